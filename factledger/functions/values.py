"""Typed values: fingerprints, scalar columns, type checks, exact numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 8192
DECIMAL_TEXT = r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with sorted keys and explicit nulls."""
    ordered = [columns[name].alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def fingerprint(**columns: Column) -> Column:
    return F.sha2(canonical_json(**columns), 256)


def exact_number(text: Column) -> Column:
    """Scale-free spelling of a number: ``1``, ``1.0`` and ``10e-1`` are equal.

    Works on the digits of the text, so no precision is lost at any size:
    significant digits without trailing zeros, then the exponent they need.
    """
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    mantissa = F.regexp_extract(text, r"\A[+-]?([0-9.]+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)\z", 1).try_cast("bigint"), F.lit(0))
    fraction = F.regexp_extract(mantissa, r"\.([0-9]*)", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"\A0+", "")
    kept = F.regexp_replace(digits, r"0+\z", "")
    exponent = power - F.length(fraction) + F.length(digits) - F.length(kept)
    spelled = F.when(kept == "", "0e0").otherwise(F.concat(sign, kept, F.lit("e"), exponent.cast("string")))
    return F.when(text.rlike(DECIMAL_TEXT), spelled)


def typed_scalar(value: Column, json_type: Column) -> Column:
    """Value split into one typed column, or the reason it cannot be indexed."""
    unsafe = F.contains(value, F.lit("\x00"))
    long_text = F.octet_length(value) > MAX_TEXT_BYTES
    text = json_type == "text"
    reason = (
        F.when(~json_type.isin("null", "boolean", "integer", "decimal", "text"), "unsupported_values")
        .when(text & unsafe, "unsafe_text")
        .when(text & long_text, "long_text")
    )
    usable = reason.isNull()
    return F.struct(
        F.when(usable, json_type).alias("value_type"),
        F.when(usable & text, value).alias("value_exact"),
        F.when(usable & (json_type == "boolean"), value == "true").alias("value_boolean"),
        F.when(usable & json_type.isin("integer", "decimal"), exact_number(value)).alias("number_exact"),
        reason.alias("omitted"),
    )


def typed_equal(left: Column, left_type: Column, right: Column, right_type: Column) -> Column:
    """JSON equality without coercion: numbers by value, other types alone."""
    numeric = left_type.isin("integer", "decimal") & right_type.isin("integer", "decimal")
    return F.coalesce(
        F.when(numeric, exact_number(left) == exact_number(right))
        .when(left_type != right_type, False)
        .when(left_type == "null", True)
        .otherwise(left == right),
        F.lit(False),
    )


def url_parts_ok(url: Column) -> Column:
    """http(s), a host, no credentials, a port that exists."""
    authority = F.regexp_extract(url, r"\A(?i:https?)://([^/?#]*)", 1)
    userinfo = F.regexp_extract(authority, r"\A(.*)@", 1)
    hostport = F.regexp_replace(authority, r"\A.*@", "")
    host = F.regexp_extract(hostport, r"\A(\[[^\]]+\]|[^:\[\]]*)(?::[^:]*)?\z", 1)
    port = F.regexp_extract(hostport, r"\A(?:\[[^\]]+\]|[^:]*):(.*)\z", 1)
    return F.coalesce(
        url.rlike(r"\A(?i:https?)://")
        & ~url.rlike(r"[\s\x00-\x20\x0b\x1c-\x1f\x85\p{Z}]")
        & (host != "")
        & ~userinfo.rlike("[^:]")
        & ((port == "") | (port.rlike(r"\A[0-9]{1,9}\z") & (F.coalesce(port.try_cast("int"), F.lit(65536)) <= 65535))),
        F.lit(False),
    )


def value_type_ok(raw: Column, json_type: Column, declared: Column, options: Column, reference_found: Column) -> Column:
    """Value against a declared field type, without coercion; null always passes."""
    text = json_type == "text"
    number = json_type.isin("integer", "decimal")
    day = F.when(raw.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(raw, "yyyy-MM-dd"))
    good = (
        F.when(declared == "text", text)
        .when(declared == "integer", json_type == "integer")
        .when(declared == "decimal", number | (text & raw.rlike(DECIMAL_TEXT)))
        .when(declared == "boolean", json_type == "boolean")
        .when(declared == "date", text & day.isNotNull())
        .when(declared == "enum", text & F.array_contains(options, raw))
        .when(declared == "url", text & url_parts_ok(raw))
        .when(declared == "reference", (json_type == "object") & reference_found)
    )
    return (json_type == "null") | F.coalesce(good, F.lit(False))


def plain_number_text(x: Column) -> Column:
    """Shortest decimal text of a double, with exponents only far from 1."""
    text = x.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"\A(-?[0-9.]+)E", 1), r"\.0\z", "")
    power = F.regexp_extract(text, r"E(-?)([0-9]+)\z", 2)
    sign = F.when(F.contains(text, F.lit("E-")), "-").otherwise("+")
    padded = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    exponent = F.concat(mantissa, F.lit("e"), sign, padded)
    spread = text.try_cast("decimal(38,18)").cast("string")
    decimal = F.regexp_replace(spread, r"(\.[0-9]+?)0+\z", "$1")
    size = F.abs(x)
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e16) | (size < 1e-4), exponent)
        .otherwise(decimal)
    )


def exact_number_text(x: Column) -> Column:
    """Text of a double a 15-digit spreadsheet cell would change, else null."""
    fifteen = F.format_string("%.14e", x).try_cast("double")
    size = F.abs(x)
    unsafe = (
        (size > 999999999999999.0)
        | ((x != 0.0) & (size < 2.2250738585072014e-308))
        | ((x == 0.0) & F.startswith(x.cast("string"), F.lit("-")))
        | (fifteen != x)
    )
    return F.when(unsafe, plain_number_text(x))


def exact_integer_text(n: Column) -> Column:
    """Text of an integer beyond 15 digits, else null."""
    return F.when(F.abs(n) > 999999999999999, n.cast("string"))
