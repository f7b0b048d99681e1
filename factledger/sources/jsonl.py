"""JSON-lines envelopes: strict reading, nothing skipped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE_KEYS = ("source_id", "external_id", "source_version", "record")  # fixed values
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_STRINGS = r'"(?:\\.|[^"\\])*"'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with the file they came from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def strict_error(raw: Column) -> Column:
    """Why a JSON text would not survive reading: null when it would.

    Duplicate keys make variant parsing refuse the text; decimals that a binary
    double would change are found among the number tokens outside strings.
    """
    bare = F.regexp_replace(raw, _STRINGS, '""')
    literals = F.filter(
        F.regexp_extract_all(bare, F.lit(f"({_NUMBER})"), F.lit(1)), lambda n: n.rlike("[.eE]")
    )
    digits = lambda n: F.regexp_replace(
        F.regexp_replace(F.replace(F.regexp_extract(n, "([0-9.]+)", 1), F.lit("."), F.lit("")), "^0+", ""), "0+$", ""
    )
    changed = lambda n: (F.length(digits(n)) > 17) | ~F.coalesce(
        n.try_cast("double").cast("string").try_cast("decimal(38,18)") == n.try_cast("decimal(38,18)"),
        digits(n.try_cast("double").cast("string")) == digits(n),
    )
    return (
        F.when(bare.rlike(r"\b(NaN|Infinity)\b"), "json_non_finite")
        .when(F.exists(literals, changed), "json_number_precision")
        .when(F.try_parse_json(raw).isNotNull(), None)
        .when(F.json_object_keys(raw).isNotNull() | F.from_json(raw, "map<string,string>").isNotNull(), "json_duplicate_keys")
        .otherwise("json_invalid")
    )


def envelopes(lines: DataFrame, line: str = "line") -> DataFrame:
    """Envelope columns of every line and the reason a line is refused.

    The line itself stays beside them: leaves are taken from it, so numbers
    keep the spelling they arrived with.
    """
    parsed = F.try_parse_json(line)
    kind = lambda key: F.coalesce(
        F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")), F.lit("absent")
    )
    keys = F.json_object_keys(line)
    foreign = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ENVELOPE_KEYS]))) > 0
    text = lambda key: F.get_json_object(line, f"$.{key}")
    error = (
        F.when(parsed.isNull(), strict_error(F.col(line)))
        .when(keys.isNull() | foreign | ~F.startswith(kind("record"), F.lit("OBJECT")), "invalid_envelope")
        .when((kind("source_id") != "STRING") | (text("source_id") == ""), "unknown_source")
        .when((kind("external_id") != "STRING") | (text("external_id") == ""), "invalid_envelope")
        .when(~kind("source_version").isin("absent", "VOID", "STRING", "BIGINT"), "invalid_source_version")
    )
    return lines.select(
        "*",
        text("source_id").alias("source_id"),
        text("external_id").alias("external_id"),
        text("source_version").alias("source_version"),
        error.alias("error"),
    )


def split(enveloped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) halves of ``envelopes``."""
    return enveloped.filter(F.col("error").isNull()).drop("error"), enveloped.filter(F.col("error").isNotNull())
