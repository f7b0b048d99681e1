"""Normalisation of documents, addresses, handles and phone numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.functions.text import SPACE, casefold, composed

# Fixed values of the two check-digit schemes (mod 11).
WEIGHTS_11 = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
WEIGHTS_14 = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))

# The day each area code adopted nine-digit mobile numbers.
NINTH_DIGIT_ROLLOUT = {
    "2012-07-29": "11",
    "2013-08-25": "12 13 14 15 16 17 18 19",
    "2013-10-27": "21 22 24 27 28",
    "2014-11-02": "91 92 93 94 95 96 97 98 99",
    "2015-05-31": "81 82 83 84 85 86 87 88 89",
    "2015-10-11": "31 32 33 34 35 37 38 71 73 74 75 77 79",
    "2016-05-29": "61 62 63 64 65 66 67 68 69",
    "2016-11-06": "41 42 43 44 45 46 47 48 49 51 53 54 55",
}


def clean_document(number: Column) -> Column:
    """Drop dots, dashes, slashes and blanks; upper-case the rest."""
    return F.upper(F.regexp_replace(number, rf"[.\-/{SPACE}]", ""))


def _weighted(number: Column, weights: tuple[int, ...]) -> Column:
    """Sum of (code point - 48) times weight over the leading characters."""
    terms = [(F.ascii(F.substring(number, i, 1)) - 48) * w for i, w in enumerate(weights, 1)]
    return reduce(lambda a, b: a + b, terms)


def _digit(number: Column, position: int) -> Column:
    return F.ascii(F.substring(number, position, 1)) - 48


def _uniform(number: Column) -> Column:
    return number == F.repeat(F.substring(number, 1, 1), F.length(number))


def check_digits_11(number: Column) -> Column:
    """Eleven digits whose last two satisfy the weighted sums."""
    good = number.rlike(r"\A[0-9]{11}\z") & ~_uniform(number)
    for weights in WEIGHTS_11:
        remainder = (_weighted(number, weights) * 10) % 11
        good = good & (_digit(number, len(weights) + 1) == F.when(remainder == 10, 0).otherwise(remainder))
    return F.coalesce(good, F.lit(False))


def check_digits_14(number: Column) -> Column:
    """Twelve letters or digits and two check digits."""
    good = number.rlike(r"\A[A-Z0-9]{12}[0-9]{2}\z") & ~_uniform(number)
    for weights in WEIGHTS_14:
        remainder = _weighted(number, weights) % 11
        good = good & (_digit(number, len(weights) + 1) == F.when(remainder < 2, 0).otherwise(11 - remainder))
    return F.coalesce(good, F.lit(False))


def normalize_email(address: Column) -> Column:
    """``struct(normalized, syntax_valid, decision, status)``; local part kept."""
    domain = F.regexp_extract(address, r"(?s)\A.*@([^@]*)\z", 1)
    local = F.regexp_extract(address, r"(?s)\A(.*)@[^@]*\z", 1)
    valid = F.coalesce(
        address.rlike(rf"\A[^{SPACE}@]+@[^{SPACE}@]+\.[^{SPACE}@]+\z"), F.lit(False)
    )
    return F.struct(
        F.when(F.contains(address, F.lit("@")), F.concat(local, F.lit("@"), F.lower(domain)))
        .otherwise(address)
        .alias("normalized"),
        valid.alias("syntax_valid"),
        F.when(valid, "domain_normalized").otherwise("review").alias("decision"),
        F.when(valid, "normalized").otherwise("pending").alias("status"),
    )


def normalize_postal(code: Column, country: Column) -> Column:
    """``struct(normalized, syntax_valid, rule, status)``; no country is guessed."""
    home = F.coalesce(country == "BR", F.lit(False))
    candidate = F.when(home, F.regexp_replace(code, rf"[-{SPACE}]", "")).otherwise(code)
    valid = F.when(home, candidate.rlike(r"\A[0-9]{8}\z"))
    kept = F.coalesce(valid, F.lit(False))
    return F.struct(
        F.when(kept, candidate).otherwise(code).alias("normalized"),
        valid.alias("syntax_valid"),
        F.when(home, "br-postal-format").otherwise("postal-preserve").alias("rule"),
        F.when(kept, "normalized").otherwise("pending").alias("status"),
    )


def normalize_handle(platform: Column, account: Column) -> Column:
    """``struct(platform, account)``: the platform is folded, the account literal."""
    return F.struct(casefold(platform).alias("platform"), account.alias("account"))


def address_component(field: Column, value: Column, json_type: Column) -> Column:
    """``struct(normalized, reason)`` of one address component."""
    text = composed(F.regexp_replace(value, rf"\A[{SPACE}]+|[{SPACE}]+\z", ""))
    postal = F.regexp_replace(text, rf"[-{SPACE}]", "")

    def outcome(normalized: Column, reason: str | Column | None) -> Column:
        why = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(normalized.cast("string").alias("normalized"), why.cast("string").alias("reason"))

    return (
        F.when(json_type == "null", outcome(value, "missing_value"))
        .when((field == "number") & (json_type == "integer"), outcome(value, None))
        .when(json_type != "text", outcome(value, "unrecognized_address_component"))
        .when(text == "", outcome(text, "empty_value"))
        .when(
            field == "postal_code",
            outcome(postal, F.when(~postal.rlike(r"\A[0-9]{8}\z"), "postal_code_requires_review")),
        )
        .when((field == "state") & text.rlike(r"\A[A-Za-z]{2}\z"), outcome(F.upper(text), None))
        .otherwise(outcome(text, None))
    )


def rollout_table(spark: SparkSession) -> DataFrame:
    """Dimension ``area, rollout_date`` (67 rows)."""
    rows = [(area, day) for day, areas in NINTH_DIGIT_ROLLOUT.items() for area in areas.split()]
    return spark.createDataFrame(rows, "area string, rollout_date string")


_EXTENSION = r"(?i)(?:\s*(?:ext\.?|ramal|x|#)\s*|;ext=)([0-9]{1,10})\z"


# Countries of the ISO list without telephone numbers of their own, and regions with numbers that it lacks.
_NO_NUMBERS = {"AQ", "BV", "GS", "HM", "PN", "TF", "UM"}
_MORE_REGIONS = {"AC", "TA", "XK"}


def phone_regions(spark: SparkSession) -> list[str]:
    """Codes of the countries that have telephone numbers."""
    countries = set(spark._jvm.java.util.Locale.getISOCountries())
    return sorted((countries - _NO_NUMBERS) | _MORE_REGIONS)


def normalize_phones(phones: DataFrame, rollout: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Add the outcome of the area-code rules to ``raw, country, area, extension``.

    With ``regions`` a country that is none of them is unknown, whatever the rest says.

    ``rollout`` is a dimension of known area codes, small by nature (an area
    code has two digits). Nothing is added to a number unless the country is
    explicit and the historic rule covers its prefix; everything else keeps its
    digits and says why it needs review.
    """
    trimmed = F.regexp_replace(F.regexp_replace("raw", rf"\A[{SPACE}]+|[{SPACE}]+\z", ""), r"(?i)\Atel:", "")
    inline = F.nullif(F.regexp_extract("_text", _EXTENSION, 1), F.lit(""))
    parts = (
        phones.withColumn("_text", trimmed)
        .withColumn("_inline", inline)
        .withColumn("_body", F.trim(F.regexp_replace("_text", _EXTENSION, "")))
        .withColumn("_given", F.nullif(F.col("extension"), F.lit("")))
        .withColumn("_compact", F.regexp_replace("_body", r"[\s().-]", ""))
        .withColumn("_home", F.coalesce(F.upper(F.trim("country")) == "BR", F.lit(False)))
        .withColumn("_explicit", F.coalesce(F.trim("country") != "", F.lit(False)))
        .withColumn("_plus", F.startswith("_compact", F.lit("+")))
        .withColumn("_dialled", F.startswith("_compact", F.lit("+55")))
        .withColumn(
            "_certain", F.when(F.col("_explicit"), F.col("_home")).otherwise(F.col("_dialled"))
        )
        .withColumn(
            "_local_only", F.col("area").isNotNull() & ~F.col("_plus") & F.length("_compact").isin(8, 9)
        )
        .withColumn(
            "_national",
            F.when(F.col("_dialled"), F.substring("_compact", 4, 40))
            .when(F.col("_local_only"), F.concat("area", "_compact"))
            .when(~F.col("_plus"), F.col("_compact")),
        )
        .withColumn("_area", F.when(F.length("_national").isin(10, 11), F.substring("_national", 1, 2)))
        .withColumn("_local", F.substring("_national", 3, 9))
    )
    known = F.broadcast(rollout.withColumnRenamed("area", "_area"))
    listed = F.broadcast(rollout.select(F.col("area").alias("_said"), F.lit(True).alias("_listed")))
    joined = parts.join(known, "_area", "left").join(listed, F.col("area") == F.col("_said"), "left")
    short, first = F.length("_local") == 8, F.substring("_local", 1, 1)
    legacy = short & first.isin("6", "8", "9")
    unknown = F.lit(False) if regions is None else F.col("_explicit") & ~F.upper(F.trim("country")).isin(regions)
    reason = (
        F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "non_text_or_empty_number")
        .when(F.col("_given").isNotNull() & ~F.col("_given").rlike(r"\A[0-9]{1,10}\z"), "invalid_extension")
        .when(F.col("_inline") != F.col("_given"), "conflicting_extensions")
        .when(~F.col("_body").rlike(r"\A\+?[0-9\s().-]+\z"), "unsupported_characters")
        .when(unknown, "unknown_country")
        .when(F.col("area").isNotNull() & F.col("_listed").isNull(), "invalid_ddd")
        .when(F.col("_local_only") & ~F.col("_certain"), "country_required_for_ddd")
        .when(F.col("_explicit") & ~F.col("_home"), "country_not_covered")
        .when(F.col("_home") & F.col("_plus") & ~F.col("_dialled"), "country_conflict")
        .when(F.col("_plus") & ~F.col("_dialled"), "country_not_covered")
        .when(F.col("_area").isNotNull() & (F.col("area") != F.col("_area")), "ddd_conflict")
        .when(F.col("rollout_date").isNull(), "missing_or_invalid_ddd")
        .when(short & (first == "7"), "specialized_or_legacy_radio")
        .when(short & first.between("2", "5"), None)
        .when((F.length("_local") == 9) & (first == "9"), None)
        .when(legacy & ~F.col("_certain"), "country_required_for_historical_rule")
        .when(legacy & (first == "6"), "historical_prefix_not_proven")
        .when(legacy & (F.substring("_local", 2, 2) == "00"), "reserved_historical_range")
        .when(legacy, None)
        .otherwise("invalid_current_format")
    )
    decided = joined.withColumn("reason", reason).withColumn("_good", F.col("reason").isNull())
    number = F.concat(F.lit("+55"), "_area", F.when(legacy, F.lit("9")).otherwise(F.lit("")), "_local")
    return (
        decided.withColumns(
            {
                "canonical_number": F.when(F.col("_good"), number),
                "decision": F.when(~F.col("_good"), "review").when(legacy, "historical_conversion").otherwise("canonical"),
                "rule_id": F.when(F.col("_good"), F.when(legacy, "br_smp_8_9_add_ninth").otherwise("current_plan")),
                "classification": F.when(F.col("_good"), F.when(short & ~legacy, "fixed").otherwise("mobile")).otherwise("unknown"),
                "rollout_date": F.when(F.col("_good") & legacy, F.col("rollout_date")),
                "phone_extension": F.coalesce("_inline", "_given"),
            }
        )
        .drop(*[c for c in decided.columns if c.startswith("_")])
    )
