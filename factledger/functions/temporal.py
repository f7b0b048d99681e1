"""Dates and instants: strict parsing, declared rules, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date and time spellings that the rules tell apart.
ISO_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?"
_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})?\z"
_OFFSET = r"(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
# day, hour, minute, second, fraction, then the offset or its sign, hours and minutes
ISO_INSTANT = (
    r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[\s\S]([01][0-9]|2[0-3])(?::([0-5][0-9])(?::([0-5][0-9])(?:[.,]([0-9]+))?)?)?"
    r"(?:Z|([+-])([01][0-9]|2[0-3])(?::?([0-5][0-9]))?)\z"
)
_GOOD = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]" + _CLOCK + _OFFSET + r"?\z"


def parse_date(text: Column) -> Column:
    """ISO calendar date or null; impossible days are null, never shifted."""
    return F.when(text.rlike(ISO_DATE), F.try_to_date(text, "yyyy-MM-dd"))


def utc_instant(text: Column) -> Column:
    """Instant with an explicit offset, in UTC; null without one.

    Minutes, seconds and the colon of the offset may be missing; digits after
    the microsecond are cut off.
    """
    part = lambda n: F.regexp_extract(text, ISO_INSTANT, n)
    or_zero = lambda n: F.coalesce(F.nullif(part(n), F.lit("")), F.lit("00"))
    fraction = F.rpad(F.substring(part(5), 1, 6), 6, "0")
    spelled = F.concat(part(1), F.lit("T"), part(2), F.lit(":"), or_zero(3), F.lit(":"), or_zero(4), F.lit("."), fraction, F.lit("Z"))
    sign = F.when(part(6) == "-", -1).otherwise(1)
    ahead = F.make_dt_interval(F.lit(0), sign * or_zero(7).try_cast("int"), sign * or_zero(8).try_cast("int"))
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return F.when(text.rlike(ISO_INSTANT) & day.isNotNull(), F.try_to_timestamp(spelled) - ahead)


def _whole_millis(raw: Column) -> Column:
    """Milliseconds of an integer or of a decimal without a fraction."""
    exact = raw.try_cast("decimal(38,6)")
    return F.when(exact == F.floor(exact), exact.try_cast("bigint"))


def _is_whole(raw: Column, json_type: Column) -> Column:
    exact = raw.try_cast("decimal(38,6)")
    return (json_type == "integer") | ((json_type == "decimal") & F.coalesce(exact == F.floor(exact), F.lit(False)))


def datetime_by_rule(raw: Column, json_type: Column, epoch_declared: Column) -> Column:
    """``struct(moment, rule, reason)``: the rules of :func:`date_by_rule` with the time of day kept.

    ``moment`` is ISO text: the offset as it was written, none if there was
    none, and UTC for milliseconds; a fraction has six digits or is left out.
    """
    ruled = date_by_rule(raw, json_type, epoch_declared)
    text = F.trim(raw)

    def with_fraction(digits: Column) -> Column:
        six = F.rpad(digits, 6, "0")
        return F.when((digits == "") | (six == "000000"), "").otherwise(F.concat(F.lit("."), six))

    offset = F.regexp_extract(text, r"(Z|[+-][0-9]{2}:[0-9]{2})\z", 1)
    offset = F.when(offset.isin("Z", "-00:00"), "+00:00").otherwise(offset)
    fraction = with_fraction(F.regexp_extract(text, r"\.([0-9]{1,6})", 1))
    written = F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), fraction, offset)
    millis = _whole_millis(raw)
    clock = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss")
    counted = F.concat(clock, with_fraction(F.lpad(F.pmod(millis, F.lit(1000)).cast("string"), 3, "0")), F.lit("+00:00"))
    rule = ruled["rule"]
    timed = rule == "iso_calendar_from_datetime"
    moment = F.when(timed, written).when(rule == "declared_epoch_millis", counted).otherwise(ruled["day"].cast("string"))
    return F.struct(moment.alias("moment"), F.when(timed, "iso_datetime").otherwise(rule).alias("rule"), ruled["reason"].alias("reason"))


def date_by_rule(raw: Column, json_type: Column, epoch_declared: Column) -> Column:
    """``struct(day, rule, reason)`` of a source value under the date rules.

    Whole numbers are milliseconds only where the source declares them. A date-time
    keeps the calendar day it was written with.
    """
    text = F.trim(raw)
    from_epoch = F.to_date(F.timestamp_millis(_whole_millis(raw)))
    shaped = text.rlike(_SHAPE)
    whole = F.when(text.rlike(_GOOD), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    day = parse_date(text)

    def outcome(value: Column | None, rule: str | None, reason: str | None) -> Column:
        return F.struct(
            (F.lit(None).cast("date") if value is None else value).alias("day"),
            F.lit(rule).cast("string").alias("rule"),
            F.lit(reason).cast("string").alias("reason"),
        )

    return (
        F.when(json_type == "null", outcome(None, None, "missing_value"))
        .when(
            epoch_declared & _is_whole(raw, json_type),
            F.when(from_epoch.isNotNull(), outcome(from_epoch, "declared_epoch_millis", None)).otherwise(
                outcome(None, None, "invalid_date")
            ),
        )
        .when(json_type != "text", outcome(None, None, "unrecognized_date_type"))
        .when(
            text.rlike(ISO_DATE),
            F.when(day.isNotNull(), outcome(day, "iso_calendar_date", None)).otherwise(outcome(None, None, "invalid_date")),
        )
        .when(
            shaped,
            F.when(whole.isNotNull(), outcome(whole, "iso_calendar_from_datetime", None)).otherwise(
                outcome(None, None, "invalid_date")
            ),
        )
        .otherwise(outcome(None, None, "ambiguous_date_format"))
    )


def age_on(born: Column, today: Column) -> Column:
    """Completed years; a 29 February birthday is passed on 1 March."""
    passed = (F.month(today) * 100 + F.day(today)) >= (F.month(born) * 100 + F.day(born))
    return F.year(today) - F.year(born) - F.when(passed, 0).otherwise(1)
