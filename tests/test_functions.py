from datetime import date

import pytest
from pyspark.sql import functions as F

from factledger.functions import contact, temporal, text, values


def column(spark, items, expression):
    df = spark.createDataFrame(list(enumerate(items)), "n long, x string")
    return [r.y for r in df.withColumn("y", expression(F.col("x"))).orderBy("n").collect()]


def test_numbers_are_equal_whatever_their_scale(spark):
    same = ["10", "10.0", "1e1", "0010", "100e-1", "+10.000"]
    assert set(column(spark, same, values.exact_number)) == {"1e1"}
    assert column(spark, ["0", "-0.00", "-2.50", "x", None, "1" * 40], values.exact_number) == ["0e0", "0e0", "-25e-1", None, None, "1" * 40 + "e0"]


def test_typed_equality_never_coerces(spark):
    pairs = [("1", "integer", "1.0", "decimal"), ("1", "text", "1", "integer"), ("true", "boolean", "true", "text"), (None, "null", None, "null"), (None, "null", "", "text"), ("a", "text", "a", "text")]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n long, a string, ta string, b string, tb string")
    got = df.withColumn("e", values.typed_equal(*[F.col(c) for c in ("a", "ta", "b", "tb")])).orderBy("n").collect()
    assert [r.e for r in got] == [True, False, False, True, False, True]


def test_url_rules(spark):
    cases = {
        "https://a.example": True, "HTTP://a.example:80/x?y#z": True, "http://[::1]:8080/": True, "ftp://a.example": False,
        "http://u:p@a.example": False, "http://u@a.example": False, "http://a.example:65536": False, "http://a.example:x": False,
        "http://": False, "https:///x": False, "http://a b": False, "http://a.example:": True,
    }
    assert column(spark, cases, values.url_parts_ok) == list(cases.values())


def test_number_text_for_sheets(spark):
    items = [0.1, 0.1 + 0.2, 1e15, -0.0, 123456789.123456789, 5e-320, 0.5, 1e16]
    df = spark.createDataFrame(list(enumerate(items)), "n long, x double")
    got = [r.y for r in df.withColumn("y", values.exact_number_text(F.col("x"))).orderBy("n").collect()]
    assert got == [None, "0.30000000000000004", "1000000000000000.0", "-0.0", "123456789.12345679", repr(5e-320), None, repr(1e16)]


def test_strict_instants_and_ages(spark):
    got = column(spark, ["2024-01-01T00:30:00+02:00", "2024-01-01T00:00:00", "2024-02-30T00:00:00Z", "2024-01-01"], lambda c: F.date_format(temporal.utc_instant(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2023-12-31 22:30", None, None, None]
    ages = column(spark, ["2000-02-29", "2000-02-28", "1999-03-01"], lambda c: temporal.age_on(c.cast("date"), F.lit("2001-02-28").cast("date")))
    assert ages == [0, 1, 1]


def test_date_rules(spark):
    rule = lambda kind, epoch: lambda c: temporal.date_by_rule(c, F.lit(kind), F.lit(epoch))
    got = column(spark, ["2024-02-29", " 2024-02-29T10:00:00Z ", "2023-02-29", "29/02/2024", "2024-01-01 24:00:00"], rule("text", False))
    assert [(r.day, r.reason) for r in got] == [
        (date(2024, 2, 29), None), (date(2024, 2, 29), None), (None, "invalid_date"), (None, "ambiguous_date_format"), (None, "invalid_date"),
    ]
    assert column(spark, ["-86400000"], rule("integer", True))[0].day == date(1969, 12, 31)
    assert column(spark, ["0"], rule("integer", False))[0].reason == "unrecognized_date_type"


def test_check_digits(spark):
    assert column(spark, ["52998224725", "52998224724", "11111111111", "5299822472", "52998224725\n"], contact.check_digits_11) == [True, False, False, False, False]
    assert column(spark, ["11222333000181", "12ABC34501DE35", "12ABC34501DE36", "00000000000000"], contact.check_digits_14) == [True, True, False, False]
    assert column(spark, ["a.b-c/d e f"], contact.clean_document) == ["ABCDEF"]


def test_email_keeps_the_local_part(spark):
    got = column(spark, ["Me@X.ORG", "a@b@C.io", "nobody", "x@y"], contact.normalize_email)
    assert [(r.normalized, r.syntax_valid) for r in got] == [("Me@x.org", True), ("a@b@c.io", False), ("nobody", False), ("x@y", False)]


def test_phone_rules_cover_every_area(spark):
    rollout = contact.rollout_table(spark)
    areas = [r.area for r in rollout.collect()]
    assert len(areas) == len(set(areas)) == 67
    rows = [(f"+55 {a} {p}123-4567", "BR", None, None) for a in areas for p in "89"]
    rows += [("11 8123-4567", None, None, None), ("+55 11 6123-4567", None, None, None), ("+55 11 8001-4567", None, None, None), ("+55 11 7123-4567", "BR", None, None)]
    rows += [("8123-4567 ext. 9", "BR", "11", "8"), ("8123-4567", None, "11", None), ("+1 11 8123-4567", "BR", None, None), ("+55 20 8123-4567", None, None, None)]
    df = spark.createDataFrame(rows, "raw string, country string, area string, extension string")
    got = contact.normalize_phones(df, rollout).collect()
    old = [r for r in got if r.country == "BR" and r.decision == "historical_conversion"]
    assert len(old) == 134 and all(len(r.canonical_number) == 14 and r.rollout_date for r in old)
    reasons = {r.raw + "|" + (r.country or ""): r.reason for r in got}
    assert reasons["11 8123-4567|"] == "country_required_for_historical_rule"
    assert reasons["+55 11 6123-4567|"] == "historical_prefix_not_proven"
    assert reasons["+55 11 8001-4567|"] == "reserved_historical_range"
    assert reasons["+55 11 7123-4567|BR"] == "specialized_or_legacy_radio"
    assert reasons["8123-4567 ext. 9|BR"] == "conflicting_extensions"
    assert reasons["8123-4567|"] == "country_required_for_ddd"
    assert reasons["+1 11 8123-4567|BR"] == "country_conflict"
    assert reasons["+55 20 8123-4567|"] == "missing_or_invalid_ddd"


def test_text_rules(spark):
    assert column(spark, ["Straße ÉÀ", None, "ﬁ"], text.fold) == ["strasse ea", None, "fi"]
    assert column(spark, ["a\x00b\tc\x1f"], text.escape_controls) == ["a\\u0000b\tc\\u001f"]
    assert column(spark, ["abcdefg", "", "abc"], lambda c: text.fragments(c, 3)) == [["abc", "def", "g"], [""], ["abc"]]
    assert column(spark, ["the cat-sat", "cathedral the"], lambda c: text.has_all_words(c, "CAT the")) == [True, False]


@pytest.mark.parametrize("declared,good", [("integer", "42"), ("decimal", "4.2"), ("date", "2024-02-29"), ("enum", "red")])
def test_declared_types(spark, declared, good):
    kinds = {"integer": "integer", "decimal": "decimal"}
    df = spark.createDataFrame([(good, kinds.get(declared, "text")), ("zzz", "text"), (None, "null")], "raw string, k string")
    checked = df.select(values.value_type_ok(F.col("raw"), F.col("k"), F.lit(declared), F.array(F.lit("red")), F.lit(False)).alias("ok"))
    assert [r.ok for r in checked.collect()] == [True, False, True]
