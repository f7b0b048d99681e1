"""Normalisation jobs: input column, normalised column, rule and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions import contact, temporal, text, values
from factledger.operators import keys
from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.tables import Tables


@query(
    "doc_clean",
    """
SELECT c_custkey, raw, upper(regexp_replace(raw, '[-./\\s]', '', 'g')) AS normalized,
       upper(regexp_replace(raw, '[-./\\s]', '', 'g')) IS DISTINCT FROM raw AS changed
FROM (SELECT c_custkey, substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 3) || '.' || substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 4, 3)
             || '/' || substr(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 7, 3) || '-' || lower(substr(c_mktsegment, 1, 1)) || ' ' AS raw FROM customer)
""",
)
def doc_clean(t: Tables):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    raw = F.concat(
        F.substring(key, 1, 3), F.lit("."), F.substring(key, 4, 3), F.lit("/"), F.substring(key, 7, 3),
        F.lit("-"), F.lower(F.substring("c_mktsegment", 1, 1)), F.lit(" "),
    )
    rows = t.customer.select("c_custkey", raw.alias("raw")).withColumn("normalized", contact.clean_document(F.col("raw")))
    return rows.withColumn("changed", ~F.col("raw").eqNullSafe(F.col("normalized")))


@query(
    "doc_check11",
    """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000000000 AS VARCHAR), 9, '0') || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS number FROM orders),
s AS (SELECT *, (list_sum(list_transform(range(1, 10), lambda i: CAST(substr(number, i, 1) AS INTEGER) * (11 - i))) * 10) % 11 AS r1,
         (list_sum(list_transform(range(1, 11), lambda i: CAST(substr(number, i, 1) AS INTEGER) * (12 - i))) * 10) % 11 AS r2 FROM n)
SELECT o_orderkey, number, CAST(substr(number, 10, 1) AS INTEGER) = (CASE WHEN r1 = 10 THEN 0 ELSE r1 END)
       AND CAST(substr(number, 11, 1) AS INTEGER) = (CASE WHEN r2 = 10 THEN 0 ELSE r2 END)
       AND number <> repeat(substr(number, 1, 1), 11) AS syntax_valid FROM s
""",
)
def doc_check11(t: Tables):
    number = F.concat(
        F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0"),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
    )
    rows = t.orders.select("o_orderkey", number.alias("number"))
    return rows.withColumn("syntax_valid", contact.check_digits_11(F.col("number")))


@query(
    "doc_check14",
    """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '1' END || lpad(CAST(o_orderkey AS VARCHAR), 11, '0')
                  || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS number FROM orders),
s AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: (ascii(substr(number, i, 1)) - 48) * [5,4,3,2,9,8,7,6,5,4,3,2][i])) % 11 AS r1,
         list_sum(list_transform(range(1, 14), lambda i: (ascii(substr(number, i, 1)) - 48) * [6,5,4,3,2,9,8,7,6,5,4,3,2][i])) % 11 AS r2 FROM n)
SELECT o_orderkey, number, ascii(substr(number, 13, 1)) - 48 = (CASE WHEN r1 < 2 THEN 0 ELSE 11 - r1 END)
       AND ascii(substr(number, 14, 1)) - 48 = (CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END) AS syntax_valid FROM s
""",
)
def doc_check14(t: Tables):
    number = F.concat(
        F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("1"),
        F.lpad(F.col("o_orderkey").cast("string"), 11, "0"),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
    )
    rows = t.orders.select("o_orderkey", number.alias("number"))
    return rows.withColumn("syntax_valid", contact.check_digits_14(F.col("number")))


def found_addresses(t: Tables):
    """Every address-like word of every document, domains partly upper-cased."""
    found = F.regexp_extract_all("text", F.lit(r"[^\s@]+@[^\s@]+"), F.lit(0))
    rows = t.spread("documents").select("doc_id", F.posexplode(found).alias("pos", "word"))
    return rows.select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        F.when(F.col("doc_id") % 2 == 0, F.upper("word")).otherwise(F.col("word")).alias("raw"),
    )


FOUND = """
lists AS (SELECT doc_id, regexp_extract_all(text, '[^\\s@]+@[^\\s@]+') AS f FROM documents),
found AS (SELECT doc_id, unnest(range(0, len(f))) AS pos, unnest(f) AS word FROM lists),
addresses AS (SELECT doc_id, pos, CASE WHEN doc_id % 2 = 0 THEN upper(word) ELSE word END AS raw FROM found),
emails AS (SELECT doc_id, pos, raw, regexp_extract(raw, '(?s)^(.*)@[^@]*$', 1) || '@' || lower(regexp_extract(raw, '(?s)^.*@([^@]*)$', 1)) AS normalized,
       regexp_matches(raw, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS syntax_valid FROM addresses)"""


@query(
    "email_normalize",
    q.with_(
        FOUND,
        """SELECT doc_id, pos, raw, normalized, syntax_valid,
       CASE WHEN syntax_valid THEN 'domain_normalized' ELSE 'review' END AS decision,
       CASE WHEN syntax_valid THEN 'normalized' ELSE 'pending' END AS status FROM emails""",
    ),
)
def email_normalize(t: Tables):
    return found_addresses(t).withColumn("r", contact.normalize_email(F.col("raw"))).select("doc_id", "pos", "raw", "r.*")


@query(
    "postal_normalize",
    """
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'BR' WHEN c_custkey % 3 = 1 THEN 'US' END AS country,
  substr(lpad(CAST(c_custkey * 13 AS VARCHAR), 8, '0'), 1, 5) || CASE WHEN c_custkey % 6 = 0 THEN '-' ELSE ' ' END
  || substr(lpad(CAST(c_custkey * 13 AS VARCHAR), 8, '0'), 6, 3) || CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE '' END AS raw FROM customer),
c AS (SELECT *, regexp_replace(raw, '[-\\s]', '', 'g') AS stripped FROM p)
SELECT c_custkey, country, raw, CASE WHEN country = 'BR' AND regexp_matches(stripped, '^[0-9]{8}$') THEN stripped ELSE raw END AS normalized,
  CASE WHEN country = 'BR' THEN regexp_matches(stripped, '^[0-9]{8}$') END AS syntax_valid,
  CASE WHEN country = 'BR' THEN 'br-postal-format' ELSE 'postal-preserve' END AS rule,
  CASE WHEN country = 'BR' AND regexp_matches(stripped, '^[0-9]{8}$') THEN 'normalized' ELSE 'pending' END AS status FROM c
""",
)
def postal_normalize(t: Tables):
    key = F.col("c_custkey")
    digits = F.lpad((key * 13).cast("string"), 8, "0")
    raw = F.concat(
        F.substring(digits, 1, 5), F.when(key % 6 == 0, "-").otherwise(" "), F.substring(digits, 6, 3),
        F.when(key % 9 == 0, "x").otherwise(""),
    )
    country = F.when(key % 3 == 0, "BR").when(key % 3 == 1, "US")
    rows = t.customer.select("c_custkey", country.alias("country"), raw.alias("raw"))
    return rows.withColumn("r", contact.normalize_postal(F.col("raw"), F.col("country"))).select(
        "c_custkey", "country", "raw", "r.*"
    )


@query(
    "handle_normalize",
    """SELECT page_id, lower(regexp_extract(upper(url), '^[A-Z]+://([^/?#]*)', 1)) AS platform,
       regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS account FROM pages""",
)
def handle_normalize(t: Tables):
    platform = F.regexp_extract(F.upper("url"), "^[A-Z]+://([^/?#]*)", 1)
    account = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)\z", 1)
    return t.pages.select("page_id", contact.normalize_handle(platform, account).alias("r")).select("page_id", "r.*")


@query(
    "phone_area_rule",
    """
WITH roll AS (SELECT unnest(string_split(areas, ' ')) AS a, day FROM (VALUES
  ('2012-07-29', '11'), ('2013-08-25', '12 13 14 15 16 17 18 19'), ('2013-10-27', '21 22 24 27 28'),
  ('2014-11-02', '91 92 93 94 95 96 97 98 99'), ('2015-05-31', '81 82 83 84 85 86 87 88 89'),
  ('2015-10-11', '31 32 33 34 35 37 38 71 73 74 75 77 79'), ('2016-05-29', '61 62 63 64 65 66 67 68 69'),
  ('2016-11-06', '41 42 43 44 45 46 47 48 49 51 53 54 55')) v(day, areas)),
n AS (SELECT o_orderkey, CAST(10 + o_orderkey % 90 AS VARCHAR) AS ar,
  CAST(o_custkey % 10 AS VARCHAR) || lpad(CAST(o_orderkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS loc, o_orderkey % 7 AS style,
  CASE WHEN o_orderkey % 9 = 5 THEN 'xx ' WHEN o_orderkey % 4 = 0 THEN 'BR' WHEN o_orderkey % 4 = 1 THEN ' br ' END AS country FROM orders),
x AS (SELECT *, CASE style WHEN 0 THEN '+55 (' || ar || ') ' || substr(loc,1,4) || '-' || substr(loc,5) WHEN 1 THEN ar || ' ' || loc
    WHEN 2 THEN 'tel:+55' || ar || loc || ' ramal 12' WHEN 3 THEN loc WHEN 4 THEN 'call ' || loc WHEN 5 THEN '  ' ELSE ar || '9' || loc END AS raw,
  CASE WHEN style = 3 THEN ar END AS area FROM n),
o AS (SELECT x.*, r.day, style IN (0, 2) OR country IS NOT NULL AS certain,
  CASE WHEN style = 6 THEN '9' || loc ELSE loc END AS l FROM x LEFT JOIN roll r ON r.a = x.ar),
d AS (SELECT *, CASE WHEN style = 5 THEN 'non_text_or_empty_number' WHEN style = 4 THEN 'unsupported_characters'
   WHEN country = 'xx ' THEN 'unknown_country' WHEN style = 3 AND day IS NULL THEN 'invalid_ddd'
   WHEN style = 3 AND NOT certain THEN 'country_required_for_ddd' WHEN day IS NULL THEN 'missing_or_invalid_ddd'
   WHEN length(l) = 9 THEN NULL
   WHEN l[1] = '7' THEN 'specialized_or_legacy_radio' WHEN l[1] IN ('2','3','4','5') THEN NULL
   WHEN l[1] IN ('6','8','9') AND NOT certain THEN 'country_required_for_historical_rule'
   WHEN l[1] = '6' THEN 'historical_prefix_not_proven' WHEN l[1] IN ('8','9') AND l[2:3] = '00' THEN 'reserved_historical_range'
   WHEN l[1] IN ('8','9') THEN NULL ELSE 'invalid_current_format' END AS reason FROM o),
e AS (SELECT *, length(l) = 8 AND l[1] IN ('8','9') AS old FROM d)
SELECT o_orderkey, raw, country, area, CASE WHEN style = 2 THEN '12' END AS phone_extension, reason,
  CASE WHEN reason IS NULL THEN '+55' || ar || CASE WHEN old THEN '9' ELSE '' END || l END AS canonical_number,
  CASE WHEN reason IS NOT NULL THEN 'review' WHEN old THEN 'historical_conversion' ELSE 'canonical' END AS decision,
  CASE WHEN reason IS NULL THEN CASE WHEN old THEN 'br_smp_8_9_add_ninth' ELSE 'current_plan' END END AS rule_id,
  CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN length(l) = 8 AND NOT old THEN 'fixed' ELSE 'mobile' END AS classification,
  CASE WHEN reason IS NULL AND old THEN day END AS rollout_date FROM e
""",
)
def phone_area_rule(t: Tables):
    key, style = F.col("o_orderkey"), F.col("o_orderkey") % 7
    area = (F.lit(10) + key % 90).cast("string")
    local = F.concat(
        (F.col("o_custkey") % 10).cast("string"), F.lpad((key * 7919 % 10000000).cast("string"), 7, "0")
    )
    raw = (
        F.when(style == 0, F.concat(F.lit("+55 ("), area, F.lit(") "), F.substring(local, 1, 4), F.lit("-"), F.substring(local, 5, 4)))
        .when(style == 1, F.concat(area, F.lit(" "), local))
        .when(style == 2, F.concat(F.lit("tel:+55"), area, local, F.lit(" ramal 12")))
        .when(style == 3, local)
        .when(style == 4, F.concat(F.lit("call "), local))
        .when(style == 5, F.lit("  "))
        .otherwise(F.concat(area, F.lit("9"), local))
    )
    phones = t.spread("orders").select(
        "o_orderkey",
        raw.alias("raw"),
        F.when(key % 9 == 5, "xx ").when(key % 4 == 0, "BR").when(key % 4 == 1, " br ").alias("country"),
        F.when(style == 3, area).alias("area"),
        F.lit(None).cast("string").alias("extension"),
    )
    regions = contact.phone_regions(t.spark)
    return contact.normalize_phones(phones, contact.rollout_table(t.spark), regions).drop("extension")


@query("text_fold", "SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def text_fold(t: Tables):
    return t.spread("documents").select("doc_id", text.fold("text").alias("folded"))


@query(
    "ts_utc_strict",
    """
WITH f AS (SELECT event_id, ts, event_id % 9 AS style, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s FROM events),
r AS (SELECT *, CASE style WHEN 0 THEN s || 'Z' WHEN 1 THEN s || '+02:00' WHEN 2 THEN s WHEN 3 THEN substr(s, 1, 10)
    WHEN 4 THEN replace(s, 'T', ' ') || '-03:30' WHEN 6 THEN substr(s, 1, 16) || '+00:00' WHEN 7 THEN s || '.1234567Z' WHEN 8 THEN s || '+0300'
    ELSE '2024-02-30T00:00:00Z' END AS raw FROM f)
SELECT event_id, raw, CASE style WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
    WHEN 4 THEN date_trunc('second', ts) + INTERVAL 210 MINUTE WHEN 6 THEN date_trunc('minute', ts)
    WHEN 7 THEN date_trunc('second', ts) + INTERVAL 123456 MICROSECOND WHEN 8 THEN date_trunc('second', ts) - INTERVAL 3 HOUR END AS instant,
  CASE WHEN style IN (2, 3, 5) THEN 'invalid_timestamp' END AS error FROM r
""",
)
def ts_utc_strict(t: Tables):
    style, spelled = F.col("event_id") % 9, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(style == 0, F.concat(spelled, F.lit("Z")))
        .when(style == 1, F.concat(spelled, F.lit("+02:00")))
        .when(style == 2, spelled)
        .when(style == 3, F.substring(spelled, 1, 10))
        .when(style == 4, F.concat(F.replace(spelled, F.lit("T"), F.lit(" ")), F.lit("-03:30")))
        .when(style == 6, F.concat(F.substring(spelled, 1, 16), F.lit("+00:00")))
        .when(style == 7, F.concat(spelled, F.lit(".1234567Z")))
        .when(style == 8, F.concat(spelled, F.lit("+0300")))
        .otherwise(F.lit("2024-02-30T00:00:00Z"))
    )
    rows = t.events.select("event_id", raw.alias("raw")).withColumn("instant", temporal.utc_instant(F.col("raw")))
    return rows.withColumn("error", F.when(F.col("instant").isNull(), "invalid_timestamp"))


@query(
    "date_rules",
    """
WITH f AS (SELECT o_orderkey, o_orderkey % 11 AS style, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT *, CASE style WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN ' ' || strftime(d, '%Y-%m-%d') || 'T23:30:00-03:00 '
   WHEN 2 THEN CAST(epoch_ms(d) AS VARCHAR) WHEN 3 THEN strftime(d, '%d/%m/%Y') WHEN 4 THEN '2024-13-45' WHEN 5 THEN NULL
   WHEN 6 THEN 'true' WHEN 7 THEN strftime(d, '%Y-%m-%d') || ' 25:00:00' WHEN 9 THEN CAST(epoch_ms(d) AS VARCHAR) || '.00' WHEN 10 THEN CAST(epoch_ms(d) AS VARCHAR) || '.5'
   ELSE CAST(epoch_ms(d) AS VARCHAR) END AS raw,
   CASE style WHEN 2 THEN 'integer' WHEN 5 THEN 'null' WHEN 6 THEN 'boolean' WHEN 8 THEN 'integer' WHEN 9 THEN 'decimal' WHEN 10 THEN 'decimal' ELSE 'text' END AS json_type FROM f)
SELECT o_orderkey, raw, json_type, CASE WHEN style IN (0, 1, 2, 9) THEN d END AS day,
   CASE style WHEN 0 THEN 'iso_calendar_date' WHEN 1 THEN 'iso_calendar_from_datetime' WHEN 2 THEN 'declared_epoch_millis' WHEN 9 THEN 'declared_epoch_millis' END AS rule,
   CASE style WHEN 3 THEN 'ambiguous_date_format' WHEN 4 THEN 'invalid_date' WHEN 5 THEN 'missing_value' WHEN 6 THEN 'unrecognized_date_type'
        WHEN 7 THEN 'invalid_date' WHEN 8 THEN 'unrecognized_date_type' WHEN 10 THEN 'unrecognized_date_type' END AS reason FROM r
""",
)
def date_rules(t: Tables):
    style, day = F.col("o_orderkey") % 11, F.to_date("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    millis = (F.unix_date(day).cast("long") * 86400000).cast("string")
    raw = (
        F.when(style == 0, iso)
        .when(style == 1, F.concat(F.lit(" "), iso, F.lit("T23:30:00-03:00 ")))
        .when(style.isin(2, 8), millis)
        .when(style == 3, F.date_format(day, "dd/MM/yyyy"))
        .when(style == 4, F.lit("2024-13-45"))
        .when(style == 6, F.lit("true"))
        .when(style == 7, F.concat(iso, F.lit(" 25:00:00")))
        .when(style == 9, F.concat(millis, F.lit(".00")))
        .when(style == 10, F.concat(millis, F.lit(".5")))
    )
    kind = F.when(style.isin(2, 8), "integer").when(style == 5, "null").when(style == 6, "boolean").when(style > 8, "decimal").otherwise("text")
    rows = t.orders.select("o_orderkey", raw.alias("raw"), kind.alias("json_type"), style.isin(2, 9, 10).alias("declared"))
    ruled = rows.withColumn("r", temporal.date_by_rule(F.col("raw"), F.col("json_type"), F.col("declared")))
    return ruled.select("o_orderkey", "raw", "json_type", "r.*")


@query(
    "datetime_rules",
    """
WITH f AS (SELECT o_orderkey, o_orderkey % 8 AS style, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders)
SELECT o_orderkey, CASE style WHEN 0 THEN t WHEN 1 THEN t || 'T23:30:00-03:00' WHEN 2 THEN t || 'T23:30:00.500000+00:00' WHEN 3 THEN t || 'T07:05:09'
    WHEN 4 THEN t || 'T00:00:01.123000+00:00' WHEN 6 THEN t || 'T00:00:00+00:00' END AS moment,
  CASE style WHEN 0 THEN 'iso_calendar_date' WHEN 4 THEN 'declared_epoch_millis' WHEN 6 THEN 'declared_epoch_millis' WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE 'iso_datetime' END AS rule,
  CASE style WHEN 5 THEN 'invalid_date' WHEN 7 THEN 'ambiguous_date_format' END AS reason FROM f
""",
)
def datetime_rules(t: Tables):
    """The same rules where the time of day is kept."""
    style, day = F.col("o_orderkey") % 8, F.to_date("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    millis = F.unix_date(day).cast("long") * 86400000
    raw = (
        F.when(style == 0, iso)
        .when(style == 1, F.concat(F.lit(" "), iso, F.lit("T23:30:00-03:00 ")))
        .when(style == 2, F.concat(iso, F.lit(" 23:30:00.5Z")))
        .when(style == 3, F.concat(iso, F.lit("T07:05:09.000")))
        .when(style == 4, (millis + 1123).cast("string"))
        .when(style == 5, F.concat(iso, F.lit("T23:60:00")))
        .when(style == 6, F.concat(millis.cast("string"), F.lit(".0")))
        .otherwise(F.concat(iso, F.lit("T07:05")))
    )
    kind = F.when(style == 4, "integer").when(style == 6, "decimal").otherwise("text")
    ruled = temporal.datetime_by_rule(raw, kind, F.lit(True))
    return t.orders.withColumn("r", ruled).select("o_orderkey", "r.*")


URLS = """
urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN replace(url, 'http', 'ftp')
   WHEN 3 THEN regexp_replace(url, '^([a-z]+://[^/]*)', '\\1:99999') WHEN 4 THEN regexp_replace(url, '^([a-z]+://[^/]*)', '\\1:8080')
   WHEN 5 THEN url || ' x' WHEN 6 THEN upper(url) ELSE 'https:///' || CAST(page_id AS VARCHAR) END AS url FROM pages)"""


def url_variants(t: Tables):
    style, url = F.col("page_id") % 8, F.col("url")
    origin = r"^([a-z]+://[^/]*)"
    return t.pages.select(
        "page_id",
        F.when(style == 0, url)
        .when(style == 1, F.replace(url, F.lit("://"), F.lit("://user:pw@")))
        .when(style == 2, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(style == 3, F.regexp_replace(url, origin, "$1:99999"))
        .when(style == 4, F.regexp_replace(url, origin, "$1:8080"))
        .when(style == 5, F.concat(url, F.lit(" x")))
        .when(style == 6, F.upper(url))
        .otherwise(F.concat(F.lit("https:///"), F.col("page_id").cast("string")))
        .alias("url"),
    )


@query("url_check", q.with_(URLS, "SELECT page_id, url, page_id % 8 IN (0, 4, 6) AS valid FROM urls"))
def url_check(t: Tables):
    return url_variants(t).withColumn("valid", values.url_parts_ok(F.col("url")))


@query(
    "exact_numbers",
    """
WITH c AS (
  SELECT l_orderkey, l_linenumber, 'l_charge' AS col, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS x FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_scaled', l_extendedprice * 100000000000.0 FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', -l_discount FROM lineitem)
SELECT l_orderkey, l_linenumber, 'l_key' AS col, CAST(l_orderkey * 1000000000000 + l_linenumber AS VARCHAR) AS exact_text FROM lineitem WHERE l_orderkey >= 1000
UNION ALL SELECT l_orderkey, l_linenumber, col, CAST(x AS VARCHAR) FROM c
WHERE abs(x) > 999999999999999 OR (x = 0 AND CAST(x AS VARCHAR) = '-0.0') OR CAST(printf('%.15g', x) AS DOUBLE) <> x
""",
)
def exact_numbers(t: Tables):
    texts = {
        "l_charge": values.exact_number_text(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))),
        "l_scaled": values.exact_number_text(F.col("l_extendedprice") * F.lit(100000000000.0)),
        "l_discount": values.exact_number_text(-F.col("l_discount")),
        "l_key": values.exact_integer_text(F.col("l_orderkey") * 1000000000000 + F.col("l_linenumber")),
    }
    cells = F.array(*[F.struct(F.lit(name).alias("col"), text.alias("exact_text")) for name, text in texts.items()])
    rows = t.spread("lineitem").select("l_orderkey", "l_linenumber", F.inline(cells))
    return rows.filter(F.col("exact_text").isNotNull())


@query(
    "export_text_safe",
    """
SELECT doc_id, length(s) AS chars, md5(s) AS digest FROM (
  SELECT doc_id, CASE WHEN doc_id % 31 + 1 IN (9, 10, 13) THEN text || chr(CAST(doc_id % 31 + 1 AS INTEGER))
     ELSE text || '\\u' || printf('%04x', doc_id % 31 + 1) END AS s FROM documents)
""",
)
def export_text_safe(t: Tables):
    dirty = F.concat("text", F.char(F.col("doc_id") % 31 + 1))
    safe = t.spread("documents").select("doc_id", text.escape_controls(dirty).alias("s"))
    return safe.select("doc_id", F.char_length("s").cast("long").alias("chars"), F.md5("s").alias("digest"))


@query(
    "text_fragments",
    """
WITH n AS (SELECT doc_id, text, CAST(greatest(0, floor((length(text) - 1) / 1000)) AS BIGINT) AS last FROM documents WHERE length(text) > 1500)
SELECT doc_id, i AS position, substr(text, i * 1000 + 1, 1000) AS content FROM n, unnest(range(0, last + 1)) u(i)
""",
)
def text_fragments(t: Tables):
    long_texts = t.spread("documents").filter(F.char_length("text") > 1500)
    pieces = long_texts.select("doc_id", F.posexplode(text.fragments(F.col("text"), 1000)).alias("position", "content"))
    return pieces.withColumn("position", F.col("position").cast("long"))


KINDS = ("identity", "document", "phone", "email", "username", "address", "relationship", "activity", "custom")


def kind_items(t: Tables) -> DataFrame:
    """Items of all nine kinds with the same fields, some of them missing."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey").cast("string")

    def quoted(*parts) -> Column:
        return F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"'))

    fields = {
        "number": quoted(F.lpad(owner, 8, "0")),
        "extension": F.when(key % 3 == 0, quoted((F.col("o_custkey") % 100).cast("string"))),
        "type": quoted("T", (key % 4).cast("string")),
        "country": F.lit('"BR"'),
        "email": quoted("a", owner, "@x.org"),
        "platform": F.lit('"p"'),
        "username": quoted("u", owner),
        "target_id": owner,
        "target_document": F.lit('{"number":"1"}'),
        "from": F.lit('"2024-01-01"'),
        "code": F.lit("12"),
        "role": F.lit('"r"'),
        "field_id": F.lit('"f"'),
        "value": F.lit("true"),
    }
    values = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value)])
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % 9 + 1).cast("int"))
    return t.orders.select("o_orderkey", kind.alias("kind"), F.map_filter(values, lambda k, v: v.isNotNull()).alias("values"))


KIND_ITEMS = """
item AS (SELECT o_orderkey, ['identity', 'document', 'phone', 'email', 'username', 'address', 'relationship', 'activity', 'custom'][o_orderkey % 9 + 1] AS kind,
  '"number":"' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || '"' AS num, '"extension":' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || (o_custkey % 100) || '"' ELSE 'null' END AS ext,
  o_orderkey % 3 = 0 AS has_ext, '"type":"T' || (o_orderkey % 4) || '"' AS typ, '"email":"a' || o_custkey || '@x.org"' AS mail, '"username":"u' || o_custkey || '"' AS usr,
  '"target_id":' || o_custkey AS tid FROM orders),
spelled AS (SELECT *, '{"code":12,"country":"BR",' || mail || ',' || CASE WHEN has_ext THEN ext || ',' ELSE '' END || '"field_id":"f","from":"2024-01-01",' || num
  || ',"platform":"p","role":"r","target_document":{"number":"1"},' || tid || ',' || typ || ',' || usr || ',"value":true}' AS whole,
  '{' || ext || ',' || num || '}' AS phone, '{' || mail || '}' AS email, '{"platform":"p",' || usr || '}' AS name FROM item)"""


@query(
    "flag_binding",
    q.with_(
        KIND_ITEMS,
        """SELECT o_orderkey, kind, flag, sha256(CASE WHEN kind = 'phone' AND flag = 'is_whatsapp' THEN '{' || num || '}' WHEN kind = 'phone' THEN phone
  WHEN kind = 'email' THEN email WHEN kind = 'username' THEN name ELSE whole END) AS binding FROM spelled, (VALUES ('valid'), ('is_whatsapp')) f(flag)""",
    ),
)
def flag_binding(t: Tables):
    items = kind_items(t).withColumn("flag", F.explode(F.array(F.lit("valid"), F.lit("is_whatsapp"))))
    return items.select("o_orderkey", "kind", "flag", keys.flag_binding(F.col("kind"), F.col("flag"), F.col("values")).alias("binding"))


@query(
    "evidence_check",
    q.with_(
        q.FLAGOBS,
        """, ev AS (SELECT id, flag, effective AS checked_at, CASE WHEN id % 5 < 4 THEN expires END AS expires_at FROM flagobs)
SELECT id, CASE WHEN expires_at IS NOT NULL AND (checked_at IS NULL OR expires_at <= checked_at) THEN 'expiry_needs_earlier_check'
     WHEN flag IS NULL AND expires_at IS NOT NULL THEN 'unknown_cannot_expire' END AS error FROM ev""",
    ),
)
def evidence_check(t: Tables):
    expires = F.when(F.col("id") % 5 < 4, F.col("expires"))
    undated = F.col("effective").isNull() | (expires <= F.col("effective"))
    error = F.when(expires.isNotNull() & undated, "expiry_needs_earlier_check").when(
        F.col("flag").isNull() & expires.isNotNull(), "unknown_cannot_expire"
    )
    return t.flagobs.select("id", error.alias("error"))


@query(
    "address_rules",
    """
WITH p AS (SELECT c_custkey, unnest(['postal_code', 'state', 'number', 'city', 'complement']) AS field, c_name, c_nationkey, c_mktsegment FROM customer),
v AS (SELECT c_custkey, field, CASE field WHEN 'postal_code' THEN CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-' || '123' ELSE '12-3' END
   WHEN 'state' THEN CASE WHEN c_custkey % 2 = 0 THEN lower(substr(c_mktsegment, 1, 2)) ELSE 'abc' END
   WHEN 'number' THEN CAST(c_custkey AS VARCHAR) WHEN 'city' THEN ' ' || c_name || 'e' || chr(769) || ' ' ELSE CASE WHEN c_custkey % 2 = 0 THEN '  ' END END AS raw,
   CASE WHEN field = 'number' THEN CASE WHEN c_custkey % 2 = 0 THEN 'integer' ELSE 'decimal' END
        WHEN field = 'complement' AND c_custkey % 2 = 1 THEN 'null' ELSE 'text' END AS json_type FROM p)
SELECT c_custkey, field, json_type, CASE WHEN json_type = 'text' AND field = 'postal_code' THEN regexp_replace(trim(raw), '[-\\s]', '', 'g')
    WHEN json_type = 'text' AND field = 'state' AND regexp_matches(trim(raw), '^[A-Za-z]{2}$') THEN upper(trim(raw))
    WHEN json_type = 'text' THEN nfc_normalize(trim(raw)) ELSE raw END AS normalized,
  CASE WHEN json_type = 'null' THEN 'missing_value' WHEN field = 'number' AND json_type = 'integer' THEN NULL
    WHEN json_type <> 'text' THEN 'unrecognized_address_component' WHEN trim(raw) = '' THEN 'empty_value'
    WHEN field = 'postal_code' AND NOT regexp_matches(regexp_replace(raw, '[-\\s]', '', 'g'), '^[0-9]{8}$') THEN 'postal_code_requires_review' END AS reason FROM v
""",
)
def address_rules(t: Tables):
    even = F.col("c_custkey") % 2 == 0
    key = F.col("c_custkey").cast("string")
    component = lambda name, raw, kind: F.struct(
        F.lit(name).alias("field"), raw.cast("string").alias("raw"), kind.alias("json_type")
    )
    components = F.array(
        component("postal_code", F.when(even, F.concat(F.lpad(key, 5, "0"), F.lit("-123"))).otherwise("12-3"), F.lit("text")),
        component("state", F.when(even, F.lower(F.substring("c_mktsegment", 1, 2))).otherwise("abc"), F.lit("text")),
        component("number", key, F.when(even, "integer").otherwise("decimal")),
        component("city", F.concat(F.lit(" "), "c_name", F.lit("e\u0301 ")), F.lit("text")),
        component("complement", F.when(even, "  "), F.when(even, "text").otherwise("null")),
    )
    rows = t.customer.select("c_custkey", F.inline(components))
    ruled = rows.withColumn("r", contact.address_component(F.col("field"), F.col("raw"), F.col("json_type")))
    return ruled.select("c_custkey", "field", "json_type", "r.normalized", "r.reason")


@query(
    "normalize_lineage",
    q.with_(
        FOUND,
        """, lineage AS (
  SELECT 'email-domain-lowercase' AS rule, raw AS input, normalized AS output FROM emails
  UNION ALL SELECT 'email-syntax', NULL, CAST(syntax_valid AS VARCHAR) FROM emails
  UNION ALL SELECT 'document-cleanup', lower(c_name), upper(regexp_replace(c_name, '[-./\\s]', '', 'g')) FROM customer)
SELECT rule, input IS NULL AS derived, input IS DISTINCT FROM output AS changed, count(*) AS n FROM lineage GROUP BY ALL""",
    ),
)
def normalize_lineage(t: Tables):
    mails = found_addresses(t).withColumn("r", contact.normalize_email(F.col("raw")))
    none = F.lit(None).cast("string")
    lineage = mails.select(
        F.inline(
            F.array(
                F.struct(F.lit("email-domain-lowercase").alias("rule"), F.col("raw").alias("input"), F.col("r.normalized").alias("output")),
                F.struct(F.lit("email-syntax").alias("rule"), none.alias("input"), F.col("r.syntax_valid").cast("string").alias("output")),
            )
        )
    ).unionByName(
        t.customer.select(
            F.lit("document-cleanup").alias("rule"),
            F.lower("c_name").alias("input"),
            contact.clean_document(F.col("c_name")).alias("output"),
        )
    )
    return lineage.groupBy(
        "rule", F.col("input").isNull().alias("derived"), (~F.col("input").eqNullSafe(F.col("output"))).alias("changed")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "row_fingerprint",
    """
SELECT o_orderkey, sha256('{"custkey":' || CAST(o_custkey AS VARCHAR) || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d')
  || '","note":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || ',"orderkey":' || CAST(o_orderkey AS VARCHAR) || '}') AS record_hash,
  sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || CAST(o_custkey AS VARCHAR)) AS record_id FROM orders
""",
)
def row_fingerprint(t: Tables):
    hashed = values.fingerprint(
        orderkey=F.col("o_orderkey"),
        custkey=F.col("o_custkey"),
        day=F.date_format("o_orderdate", "yyyy-MM-dd"),
        note=F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")),
    )
    ident = F.sha2(F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 256)
    return t.orders.select("o_orderkey", hashed.alias("record_hash"), ident.alias("record_id"))


@query(
    "item_key",
    q.with_(
        KIND_ITEMS,
        """SELECT o_orderkey, kind, CASE kind WHEN 'identity' THEN 'identity' ELSE sha256(CASE kind WHEN 'document' THEN '{"country":"BR",' || num || ',' || typ || '}'
  WHEN 'phone' THEN phone WHEN 'email' THEN email WHEN 'username' THEN name
  WHEN 'relationship' THEN '{"from":"2024-01-01","target_document":{"number":"1"},' || tid || ',' || typ || ',"until":null}'
  WHEN 'activity' THEN '{"code":12,"role":"r"}' WHEN 'custom' THEN '{"field_id":"f","value":true}' ELSE whole END) END AS item_key FROM spelled""",
    ),
)
def item_key(t: Tables):
    return kind_items(t).select("o_orderkey", "kind", keys.item_key(F.col("kind"), F.col("values")).alias("item_key"))
