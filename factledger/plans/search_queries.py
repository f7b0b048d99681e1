"""Predicates, same-item search, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions import contact, temporal, text, values
from factledger.operators import search, sorting
from factledger.operators.ordered import beside, with_ordinal
from factledger.operators.projection import custom_key
from factledger.operators.state import current_state
from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.tables import Tables

AT = "2024-01-25 00:00:00"


def order_items(t: Tables) -> DataFrame:
    return t.orders.withColumnRenamed("o_custkey", "c_custkey")


@query(
    "pred_in",
    """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))""",
)
def pred_in(t: Tables):
    listed = t.nation.filter(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").alias("c_nationkey"))
    chosen = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return chosen.join(listed, "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment", "c_nationkey")


@query(
    "pred_contains_fold",
    "SELECT doc_id, source FROM documents WHERE contains(strip_accents(replace(lower(text), 'ß', 'ss')), 'reaux')",
)
def pred_contains_fold(t: Tables):
    found = t.text_index.contains("Réaux").select(F.col("id").alias("doc_id"))
    return t.documents.select("doc_id", "source").join(found, "doc_id")


@query(
    "pred_prefix_fold",
    "SELECT doc_id, source FROM documents WHERE starts_with(strip_accents(replace(lower(text), 'ß', 'ss')), 'ea')",
)
def pred_prefix_fold(t: Tables):
    found = t.text_index.prefix("Éa").select(F.col("id").alias("doc_id"))
    return t.documents.select("doc_id", "source").join(found, "doc_id")


@query(
    "pred_range",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 110000)
AND c_acctbal >= 1000""",
)
def pred_range(t: Tables):
    rich = t.customer.filter(search.in_range(F.col("c_acctbal"), low=1000.0))
    price = search.in_range(F.col("o_totalprice"), 100000.0, 110000.0)
    return search.with_item(rich, order_items(t), "c_custkey", price).select("c_custkey", "c_name")


@query(
    "pred_date_range",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderdate > TIMESTAMP '1996-02-28' AND o_orderdate <= TIMESTAMP '1997-01-01'""",
)
def pred_date_range(t: Tables):
    day = F.col("o_orderdate")
    low, high = F.lit("1996-02-28").cast(t.orders.schema["o_orderdate"].dataType), F.lit("1997-01-01").cast(
        t.orders.schema["o_orderdate"].dataType
    )
    return t.orders.filter((day > low) & (day <= high)).select("o_orderkey", F.to_date(day).alias("day"))


@query(
    "pred_exists",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000) AS found FROM customer""",
)
def pred_exists(t: Tables):
    condition = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)
    base, items = t.customer.select("c_custkey"), order_items(t)
    present = search.with_item(base, items, "c_custkey", condition).withColumn("found", F.lit(True))
    absent = search.without_item(base, items, "c_custkey", condition).withColumn("found", F.lit(False))
    return present.unionByName(absent)


@query(
    "pred_is_null_any",
    """
WITH v AS (SELECT user_id, event_type, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS x FROM events)
SELECT user_id, bool_or(x IS NULL) AS some_null, bool_or(x IS NOT NULL) AS some_value,
  coalesce(bool_or(event_type = 'view' AND x IS NULL), FALSE) OR NOT bool_or(event_type = 'view') AS flag_null FROM v GROUP BY user_id
""",
)
def pred_is_null_any(t: Tables):
    x = F.when(F.col("event_id") % 97 != 0, F.col("value"))
    flag_row = F.col("event_type") == "view"
    flags = search.record_flags(
        t.events,
        "user_id",
        {"some_null": x.isNull(), "some_value": x.isNotNull(), "flag_seen": flag_row, "flag_unknown": flag_row & x.isNull()},
    )
    return flags.select("user_id", "some_null", "some_value", (F.col("flag_unknown") | ~F.col("flag_seen")).alias("flag_null"))


@query(
    "pred_and_or",
    """SELECT c_custkey FROM customer c WHERE (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 450000)
 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))
 OR (c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'))""",
)
def pred_and_or(t: Tables):
    flags = search.record_flags(
        order_items(t),
        "c_custkey",
        {
            "big": (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 450000),
            "urgent": F.col("o_orderpriority") == "1-URGENT",
            "partial": F.col("o_orderstatus") == "P",
        },
    )
    joined = t.customer.select("c_custkey", "c_mktsegment").join(flags, "c_custkey", "left").na.fill(False)
    wanted = (F.col("big") & F.col("urgent")) | ((F.col("c_mktsegment") == "BUILDING") & ~F.col("partial"))
    return joined.filter(wanted).select("c_custkey")


@query(
    "pred_same_item",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 400000
 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40))""",
)
def pred_same_item(t: Tables):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    wanted = order_items(t).filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000))
    fields = search.with_item(wanted, lines, "o_orderkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
    return search.with_item(t.customer.select("c_custkey"), fields, "c_custkey")


@query(
    "pred_cross_item",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
def pred_cross_item(t: Tables):
    flags = search.record_flags(
        order_items(t), "c_custkey", {"a": F.col("o_orderstatus") == "F", "b": F.col("o_totalprice") > 400000}
    )
    return flags.filter(F.col("a") & F.col("b")).select("c_custkey")


def purchases_with_flags(t: Tables) -> DataFrame:
    flags = t.flag_state.select("owner", "item", "path", "flag", "applicable", "expires")
    values_now = t.value_state.filter(F.col("item") == "purchase").select("owner", "item", "path", "value", "id")
    return values_now.join(flags, ["owner", "item", "path"], "left")


PURCHASES = q.FLAG_STATE + """,
purchases AS (SELECT v.owner, v.item, v.path, v.value, v.id, f.flag, f.applicable, f.expires
  FROM value_state v LEFT JOIN flag_state f ON f.owner = v.owner AND f.item = v.item AND f.path = v.path WHERE v.item = 'purchase')"""


@query(
    "pred_exclude_invalid",
    q.with_(PURCHASES, "SELECT owner, id, value FROM purchases WHERE (CASE WHEN applicable THEN flag END) IS DISTINCT FROM FALSE"),
)
def pred_exclude_invalid(t: Tables):
    effective = F.when(F.col("applicable"), F.col("flag"))
    return purchases_with_flags(t).filter(search.not_invalid(effective)).select("owner", "id", "value")


@query(
    "pred_live_flag",
    q.with_(
        PURCHASES,
        f""", l AS (SELECT owner, id, flag, coalesce(applicable AND (expires IS NULL OR expires > TIMESTAMP '{AT}'), FALSE) AS live FROM purchases)
SELECT owner, id, live AND coalesce(flag, FALSE) AS live_true, live AND coalesce(NOT flag, FALSE) AS live_false,
       NOT (live AND flag IS NOT NULL) AS live_unknown FROM l""",
    ),
)
def pred_live_flag(t: Tables):
    at = F.lit(AT).cast("timestamp")
    ask = lambda expected: search.live_flag(
        F.col("flag"), F.col("applicable"), F.col("expires"), at, expected
    )
    return purchases_with_flags(t).select(
        "owner", "id", ask(True).alias("live_true"), ask(False).alias("live_false"), ask(None).alias("live_unknown")
    )


@query(
    "pred_parent_invalid",
    q.with_(
        PURCHASES,
        f""", derived AS (SELECT owner, id, 'band' AS key, CAST(floor(value / 10) AS BIGINT) AS band FROM purchases),
bad AS (SELECT id FROM purchases WHERE flag = FALSE AND applicable AND (expires IS NULL OR expires > TIMESTAMP '{AT}'))
SELECT * FROM derived WHERE id NOT IN (SELECT id FROM bad)""",
    ),
)
def pred_parent_invalid(t: Tables):
    rows = purchases_with_flags(t)
    at = F.lit(AT).cast("timestamp")
    invalid = search.live_flag(F.col("flag"), F.col("applicable"), F.col("expires"), at, False)
    derived = rows.select("owner", "id", F.lit("band").alias("key"), F.floor(F.col("value") / 10).alias("band"))
    return search.without_item(derived, rows, "id", invalid).select("owner", "id", "key", "band")


@query(
    "pred_age",
    """
WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS born,
  CAST(2024 - year(o_orderdate) - CASE WHEN 229 < month(o_orderdate) * 100 + day(o_orderdate) THEN 1 ELSE 0 END AS INTEGER) AS age FROM orders)
SELECT * FROM a WHERE age BETWEEN 24 AND 26
""",
)
def pred_age(t: Tables):
    born = F.to_date("o_orderdate")
    aged = t.orders.select("o_orderkey", born.alias("born"), temporal.age_on(born, F.lit("2024-02-29").cast("date")).alias("age"))
    return aged.filter(search.in_range(F.col("age"), 24, 26))


@query(
    "pred_norm_eq",
    """SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_custkey = s_suppkey * 3""",
)
def pred_norm_eq(t: Tables):
    digits = lambda c: F.lpad(c.cast("string"), 9, "0")
    asked = digits(F.col("s_suppkey") * 3)
    operand = F.concat(F.substring(asked, 1, 3), F.lit("."), F.substring(asked, 4, 3), F.lit("-"), F.substring(asked, 7, 3))
    stored = F.concat(digits(F.col("c_custkey")), F.lit(" "))
    wanted = t.supplier.select("s_suppkey", contact.clean_document(operand).alias("number"))
    have = t.customer.select("c_custkey", contact.clean_document(stored).alias("number"))
    return have.join(wanted, "number").select("s_suppkey", "c_custkey")


@query(
    "pred_ieq",
    """SELECT c.c_custkey, e.asked FROM customer c JOIN (SELECT DISTINCT upper(c_name) AS asked FROM customer) e ON lower(c.c_name) = lower(e.asked)""",
)
def pred_ieq(t: Tables):
    listed = t.customer.select(F.upper("c_name").alias("asked")).distinct()
    asked = listed.select("asked", text.fold("asked").alias("folded"))
    return t.customer.select("c_custkey", text.fold("c_name").alias("folded")).join(asked, "folded").select("c_custkey", "asked")


@query(
    "pred_match_all",
    """
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents)
SELECT doc_id FROM w WHERE list_contains(ws, 'the') AND list_contains(ws, 'and') AND list_contains(ws, 'with')
""",
)
def pred_match_all(t: Tables):
    return t.text_index.all_words("With THE and").select(F.col("id").alias("doc_id"))


NUMERALS = """
numerals AS (SELECT o_orderkey, o_custkey % 7 AS n, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey % 7 AS VARCHAR) WHEN 1 THEN (o_custkey % 7) || '.0'
  WHEN 2 THEN (o_custkey % 7) || '0e-1' WHEN 3 THEN '00' || (o_custkey % 7) || '.000' WHEN 4 THEN '.' || (o_custkey % 7) || 'E+1' ELSE (o_custkey % 7) || 'x' END AS raw FROM orders)"""


def numerals(t: Tables) -> DataFrame:
    style, n = F.col("o_orderkey") % 6, (F.col("o_custkey") % 7).cast("string")
    raw = (
        F.when(style == 0, n)
        .when(style == 1, F.concat(n, F.lit(".0")))
        .when(style == 2, F.concat(n, F.lit("0e-1")))
        .when(style == 3, F.concat(F.lit("00"), n, F.lit(".000")))
        .when(style == 4, F.concat(F.lit("."), n, F.lit("E+1")))
        .otherwise(F.concat(n, F.lit("x")))
    )
    return t.orders.select("o_orderkey", raw.alias("raw"))


@query("pred_num_exact", q.with_(NUMERALS, "SELECT o_orderkey, raw FROM numerals WHERE n = 3 AND o_orderkey % 6 < 5"))
def pred_num_exact(t: Tables):
    return numerals(t).filter(values.exact_number(F.col("raw")) == values.exact_number(F.lit("3")))


@query("pred_source", q.with_(q.OBS, "SELECT DISTINCT owner FROM obs WHERE source = 1 AND item = 'signup'"))
def pred_source(t: Tables):
    return t.obs.filter((F.col("source") == 1) & (F.col("item") == "signup")).select("owner").distinct()


@query(
    "pred_resolved",
    q.with_(q.CURRENT, "SELECT owner, item, id, status FROM value_state WHERE status NOT IN ('pending', 'ambiguous', 'unclassified')"),
)
def pred_resolved(t: Tables):
    return t.value_state.filter(search.resolved(F.col("status"))).select("owner", "item", "id", "status")


@query(
    "pred_custom_selector",
    """
WITH e AS (SELECT event_id, event_type, event_id % 2 + 1 AS version, CASE WHEN event_id % 3 = 0 THEN 'integer' ELSE 'text' END AS kind,
   CASE WHEN event_id % 7 = 0 THEN 'changed' ELSE 'plain' END AS label, CASE WHEN event_id % 4 = 0 THEN 'd1' END AS deployment,
   CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, event_type, k FROM e WHERE kind = 'integer' AND label = 'plain' AND k > 50
  AND ((event_type = 'click' AND version = 1 AND deployment IS NULL) OR (event_type = 'view' AND version = 2 AND deployment IS NULL)
    OR (event_type = 'view' AND version = 1 AND deployment = 'd1'))
""",
)
def pred_custom_selector(t: Tables):
    """Values bound to one immutable definition: its own digest, contract and deployment count."""

    def bound(rows: DataFrame) -> DataFrame:
        digest = values.fingerprint(id=F.col("f"), version=F.col("v"), type=F.col("k"), label=F.col("label"))
        contract = F.when(F.col("d").isNull(), "catalogue").otherwise("deployed")
        definition = F.struct(
            F.col("f").alias("field_id"), F.col("v").alias("version"), digest.alias("sha256"), F.col("k").alias("type"),
            contract.alias("contract"), F.col("d").alias("deployment_id"),
        )
        return rows.withColumn("definition", definition).withColumn("selector", custom_key("definition"))

    key = F.col("event_id")
    typed = t.events.select(
        "event_id",
        "event_type",
        F.col("event_type").alias("f"),
        (key % 2 + 1).alias("v"),
        F.when(key % 3 == 0, "integer").otherwise("text").alias("k"),
        F.when(key % 7 == 0, "changed").otherwise("plain").alias("label"),
        F.when(key % 4 == 0, "d1").alias("d"),
        F.get_json_object("props", "$.k").cast("bigint").alias("number"),
    )
    asked = t.spark.createDataFrame(
        [("click", 1, "integer", "plain", None), ("view", 2, "integer", "plain", None), ("view", 1, "integer", "plain", "d1")],
        "f string, v bigint, k string, label string, d string",
    )
    found = bound(typed).join(F.broadcast(bound(asked).select("selector")), "selector", "left_semi")
    return found.filter(F.col("number") > 50).select("event_id", "event_type", F.col("number").alias("k"))


# ---- ordering and paging ------------------------------------------------------

SORT_KEYS = """
keys AS (SELECT c_custkey, lower(c_name) AS name, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS top_price,
   min(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END) AS first_day
   FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name)"""


def field_row(field: str, value: Column, json_type: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"), json_type.alias("json_type"))


@query(
    "sort_multi",
    q.with_(
        SORT_KEYS,
        """SELECT c_custkey, top_price, first_day,
  row_number() OVER (ORDER BY CAST(round(top_price / 100000) AS BIGINT) DESC NULLS LAST, first_day ASC NULLS LAST, name, c_custkey) AS place FROM keys""",
    ),
)
def sort_multi(t: Tables):
    eligible = F.col("o_orderstatus") == "P"
    shown = order_items(t).groupBy("c_custkey").agg(
        F.max(F.when(eligible, F.col("o_totalprice"))).alias("top_price"),
        F.min(F.when(eligible, F.to_date("o_orderdate"))).alias("first_day"),
    )
    band = F.round(F.col("o_totalprice") / 100000).cast("long").cast("string")
    sides = F.array(
        field_row("band", band, F.lit("integer")),
        field_row("day", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("text")),
    )
    items = t.orders.select(F.col("o_custkey").alias("id"), F.lit("order").alias("kind"), F.inline(sides), eligible.alias("valid"))
    fields = {"band": ("order", "integer"), "day": ("order", "date"), "name": (None, "text"), "id": (None, "integer")}
    wish = [{"field": "band", "direction": "desc"}, {"field": "day", "direction": "asc"}, {"field": "name", "direction": "asc"}]
    records = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    keyed = sorting.with_sort_key(records, sorting.sort_plan(wish, fields), items, fields)
    placed = with_ordinal(keyed.select(F.col("id").alias("c_custkey"), "sort_key"), ["sort_key"], name="place")
    return placed.join(shown, "c_custkey", "left").select("c_custkey", "top_price", "first_day", "place")


SORTED = """
person AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 2 THEN 1 WHEN c_custkey % 5 = 2 THEN 2 END AS style,
  TIMESTAMP '2024-02-01' + to_hours(CAST(c_custkey % 40 AS INTEGER)) AS moment FROM customer),
entry AS (SELECT o_custkey AS id, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS valid,
  CASE o_orderkey % 4 WHEN 0 THEN 'Élan ' || (o_custkey % 11) WHEN 1 THEN 'E' || chr(769) || 'LAN ' || (o_custkey % 11)
    WHEN 2 THEN 'zeta' ELSE o_orderpriority END AS name,
  CASE o_orderkey % 6 WHEN 0 THEN '1999-02-30' WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN '12'
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS birth FROM orders),
value AS (SELECT id, valid, nfc_normalize(lower(nfc_normalize(name))) AS name, CASE WHEN k % 6 > 2 THEN birth END AS birth FROM entry),
keys AS (SELECT p.id, CASE WHEN p.style IS NOT NULL THEN p.moment END AS moment, min(name) FILTER (valid IS NOT FALSE) AS name_min,
  max(name) FILTER (valid IS NOT FALSE) AS name_max, max(birth) FILTER (valid IS NOT FALSE) AS birth_max, max(name) AS every_name
  FROM person p LEFT JOIN value v ON v.id = p.id GROUP BY p.id, p.style, p.moment)"""


def sorted_people(t: Tables) -> DataFrame:
    """Customers with an instant of their own, written in two ways or without its offset."""
    style = F.col("c_custkey") % 5
    at = F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("c_custkey") % 40).cast("int"))
    later = F.date_format(at + F.make_dt_interval(hours=F.lit(3)), "yyyy-MM-dd'T'HH:mm:ss")
    spelled = F.when(style < 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(
        style == 2, F.concat(later, F.lit("+03:00"))
    )
    return t.customer.select(F.col("c_custkey").alias("id"), F.coalesce(spelled, later).alias("updated_at"))


def sorted_items(t: Tables) -> DataFrame:
    """Names in composed and decomposed spelling and birth dates of which some are none."""
    key, number = F.col("o_orderkey"), (F.col("o_custkey") % 11).cast("string")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit("\u00c9lan "), number))
        .when(key % 4 == 1, F.concat(F.lit("E\u0301LAN "), number))
        .when(key % 4 == 2, "zeta")
        .otherwise(F.col("o_orderpriority"))
    )
    birth = (
        F.when(key % 6 == 0, "1999-02-30")
        .when(key % 6 == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(key % 6 == 2, "12")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    sides = F.array(
        field_row("name", name, F.lit("text")),
        field_row("birth_date", birth, F.when(key % 6 == 2, "integer").otherwise("text")),
    )
    valid = F.when(key % 5 == 0, False).when(key % 5 > 1, True)
    return t.orders.select(F.col("o_custkey").alias("id"), F.lit("identity").alias("kind"), F.inline(sides), valid.alias("valid"))


@query(
    "sort_records",
    q.with_(
        SORTED,
        """SELECT 'name' AS plan, id, row_number() OVER (ORDER BY name_min NULLS LAST, birth_max DESC NULLS LAST, id) AS place FROM keys
UNION ALL SELECT 'birth', id, row_number() OVER (ORDER BY birth_max NULLS LAST, name_min DESC NULLS LAST, moment DESC NULLS LAST, id DESC) FROM keys
UNION ALL SELECT 'every', id, row_number() OVER (ORDER BY moment NULLS LAST, every_name DESC NULLS LAST, id) FROM keys""",
    ),
)
def sort_records(t: Tables):
    fields = sorting.FIELDS | {"id": (None, "integer")}
    asked = {
        "name": [{"field": "name", "direction": "asc"}, {"field": "birth_date", "direction": "desc"}],
        "birth": [
            {"field": "birth_date", "direction": "asc", "mode": "max"},
            {"field": "name", "direction": "desc", "mode": "min"},
            {"field": "updated_at", "direction": "desc"},
            {"field": "id", "direction": "desc"},
        ],
        "every": [{"field": "updated_at", "direction": "asc"}, {"field": "name", "direction": "desc"}],
    }
    placed = None
    for name, wish in asked.items():
        plan = sorting.sort_plan(wish, fields)
        keyed = sorting.with_sort_key(sorted_people(t), plan, sorted_items(t), fields, include_invalid=name == "every")
        part = with_ordinal(keyed.select("id", "sort_key"), ["sort_key"], name="place")
        part = part.select(F.lit(name).alias("plan"), "id", "place")
        placed = part if placed is None else placed.unionByName(part)
    return placed


@query(
    "sort_legacy",
    "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY lower(c_mktsegment) DESC, c_custkey DESC) AS place FROM customer",
)
def sort_legacy(t: Tables):
    rows = t.customer.select("c_custkey", "c_mktsegment", text.casefold("c_mktsegment").alias("name"))
    placed = with_ordinal(rows, [F.col("name").desc(), F.col("c_custkey").desc()], name="place")
    return placed.select("c_custkey", "c_mktsegment", "place")


@query(
    "page_offset",
    """WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) <= 150 AS complete FROM m
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def page_offset(t: Tables):
    found = t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    return search.offset_page(found, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100, 50)


@query(
    "page_keyset",
    q.with_(
        q.DECIDED,
        """SELECT id, owner, version, seq, row_number() OVER (ORDER BY version DESC, seq DESC, id DESC) AS position, TRUE AS has_more FROM
(SELECT * FROM decided WHERE (version < 60) OR (version = 60 AND seq < 1) OR (version = 60 AND seq = 1 AND id < 5000)
 ORDER BY version DESC, seq DESC, id DESC LIMIT 200)""",
    ),
)
def page_keyset(t: Tables):
    page = search.keyset_page(t.decided, ["version", "seq", "id"], (60, 1, 5000), 200, descending=True)
    return page.select("id", "owner", "version", "seq", "position", "has_more")


@query(
    "page_at_cut",
    q.with_(
        q.DECIDED,
        """, cut AS (SELECT * FROM decided WHERE applied AND version <= 40
  QUALIFY row_number() OVER (PARTITION BY owner, item, path, dimension ORDER BY version DESC, seq DESC) = 1)
SELECT owner, item, path, dimension, id, row_number() OVER (ORDER BY owner, item, path, dimension) AS position, TRUE AS has_more FROM
(SELECT * FROM cut WHERE owner > 30 OR (owner = 30 AND item > 'error') ORDER BY owner, item, path, dimension LIMIT 100)""",
    ),
)
def page_at_cut(t: Tables):
    cut = current_state(t.decided, at_version=40)
    page = search.keyset_page(cut, ["owner", "item", "path", "dimension"], (30, "error", "value", "value"), 100)
    return page.select("owner", "item", "path", "dimension", "id", "position", "has_more")


@query(
    "page_order_check",
    """
WITH h AS (SELECT doc_id + 1 AS position, CASE WHEN doc_id % 17 = 0 AND doc_id > 0 THEN doc_id - 1 WHEN doc_id % 19 = 0 AND doc_id > 0 THEN doc_id - 3 ELSE doc_id END AS hit FROM documents)
SELECT position, hit, prev_hit, CASE WHEN hit = prev_hit THEN 'duplicate' ELSE 'unordered' END AS problem
FROM (SELECT *, lag(hit) OVER (ORDER BY position) AS prev_hit FROM h) WHERE hit <= prev_hit
""",
)
def page_order_check(t: Tables):
    key = F.col("doc_id")
    hit = F.when((key % 17 == 0) & (key > 0), key - 1).when((key % 19 == 0) & (key > 0), key - 3).otherwise(key)
    hits = t.documents.select((key + 1).alias("position"), hit.alias("hit"))
    checked = beside(hits, [], "position", ["hit"]).filter(F.col("hit") <= F.col("prev_hit"))
    return checked.withColumn("problem", F.when(F.col("hit") == F.col("prev_hit"), "duplicate").otherwise("unordered"))


@query(
    "page_byte_budget",
    """
WITH p AS (SELECT doc_id, CAST(strlen(text) + 2 AS BIGINT) AS row_bytes FROM documents ORDER BY doc_id LIMIT 201),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS position, CAST(sum(row_bytes) OVER (ORDER BY doc_id) + 512 AS BIGINT) AS running_bytes FROM p)
SELECT doc_id, row_bytes, position, running_bytes, bool_or(running_bytes > 400000 OR position > 200) OVER () AS has_more FROM r
QUALIFY running_bytes <= 400000 AND position <= 200
""",
)
def page_byte_budget(t: Tables):
    size = (F.octet_length("text") + 2).cast("long")
    page = search.byte_page(t.documents, ["doc_id"], size, limit=200, budget=400000, envelope=512)
    return page.select("doc_id", "row_bytes", "position", "running_bytes", "has_more")


@query("bounded_total", "SELECT least(count(*), 10000) AS value, CASE WHEN count(*) > 10000 THEN 'gte' ELSE 'eq' END AS relation FROM lineitem")
def bounded_total(t: Tables):
    return search.bounded_total(t.lineitem)
