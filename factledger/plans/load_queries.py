"""Reading, flattening, mapping and projecting source records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import values
from factledger.operators import batching, flatten, mapping, projection
from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.tables import Tables
from factledger.sources import jsonl


def docrec(t: Tables) -> DataFrame:
    """One nested JSON record per order; number spellings kept as written."""
    key = F.col("o_orderkey")
    line = lambda i: F.concat(
        F.lit('{"no":'), i.cast("string"), F.lit(',"qty":"'), (F.col("o_custkey") % (i + 2)).cast("string"),
        F.lit('","a/b":'), F.when((key + i) % 2 == 0, "true").otherwise("false"), F.lit("}"),
    )
    lines = F.array_join(F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), line), ",")
    doc = F.concat(
        F.lit('{"id":'), key.cast("string"), F.lit(',"status":"'), F.col("o_orderstatus"),
        F.lit('","total":'), (key % 1000).cast("string"), F.lit('.500e+1,"none":null,"lines":['), lines,
        F.lit('],"empty":{},"list":[],"n~1":"é '), F.substring("o_orderpriority", 3, 20), F.lit('"}'),
    )
    return t.spread("orders").select(key.alias("record"), doc.alias("doc"))


def flat(t: Tables) -> DataFrame:
    return flatten.flatten_json(docrec(t), "record", "doc")


def node_table(t: Tables) -> DataFrame:
    """The flattened records as the load keeps them, with digests: written once, read by all.

    Digests are most of it; their hex digits take half the room in this codec.
    """
    return t.staged("nodes", lambda: flatten.flatten_json(docrec(t), "record", "doc", digests=True), codec="zstd")


def leaf_table(t: Tables) -> DataFrame:
    return flatten.leaves(node_table(t)).drop("digest")


LEAVES = """
o AS (SELECT o_orderkey AS record, * FROM orders),
n AS (SELECT *, unnest(range(0, record % 4 + 1)) AS i FROM o),
leaves AS (
  SELECT record, '/id' AS source_path, '/id' AS base_field, 'integer' AS json_type, CAST(record AS VARCHAR) AS value, CAST(1 AS BIGINT) AS depth FROM o
  UNION ALL SELECT record, '/status', '/status', 'text', o_orderstatus, 1 FROM o
  UNION ALL SELECT record, '/total', '/total', 'decimal', CAST(record % 1000 AS VARCHAR) || '.500e+1', 1 FROM o
  UNION ALL SELECT record, '/none', '/none', 'null', NULL, 1 FROM o
  UNION ALL SELECT record, '/empty', '/empty', 'empty_object', NULL, 1 FROM o
  UNION ALL SELECT record, '/list', '/list', 'empty_array', NULL, 1 FROM o
  UNION ALL SELECT record, '/n~01', '/n~01', 'text', 'é ' || substr(o_orderpriority, 3), 1 FROM o
  UNION ALL SELECT record, '/lines/' || i || '/no', '/lines/no', 'integer', CAST(i AS VARCHAR), 3 FROM n
  UNION ALL SELECT record, '/lines/' || i || '/qty', '/lines/qty', 'text', CAST(o_custkey % (i + 2) AS VARCHAR), 3 FROM n
  UNION ALL SELECT record, '/lines/' || i || '/a~1b', '/lines/a~1b', 'boolean', CASE WHEN (record + i) % 2 = 0 THEN 'true' ELSE 'false' END, 3 FROM n),
boxes AS (
  SELECT record, '' AS source_path, 'object' AS json_type, CAST(8 AS BIGINT) AS size, CAST(0 AS BIGINT) AS depth FROM o
  UNION ALL SELECT record, '/empty', 'object', 0, 1 FROM o
  UNION ALL SELECT record, '/list', 'array', 0, 1 FROM o
  UNION ALL SELECT record, '/lines', 'array', record % 4 + 1, 1 FROM o
  UNION ALL SELECT record, '/lines/' || i, 'object', 3, 2 FROM n)"""


@query("json_leaves", q.with_(LEAVES, "SELECT record, source_path, base_field, json_type, value, depth FROM leaves"))
def json_leaves(t: Tables):
    return flatten.leaves(flat(t))


@query("json_containers", q.with_(LEAVES, "SELECT * FROM boxes"))
def json_containers(t: Tables):
    return flatten.containers(flat(t))


@query(
    "structure_rows",
    """
SELECT event_id, '' AS source_path, 'object' AS type, NULL AS value FROM events
UNION ALL SELECT event_id, '/k', 'number', json_extract_string(props, '$.k') FROM events
""",
)
def structure_rows(t: Tables):
    rows = flatten.structure_rows(flatten.flatten_json(t.events, "event_id", "props"))
    return rows.select("event_id", "source_path", "type", "value")


STRICT = """
strict AS (SELECT event_id, event_id % 8 AS style, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '{"k": 1, "k": 2}' WHEN 2 THEN '{"k": 0.12345678901234567890123}'
  WHEN 3 THEN '{"k": NaN}' WHEN 4 THEN '{"k": ' WHEN 5 THEN '{"k": 1.2300e+2, "t": "NaN 0.12345678901234567890123"}' WHEN 6 THEN '{"a": {"x": 1, "x": 1}}' ELSE '{"k": 0.1, "big": 12345678901234567890}' END AS raw FROM events)"""


def strict_lines(t: Tables) -> DataFrame:
    style = F.col("event_id") % 8
    raw = (
        F.when(style == 0, F.col("props"))
        .when(style == 1, '{"k": 1, "k": 2}')
        .when(style == 2, '{"k": 0.12345678901234567890123}')
        .when(style == 3, '{"k": NaN}')
        .when(style == 4, '{"k": ')
        .when(style == 5, '{"k": 1.2300e+2, "t": "NaN 0.12345678901234567890123"}')
        .when(style == 6, '{"a": {"x": 1, "x": 1}}')
        .otherwise('{"k": 0.1, "big": 12345678901234567890}')
    )
    return t.events.select("event_id", raw.alias("raw"))


@query(
    "json_strict_ingest",
    q.with_(
        STRICT,
        """SELECT event_id, raw, CASE style WHEN 1 THEN 'json_duplicate_keys' WHEN 6 THEN 'json_duplicate_keys' WHEN 2 THEN 'json_number_precision'
  WHEN 3 THEN 'json_non_finite' WHEN 4 THEN 'json_invalid' END AS error FROM strict""",
    ),
)
def json_strict_ingest(t: Tables):
    return strict_lines(t).withColumn("error", jsonl.strict_error(F.col("raw")))


@query(
    "jsonl_envelope_quarantine",
    """
WITH s AS (SELECT event_id, event_type, event_id % 9 AS style FROM events)
SELECT event_id, CASE WHEN style IN (3) THEN NULL ELSE event_type END AS source_id,
  CASE WHEN style IN (3) THEN NULL WHEN style = 5 THEN '' ELSE CAST(event_id AS VARCHAR) END AS external_id,
  CASE style WHEN 1 THEN 'invalid_envelope' WHEN 2 THEN 'invalid_envelope' WHEN 3 THEN 'json_invalid' WHEN 4 THEN 'invalid_envelope'
     WHEN 5 THEN 'invalid_envelope' WHEN 6 THEN 'invalid_source_version' WHEN 7 THEN 'json_duplicate_keys' END AS error FROM s
""",
)
def jsonl_envelope_quarantine(t: Tables):
    style, ident = F.col("event_id") % 9, F.col("event_id").cast("string")
    head = F.concat(F.lit('{"source_id":"'), F.col("event_type"), F.lit('",'))
    text_id = F.concat(F.lit('"external_id":"'), ident, F.lit('",'))
    body = F.concat(F.lit('"record":'), F.col("props"), F.lit("}"))
    line = (
        F.when(style == 1, F.concat(head, text_id, F.lit('"extra":1,'), body))
        .when(style == 2, F.concat(head, text_id, F.lit('"record":[1]}')))
        .when(style == 3, F.concat(head, text_id))
        .when(style == 4, F.concat(head, F.lit('"external_id":'), ident, F.lit(","), body))
        .when(style == 5, F.concat(head, F.lit('"external_id":"",'), body))
        .when(style == 6, F.concat(head, text_id, F.lit('"source_version":true,'), body))
        .when(style == 7, F.concat(head, text_id, F.lit('"source_version":1,"source_version":1,'), body))
        .when(style == 8, F.concat(head, text_id, F.lit('"source_version":7,'), body))
        .otherwise(F.concat(head, text_id, body))
    )
    lines = t.events.select("event_id", line.alias("line"))
    enveloped = jsonl.envelopes(lines)
    broken = F.col("error") == "json_invalid"
    return enveloped.select(
        "event_id",
        F.when(~F.coalesce(broken, F.lit(False)), F.col("source_id")).alias("source_id"),
        F.when(~F.coalesce(broken, F.lit(False)), F.col("external_id")).alias("external_id"),
        "error",
    )


RULE_ROWS = [
    ("/id", "identity", "number", "mapped"),
    ("/status", "identity", "state", "mapped"),
    ("/lines/qty", "document", "number", "mapped"),
    ("/lines/no", "document", "position", "pending"),
]


def rules(t: Tables) -> DataFrame:
    """The rules as a written table: its size is known, so leaves are not dealt out to join a few of them."""
    columns = "base_field string, target_kind string, target_path string, status string"
    return t.staged("rules", lambda: t.spark.createDataFrame(RULE_ROWS, columns).coalesce(1))


FACTS = LEAVES + """,
rules(base_field, target_kind, target_path, status) AS (VALUES ('/id', 'identity', 'number', 'mapped'), ('/status', 'identity', 'state', 'mapped'),
  ('/lines/qty', 'document', 'number', 'mapped'), ('/lines/no', 'document', 'position', 'pending')),
facts AS (SELECT l.record, l.source_path, l.base_field, l.json_type, l.value, coalesce(r.target_kind, 'custom') AS target_kind,
  coalesce(r.target_path, 'value') AS target_path, coalesce(r.status, 'pending') AS status,
  CASE WHEN r.target_kind IS NULL THEN 'unmapped_semantics' END AS pending_reason,
  'orders' AS source_id, l.record % 7 AS source_version,
  sha256(sha256('orders') || sha256(CAST(l.record AS VARCHAR)) || sha256(CAST(l.record % 7 AS VARCHAR)) || sha256(l.source_path)) AS fact_id FROM leaves l LEFT JOIN rules r USING (base_field))"""


def fact_table(t: Tables) -> DataFrame:
    """Facts of all leaves; every seventh record has the same source version."""
    versioned = leaf_table(t).withColumns({"source_id": F.lit("orders"), "source_version": F.col("record") % 7})
    return mapping.map_facts(versioned, rules(t), ["source_id", "record", "source_version"])


@query("map_facts", q.with_(FACTS, "SELECT * FROM facts"))
def map_facts(t: Tables):
    return fact_table(t).drop("depth")


@query(
    "group_item_key",
    q.with_(
        LEAVES,
        """, g AS (SELECT record, source_path, regexp_replace(source_path, '/[^/]*$', '') AS parent, regexp_extract(source_path, '/([^/]*)$', 1) AS field,
   sha256(regexp_extract(source_path, '/([^/]*)$', 1)) || coalesce(sha256(upper(value)), json_type) AS spelled FROM leaves),
k AS (SELECT record, parent, sha256(string_agg(spelled, '' ORDER BY spelled)) AS item_key, count(*) AS components FROM g GROUP BY record, parent)
SELECT record, source_path, field, item_key, components FROM g JOIN k USING (record, parent)""",
    ),
)
def group_item_key(t: Tables):
    components = leaf_table(t).withColumn("normalized", F.upper("value"))
    return mapping.group_item_keys(components, "record", "normalized").select("record", "source_path", "field", "item_key", "components")


def measured_records(t: Tables) -> DataFrame:
    """Records of which some reach each limit: many leaves, deep nesting, many bytes, unreadable."""
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 3000 == 7, F.concat(F.lit("["), F.repeat(F.lit("0,"), F.lit(20_000)), F.lit("0]")))
        .when(key % 3000 == 8, F.concat(F.lit("["), F.repeat(F.lit("0,"), F.lit(19_999)), F.lit("0]")))
        .when(key % 3000 == 11, F.concat(F.repeat(F.lit("["), F.lit(66)), F.repeat(F.lit("]"), F.lit(66))))
        .when(key % 3000 == 12, F.concat(F.repeat(F.lit("["), F.lit(65)), F.repeat(F.lit("]"), F.lit(65))))
        .when(key % 3000 == 13, F.concat(F.lit('"'), F.repeat(F.lit("x"), F.lit(2_097_151)), F.lit('"')))
        .when(key % 3000 == 14, F.concat(F.lit('"'), F.repeat(F.lit("x"), F.lit(2_097_150)), F.lit('"')))
        .when(key % 3000 == 17, '{"a": ')
        .otherwise(F.concat(F.lit("["), F.repeat(F.lit("1,"), (key % 40).cast("int")), F.lit("2]")))
    )
    return t.spread("orders").select(key.alias("record"), raw.alias("raw"))


MEASURED = """
kinds AS (SELECT o_orderkey AS record, o_orderkey % 3000 AS style FROM orders),
sizes AS (SELECT record, CASE style WHEN 7 THEN 20001 WHEN 8 THEN 20000 WHEN 17 THEN 0 WHEN 11 THEN 1 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 14 THEN 1 ELSE record % 40 + 1 END AS leaves,
  CAST(CASE style WHEN 17 THEN 0 WHEN 11 THEN 65 WHEN 12 THEN 64 WHEN 13 THEN 0 WHEN 14 THEN 0 ELSE 1 END AS BIGINT) AS depth,
  CASE style WHEN 7 THEN 40003 WHEN 8 THEN 40001 WHEN 11 THEN 132 WHEN 12 THEN 130 WHEN 13 THEN 2097153 WHEN 14 THEN 2097152 WHEN 17 THEN 6 ELSE 2 * (record % 40) + 3 END AS bytes,
  CASE style WHEN 7 THEN 'leaves' WHEN 11 THEN 'depth' WHEN 13 THEN 'bytes' WHEN 17 THEN 'json_invalid' END AS refused FROM kinds)"""


def limited(t: Tables) -> DataFrame:
    records = measured_records(t)
    return t.staged("limits", lambda: flatten.record_limits(records, flatten.flatten_json(records, "record", "raw"), "record", "raw"))


@query("record_limits", q.with_(MEASURED, "SELECT record, leaves, depth, bytes, refused FROM sizes"))
def record_limits(t: Tables):
    return limited(t).select("record", "leaves", "depth", "bytes", "refused")


@query("record_set_aside", q.with_(MEASURED, "SELECT record, refused, bytes AS kept_bytes FROM sizes WHERE refused IS NOT NULL"))
def record_set_aside(t: Tables):
    """Refused records come out whole."""
    refused = flatten.set_aside(measured_records(t), limited(t), "record")[1]
    return refused.select("record", "refused", F.octet_length("raw").cast("long").alias("kept_bytes"))


@query(
    "batch_cuts",
    q.with_(
        MEASURED,
        """, item AS (SELECT record, leaves, bytes, row_number() OVER (ORDER BY record) AS ordinal FROM sizes WHERE refused IS NULL),
total AS (SELECT *, sum(leaves) OVER (ORDER BY ordinal) - leaves AS a0, sum(leaves) OVER (ORDER BY ordinal) AS a1,
  sum(bytes) OVER (ORDER BY ordinal) - bytes AS b0, sum(bytes) OVER (ORDER BY ordinal) AS b1 FROM item),
-- each step begins the batch after the longest one that keeps every limit
cuts(start, batch) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT)
  UNION ALL SELECT min(n.ordinal), any_value(c.batch) + 1 FROM cuts c JOIN total s ON s.ordinal = c.start JOIN total n ON n.ordinal > c.start AND n.ordinal <= c.start + 100
  WHERE n.a1 - s.a0 > 1500 OR n.b1 - s.b0 > 4000 OR n.ordinal = c.start + 100 GROUP BY c.start)
SELECT i.record, i.ordinal, c.batch, i.ordinal - c.start + 1 AS place FROM item i ASOF JOIN cuts c ON i.ordinal >= c.start""",
        recursive=True,
    ),
)
def batch_cuts(t: Tables):
    kept = limited(t).filter(F.col("refused").isNull()).select("record", "leaves", "bytes")
    cut = batching.batches(kept, ["record"], "leaves", "bytes", records=100, max_atoms=1500, max_bytes=4000, block_rows=2000)
    return cut.select("record", "ordinal", "batch", "place")


@query(
    "coverage_check",
    q.with_(
        LEAVES,
        """, h AS (SELECT *, record * 31 + length(source_path) AS mark FROM leaves),
stats AS (SELECT record, CAST(sum(CASE WHEN mark % 101 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  CAST(sum(CASE WHEN mark % 103 = 0 AND mark % 101 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS extra,
  CAST(sum(CASE WHEN mark % 107 = 0 AND mark % 101 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS changed,
  CAST(sum(CASE WHEN mark % 109 = 0 AND mark % 101 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates,
  CAST(sum(CASE WHEN mark % 113 = 0 AND mark % 101 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_metadata FROM h GROUP BY record),
shape AS (SELECT record, bool_and((record * 7 + length(source_path)) % 127 NOT IN (1, 2, 3)) AS containers_match FROM boxes GROUP BY record)
SELECT s.*, containers_match, missing + extra + changed + duplicates + invalid_metadata = 0 AND containers_match AS passed FROM stats s JOIN shape USING (record)""",
    ),
)
def coverage_check(t: Tables):
    """Facts and containers as stored, some lost, added, changed, doubled or with another digest."""
    nodes = node_table(t)
    expected = flatten.leaves(nodes).select("record", "source_path", "json_type", "value", "digest")
    mark = F.col("record") * 31 + F.char_length("source_path")
    kept = expected.filter(mark % 101 != 0)
    facts = kept.withColumns(
        {
            "value": F.when(mark % 107 == 0, F.lit("tampered")).otherwise(F.col("value")),
            "digest": F.when(mark % 113 == 0, F.lit("tampered")).otherwise(F.col("digest")),
        }
    )
    copies = facts.filter(mark % 109 == 0)
    strays = kept.filter(mark % 103 == 0).withColumn("source_path", F.concat("source_path", F.lit("/stray")))
    boxes = nodes.filter(F.col("row_kind") == "container").select("record", "source_path", "json_type", "size")
    spot = (F.col("record") * 7 + F.char_length("source_path")) % 127
    stored = boxes.filter(spot != 1).withColumn("size", F.col("size") + F.when(spot == 2, 1).otherwise(0))
    stored = stored.unionByName(boxes.filter(spot == 3))
    return mapping.coverage(expected, facts.unionByName(copies).unionByName(strays), "record", boxes, stored)


@query(
    "identity_eligible",
    """
WITH c AS (SELECT o_custkey AS record, 'D' || (CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 2 ELSE o_custkey END) AS claim, o_orderkey % 17 <> 0 AS valid FROM orders),
g AS (SELECT record, count(*) AS claims, min(CASE WHEN valid THEN claim END) AS lo, count(DISTINCT CASE WHEN valid THEN claim END) AS n, bool_and(valid) AS ok FROM c GROUP BY record)
SELECT record, claims, ok AND n = 1 AS eligible, CASE WHEN ok AND n = 1 THEN lo END AS candidate,
  CASE WHEN n > 1 OR (n > 0 AND NOT ok) THEN 'conflicting_claims' END AS pending_reason FROM g
""",
)
def identity_eligible(t: Tables):
    number = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 2).otherwise(F.col("o_custkey"))
    claims = t.orders.select(
        F.col("o_custkey").alias("record"),
        F.concat(F.lit("D"), number.cast("string")).alias("claim"),
        (F.col("o_orderkey") % 17 != 0).alias("valid"),
    )
    return mapping.identity_eligibility(claims, "record")


@query(
    "kind_columns",
    q.with_(FACTS, "SELECT DISTINCT target_kind, regexp_extract(base_field, '/([^/]*)$', 1) AS key FROM facts"),
)
def kind_columns(t: Tables):
    facts = fact_table(t)
    keyed = facts.withColumn("key", mapping.last_step(F.col("base_field")))
    return mapping.discovered_columns(keyed, "target_kind", "key")


@query(
    "typed_scalar",
    q.with_(
        LEAVES,
        """SELECT record, source_path, CASE WHEN json_type NOT LIKE 'empty%' THEN json_type END AS value_type, CASE WHEN json_type = 'text' THEN value END AS value_exact,
  CASE WHEN json_type = 'boolean' THEN value = 'true' END AS value_boolean,
  CASE WHEN json_type IN ('integer', 'decimal') THEN CASE WHEN CAST(value AS DOUBLE) = 0 THEN '0e0' ELSE
    regexp_replace(CAST(CAST(round(CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR), '0+$', '') || 'e'
      || (length(CAST(CAST(round(CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR)) - length(regexp_replace(CAST(CAST(round(CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR), '0+$', ''))) END END AS number_exact,
  CASE WHEN json_type LIKE 'empty%' THEN 'unsupported_values' END AS omitted FROM leaves""",
    ),
)
def typed_scalar(t: Tables):
    scalar = values.typed_scalar(F.col("value"), F.col("json_type"))
    return leaf_table(t).withColumn("s", scalar).select("record", "source_path", "s.*")


# Operands of comparisons by value: a name and a JSON text each.
OPERANDS = (
    ("int 1", "1.0"),
    ("text 1", '"1"'),
    ("true", "true"),
    ("null", "null"),
    ("forty", "4.00e1"),
    ("no list", "[]"),
    ("no members", "{}"),
    ("line", '{"a/b": true, "qty": "1", "no": 10e-1}'),
    ("lines", '[{"qty": "0", "a/b": true, "no": 0.0}]'),
)


@query(
    "pred_eq_typed",
    q.with_(
        LEAVES,
        """, line AS (SELECT record, i, o_custkey % (i + 2) AS qty, (record + i) % 2 = 0 AS even FROM n)
SELECT record, source_path, asked FROM leaves, (VALUES ('int 1'), ('text 1'), ('true'), ('null'), ('forty')) a(asked)
WHERE (asked = 'int 1' AND json_type = 'integer' AND value = '1') OR (asked = 'text 1' AND json_type = 'text' AND value = '1')
   OR (asked = 'true' AND json_type = 'boolean' AND value = 'true') OR (asked = 'null' AND json_type = 'null')
   OR (asked = 'forty' AND (json_type = 'integer' AND value = '40' OR json_type = 'decimal' AND (record % 1000) * 10 + 5 = 40))
UNION ALL SELECT record, '/list', 'no list' FROM o UNION ALL SELECT record, '/empty', 'no members' FROM o
UNION ALL SELECT record, '/lines/1', 'line' FROM line WHERE i = 1 AND qty = 1 AND even
UNION ALL SELECT record, '/lines', 'lines' FROM line WHERE record % 4 = 0 AND qty = 0 AND even""",
    ),
)
def pred_eq_typed(t: Tables):
    """Equality of values of any depth: digests made when the records were flattened."""
    asked = t.spark.createDataFrame([(flatten.value_digest(raw), name) for name, raw in OPERANDS], "digest string, asked string")
    nodes = node_table(t).filter(F.col("json_type") != "empty_object").filter(F.col("json_type") != "empty_array")
    found = nodes.join(F.broadcast(asked), "digest")  # the operands of one query
    return found.select("record", "source_path", "asked")


def projection_input(t: Tables) -> DataFrame:
    """Current fields of every kind, among them custom ones, days and texts that can't be indexed."""
    key = F.col("id")
    names = ("click", "email", "purchase", "document", "view", "phone", "signup", "username", "error", "gadget")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in names]), F.col("item"))
    kind = F.when(key % 17 == 0, "custom").when(key % 11 == 0, "identity").otherwise(kind)
    path = F.element_at(F.array(*[F.lit(x) for x in ("number", "type", "email", "country")]), (key % 4 + 1).cast("int"))
    path = F.when(key % 17 == 0, "value").when(key % 11 == 0, "birth_date").otherwise(path)
    text = (
        F.when(key % 31 == 0, F.concat(F.lit("a"), F.char(F.lit(0)), F.lit("b")))
        .when(key % 37 == 0, F.repeat(F.lit("x"), F.lit(8193)))
        .when(key % 22 == 0, "1999-02-30")
        .when(key % 11 == 0, "1980-05-17")
        .otherwise(F.concat(F.lit("Élan "), F.col("source")))
    )
    json_type = F.when(key % 13 == 0, "object").when((key % 2 == 0) & (key % 11 > 0), "integer").otherwise("text")
    types = F.when(key % 5 == 0, "reference").when(key % 5 == 1, "date").otherwise("text")
    definition = F.struct(
        F.col("item").alias("field_id"), (key % 3 + 1).alias("version"), F.sha2("item", 256).alias("sha256"),
        types.alias("type"), F.lit("v1").alias("contract"), F.lit(None).cast("string").alias("deployment_id"),
    )
    return t.decided.filter(F.col("applied")).select(
        "owner",
        "id",
        kind.alias("kind"),
        path.alias("path"),
        F.when(json_type == "integer", F.col("source").cast("string")).otherwise(text).alias("value"),
        json_type.alias("json_type"),
        "status",
        (key % 8 == 5).alias("derived"),
        F.col("source").cast("string").alias("source"),
        F.when(key % 29 == 0, F.repeat(F.lit("m"), F.lit(9000))).otherwise("{}").alias("metadata"),
        F.when(key % 34 != 0, definition).alias("definition"),
        "effective",
        "received",
    )


def projection_flags(t: Tables) -> DataFrame:
    """One flag for every third field, some of other fields and some of unknown names."""
    key = F.col("id")
    names = F.array(*[F.lit(x) for x in ("valid", "is_whatsapp", "deliverable", "valid", "seen")])
    return projection_input(t).filter(key % 3 == 0).select(
        "owner",
        "id",
        F.when(key % 7 == 0, "other").otherwise(F.col("path")).alias("path"),
        F.element_at(names, (key % 5 + 1).cast("int")).alias("name"),
        F.when(key % 4 < 2, True).when(key % 4 == 2, False).alias("value"),
        (key % 10 != 3).alias("applicable"),
        F.col("received").alias("expires"),
    )


PROJECTED = q.DECIDED + """,
allowed(kind, path) AS (VALUES ('document','number'),('document','type'),('document','country'),('phone','number'),('phone','type'),('phone','country'),
  ('email','email'),('custom','value'),('identity','birth_date')),
pin0 AS (SELECT owner, id, item, status, CAST(source AS VARCHAR) AS source, effective, received, id % 8 = 5 AS derived,
  CASE WHEN id % 17 = 0 THEN 'custom' WHEN id % 11 = 0 THEN 'identity' ELSE CASE item WHEN 'click' THEN 'email' WHEN 'purchase' THEN 'document' WHEN 'view' THEN 'phone'
    WHEN 'signup' THEN 'username' ELSE 'gadget' END END AS kind,
  CASE WHEN id % 17 = 0 THEN 'value' WHEN id % 11 = 0 THEN 'birth_date' ELSE ['number', 'type', 'email', 'country'][id % 4 + 1] END AS path,
  CASE WHEN id % 13 = 0 THEN 'object' WHEN id % 2 = 0 AND id % 11 > 0 THEN 'integer' ELSE 'text' END AS json_type,
  CASE WHEN id % 31 = 0 THEN 'unsafe' WHEN id % 37 = 0 THEN 'long' WHEN id % 22 = 0 THEN '1999-02-30' WHEN id % 11 = 0 THEN '1980-05-17' ELSE 'Élan ' || source END AS text,
  CASE id % 5 WHEN 0 THEN 'reference' WHEN 1 THEN 'date' ELSE 'text' END AS type,
  id % 29 = 0 AS much, id % 34 <> 0 AS bound FROM decided WHERE applied),
flag AS (SELECT owner, id, CASE WHEN id % 7 = 0 THEN 'other' ELSE path END AS path, ['valid', 'is_whatsapp', 'deliverable', 'valid', 'seen'][id % 5 + 1] AS name,
  CASE WHEN id % 4 < 2 THEN TRUE WHEN id % 4 = 2 THEN FALSE END AS value, id % 10 <> 3 AS applicable, received AS expires FROM pin0 WHERE id % 3 = 0),
proj0 AS (SELECT p.*, CASE WHEN kind = 'gadget' THEN 'unknown_items' WHEN a.path IS NULL THEN 'unknown_fields' WHEN kind = 'custom' AND NOT bound THEN 'unbound_custom_fields'
    WHEN kind = 'custom' AND type = 'reference' OR json_type = 'object' THEN 'unsupported_values'
    WHEN json_type = 'text' AND text = 'unsafe' THEN 'unsafe_text' WHEN json_type = 'text' AND text = 'long' THEN 'long_text' END AS omitted,
  json_type = 'text' AND (path = 'birth_date' OR kind = 'custom' AND type = 'date') AS dated FROM pin0 p LEFT JOIN allowed a USING (kind, path)),
proj AS (SELECT *, omitted IS NULL AND status <> 'pending' AND NOT (dated AND text <> '1980-05-17') AS resolved FROM proj0),
shown AS (SELECT p.*, f.name, f.expires, CASE WHEN p.resolved AND f.applicable THEN f.value END AS said FROM proj p
  LEFT JOIN flag f ON f.owner = p.owner AND f.id = p.id AND f.path = p.path)"""


@query(
    "search_projection",
    q.with_(
        PROJECTED,
        """SELECT owner, id, kind, path, omitted, resolved, CASE WHEN omitted IS NULL THEN json_type END AS value_type,
  CASE WHEN omitted IS NULL AND json_type = 'text' THEN text END AS value_exact,
  CASE WHEN omitted IS NULL AND json_type = 'text' THEN strip_accents(lower(text)) END AS value_folded,
  CASE WHEN omitted IS NULL AND json_type = 'integer' THEN CASE WHEN source = '0' THEN '0e0' ELSE source || 'e0' END END AS number_exact,
  CASE WHEN resolved AND dated THEN CAST(text AS DATE) END AS value_date, sha256('{"source":"' || source || '"}') AS source_key,
  CASE WHEN kind = 'custom' AND omitted IS NULL THEN sha256('{"contract":"v1","deployment_id":null,"field_id":"' || item || '","sha256":"' || sha256(item) || '","type":"' || type
    || '","version":' || (id % 3 + 1) || '}') END AS custom_key,
  effective, received, CASE WHEN NOT much THEN '{}' END AS metadata,
  CASE WHEN name = 'valid' AND NOT derived AND said IS NOT NULL THEN CAST(said AS VARCHAR) ELSE 'unknown' END AS valid,
  CASE WHEN name = 'is_whatsapp' AND NOT derived AND said IS NOT NULL THEN CAST(said AS VARCHAR) ELSE 'unknown' END AS is_whatsapp,
  CASE WHEN name = 'deliverable' AND NOT derived AND said IS NOT NULL THEN CAST(said AS VARCHAR) ELSE 'unknown' END AS deliverable,
  CASE WHEN name = 'valid' THEN expires END AS valid_until,
  CASE WHEN name = 'valid' AND derived AND said IS NOT NULL THEN CAST(said AS VARCHAR) ELSE 'unknown' END AS parent_valid,
  coalesce(resolved AND NOT derived AND name = 'valid' AND said, FALSE) AS confirmation_recorded FROM shown""",
    ),
)
def search_projection(t: Tables):
    projected = projection.project_fields(
        projection_input(t), projection.searchable_table(t.spark), projection_flags(t), ["owner", "id"]
    )
    return projected.select(
        "owner", "id", "kind", "path", "omitted", "resolved", "value_type", "value_exact", "value_folded", "number_exact", "value_date",
        "source_key", "custom_key", "effective", "received", "metadata", F.col("flag_valid.state").alias("valid"),
        F.col("flag_is_whatsapp.state").alias("is_whatsapp"), F.col("flag_deliverable.state").alias("deliverable"),
        F.col("flag_valid.expires").alias("valid_until"), F.col("parent_valid.state").alias("parent_valid"), "confirmation_recorded",
    )


@query(
    "projection_omissions",
    q.with_(
        PROJECTED,
        """, counted AS (SELECT owner, count(*) FILTER (omitted IS NULL) AS indexed, count(*) FILTER (omitted = 'unknown_items') AS unknown_items,
  count(*) FILTER (omitted = 'unknown_fields') AS unknown_fields, count(*) FILTER (omitted = 'unsupported_values') AS unsupported_values,
  count(*) FILTER (omitted = 'unsafe_text') AS unsafe_text, count(*) FILTER (omitted = 'long_text') AS long_text,
  count(*) FILTER (omitted = 'unbound_custom_fields') AS unbound_custom_fields, count(*) FILTER (omitted IS NULL AND much) AS metadata FROM proj GROUP BY owner)
SELECT *, (SELECT count(*) FROM flag f WHERE f.owner = counted.owner AND name = 'seen') AS unknown_flags FROM counted""",
    ),
)
def projection_omissions(t: Tables):
    flags = projection_flags(t)
    projected = projection.project_fields(projection_input(t), projection.searchable_table(t.spark), flags, ["owner", "id"])
    return projection.omissions(projected, flags, "owner")


@query(
    "derived_fields",
    """
WITH e AS (SELECT p_partkey, 'type' AS path, 'explicit' AS value FROM part WHERE p_partkey % 3 = 0)
SELECT *, FALSE AS derived FROM e
UNION ALL SELECT p_partkey, 'brand', p_brand, TRUE FROM part
UNION ALL SELECT p_partkey, 'type', p_type, TRUE FROM part WHERE p_partkey % 3 <> 0
""",
)
def derived_fields(t: Tables):
    explicit = t.part.filter(F.col("p_partkey") % 3 == 0).select("p_partkey", F.lit("type").alias("path"), F.lit("explicit").alias("value"))
    attributes = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return mapping.derived_fields(t.part, attributes, explicit, "p_partkey")


@query(
    "display_name",
    """
WITH i AS (SELECT o_custkey, o_orderkey, substr(o_orderpriority, 3) AS name FROM orders WHERE o_orderkey % 10 = 0),
f AS (SELECT o_custkey, arg_min(name, o_orderkey) AS name FROM i GROUP BY o_custkey)
SELECT c_custkey, coalesce(name, 'Sem nome informado') AS name FROM customer LEFT JOIN f ON o_custkey = c_custkey
""",
)
def display_name(t: Tables):
    items = t.orders.select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_orderkey").alias("item_order"),
        F.when(F.col("o_orderkey") % 10 == 0, "identity").otherwise("document").alias("kind"),
        F.substring("o_orderpriority", 3, 20).alias("name"),
    )
    return mapping.display_names(t.customer, items, "c_custkey")
