"""Field definitions and custom values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import catalog
from factledger.plans.identity_queries import entities
from factledger.plans.registry import query
from factledger.plans.tables import Tables

DEFINITION_ROWS = [
    ("click", 1, "integer", "both", True),
    ("click", 2, "integer", "person", True),
    ("error", 1, "text", "company", True),
    ("purchase", 1, "decimal", "both", False),
    ("purchase", 2, "decimal", "both", True),
    ("signup", 1, "date", "person", True),
]


def definitions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(
        DEFINITION_ROWS, "field_id string, version bigint, type string, scope string, active boolean"
    )


@query(
    "definition_bind",
    """
WITH d(field_id, version, type, scope, active) AS (VALUES ('click', 1, 'integer', 'both', TRUE), ('click', 2, 'integer', 'person', TRUE), ('error', 1, 'text', 'company', TRUE),
  ('purchase', 1, 'decimal', 'both', FALSE), ('purchase', 2, 'decimal', 'both', TRUE), ('signup', 1, 'date', 'person', TRUE)),
v AS (SELECT event_id, event_type AS field_id, event_id % 2 + 1 AS version, CASE WHEN user_id % 4 = 0 THEN 'company' ELSE 'person' END AS entity_type FROM events)
SELECT v.event_id, v.field_id, v.version, v.entity_type, d.type,
  CASE WHEN d.type IS NULL THEN 'pending' WHEN NOT active THEN 'rejected' WHEN scope <> 'both' AND scope <> entity_type THEN 'rejected' ELSE 'bound' END AS bind_status,
  CASE WHEN d.type IS NULL THEN 'definition_unknown' WHEN NOT active THEN 'definition_inactive' WHEN scope <> 'both' AND scope <> entity_type THEN 'scope_mismatch' END AS bind_reason
FROM v LEFT JOIN d USING (field_id, version)
""",
)
def definition_bind(t: Tables):
    rows = t.events.select(
        "event_id",
        F.col("event_type").alias("field_id"),
        (F.col("event_id") % 2 + 1).alias("version"),
        F.when(F.col("user_id") % 4 == 0, "company").otherwise("person").alias("entity_type"),
    )
    bound = catalog.bind(rows, definitions(t), F.col("entity_type"))
    return bound.select("event_id", "field_id", "version", "entity_type", "type", "bind_status", "bind_reason")


@query(
    "definition_as_of",
    """
WITH d AS (SELECT p_brand AS field_id, CAST(p_size AS BIGINT) AS version, min(DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER)) AS changed_at FROM part GROUP BY 1, 2),
u AS (SELECT DISTINCT p_brand AS field_id FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount < 0.01)
SELECT field_id, version, changed_at FROM d WHERE changed_at <= DATE '2024-01-31' AND field_id IN (SELECT field_id FROM u)
""",
)
def definition_as_of(t: Tables):
    changed = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int"))
    versions = t.part.groupBy(F.col("p_brand").alias("field_id"), F.col("p_size").cast("long").alias("version")).agg(
        F.min(changed).alias("changed_at")
    )
    chosen = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49) & (F.col("l_discount") < 0.01))
    used = t.part.join(chosen.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(
        F.col("p_brand").alias("field_id")
    )
    return catalog.in_force(versions, used, F.lit("2024-01-31").cast("date"))


@query(
    "definition_scd2",
    """
WITH c AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'integer' ELSE 'text' END AS type,
   CAST(json_extract_string(props, '$.k') AS BIGINT) // 40 AS name FROM events),
f AS (SELECT *, first_value(type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_type FROM c),
ok AS (SELECT *, lag(name) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM f WHERE type = first_type),
n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to
   FROM ok WHERE rn = 1 OR name IS DISTINCT FROM prev)
SELECT user_id, event_id, 'version' AS status, version, ts AS valid_from, valid_to FROM n
UNION ALL SELECT user_id, event_id, 'incompatible', NULL, ts, NULL FROM f WHERE type <> first_type
""",
)
def definition_scd2(t: Tables):
    changes = t.events.select(
        "user_id",
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "integer").otherwise("text").alias("type"),
        F.floor(F.get_json_object("props", "$.k").cast("bigint") / 40).alias("name"),
    )
    return catalog.history_intervals(changes, "user_id", "event_id", "ts", fixed="type", value="name")


TYPES = ["text", "integer", "decimal", "boolean", "date", "enum", "url", "reference"]  # fixed values: field types


@query(
    "custom_type_check",
    """
WITH v AS (SELECT event_id, ['text','integer','decimal','boolean','date','enum','url','reference'][event_id % 8 + 1] AS declared, event_id % 11 AS style, user_id FROM events),
r AS (SELECT *, CASE style WHEN 0 THEN 'plain' WHEN 1 THEN '42' WHEN 2 THEN '1.50' WHEN 3 THEN '12.5e1' WHEN 4 THEN 'true' WHEN 5 THEN NULL WHEN 6 THEN '2024-02-29'
    WHEN 7 THEN '2023-02-29' WHEN 8 THEN 'red' WHEN 9 THEN 'https://a.example.org:8080/x' ELSE NULL END AS raw,
  CASE style WHEN 1 THEN 'integer' WHEN 2 THEN 'decimal' WHEN 4 THEN 'boolean' WHEN 5 THEN 'null' WHEN 10 THEN 'object' ELSE 'text' END AS json_type FROM v)
SELECT event_id, declared, raw, json_type, json_type = 'null' OR CASE declared WHEN 'text' THEN json_type = 'text' WHEN 'integer' THEN style = 1 WHEN 'decimal' THEN style IN (1, 2, 3)
   WHEN 'boolean' THEN style = 4 WHEN 'date' THEN style = 6 WHEN 'enum' THEN style = 8 WHEN 'url' THEN style = 9
   ELSE style = 10 AND user_id % 3 <> 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id * 5) END AS valid FROM r
""",
)
def custom_type_check(t: Tables):
    style = F.col("event_id") % 11
    raws = ["plain", "42", "1.50", "12.5e1", "true", None, "2024-02-29", "2023-02-29", "red", "https://a.example.org:8080/x", None]
    kinds = ["text", "integer", "decimal", "text", "boolean", "null", "text", "text", "text", "text", "object"]
    pick = lambda options, at: F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (at + 1).cast("int"))
    is_object = style == 10
    rows = t.events.select(
        "event_id",
        pick(TYPES, F.col("event_id") % 8).alias("declared"),
        pick(raws, style).alias("raw"),
        pick(kinds, style).alias("json_type"),
        F.array(F.lit("red"), F.lit("green")).alias("options"),
        F.when(is_object, F.when(F.col("user_id") % 3 == 0, "company").otherwise("person")).alias("ref_type"),
        F.when(is_object, F.concat(F.lit("C"), F.col("user_id") * 5)).alias("ref_id"),
    )
    return catalog.check_types(rows, entities(t)).select("event_id", "declared", "raw", "json_type", "valid")


@query(
    "reference_check",
    """
WITH r AS (SELECT o_orderkey, 'C' || (o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 100000000 ELSE 0 END) AS ref_id, CASE WHEN o_orderkey % 7 = 0 THEN 'company' ELSE 'person' END AS ref_type,
  o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 100000000 ELSE 0 END AS k FROM orders)
SELECT o_orderkey, ref_id, ref_type, CASE WHEN c_custkey IS NULL THEN 'missing' WHEN ref_type = 'company' THEN 'other_type' ELSE 'ok' END AS verdict
FROM r LEFT JOIN customer ON c_custkey = k
""",
)
def reference_check(t: Tables):
    dangling = F.when(F.col("o_orderkey") % 13 == 0, 100000000).otherwise(0)
    references = t.orders.select(
        "o_orderkey",
        F.concat(F.lit("C"), (F.col("o_custkey") + dangling).cast("string")).alias("ref_id"),
        F.when(F.col("o_orderkey") % 7 == 0, "company").otherwise("person").alias("ref_type"),
    )
    return catalog.check_references(references, entities(t)).select("o_orderkey", "ref_id", "ref_type", "verdict")


@query(
    "pin_guard",
    """
WITH b AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS binding FROM events),
p AS (SELECT *, first_value(binding) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pinned FROM b)
SELECT event_id, user_id, event_type, binding, pinned FROM p WHERE binding IS DISTINCT FROM pinned
""",
)
def pin_guard(t: Tables):
    rows = t.events.select(
        "event_id", "user_id", "event_type", (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("binding")
    )
    return catalog.first_binding_guard(rows, ["user_id", "event_type"], "event_id", "binding")
