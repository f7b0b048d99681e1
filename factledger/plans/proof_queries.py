"""Reconciliation, replays, gates, publication and write guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import reconcile
from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.tables import Tables
from factledger.sources import exports


def stored_orders(t: Tables) -> DataFrame:
    """A destination copy with rows lost, added and changed."""
    key = F.col("o_orderkey")
    kept = t.orders.filter(key % 101 != 0)
    strays = t.orders.filter(key % 97 == 0).withColumn("o_orderkey", -key - 1)
    tampered = kept.withColumns(
        {
            "o_orderstatus": F.when(key % 89 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(key % 83 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
            "o_custkey": F.when(key % 79 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")),
        }
    )
    return tampered.unionByName(strays)


CODES = """
codes AS (
  SELECT o_orderkey, 'missing' AS code FROM orders WHERE o_orderkey % 101 = 0
  UNION ALL SELECT -o_orderkey - 1, 'extra' FROM orders WHERE o_orderkey % 97 = 0
  UNION ALL SELECT o_orderkey, 'o_orderstatus_mismatch' FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 89 = 0
  UNION ALL SELECT o_orderkey, 'o_totalprice_mismatch' FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 83 = 0
  UNION ALL SELECT o_orderkey, 'o_custkey_mismatch' FROM orders WHERE o_orderkey % 101 <> 0 AND o_orderkey % 79 = 0)"""

COMPARED = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("reconcile_columns", q.with_(CODES, "SELECT * FROM codes"))
def reconcile_columns(t: Tables):
    return reconcile.compare_columns(t.orders, stored_orders(t), ["o_orderkey"], COMPARED)


@query("reconcile_summary", q.with_(CODES, "SELECT code, count(*) AS n FROM codes GROUP BY code"))
def reconcile_summary(t: Tables):
    return reconcile.summarise(reconcile.compare_columns(t.orders, stored_orders(t), ["o_orderkey"], COMPARED))


@query(
    "set_missing_extra",
    """SELECT o_orderkey, 'missing' AS side FROM orders WHERE o_orderkey % 101 = 0
UNION ALL SELECT -o_orderkey - 1, 'extra' FROM orders WHERE o_orderkey % 97 = 0""",
)
def set_missing_extra(t: Tables):
    return reconcile.missing_and_extra(t.orders, stored_orders(t), ["o_orderkey"])


@query("set_changed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 101 <> 0 AND (o_orderkey % 89 = 0 OR o_orderkey % 83 = 0 OR o_orderkey % 79 = 0)")
def set_changed(t: Tables):
    return reconcile.changed(t.orders, stored_orders(t), ["o_orderkey"], COMPARED)


@query(
    "idempotent_append",
    """
SELECT o_orderkey AS operation, CASE WHEN o_orderkey % 5 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS copies,
  CASE WHEN o_orderkey % 35 = 0 THEN 'conflict' WHEN o_orderkey % 2 = 1 THEN 'append' WHEN o_orderkey % 22 = 0 THEN 'conflict' ELSE 'replayed' END AS outcome FROM orders
""",
)
def idempotent_append(t: Tables):
    key = F.col("o_orderkey")
    content = F.sha2(F.concat_ws("\x1f", key, "o_custkey", "o_orderstatus"), 256)
    stored = t.orders.filter(key % 2 == 0).select(
        key.alias("operation"), F.when(key % 22 == 0, "older").otherwise(content).alias("content")
    )
    once = t.orders.select(key.alias("operation"), content.alias("content"))
    again = t.orders.filter(key % 5 == 0).select(
        key.alias("operation"), F.when(key % 7 == 0, "altered").otherwise(content).alias("content")
    )
    return reconcile.idempotent_append(stored, once.unionByName(again), "operation", "content")


@query(
    "duplicate_keys",
    "SELECT md5(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(t: Tables):
    hashed = t.documents.select("doc_id", F.md5("text").alias("content"))
    return reconcile.duplicates(hashed, ["content"], "doc_id")


@query(
    "table_digest",
    """SELECT count(*) AS rows, bit_xor(o_orderkey * 31 + o_custkey) AS key_xor, CAST(sum(o_orderkey * 31 + o_custkey) AS BIGINT) AS key_sum, TRUE AS reordered_copy_equal FROM orders""",
)
def table_digest(t: Tables):
    mixed = F.col("o_orderkey") * 31 + F.col("o_custkey")
    keys = t.orders.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(mixed).alias("key_xor"), F.sum(mixed).alias("key_sum"))
    columns = t.orders.columns
    evidence = lambda df: df.agg(F.to_json(F.struct(*reconcile.digest_columns(columns)))).scalar()
    return keys.withColumn("reordered_copy_equal", evidence(t.orders) == evidence(t.orders.repartition("o_custkey")))


@query(
    "selector_coverage",
    """
WITH s AS (SELECT event_type AS selector, CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN 'failed' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'omitted' ELSE 'indexed' END AS st FROM events)
SELECT selector, count(*) AS expected, count(*) FILTER (st = 'indexed') AS indexed, count(*) FILTER (st = 'omitted') AS omitted, count(*) FILTER (st = 'failed') AS failed,
  CASE WHEN count(*) = count(*) FILTER (st = 'indexed') THEN 'ready' ELSE 'pending' END AS state FROM s GROUP BY selector
""",
)
def selector_coverage(t: Tables):
    kind, key = F.col("event_type"), F.col("event_id")
    state = F.when((kind == "view") & (key % 50 == 0), "failed").when((kind == "error") & (key % 9 == 0), "omitted").otherwise("indexed")
    return reconcile.selector_readiness(t.events.select(kind.alias("selector"), state.alias("outcome")), "selector", "outcome")


BASELINE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


@query(
    "baseline_check",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS source, count(*) AS found FROM {name}" for name in BASELINE_TABLES)
    + """),
r AS (SELECT source, found + CASE source WHEN 'orders' THEN 1 ELSE 0 END AS recorded FROM f WHERE source <> 'part' UNION ALL SELECT 'returns', 7)
SELECT source, found, recorded, CASE WHEN found IS NULL THEN 'source_missing' WHEN recorded IS NULL THEN 'source_unknown' WHEN source IN ('events', 'pages') THEN 'schema_differs'
  WHEN found <> recorded THEN 'count_differs' ELSE 'equal' END AS verdict FROM f FULL JOIN r USING (source)
""",
)
def baseline_check(t: Tables):
    """Tables against a record of them in which counts, schemas and names have changed."""
    now = was = None
    for name in BASELINE_TABLES:
        table = t.read(name)
        before = table.withColumnRenamed("props", "properties") if name == "events" else table
        before = before.withColumn("page_id", F.col("page_id").cast("string")) if name == "pages" else before
        before = before.select(*reversed(before.columns))  # the order of columns is none of the schema
        rows = table.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"))
        one, other = (rows.withColumn("schema_digest", F.lit(exports.schema_digest(x))) for x in (table, before))
        now = one if now is None else now.unionByName(one)
        was = other if was is None else was.unionByName(other)
    was = was.filter("source <> 'part'").withColumn("rows", F.col("rows") + F.when(F.col("source") == "orders", 1).otherwise(0))
    was = was.unionByName(t.spark.createDataFrame([("returns", 7, "0")], "source string, rows bigint, schema_digest string"))
    return reconcile.baseline(now, was, "source")


@query(
    "load_metrics",
    q.with_(
        q.OBS,
        """SELECT count(DISTINCT owner) AS entities, (SELECT count(*) FROM (SELECT owner FROM obs GROUP BY owner HAVING count(DISTINCT source) > 1)) AS intersection_records,
  (SELECT count(*) FROM (SELECT DISTINCT owner, item FROM obs)) AS items, count(*) AS observations FROM obs""",
    ),
)
def load_metrics(t: Tables):
    per_item = t.obs.groupBy("owner", "item").agg(
        F.count(F.lit(1)).alias("n"), F.min("source").alias("low"), F.max("source").alias("high")
    )
    per_owner = per_item.groupBy("owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return per_owner.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("low") != F.col("high")).alias("intersection_records"),
        F.sum("items").alias("items"),
        F.sum("n").alias("observations"),
    )


@query(
    "registry_stats",
    q.with_(
        q.OBS,
        """SELECT (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM supplier) AS companies, (SELECT count(*) FROM (SELECT DISTINCT owner, item FROM obs)) AS items,
  count(*) AS observations, count(*) FILTER (status = 'pending') AS pending FROM obs""",
    ),
)
def registry_stats(t: Tables):
    counted = lambda df: df.agg(F.count(F.lit(1))).scalar()
    totals = t.obs.agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("status") == "pending").alias("pending"))
    return totals.withColumns(
        {
            "people": counted(t.customer),
            "companies": counted(t.supplier),
            "items": counted(t.obs.select("owner", "item").distinct()),
        }
    )


@query(
    "source_allowlist",
    """SELECT doc_id, source, CASE WHEN CAST(substr(source, 4) AS INTEGER) > 17 THEN 'unknown_source' WHEN CAST(substr(source, 4) AS INTEGER) % 6 = 1 THEN 'inactive_source' ELSE 'allowed' END AS verdict FROM documents""",
)
def source_allowlist(t: Tables):
    number = F.substring("source", 4, 10).try_cast("int")
    known = t.documents.select("source").distinct().filter(number <= 17).withColumn("active", number % 6 != 1)
    return reconcile.allowed_sources(t.documents.select("doc_id", "source"), known, "source")


@query(
    "outbox_latest",
    q.with_(
        q.OBS,
        """, n AS (SELECT owner, max(version) AS latest FROM obs WHERE version <= 60 GROUP BY owner)
SELECT o.id, o.owner, o.version, n.latest, coalesce(n.latest < o.version, TRUE) AS source_behind FROM obs o LEFT JOIN n USING (owner)""",
    ),
)
def outbox_latest(t: Tables):
    return reconcile.latest_for_events(t.obs.select("id", "owner", "version"), t.obs.filter(F.col("version") <= 60), "owner")


@query(
    "index_freshness",
    q.with_(
        q.OBS,
        """, h AS (SELECT owner, max(version) AS indexed_version FROM obs WHERE item <> 'view' GROUP BY owner), n AS (SELECT owner, max(version) AS canonical_version FROM obs GROUP BY owner)
SELECT owner, indexed_version, canonical_version, indexed_version IS DISTINCT FROM canonical_version AS indexing_pending FROM h LEFT JOIN n USING (owner)""",
    ),
)
def index_freshness(t: Tables):
    hits = t.obs.filter(F.col("item") != "view").groupBy("owner").agg(F.max("version").alias("indexed_version"))
    return reconcile.freshness(hits, t.obs, "owner")


PUBLISH = q.CURRENT + """,
target AS (SELECT owner, item, CASE WHEN id % 5 = 0 THEN version + 1 WHEN id % 5 = 1 THEN version - 1 ELSE version END AS tv,
  CASE WHEN id % 5 = 2 THEN 'other' ELSE CAST(id AS VARCHAR) END AS tc FROM value_state WHERE id % 7 <> 0)"""


@query(
    "publish_guard",
    q.with_(
        PUBLISH,
        """SELECT s.owner || '/' || s.item AS entity, s.version, CAST(s.id AS VARCHAR) AS content, CASE WHEN s.version = tv THEN CASE WHEN tc = CAST(s.id AS VARCHAR) THEN 'already_indexed' ELSE 'conflict' END
  WHEN s.version < tv OR s.version < max(s.version) OVER (PARTITION BY s.owner, s.item) THEN 'obsolete' ELSE 'indexed' END AS decision
  FROM decided s LEFT JOIN target t ON t.owner = s.owner AND t.item = s.item WHERE s.applied""",
    ),
)
def publish_guard(t: Tables):
    entity, ident = F.concat_ws("/", F.col("owner").cast("string"), "item"), F.col("id")
    projected = t.decided.filter(F.col("applied")).select(entity.alias("entity"), "version", ident.cast("string").alias("content"))
    shifted = F.when(ident % 5 == 0, F.col("version") + 1).when(ident % 5 == 1, F.col("version") - 1).otherwise(F.col("version"))
    target = t.value_state.filter(ident % 7 != 0).select(
        entity.alias("entity"), shifted.alias("version"), F.when(ident % 5 == 2, "other").otherwise(ident.cast("string")).alias("content")
    )
    return reconcile.publish_decisions(projected, target, "entity")


@query(
    "flag_target_check",
    q.with_(
        q.FLAGOBS,
        """, r AS (SELECT id AS request, owner, item, path, flag, CASE WHEN id % 6 = 0 THEN '' WHEN id % 6 = 1 THEN 'checked by hand' END AS reason,
   CASE WHEN id % 10 = 0 THEN id + 100000000 WHEN id % 10 < 5 THEN id ELSE (SELECT min(o.id) FROM obs o WHERE o.owner = f.owner AND o.item = 'purchase') END AS target_id FROM flagobs f)
SELECT r.request, r.target_id, CASE WHEN o.id IS NULL THEN 'target_missing' WHEN NOT (o.owner = r.owner AND o.item = r.item AND o.path = r.path) THEN 'target_of_other_field'
   WHEN flag = FALSE AND coalesce(reason, '') = '' THEN 'invalid_needs_reason' END AS error FROM r LEFT JOIN obs o ON o.id = r.target_id""",
    ),
)
def flag_target_check(t: Tables):
    ident = F.col("id")
    first = t.obs.filter(F.col("item") == "purchase").groupBy("owner").agg(F.min("id").alias("first_id"))
    target = F.when(ident % 10 == 0, ident + 100000000).when(ident % 10 < 5, ident).otherwise(F.col("first_id"))
    requests = t.flagobs.join(first, "owner", "left").select(
        ident.alias("request"), "owner", "item", "path", "flag",
        F.when(ident % 6 == 0, "").when(ident % 6 == 1, "checked by hand").alias("reason"), target.alias("target_id"),
    )
    return reconcile.check_flag_targets(requests, t.obs).select("request", "target_id", "error")


@query(
    "conditional_append",
    q.with_(
        q.CURRENT,
        """, now AS (SELECT owner, max(version) AS v FROM obs GROUP BY owner),
r AS (SELECT o.id AS request, o.owner, CASE WHEN o.id % 9 = 0 THEN 'relationship' ELSE o.item END AS item, o.path, n.v - CASE WHEN o.id % 4 = 0 THEN 1 ELSE 0 END AS expected_version FROM obs o JOIN now n USING (owner) WHERE o.source = 2),
e AS (SELECT r.*, CASE WHEN r.expected_version <> n.v THEN 'version_conflict' WHEN s.owner IS NULL THEN 'field_missing' END AS error
  FROM r JOIN now n USING (owner) LEFT JOIN value_state s ON s.owner = r.owner AND s.item = r.item AND s.path = r.path),
w AS (SELECT owner, min(request) AS winner FROM e WHERE error IS NULL GROUP BY owner)
SELECT request, e.owner, expected_version, CASE WHEN error IS NULL AND request <> winner THEN 'version_conflict' ELSE error END AS error, error IS NULL AND request = winner AS accepted
FROM e LEFT JOIN w ON w.owner = e.owner""",
    ),
)
def conditional_append(t: Tables):
    newest = t.obs.groupBy("owner").agg(F.max("version").alias("v"))
    requests = t.obs.filter(F.col("source") == 2).join(newest, "owner").select(
        F.col("id").alias("request"), "owner", F.when(F.col("id") % 9 == 0, "relationship").otherwise(F.col("item")).alias("item"), "path",
        (F.col("v") - F.when(F.col("id") % 4 == 0, 1).otherwise(0)).alias("expected_version"),
    )
    return reconcile.conditional_append(requests, t.obs, t.value_state).select(
        "request", "owner", "expected_version", "error", "accepted"
    )
