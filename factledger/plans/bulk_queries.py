"""Bulk lists, selections, exports and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factledger.functions import contact, text
from factledger.operators import bulk, filters, flatten, imports, mapping, reconcile
from factledger.plans import sqltext as q
from factledger.plans.load_queries import FACTS, fact_table, leaf_table
from factledger.plans.registry import query
from factledger.plans.tables import Tables
from factledger.sources import exports, lists
from factledger.workspace import new_path, pin


def name_entries(t: Tables) -> DataFrame:
    """A list of names: all nations and regions, spelled to hit, miss or be blank."""
    nations = t.nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("input_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("no such "), "n_name"))
        .when(F.col("n_nationkey") % 7 == 0, "  ")
        .when(F.col("n_nationkey") % 11 == 0, "")
        .otherwise(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")))
        .alias("value"),
    )
    again = t.region.select(
        F.concat(F.lit("r"), "r_regionkey").alias("input_id"), F.lit("customer#000000001").alias("value")
    )
    return bulk.with_errors(nations.unionByName(again).withColumn("mode", F.lit("eq")))


ENTRIES = """
entry AS (SELECT 'n' || n_nationkey AS input_id, CASE WHEN n_nationkey % 5 = 0 THEN 'no such ' || n_name WHEN n_nationkey % 7 = 0 THEN '  ' WHEN n_nationkey % 11 = 0 THEN ''
   ELSE 'CUSTOMER#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') END AS value FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'customer#000000001' FROM region),
checked AS (SELECT *, CASE WHEN value = '' THEN 'empty_entry' END AS error FROM entry),
link AS (SELECT input_id, c_custkey FROM checked JOIN customer ON lower(c_name) = lower(value) WHERE error IS NULL)"""


def name_links(t: Tables) -> DataFrame:
    return bulk.match_equal(name_entries(t), t.customer, "c_custkey", "c_name")


@query("bulk_match_eq", q.with_(ENTRIES, "SELECT input_id, c_custkey FROM link"))
def bulk_match_eq(t: Tables):
    return name_links(t)


@query(
    "bulk_entry_status",
    q.with_(
        ENTRIES,
        """, n AS (SELECT input_id, count(*) AS found FROM link GROUP BY input_id)
SELECT c.input_id, c.value, c.error, coalesce(n.found, 0) AS found,
   CASE WHEN error IS NOT NULL THEN 'invalid' WHEN n.found > 0 THEN 'found' ELSE 'not_found' END AS state FROM checked c LEFT JOIN n USING (input_id)""",
    ),
)
def bulk_entry_status(t: Tables):
    return bulk.entry_status(name_entries(t), name_links(t)).select("input_id", "value", "error", "found", "state")


@query(
    "bulk_selection",
    q.with_(ENTRIES, "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT c_custkey FROM link)"),
)
def bulk_selection(t: Tables):
    return bulk.selection(t.customer, name_links(t), "c_custkey", F.col("c_acctbal") > 0).select("c_custkey", "c_name")


def word_entries(t: Tables) -> DataFrame:
    """One entry per distinct word of the catalogue of names, plus edge cases."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("value")).unionByName(
        t.nation.select(F.substring("n_name", 1, 3).alias("value"))
    )
    more = t.region.select(F.element_at(F.array(*[F.lit(w) for w in ("Ouê", "the of", "en", "tion", "ÇRÉO")]), (F.col("r_regionkey") + 1)).alias("value"))
    entries = words.unionByName(more).distinct().select(F.concat(F.lit("w:"), "value").alias("input_id"), "value")
    return bulk.with_errors(entries.withColumn("mode", F.lit("contains")))


@query(
    "bulk_match_contains",
    """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part UNION SELECT substr(n_name, 1, 3) FROM nation
  UNION SELECT unnest(['Ouê', 'the of', 'en', 'tion', 'ÇRÉO'])),
e AS (SELECT 'w:' || value AS input_id, strip_accents(lower(value)) AS folded FROM w WHERE length(value) >= 3),
d AS (SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS folded FROM documents)
SELECT input_id, doc_id FROM e JOIN d ON contains(d.folded, e.folded)
""",
)
def bulk_match_contains(t: Tables):
    return bulk.match_contains(word_entries(t), t.spread("documents"), "doc_id", "text")


@query(
    "bulk_match_prefix",
    """
WITH e AS (SELECT 's' || s_suppkey AS input_id, 'CUSTOMER#' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS value FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, substr(n_name, 1, 1) FROM nation)
SELECT input_id, c_custkey FROM e JOIN customer ON starts_with(lower(c_name), lower(value))
""",
)
def bulk_match_prefix(t: Tables):
    """Prefixes of names, from one letter to all but two."""
    heads = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("input_id"),
        F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("value"),
    )
    letters = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("input_id"), F.substring("n_name", 1, 1).alias("value"))
    entries = bulk.with_errors(heads.unionByName(letters).withColumn("mode", F.lit("prefix")))
    return bulk.match_prefix(entries, t.customer, "c_custkey", "c_name")


@query(
    "bulk_match_document",
    """
SELECT 's' || s_suppkey AS input_id, c_custkey, CASE WHEN s_suppkey % 4 = 0 THEN 'document_invalid' END AS error
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 3 AND s_suppkey % 4 <> 0
""",
)
def bulk_match_document(t: Tables):
    """Punctuated numbers; every fourth claims a type whose check digits it lacks."""
    digits = lambda c: F.lpad(c.cast("string"), 9, "0")
    asked = digits(F.col("s_suppkey") * 3)
    entries = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("input_id"),
        F.when(F.col("s_suppkey") % 4 == 0, "CPF").otherwise("OTHER").alias("document_type"),
        F.concat(F.substring(asked, 1, 3), F.lit("."), F.substring(asked, 4, 6)).alias("value"),
    )
    stored = t.customer.select("c_custkey", F.lit("OTHER").alias("kind"), F.concat(digits(F.col("c_custkey")), F.lit(" ")).alias("number"))
    checked = bulk.with_document_errors(entries)
    links = bulk.match_document(checked, stored, "c_custkey", "kind", "number")
    return checked.select("input_id", "error").join(links, "input_id", "left")


# Filters that entries refer to by name.
ENTRY_FILTERS = {
    "people": {"and": [{"field": "segment", "op": "in", "value": ["BUILDING", "MACHINERY"]}, {"field": "nation", "op": "range", "value": [5, 15.5]}]},
    "orders": {"item": {"and": [{"field": "status", "value": "F"}, {"field": "price", "op": "range", "value": [200000, None]}]}},
    "either": {
        "or": [
            {"item": {"or": [{"field": "status", "value": "P"}, {"field": "price", "op": "range", "value": [None, 2000]}]}},
            {"and": [{"field": "gift", "op": "exists", "value": False}, {"field": "name", "op": "contains", "value": "é Cus"}]},
        ]
    },
}


def entity_values(t: Tables) -> DataFrame:
    """Customers' own fields and those of their orders, one row per value."""

    def row(field: str, value, json_type: str):
        text = value.cast("string")
        return F.struct(F.lit(field).alias("field"), text.alias("value"), F.lit(json_type).alias("json_type"))

    key = F.col("c_custkey")
    own = F.array(
        row("segment", F.col("c_mktsegment"), "text"),
        row("nation", F.col("c_nationkey"), "integer"),
        row("name", F.concat(F.when(key % 2 == 0, "é ").otherwise("x "), "c_name"), "text"),
        row("gift", F.when(key % 3 == 0, key), "integer"),
    )
    people = t.customer.select("c_custkey", F.lit(None).cast("long").alias("item"), F.inline(own)).filter("value IS NOT NULL")
    price = F.col("o_totalprice").cast("decimal(20,2)")
    parts = F.array(row("status", F.col("o_orderstatus"), "text"), row("price", price, "decimal"))
    bought = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("item"), F.inline(parts))
    every = people.unionByName(bought)
    raw = F.when(F.col("json_type") == "text", F.to_json(F.struct(F.col("value").alias("v")))).otherwise(F.concat(F.lit('{"v":'), "value", F.lit("}")))
    digest = flatten.flatten_json(every.withColumn("row", F.struct("c_custkey", "item", "field")).withColumn("raw", raw), "row", "raw", digests=True)
    marked = digest.filter("source_path = '/v'").select("row.*", "value", "json_type", "digest")
    return marked.withColumn("folded", text.fold(F.when(F.col("json_type") == "text", F.col("value"))))


@query(
    "bulk_match_filtered",
    """
WITH e AS (SELECT 'n' || n_nationkey AS input_id, lower('CUSTOMER#00000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')) AS head, n_nationkey % 4 AS style FROM nation),
l AS (SELECT input_id, style, c.* FROM e JOIN customer c ON starts_with(lower(c_name), head))
SELECT input_id, c_custkey FROM l WHERE style = 0
  OR (style = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey BETWEEN 5 AND 15)
  OR (style = 2 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND CAST(o_totalprice AS DECIMAL(20,2)) >= 200000))
  OR (style = 3 AND (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR CAST(o_totalprice AS DECIMAL(20,2)) <= 2000))
     OR (c_custkey % 3 <> 0 AND c_custkey % 2 = 0)))
""",
)
def bulk_match_filtered(t: Tables):
    """Entries with a filter each, given as rows; every fourth entry has none."""
    digits = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    entries = t.nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("input_id"),
        F.concat(F.lit("CUSTOMER#00000"), digits).alias("value"),
        F.element_at(F.array(F.lit("none"), *[F.lit(name) for name in ENTRY_FILTERS]), F.col("n_nationkey") % 4 + 1).alias("filter_id"),
    )
    checked = bulk.with_errors(entries.withColumn("mode", F.lit("prefix")))
    links = bulk.match_prefix(checked, t.customer, "c_custkey", "c_name")
    nodes = entries.select("input_id", "filter_id").join(F.broadcast(filters.filter_table(t.spark, ENTRY_FILTERS)), "filter_id")
    return filters.passing(links, nodes.drop("filter_id"), entity_values(t), "c_custkey")


@query(
    "bulk_match_phone",
    """
SELECT 's' || s_suppkey AS input_id, c_custkey FROM supplier JOIN customer ON c_custkey = s_suppkey * 2
""",
)
def bulk_match_phone(t: Tables):
    """Phone numbers in several spellings; numbers the rules leave for review match as written."""
    asked = F.lpad((F.col("s_suppkey") * 2).cast("string"), 7, "0")
    style = F.col("s_suppkey") % 3
    spelled = (
        F.when(style == 0, F.concat(F.lit("(11) 3"), F.substring(asked, 1, 3), F.lit("-"), F.substring(asked, 4, 4)))
        .when(style == 1, F.concat(F.lit("+55 11 3"), asked))
        .otherwise(F.concat(F.lit("tel:11 3"), asked))
    )
    entries = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("input_id"), spelled.alias("value"), F.when(style != 1, "BR").alias("country")
    )
    stored = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    have = t.customer.select("c_custkey", F.concat(F.lit("+55 (11) 3"), stored).alias("raw"), F.lit("br").alias("country"))
    checked = bulk.with_errors(entries.withColumn("mode", F.lit("eq")))
    return bulk.match_phone(checked, have, "c_custkey", contact.rollout_table(t.spark))


@query(
    "entry_list_scan",
    """
WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '["\\r]', '', 'g'), '[,\\n]'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM documents)
SELECT doc_id, CAST(unnest(range(1, len(cells) + 1)) AS VARCHAR) AS input_id, unnest(cells) AS value FROM l
""",
)
def entry_list_scan(t: Tables):
    pasted = t.spread("documents").select("doc_id", F.regexp_replace("text", '["\\r]', "").alias("list"))
    return lists.list_entries(pasted, "doc_id", "list")


@query(
    "inventory_map",
    q.with_(
        FACTS,
        """, inv AS (SELECT DISTINCT 'orders' AS source_id, base_field AS field, json_type AS type FROM leaves UNION ALL SELECT DISTINCT 'events', '/' || event_type || '/email', 'text' FROM events)
SELECT source_id, field, type, CASE field WHEN '/id' THEN 'identity.number' WHEN '/status' THEN 'identity.state' ELSE
  CASE WHEN regexp_matches(upper(field), 'PHONE|EMAIL') THEN 'custom.original_contact' ELSE 'custom.original_field' END END AS target,
  CASE WHEN field IN ('/id', '/status') THEN 'mapped' WHEN regexp_matches(upper(field), 'PHONE|EMAIL') THEN 'pending_contact_parse' ELSE 'pending_mapping' END AS status FROM inv""",
    ),
)
def inventory_map(t: Tables):
    leaves = leaf_table(t).select(F.lit("orders").alias("source_id"), F.col("base_field").alias("field"), F.col("json_type").alias("type"))
    events = t.events.select(F.lit("events").alias("source_id"), F.concat(F.lit("/"), "event_type", F.lit("/email")).alias("field"), F.lit("text").alias("type"))
    path = new_path(t.spark, "inventory")
    leaves.distinct().unionByName(events.distinct()).write.csv(path, header=True)
    known = t.spark.createDataFrame(
        [("/id", "identity.number", "mapped"), ("/status", "identity.state", "mapped")], "field string, target string, status string"
    )
    contact = F.upper("field").rlike("PHONE|EMAIL")
    mapped = lists.map_inventory(lists.read_inventory(t.spark, path), known, contact, ("custom.original_field", "pending_mapping"))
    return mapped.select("source_id", "field", "type", "target", "status")


@query(
    "import_row_results",
    """
SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'bad_record' WHEN value < 1 THEN 'bad_value' WHEN event_type = 'error' THEN 'source_not_allowed' END AS error_code,
  CASE WHEN event_id % 10 = 3 OR value < 1 OR event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM events
""",
)
def import_row_results(t: Tables):
    record = F.when(F.col("event_id") % 10 != 3, F.col("props")).otherwise(F.lit('{"k": '))
    rows = t.events.select("event_id", "event_type", "value", record.alias("record"))
    judged = imports.judge_rows(
        rows,
        {
            "bad_record": F.try_parse_json("record").isNotNull(),
            "bad_value": F.col("value") >= 1,
            "source_not_allowed": F.col("event_type") != "error",
        },
    )
    return judged.select("event_id", "error_code", "status")


@query(
    "job_progress",
    """
WITH r AS (SELECT event_type AS job, CASE WHEN event_id % 10 = 9 THEN 'not_processed' WHEN value < 1 THEN 'failed' ELSE 'succeeded' END AS status FROM events)
SELECT job, count(*) AS total, count(*) FILTER (status <> 'not_processed') AS processed, count(*) FILTER (status = 'succeeded') AS succeeded,
  count(*) FILTER (status = 'failed') AS failed, 100 * count(*) FILTER (status <> 'not_processed') // count(*) AS percent FROM r GROUP BY job
""",
)
def job_progress(t: Tables):
    status = F.when(F.col("event_id") % 10 == 9, "not_processed").when(F.col("value") < 1, "failed").otherwise("succeeded")
    return reconcile.progress(t.events.select(F.col("event_type").alias("job"), status.alias("status")), "job")


@query(
    "job_results",
    """SELECT event_id, event_type AS job, CASE WHEN event_id % 10 = 9 THEN 'not_processed' WHEN value < 1 THEN 'failed' ELSE 'succeeded' END AS status FROM events""",
)
def job_results(t: Tables):
    entries = t.events.select("event_id", F.col("event_type").alias("job"))
    done = t.events.filter(F.col("event_id") % 10 != 9)
    results = done.select("event_id", F.when(F.col("value") < 1, "failed").otherwise("succeeded").alias("status"))
    return reconcile.results_with_defaults(entries, results, ["event_id"])


# ---- exports --------------------------------------------------------------------


@query(
    "export_volumes",
    """SELECT c_custkey, ordinal, (ordinal - 1) // 400 + 1 AS volume FROM
(SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS ordinal FROM customer)""",
)
def export_volumes(t: Tables):
    order = [F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), F.col("c_custkey").asc()]
    volumes = exports.with_volume(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), order, size=400)
    return volumes.select("c_custkey", "ordinal", "volume")


def exported(t: Tables) -> dict:
    """Three tables of an export: rows, id column, order."""
    people = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    bought = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return {
        "people": (people, "c_custkey", [F.col("c_custkey").asc()]),
        "bought": (bought, "o_custkey", [F.col("o_orderkey").desc()]),
        "parts": (t.part.select("p_partkey", "p_name", "p_size"), "p_partkey", [F.col("p_name").asc(), F.col("p_partkey").asc()]),
    }


def _marks(*columns: str) -> str:
    """60 bits of a row's digest, as the export spells the row."""
    texts = [f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns]
    return f"CAST('0x' || substr(sha256({' || '.join(texts)}), 1, 15) AS BIGINT)"


EXPORT = f"""
row AS (
  SELECT 'people' AS tab, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 + 1 AS volume, c_custkey AS id, {_marks('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment')} AS mark FROM customer
  UNION ALL SELECT 'bought', (row_number() OVER (ORDER BY o_orderkey DESC) - 1) // 400 + 1, o_custkey,
    {_marks('o_orderkey', 'o_custkey', 'o_orderstatus', "strftime(o_orderdate, '%Y-%m-%d')")} FROM orders
  UNION ALL SELECT 'parts', (row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 400 + 1, p_partkey, {_marks('p_partkey', 'p_name', 'p_size')} FROM part),
vol AS (SELECT tab, volume, count(*) AS rows, count(DISTINCT id) AS ids, CAST(sum(mark) AS VARCHAR) AS "sum", bit_xor(mark) AS mix FROM row GROUP BY tab, volume),
volm AS (SELECT *, {_marks('tab', 'volume', 'rows', 'ids', '"sum"', 'mix')} AS mark FROM vol),
tab AS (SELECT tab, CAST(NULL AS BIGINT) AS volume, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(ids) AS BIGINT) AS ids, CAST(sum(mark) AS VARCHAR) AS "sum", bit_xor(mark) AS mix FROM volm GROUP BY tab),
tabm AS (SELECT *, {_marks('tab', 'volume', 'rows', 'ids', '"sum"', 'mix')} AS mark FROM tab),
manifest AS (SELECT 'volume' AS level, tab, volume, rows, ids, "sum", mix FROM vol UNION ALL SELECT 'table', * FROM tab
  UNION ALL SELECT 'export', '', NULL, CAST(sum(rows) AS BIGINT), CAST(sum(ids) AS BIGINT), CAST(sum(mark) AS VARCHAR), bit_xor(mark) FROM tabm)"""


@query("export_manifest", q.with_(EXPORT, 'SELECT level, tab AS "table", volume, rows, ids, "sum", mix FROM manifest'))
def export_manifest(t: Tables):
    """Every table, volume and the whole of an export with rows, ids and digest."""
    path = new_path(t.spark, "export")
    exports.write_export(exported(t), path, volume_rows=400)
    return exports.read_manifest(t.spark, path)


@query(
    "export_tampered",
    q.with_(
        EXPORT,
        """SELECT level, tab AS "table", volume, rows, ids, NOT (level = 'export' OR (tab = 'bought' AND (level = 'table' OR volume = 2))) AS matches FROM manifest""",
    ),
)
def export_tampered(t: Tables):
    """A changed row of one volume shows there, in its table and in the export, and nowhere else."""
    path, tables = new_path(t.spark, "export"), exported(t)
    exports.write_export(tables, path, volume_rows=400)
    known = {name: (rows, ident) for name, (rows, ident, _) in tables.items()}
    second = exports.read_volumes(known["bought"][0], path, "bought", 2).drop("volume")
    least = second.agg(F.min("ordinal")).first()[0]
    changed = second.withColumn("o_orderstatus", F.when(F.col("ordinal") == least, "?").otherwise(F.col("o_orderstatus")))
    pin(changed, "changed").write.mode("overwrite").parquet(f"{path}/bought/volume=2")
    return exports.check_export(known, path)


def keyed_facts(t: Tables) -> DataFrame:
    facts = fact_table(t)
    return facts.withColumns(
        {"key": mapping.last_step(F.col("base_field")), "item": mapping.parent_path(F.col("source_path"))}
    )


@query(
    "export_kind_tables",
    q.with_(
        FACTS,
        """, cell AS (SELECT record, target_kind AS kind, regexp_extract(base_field, '[^/]*$') AS key, regexp_replace(source_path, '/[^/]*$', '') AS item, value FROM facts),
col AS (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key) AS number FROM (SELECT DISTINCT kind, key FROM cell))
SELECT record, item, kind, (number - 1) // 2 + 1 AS sheet, (number - 1) % 2 + 1 AS place, max(value) AS value FROM cell JOIN col USING (kind, key) GROUP BY ALL""",
    ),
)
def export_kind_tables(t: Tables):
    """The sheets of every kind, two columns each, written with the table of their columns."""
    cells, columns = exports.kind_cells(keyed_facts(t), ["record", "item"], width=2)
    path = new_path(t.spark, "sheets")
    exports.write_tables({"cells": cells, "columns": columns}, path)
    return t.spark.read.schema(cells.schema).parquet(f"{path}/cells")


@query(
    "history_append",
    q.with_(q.OBS, "SELECT count(*) AS rows, count(DISTINCT owner) AS owners, CAST(0 AS BIGINT) AS misplaced FROM obs"),
)
def history_append(t: Tables):
    path = new_path(t.spark, "history")
    half = F.col("id") % 2 == 0
    exports.append_history(t.obs.filter(half), path)
    exports.append_history(t.obs.filter(~half), path)
    schema = StructType([*t.obs.schema.fields, StructField("bucket", IntegerType())])
    stored = exports.read_history(t.spark, path, schema)
    return stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("owner").alias("owners"),
        F.count_if(F.col("bucket") != exports.owner_bucket(F.col("owner"))).alias("misplaced"),
    )


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(
    "source_pin",
    "SELECT unnest(["
    + ", ".join(f"'{name}.parquet'" for name in GIVEN)
    + """]) AS file_name, 'unchanged' AS status
UNION ALL SELECT * FROM (VALUES ('own/same/part.csv', 'unchanged'), ('own/edited/part.json', 'changed'), ('own/gone/part.csv', 'missing'), ('own/added/part.txt', 'new'))""",
)
def source_pin(t: Tables):
    """All given files, and files of other formats of which one changed, one is gone and one is new."""
    single = F.regexp_replace("file_name", r"part-[^.]*(\.c000)?(?=\.)", "part")
    before, after = new_path(t.spark, "source"), new_path(t.spark, "source")
    nation, region = t.nation.coalesce(1), t.region.coalesce(1)
    for folder in (before, after):
        nation.orderBy("n_nationkey").coalesce(1).write.csv(f"{folder}/own/same")
    nation.write.json(f"{before}/own/edited")
    nation.withColumn("n_name", F.concat("n_name", F.lit("!"))).write.json(f"{after}/own/edited")
    region.write.csv(f"{before}/own/gone")
    region.select("r_name").write.text(f"{after}/own/added")
    given = pin(exports.file_pins(t.spark, t.sf_dir, chunk_bytes=1 << 20), "pins").filter(F.col("file_name").endswith(".parquet"))
    again = exports.file_pins(t.spark, t.sf_dir, chunk_bytes=1 << 20).filter(F.col("file_name").endswith(".parquet"))
    was, now = (exports.file_pins(t.spark, folder).filter(~F.col("file_name").contains("/_")).withColumn("file_name", single) for folder in (before, after))
    return exports.check_pins(given.unionByName(was), again.unionByName(now)).select("file_name", "status")
