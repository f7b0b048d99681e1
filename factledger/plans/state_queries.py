"""Precedence, current and as-of state, versions, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from factledger.operators import state
from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.tables import Tables

OBS_COLUMNS = "owner, item, path, dimension, id, value, effective, received, status, source, version, seq"
CUT = 40


@query("field_precedence", q.with_(q.DECIDED, f"SELECT {OBS_COLUMNS}, applied, pending_reason FROM decided"))
def field_precedence(t: Tables):
    return state.field_precedence(t.obs)


@query(
    "field_precedence_local",
    q.with_(
        q.RANKED,
        f"""
, s AS (SELECT *, max(CASE WHEN NOT fut THEN k.e END) OVER (PARTITION BY owner, item, path, dimension
        ORDER BY version, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ranked)
SELECT {OBS_COLUMNS}, NOT fut AND (m IS NULL OR k.e >= m) AS applied,
       CASE WHEN fut THEN 'future_timestamp' END AS pending_reason FROM s""",
    ),
)
def field_precedence_local(t: Tables):
    return state.field_precedence_by_date(t.obs)


@query("flag_precedence", q.with_(q.DECIDED_FLAGS, "SELECT * FROM decided_flags"))
def flag_precedence(t: Tables):
    values = t.decided.filter(F.col("item") == "purchase")
    return state.flag_precedence(values, t.flagobs, t.value_binding())


@query(
    "previous_value",
    q.with_(
        q.DECIDED,
        """
SELECT id, applied, last_value(CASE WHEN applied THEN id END IGNORE NULLS) OVER w AS previous_id,
       last_value(CASE WHEN applied THEN value END IGNORE NULLS) OVER w AS previous_value
FROM decided WINDOW w AS (PARTITION BY owner, item, path, dimension ORDER BY version, seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
)
def previous_value(t: Tables):
    return state.previous_applied(t.decided).select("id", "applied", "previous_id", "previous_value")


@query("current_state", q.with_(q.CURRENT, f"SELECT {OBS_COLUMNS} FROM value_state"))
def current_state(t: Tables):
    return state.current_state(state.field_precedence(t.obs))


@query(
    "state_as_of",
    q.with_(
        q.DECIDED,
        f"""SELECT {OBS_COLUMNS} FROM decided WHERE applied AND version <= {CUT}
QUALIFY row_number() OVER (PARTITION BY owner, item, path, dimension ORDER BY version DESC, seq DESC) = 1""",
    ),
)
def state_as_of(t: Tables):
    return state.current_state(t.decided, at_version=CUT)


@query(
    "item_as_of",
    q.with_(
        q.OBS,
        f"""SELECT owner, item, count(DISTINCT version) AS item_version, max(version) AS last_version
FROM obs WHERE version <= {CUT} GROUP BY owner, item""",
    ),
)
def item_as_of(t: Tables):
    return state.item_version_as_of(t.obs, CUT)


@query(
    "version_numbering",
    q.with_(
        q.OBS,
        """SELECT id, owner, item, version, seq,
       dense_rank() OVER (PARTITION BY owner, item ORDER BY version) AS item_version FROM obs""",
    ),
)
def version_numbering(t: Tables):
    numbered = state.number_versions(t.arrivals, ["perm"]).withColumn("seq", F.lit(1).cast("long"))
    pinned = t.staged("version_numbering", lambda: numbered.select("id", "owner", "item", "version", "seq"))
    return state.number_items(pinned)


@query(
    "version_gaps",
    q.with_(
        q.OBS,
        """, kept AS (SELECT owner, version FROM obs WHERE id % 11 <> 0)
SELECT owner, version FROM (SELECT *, coalesce(lag(version) OVER (PARTITION BY owner ORDER BY version), 0) AS p FROM kept)
WHERE version <> p + 1""",
    ),
)
def version_gaps(t: Tables):
    return state.version_gaps(t.obs.filter(F.col("id") % 11 != 0))


@query(
    "flag_applicable",
    q.with_(q.FLAG_STATE, "SELECT owner, item, path, id, flag, binding, applicable FROM flag_state"),
)
def flag_applicable(t: Tables):
    return t.flag_state.select("owner", "item", "path", "id", "flag", "binding", "applicable")


AT = "2024-01-25 00:00:00"


@query(
    "flag_details",
    q.with_(
        q.FLAG_STATE,
        f"""SELECT owner, item, path, id, flag AS last_result, CASE WHEN applicable THEN flag END AS flag_value,
       applicable, received, expires, expires <= TIMESTAMP '{AT}' AS stale, source, CASE WHEN id % 2 = 0 THEN received ELSE effective END AS checked_at,
       CASE WHEN id % 3 = 0 THEN 'call' END AS method, CASE WHEN id % 4 = 0 THEN 'ref' || id END AS reference FROM flag_state""",
    ),
)
def flag_details(t: Tables):
    at = F.lit(AT).cast("timestamp")
    ident = F.col("id")
    shown = t.flag_state.withColumns(
        {
            "checked_at": F.when(ident % 2 == 0, F.col("received")),
            "method": F.when(ident % 3 == 0, "call"),
            "reference": F.when(ident % 4 == 0, F.concat(F.lit("ref"), ident)),
        }
    )
    columns = ["owner", "item", "path", "id", "last_result", "flag_value", "applicable", "received", "expires", "stale"]
    return state.flag_details(shown, at).select(*columns, "source", "checked_at", "method", "reference")


@query(
    "record_view",
    q.with_(
        q.FLAG_STATE,
        """, cells AS (SELECT owner, item, dimension, path, CAST(value AS VARCHAR) AS v FROM value_state
      UNION ALL SELECT owner, item, dimension, path, CASE WHEN applicable THEN CAST(flag AS VARCHAR) END FROM flag_state),
fields AS (SELECT owner, item, string_agg(dimension || '|' || path || '|' || coalesce(v, 'null'), ';' ORDER BY dimension, path) AS txt FROM cells GROUP BY owner, item)
SELECT owner, CAST(1 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS part, string_agg(item || '=' || txt, ',' ORDER BY item) AS record
FROM fields GROUP BY owner""",
    ),
)
def record_view(t: Tables):
    """Values and applicable flags of every item, one document per owner."""
    key = ["owner", "item", "path", "dimension"]
    values = t.value_state.select(*key, F.col("value").cast("string").alias("value"))
    flags = t.flag_state.select(*key, F.when(F.col("applicable"), F.col("flag")).cast("string").alias("value"))
    nested = state.nested_records(values.unionByName(flags))
    spelled = F.transform(
        "items",
        lambda i: F.concat(
            i["item"],
            F.lit("="),
            F.array_join(
                F.transform(
                    i["fields"], lambda f: F.concat_ws("|", f["dimension"], f["path"], F.coalesce(f["value"], F.lit("null")))
                ),
                ";",
            ),
        ),
    )
    return nested.select("owner", "parts", "part", F.array_join(spelled, ",").alias("record"))


@query(
    "late_future_report",
    q.with_(
        q.DECIDED,
        """SELECT coalesce(pending_reason, 'applied') AS outcome, status, count(*) AS observations,
       count(DISTINCT owner) AS owners FROM decided GROUP BY 1, 2""",
    ),
)
def late_future_report(t: Tables):
    return t.decided.groupBy(F.coalesce("pending_reason", F.lit("applied")).alias("outcome"), "status").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("owner").alias("owners")
    )


@query(
    "history_provenance",
    q.with_(
        q.DECIDED,
        """SELECT d.id, d.owner, d.item, d.version, d.applied, c.c_name AS actor, c.c_mktsegment AS segment
FROM decided d JOIN customer c ON c.c_custkey = d.owner""",
    ),
)
def history_provenance(t: Tables):
    operations = t.customer.select(
        F.col("c_custkey").alias("owner"), F.col("c_name").alias("actor"), F.col("c_mktsegment").alias("segment")
    )
    return t.decided.select("id", "owner", "item", "version", "applied").join(operations, "owner")


@query(
    "item_sources",
    q.with_(q.OBS, "SELECT DISTINCT owner, item, source FROM obs"),
)
def item_sources(t: Tables):
    return t.obs.select("owner", "item", "source").distinct()


@query(
    "history_filter",
    q.with_(
        q.OBS,
        """SELECT id, owner, item, path, source, version FROM obs
WHERE item = 'purchase' AND path = 'value' AND dimension = 'value' AND source = 1""",
    ),
)
def history_filter(t: Tables):
    wanted = (F.col("item") == "purchase") & (F.col("path") == "value") & (F.col("dimension") == "value")
    return t.obs.filter(wanted & (F.col("source") == 1)).select("id", "owner", "item", "path", "source", "version")


@query(
    "repeated_target",
    q.with_(
        q.OBS,
        """, ops AS (SELECT owner, version // 5 AS operation, item, path, id FROM obs)
SELECT owner, operation, item, path, count(*) AS facts, min(id) AS first_id FROM ops
GROUP BY owner, operation, item, path HAVING count(*) > 1""",
    ),
)
def repeated_target(t: Tables):
    ops = t.obs.withColumn("operation", F.floor(F.col("version") / 5))
    return (
        ops.groupBy("owner", "operation", "item", "path")
        .agg(F.count(F.lit(1)).alias("facts"), F.min("id").alias("first_id"))
        .filter(F.col("facts") > 1)
    )
