"""SQL spellings of the derived tables, shared by the SQL twins."""

ARRIVALS = """
arrivals AS (
  SELECT user_id AS owner, event_type AS item, 'value' AS path, 'value' AS dimension, event_id AS id, value,
         CASE WHEN event_id % 5 <> 0 THEN ts END AS effective,
         TIMESTAMP '2024-01-10 00:00:00' + to_seconds(((event_id * 1103515245 + 12345) % 2147483647) // 1000) AS received,
         CASE WHEN event_id % 7 = 0 THEN 'pending' ELSE 'mapped' END AS status,
         CAST(event_id % 3 AS INTEGER) AS source,
         (event_id * 1103515245 + 12345) % 2147483647 AS perm
  FROM events)"""

OBS = ARRIVALS + """,
obs AS (
  SELECT * EXCLUDE (perm), row_number() OVER (PARTITION BY owner ORDER BY perm) AS version, CAST(1 AS BIGINT) AS seq
  FROM arrivals)"""

# The rank of an observation as one orderable row value.
RANKED = OBS + """,
ranked AS (
  SELECT *, coalesce(effective > received + INTERVAL 5 MINUTE, FALSE) AS fut, status <> 'pending' AS res,
         {'e': coalesce(effective, TIMESTAMP '0001-01-01 00:00:00'), 'r': received, 'i': id} AS k
  FROM obs)"""

DECIDED = RANKED + """,
scan1 AS (
  SELECT *, max(CASE WHEN NOT fut THEN k END) OVER w AS m, max(CASE WHEN NOT fut AND res THEN k END) OVER w AS mr
  FROM ranked
  WINDOW w AS (PARTITION BY owner, item, path, dimension ORDER BY version, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scan2 AS (
  SELECT *, min(CASE WHEN NOT fut AND res AND (m IS NULL OR k > m) THEN version END)
           OVER (PARTITION BY owner, item, path, dimension) AS first_win
  FROM scan1),
scan3 AS (
  SELECT *, coalesce(version > first_win, FALSE) AS settled FROM scan2),
scan4 AS (
  SELECT *, CASE WHEN settled THEN mr ELSE m END AS cur FROM scan3),
decided AS (
  SELECT owner, item, path, dimension, id, value, effective, received, status, source, version, seq,
         (NOT fut) AND NOT (settled AND NOT res) AND (cur IS NULL OR k > cur) AS applied,
         CASE WHEN settled AND NOT res THEN 'pending_against_resolved'
              WHEN fut THEN 'future_date'
              WHEN cur IS NOT NULL AND effective IS NULL AND cur.e > TIMESTAMP '0001-01-01 00:00:00' THEN 'undated_against_dated'
              WHEN cur IS NOT NULL AND NOT (k > cur) THEN 'older_observation' END AS pending_reason
  FROM scan4)"""

CURRENT = DECIDED + """,
value_state AS (
  SELECT * EXCLUDE (applied, pending_reason) FROM decided WHERE applied
  QUALIFY row_number() OVER (PARTITION BY owner, item, path, dimension ORDER BY version DESC, seq DESC) = 1)"""

FLAGOBS = DECIDED + """,
flagobs AS (
  SELECT owner, 'purchase' AS item, path, 'flag:valid' AS dimension, id,
         CASE WHEN id % 3 = 0 THEN TRUE WHEN id % 3 = 1 THEN FALSE END AS flag, id % 4 AS binding,
         effective, received, received + to_days(CAST(id % 20 AS INTEGER)) AS expires, status, source, version, seq
  FROM obs WHERE item = 'view')"""

DECIDED_FLAGS = FLAGOBS + """,
marks AS (
  SELECT owner, item, path, version, seq, CASE WHEN applied THEN CAST(floor(value) AS BIGINT) % 4 END AS b, CAST(NULL AS BIGINT) AS fid
  FROM decided WHERE item = 'purchase'
  UNION ALL SELECT owner, item, path, version, seq, NULL, id FROM flagobs),
bound AS (
  SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY owner, item, path ORDER BY version, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current_binding FROM marks),
fr AS (
  SELECT f.*, b.current_binding, coalesce(f.binding = b.current_binding, FALSE) AS binding_matches,
         coalesce(f.effective > f.received + INTERVAL 5 MINUTE, FALSE) AS fut, f.status <> 'pending' AS res,
         {'e': coalesce(f.effective, TIMESTAMP '0001-01-01 00:00:00'), 'r': f.received, 'i': f.id} AS k
  FROM flagobs f JOIN bound b ON b.fid = f.id),
f1 AS (
  SELECT *, binding_matches AND NOT fut AS elig,
         max(CASE WHEN binding_matches AND NOT fut THEN k END) OVER w AS m,
         max(CASE WHEN binding_matches AND NOT fut AND res THEN k END) OVER w AS mr
  FROM fr WINDOW w AS (PARTITION BY owner, item, path, dimension ORDER BY version, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (
  SELECT *, min(CASE WHEN elig AND res AND (m IS NULL OR k > m) THEN version END) OVER (PARTITION BY owner, item, path, dimension) AS fw FROM f1),
f3 AS (SELECT *, coalesce(version > fw, FALSE) AS settled FROM f2),
f4 AS (SELECT *, CASE WHEN settled THEN mr ELSE m END AS cur FROM f3),
decided_flags AS (
  SELECT owner, item, path, dimension, id, flag, binding, effective, received, expires, status, source, version, seq,
         current_binding, binding_matches,
         elig AND NOT (settled AND NOT res) AND (cur IS NULL OR k > cur) AS applied,
         CASE WHEN NOT binding_matches THEN 'value_mismatch'
              WHEN settled AND NOT res THEN 'pending_against_resolved'
              WHEN fut THEN 'future_date'
              WHEN cur IS NOT NULL AND effective IS NULL AND cur.e > TIMESTAMP '0001-01-01 00:00:00' THEN 'undated_against_dated'
              WHEN cur IS NOT NULL AND NOT (k > cur) THEN 'older_observation' END AS pending_reason
  FROM f4)"""

FLAG_STATE = DECIDED_FLAGS + """,
value_state AS (
  SELECT * EXCLUDE (applied, pending_reason) FROM decided WHERE applied
  QUALIFY row_number() OVER (PARTITION BY owner, item, path, dimension ORDER BY version DESC, seq DESC) = 1),
flag_last AS (
  SELECT * EXCLUDE (applied, pending_reason, current_binding, binding_matches) FROM decided_flags WHERE applied
  QUALIFY row_number() OVER (PARTITION BY owner, item, path, dimension ORDER BY version DESC, seq DESC) = 1),
flag_state AS (
  SELECT f.*, coalesce(f.binding = CAST(floor(v.value) AS BIGINT) % 4, FALSE) AS applicable
  FROM flag_last f LEFT JOIN value_state v ON v.owner = f.owner AND v.item = f.item AND v.path = f.path)"""

IDREC = """
idrec AS (
  SELECT o_orderkey AS record, 'C' || o_custkey || '.' || (o_orderkey % 4) AS source_key,
         CASE WHEN o_orderkey % 3 <> 0 THEN 'D' || (CAST(round(o_totalprice * 100) AS BIGINT) % 100003) END AS doc_key,
         o_orderkey AS arrival
  FROM orders)"""


def with_(fixture: str, body: str, recursive: bool = False) -> str:
    """One statement from a shared fixture and a query body."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{fixture.strip()}\n{body.strip()}"
