"""Exact identity: lookups, owners, components, assignment, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import identity, relations
from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.tables import Tables


def id_keys(t: Tables) -> DataFrame:
    return identity.key_rows(t.idrec, "record", {"source": F.col("source_key"), "document": F.col("doc_key")})


def registry(t: Tables) -> DataFrame:
    """Identity keys known so far: those first seen on even records."""
    owners = id_keys(t).groupBy("kind", "key").agg(F.min("record").alias("owner"))
    return owners.filter(F.col("owner") % 2 == 0).withColumn("key_hash", identity.key_hash(F.col("kind"), F.col("key")))


REGISTRY = q.IDREC + """,
keys AS (SELECT record, 'source' AS kind, source_key AS key FROM idrec UNION ALL SELECT record, 'document', doc_key FROM idrec WHERE doc_key IS NOT NULL),
registry AS (SELECT kind, key, min(record) AS owner FROM keys GROUP BY kind, key HAVING min(record) % 2 = 0)"""


@query("identity_lookup", q.with_(REGISTRY, "SELECT record, kind, key, owner FROM keys JOIN registry USING (kind, key)"))
def identity_lookup(t: Tables):
    return identity.lookup(id_keys(t), registry(t)).select("record", "kind", "key", "owner")


@query(
    "owner_match",
    q.with_(
        REGISTRY,
        """, usable AS (SELECT * FROM keys WHERE kind = 'source' OR record % 9 <> 0),
hits AS (SELECT record, count(DISTINCT owner) AS n, min(owner) AS owner FROM usable JOIN registry USING (kind, key) GROUP BY record)
SELECT i.record, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'matched' ELSE 'conflict' END AS outcome, CASE WHEN n = 1 THEN h.owner END AS owner
FROM idrec i LEFT JOIN hits h USING (record)""",
    ),
)
def owner_match(t: Tables):
    """Documents of invalidated rows do not identify; source keys always do."""
    usable = id_keys(t).filter((F.col("kind") == "source") | (F.col("record") % 9 != 0))
    return identity.match_owners(t.idrec, identity.lookup(usable, registry(t)), "record")


COMPONENTS = q.IDREC + """,
links AS (
  SELECT a.record AS x, b.m AS y FROM idrec a JOIN (SELECT source_key, min(record) AS m FROM idrec GROUP BY 1) b USING (source_key)
  UNION SELECT a.record, b.m FROM idrec a JOIN (SELECT doc_key, min(record) AS m FROM idrec GROUP BY 1) b USING (doc_key)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(record, seen) AS (SELECT record, record FROM idrec UNION SELECT r.record, b.y FROM reach r JOIN both_ways b ON b.x = r.seen),
comp AS (SELECT record, min(seen) AS component FROM reach GROUP BY record)"""


@query("entity_components", q.with_(COMPONENTS, "SELECT record, component FROM comp", recursive=True))
def entity_components(t: Tables):
    return identity.components(id_keys(t), "record")


ASSIGNED = q.IDREC + """,
firsts AS (SELECT source_key, doc_key AS first_doc, arrival AS first_at FROM idrec
  QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY arrival) = 1),
claimed AS (SELECT first_doc AS doc_key, min(first_at) AS t0 FROM firsts WHERE first_doc IS NOT NULL GROUP BY 1),
wishes AS (SELECT i.source_key, i.doc_key, min(i.arrival) AS moment FROM idrec i JOIN firsts f USING (source_key) LEFT JOIN claimed c ON c.doc_key = i.doc_key
  WHERE f.first_doc IS NULL AND i.doc_key IS NOT NULL GROUP BY i.source_key, i.doc_key, c.t0 HAVING c.t0 IS NULL OR min(i.arrival) < c.t0),
-- every step keeps the pairs that are first at both ends and what they leave over
matching(step, source_key, doc_key, moment, won) AS (
  SELECT 0, source_key, doc_key, moment, FALSE FROM wishes
  UNION ALL
  SELECT step, source_key, doc_key, moment, won FROM (
    SELECT *, bool_or(won) OVER (PARTITION BY source_key) OR bool_or(won) OVER (PARTITION BY doc_key) AS touched FROM (
      SELECT step + 1 AS step, source_key, doc_key, moment,
        moment = min(moment) OVER (PARTITION BY source_key) AND moment = min(moment) OVER (PARTITION BY doc_key) AS won
      FROM matching WHERE NOT won))
  WHERE won OR NOT touched),
documents AS (
  SELECT doc_key, moment AS reg_at, 'source:' || source_key AS doc_owner FROM matching WHERE won
  UNION ALL SELECT doc_key, t0, 'document:' || doc_key FROM claimed WHERE doc_key NOT IN (SELECT doc_key FROM matching WHERE won)),
sources AS (SELECT f.source_key, f.first_at, coalesce(d.doc_owner, 'source:' || f.source_key) AS source_owner
  FROM firsts f LEFT JOIN documents d ON d.doc_key = f.first_doc),
judged AS (SELECT i.record, i.arrival, i.doc_key, s.first_at, s.source_owner, d.doc_owner, coalesce(d.reg_at <= i.arrival, FALSE) AS known
  FROM idrec i JOIN sources s USING (source_key) LEFT JOIN documents d ON d.doc_key = i.doc_key)"""


@query(
    "entity_assign",
    q.with_(
        ASSIGNED,
        """SELECT record, arrival, CASE WHEN doc_key IS NULL OR (known AND doc_owner = source_owner) THEN source_owner END AS owner,
  CASE WHEN doc_key IS NULL OR (known AND doc_owner = source_owner) THEN CASE WHEN arrival = first_at THEN 'registered' ELSE 'joined' END
       WHEN known THEN 'distinct_owners' ELSE 'different_document' END AS outcome FROM judged""",
        recursive=True,
    ),
)
def entity_assign(t: Tables):
    return identity.assign(t.idrec)


@query(
    "type_conflict",
    q.with_(
        COMPONENTS,
        """SELECT component, min(typ) AS low, max(typ) AS high, count(*) AS records FROM
(SELECT component, CASE WHEN record % 50 = 0 THEN 'company' ELSE 'person' END AS typ FROM comp) GROUP BY component HAVING min(typ) <> max(typ)""",
        recursive=True,
    ),
)
def type_conflict(t: Tables):
    grouped = identity.components(id_keys(t), "record")
    typed = grouped.withColumn("typ", F.when(F.col("record") % 50 == 0, "company").otherwise("person"))
    return identity.mixed_types(typed, "component", "typ")


@query(
    "unique_doc_conflict",
    q.with_(q.IDREC, """SELECT source_key, CASE WHEN CAST(substr(doc_key, 2) AS BIGINT) % 2 = 0 THEN 'CPF' ELSE 'CNPJ' END AS document_type,
  count(DISTINCT doc_key) AS documents FROM idrec WHERE doc_key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT doc_key) > 1"""),
)
def unique_doc_conflict(t: Tables):
    even = F.substring("doc_key", 2, 20).cast("long") % 2 == 0
    typed = t.idrec.withColumn("document_type", F.when(even, "CPF").otherwise("CNPJ"))
    return identity.document_conflicts(typed, "source_key", "doc_key", "document_type")


# ---- relationships -------------------------------------------------------------


def edges(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    rel = F.element_at(F.array(*[F.lit(r) for r in ("mother", "father", "sibling", "spouse", "other")]), (key % 5 + 1).cast("int"))
    by_id = key % 3 == 0
    target = F.when(by_id, F.when(key % 9 == 0, key).otherwise(key + 7))
    return t.customer.select(
        F.concat(F.lit("C"), key).alias("owner"),
        rel.alias("rel"),
        F.concat(F.lit("C"), target).alias("target_id"),
        F.when(~by_id & (key % 7 != 0), F.when(key % 20 == 1, 1000 + key).otherwise(key % 130)).alias("target_document"),
        (key % 17 != 0).alias("document_valid"),
    )


def entities(t: Tables) -> DataFrame:
    people = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("entity"), F.lit("person").alias("entity_type"))
    firms = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("entity"), F.lit("company").alias("entity_type"))
    return people.unionByName(firms)


def owned_documents(t: Tables) -> DataFrame:
    firms = t.supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("owner"), (F.col("s_suppkey") % 70).alias("document"), (F.col("s_suppkey") % 11 != 0).alias("valid")
    )
    people = t.customer.select(
        F.concat(F.lit("C"), "c_custkey").alias("owner"), (F.col("c_custkey") + 1000).alias("document"), F.lit(True).alias("valid")
    )
    return firms.unionByName(people)


EDGES = """
edge AS (SELECT 'C' || c_custkey AS owner, ['mother', 'father', 'sibling', 'spouse', 'other'][c_custkey % 5 + 1] AS rel,
  'C' || CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN c_custkey ELSE c_custkey + 7 END END AS target_id,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 20 = 1 THEN 1000 + c_custkey ELSE c_custkey % 130 END END AS target_document,
  c_custkey % 17 <> 0 AS document_valid FROM customer),
entity AS (SELECT 'C' || c_custkey AS entity, 'person' AS entity_type FROM customer UNION ALL SELECT 'S' || s_suppkey, 'company' FROM supplier),
owned AS (SELECT 'S' || s_suppkey AS owner, s_suppkey % 70 AS document FROM supplier WHERE s_suppkey % 11 <> 0
  UNION ALL SELECT 'C' || c_custkey, c_custkey + 1000 FROM customer),
by_id AS (SELECT e.owner, e.rel, CASE WHEN target_id = e.owner THEN 'self_reference' WHEN n.entity IS NULL THEN 'pending_target' ELSE 'resolved' END AS status,
  CASE WHEN target_id <> e.owner THEN n.entity END AS target, CASE WHEN target_id <> e.owner THEN n.entity_type END AS target_type
  FROM edge e LEFT JOIN entity n ON n.entity = e.target_id WHERE e.target_id IS NOT NULL),
doc AS (SELECT document, count(DISTINCT owner) AS n, min(owner) AS one FROM owned GROUP BY document),
by_doc0 AS (SELECT e.owner, e.rel, e.target_document AS document, CASE WHEN NOT document_valid THEN 'pending_document_validation'
   WHEN EXISTS (SELECT 1 FROM owned o WHERE o.document = e.target_document AND o.owner = e.owner) THEN 'self_reference'
   WHEN d.n IS NULL THEN 'pending_target' WHEN d.n = 1 THEN 'resolved' ELSE 'ambiguous_document' END AS status, d.one
  FROM edge e LEFT JOIN doc d ON d.document = e.target_document WHERE e.target_id IS NULL AND e.target_document IS NOT NULL),
by_doc AS (SELECT owner, rel, document, status, CASE WHEN status = 'resolved' THEN one END AS target FROM by_doc0)"""


@query("rel_by_id", q.with_(EDGES, "SELECT * FROM by_id"))
def rel_by_id(t: Tables):
    return relations.resolve_by_id(edges(t), entities(t))


@query("rel_by_document", q.with_(EDGES, "SELECT * FROM by_doc"))
def rel_by_document(t: Tables):
    return relations.resolve_by_document(edges(t), owned_documents(t))


@query(
    "rel_connections",
    q.with_(
        EDGES,
        """, every AS (SELECT owner, rel, status, target FROM by_id UNION ALL SELECT owner, rel, status, target FROM by_doc
  UNION ALL SELECT owner, rel, 'pending_identity', NULL FROM edge WHERE target_id IS NULL AND target_document IS NULL)
SELECT owner AS entity, 'outgoing' AS direction, target AS other, rel AS role, FALSE AS derived, status FROM every
UNION ALL SELECT target, 'incoming', owner, CASE rel WHEN 'mother' THEN 'child' WHEN 'father' THEN 'child' WHEN 'sibling' THEN 'sibling' WHEN 'spouse' THEN 'spouse' END, TRUE, status
FROM every WHERE status = 'resolved'""",
    ),
)
def rel_connections(t: Tables):
    columns = ["owner", "rel", "status", "target"]
    by_id = relations.resolve_by_id(edges(t), entities(t)).select(*columns)
    by_document = relations.resolve_by_document(edges(t), owned_documents(t)).select(*columns)
    every = by_id.unionByName(by_document).unionByName(relations.pending_identity(edges(t)))
    return relations.connections(every)
