"""Which records describe the same entity: exact keys, components, assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.operators.reconcile import digest
from factledger.workspace import pin


def key_rows(records: DataFrame, record: str, keys: dict[str, Column]) -> DataFrame:
    """``record, kind, key`` for every non-null key of a record."""
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), column.alias("key")) for kind, column in keys.items()])
    return records.select(record, F.inline(entries)).filter(F.col("key").isNotNull())


def key_hash(kind: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", kind, key), 256)


def lookup(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Owners of keys: equality on the hash, checked on the full key."""
    hashed = keys.withColumn("key_hash", key_hash(F.col("kind"), F.col("key")))
    return hashed.join(registry, ["key_hash", "kind", "key"])


def match_owners(records: DataFrame, found: DataFrame, record: str) -> DataFrame:
    """``new``, ``matched`` or ``conflict`` for every incoming record.

    Only the smallest and largest owner travel per record: they differ exactly
    when the keys of the record lead to several owners.
    """
    span = found.groupBy(record).agg(F.min("owner").alias("_low"), F.max("owner").alias("_high"))
    joined = records.select(record).join(span, record, "left")
    single = F.col("_low") == F.col("_high")
    return joined.select(
        record,
        F.when(F.col("_low").isNull(), "new").when(single, "matched").otherwise("conflict").alias("outcome"),
        F.when(single, F.col("_low")).alias("owner"),
    )


def components(keys: DataFrame, record: str) -> DataFrame:
    """``record, component``: the smallest record reachable through shared keys.

    Every key first ties its records to their smallest one, so a key shared by
    a third of all records is a star, never a set of pairs. Alternating large-
    and small-star rounds (Kiveris et al., 2014) then shrink every tree to a
    star in a logarithmic number of rounds. A round is two partial aggregations
    and two joins against one row per node; it is pinned between its halves and
    before the next, so that no shuffle runs twice.
    """
    anchor = keys.groupBy("kind", "key").agg(F.min(record).alias("v"))
    tied = keys.join(anchor, ["kind", "key"]).select(F.col(record).alias("u"), "v")
    edges = pin(tied.filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = digest(edges, ["u", "v"])
    while True:
        wide = pin(_large_star(edges), "edges")
        edges = pin(_small_star(wide).distinct(), "edges")
        now = digest(edges, ["u", "v"])
        if now == seen:
            break
        seen = now
    everyone = keys.select(record).distinct()
    return everyone.join(edges.select(F.col("u").alias(record), "v"), record, "left").select(
        record, F.coalesce("v", record).alias("component")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour at the smallest node of the neighbourhood."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").select(
        F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    )
    return moved.filter(F.col("u") != F.col("v"))


def mixed_types(records: DataFrame, group: str, kind: str) -> DataFrame:
    """Groups whose records disagree on the entity type."""
    span = records.groupBy(group).agg(F.min(kind).alias("low"), F.max(kind).alias("high"), F.count(F.lit(1)).alias("records"))
    return span.filter(F.col("low") != F.col("high"))


def document_conflicts(records: DataFrame, owner: str, document: str, kind: str | None = None) -> DataFrame:
    """Owners that claim two different documents of one unique type.

    ``kind`` names the column of the type; without it all are of one type.
    """
    group = [owner, kind] if kind else [owner]
    counted = records.filter(F.col(document).isNotNull()).groupBy(*group).agg(F.countDistinct(document).alias("documents"))
    return counted.filter(F.col("documents") > 1)


def assign(records: DataFrame) -> DataFrame:
    """Owner and outcome of every record as if they arrived one at a time.

    Input ``record, source_key, doc_key, arrival`` with distinct arrivals and
    one entity type. One at a time the rules are: a known key gives its owner;
    keys of two owners are a conflict; a new owner is named after the document
    if there is one, else after the source; an owner holds one document. A
    refused record registers nothing.

    The replay needs no sequence, because the first record of a source is never
    refused:

    * it fixes the owner of its source, and registers its document at ``t0``
      unless something registered it before;
    * the only other way to register a document is a later record of a source
      whose first record had none. Such a source takes at most one document and
      such a document goes to at most one source, earliest record first -
      a greedy matching on (source, document) pairs ordered by arrival;
    * with owners and registration times known, each record is judged alone.

    A pair waits for the earlier ones at its source and at its document. Pairs
    that wait for none are taken. A pair that waits for a single other one is
    taken if that one is not, so along such links the answer alternates: they
    are settled by pointer doubling, a chain of any length in as many rounds as
    its length has binary digits. Pairs that wait for several are judged anew
    once those settled are gone; a document wanted by a third of all sources is
    settled in one round. All steps are joins on unique right sides and partial
    aggregations.
    """
    firsts = records.groupBy("source_key").agg(F.min_by(F.struct("doc_key", "arrival"), "arrival").alias("f"))
    firsts = pin(firsts.select("source_key", F.col("f.doc_key").alias("first_doc"), F.col("f.arrival").alias("first_at")), "firsts")
    claimed = firsts.filter(F.col("first_doc").isNotNull()).groupBy(F.col("first_doc").alias("doc_key")).agg(
        F.min("first_at").alias("t0")
    )
    open_sources = firsts.filter(F.col("first_doc").isNull()).select("source_key")
    wishes = (
        records.filter(F.col("doc_key").isNotNull())
        .join(open_sources, "source_key", "left_semi")
        .groupBy("source_key", "doc_key")
        .agg(F.min("arrival").alias("at"))
        .join(claimed, "doc_key", "left")
        .filter(F.col("t0").isNull() | (F.col("at") < F.col("t0")))
        .drop("t0")
    )
    matched = _earliest_matching(pin(wishes, "wishes"))
    taken = matched.select("doc_key", F.col("at").alias("reg_at"), F.concat(F.lit("source:"), "source_key").alias("doc_owner"))
    fresh = claimed.join(taken.select("doc_key"), "doc_key", "left_anti").select(
        "doc_key", F.col("t0").alias("reg_at"), F.concat(F.lit("document:"), "doc_key").alias("doc_owner")
    )
    documents = pin(taken.unionByName(fresh), "documents")
    sources = (
        firsts.join(documents.withColumnRenamed("doc_key", "first_doc"), "first_doc", "left")
        .select("source_key", "first_at", F.coalesce("doc_owner", F.concat(F.lit("source:"), "source_key")).alias("source_owner"))
    )
    # Records without a document stay out of the join: as null keys they would
    # all meet in one task.
    owned = records.join(sources, "source_key")
    judged = owned.filter(F.col("doc_key").isNotNull()).join(documents, "doc_key", "left").unionByName(
        owned.filter(F.col("doc_key").isNull()), allowMissingColumns=True
    )
    known = F.coalesce(F.col("reg_at") <= F.col("arrival"), F.lit(False))
    agrees = F.col("doc_key").isNull() | (known & (F.col("doc_owner") == F.col("source_owner")))
    return judged.select(
        "record",
        "arrival",
        F.when(agrees, F.col("source_owner")).alias("owner"),
        F.when(agrees, F.when(F.col("arrival") == F.col("first_at"), "registered").otherwise("joined"))
        .when(known, "distinct_owners")
        .otherwise("different_document")
        .alias("outcome"),
    )


def _earliest_matching(wishes: DataFrame) -> DataFrame:
    """Greedy matching of (source_key, doc_key) pairs in order of ``at``, which tells pairs apart."""
    left, chosen = wishes, None
    while not left.isEmpty():
        ranked = left.withColumn("waits", F.lit(0)).withColumn("on", F.lit(None).cast(left.schema["at"].dataType))
        for end in ("source_key", "doc_key"):
            first = left.groupBy(end).agg(F.min("at").alias("first"))
            later = left.join(first, end).filter("at > first").groupBy(end).agg(F.min("at").alias("second"))
            ranked = ranked.join(first, end).join(later, end, "left")
            # 0, 1 or several earlier pairs at this end
            earlier = F.when(F.col("at") == F.col("first"), 0).when(F.col("at") == F.col("second"), 1).otherwise(2)
            ranked = ranked.withColumn("on", F.when(earlier == 1, F.col("first")).otherwise(F.col("on")))
            ranked = ranked.withColumn("waits", F.col("waits") + earlier).drop("first", "second")
        ranked = pin(ranked.select("source_key", "doc_key", "at", "waits", F.when(F.col("waits") == 1, F.col("on")).alias("on")), "ranked")
        settled = _settled(ranked)
        won = pin(ranked.join(settled.filter("taken"), "at", "left_semi").select("source_key", "doc_key", "at"), "won")
        chosen = won if chosen is None else chosen.unionByName(won)
        left = left.join(won.select("source_key"), "source_key", "left_anti").join(won.select("doc_key"), "doc_key", "left_anti")
        left = pin(left, "wishes")
    return wishes if chosen is None else chosen


def _settled(ranked: DataFrame) -> DataFrame:
    """``(at, taken)`` of the pairs whose links lead to one that waits for none.

    Every round doubles the reach of the links that have not arrived; parity
    counts the links passed.
    """
    done = ranked.filter("waits = 0").select("at", F.lit(True).alias("taken"))
    links = ranked.filter("waits = 1").select("at", "on", F.lit(1).alias("odd"))
    while True:
        links = _doubled(links, done)
        done = links.filter("arrived").select("at", F.col("odd") == 0).toDF("at", "taken").unionByName(done)
        moving = links.filter("moved AND NOT arrived")
        if moving.isEmpty():
            return done
        links = links.filter("NOT arrived").select("at", "on", "odd")


def _doubled(links: DataFrame, done: DataFrame) -> DataFrame:
    """Every link passed on to where its target's link leads; ``arrived`` at a settled pair."""
    ends = done.select(F.col("at").alias("on"), (~F.col("taken")).cast("int").alias("end_odd"), F.lit(True).alias("arrived"))
    steps = links.select(F.col("at").alias("on"), F.col("on").alias("then"), F.col("odd").alias("then_odd"))
    passed = links.join(ends, "on", "left").join(steps, "on", "left")
    odd = F.col("odd").bitwiseXOR(F.coalesce("end_odd", "then_odd", F.lit(0)))
    return pin(
        passed.select(
            "at",
            F.coalesce("then", "on").alias("on"),
            odd.alias("odd"),
            F.coalesce("arrived", F.lit(False)).alias("arrived"),
            F.col("then").isNotNull().alias("moved"),
        ),
        "links",
    )
