"""From leaves to facts: mapping rules, shared item keys, coverage, claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest_of(*columns: str) -> Column:
    """One hash of several columns; no value can run into its neighbour."""
    return F.sha2(F.concat(*[F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in columns]), 256)


def map_facts(leaves: DataFrame, rules: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Attach target, status and id to every leaf; unmapped leaves stay pending.

    ``rules`` has ``base_field, target_kind, target_path, status``. The join
    keeps every leaf; no hint is given, so a grown rule table shuffles.
    ``identity`` names what makes a version of a record: source, record, source
    version, record hash, adapter version. A fact's id is all of it and the path.
    """
    joined = leaves.join(rules, "base_field", "left")
    return joined.withColumns(
        {
            "fact_id": digest_of(*identity, "source_path"),
            "target_kind": F.coalesce("target_kind", F.lit("custom")),
            "target_path": F.coalesce("target_path", F.lit("value")),
            "pending_reason": F.when(F.col("target_kind").isNull(), "unmapped_semantics"),
            "status": F.coalesce("status", F.lit("pending")),
        }
    )


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def last_step(path: Column) -> Column:
    return F.regexp_extract(path, r"/([^/]*)\z", 1)


def group_item_keys(leaves: DataFrame, record: str, normalized: str = "value") -> DataFrame:
    """Give the components of one object one item key: the hash of them all.

    The column ``normalized`` is hashed, not the spelling of the source. A group
    is one object of one record, bounded by the record limits.
    """
    placed = leaves.withColumns({"parent": parent_path(F.col("source_path")), "field": last_step(F.col("source_path"))})
    spelled = F.concat(F.sha2("field", 256), F.coalesce(F.sha2(normalized, 256), F.col("json_type")))
    keys = placed.groupBy(record, "parent").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(spelled)), ""), 256).alias("item_key"),
        F.count(F.lit(1)).alias("components"),
    )
    return placed.join(keys, [record, "parent"])


#: Expected leaves of one part of a comparison; parts are sorted in memory.
PART_LEAVES = 250_000


def _sides(wanted: DataFrame, stored: DataFrame, record: str, parts: int) -> DataFrame:
    """Rows of both sides, told apart by ``_stored``, dealt by record."""
    both = wanted.withColumn("_stored", F.lit(False)).unionByName(stored.withColumn("_stored", F.lit(True)))
    return both.repartition(parts, record)


def _cell(kind: str, value: str) -> Column:
    """Two columns as one text, whose equality is theirs."""
    shown = F.col(kind).cast("string")
    head = F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))
    return F.concat(head, F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit("-"))).alias("_cell")


def _packed(digest: str) -> Column:
    """A digest in half the room: hex digits as their bytes, other texts as they are, told apart by the first byte."""
    text = F.col(digest).cast("string")
    hexed = text.rlike(r"\A[0-9a-f]+\z") & (F.length(text) % 2 == 0)
    plain = F.concat(F.lit(b"\x00"), text.cast("binary"))
    return F.when(hexed, F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(plain).alias("digest")


def coverage(expected: DataFrame, facts: DataFrame, record: str, boxes: DataFrame | None = None, stored_boxes: DataFrame | None = None) -> DataFrame:
    """Per record: are all leaves and containers present once, unchanged, and nothing else?

    Leaves may carry the ``digest`` of their value and facts the one stored with
    them: ``invalid_metadata`` counts facts whose stored digest is not that of
    the source's value. Containers, where given, are compared by path, type and
    size.
    """
    key = [record, "source_path"]
    if "digest" not in expected.columns:
        expected, facts = (rows.withColumn("digest", F.lit(None).cast("string")) for rows in (expected, facts))
    if boxes is None:
        boxes = stored_boxes = expected.filter(F.lit(False)).select(*key, "json_type", F.lit(0).alias("size"))
    # both sides in one layout by record: everything that follows stays inside its parts
    cell, shape, mark = _cell("json_type", "value"), _cell("json_type", "size"), _packed("digest")
    parts = max(expected.sparkSession.sparkContext.defaultParallelism, 1 + expected.count() // PART_LEAVES)
    leaf = _sides(expected.select(*key, cell, mark), facts.select(*key, cell, mark), record, parts)
    group = Window.partitionBy(*key).orderBy("_stored").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stored = F.col("_stored")
    fact, mark = F.when(stored, F.col("_cell")), F.when(stored, F.col("digest"))
    named = F.col(record).isNotNull() & F.col("source_path").isNotNull()  # others meet nothing
    spread = leaf.select(
        record,
        "_cell",
        "digest",
        "_stored",
        F.sum(stored.cast("long")).over(group).alias("_copies"),
        (named & (F.sum((~stored).cast("long")).over(group) > 0)).alias("_wanted"),
        F.min(fact).over(group).alias("_low"),
        F.max(fact).over(group).alias("_high"),
        F.min(mark).over(group).alias("_digest_low"),
        F.max(mark).over(group).alias("_digest_high"),
        named.alias("_named"),
        # a group of facts that nothing wants counts once
        (stored & ~F.coalesce(F.lag("_stored").over(Window.partitionBy(*key).orderBy("_stored")), F.lit(False))).alias("_once"),
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    differs = ~(F.col("_cell").eqNullSafe(F.col("_low")) & F.col("_cell").eqNullSafe(F.col("_high")))
    marked = ~(F.col("digest").eqNullSafe(F.col("_digest_low")) & F.col("digest").eqNullSafe(F.col("_digest_high")))
    both = ~stored & F.col("_named") & (F.col("_copies") > 0)
    alone = F.col("_once") & ~F.col("_wanted")
    totals = spread.groupBy(record).agg(
        count(~stored & ~both).alias("missing"),
        count(alone).alias("extra"),
        count(both & differs).alias("changed"),
        count((both | alone) & (F.col("_copies") > 1)).alias("duplicates"),
        count(both & marked).alias("invalid_metadata"),
    )
    box = _sides(boxes.select(*key, shape), stored_boxes.select(*key, shape), record, parts)
    group = Window.partitionBy(*key)
    once = (F.sum(stored.cast("long")).over(group) == 1) & (F.sum((~stored).cast("long")).over(group) > 0)
    there = F.when(stored, F.col("_cell"))
    same = F.col("_cell").eqNullSafe(F.min(there).over(group)) & F.col("_cell").eqNullSafe(F.max(there).over(group))
    matched = box.select(record, (named & once & same).alias("_same")).groupBy(record)
    matched = matched.agg(F.bool_and(F.col("_same")).alias("containers_match"))
    joined = totals.join(matched, record, "full_outer")
    counts = ["missing", "extra", "changed", "duplicates", "invalid_metadata"]
    joined = joined.select(record, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("containers_match", F.lit(True)).alias("containers_match"))
    clean = F.col("containers_match")
    for c in counts:
        clean = clean & (F.col(c) == 0)
    return joined.withColumn("passed", clean)


def identity_eligibility(claims: DataFrame, record: str) -> DataFrame:
    """A record may claim an identity only with one distinct, undisputed value."""
    valid = F.when(F.col("valid"), F.col("claim"))
    totals = claims.groupBy(record).agg(
        F.count(F.lit(1)).alias("claims"),
        F.min(valid).alias("_low"),
        F.max(valid).alias("_high"),
        F.bool_and("valid").alias("_all_valid"),
    )
    eligible = F.col("_all_valid") & (F.col("_low") == F.col("_high"))
    conflict = F.coalesce((F.col("_low") != F.col("_high")) | (F.col("_low").isNotNull() & ~F.col("_all_valid")), F.lit(False))
    return totals.select(
        record,
        "claims",
        F.coalesce(eligible, F.lit(False)).alias("eligible"),
        F.when(eligible, F.col("_low")).alias("candidate"),
        F.when(conflict, "conflicting_claims").alias("pending_reason"),
    )


def discovered_columns(items: DataFrame, kind: str, key: str) -> DataFrame:
    """Union of the keys seen per kind, one row each."""
    return items.select(kind, key).distinct()


def derived_fields(items: DataFrame, attributes: Column, explicit: DataFrame, item: str) -> DataFrame:
    """Item attributes as derived fields, unless the item has the path itself."""
    candidates = items.select(item, F.explode(attributes).alias("path", "value"))
    derived = candidates.join(explicit.select(item, "path"), [item, "path"], "left_anti")
    return explicit.withColumn("derived", F.lit(False)).unionByName(derived.withColumn("derived", F.lit(True)))


# Fixed value: the name shown for a record that has none.
UNNAMED = "Sem nome informado"


def display_names(entities: DataFrame, items: DataFrame, on: str, default: str = UNNAMED) -> DataFrame:
    """Name of the first identity item, or the default."""
    first = items.filter(F.col("kind") == "identity").groupBy(on).agg(F.min_by("name", "item_order").alias("name"))
    return entities.select(on).join(first, on, "left").withColumn("name", F.coalesce("name", F.lit(default)))
