"""Proof that a load is complete: digests, differences, replays, gates."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of a row; a null is spelled as no value is, so it cannot shift columns."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])


def digest_columns(columns: Sequence[str]) -> list[Column]:
    """Order-insensitive evidence: count, xor and wide sum of row hashes."""
    hashed = row_hash(columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(hashed).alias("xor_hash"),
        F.sum(hashed.cast("decimal(38,0)")).alias("sum_hash"),
    ]


def digest(df: DataFrame, columns: Sequence[str]) -> tuple:
    """The evidence of a whole table as a driver-side triple."""
    return tuple(df.agg(*digest_columns(columns)).first())


def compare_columns(expected: DataFrame, stored: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per discrepancy: key and code (missing, extra, <column>_mismatch)."""
    mark = lambda df, side: df.select(
        *key, F.struct(*columns).alias(side)
    )
    joined = mark(expected, "_e").join(mark(stored, "_s"), list(key), "full_outer")
    differing = [
        F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_s.{c}")), F.lit(f"{c}_mismatch")) for c in columns
    ]
    codes = (
        F.when(F.col("_s").isNull(), F.array(F.lit("missing")))
        .when(F.col("_e").isNull(), F.array(F.lit("extra")))
        .otherwise(F.array_compact(F.array(*differing)))
    )
    return joined.select(*key, F.explode(codes).alias("code"))


def summarise(discrepancies: DataFrame) -> DataFrame:
    return discrepancies.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only, labelled."""
    gone = expected.select(*key).join(actual.select(*key), list(key), "left_anti").withColumn("side", F.lit("missing"))
    more = actual.select(*key).join(expected.select(*key), list(key), "left_anti").withColumn("side", F.lit("extra"))
    return gone.unionByName(more)


def changed(expected: DataFrame, actual: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys on both sides whose content differs."""
    left = expected.select(*key, F.struct(*columns).alias("_l"))
    right = actual.select(*key, F.struct(*columns).alias("_r"))
    return left.join(right, list(key)).filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(*key)


def idempotent_append(stored: DataFrame, incoming: DataFrame, operation: str, content: str) -> DataFrame:
    """Outcome per incoming operation: append, replayed or conflict.

    Copies inside the batch collapse when equal and conflict when they differ;
    a stored operation with the same content is a no-op.
    """
    batch = incoming.groupBy(operation).agg(
        F.min(content).alias("_low"), F.max(content).alias("_high"), F.count(F.lit(1)).alias("copies")
    )
    have = stored.select(operation, F.col(content).alias("_have"))
    joined = batch.join(have, operation, "left")
    outcome = (
        F.when(F.col("_low") != F.col("_high"), "conflict")
        .when(F.col("_have").isNull(), "append")
        .when(F.col("_have") == F.col("_low"), "replayed")
        .otherwise("conflict")
    )
    return joined.select(operation, "copies", outcome.alias("outcome"))


def duplicates(rows: DataFrame, key: Sequence[str], ident: str) -> DataFrame:
    """Keys that occur more than once, with count and first row."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id"))
    return counted.filter(F.col("copies") > 1)


def selector_readiness(rows: DataFrame, selector: str, state: str) -> DataFrame:
    """Is a selector fully searchable? Only when nothing is omitted or failed."""
    counts = rows.groupBy(selector).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col(state) == "indexed").alias("indexed"),
        F.count_if(F.col(state) == "omitted").alias("omitted"),
        F.count_if(F.col(state) == "failed").alias("failed"),
    )
    ready = (F.col("expected") == F.col("indexed")) & (F.col("omitted") == 0) & (F.col("failed") == 0)
    return counts.withColumn("state", F.when(ready, "ready").otherwise("pending"))


def baseline(counts: DataFrame, recorded: DataFrame, source: str) -> DataFrame:
    """Counts and schema digests of sources against the recorded baseline.

    Both have ``<source>, rows, schema_digest``.
    """
    found = counts.select(source, F.col("rows").alias("found"), F.col("schema_digest").alias("_now"))
    was = recorded.select(source, F.col("rows").alias("recorded"), F.col("schema_digest").alias("_was"))
    joined = found.join(was, source, "full_outer")
    verdict = (
        F.when(F.col("found").isNull(), "source_missing")
        .when(F.col("recorded").isNull(), "source_unknown")
        .when(~F.col("_now").eqNullSafe(F.col("_was")), "schema_differs")
        .when(F.col("found") != F.col("recorded"), "count_differs")
        .otherwise("equal")
    )
    return joined.select(source, "found", "recorded", verdict.alias("verdict"))


def progress(results: DataFrame, job: str) -> DataFrame:
    """Processed, succeeded, failed and whole percent per job."""
    done = F.col("status") != "not_processed"
    counts = results.groupBy(job).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("processed"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return counts.withColumn("percent", F.floor(F.col("processed") * 100 / F.col("total")))


def results_with_defaults(entries: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every entry with its result; entries without one were not processed."""
    return entries.join(results, list(key), "left").withColumn("status", F.coalesce("status", F.lit("not_processed")))


def allowed_sources(rows: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """Rows labelled by whether their source is active, known or neither."""
    joined = rows.join(sources.select(source, F.col("active").alias("_active")), source, "left")
    verdict = F.when(F.col("_active").isNull(), "unknown_source").when(~F.col("_active"), "inactive_source").otherwise("allowed")
    return joined.withColumn("verdict", verdict).drop("_active")


def latest_for_events(events: DataFrame, versions: DataFrame, owner: str) -> DataFrame:
    """Newest entity version per change event; never behind the event itself."""
    newest = versions.groupBy(owner).agg(F.max("version").alias("latest"))
    joined = events.join(newest, owner, "left")
    return joined.withColumn("source_behind", F.coalesce(F.col("latest") < F.col("version"), F.lit(True)))


def freshness(hits: DataFrame, canonical: DataFrame, owner: str) -> DataFrame:
    """Is the indexed version the canonical one?"""
    newest = canonical.groupBy(owner).agg(F.max("version").alias("canonical_version"))
    joined = hits.join(newest, owner, "left")
    return joined.withColumn("indexing_pending", ~F.col("indexed_version").eqNullSafe(F.col("canonical_version")))


def publish_decisions(incoming: DataFrame, target: DataFrame, owner: str) -> DataFrame:
    """Monotone publication: newer wins, equal content is already there.

    One decision per owner and version of ``incoming``. Two contents under one
    version are a conflict; of the others only the newest is indexed.
    """
    batch = incoming.groupBy(owner, "version").agg(F.min("content").alias("_low"), F.max("content").alias("_high"))
    clean = F.col("_low") == F.col("_high")
    newest = batch.filter(clean).groupBy(owner).agg(F.max("version").alias("_top"))
    joined = batch.join(newest, owner, "left").join(
        target.select(owner, F.col("version").alias("_at"), F.col("content").alias("_there")), owner, "left"
    )
    decision = (
        F.when(~clean, "conflict")
        .when(F.col("version") == F.col("_at"), F.when(F.col("_low") == F.col("_there"), "already_indexed").otherwise("conflict"))
        .when((F.col("version") < F.col("_at")) | (F.col("version") < F.col("_top")), "obsolete")
        .otherwise("indexed")
    )
    return joined.select(owner, "version", F.col("_low").alias("content"), decision.alias("decision"))


def check_flag_targets(requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Requests to confirm a value: the target must be that item's scalar value."""
    target = observations.select(
        F.col("id").alias("target_id"),
        F.struct("owner", "item", "path", "dimension").alias("_t"),
    )
    joined = requests.join(target, "target_id", "left")
    same = (F.col("_t.owner") == F.col("owner")) & (F.col("_t.item") == F.col("item")) & (F.col("_t.path") == F.col("path"))
    error = (
        F.when(F.col("_t").isNull(), "target_missing")
        .when(F.col("_t.dimension") != "value", "target_not_a_value")
        .when(~same, "target_of_other_field")
        .when((F.col("flag") == F.lit(False)) & (F.coalesce("reason", F.lit("")) == ""), "invalid_needs_reason")
    )
    return joined.withColumn("error", error).drop("_t")


def conditional_append(requests: DataFrame, versions: DataFrame, state: DataFrame) -> DataFrame:
    """Optimistic writes: right version, existing field, one winner per owner.

    The winner is the earliest acceptable request, found with a partial
    aggregation; the others see a changed version.
    """
    newest = versions.groupBy("owner").agg(F.max("version").alias("_now"))
    fields = state.select("owner", "item", "path", F.lit(True).alias("_field"))
    joined = requests.join(newest, "owner", "left").join(fields, ["owner", "item", "path"], "left")
    error = (
        F.when(F.col("_now").isNull(), "entity_missing")
        .when(F.col("expected_version") != F.col("_now"), "version_conflict")
        .when(F.col("_field").isNull(), "field_missing")
        .when(F.col("item") == "relationship", "relationship_needs_contract")
    )
    checked = joined.withColumn("error", error).drop("_now", "_field")
    winners = checked.filter(F.col("error").isNull()).groupBy("owner").agg(F.min("request").alias("_winner"))
    late = F.col("error").isNull() & (F.col("request") != F.col("_winner"))
    return (
        checked.join(winners, "owner", "left")
        .withColumn("error", F.when(late, "version_conflict").otherwise(F.col("error")))
        .withColumn("accepted", F.col("error").isNull())
        .drop("_winner")
    )
