"""Field definitions: binding, versions in force, histories, type checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions.values import value_type_ok
from factledger.operators.ordered import beside, with_ordinal


def bind(values: DataFrame, definitions: DataFrame, entity_type: Column) -> DataFrame:
    """Attach the definition a value names and say whether it may be used.

    ``definitions`` has ``field_id, version, type, scope, active``. A value
    whose definition is not catalogued stays, waiting for classification.
    """
    joined = values.join(definitions, ["field_id", "version"], "left")
    known = F.col("type").isNotNull()
    status = (
        F.when(~known, "pending")
        .when(~F.col("active"), "rejected")
        .when((F.col("scope") != "both") & (F.col("scope") != entity_type), "rejected")
        .otherwise("bound")
    )
    reason = (
        F.when(~known, "definition_unknown")
        .when(~F.col("active"), "definition_inactive")
        .when((F.col("scope") != "both") & (F.col("scope") != entity_type), "scope_mismatch")
    )
    return joined.withColumns({"bind_status": status, "bind_reason": reason})


def in_force(definitions: DataFrame, used: DataFrame, cutoff: Column) -> DataFrame:
    """Definition versions a selection refers to, as known at the cutoff."""
    known = definitions.filter(F.col("changed_at").isNull() | (F.col("changed_at") <= cutoff))
    return known.join(used.select("field_id"), "field_id", "left_semi")


def history_intervals(changes: DataFrame, key: str, order: str, at: str, fixed: str, value: str) -> DataFrame:
    """Definition history as validity intervals.

    ``fixed`` may never change: a change that does not repeat the first value
    is kept as ``incompatible`` and applies nothing. Repeats of the current
    ``value`` create no version. Neighbours are found by joins on dense
    positions, so one key with most of the changes is still spread.
    """
    first = changes.groupBy(key).agg(F.min_by(fixed, order).alias("_first"))
    marked = changes.join(first, key)
    same = F.col(fixed).eqNullSafe(F.col("_first"))
    refused = marked.filter(~same).select(
        key, order, F.lit("incompatible").alias("status"), F.lit(None).cast("long").alias("version"),
        F.col(at).alias("valid_from"), F.lit(None).cast(changes.schema[at].dataType).alias("valid_to"),
    )
    placed = with_ordinal(marked.filter(same).select(key, order, at, value), [order], keys=[key], name="_pos")
    compared = beside(placed, [key], "_pos", [value])
    new = compared.filter((F.col("_pos") == 1) | ~F.col(value).eqNullSafe(F.col(f"prev_{value}")))
    numbered = with_ordinal(new.select(key, order, at), [order], keys=[key], name="version")
    bounded = beside(numbered, [key], "version", [at], step=1)
    versions = bounded.select(
        key, order, F.lit("version").alias("status"), "version", F.col(at).alias("valid_from"), F.col(f"next_{at}").alias("valid_to")
    )
    return versions.unionByName(refused)


def check_types(values: DataFrame, entities: DataFrame) -> DataFrame:
    """Type verdict per custom value; references must exist with their type.

    ``values`` has ``raw, json_type, declared, options`` and, for references,
    ``ref_type, ref_id``.
    """
    have = entities.select(F.col("entity_type").alias("ref_type"), F.col("entity").alias("ref_id"), F.lit(True).alias("_found"))
    # Most values refer to nothing; as null keys they would all meet in one task.
    referring = values.filter(F.col("ref_id").isNotNull()).join(have, ["ref_type", "ref_id"], "left")
    joined = referring.unionByName(values.filter(F.col("ref_id").isNull()), allowMissingColumns=True)
    good = value_type_ok(
        F.col("raw"), F.col("json_type"), F.col("declared"), F.col("options"), F.coalesce("_found", F.lit(False))
    )
    return joined.withColumn("valid", good).drop("_found")


def check_references(references: DataFrame, entities: DataFrame) -> DataFrame:
    """Does the referenced entity exist, and with the declared type?"""
    have = entities.select(F.col("entity").alias("ref_id"), F.col("entity_type").alias("_type"))
    joined = references.join(have, "ref_id", "left")
    verdict = F.when(F.col("_type").isNull(), "missing").when(F.col("_type") != F.col("ref_type"), "other_type").otherwise("ok")
    return joined.withColumn("verdict", verdict).drop("_type")


def first_binding_guard(rows: DataFrame, keys: list[str], order: str, binding: str) -> DataFrame:
    """Rows that disagree with the first binding of their item."""
    first = rows.groupBy(*keys).agg(F.min_by(binding, order).alias("pinned"))
    return rows.join(first, keys).filter(~F.col(binding).eqNullSafe(F.col("pinned")))
