"""Relationship edges: resolution by id or document, and both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The role seen from the other end of an edge.
INVERSE_ROLE = {
    "mother": "child",
    "father": "child",
    "child": "parent",
    "sibling": "sibling",
    "spouse": "spouse",
    "possible_relative": "possible_relative",
    "mãe": "filho/filha",
    "pai": "filho/filha",
    "filho": "pai/mãe",
    "filha": "pai/mãe",
    "irmão": "irmão/irmã",
    "cônjuge": "cônjuge",
}


def resolve_by_id(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an explicit target id."""
    known = entities.select(F.col("entity").alias("target_id"), F.col("entity_type").alias("target_type"))
    joined = edges.filter(F.col("target_id").isNotNull()).join(known, "target_id", "left")
    status = (
        F.when(F.col("target_id") == F.col("owner"), "self_reference")
        .when(F.col("target_type").isNotNull(), "resolved")
        .otherwise("pending_target")
    )
    resolved = status == "resolved"
    return joined.select(
        "owner",
        "rel",
        status.alias("status"),
        F.when(resolved, F.col("target_id")).alias("target"),
        F.when(resolved, F.col("target_type")).alias("target_type"),
    )


def resolve_by_document(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges that name a document: one valid owner resolves, several do not.

    Ownership is summarised to (smallest, largest) owner per document, and the
    edge's own claim is a semi-join, so no owner list is ever collected.
    """
    valid = documents.filter(F.col("valid")).select("document", "owner").distinct()
    span = valid.groupBy("document").agg(F.min("owner").alias("_low"), F.max("owner").alias("_high"))
    own = valid.select(F.col("document"), F.col("owner"), F.lit(True).alias("_own"))
    asked = edges.filter(F.col("target_id").isNull() & F.col("target_document").isNotNull()).withColumnRenamed(
        "target_document", "document"
    )
    joined = asked.join(span, "document", "left").join(own, ["document", "owner"], "left")
    status = (
        F.when(~F.col("document_valid"), "pending_document_validation")
        .when(F.col("_own"), "self_reference")
        .when(F.col("_low").isNull(), "pending_target")
        .when(F.col("_low") == F.col("_high"), "resolved")
        .otherwise("ambiguous_document")
    )
    return joined.select(
        "owner", "rel", "document", status.alias("status"), F.when(status == "resolved", F.col("_low")).alias("target")
    )


def pending_identity(edges: DataFrame) -> DataFrame:
    """Edges that give neither an id nor a document: a name alone resolves nothing."""
    return edges.filter(F.col("target_id").isNull() & F.col("target_document").isNull()).select(
        "owner", "rel", F.lit("pending_identity").alias("status"), F.lit(None).cast("string").alias("target")
    )


def connections(resolved: DataFrame) -> DataFrame:
    """Every resolved edge from both ends; the far end is marked derived."""
    pairs = [F.lit(x) for role in INVERSE_ROLE.items() for x in role]
    outgoing = resolved.select(
        F.col("owner").alias("entity"), F.lit("outgoing").alias("direction"), F.col("target").alias("other"),
        F.col("rel").alias("role"), F.lit(False).alias("derived"), "status",
    )
    incoming = resolved.filter(F.col("status") == "resolved").select(
        F.col("target").alias("entity"), F.lit("incoming").alias("direction"), F.col("owner").alias("other"),
        F.try_element_at(F.create_map(*pairs), F.col("rel")).alias("role"), F.lit(True).alias("derived"), "status",
    )
    return outgoing.unionByName(incoming)
