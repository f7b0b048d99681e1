"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.session import tune
from factledger.workspace import new_path, pin

#: Rows of one Arrow batch: whole texts are large, so batches hold few of them.
BATCH_ROWS = 400

#: White space of the text contracts, as a regular expression class.
SPACE = r"\x20\x09-\x0D"


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of these jobs: small Arrow batches of whole texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def drained(batches: Iterator, work) -> Iterator:
    """``work`` over every batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield work(batch)


def sent_if_few(table: DataFrame, rows: int) -> DataFrame:
    """Sent to all tasks if it has at most ``rows`` rows, else left to the optimiser."""
    return F.broadcast(table) if table.count() <= rows else table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges ``(a long, b long)``.

    Returns ``(node, component)`` with the smallest reachable node, for every
    node that has an edge to another one. Alternating large and small stars:
    the number of rounds is logarithmic, every round is partial aggregates and
    equi-joins with a unique side, and is written to the shared folder, so a
    lost executor costs one round. Self edges, repeats and nulls are ignored;
    no edges give an empty result.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    live = pin(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(high.cast("long").alias("u"), low.cast("long").alias("v"))
        .distinct(),
        name,
    )
    seen = _state(live)
    while seen[0]:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        live = pin(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), name)
        now = _state(live)
        if now == seen:
            break
        seen = now
    return live.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """One row that changes when the edges do."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s"),
    ).first()
    return tuple(row)


__all__ = ["BATCH_ROWS", "SPACE", "components", "drained", "new_path", "pin", "prepare", "read", "sent_if_few", "text_or_empty"]
