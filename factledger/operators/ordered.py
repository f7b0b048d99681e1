"""Ordered work that stays balanced when one key holds most of the rows.

A window over a hot key would put the whole key into one task. These helpers
split every key into *blocks* that follow the order, run the window inside a
block, summarise each block to one row and carry the summaries forward. A task
then never holds more than one block per key. Keys that fit in one block need
no carry, so only the owners that outgrow a block take part in the second step.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.workspace import pin

BLOCK = "_block"
BLOCK_ROWS = 1_000_000


def version_block(version: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number from a dense per-owner version: no shuffle, no sampling."""
    return F.call_function("div", version - 1, F.lit(rows))


def outgrown(rows: DataFrame, owner: str, version: str, block_rows: int) -> DataFrame:
    """Rows of the owners that need more than one block.

    The version filter reaches the scan and skips row groups; the optimiser
    chooses the join from the size of what is left.
    """
    owners = rows.filter(F.col(version) > block_rows).select(owner).distinct()
    return rows.join(owners, owner, "left_semi")


def pin_layout(df: DataFrame, order: Sequence, name: str = "layout", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Range-partition by ``order`` and pin the partition number as the block.

    The number of ranges follows the number of rows, so a block stays near
    ``block_rows`` at any size. The layout is written before use: range bounds
    are sampled, so a second evaluation could cut elsewhere.
    """
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, 1 + df.count() // block_rows)
    laid = df.repartitionByRange(ranges, *order).withColumn(BLOCK, F.spark_partition_id().cast("long"))
    return pin(laid, name)


_FOLD = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    folds: dict[str, tuple[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add, per name, the fold of a column over the earlier rows of the key.

    ``folds`` maps an output name to ``("max" | "min" | "sum", column)``. Nulls
    are skipped; the first row of a key gets null (0 for sums). ``keys[0]`` is
    the owner and ``order[0]`` its dense version; ``df`` must be deterministic.
    """
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    block = version_block(F.col(order[0]), block_rows)
    parts = (
        outgrown(df, keys[0], order[0], block_rows)
        .withColumn(BLOCK, block)
        .groupBy(*keys, BLOCK)
        .agg(*[_FOLD[f][0](c).alias(f"_sum_{n}") for n, (f, c) in folds.items()])
    )
    carried = parts.select(
        *keys, BLOCK, *[_FOLD[f][0](f"_sum_{n}").over(across).alias(f"_carry_{n}") for n, (f, _) in folds.items()]
    )
    rows = df.withColumn(BLOCK, block).select(
        "*", *[_FOLD[f][0](c).over(inside).alias(f"_in_{n}") for n, (f, c) in folds.items()]
    )
    joined = rows.join(carried, [*keys, BLOCK], "left")
    merged = {n: _FOLD[f][1](F.col(f"_carry_{n}"), F.col(f"_in_{n}")) for n, (f, _) in folds.items()}
    spent = [f"_{p}_{n}" for n in folds for p in ("carry", "in")]
    return joined.withColumns(merged).drop(BLOCK, *spent)


def with_ordinal(
    df: DataFrame,
    order: Sequence,
    keys: Sequence[str] = (),
    name: str = "ordinal",
    pinned: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number rows 1..n in ``order``, globally or per key, without one big task.

    ``order`` must make rows distinct. Only block counts travel between blocks.
    """
    laid = df if pinned else pin_layout(df, [*keys, *order], block_rows=block_rows)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*keys, BLOCK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    )
    return (
        laid.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*keys, BLOCK])
        .withColumn(name, (F.col("_offset") + F.col("_in")).cast("long"))
        .drop("_offset", "_in", BLOCK)
    )


def beside(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], step: int = -1) -> DataFrame:
    """Add ``prev_*`` (step -1) or ``next_*`` (step 1) columns of a dense position.

    A neighbour lookup is an equi-join on ``position + step``: every (key,
    position) pair is its own join key, so a hot key spreads over all tasks.
    """
    prefix = "prev_" if step < 0 else "next_"
    shifted = df.select(
        *keys, (F.col(position) - step).alias(position), *[F.col(c).alias(prefix + c) for c in columns]
    )
    return df.join(shifted, [*keys, position], "left")
