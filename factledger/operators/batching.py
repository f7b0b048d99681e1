"""Cutting an ordered load into batches that keep every limit.

A batch takes records in order until the next one would break a limit; that one
starts the next batch. Where a batch ends depends on where it began, so the cuts
look sequential. They are not: a batch holds at most ``records`` records, so
whatever a block of consecutive records begins with, its last batch begins in
one of few places. Every block therefore says, for each place it can be entered
at, where the following block is entered and how many batches begin in between.
These tables are composed by doubling over the blocks; then every block cuts
itself. No task holds more than a block, and no block waits for another.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.ordered import with_ordinal
from factledger.workspace import pin

MAX_RECORDS = 1_000
MAX_ATOMS = 20_000
MAX_BYTES = 16 * 1024 * 1024
BLOCK_ROWS = 100_000


def _next_starts(sizes: list[np.ndarray], limits: Sequence[int], records: int) -> np.ndarray:
    """For every record the place where the batch that begins with it ends.

    A record that breaks a limit by itself is a batch of its own.
    """
    n = len(sizes[0])
    begin = np.arange(n)
    ends = np.minimum(begin + records, n)
    for size, limit in zip(sizes, limits, strict=True):
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.minimum(ends, np.searchsorted(total, total[:-1] + limit, side="right") - 1)
    return np.maximum(ends, begin + 1)


def batches(
    rows: DataFrame,
    order: Sequence[str],
    atoms: str,
    size: str,
    records: int = MAX_RECORDS,
    max_atoms: int = MAX_ATOMS,
    max_bytes: int = MAX_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with ``ordinal``, ``batch`` and ``place``, all from 1; ``order`` makes rows distinct."""
    if block_rows < records:
        raise ValueError("a block must hold a whole batch")
    limits = (max_atoms, max_bytes)
    numbered = pin(with_ordinal(rows, [F.col(c) for c in order]), "numbered")
    light = numbered.select(
        F.expr(f"(ordinal - 1) div {block_rows}").alias("block"),
        F.expr(f"(ordinal - 1) % {block_rows}").alias("at"),
        F.col(atoms).cast("long").alias("atoms"),
        F.col(size).cast("long").alias("bytes"),
    )
    # a block also sees the beginning of the next one, where its last batch may end
    ahead = light.filter(F.col("at") < records).filter("block > 0").select((F.col("block") - 1).alias("block"), (F.col("at") + block_rows).alias("at"), "atoms", "bytes")
    seen = light.unionByName(ahead)

    def starts(frame: pd.DataFrame) -> tuple[np.ndarray, int]:
        frame = frame.sort_values("at")
        own = int((frame["at"] < block_rows).sum())
        ends = _next_starts([frame["atoms"].to_numpy(), frame["bytes"].to_numpy()], limits, records)
        return ends[:own], own

    def passage(frame: pd.DataFrame) -> pd.DataFrame:
        ends, own = starts(frame)
        leaves, cuts = np.zeros(own, np.int64), np.ones(own, np.int64)
        for k in range(own - 1, -1, -1):
            if ends[k] >= own:
                leaves[k] = ends[k] - own
            else:
                leaves[k] = leaves[ends[k]]
                cuts[k] += cuts[ends[k]]
        most = min(records, own)
        entries = {"block": [int(frame["block"].iloc[0])], "leaves": [leaves[:most].tolist()], "cuts": [cuts[:most].tolist()]}
        return pd.DataFrame(entries)

    passages = pin(seen.groupBy("block").applyInPandas(passage, "block long, leaves array<long>, cuts array<long>"), "passages")
    entered = _entries(passages)

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        ends, own = starts(frame)
        at, batch = int(frame["entry"].iloc[0]), int(frame["before"].iloc[0])
        numbers = np.full(own, batch)  # records before the entry: of the batch that began in the block before
        while at < own:
            batch += 1
            numbers[at : ends[at]] = batch
            at = int(ends[at])
        ordinals = int(frame["block"].iloc[0]) * block_rows + np.arange(own) + 1
        return pd.DataFrame({"ordinal": ordinals, "batch": numbers})

    placed = seen.join(entered, "block").groupBy("block").applyInPandas(cut, "ordinal long, batch long")
    first = F.min("ordinal").over(Window.partitionBy("batch"))  # a batch is at most ``records`` rows
    return numbered.join(placed, "ordinal").withColumn("place", F.col("ordinal") - first + 1)


def _entries(passages: DataFrame) -> DataFrame:
    """``(block, entry, before)``: where a block is entered and how many batches begin before it."""
    reach, step = passages, 1
    blocks = passages.agg(F.max("block")).first()[0]
    if blocks is None:
        return passages.select("block", F.lit(0).alias("entry"), F.lit(0).alias("before"))
    while step <= blocks:  # composition of passages over twice as many blocks each round
        earlier = reach.select((F.col("block") + step).alias("block"), F.col("leaves").alias("way"), F.col("cuts").alias("sum"))
        both = reach.join(earlier, "block", "left")
        leaves = F.transform("way", lambda x: F.get("leaves", x.cast("int")))
        cuts = F.transform(F.arrays_zip("way", "sum"), lambda x: x["sum"] + F.get("cuts", x["way"].cast("int")))
        reach = pin(
            both.select("block", F.coalesce(leaves, "leaves").alias("leaves"), F.coalesce(cuts, "cuts").alias("cuts")), "passages"
        )
        step *= 2
    after = reach.select((F.col("block") + 1).alias("block"), F.get("leaves", F.lit(0)).alias("entry"), F.get("cuts", F.lit(0)).alias("before"))
    return passages.select("block").join(after, "block", "left").na.fill(0)
