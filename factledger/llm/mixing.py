"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / size`` times on average.
The whole part is fixed; the fractions are settled in pairs: mass moves at
random from one document to the other until one of them is integral, which
keeps their sum. Documents are dealt to bounded blocks by a hash, a block runs
through its documents from the largest to the smallest, so partners have
similar sizes, and leaves at most one open fraction. Those residuals meet in a
reduction tree, block by block, until one is left for each source; it is
rounded at random. Of a few seeded runs of a block the one nearest to its
expected words is kept, so that a few very long documents don't pull a source
away from its target. All draws are seeded, so reruns agree.

Size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null. Sources
weigh 5, 2, 1, repeating, by code point with null last. A target stops at three
times its source's size and the excess is shared by weight among the others:
the target is the smaller of the limit and level x weight. Rows that repeat a
document are documents of their own. Documents of size 0 take part with 0
words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import SPACE, pin, prepare, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK_ROWS = 4096
SEED = 20240601
#: Seeded runs of a block; the one whose words come nearest to the expected ones is kept.
#: Small blocks, where single documents weigh most, get more runs: so many steps in all.
DRAWS, DRAW_STEPS = 24, 40_000
#: Fractions nearer than this to a whole number are whole.
EXACT = 1e-9

_ROW = "doc_id long, source string, size long, mark long, nth long, block long, rate double"


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, mark)``; the mark tells texts of one id apart."""
    prepare(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.regexp_count(text_or_empty(), F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        F.xxhash64("doc_id", text_or_empty()).alias("mark"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(source, n_docs, source_size, target)``, one row per source.

    Sharing the excess again and again ends at one level for all sources below
    their limit. With sources ordered by limit / weight, the level that holds if
    all earlier ones stop at their limits rises up to the right place and falls
    after it, so the right one is the largest.
    """
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.element_at(listed, (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .select(
            "source",
            "n_docs",
            "source_size",
            F.least(F.col("limit"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def settle(frame: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """Settle the fractions of one block; at most one row stays open (``copies`` null)."""
    frame = frame.sort_values(["size", "mark", "doc_id", "nth"], ascending=[False, True, True, True], kind="stable")
    source = frame["source"].iloc[0]
    name = f"{SEED}/{level}/{source if isinstance(source, str) else chr(0)}/{frame['block'].iloc[0]}"
    rates, sizes_ = frame["rate"].to_numpy(), frame["size"].to_numpy().astype(float)
    tries = []
    unsettled = int((rates - np.floor(rates + EXACT) >= EXACT).sum())
    for k in range(min(max(DRAWS, DRAW_STEPS // len(frame)), 1 << min(max(unsettled - 1, 0), 9))):
        draws = np.random.default_rng([xxhash.xxh64_intdigest(name), k]).random(len(frame) + 1)
        copies, parts, held = pivot(rates, draws, last)
        words = float(((copies + parts - rates) * sizes_).sum())
        tries.append((abs(words), k, copies, parts, held))
        if not words:
            break
    _, _, copies, parts, held = min(tries, key=lambda t: t[:2])
    out = frame.assign(rate=copies + parts, copies=pd.array(copies.astype(np.int64), dtype="Int64"))
    if held >= 0:
        out.iloc[held, out.columns.get_loc("copies")] = pd.NA
    return out


def pivot(rates: np.ndarray, draws: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Copies and open fractions after one run through ``rates``, and the open row or -1."""
    copies = np.floor(rates + EXACT)
    parts = np.where(rates - copies < EXACT, 0.0, rates - copies).tolist()
    chances, up = draws.tolist(), []
    held = -1
    for i, b in enumerate(parts):
        if not b:
            continue
        if held < 0:
            held = i
            continue
        a = parts[held]
        both = a + b
        if both < 1 - EXACT:  # one of the two gives all it has
            if chances[i] * both < a:
                parts[held], parts[i] = both, 0.0
            else:
                parts[held], parts[i], held = 0.0, both, i
        else:  # one of the two becomes whole
            rest = both - 1 if both - 1 > EXACT else 0.0
            full, left = (held, i) if chances[i] * (2 - both) < 1 - b else (i, held)
            up.append(full)
            parts[full], parts[left] = 0.0, rest
            held = left if rest else -1
    if held >= 0 and last:
        if chances[-1] < parts[held]:
            up.append(held)
        parts[held], held = 0.0, -1
    copies[up] += 1
    return copies, np.array(parts), held


def settler(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda frame: settle(frame, level, last)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, mark, source, size, source_size, target, copies)`` for every row."""
    sized = pin(sizes(docs), "mix-sizes")
    goals = pin(targets(sized, weights, most), "mix-targets").withColumn("blocks", F.ceil(F.col("n_docs") / block_rows))
    goal = goals.select(F.col("source").alias("_source"), "source_size", "target", "blocks")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # equal rows are counted and numbered, so they are dealt to blocks like any others
    counted = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("rows"))
    numbered = counted.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    spot = F.when(F.col("nth") == 0, F.xxhash64(F.lit(SEED), "mark")).otherwise(F.xxhash64(F.lit(SEED), "mark", "nth"))
    open_rows = (
        numbered.join(goal, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("block", F.pmod(spot, F.col("blocks")))
        .select("doc_id", "source", "size", "mark", "nth", "block", rate.alias("rate"))
    )
    blocks = (goals.agg(F.max("blocks")).first()[0]) or 0
    done, level = [], 0
    while True:
        last = blocks <= 1
        work = settler(level, last)
        step = pin(open_rows.groupBy("source", "block").applyInPandas(work, f"{_ROW}, copies long"), "mix-level")
        done.append(step.filter("copies IS NOT NULL"))
        if last:
            break
        open_rows = step.filter("copies IS NULL").drop("copies").withColumn("block", F.expr(f"block div {block_rows}"))
        blocks, level = -(-blocks // block_rows), level + 1
    taken = done[0]
    for more in done[1:]:
        taken = taken.unionByName(more)
    return taken.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "mark", "source", "size", "source_size", "target", "copies"
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows equal in id and text are interchangeable: their copies are dealt
    evenly among them.
    """
    taken = mix(docs).groupBy("doc_id", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = pin(taken.withColumnsRenamed({"doc_id": "taken_id", "mark": "taken_mark"}), "mix-copies")
    ident = F.col("doc_id").cast("long")
    # the row travels whole in one column, so its own columns may have any names
    marked = docs.select(F.struct(*docs.columns).alias("row"), ident.alias("id"), F.xxhash64(ident, text_or_empty()).alias("mark"))
    joined = marked.join(taken, (F.col("mark") == F.col("taken_mark")) & F.col("id").eqNullSafe(F.col("taken_id")))
    nth = F.row_number().over(Window.partitionBy("mark", "id").orderBy(F.lit(0)))
    joined = joined.withColumn("nth", F.when(F.col("rows") > 1, nth).otherwise(1))
    times = F.expr("copies div rows + int(nth <= copies % rows)")
    return joined.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1), times.cast("int")))).select("row.*")
