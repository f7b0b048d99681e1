"""Runs of words that repeat with a period, by minimizers at several scales.

Words are separated by ASCII white space. A run is a stretch of consecutive
words with smallest period q (words q apart are equal) that no neighbouring word
extends and whose length is at least ``LEAST_WORDS`` and ``LEAST_TIMES`` * q.
Dropping all words of a run after its first q collapses it.

Periods up to ``LAGS`` are found by comparing words that many places apart.
Longer ones are dealt to scales: one for periods ``low`` to ``high`` takes
shingles of k = ``high`` words and, from every window of w = 2 * ``low`` -
``high`` + 1 of them, the least by a mixed number. Inside a run of a period q of
that scale two windows q apart hold the same shingles, because w + k - 1 + q is
at most 3q, so the least of one is the least of the other q words on. Between
the two the shingle can't occur: a shingle of k >= q words at distance d < q
would give the run the period gcd(d, q). So every run has a pair of neighbouring
equal minimizers at distance q, and looking at neighbours alone misses none.
Pairs whose distance suits the scale are extended over equal words both ways;
shingles are exact numbers, not hashes, and the extension is exact too.

A batch of texts is handled as one row of numbers, longest text first, so that
the texts that can hold a period of the scale stand in front. Texts without a
repeated shingle of the scale's next power of two take no further part.

Null texts count as empty; texts without words have no run and collapse to the
empty text. Rows stay as they are, repeated or without ``doc_id``; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import drained, prepare, text_or_empty

LEAST_WORDS = 24
LEAST_TIMES = 3
#: Periods up to this are compared directly; LEAST_WORDS is at least LEAST_TIMES times as long.
LAGS = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
RUN = "array<struct<start: long, length: long, period: long>>"


def _numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs, from 0 and without gaps."""
    return pd.factorize(left * (int(right.max(initial=0)) + 1) + right)[0]


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (or largest) of every ``width`` consecutive values."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = least(out[: len(out) - step], out[step:])
        done += step
    return out


def minimizers(keys: np.ndarray, width: int) -> np.ndarray:
    """Places whose mixed number is the least of some ``width`` consecutive ones."""
    mixed = keys.astype(np.uint64) * _ODD
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    least = _sliding(mixed, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == mixed)


def _equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def _long_enough(length: int, period: int) -> bool:
    return length >= max(LEAST_WORDS, LEAST_TIMES * period)


def _by_lag(words: np.ndarray, period: int) -> Iterator[tuple[int, int, int]]:
    """``(start, length, period)`` of stretches whose words agree ``period`` apart."""
    ends = np.concatenate([[-1], np.flatnonzero(words[:-period] != words[period:]), [len(words) - period]])
    for k in np.flatnonzero(np.diff(ends) > LEAST_WORDS - period):
        yield int(ends[k]) + 1, int(ends[k + 1] - ends[k]) - 1 + period, period


def _by_minimizers(words: np.ndarray, keys: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """The same for periods ``low`` to ``high``; ``keys`` number the shingles of ``high`` words."""
    places = minimizers(keys, 2 * low - high + 1)
    order = np.argsort(keys[places], kind="stable")
    at, same = places[order], np.diff(keys[places][order]) == 0
    apart = np.diff(at)
    seeds = np.flatnonzero(same & (apart >= low) & (apart <= high))
    last = (0, 0)
    for period, place in sorted(zip(apart[seeds].tolist(), at[seeds].tolist(), strict=True)):
        if last[0] == period and place < last[1]:
            continue  # inside the stretch just found
        after = _equal_words(words[place:], words[place + period :])
        before = _equal_words(words[:place][::-1], words[: place + period][::-1])
        last = (period, place + after)
        yield place - before, before + after + period, period


def stretches(words: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs among the ``words`` of texts that follow each other.

    ``texts`` has the length of each text, longest first; words of different
    texts have different numbers.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(runs: Iterator[tuple[int, int, int]], origin: np.ndarray | None = None) -> None:
        for start, length, period in runs:
            if _long_enough(length, period):
                start = start if origin is None else int(origin[start])
                found[start, length] = min(period, found.get((start, length), period))

    live = int(texts[: np.searchsorted(-texts, -LEAST_WORDS, side="right")].sum())
    words, texts = words[:live], texts[: np.searchsorted(-texts, -LEAST_WORDS, side="right")]
    for period in range(1, min(LAGS, live - 1) + 1):
        keep(_by_lag(words, period))
    # origin: the place in the batch of every word that still takes part
    origin, grams, size, low = np.arange(live), words, 1, LAGS + 1
    while True:
        high = low * 3 // 2
        many = int(np.searchsorted(-texts, -LEAST_TIMES * low, side="right"))
        texts, live = texts[:many], int(texts[:many].sum())
        words, grams, origin = words[:live], grams[:live], origin[:live]
        while size * 2 <= high and live > 2 * size:
            # beyond the end a shingle is that of the place alone
            grams = np.concatenate([_numbered(grams[: live - size], grams[size:]), live + np.arange(size)])
            size *= 2
            often = np.bincount(grams)[grams] > 1
            starts = np.cumsum(texts) - texts
            alive = np.add.reduceat(often, starts) > 0 if len(texts) else np.zeros(0, bool)
            stay = np.repeat(alive, texts)
            words, grams, origin, texts = words[stay], grams[stay], origin[stay], texts[alive]
            live = len(words)
        if live < LEAST_TIMES * low:
            return [(start, length, period) for (start, length), period in found.items()]
        shift = high - size
        keys = _numbered(grams[: live - shift], grams[shift:])[: live - high + 1]
        keep(_by_minimizers(words, keys, low, high), origin)
        low = high + 1


def _work(batch: pa.RecordBatch) -> pa.RecordBatch:
    pieces = pc.ascii_split_whitespace(batch.column("text").cast(pa.string()))
    parents, flat = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.not_equal(flat, "")
    parents, flat = parents.filter(real).to_numpy(), flat.filter(real)
    sizes = np.bincount(parents, minlength=batch.num_rows)
    starts = np.cumsum(sizes) - sizes
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    places = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in order])
    own = _numbered(parents[places].astype(np.int64), ids[places])
    runs: list[list[dict]] = [[] for _ in sizes]
    gone = np.zeros(len(flat), bool)
    for start, length, period in stretches(own, sizes[order]):
        place = int(places[start])
        k = int(parents[place])
        runs[k].append({"start": place - int(starts[k]), "length": length, "period": period})
        gone[place + period : place + length] = True
    # one joined text for each row: cut the kept words anew into rows
    kept = np.bincount(parents[~gone], minlength=batch.num_rows)
    offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(pa.array(~gone))), " ")
    for own_runs in runs:
        own_runs.sort(key=lambda r: (r["start"], r["period"]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, kind), collapsed],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed)`` of every row.

    ``runs`` is ordered by start, then period; word numbers count from 0.
    ``collapsed`` joins the kept words by one space.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drained(batches, _work)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def foremost(runs: Column) -> Column:
    """Of runs in order the one with the greatest length / period, the first of equal ones."""

    def better(a: Column, b: Column) -> Column:
        return b["length"] * a["period"] > a["length"] * b["period"]

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | better(a, b), b).otherwise(a))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where the tails of a tenth of the texts are made periodic.

    With h the crc32 of the id's decimal text, g = floor(h / 10) and n words: if
    h is divisible by 10, word i >= a becomes word a + (i - a) % p, where
    a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other texts, texts
    without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    spaced = F.array_remove(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, spaced))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    tail = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
