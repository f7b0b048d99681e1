"""Near duplicates by SimHash with deletion-variant signatures.

A fingerprint is cut into two halves, so two fingerprints that differ in at
most three bits have a half that differs in at most one. Every half is indexed
whole and once for each bit as a wildcard; an equality join on these variants
finds every such pair, and the full fingerprints are compared after it.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other. Rows that repeat a document
share its fingerprint and class. Rows without a ``doc_id`` keep their row and
never name a class (``component_id`` is null where no member has an id). An
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import components, drained, pin, prepare, text_or_empty

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Variants shared by more fingerprints than this are cut further before pairing.
BUCKET_ROWS = 128
#: Free bits at which a bucket is small by itself: at most 16 x 16 fingerprints.
LAST_WIDTH = 4
#: Hashes whose bits are counted at once: bounds memory for very long texts.
COUNTED_AT_ONCE = 1 << 16


def fingerprint(text: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text, as an unsigned number."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    last = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, last, COUNTED_AT_ONCE):
        stop = min(start + COUNTED_AT_ONCE, last)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(start, stop)]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp long)`` of every row of ``documents``."""
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drained(batches, work)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """Variants of both halves of the free bits of ``(fp, key, low)``.

    ``low`` is where the free bits start. The exact half is position
    ``width / 2``; at a wildcard only rows of different ``side`` are paired,
    because equal halves already meet at the exact position.
    """
    half = width // 2
    mask = F.lit((1 << half) - 1).cast("long")
    places = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h in (0, 1) for p in range(half + 1)])
    start = F.col("low") + F.col("v.h") * half

    piece = F.call_function("shiftrightunsigned", F.col("fp"), start.cast("int")).bitwiseAND(mask)
    bit = F.when(F.col("v.p") < half, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v.p"))).otherwise(
        F.lit(0).cast("long")
    )
    side = piece.bitwiseAND(bit)
    return rows.withColumn("v", F.explode(places)).select(
        "fp",
        F.xxhash64("key", "low", "v.h", "v.p", piece.bitwiseXOR(side)).alias("key"),
        (F.col("low") + (1 - F.col("v.h")) * half).alias("low"),
        F.when(F.col("v.p") == half, 2).otherwise((side != 0).cast("int")).alias("side"),
    )


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints that differ in few bits.

    No pairs are made inside a bucket of many fingerprints: its free bits are
    cut again, which holds at most 256 fingerprints a bucket at the last cut.
    """
    if max_bits > 3:
        raise ValueError("two halves with one wildcard reach three differing bits")
    rows = prints.select("fp").distinct().select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("low"))
    width, found = 64, []
    while True:
        dealt = _cut(rows, width).repartition("key")
        width //= 2
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        shared = pin(dealt.join(sizes, "key"), "simhash-variants")
        small = shared if width <= LAST_WIDTH else shared.filter(F.col("n") <= bucket_rows)
        left = small.select("key", F.col("fp").alias("a"), F.col("side").alias("side_a"))
        right = small.select("key", F.col("fp").alias("b"), F.col("side").alias("side_b"))
        pairs = left.join(right, "key").filter(
            "side_a = 2 AND side_b = 2 AND a < b OR side_a = 0 AND side_b = 1"
        )
        close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
        found.append(
            pairs.filter(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        rows = shared.filter(F.col("n") > bucket_rows).select("fp", "key", "low")
        if width <= LAST_WIDTH or rows.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document."""
    prints = pin(fingerprints(docs), "simhash-prints")
    classes = components(links(prints, max_bits), "simhash-components")
    known = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    named = known.join(classes.withColumnRenamed("node", "fp"), "fp", "left")
    named = pin(named.withColumn("component", F.coalesce("component", "fp")), "simhash-classes")
    heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(heads, "component").select("fp", "component_id"), "fp")


def hexadecimal(fp: str = "fp") -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without those whose class has a smaller ``doc_id``.

    Rows that repeat a ``doc_id`` are judged apart where their texts differ:
    an id stays if one of its rows stands first in a class.
    """
    found = near_duplicates(docs, max_bits)
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")
    gone = pin(found.groupBy("doc_id").agg(stays).filter("stays = 0").select("doc_id"), "simhash-dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
