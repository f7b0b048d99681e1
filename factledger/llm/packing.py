"""Packing by concatenate and cut.

All documents, each followed by the end id, are one long row of tokens that is
cut into windows of ``length``; only the last window can be short, and is
padded. Two passes: the first encodes every text once and writes its ids with
its place in its partition; the partition totals give every partition its
global offset by a prefix sum; the second cuts each document at the window
borders. A document that crosses a border gives a piece on both sides. The
order of documents is that of the written partitions.

A null or empty text is a document of the end id alone. Rows that repeat a
document are packed as documents of their own. Longer documents than a window
take several. An empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import pin, prepare, text_or_empty
from factledger.llm.tokens import encoder

LENGTH = 4096
END_ID = 2

_ENCODED = "part int, first long, doc_id long, n long, ids binary"
_PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """First pass, written: the ids of every document and its place in its partition."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, first = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encode.dtype).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = [c + end for c in encode.encode(batch.column(1).to_pylist())]
            counts = np.array([len(c) for c in coded], dtype=np.int64) // encode.dtype.itemsize
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * len(coded), pa.int32()),
                    "first": pa.array(first + np.cumsum(counts) - counts),
                    "doc_id": batch.column(0),
                    "n": pa.array(counts),
                    "ids": pa.array(coded, pa.binary()),
                }
            )
            first += int(counts.sum())

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return pin(rows.mapInArrow(run, _ENCODED), "pack-encoded")


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` holds its little-endian 32-bit ids, null unless asked for."""
    table = encoded(docs, tokenizer, end_id)
    # one row for each partition: a few numbers, however large the partitions are
    totals = table.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = pin(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")), "pack-offsets")
    placed = table.join(totals, "part").select(
        "doc_id", (F.col("before") + F.col("first")).alias("at"), F.col("n"), "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, at, n, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")
                start = 0
                while start < n:
                    window, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    cut = ids[start : start + size].tobytes()
                    out.append((doc_id, start, size, zlib.crc32(cut), n, window, offset, cut if with_ids else None))
                    start += size
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    return placed.mapInArrow(run, _PIECE)


def sequences(found: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, ids array<int>, n_tokens, boundaries)``: whole windows from pieces with ids.

    ``boundaries`` are the offsets where a document's piece starts. A window
    holds at most ``length`` ids, so no group can grow beyond it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for seq, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = b"".join(p["ids"] for p in parts)
                ids = np.full(length, pad_id, np.int32)
                ids[: len(data) // 4] = np.frombuffer(data, "<u4")
                out.append((seq, ids, len(data) // 4, [p["offset"] for p in parts]))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["sequence_id", "ids", "n_tokens", "boundaries"],
            )

    parts = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    return found.groupBy("sequence_id").agg(parts).mapInArrow(
        run, "sequence_id long, ids array<int>, n_tokens long, boundaries array<long>"
    )
