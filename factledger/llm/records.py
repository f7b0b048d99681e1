"""Token ids as length-delimited binary records, with an offset index beside them.

File format, one record after another (the framing of TFRecord files)::

    uint64 length | uint32 masked CRC-32C of the length | payload | uint32 masked CRC-32C of the payload

all little-endian; masked means rotated right by 15 bits plus 0xA282EAD8. The
payload is ``int64 doc_id | uint8 id width | ids``, the ids unsigned and
little-endian; width 0 marks a document without an id (then 0 stands for it).
The index is a Parquet table ``(file, part, first_token, offset, length,
doc_id, n_tokens)``, so any record is read, in any order, with one seek;
``first_token`` counts the ids before it in its file.

Documents are dealt by range of ``doc_id`` and sorted inside a file, so the
files in order hold ascending ids; rows without an id come last. An attempt
writes a file of its own name and only the files of successful attempts are in
the index, so lost executors leave no trace in the data.

Null texts count as empty and give a record with the end id alone. Rows that
repeat a ``doc_id`` get a record each, in the order of their texts. An empty
table gives no file and an empty index. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import new_path, pin, prepare, text_or_empty
from factledger.llm.tokens import encoder

END_ID = 0
#: Target bytes of text for one file.
FILE_BYTES = 64 << 20
#: Bytes whose checksums are worked out side by side.
_BLOCK = 512
_MASK_DELTA = 0xA282EAD8  # fixed value of the format
_POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
#: A record's payload before its ids: doc_id and id width.
_HEAD = struct.Struct("<qB")

INDEX = "file string, part int, first_token long, offset long, length long, doc_id long, n_tokens long"


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_BYTE = _byte_table()


def _advance(crcs: np.ndarray, n_bytes: int) -> np.ndarray:
    """Checksums after ``n_bytes`` zero bytes (no initial value, no final xor)."""
    for _ in range(n_bytes):
        crcs = (crcs >> 8) ^ _BYTE[crcs & 0xFF]
    return crcs


# What a block of zero bytes does to each byte of a checksum, as four tables.
_STEP = [_advance(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), _BLOCK) for k in range(4)]


def _step(crcs: np.ndarray) -> np.ndarray:
    return _STEP[0][crcs & 0xFF] ^ _STEP[1][(crcs >> 8) & 0xFF] ^ _STEP[2][(crcs >> 16) & 0xFF] ^ _STEP[3][crcs >> 24]


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of every buffer.

    The checksum is linear: every buffer is padded with zero bytes in front, its
    blocks are run through side by side and joined by stepping over a block.
    The initial value is put in as ones over the first four bytes.
    """
    lengths = np.array([len(b) for b in buffers], dtype=np.int64)
    out = np.zeros(len(buffers), np.uint32)
    short = np.flatnonzero(lengths < 4)
    for i in short:
        crc = np.uint32(0xFFFFFFFF)
        for byte in buffers[i]:
            crc = (crc >> np.uint32(8)) ^ _BYTE[(int(crc) ^ byte) & 0xFF]
        out[i] = crc ^ np.uint32(0xFFFFFFFF)
    long = np.flatnonzero(lengths >= 4)
    if not len(long):
        return out
    blocks = -(-lengths[long] // _BLOCK)
    first = np.cumsum(blocks) - blocks
    data = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
    for i, end in zip(long, (first + blocks) * _BLOCK, strict=True):
        start = end - lengths[i]
        data[start:end] = np.frombuffer(buffers[i], np.uint8)
        data[start : start + 4] ^= 0xFF
    rows = np.ascontiguousarray(data.reshape(-1, _BLOCK).T)
    crcs = np.zeros(rows.shape[1], np.uint32)
    for column in rows:
        crcs = (crcs >> 8) ^ _BYTE[(crcs ^ column) & 0xFF]
    state = np.zeros(len(long), np.uint32)
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        state[live] = _step(state[live]) ^ crcs[first[live] + k]
    out[long] = state ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crcs: np.ndarray) -> np.ndarray:
    crcs = crcs.astype(np.uint64)
    return ((((crcs >> 15) | (crcs << 17)) + _MASK_DELTA) & 0xFFFFFFFF).astype("<u4")


def frames(payloads: list[bytes]) -> list[bytes]:
    """Every payload with its lengths and checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    checks = masked(crc32c(lengths + payloads))
    return [
        n + checks[i].tobytes() + p + checks[len(payloads) + i].tobytes()
        for i, (n, p) in enumerate(zip(lengths, payloads, strict=True))
    ]


def payload(doc_id: int | None, width: int, coded: bytes) -> bytes:
    return _HEAD.pack(doc_id or 0, 0 if doc_id is None else width) + coded


def unpacked(data: bytes, width: int) -> tuple[int | None, np.ndarray]:
    """``doc_id`` and ids of a payload; ``width`` holds for payloads without an id."""
    doc_id, own = _HEAD.unpack_from(data)
    return (doc_id if own else None), np.frombuffer(data, f"<u{own or width}", offset=_HEAD.size)


def parse(frames_: list[bytes]) -> list[bytes]:
    """The payloads of whole frames; a damaged one raises ``ValueError``."""
    payloads = [f[12:-4] for f in frames_]
    want = masked(crc32c([f[:8] for f in frames_] + payloads))
    for i, frame in enumerate(frames_):
        found = (frame[8:12], frame[-4:])
        if struct.unpack("<Q", frame[:8])[0] != len(payloads[i]) or found != (
            want[i].tobytes(),
            want[len(frames_) + i].tobytes(),
        ):
            raise ValueError("damaged record")
    return payloads


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as record files; returns the index, itself a written table."""
    spark = prepare(docs.sparkSession)
    folder = folder or new_path(spark, "records")
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-n_bytes // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    rows = rows.repartitionByRange(files, order[0]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        out, offset, tokens = None, 0, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        system, path = _file_system(folder)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}")
                ids = batch.column(0).to_pylist()
                end = np.array([end_id], encode.dtype).tobytes()
                coded = [c + end for c in encode.encode(batch.column(1).to_pylist())]
                width = encode.dtype.itemsize
                framed = frames([payload(i, width, c) for i, c in zip(ids, coded, strict=True)])
                lengths = np.array([len(f) for f in framed], dtype=np.int64)
                starts = offset + np.cumsum(lengths) - lengths
                out.write(b"".join(framed))
                n = len(framed)
                counts = np.array([len(c) // width for c in coded], dtype=np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([name] * n, pa.string()),
                        "part": pa.array([part] * n, pa.int32()),
                        "first_token": pa.array(tokens + np.cumsum(counts) - counts),
                        "offset": pa.array(starts),
                        "length": pa.array(lengths),
                        "doc_id": batch.column(0),
                        "n_tokens": pa.array(counts),
                    }
                )
                offset, tokens = offset + int(lengths.sum()), tokens + int(counts.sum())
        finally:
            if out is not None:
                out.close()

    return pin(rows.mapInArrow(run, INDEX).withColumn("folder", F.lit(folder)), "records-index")


def read_records(index: DataFrame, tokenizer: str) -> DataFrame:
    """``(part, first_token, doc_id, ids binary)`` of every record the index names.

    ``ids`` are little-endian unsigned 32-bit integers. Records are read by
    offset, so the index may be filtered or shuffled before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = []
            for row in batch.to_pylist():
                if opened != (row["folder"], row["file"]):
                    if stream is not None:
                        stream.close()
                    opened = (row["folder"], row["file"])
                    system, path = _file_system(row["folder"])
                    stream = system.open_input_file(f"{path}/{row['file']}")
                stream.seek(row["offset"])
                got.append(stream.read(row["length"]))
            ids, out = [], []
            for data in parse(got):
                doc_id, coded = unpacked(data, full)
                ids.append(doc_id)
                out.append(coded.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part"),
                    "first_token": batch.column("first_token"),
                    "doc_id": pa.array(ids, pa.int64()),
                    "ids": pa.array(out, pa.binary()),
                }
            )
        if stream is not None:
            stream.close()

    full = encoder(tokenizer).dtype.itemsize
    columns = index.select("folder", "file", "part", "first_token", "offset", "length")
    return columns.mapInArrow(run, "part int, first_token long, doc_id long, ids binary")


def record_digests(index: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    ``start`` counts the ids of all documents before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_py() for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part"),
                    "first_token": batch.column("first_token"),
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(d) // 4 for d in data], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(d) for d in data], pa.int64()),
                }
            )

    schema = "part int, first_token long, doc_id long, n_tokens long, ids_crc32 long"
    found = read_records(index, tokenizer).mapInArrow(run, schema)
    # one row for each file: a few numbers, however large the files are
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = pin(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")), "records-starts")
    return found.join(totals, "part").select(
        "doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32"
    )
