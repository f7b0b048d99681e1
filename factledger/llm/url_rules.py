"""URL rules from a sorted digest array.

Every rule is a host and a path prefix with a verdict. Rules are hashed with
64-bit xxHash and written as shards of the hash space: a sorted array of
digests, which workers memory-map, and the full strings beside it. For a URL,
the keys of all its host suffixes and of the path prefixes whose lengths occur
in the list are made, hashed and looked up by binary search over the whole
batch at once; a hit counts only if the stored string is the key, so collisions
change nothing. The longest rule wins.

The list is hashed, sorted and written by Spark, never gathered on the driver.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end. A null URL, or one
without ``://``, has an empty host and path and fits no rule. A URL that fits
no rule has the default verdict. Rows that repeat a URL are judged alike. Of
rules that repeat a key the verdict ``block`` stays; rules without a host or a
verdict are ignored. Empty tables give empty results or the default verdict.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import new_path, pin, prepare
from factledger.llm.records import _file_system

#: Shards of the digest array, by the top bits of the hash: 2**SHARD_BITS files at least.
SHARD_BITS = 4
#: Rules of one shard on average, at most.
SHARD_RULES = 250_000
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def bits_for(n_rules: int, shard_rules: int = SHARD_RULES) -> int:
    """Bits of the hash that name a shard, so that shards stay small at any number of rules."""
    return max(SHARD_BITS, (max(0, n_rules - 1) // shard_rules).bit_length())


def build(rules: DataFrame, folder: str | None = None, shard_bits: int | None = None) -> DataFrame:
    """Write the digest array of ``(host, path, verdict)``; returns its shards.

    One row per shard: ``(folder, shard, name, path_lengths, shard_bits)``.
    Without ``shard_bits`` the rules are counted.
    """
    spark = prepare(rules.sparkSession)
    if shard_bits is None:
        shard_bits = bits_for(rules.count())
    folder = folder or new_path(spark, "url-digests")
    host = F.translate("host", _UPPER, _LOWER)  # as the hosts of urls are read
    key = F.concat(host, F.coalesce("path", F.lit("")))
    keys = (
        rules.filter("host IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(key.alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("path_length"))
        .agg(F.max("verdict").alias("verdict"))
    )

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            values = np.array([xxhash.xxh64_intdigest(k) for k in frame["key"]], dtype=np.uint64)
            yield frame.assign(digest=values.view(np.int64), shard=(values >> np.uint64(64 - shard_bits)).astype(np.int32))

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(_unsigned=frame["digest"].to_numpy().view(np.uint64)).sort_values(["_unsigned", "key"])
        name = f"{int(frame['shard'].iloc[0]):05d}-{uuid.uuid4().hex}"
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        texts = [f"{v}\t{k}".encode() for v, k in zip(frame["verdict"], frame["key"], strict=True)]
        ends = np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
        for kind, data in (
            ("digests", frame["_unsigned"].to_numpy()),
            ("ends", ends),
            ("texts", np.frombuffer(b"".join(texts), np.uint8)),
        ):
            with system.open_output_stream(f"{path}/{name}.{kind}.npy") as out:
                sink = pa.BufferOutputStream()
                np.save(sink, data)
                out.write(sink.getvalue())
        lengths = sorted(set(int(n) for n in frame["path_length"]))
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "name": [name], "path_lengths": [lengths]})

    hashed = keys.mapInPandas(digests, "key string, path_length int, verdict string, digest long, shard int")
    shards = hashed.groupBy("shard").applyInPandas(write, "shard int, name string, path_lengths array<int>")
    return pin(shards.withColumns({"folder": F.lit(folder), "shard_bits": F.lit(shard_bits)}), "url-shards")


@functools.lru_cache(maxsize=64)
def _mapped(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's arrays, memory-mapped; stores that aren't mounted are copied first."""
    system, path = _file_system(folder)
    if system.type_name != "local":
        local = os.path.join(tempfile.gettempdir(), hashlib.sha256(folder.encode()).hexdigest()[:16])
        os.makedirs(local, exist_ok=True)
        for kind in ("digests", "ends", "texts"):
            with system.open_input_stream(f"{path}/{name}.{kind}.npy") as source:
                with open(f"{local}/{name}.{kind}.npy.{os.getpid()}", "wb") as copy:
                    copy.write(source.read())
            os.replace(f"{local}/{name}.{kind}.npy.{os.getpid()}", f"{local}/{name}.{kind}.npy")
        path = local
    return tuple(np.load(f"{path}/{name}.{kind}.npy", mmap_mode="r") for kind in ("digests", "ends", "texts"))


class DigestArray:
    """Lookups in the shards of one list."""

    def __init__(self, folder: str, names: dict[int, str], path_lengths: list[int], shard_bits: int):
        self.folder, self.names, self.path_lengths, self.shard_bits = folder, names, path_lengths, shard_bits

    def probe(self, keys: list[str]) -> list[str | None]:
        """The verdict of every key, or None: binary search, then the stored string."""
        values = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        shards = (values >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        out: list[str | None] = [None] * len(keys)
        for shard in np.unique(shards):
            if (name := self.names.get(int(shard))) is None:
                continue
            digests, ends, texts = _mapped(self.folder, name)
            asked = np.flatnonzero(shards == shard)
            places = np.searchsorted(digests, values[asked], side="left")
            inside = places < len(digests)
            asked, places = asked[inside], places[inside]
            same = digests[places] == values[asked]
            for i, at in zip(asked[same], places[same], strict=True):
                while at < len(digests) and digests[at] == values[i]:
                    verdict, key = texts[ends[at] : ends[at + 1]].tobytes().decode().split("\t", 1)
                    if key == keys[i]:
                        out[i] = verdict
                        break
                    at += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """The longest rule of every URL with its verdict, or a pair of None."""
        keys: dict[str, int] = {}
        asked: list[list[tuple[int, int]]] = []
        for host, path in zip(hosts, paths, strict=True):
            own: list[tuple[int, int]] = []
            labels = host.split(".") if host else []
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in self.path_lengths:
                    if n <= len(path):
                        key = suffix + path[:n]
                        own.append((len(key), keys.setdefault(key, len(keys))))
            asked.append(own)
        verdicts = self.probe(list(keys))
        names = list(keys)
        out = []
        for own in asked:
            fits = [(n, k) for n, k in own if verdicts[k] is not None]
            best = max(fits, key=lambda fit: fit[0])[1] if fits else None  # of equal lengths the longer host
            out.append((None, None) if best is None else (names[best], verdicts[best]))
        return out


def judge(pages: DataFrame, shards: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` for every row of ``pages``.

    What tasks are told of the list is one short row per shard; the bits that name one are stored with it.
    """
    prepare(pages.sparkSession)
    known = shards.collect()
    lengths = sorted({n for row in known for n in row["path_lengths"]})
    shard_bits = known[0]["shard_bits"] if known else SHARD_BITS
    array = DigestArray(known[0]["folder"] if known else "", {r["shard"]: r["name"] for r in known}, lengths, shard_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = array.judge(frame["host"].tolist(), frame["path"].tolist())
            yield frame.assign(
                rule=pd.array([r for r, _ in found], dtype=object), verdict=[v or default for _, v in found]
            )

    rows = pages.select("page_id", "url", host_of().alias("host"), path_of().alias("path"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, path string"
    return rows.mapInPandas(run, f"{schema}, rule string, verdict string")
