"""A stored text index: folded texts, and the rows of every gram, word and beginning.

Texts are folded once, when a batch is added, stored, and turned around as they
are stored: a task makes one block ``(kind, term, ids)`` of the rows of a chunk
that have a term. It lays its blocks out by term below one of ``BUCKETS`` folders,
with their numbers of rows beside them; nothing is dealt out. A query reads the folders of its own terms, intersects
their postings from the rarest on and verifies what is left on the folded text;
nothing is folded in a query but its own few characters.

A batch replaces itself when it is added again. A row that is added again in a
later batch is found by its newest text only.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from factledger.functions.text import fold, fold_text, words
from factledger.workspace import new_path, pin

BUCKETS = 64
GRAM = 3
#: Lists that are intersected before texts are read.
RAREST = 4
#: Terms of one row and of one batch of folded texts: bounds memory however long and many the texts are.
ROW_TERMS = 512
BATCH_TERMS = 1 << 16
#: Postings and characters of one chunk that is turned around, rows of one block, blocks of one batch.
CHUNK_TERMS = 1 << 20
CHUNK_CHARS = 1 << 24
BLOCK_ROWS = 1024
BATCH_BLOCKS = 1 << 14
#: Characters of the texts that one task lays out; each writes a file below every bucket.
TASK_CHARS = 1 << 26
_TERMS = "array<struct<kind: string, term: string>>"


def terms_of(folded: str) -> list[tuple[str, str]]:
    """What a folded text is found by: grams, words and its first one to three characters."""
    grams = {folded[n : n + GRAM] for n in range(len(folded) - GRAM + 1)}
    heads = {folded[:n] for n in range(1, GRAM + 1) if len(folded) >= n}
    kinds = (("gram", grams), ("word", words(folded)), ("head", heads))
    return [(kind, term) for kind, found in kinds for term in sorted(found)]


class _Batch:
    """Rows ``(id, folded, terms)`` on their way to Spark, as flat lists."""

    def __init__(self) -> None:
        self.places: list[int] = []
        self.folded: list[str | None] = []
        self.ends: list[int] = [0]
        self.kinds: list[str] = []
        self.terms: list[str] = []

    def add(self, place: int, folded: str | None, terms: Sequence[tuple[str, str]]) -> None:
        self.places.append(place)
        self.folded.append(folded)
        self.kinds.extend([kind for kind, _ in terms])
        self.terms.extend([term for _, term in terms])
        self.ends.append(len(self.terms))

    def arrow(self, idents: pa.Array) -> pa.RecordBatch:
        both = pa.StructArray.from_arrays([pa.array(self.kinds, pa.string()), pa.array(self.terms, pa.string())], ["kind", "term"])
        terms = pa.ListArray.from_arrays(pa.array(np.array(self.ends, np.int32)), both)
        columns = [idents.take(pa.array(self.places, pa.int64())), pa.array(self.folded, pa.string()), terms]
        return pa.RecordBatch.from_arrays(columns, ["id", "folded", "terms"])


def folded_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, folded, terms)`` of every row that has a text: one narrow pass.

    A text of many terms continues in further rows, whose ``folded`` is null. The
    index takes the same terms from :func:`posting_blocks`, by term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents, out = batch.column(0), _Batch()
            for place, value in enumerate(batch.column(1)):
                folded = fold_text(value.as_py())
                terms = terms_of(folded)
                for start in range(0, max(1, len(terms)), ROW_TERMS):
                    out.add(place, None if start else folded, terms[start : start + ROW_TERMS])
                if len(out.terms) >= BATCH_TERMS:
                    yield out.arrow(idents)
                    out = _Batch()
            if out.places:
                yield out.arrow(idents)

    there = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
    key_type = there.schema["id"].dataType.simpleString()
    return there.mapInArrow(run, f"id {key_type}, folded string, terms {_TERMS}")


_POINT_BITS = 21


def _gram_codes(folded: str) -> np.ndarray:
    """The distinct grams of a text as numbers: their code points side by side."""
    points = np.frombuffer(folded.encode("utf-32-le"), "<u4").astype(np.int64)
    count = max(0, len(points) - GRAM + 1)
    codes = np.zeros(count, np.int64)
    for n in range(GRAM):
        codes = codes << _POINT_BITS | points[n : n + count]
    codes.sort()
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if count else codes


def _grams(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> _POINT_BITS * n & (1 << _POINT_BITS) - 1 for n in reversed(range(GRAM))], axis=1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[n : n + GRAM] for n in range(0, len(text), GRAM)]


class _Chunk:
    """Folded texts and, by term, the rows that have it: what :func:`terms_of` gives, turned around."""

    def __init__(self) -> None:
        self.idents: list[pa.Array] = []
        self.folded: list[str] = []
        self.codes: list[np.ndarray] = []
        self.found: dict[str, list[str]] = {"word": [], "head": []}
        self.counts: dict[str, list[int]] = {"gram": [], "word": [], "head": []}
        self.terms = self.chars = 0

    def add(self, folded: str) -> None:
        codes, found = _gram_codes(folded), {"word": words(folded), "head": [folded[:n] for n in range(1, GRAM + 1) if len(folded) >= n]}
        self.folded.append(folded)
        self.codes.append(codes)
        for kind, terms in found.items():
            self.found[kind].extend(terms)
        for kind, terms in (("gram", codes), *found.items()):
            self.counts[kind].append(len(terms))
            self.terms += len(terms)
        self.chars += len(folded)

    def _by_term(self) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
        """By kind: its terms, where the rows of each begin and end, and these rows."""
        for kind, counts in self.counts.items():
            if kind == "gram":
                codes = np.concatenate(self.codes)
            else:
                numbered = pa.array(self.found[kind], pa.string()).dictionary_encode()
                codes = numbered.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            terms = pa.array(_grams(codes[starts]), pa.string()) if kind == "gram" else numbered.dictionary
            yield kind, terms, np.append(starts, len(codes)), np.repeat(np.arange(len(counts)), counts)[order]

    def arrow(self, block_rows: int) -> Iterator[pa.RecordBatch]:
        idents = pa.concat_arrays(self.idents)
        for kind, terms, ends, rows in self._by_term():
            # a block takes at most so many rows; a term of more goes on in the next
            pieces = -(-np.diff(ends) // block_rows)
            term = np.repeat(np.arange(len(terms)), pieces)
            starts = ends[term] + (np.arange(len(term)) - (np.cumsum(pieces) - pieces)[term]) * block_rows
            bounds, named = np.append(starts, ends[-1]), terms.take(pa.array(term))
            for n in range(0, len(starts), BATCH_BLOCKS):
                cut = bounds[n : n + BATCH_BLOCKS + 1]
                held = idents.take(pa.array(rows[cut[0] : cut[-1]]))
                blocks = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), held)
                kinds = pa.array([kind], pa.string()).take(pa.array(np.zeros(len(blocks), np.int64)))
                yield pa.RecordBatch.from_arrays([kinds, named.slice(n, len(blocks)), blocks], ["kind", "term", "ids"])


def posting_blocks(texts: DataFrame, chunk_terms: int = CHUNK_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(kind, term, ids)`` of folded texts ``(id, folded)``: one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            start = 0
            for place, value in enumerate(batch.column(1), 1):
                chunk.add(value.as_py())
                full = chunk.terms >= chunk_terms or chunk.chars >= CHUNK_CHARS
                if full or place == batch.num_rows:
                    # a copy: a slice would keep the batch's texts
                    chunk.idents.append(batch.column(0).take(pa.array(np.arange(start, place))))
                    start = place
                if full:
                    yield from chunk.arrow(block_rows)
                    chunk = _Chunk()
        if chunk.idents:
            yield from chunk.arrow(block_rows)

    key_type = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "folded").mapInArrow(run, f"kind string, term string, ids array<{key_type}>")


def _bucket(kind: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(kind, term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The index below one folder."""

    def __init__(self, spark: SparkSession, path: str, key_type: DataType | None = None):
        self.spark, self.path = spark, path
        self.key_type = key_type or LongType()

    def add(self, rows: DataFrame, key: str, text: str, batch: int = 0) -> None:
        """Index the rows of a batch; the same batch again replaces itself."""
        there = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")
        folded = there.select("id", fold("text").alias("folded"))
        place = f"{self.path}/texts/batch={batch}"
        folded.write.mode("overwrite").option("compression", "zstd").parquet(place)
        texts = self.spark.read.schema(folded.schema).parquet(place)
        # every task lays out its own blocks: a frequent term has some in each, and none is dealt out
        chars = texts.agg(F.sum(F.char_length("folded"))).first()[0] or 0
        blocks = posting_blocks(texts.coalesce(1 + chars // TASK_CHARS)).withColumn("bucket", _bucket(F.col("kind"), F.col("term")))
        place = f"{self.path}/postings/batch={batch}"
        laid = blocks.sortWithinPartitions("bucket", "kind", "term")
        laid.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(place)
        stored = self.spark.read.schema(blocks.schema).parquet(place)
        counts = stored.select("bucket", "kind", "term", F.size("ids").cast("long").alias("rows")).repartition("bucket")
        counts = counts.groupBy("bucket", "kind", "term").agg(F.sum("rows").alias("rows")).sortWithinPartitions("bucket", "kind", "term")
        counts.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/frequencies/batch={batch}")

    def _read(self, name: str, *fields: StructField) -> DataFrame:
        schema = StructType([*fields, StructField("batch", LongType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def texts(self) -> DataFrame:
        """``(id, folded, batch)`` of all batches."""
        return self._read("texts", StructField("id", self.key_type), StructField("folded", StringType()))

    def _of(self, rows: DataFrame, kind: str, terms: Sequence[str]) -> DataFrame:
        """The rows of a few terms, read from their folders alone."""
        wanted = F.lit(False)
        for term in terms:
            place = F.col("bucket") == _bucket(F.lit(kind), F.lit(term))
            wanted = wanted | (place & (F.col("term") == term))
        return rows.filter((F.col("kind") == kind) & wanted)

    def frequencies(self, kind: str, terms: Sequence[str]) -> dict[str, int]:
        """How many rows have each of a query's terms: one number for each."""
        fields = [StructField(c, StringType()) for c in ("kind", "term")]
        rows = self._read("frequencies", *fields, StructField("rows", LongType()), StructField("bucket", IntegerType()))
        found = self._of(rows, kind, terms).groupBy("term").agg(F.sum("rows").alias("rows"))
        return {r["term"]: r["rows"] for r in found.collect()}

    def having(self, kind: str, terms: Sequence[str], most: int | None = None) -> DataFrame:
        """``(id, batch)`` of rows that have all terms, or the ``most`` rarest of them."""
        counts = self.frequencies(kind, terms)
        fields = [StructField("kind", StringType()), StructField("term", StringType()), StructField("ids", ArrayType(self.key_type))]
        rows = self._read("postings", *fields, StructField("bucket", IntegerType()))
        ranked = sorted(set(terms), key=lambda term: (counts.get(term, 0), term))
        if not ranked or not counts.get(ranked[0]):
            return rows.filter(F.lit(False)).select(F.explode("ids").alias("id"), "batch")
        lists = [self._of(rows, kind, [term]).select(F.explode("ids").alias("id"), "batch") for term in ranked[:most]]
        found = lists[0]
        for others in lists[1:]:
            found = found.join(others, ["id", "batch"], "left_semi")
        return found

    def _newest(self, found: DataFrame | None = None) -> DataFrame:
        """``(id, folded)`` of the newest texts, of the rows found in them."""
        texts = self.texts()
        if found is not None:
            # written first: the texts are not dealt out to find a few of them
            found = pin(found, "found")
            texts = texts.join(found.select("id").distinct(), "id", "left_semi")
        newest = texts.groupBy("id").agg(F.max(F.struct("batch", "folded")).alias("n")).select("id", "n.batch", "n.folded")
        if found is not None:
            newest = newest.join(found, ["id", "batch"], "left_semi")
        return newest.select("id", "folded")

    def contains(self, query: str) -> DataFrame:
        """Rows whose text contains the query, without regard to case and accents."""
        if len(query) < GRAM:
            raise ValueError(f"contains needs at least {GRAM} characters")
        folded = fold_text(query)
        grams = [folded[n : n + GRAM] for n in range(len(folded) - GRAM + 1)]
        # what folds to fewer characters has no gram: the stored texts are scanned
        rows = self._newest(self.having("gram", grams, RAREST) if grams else None)
        return rows.filter(F.contains("folded", F.lit(folded)))

    def prefix(self, query: str, beside_selective: bool = False) -> DataFrame:
        """Rows whose text begins with the query; one character only beside a selective filter."""
        if len(query) < (1 if beside_selective else 2):
            raise ValueError("a one-character prefix needs a selective filter beside it")
        folded = fold_text(query)
        rows = self._newest(self.having("head", [folded[:GRAM]]) if folded else None)
        return rows.filter(F.startswith("folded", F.lit(folded)))

    def all_words(self, query: str) -> DataFrame:
        """Rows whose text has every word of the query; a query without a word matches nothing."""
        return self._newest(self.having("word", words(query)))


def build(rows: DataFrame, key: str, text: str, path: str | None = None) -> TextIndex:
    """A new index of ``rows``."""
    spark = rows.sparkSession
    index = TextIndex(spark, path or new_path(spark, "text-index"), rows.schema[key].dataType)
    index.add(rows, key, text)
    return index
