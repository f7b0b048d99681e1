"""How far the sources of a language differ in their words, by iceberg prefix refinement.

A term is a run of letters: characters other than ASCII ones that are no letter,
with A-Z lower-cased. A language keeps the terms of at least ``LEAST_DOCS`` of
its documents. They are found by byte prefixes: the first level counts, for
every prefix of ``FIRST_BYTES`` bytes, the documents that hold a term with it;
prefixes below the threshold are discarded, the rest are extended to ``LONGER``
times the length, until only complete terms are left. A prefix is in at least as many
documents as any term with it, so nothing is lost. Counts are made in narrow
passes over term lists that are written once, added up within a task and only
then shuffled.

Surviving prefixes reach the tasks of the next level as a sieve of ``SIEVE_BITS``
bits, whose size doesn't grow with the data. It may let a discarded prefix
through, but every level counts exactly, so the extension falls there.

Of a language's terms every occurring (language, source) group gives each one
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and the language itself q likewise;
f = floor((p - q)^2 / (p + q)). Part ``pair`` compares a group with every other
source of its language, f summed over all kept terms; terms that one of the two
or both lack are added up by how often a p occurs, not one by one. Part ``term``
names the terms that a group uses more than its language. Whole numbers
throughout; products that may exceed 64 bits are decimals.

Null text, language and source count as empty. Rows that repeat a document count
as documents. Groups without terms take part, a language without kept terms has
pairs of value 0. An empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import drained, pin, prepare, text_or_empty

LEAST_DOCS = 10
#: Bytes of the first level's prefixes, and how many times as long the next level's are.
FIRST_BYTES, LONGER = 3, 3
SIEVE_BITS = 23
TOP_TERMS = 10
#: Terms, or rows of counts, that a task handles at once.
AT_ONCE = 1 << 18

_LETTERS = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in bytes(range(256)).lower())
_ODD = np.uint64(0x9E3779B97F4A7C15)
LISTS = "lang string, source string, terms string, counts binary"


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """A task's result in pieces of moderate size."""
    yield from table.combine_chunks().to_batches(max_chunksize=1 << 15)


def _split(joined: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts that are separated by blanks, and the text of each."""
    pieces = pc.ascii_split_whitespace(joined)
    parents, flat = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.not_equal(flat, "")
    return parents.filter(real).to_numpy().astype(np.int64), flat.filter(real)


def term_lists(docs: DataFrame) -> DataFrame:
    """``(lang, source, terms, counts)``: the distinct terms of every row and how often it has them.

    One row per document: terms joined by blanks, counts as 32-bit integers.
    """
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode().translate(_LETTERS) for t in batch.column("text").to_pylist()]
        parents, flat = _split(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = flat.dictionary_encode()
        width = max(1, len(coded.dictionary))
        pairs, counts = np.unique(parents * width + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(pairs, width * np.arange(batch.num_rows + 1)).astype(np.int32)
        terms = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(pairs % width)))
        often = [pa.py_buffer(ends * np.int32(4)), pa.py_buffer(counts.astype("<i4"))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("source"),
                pc.binary_join(terms, " "),
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, *often]),
            ],
            ["lang", "source", "terms", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drained(batches, work)

    named = [text_or_empty(c).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*named).mapInArrow(run, LISTS)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of term lists together, up to about ``AT_ONCE`` terms."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column("terms").nbytes // 8
        if size >= AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _marks(names: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A mixed number of each name and of each text."""
    named, told = (pd.util.hash_array(x.to_numpy(zero_copy_only=False)) for x in (names, texts))
    return named * _ODD, told


def _places(marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of the sieve, twice for each mark."""
    for h in (marks, marks >> np.uint64(32)):
        at = h & np.uint64((1 << SIEVE_BITS) - 1)
        yield at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))


def sieve_of(found: DataFrame, term: str) -> np.ndarray:
    """The bits of all pairs ``(lang, term)`` of ``found``: a table of fixed size."""
    size = 1 << (SIEVE_BITS - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint64)
        for batch in batches:
            named, told = _marks(batch.column(0).cast(pa.binary()), batch.column(1))
            for word, bit in _places(named + told):
                np.bitwise_or.at(own, word, bit)
        word = np.flatnonzero(own)
        yield from _batches(pa.table({"word": word.astype(np.int32), "bits": own[word].view(np.int64)}))

    rows = found.select("lang", F.col(term).cast("binary")).mapInArrow(run, "word int, bits long")
    table = np.zeros(size, np.int64)
    for row in rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # at most ``size`` rows
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


class _Terms:
    """The terms of many rows: row number, language number and term of each."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.rows, terms = _split(table.column("terms").combine_chunks())
        self.terms = terms.cast(pa.binary())
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.names = langs.dictionary
        self.lang = langs.indices.to_numpy().astype(np.int64)[self.rows]

    def cut(self, keep: np.ndarray) -> None:
        self.rows, self.lang, self.terms = self.rows[keep], self.lang[keep], self.terms.filter(pa.array(keep))

    def sieved(self, sieve: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which terms have a text (a prefix of theirs) that the sieve holds for their language."""
        coded = texts.dictionary_encode()
        named, told = _marks(self.names.cast(pa.binary()), coded.dictionary)
        marks = named[self.lang] + told[coded.indices.to_numpy()]
        passed = np.ones(len(marks), bool)
        for word, bit in _places(marks):
            passed &= sieve[word] & bit != 0
        return passed

    def prefixes(self, size: int) -> pa.Table:
        """``(lang, prefix, whole, docs)``: how many rows have a prefix, or a term that is no longer."""
        whole = pc.less_equal(pc.binary_length(self.terms), size).to_numpy(zero_copy_only=False)
        coded = pc.binary_slice(self.terms, 0, size).dictionary_encode()
        width = max(1, len(coded.dictionary))
        number, distinct = pd.factorize((self.lang * width + coded.indices.to_numpy()) * 2 + whole)
        many = max(1, len(distinct))
        docs = np.bincount(pd.unique(self.rows * many + number) % many, minlength=len(distinct))
        return pa.table(
            {
                "lang": self.names.take(pa.array(distinct // 2 // width)),
                "prefix": coded.dictionary.take(pa.array(distinct // 2 % width)),
                "whole": pa.array(distinct % 2 == 1),
                "docs": pa.array(docs[: len(distinct)], pa.int64()),
            }
        )

    def sums(self, counts: np.ndarray) -> pa.Table:
        """``(lang, source, term, n)``: ``counts`` of the terms added up."""
        sources = self.table.column("source").combine_chunks().dictionary_encode()
        coded = self.terms.dictionary_encode()
        width, many = max(1, len(coded.dictionary)), len(sources.dictionary)
        source = sources.indices.to_numpy().astype(np.int64)[self.rows]
        number, distinct = pd.factorize((self.lang * many + source) * width + coded.indices.to_numpy())
        return pa.table(
            {
                "lang": self.names.take(pa.array(distinct // width // many)),
                "source": sources.dictionary.take(pa.array(distinct // width % many)),
                "term": coded.dictionary.take(pa.array(distinct % width)).cast(pa.string()),
                # whole numbers below 2^53 add up exactly
                "n": pa.array(np.bincount(number, counts, len(distinct)).astype(np.int64)[: len(distinct)]),
            }
        )


def _level(lists: DataFrame, size: int, sieve: np.ndarray | None, least: int) -> DataFrame:
    """``(lang, prefix, whole, docs)`` of the level's survivors."""
    sent = None if sieve is None else lists.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            found = _Terms(table)
            if sent is not None:
                found.cut(pc.greater(pc.binary_length(found.terms), size // LONGER).to_numpy(zero_copy_only=False))
                found.cut(found.sieved(sent.value, pc.binary_slice(found.terms, 0, size // LONGER)))
            yield from _batches(found.prefixes(size))

    counted = lists.select("lang", "terms").mapInArrow(run, "lang string, prefix binary, whole boolean, docs long")
    return counted.groupBy("lang", "prefix", "whole").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)


def kept_terms(lists: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term, docs)``: the terms that at least ``least`` rows of a language have."""
    size, sieve, kept = FIRST_BYTES, None, None
    while True:
        found = pin(_level(lists, size, sieve, least), "iceberg-level")
        whole = found.filter("whole").select("lang", F.col("prefix").cast("string").alias("term"), "docs")
        kept = whole if kept is None else kept.unionByName(whole)
        unfinished = found.filter("NOT whole")
        if unfinished.isEmpty():
            return pin(kept, "iceberg-terms")
        size, sieve = size * LONGER, sieve_of(unfinished, "prefix")


def occurrences(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, term, n, spoken)``: how often each group has each kept term that it has.

    ``spoken`` is how often the language has it.
    """
    sent = lists.sparkSession.sparkContext.broadcast(sieve_of(kept, "term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            found = _Terms(table)
            counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4")
            keep = found.sieved(sent.value, found.terms)
            found.cut(keep)
            yield from _batches(found.sums(counts[keep]))

    counted = lists.mapInArrow(run, "lang string, source string, term string, n long")
    # dealt out by term: its groups, their sum and the check for kept terms meet in one place
    added = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    added = added.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    spoken = F.sum("n").over(Window.partitionBy("lang", "term"))
    return added.select("lang", "source", "term", "n", spoken.alias("spoken"))


def _share(count: str, total: str = "total") -> Column:
    """p of a count among ``total`` occurrences of ``v`` terms; null without terms."""
    whole = f"CAST({total} + 2 * v AS DECIMAL(20, 0))"
    wide = f"(CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) div {whole}"
    # products of 64 bits where they suffice: the same numbers, sooner
    return F.expr(
        f"CASE WHEN v > 0 THEN 1 + CASE WHEN {count} < 9000000000L THEN (1000000000L * ({count} + 2)) div ({total} + 2 * v) "
        f"ELSE {wide} END END"
    )


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    return rows.withColumn("rank", F.row_number().over(order))


def _in_common(rows: pa.Table) -> pa.Table:
    """``(lang, a, b, value)``: the corrections of terms that two sources have.

    ``rows`` are ordered by language and term; every row meets the next, the one
    after that and so on within its term.
    """
    coded = [rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source")]
    lang, term, source = (c.indices.to_numpy().astype(np.int64) for c in coded)
    p, none = rows.column("p").to_numpy(), rows.column("none").to_numpy()
    many = len(coded[2].dictionary)
    added: dict[int, int] = {}
    step = 1
    while True:
        i = np.flatnonzero((lang[:-step] == lang[step:]) & (term[:-step] == term[step:]))
        if not len(i):
            break
        j = i + step

        def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (x - y) * (x - y) // (x + y)

        value = apart(p[i], p[j]) - apart(p[i], none[j]) - apart(none[i], p[j]) + apart(none[i], none[j])
        number, distinct = pd.factorize((lang[i] * many + source[i]) * many + source[j])
        # at most AT_ONCE values below 2^32: sums below 2^53 are exact
        for key, x in zip(distinct.tolist(), np.bincount(number, value).tolist(), strict=True):
            added[key] = added.get(key, 0) + int(x)
        step += 1
    keys = np.array(list(added), np.int64)
    sources = coded[2].dictionary
    return pa.table(
        {
            "lang": coded[0].dictionary.take(pa.array(keys // many // many)),
            "a": sources.take(pa.array(keys // many % many)),
            "b": sources.take(pa.array(keys % many)),
            "value": pa.array(list(added.values()), pa.int64()),
        }
    )


def _by_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their terms in tables of whole terms."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < AT_ONCE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = pc.and_(pc.equal(table["term"], table["term"][-1]), pc.equal(table["lang"], table["lang"][-1]))
        cut = pc.index(same, True).as_py()
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_terms(counts: DataFrame) -> DataFrame:
    """``(lang, a, b, value)``, ``a`` before ``b``: added up over the terms that both have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_terms(batches):
            yield from _batches(_in_common(table))

    rows = counts.select("lang", "term", "source", "p", "none").repartition("lang", "term")
    found = rows.sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, a string, b string, value long")
    least, most = F.least("a", "b"), F.greatest("a", "b")
    return found.groupBy("lang", least.alias("a"), most.alias("b")).agg(F.sum("value").alias("value"))


def pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: every two sources of a language, both ways.

    ``groups`` holds ``(lang, source, v, none)``, where ``none`` is p of a term
    that the group lacks; ``counts`` ``(lang, source, term, p, none)``. The sum over all terms is v times
    f of two lacking terms, corrected for the terms that one group has, by their
    distinct p, and for those that both have.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_item"))
    both = pin(groups.join(other, "lang").filter("source <> item"), "audit-pairs")
    lacking = _apart("none", "none_item")
    spread = counts.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    single = spread.join(both, ["lang", "source"]).select(
        "lang", "source", "item", (F.col("terms") * (_apart("p", "none_item") - lacking)).alias("value")
    )
    least, most = F.least("source", "item"), F.greatest("source", "item")
    single = single.groupBy("lang", least.alias("a"), most.alias("b")).agg(F.sum("value").alias("value"))
    whole = both.filter("source < item").select(
        "lang", F.col("source").alias("a"), F.col("item").alias("b"), (F.col("v") * lacking).alias("value")
    )
    every = whole.unionByName(single).unionByName(shared_terms(counts)).groupBy("lang", "a", "b")
    added = every.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return added.select("lang", F.inline(ways), "value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs, and the ``top`` terms of every group."""
    lists = pin(term_lists(docs), "audit-lists")
    kept = kept_terms(lists, least)
    found = pin(occurrences(lists, kept), "audit-counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = lists.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    groups = pin(groups.join(whole, "lang").withColumn("none", _share("0L")), "audit-groups")
    shares = found.join(groups, ["lang", "source"]).withColumns({"p": _share("n"), "q": _share("spoken", "all_total")})
    counts = pin(shares.select("lang", "source", "term", "p", "q", "none"), "audit-shares")
    own = counts.filter("p > q")
    terms = own.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    named = ["lang", "source", "part", "item", "value", "rank"]
    terms = _ranked(terms).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    sources = _ranked(pairs(groups.drop("total", "all_total"), counts)).withColumn("part", F.lit("pair"))
    return sources.select(*named).unionByName(terms.select(*named))
