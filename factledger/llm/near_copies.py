"""Near copies: documents whose sets of five-word shingles are alike.

Two texts are linked if the exact Jaccard similarity of their distinct
shingles is ``THRESHOLD`` or more. Candidates come from two methods. SimHash
fingerprints of the five-word shingles are linked at three or fewer differing
bits by the deletion variants of ``simhash``; that finds the closest copies.
Pairs of similarity 0.8 differ in up to 17 bits, which variants can't join, so
MinHash bands joined by equality find the others: such a pair shares one of
``BANDS`` bands of ``BAND_ROWS`` values with probability 0.9999.

Within a band's bucket every text is first compared with one hub, the text that
shares most buckets with most others, so many copies of one text make no pairs.
Texts that are not alike their hub are compared further by their deviations, the
shingles that only one of text and hub has. The texts A and B differ in the
shingles in which their deviations differ; if the deviations have none in common
and A and B are alike, both are alike the hub: |A xor B| >= |B xor H| + ||A| -
|H||, and that is at most (|A| + |B|) / 9 at a similarity of 0.8. So pairs that
the hub doesn't settle share a deviation. Deviations are put in one order, first
those the hub lacks, and a pair is made only where its first common one stands
early enough in both for the rest to suffice (a prefix filter with positions).
Nothing is lost by that; large groups of texts that share a passage, or have the
same origin and edits of their own, make hardly any pairs.

Words are those of ``simhash``: ASCII letters in lower case, ASCII white space
between them. A text of fewer words than a shingle is one shingle, so texts
without words are copies of each other; a null text counts as empty. Rows that
repeat a document are judged by their texts. Rows without a ``doc_id`` stay and
never name a class. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm import simhash
from factledger.llm.common import components, drained, pin, prepare, text_or_empty

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 30, 6
#: Hashes that are mixed at once: bounds memory for very long texts.
MIXED_AT_ONCE = 1 << 13
#: Shingle sets a task keeps, because pairs of one text follow each other.
KEPT_SETS = 16
#: Odd factors of the hash functions.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Columns of a text's digest.
KEY = ["key", "key2"]


def shingles(text: str, size: int = SHINGLE_WORDS) -> set[bytes]:
    """The distinct shingles of one text, at least one."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar(a: set[bytes], b: set[bytes], threshold: float = THRESHOLD) -> bool:
    shared = len(a & b)
    return shared >= threshold * (len(a) + len(b) - shared)


def bands(found: set[bytes]) -> np.ndarray:
    """One number for each band of the MinHash signature."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in found), np.uint64, len(found))
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), MIXED_AT_ONCE):
        least = np.minimum(least, (hashes[k : k + MIXED_AT_ONCE] * FACTORS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit("text"), text).alias("key2"), text.alias("text")
    )


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, key2, n, fp, bands)`` of every row; ``n`` counts the distinct shingles, ``fp`` is the SimHash."""
    prepare(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(3).to_pylist()
        sets = [shingles(t) for t in texts]
        signed = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
        counts = pa.array([len(s) for s in sets], pa.int64())
        prints = pa.array(np.array([simhash.fingerprint(t, SHINGLE_WORDS) for t in texts], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], counts, prints, signed], ["doc_id", *KEY, "n", "fp", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return drained(batches, work)

    return _texts(docs).mapInArrow(run, "doc_id long, key long, key2 long, n long, fp long, bands array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame, work, schema: str) -> DataFrame:
    """``work(a, b, shingles of a, shingles of b)`` over batches of pairs; it yields batches of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, set[bytes]] = {}

        def of(node: int, text: str) -> set[bytes]:
            if node not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.pop(next(iter(kept)))
                kept[node] = shingles(text)
            return kept[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = (
                (of(x, batch.column(2)[k].as_py()), of(y, batch.column(3)[k].as_py()))
                for k, (x, y) in enumerate(zip(a, b, strict=True))
            )
            yield work(batch, sets)

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets are alike."""

    def work(batch: pa.RecordBatch, sets: Iterator) -> pa.RecordBatch:
        alike = [similar(x, y, threshold) for x, y in sets]
        return batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return _with_texts(pairs, texts, work, "a long, b long")


def deviations(hub: set[bytes], own: set[bytes]) -> list[int]:
    """Shingles of one of the two sets, those of ``own`` first, each part in the order of its hashes."""
    return [
        h - (1 << 64) if h >> 63 else h
        for part in (own - hub, hub - own)
        for h in sorted(xxhash.xxh64_intdigest(s) for s in part)
    ]


def _deviating(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``(hub, id, n, d, at, shingle)``: the first deviations of each text ``b`` from its hub ``a``.

    ``n`` and ``d`` count the text's shingles and deviations; ``at`` is the
    deviation's place. A partner has at most n / threshold shingles, so no pair
    needs a later place than their largest allowed difference.
    """
    share = (1 - threshold) / (1 + threshold)

    def work(batch: pa.RecordBatch, sets: Iterator) -> pa.RecordBatch:
        sizes, counts, firsts = [], [], []
        for hub, own in sets:
            found = deviations(hub, own)
            sizes.append(len(own))
            counts.append(len(found))
            firsts.append(found[: int(share * len(own) * (1 + 1 / threshold) + 1e-6) + 1])
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(firsts, pa.list_(pa.int64()))], ["a", "b", "n", "d", "firsts"])

    found = _with_texts(pairs, texts, work, "a long, b long, n long, d long, firsts array<long>")
    return found.select(F.col("a").alias("hub"), F.col("b").alias("id"), "n", "d", F.posexplode("firsts").alias("at", "shingle"))


def _unsettled(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of different components that may be alike by the deviations they share.

    ``rows`` are those of ``_deviating`` with their ``component``. With the
    allowed difference L, a pair has to share o = (d_a + d_b - L) / 2
    deviations; the first one stands at most d_a - o and d_b - o places in.
    """
    share = (1 - threshold) / (1 + threshold)
    left, right = (
        rows.select("hub", "shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "d", "at", "component")]) for x in "ab"
    )
    limit = share * (F.col("n_a") + F.col("n_b")) + 1e-6
    early = (2 * F.col("at_a") <= F.col("d_a") - F.col("d_b") + limit) & (2 * F.col("at_b") <= F.col("d_b") - F.col("d_a") + limit)
    pairs = left.join(right, ["hub", "shingle"]).filter((F.col("component_a") < F.col("component_b")) & early)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _simhash_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of texts by SimHash: a fingerprint's texts with its first one, and the first ones of linked fingerprints."""
    heads = pin(distinct.groupBy("fp").agg(F.min("id").alias("head")), "near-heads")
    same = distinct.join(heads, "fp").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    close = simhash.links(heads).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    close = close.join(heads, "fp").select(F.col("head").alias("a"), F.col("other").alias("fp"))
    close = close.join(heads, "fp").select(F.least("a", "head").alias("a"), F.greatest("a", "head").alias("b"))
    return same.unionByName(close)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, key, key2, component_id)``, one row per document: the smallest id of its class."""
    signed = pin(signatures(docs), "near-signatures")
    distinct = signed.groupBy(*KEY).agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    distinct = pin(distinct.withColumn("id", F.monotonically_increasing_id()), "near-distinct")
    banded = distinct.select("id", "n", F.posexplode("bands").alias("b", "value"))
    dealt = banded.select("id", "n", F.xxhash64("b", "value").alias("band")).repartition("band")
    shared = dealt.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1")
    members = pin(dealt.join(shared, "band"), "near-buckets")
    # most rows of most buckets: the text that most others come close to
    central = members.groupBy("id").agg(F.sum("rows").alias("score"))
    hub = F.max(F.struct("score", -F.col("id"), "id", "n")).alias("hub")
    hubs = members.join(central, "id").groupBy("band").agg(hub)
    members = members.join(hubs, "band").select("id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("n_hub"))
    members = pin(members.filter("id <> hub").distinct(), "near-members")

    # false only where the numbers of shingles rule the similarity out
    possible = F.least("n", "n_hub") >= F.greatest("n", "n_hub") * threshold - 1e-6
    close = pin(_simhash_pairs(distinct), "near-simhash")
    ids = members.select("id").union(members.select("hub")).union(close.select("a")).union(close.select("b")).distinct()
    wanted = ids.join(distinct, "id").select("id", *KEY)
    texts = _texts(docs).join(wanted, KEY).select("id", "text").dropDuplicates(["id"])
    texts = pin(texts, "near-texts")
    compared = members.filter(possible).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    compared = compared.unionByName(close).distinct()
    linked = components(_verified(compared, texts, threshold), "near-components")
    placed = members.join(linked.withColumnRenamed("node", "id"), "id", "left").select(
        "hub", "id", F.coalesce("component", "id").alias("component")
    )
    placed = pin(placed, "near-placed")
    mixed = placed.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ = pin(placed.join(mixed.select("hub"), "hub"), "near-open")
    deviating = _deviating(open_.select(F.col("hub").alias("a"), F.col("id").alias("b")), texts, threshold)
    deviating = pin(deviating.join(open_, ["hub", "id"]), "near-deviations")
    later = _verified(pin(_unsettled(deviating, threshold), "near-unsettled"), texts, threshold)
    # ids of the first step's components stand for their members
    edges = later.select("a", "b").unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
    joined = components(edges, "near-joined")
    named = distinct.select("id", *KEY, "first_id").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = pin(named.withColumn("component", F.coalesce("component", "id")), "near-classes")
    heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return signed.select("doc_id", *KEY).join(named.join(heads, "component").select(*KEY, "component_id"), KEY)


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those whose class has a smaller ``doc_id``.

    Rows that repeat a ``doc_id`` are judged apart where their texts differ:
    an id stays if one of its rows stands first in a class.
    """
    found = classes(docs, threshold)
    stays = F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays")
    gone = pin(found.groupBy("doc_id").agg(stays).filter("stays = 0").select("doc_id"), "near-dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
