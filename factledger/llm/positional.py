"""Benchmark passages in documents, by a positional inverted index.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z lower-cased. The index holds every word of every document: postings
``(term, row, place)``, grouped by term within each part of the documents, so
building it shuffles nothing and no part grows with a frequent term; and the
words of each row by number, from which places can be read back. Terms stand in
the order of a number made of them: such rows are sorted without a comparison.

A test item is cut into windows of ``WINDOW`` consecutive words; one of fewer
words is a single window. A window occurs where the lists of all its terms meet
at places that differ as the terms do. Terms are taken from the rarest in the
documents on: the list of the first gives candidates, joined by equality with
those of the second and third, shifted by their offsets; the few rows left are
read back and compared whole. A window with a term that no document has can't
occur. Words inside any occurrence are hit. ``near`` asks for less: the rarest
terms of a window within some words of each other, in any order.

Null texts have no words. Rows are judged apart even where they repeat a
document or have no ``doc_id``. Items that repeat an id count once; those
without an id hit words but are not listed. Empty tables give empty results, or
documents without hits; other columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import pin, prepare, sent_if_few, text_or_empty

WINDOW = 10
#: Lists that are intersected before the words are read back.
RAREST = 3
#: Terms, or numbers of rows, that are sent to all tasks; more are shuffled.
SENT = 1_000_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN), "")


@dataclass(frozen=True)
class Index:
    """``forward (row, doc_id, words)`` and ``postings (term, row, place)``, both written."""

    forward: DataFrame
    postings: DataFrame


def build(docs: DataFrame) -> Index:
    """The index of all words of all documents."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), words(text_or_empty()).alias("words"))
    forward = pin(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "words"), "positional-words")
    postings = forward.select("row", F.posexplode("words").alias("place", "term")).select("term", "row", "place")
    return Index(forward, pin(postings.sortWithinPartitions(F.xxhash64("term")), "positional-postings"))


def windows(tests: DataFrame, width: int = WINDOW) -> DataFrame:
    """``(key, window, item_id)``: the different windows of every item; ``key`` is the window's digest."""
    items = tests.select(F.col("item_id").cast("long"), words(text_or_empty()).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.slice("words", at, size))
    each = items.select("item_id", F.explode(F.array_distinct(cut)).alias("window"))
    return each.select(F.md5(F.array_join("window", " ")).alias("key"), "window", "item_id").distinct()


def ranked_terms(index: Index, found: DataFrame) -> DataFrame:
    """``(key, width, slots)`` of windows whose terms all occur; slots ``(n, term, offset)`` from the rarest on."""
    distinct = found.select("key", "window").dropDuplicates(["key"])
    slots = distinct.select("key", F.size("window").alias("width"), F.posexplode("window").alias("offset", "term"))
    sought = pin(slots.select("term").distinct(), "positional-terms")
    counted = index.postings.join(sent_if_few(sought, SENT), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = slots.join(pin(counted, "positional-counts"), "term").groupBy("key", "width")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("slots"))
    return ranked.filter(F.size("slots") == F.col("width"))


def _lists(index: Index, chosen: DataFrame) -> DataFrame:
    """The postings of the terms in the slots of ``chosen``."""
    terms = pin(chosen.select(F.explode("slots.term").alias("term")).distinct(), "positional-chosen")
    return pin(index.postings.join(sent_if_few(terms, SENT), "term", "left_semi"), "positional-lists")


def phrases(index: Index, found: DataFrame) -> DataFrame:
    """``(row, start, width, key)``: every occurrence of every window of ``found``, exactly once."""
    chosen = ranked_terms(index, found).withColumn("slots", F.slice("slots", 1, RAREST))
    chosen = pin(chosen, "positional-slots")
    lists = _lists(index, chosen)
    rarest = F.col("slots")[0]
    at = chosen.withColumn("term", rarest["term"]).join(lists, "term").drop("term")
    at = at.withColumn("start", F.col("place") - rarest["offset"]).filter("start >= 0").drop("place")
    for k in range(1, RAREST):
        slot = F.coalesce(F.get("slots", F.lit(k)), rarest)  # windows of fewer words ask for the first again
        at = at.withColumn("term", slot["term"]).withColumn("place", F.col("start") + slot["offset"])
        at = at.join(lists, ["term", "row", "place"]).drop("term", "place")
    at = pin(at.select("row", "start", "width", "key"), "positional-candidates")
    rows = sent_if_few(pin(at.select("row").distinct(), "positional-rows"), SENT)
    read = index.forward.select("row", "words").join(rows, "row", "left_semi").join(at, "row")
    there = F.md5(F.array_join(F.slice("words", F.col("start") + 1, F.col("width")), " "))
    return read.filter(there == F.col("key")).select("row", "start", "width", "key")


def near(index: Index, tests: DataFrame, terms: int = RAREST, within: int = 20) -> DataFrame:
    """``(row, place, item_id)``: where the rarest ``terms`` different terms of a window stand together.

    ``place`` is that of the rarest one; each other one stands at most
    ``within`` words before or after it.
    """
    found = windows(tests)
    slots = F.array_sort(
        F.transform(
            F.map_entries(F.map_from_entries(F.col("firsts"))), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("term"))
        )
    )
    distinct = F.array_distinct(F.transform("slots", lambda s: F.struct(s["term"].alias("key"), s["n"].alias("value"))))
    chosen = ranked_terms(index, found).withColumn("firsts", distinct).select("key", F.slice(slots, 1, terms).alias("slots"))
    chosen = pin(chosen, "near-slots")
    lists = _lists(index, chosen)
    at = chosen.withColumn("term", F.col("slots")[0]["term"]).join(lists, "term").drop("term")
    cells = lists.select("term", "row", F.floor(F.col("place") / within).alias("cell"), F.col("place").alias("other"))
    for k in range(1, terms):
        cell = F.floor(F.col("place") / within)
        other = F.coalesce(F.get("slots", F.lit(k)), F.col("slots")[0])["term"]
        around = at.withColumn("term", other).withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        close = (F.abs(F.col("a.place") - F.col("b.other")) <= within) & (F.col("a.cell") == F.col("b.cell"))
        same = (F.col("a.term") == F.col("b.term")) & (F.col("a.row") == F.col("b.row"))
        at = around.alias("a").join(cells.alias("b"), same & close, "left_semi").drop("term", "cell").distinct()
    return at.select("key", "row", "place").join(found.select("key", "item_id"), "key").select("row", "place", "item_id").distinct()


def hits(found: DataFrame) -> DataFrame:
    """``(row, n_hit)``: how many words of a row lie inside any of its occurrences."""
    spans = found.select("row", "start", (F.col("start") + F.col("width")).alias("end")).distinct()
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), "start"))
    spans = spans.withColumn("fresh", F.greatest(fresh, F.lit(0)))
    return spans.groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))


def judge(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, items array<string>)`` of every row; ``items`` in the order of their strings."""
    index = build(docs)
    found = pin(windows(tests), "positional-windows")
    seen = pin(phrases(index, found), "positional-phrases")
    named = seen.select("row", "key").distinct().join(found.filter("item_id IS NOT NULL").select("key", "item_id"), "key")
    items = named.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = index.forward.select("row", "doc_id", F.size("words").cast("long").alias("n_words"))
    return (
        rows.join(pin(hits(seen), "positional-hits"), "row", "left")
        .join(pin(items, "positional-items"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
