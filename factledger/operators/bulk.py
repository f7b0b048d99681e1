"""Bulk matching of a user's list against the registry, as joins.

A list may be as long as the registry: nothing of it is collected or shipped
whole, and the optimiser chooses the join. Every match function returns links
``(input_id, entity)``; entries with an error and null values take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions.contact import check_digits_11, check_digits_14, clean_document, normalize_phones
from factledger.functions.text import fold, fold_text
from factledger.workspace import pin

MODES = ("eq", "prefix", "contains")
SHORTEST = 3
#: Document types whose numbers carry check digits.
SCHEMES: dict[str, Callable[[Column], Column]] = {"CPF": check_digits_11, "CNPJ": check_digits_14}

#: Whole texts folded at once: bounds a worker's memory.
FOLDED_AT_ONCE = 64

_GRAMS = r"(?s)(?=(.{%d}))"


def with_errors(entries: DataFrame) -> DataFrame:
    """Entries with the reason one cannot be matched; an ``input_id`` names one entry."""
    repeated = entries.groupBy("input_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    known = F.coalesce(F.col("mode").isin(*MODES), F.lit(False))
    error = (
        F.when(F.coalesce("value", F.lit("")) == "", "empty_entry")
        .when(~known, "unknown_mode")
        .when((F.col("mode") == "contains") & (F.char_length("value") < SHORTEST), "text_too_short")
        .when(F.col("_n").isNotNull(), "repeated_input_id")
    )
    return entries.join(repeated, "input_id", "left").withColumn("error", error).drop("_n")


def with_document_errors(entries: DataFrame) -> DataFrame:
    """The same for entries ``(input_id, document_type, value)`` of document numbers."""
    number = clean_document(F.col("value"))
    wrong = F.lit(False)
    for kind, valid in SCHEMES.items():
        wrong = wrong | ((F.col("document_type") == kind) & ~valid(number))
    checked = with_errors(entries.withColumn("mode", F.lit("eq"))).drop("mode")
    return checked.withColumn("error", F.coalesce("error", F.when(F.coalesce(wrong, F.lit(False)), "document_invalid")))


def _asked(entries: DataFrame, mode: str) -> DataFrame:
    usable = entries.filter(F.col("error").isNull() & (F.col("mode") == mode))
    return usable.select("input_id", fold("value").alias("_asked"))


def match_equal(entries: DataFrame, registry: DataFrame, entity: str, value: str) -> DataFrame:
    """Links by equality of the folded value."""
    have = registry.select(entity, fold(value).alias("_asked"))
    return have.join(_asked(entries, "eq"), "_asked").select("input_id", entity)


def match_prefix(entries: DataFrame, registry: DataFrame, entity: str, value: str) -> DataFrame:
    """Links where the folded value starts with the folded entry.

    Both sides are cut to a power of two: the entry to the largest one it holds,
    the value to every one it holds, so a value gives a logarithmic number of
    rows and short and long entries meet it by equality.
    """

    def power(length: Column) -> Column:
        return F.pow(F.lit(2), F.floor(F.log2(length))).cast("int")

    def head(column: str, length: Column) -> Column:
        return F.substring(F.col(column), F.lit(1), length)

    asked = _asked(entries, "prefix").withColumn("_cut", power(F.char_length("_asked")))
    asked = asked.select("input_id", "_asked", "_cut", head("_asked", F.col("_cut")).alias("_head"))
    folded = registry.select(entity, fold(value).alias("_text")).filter("_text <> ''")
    exponents = F.sequence(F.lit(0), F.floor(F.log2(F.char_length("_text"))).cast("int"))
    cuts = folded.select(entity, "_text", F.explode(exponents).alias("_e"))
    cuts = cuts.select(entity, "_text", F.pow(F.lit(2), "_e").cast("int").alias("_cut"))
    cuts = cuts.withColumn("_head", head("_text", F.col("_cut")))
    return cuts.join(asked, ["_cut", "_head"]).filter(F.startswith("_text", "_asked")).select("input_id", entity)


def _folded_texts(registry: DataFrame, entity: str, value: str) -> DataFrame:
    """``(<entity>, _text)``: the folded texts of a column of long texts, few at a time; null values left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FOLDED_AT_ONCE):
                part = batch.slice(start, FOLDED_AT_ONCE)
                folded = pa.array([fold_text(text) for text in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), folded], [entity, "_text"])

    texts = registry.select(entity, F.col(value).alias("_text")).filter(F.col("_text").isNotNull())
    return texts.mapInArrow(run, f"`{entity}` {texts.schema[entity].dataType.simpleString()}, _text string")


def match_contains(entries: DataFrame, registry: DataFrame, entity: str, value: str) -> DataFrame:
    """Links where the folded text contains the folded entry.

    An entry is looked up by that one of its trigrams which the fewest texts
    hold, then verified against the text. Texts are folded and written once;
    of their distinct trigrams only those that some entry has are kept. Texts
    and entries meet by equality, so adaptive execution splits a hot trigram.
    An entry that folds to one or two characters is looked up as a gram of its
    own length; one that folds to none is in every text, so every text gets a
    gram without characters for it if there is such an entry.
    """
    rows = pin(
        _folded_texts(registry, entity, value)
        .withColumn("_row", F.monotonically_increasing_id()),
        "bulk-texts",
    )
    asked = pin(_asked(entries, "contains"), "bulk-entries")

    def grams(column: str, size: int = SHORTEST) -> Column:
        return F.array_distinct(F.regexp_extract_all(column, F.lit(_GRAMS % size), F.lit(1)))

    wanted = asked.select("input_id", F.explode(grams("_asked")).alias("_gram"))
    held = rows.select("_row", F.explode(grams("_text")).alias("_gram"))
    held = pin(held.join(wanted.select("_gram").distinct(), "_gram", "left_semi"), "bulk-trigrams")
    texts = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # an entry with a trigram that no text holds is in no text
    rated = wanted.join(texts, "_gram", "left")
    best = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_best")
    rare = rated.groupBy("input_id").agg(best).filter("_best._n > 0").select("input_id", F.col("_best._gram").alias("_gram"))
    candidates = held.join(rare.join(asked, "input_id"), "_gram").select("_row", "input_id", "_asked")
    found = candidates.join(rows, "_row").filter(F.contains("_text", "_asked")).select("input_id", entity)
    lengths = asked.agg(F.collect_set(F.least(F.char_length("_asked"), F.lit(SHORTEST)))).first()[0]  # at most four numbers
    for size in sorted(set(lengths) - {SHORTEST}):
        short = asked.filter(F.char_length("_asked") == size).withColumnRenamed("_asked", "_gram")
        own = grams("_text", size) if size else F.array(F.lit(""))
        more = rows.select(entity, F.explode(own).alias("_gram")).join(short, "_gram")
        found = found.unionByName(more.select("input_id", entity))
    return found


def match_document(entries: DataFrame, registry: DataFrame, entity: str, kind: str, number: str) -> DataFrame:
    """Links by document type and cleaned number."""
    asked = entries.filter(F.col("error").isNull()).select(
        "input_id", F.col("document_type").alias("_kind"), clean_document(F.col("value")).alias("_number")
    )
    have = registry.select(entity, F.col(kind).alias("_kind"), clean_document(F.col(number)).alias("_number"))
    return have.join(asked, ["_kind", "_number"]).select("input_id", entity)


def _phones(rows: DataFrame, rollout: DataFrame) -> DataFrame:
    """Rows with the number that the phone rules give, or the text they leave for review."""
    empty = F.lit(None).cast("string")
    shaped = rows.withColumns({"area": empty, "extension": empty})
    ruled = normalize_phones(shaped, rollout)
    return ruled.withColumn("_number", F.coalesce("canonical_number", F.regexp_replace("raw", r"[\s().-]", "")))


def match_phone(entries: DataFrame, registry: DataFrame, entity: str, rollout: DataFrame) -> DataFrame:
    """Links by phone number: ``value, country`` of entries, ``raw, country`` of the registry."""
    asked = entries.filter(F.col("error").isNull()).select("input_id", F.col("value").alias("raw"), "country")
    asked = _phones(asked, rollout).select("input_id", "_number")
    have = _phones(registry.select(entity, "raw", "country"), rollout).select(entity, "_number")
    return have.join(asked, "_number").select("input_id", entity)


def entry_status(entries: DataFrame, links: DataFrame) -> DataFrame:
    """invalid / found / not_found with the number of matches per entry."""
    counts = links.groupBy("input_id").agg(F.count(F.lit(1)).alias("found"))
    joined = entries.join(counts, "input_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    state = F.when(F.col("error").isNotNull(), "invalid").when(F.col("found") > 0, "found").otherwise("not_found")
    return joined.withColumn("state", state)


def selection(registry: DataFrame, links: DataFrame, entity: str, condition: Column) -> DataFrame:
    """Registry rows hit by any entry and passing the global filter, once each."""
    return registry.filter(condition).join(links.select(entity), entity, "left_semi")
