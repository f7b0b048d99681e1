"""The text index against folding and searching every text."""

import random
import re

import pytest

from factledger.functions.text import fold_text
from factledger.operators import textindex

QUERIES = ["Réaux", "the", "STRASSE", "ß a", "éé ", "zzz", "a b c", "ña", "ffi"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    stock = ["Réaux", "reaux", "the", "Straße", "STRASSE", "ab", "É", "a", "b", "c", "ña", "nña", "ﬃ", "office", "x_y", "漢字", "the_end", "́"]
    texts = {k: " ".join(rng.choice(stock) for _ in range(rng.randrange(14))) for k in range(200)}
    return texts | {300: "", 301: None, 302: "a", 303: "éa", 304: "the " * 500}


def searched(texts, test):
    return {k for k, text in texts.items() if text is not None and test(fold_text(text))}


def ids(rows):
    found = [r["id"] for r in rows.collect()]
    assert len(found) == len(set(found))
    return set(found)


def has_words(text, query):
    return bool(wanted := re.findall(r"[^\W_]+", fold_text(query))) and set(wanted) <= set(re.findall(r"[^\W_]+", text))


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, id int, folded string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    return textindex.build(frame(spark, corpus), "doc_id", "text")


@pytest.mark.parametrize("query", QUERIES)
def test_queries_equal_a_search_of_all_texts(corpus, index, query):
    assert ids(index.contains(query)) == searched(corpus, lambda text: fold_text(query) in text)
    assert ids(index.prefix(query)) == searched(corpus, lambda text: text.startswith(fold_text(query)))
    assert ids(index.all_words(query)) == searched(corpus, lambda text: has_words(text, query))


def test_short_queries(corpus, index):
    assert ids(index.contains("́é")) == searched(corpus, lambda text: "e" in text)  # folds to one character
    assert ids(index.prefix("É", beside_selective=True)) == searched(corpus, lambda text: text.startswith("e"))
    assert ids(index.all_words(" .,_ ")) == set()
    for call in (lambda: index.contains("ab"), lambda: index.prefix("a")):
        with pytest.raises(ValueError):
            call()


def test_a_query_folds_nothing_and_reads_its_folders_alone(index):
    plan = index.contains("reaux")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    files = index._of(index._read("postings", *POSTING), "gram", ["rea"]).inputFiles()
    all_files = index._read("postings", *POSTING).inputFiles()
    assert len(all_files) > 20
    touched = {f.split("bucket=")[1].split("/")[0] for f in index._of(index._read("postings", *POSTING), "gram", ["rea"]).select(
        textindex.F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(touched) == 1 and files


def test_long_texts_go_on_in_further_rows_of_bounded_batches(spark):
    rng = random.Random(3)
    texts = {k: " ".join(f"{rng.randrange(10**9):x}é" for _ in range(700)) for k in range(40)} | {50: ""}
    rows = textindex.folded_rows(frame(spark, texts), "doc_id", "text")
    most = rows.selectExpr("max(size(terms)) AS n", "count_if(folded IS NOT NULL) AS texts").first()
    assert (most["n"], most["texts"]) == (textindex.ROW_TERMS, len(texts))
    found = {}
    for r in rows.collect():
        found.setdefault(r["id"], []).extend((t["kind"], t["term"]) for t in r["terms"])
    assert {k: sorted(t) for k, t in found.items()} == {k: sorted(textindex.terms_of(fold_text(t))) for k, t in texts.items()}
    index = textindex.build(frame(spark, texts), "doc_id", "text")
    assert index.texts().count() == len(texts)
    word = texts[7].split()[333]
    assert ids(index.contains(word)) == searched(texts, lambda text: fold_text(word) in text)


POSTING = [
    textindex.StructField("kind", textindex.StringType()),
    textindex.StructField("term", textindex.StringType()),
    textindex.StructField("id", textindex.LongType()),
    textindex.StructField("bucket", textindex.IntegerType()),
]


def test_batches_replace_themselves_and_earlier_texts(spark):
    first = {1: "old words here", 2: "kept words", 3: "changed twice"}
    index = textindex.build(frame(spark, first), "doc_id", "text")
    index.add(frame(spark, {1: "new text here", 4: "more words"}), "doc_id", "text", batch=1)
    for _ in range(2):  # a batch that runs again after a failure
        index.add(frame(spark, {3: "changed words", 5: "words"}), "doc_id", "text", batch=2)
    now = first | {1: "new text here", 4: "more words", 3: "changed words", 5: "words"}
    for query in ("words", "here", "old words", "twice", "changed", "new"):
        assert ids(index.contains(query)) == searched(now, lambda text: query in text)
        assert ids(index.all_words(query)) == searched(now, lambda text: has_words(text, query))
        assert ids(index.prefix(query)) == searched(now, lambda text: text.startswith(query))
    assert index.frequencies("word", ["words", "nothing"]) == {"words": 5}


@pytest.mark.parametrize("chunk, most", [(40, 3), (1 << 20, 1024)])
def test_postings_travel_in_blocks_of_many_rows(spark, corpus, chunk, most):
    texts = corpus | {400 + k: "the \x00\x00 \U0001d518𠀀𠀁 end" for k in range(60)} | {500: "z\x00\x00"}
    folded = {k: fold_text(text) for k, text in texts.items() if text is not None}
    rows = spark.createDataFrame(list(folded.items()), "id long, folded string").coalesce(1)
    blocks = textindex.posting_blocks(rows, chunk, most).collect()
    found = [(r["kind"], r["term"], k) for r in blocks for k in r["ids"]]
    wanted = [(kind, term, k) for k, text in folded.items() for kind, term in textindex.terms_of(text)]
    assert sorted(found) == sorted(wanted)
    assert all(0 < len(r["ids"]) <= most for r in blocks)
    if chunk > len(wanted):
        assert len(blocks) == len({(kind, term) for kind, term, _ in wanted}) < len(wanted) / 4


def test_an_index_keeps_a_row_for_many_postings(spark, corpus, index):
    """Every posting was a row of its own, dealt out and sorted by its term."""
    wanted = [(kind, term) for text in corpus.values() if text is not None for kind, term in textindex.terms_of(fold_text(text))]
    rows = spark.read.parquet(f"{index.path}/postings")
    assert rows.count() < len(wanted) / 4
    counts = spark.read.parquet(f"{index.path}/frequencies").groupBy("kind", "term").agg(textindex.F.sum("rows").alias("n")).collect()
    assert {(r["kind"], r["term"]): r["n"] for r in counts} == {pair: wanted.count(pair) for pair in set(wanted)}
