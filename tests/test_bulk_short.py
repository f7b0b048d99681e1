"""Entries that fold to fewer characters than a trigram."""

from __future__ import annotations

from factledger.functions.text import fold_text
from factledger.operators import bulk


def test_contains_entries_that_fold_to_few_characters(spark):
    values = ["aé", "ño", "é́", "́́́", "\U0001f600é", "abc", "ab"]
    texts = ["caesar", "AÉ", "não", "No", "x\U0001f600É", "", None, "abcabc", "zz"]
    entries = bulk.with_errors(
        spark.createDataFrame([(f"i{k}", v, "contains") for k, v in enumerate(values)], "input_id string, value string, mode string")
    )
    registry = spark.createDataFrame(list(enumerate(texts)), "who long, name string")
    found = bulk.match_contains(entries, registry, "who", "name")
    want = [
        (f"i{k}", who)
        for k, v in enumerate(values)
        for who, text in enumerate(texts)
        if len(v) >= bulk.SHORTEST and text is not None and fold_text(v) in fold_text(text)
    ]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    state = {r["input_id"]: r["state"] for r in bulk.entry_status(entries, found).collect()}
    assert state == {f"i{k}": "invalid" if v == "ab" else "found" for k, v in enumerate(values)}


def test_long_texts_are_folded_few_at_a_time(spark):
    texts = [None if k % 50 == 3 else f"ÉX{k} " + "ab" * (k % 7) for k in range(3 * bulk.FOLDED_AT_ONCE + 5)]
    registry = spark.createDataFrame(list(enumerate(texts)), "who long, name string").coalesce(1)
    folded = bulk._folded_texts(registry, "who", "name")
    assert {r["who"]: r["_text"] for r in folded.collect()} == {k: fold_text(t) for k, t in enumerate(texts) if t is not None}
    assert "ArrowEvalPython" not in folded._jdf.queryExecution().executedPlan().toString()
