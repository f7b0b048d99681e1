"""Rows keep their texts without an id of their own; shards follow the number of rules."""

from __future__ import annotations

from factledger.llm import line_dedup, url_rules
from test_operators import table


def test_rows_with_null_and_repeated_ids_keep_their_texts(spark):
    texts = ["first of none", "second of none\n\nmore of it", "one of seven\nshared words here", "two of seven", None]
    ids = [None, None, 7, 7, None]
    found = line_dedup.without_repeats(table(spark, texts, ids)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in found) == sorted((i or -1, t or "") for i, t in zip(ids, texts))


def test_shards_follow_the_number_of_rules(spark, monkeypatch):
    assert [url_rules.bits_for(n) for n in (0, 4, 4_000_000, 4_000_001, 1_000_000_000)] == [4, 4, 4, 5, 12]
    monkeypatch.setattr(url_rules.bits_for, "__defaults__", (10,))
    rules = [(f"h{k}.example", "/", "block" if k % 2 else "allow") for k in range(600)]
    shards = url_rules.build(spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert shards.count() > 16
    pages = spark.createDataFrame([(k, f"http://{h}{p}x") for k, (h, p, _) in enumerate(rules)], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, shards).collect()}
    assert found == {k: (h + p, v) for k, (h, p, v) in enumerate(rules)}
