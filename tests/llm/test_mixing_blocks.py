"""Blocks of the mix stay bounded when thousands of rows are equal."""

from __future__ import annotations

from collections import Counter

from factledger.llm import mixing
from test_operators import table


def test_equal_rows_are_dealt_to_many_blocks(spark, monkeypatch):
    texts = ["the same few words"] * 20_000 + [f"other words {k} " * (1 + k % 9) for k in range(500)]
    ids = [None] * 20_000 + list(range(500))
    docs = table(spark, texts, ids, sources=["a"] * len(texts))
    path = []
    pin = mixing.pin
    monkeypatch.setattr(mixing, "pin", lambda rows, name: path.append((name, pin(rows, name))) or path[-1][1])
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    first = next(found for name, found in path if name == "mix-level")
    blocks = [r["count"] for r in first.groupBy("block").count().collect()]
    assert len(blocks) == 6 and max(blocks) < 1.3 * mixing.BLOCK_ROWS
    again = mixing.mix(docs.repartition(5)).collect()
    one, other = (Counter((r["doc_id"], r["copies"]) for r in found) for found in (rows, again))
    assert one == other
    assert mixing.apply_mix(docs).count() == sum(r["copies"] for r in rows)
