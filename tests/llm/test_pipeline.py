"""The pipeline's stages, one after another, against the operators' own rules."""

from __future__ import annotations

import itertools

import corpus_pipeline
from factledger.llm import mixing, near_copies
from factledger.llm.common import read

SF_DIR = "/root/testdata/sf0.001"


def test_stages_filter_and_hand_on(spark):
    docs = read(spark, SF_DIR, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), before.schema)
        assert docs.columns == columns
        if name == "near_dedup":
            sets = {r["doc_id"]: near_copies.shingles(r["text"] or "") for r in before.collect()}
            stay = [r["doc_id"] for r in docs.collect()]
            assert not any(near_copies.similar(sets[a], sets[b]) for a, b in itertools.combinations(stay, 2))
            for gone in sets.keys() - set(stay):  # each has a copy of a smaller id
                assert any(near_copies.similar(sets[gone], sets[k]) for k in sets if k != gone)
        if name == "mixing":
            want = sum(r["copies"] for r in mixing.mix(before).collect())
            assert docs.count() == want
        else:
            assert docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert sum(1 for r in pieces if r["start"] == 0) == docs.count()
    at = 0
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert divmod(at, 4096) == (r["sequence_id"], r["offset"])
        at += r["length"]


def test_empty_documents_give_no_piece(spark):
    docs = read(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.collect() == []
