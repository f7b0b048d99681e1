"""Columns of any name, nulls and repeats through every operator that takes documents."""

from __future__ import annotations

import pytest

from factledger.llm import (
    divergence,
    exact_dedup,
    fingerprints,
    line_dedup,
    mixing,
    near_copies,
    packing,
    periodic,
    pii,
    positional,
    records,
    simhash,
    url_rules,
)
from factledger.llm.queries import tokenizer

#: Names that operators use for columns of their own.
NAMES = (
    "at _at id _id _mark mark _own _nth _copy _copies _rows rows row copies taken_id taken_mark times nth key key2 n bands band hub component "
    "component_id digest _digest stay_id keep_id group_size kept text_sha256 block size rate target term place start width words window "
    "line spans base h a p runs collapsed next next_text bucket head no_id h1 h2 mask print sides turn score fp first_id total v part item value "
    "rank shingle d sequence_id offset length ids pieces word bits batch number seq stay path_of host path rule verdict"
).split()
IDS = [1, 2, 2, None, None, 7, 8, 9]
TEXTS = ["a b c d e f", "a b c d e f", "x y", None, "", "a  b c d e f", "long " * 400, "mail me: a.b@example.org\nsecond line of words here\nsecond line of words here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{k % 2}", len(t or ""), *[f"{name}{k}" for name in NAMES]) for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` string" for name in NAMES)
    return spark.createDataFrame(rows, schema)


def whole(rows):
    return sorted(map(str, rows.collect()))


@pytest.mark.parametrize("keep", [exact_dedup.unique_rows, near_copies.keep_first, simhash.keep_first, mixing.apply_mix])
def test_rows_come_back_as_they_were(docs, keep):
    kept = keep(docs)
    assert kept.columns == docs.columns
    found, every = whole(kept), set(whole(docs))
    assert found and set(found) <= every


@pytest.mark.parametrize(
    "operator",
    [
        simhash.near_duplicates,
        near_copies.classes,
        fingerprints.compare_edited,
        mixing.mix,
        pii.find,
        periodic.periodic_runs,
        lambda docs: packing.pieces(docs, tokenizer("word_bpe_49k.json"), with_ids=False),
        lambda docs: exact_dedup.fresh_index(docs.sparkSession).add(docs),
        lambda docs: positional.judge(docs, docs.withColumnRenamed("doc_id", "item_id")),
        lambda docs: records.record_digests(records.write_records(docs, tokenizer("byte_bpe_50k.json")), tokenizer("byte_bpe_50k.json")),
    ],
)
def test_one_result_for_each_row(docs, operator):
    assert operator(docs).count() == len(IDS)


def test_tables_of_other_shapes(docs):
    lines = line_dedup.line_classes(docs)
    assert lines.count() > len(IDS)
    assert line_dedup.without_repeats(docs).count() > 0
    assert divergence.audit(docs, 1).filter("part = 'pair'").count() == 2


def test_hosts_of_rules_are_lower_cased(spark):
    pages = spark.createDataFrame([(1, "https://WWW.Example.com/a"), (2, "http://other.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("Example.COM", "/", "block")], "host string, path string, verdict string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, url_rules.build(rules)).collect()}
    assert found == {1: ("example.com/", "block"), 2: (None, "allow")}
