"""Phrases and proximity of the positional index against plain search."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from factledger.llm import positional

DOCS = "doc_id long, text string, row long, place int, words string, term string, key string"
TESTS = "item_id long, text string, window string, key string, row long"


def plain_words(text):
    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_windows(tests):
    found = []
    for item, text in tests:
        words = plain_words(text)
        if words:
            n = min(10, len(words))
            found += [(item, tuple(words[s : s + n])) for s in range(len(words) - n + 1)]
    return found


def plain_judge(docs, tests):
    windows = plain_windows(tests)
    out = []
    for doc, text in docs:
        words = plain_words(text)
        hit, items = set(), set()
        for item, w in windows:
            for s in range(len(words) - len(w) + 1):
                if words[s] == w[0] and tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    items.add(item)
        out.append((doc, len(words), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(13)

    def prose(n, most=60):
        return [rng.choice(["the", "of", "and", "é"]) if rng.random() < 0.5 else f"W{rng.randrange(most)}" for _ in range(n)]

    tests = [(k, " ".join(prose(rng.choice([10, 11, 14, 25, 40])))) for k in range(20)]
    tests += [(30, "of the"), (31, "w7"), (32, "W3, the: w4"), (33, "unseen words only"), (34, "the the the the the the the the the the the")]
    tests += [(35, ""), (36, None), (37, " \t.,"), (None, "of W9 and"), (2, tests[2][1]), (38, tests[2][1]), (39, tests[0][1] + " zzz")]
    docs = [(0, None), (1, ""), (2, " \n.;"), (3, "the"), (4, "the " * 60), (5, "of the of the"), (6, "漢字 w7 ÉÉ é")]
    for k in range(70):
        words = prose(rng.randrange(1, 120))
        for _ in range(rng.randrange(4)):
            item = (tests[rng.randrange(20)][1]).split()
            low = rng.randrange(len(item))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[low : low + rng.randrange(1, 40)]
        docs.append((100 + k, rng.choice([" ", ", ", "\n", "-"]).join(words).replace("W", rng.choice("wW"))))
    docs.append((900, " ".join((tests[5][1] + " " + " ".join(prose(30))) for _ in range(300))))
    docs += [(None, tests[1][1]), (None, tests[1][1]), (None, "x"), (100, docs[8][1]), (100, tests[3][1])]
    return docs, tests


def frames(spark, docs, tests):
    a = spark.createDataFrame([(i, t, 1, 2, "w", "t", "k") for i, t in docs], DOCS)
    return a, spark.createDataFrame([(i, t, "w", "k", 1) for i, t in tests], TESTS)


def test_judge_equals_plain_search(spark, tables):
    found = positional.judge(*frames(spark, *tables))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = plain_judge(*tables)
    assert got == want and sum(n > 0 for _, _, n, _ in want) > 30


def test_large_lists_are_shuffled_with_equal_result(spark, tables, monkeypatch):
    monkeypatch.setattr(positional, "SENT", 0)
    got = sorted((tuple(r) for r in positional.judge(*frames(spark, *tables)).collect()), key=repr)
    assert got == plain_judge(*tables)


def test_every_word_has_its_posting(spark, tables):
    index = positional.build(frames(spark, *tables)[0])
    texts = {r["row"]: r["words"] for r in index.forward.collect()}
    assert sorted(map(tuple, texts.values())) == sorted(tuple(plain_words(t)) for _, t in tables[0])
    got = Counter(map(tuple, index.postings.collect()))
    assert got == Counter((w, row, k) for row, words in texts.items() for k, w in enumerate(words))


@pytest.mark.parametrize(("terms", "within"), [(3, 6), (2, 1), (1, 5)])
def test_near_terms_stand_together(spark, tables, terms, within):
    docs, tests = frames(spark, *tables)
    index = positional.build(docs)
    got = {tuple(r) for r in positional.near(index, tests, terms, within).collect()}
    rows = {r["row"]: r["words"] for r in index.forward.collect()}
    often = Counter(w for words in rows.values() for w in words)
    want = set()
    for item, w in plain_windows(tables[1]):
        if all(often[t] for t in w):
            first, *others = sorted(set(w), key=lambda t: (often[t], t.encode()))[:terms]
            for row, words in rows.items():
                for p, word in enumerate(words):
                    span = words[max(0, p - within) : p + within + 1]
                    if word == first and all(t in span for t in others):
                        want.add((row, p, item))
    assert got == want and want


def test_empty_tables(spark, tables):
    docs, tests = frames(spark, *tables)
    assert positional.judge(docs.limit(0), tests).count() == 0
    clean = positional.judge(docs, tests.limit(0))
    assert clean.count() == len(tables[0]) and clean.filter("n_hit > 0 OR size(items) > 0").count() == 0


def test_postings_stand_in_the_order_of_a_number(spark):
    docs = spark.createDataFrame([(n, "pear Apple kiwi apple fig " * 3 + f"w{n}") for n in range(40)], "doc_id long, text string")
    found = positional.build(docs.coalesce(1)).postings.selectExpr("term", "xxhash64(term) AS number").collect()
    assert len(found) == 40 * 16
    assert [r.number for r in found] == sorted(r.number for r in found)
