"""The audit of sources against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factledger.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, total long, rank string"


def plain_terms(text):
    lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_audit(rows, least, top):
    """``rows`` of (lang, source, text)."""
    rows = [(a or "", b or "", plain_terms(t)) for a, b, t in rows]
    docs = Counter((a, t) for a, _, found in rows for t in set(found))
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= least:
            kept[lang].append(term)
    counts, groups = Counter(), sorted({(a, b) for a, b, _ in rows})
    for a, b, found in rows:
        counts.update((a, b, t) for t in found)

    def shares(lang, sources):
        n = {t: sum(counts[lang, b, t] for b in sources) for t in kept[lang]}
        total = sum(n.values()) + 2 * len(n)
        return n, {t: 1 + 10**9 * (c + 2) // total for t, c in n.items()}

    def apart(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang, source in groups:
        others = [b for a, b in groups if a == lang]
        (n, p), (_, q) = shares(lang, [source]), shares(lang, others)
        found = [(b, sum(apart(p[t], shares(lang, [b])[1][t]) for t in p)) for b in others if b != source]
        for part, items, most in (
            ("pair", found, len(found)),
            ("term", [(t, apart(p[t], q[t])) for t in p if n[t] and p[t] > q[t]], top),
        ):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, a, b, "x", 1, 2, "z") for k, (a, b, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    stems = ["Ab", "abc", "abcd", "abcde", "ABCDEFGH", "abcdefghi", "é", "èé", "漢字漢字", "straße", "x" * 40, "y" * 300, "z" * 3000]
    stems += ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    found = [(None, None, None), ("en", None, ""), ("en", "s1", " \t\n 12 ,.- \x00"), ("", "s1", "abc abcd"), ("xx", "s0", "a"), ("xx", "s1", "b")]
    for k in range(260):
        lang = ("en", "en", "de", "fr", None)[k % 5]
        source = "s0" if k % 3 == 0 else rng.choice(["s1", "s2", "s3", "S4", "é", None])
        weighted = stems[: 20 + 100 * (k % 2)]
        found.append((lang, source, rng.choice([" ", ", ", "1", "\n"]).join(rng.choice(weighted) for _ in range(rng.randrange(60)))))
    return found + found[50:90] + [("en", "long", "tail " + "abcd " * 30_000)]


@pytest.mark.parametrize(("least", "top"), [(10, 10), (2, 3), (1, 10), (10_000, 10)])
def test_audit_equals_plain_counting(spark, rows, least, top):
    found = sorted(tuple(r) for r in divergence.audit(frame(spark, rows), least, top).collect())
    assert found == plain_audit(rows, least, top)


def test_levels_discard_by_distinct_documents(spark, rows):
    lists = divergence.term_lists(frame(spark, rows))
    texts = [(a or "", set(plain_terms(t))) for a, _, t in rows]
    for size in (3, 9):
        found = {(r["lang"], bytes(r["prefix"]), r["whole"]): r["docs"] for r in divergence._level(lists, size, None, 10).collect()}
        want = Counter()
        for lang, terms in texts:
            want.update({(lang, t.encode()[:size], len(t.encode()) <= size) for t in terms})
        assert found == {k: n for k, n in want.items() if n >= 10}


def test_sieve_holds_what_it_was_given(spark):
    names = [("en", f"t{k}é") for k in range(3000)] + [("de", "de")]
    sieve = divergence.sieve_of(spark.createDataFrame(names, "lang string, term string"), "term")

    def share(lang, terms):
        table = pa.table({"lang": [lang], "source": [""], "terms": [" ".join(terms)]})
        found = divergence._Terms(table)
        return found.sieved(sieve, found.terms).mean()

    assert share("en", [t for _, t in names[:-1]]) == 1 == share("de", ["de"])
    assert share("en", [f"u{k}" for k in range(3000)]) < 0.01 > share("de", [t for _, t in names[:-1]])


def test_blocks_hold_whole_terms(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 50)
    batches = pa.table({"lang": ["a"] * 90 + ["b"] * 90, "term": [f"t{k // 7:03}" for k in range(180)]}).to_batches(13)
    found = [t.to_pydict() for t in divergence._by_terms(iter(batches))]
    keys = [set(zip(t["lang"], t["term"], strict=True)) for t in found]
    assert sum(len(t["term"]) for t in found) == 180 and len(found) > 2
    assert sum(map(len, keys)) == len(set().union(*keys))


def test_empty_and_wordless_tables(spark):
    empty = frame(spark, [("a", "b", "c")]).limit(0)
    found = divergence.audit(empty)
    assert found.count() == 0 and found.columns == ["lang", "source", "part", "item", "value", "rank"]
    wordless = divergence.audit(frame(spark, [("a", "x", None), ("a", "y", "1 2")]), 1)
    assert {(r["source"], r["item"], r["value"], r["rank"]) for r in wordless.collect()} == {("x", "y", 0, 1), ("y", "x", 0, 1)}


def test_shares_of_huge_counts_are_exact(spark):
    one = spark.range(1).select(F.lit(10**17).alias("n"), F.lit(7 * 10**17 + 1).alias("total"), F.lit(10**9).alias("v"))
    assert one.select(divergence._share("n").alias("p")).first()["p"] == 1 + 10**9 * (10**17 + 2) // (7 * 10**17 + 1 + 2 * 10**9)
