"""Periodic runs against a plain search of all periods."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factledger.llm import periodic

SCHEMA = "doc_id long, text string, runs string, n_words long, start int, words string, h long"


def plain_runs(words):
    """Every run by comparing at every lag."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        at = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and at is None:
                at = i
            elif not same and at is not None:
                length = i - at + q
                if length >= max(24, 3 * q):
                    found[at, length] = min(q, found.get((at, length), q))
                at = None
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    found = [None, "", " \t\r\n", "a", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 8, "x\x0by\x0cz " * 9, "é é ü " * 30]
    for q in list(range(1, 32)) + [40, 57, 64, 85, 128, 200]:
        block = [f"w{rng.randrange(q * 3 + 1)}" for _ in range(q)]
        for times in (2.97, 3, 3.01, 4.4, 9):
            n = max(int(q * times), 23 if times == 3 else 24)
            body = [block[i % q] for i in range(n)]
            found.append(" ".join(["pre"] * rng.randrange(4) + body + ["post"] * rng.randrange(4)))
    for alphabet in (1, 2, 3, 5):  # nested and overlapping runs
        for _ in range(12):
            words = [rng.choice("abcde"[:alphabet]) for _ in range(rng.randrange(150))]
            for _ in range(3):
                at, size = rng.randrange(len(words) + 1), rng.randrange(1, 20)
                words[at:at] = words[at : at + size] * rng.randrange(2, 6)
            found.append(" ".join(words))
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    found.append(" ".join(fib[-1]))
    thue = "a"
    while len(thue) < 256:
        thue += thue.translate(str.maketrans("ab", "ba"))
    found.append(" ".join(thue * 3))
    long = [f"v{rng.randrange(900)}" for _ in range(4000)]
    found.append(" ".join(long + long[:1000] * 4 + long))
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 5, 1, "w", 2) for i, t in rows], SCHEMA)


def test_runs_of_every_period(spark):
    rows = list(enumerate(texts())) + [(None, "a b " * 20), (3, "a b " * 20), (3, "a b " * 20)]
    found = {}
    for r in periodic.periodic_runs(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]))
    want = {}
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words)
        want.setdefault(i, []).append((runs, plain_collapse(words, runs), len(words)))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    assert sum(len(v[0][0]) for v in want.values()) > 150


@pytest.mark.parametrize("seed", range(6))
def test_runs_within_one_batch(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(0, 400, 60))[::-1]
    words, texts_of = [], []
    for k, n in enumerate(sizes):
        own = rng.integers(0, 1 + seed * 4, n)
        for _ in range(2):
            q = int(rng.integers(1, 60))
            at = int(rng.integers(0, max(1, n)))
            tail = own[at : at + q * 5]
            own[at : at + q * 5] = np.resize(own[at : at + q], len(tail))
        texts_of.append(own.tolist())
        words.append(own + 1000 * k)
    starts = np.cumsum(sizes) - sizes
    found = sorted(periodic.stretches(np.concatenate(words), sizes))
    want = sorted((int(s) + a, n, q) for s, own in zip(starts, texts_of, strict=True) for a, n, q in plain_runs(own))
    assert found == want


def test_foremost_run_and_planted_tails(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(40 + i))) for i in range(60)]
    rows += [(None, "a b"), (7, None), (8, "")]
    planted = periodic.with_planted_runs(frame(spark, rows)).collect()
    assert len(planted) == len(rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in planted)
    want, changed = [], 0
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w if k < a else words[a + (k - a) % p] for k, w in enumerate(words))
            changed += 1
        want.append((-1 if i is None else i, text or ""))
    assert got == sorted(want) and changed > 2
    rows = [(0, 24, 9), (2, 30, 10), (2, 36, 12), (5, 60, 20)]
    one = spark.createDataFrame([(rows,)], f"runs {periodic.RUN}").select(periodic.foremost(F.col("runs")).alias("top"))
    assert tuple(one.first()["top"]) == (2, 30, 10)


def test_empty_table(spark):
    empty = frame(spark, []).limit(0)
    assert periodic.periodic_runs(empty).count() == 0
    assert periodic.with_planted_runs(empty).count() == 0
