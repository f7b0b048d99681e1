"""Near copies by five-word shingles against all pairs and on planted copies."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from factledger.llm import near_copies, simhash
from test_operators import groups_of, table


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, words, share):
    """Scattered replaced words: each spoils five shingles."""
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[k] = f"z{rng.randrange(10**6)}"
    return out


def likeness(a, b):
    one, other = near_copies.shingles(a), near_copies.shingles(b)
    return len(one & other) / len(one | other)


@pytest.mark.parametrize("n", [60, 200, 600])
def test_bands_find_pairs_above_the_threshold(n):
    rng = random.Random(n)
    seen = 0
    while seen < 150:
        a = prose(rng, n)
        a, b = " ".join(a), " ".join(edited(rng, a, rng.choice((0.005, 0.01, 0.015, 0.02, 0.025))))
        if near_copies.THRESHOLD <= likeness(a, b):
            seen += 1
            one, other = (near_copies.bands(near_copies.shingles(t)) for t in (a, b))
            assert (one == other).any()


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one", "One", "a b c", "a b d"]
    for _ in range(60):
        base = prose(rng, rng.choice((60, 200, 400)))
        texts += [" ".join(base), " ".join(edited(rng, base, rng.choice((0.005, 0.02, 0.03))))]
    common = prose(rng, 100)
    texts += [" ".join(edited(rng, common, 0.01)) for _ in range(30)]  # a chain of copies of one text
    texts += [" ".join([*common, *prose(rng, 60)]) for _ in range(20)]  # a shared passage is not a copy
    n = len(texts)
    sets = [near_copies.shingles(t or "") for t in texts]
    links = [(a, b) for a in range(n) for b in range(a + 1, n) if near_copies.similar(sets[a], sets[b])]
    tops = groups_of(n, links)
    assert len(set(tops)) < n - 60
    docs = table(spark, texts)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(tops)


def test_rows_without_an_id_and_repeated_ids(spark):
    docs = table(spark, ["a b", "a b", "a b", "c d", "a b"], [None, 3, 2, 3, None])
    kept = near_copies.keep_first(docs).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "a b"), (-1, "a b"), (2, "a b"), (3, "a b"), (3, "c d")]


def test_large_groups_of_unlike_texts_make_few_pairs(spark, monkeypatch):
    rng = random.Random(21)
    passage, origin = prose(rng, 150), prose(rng, 140)
    texts = [" ".join([*prose(rng, n), *passage, *prose(rng, n)]) for n in (rng.randrange(10, 90) for _ in range(400))]
    texts += [" ".join(edited(rng, origin, rng.choice((0.01, 0.02, 0.03, 0.05)))) for _ in range(300)]
    texts += [" ".join(origin), *[" ".join(origin[:n]) for n in range(60, 140, 4)]]
    sets = [near_copies.shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    tops = groups_of(len(sets), [p for p in pairs if near_copies.similar(sets[p[0]], sets[p[1]])])
    made, verify = [], near_copies._verified

    def counted(found, *rest):
        made.append(found.count())
        return verify(found, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.classes(table(spark, texts)).collect()}
    # a pair just above 0.8 may miss every band with probability 0.0001
    assert sum(found[k] != top for k, top in enumerate(tops)) <= 1
    assert len(made) == 2 and sum(made) < 10 * len(texts) < 0.04 * len(pairs)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_pairs_the_hub_does_not_settle_share_an_early_deviation(spark, threshold):
    rng = random.Random(int(threshold * 10))
    hub = {f"{k}".encode() for k in range(60)}
    sets = []
    for _ in range(120):
        gone = set(rng.sample(sorted(hub), rng.randrange(30)))
        sets.append(hub - gone | {f"x{rng.randrange(40)}".encode() for _ in range(rng.randrange(25))})
    share, rows = (1 - threshold) / (1 + threshold), []
    for k, own in enumerate(sets):
        found = near_copies.deviations(hub, own)
        firsts = found[: int(share * len(own) * (1 + 1 / threshold) + 1e-6) + 1]
        rows += [(0, k, len(own), len(found), at, x, k) for at, x in enumerate(firsts)]
    schema = "hub long, id long, n long, d long, at int, shingle long, component long"
    got = {tuple(r) for r in near_copies._unsettled(spark.createDataFrame(rows, schema), threshold).collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            settled = near_copies.similar(hub, sets[a], threshold) and near_copies.similar(hub, sets[b], threshold)
            assert settled or not near_copies.similar(sets[a], sets[b], threshold) or (a, b) in got


def test_simhash_links_are_part_of_the_stage(spark):
    rng = random.Random(5)
    fps = [0, 0, 0, -1, 5]
    for _ in range(40):
        fp = rng.getrandbits(64)
        fps += [fp, fp]
        for bits in (1, 2, 3, 4):
            for bit in rng.sample(range(64), bits):
                fp ^= 1 << bit
            fps.append(fp)
    fps = [f - (1 << 64) if f >> 63 == 1 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    found = groups_of(len(fps), [(r["a"], r["b"]) for r in near_copies._simhash_pairs(rows).collect()])
    close = lambda a, b: ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= simhash.MAX_BITS
    assert found == groups_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if close(a, b)])
    texts = {1: "a b c d e f g", 2: "One two", 3: "", 4: None}
    signed = near_copies.signatures(table(spark, list(texts.values()), list(texts)))
    want = {k: simhash.fingerprint(t or "", near_copies.SHINGLE_WORDS) for k, t in texts.items()}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in signed.collect()} == want
