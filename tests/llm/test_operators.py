"""Operators against brute force on small fixtures, with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factledger.llm import (
    exact_dedup,
    fingerprints,
    line_dedup,
    mixing,
    packing,
    pii,
    quality,
    records,
    simhash,
    tokens,
    url_rules,
)
from factledger.llm.queries import tokenizer

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long"


def table(spark, texts, ids=None, sources=None):
    """``documents`` with two more columns whose names operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or [f"s{k % 4}" for k in range(len(texts))]
    rows = [(i, t, None, s, None if t is None else len(t), None, 7) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return " ".join(rng.choice("the of and in to".split()) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "a b", "x" * 30_000, "é ß 漢字 \U0001f600 ok", "a\tb", "ab"]
    base = [words(rng, rng.randrange(5, 120)) for _ in range(40)]
    for text in base:
        texts.append(text)
    for text in base[:12]:
        texts += [text, text.replace(" ", "  ", 1), text + " extra"]
    texts.append(" ".join(words(rng, 200) for _ in range(40)))
    return texts


def groups_of(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return [top(k) for k in range(n)]


def test_simhash_classes(spark, corpus):
    docs = table(spark, corpus)
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == len(corpus)
    prints = [simhash.fingerprint(t or "") for t in corpus]
    assert prints[0] == prints[1] == prints[2] == 0
    assert all(found[k]["fp"] & (1 << 64) - 1 == p for k, p in enumerate(prints))
    near = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert [found[k]["component_id"] for k in range(len(prints))] == groups_of(len(prints), near)
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == set(groups_of(len(prints), near))
    assert simhash.keep_first(docs).columns == docs.columns


def test_simhash_links_with_full_buckets(spark):
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(60):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 3}
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (4, 10_000):
        assert {(r["a"], r["b"]) for r in simhash.links(frame, bucket_rows=most).collect()} == want


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_tokens_by_piece_are_those_of_the_library(name, corpus):
    model = Tokenizer.from_file(tokenizer(name))
    model.encode_special_tokens = True
    rng = random.Random(name)
    alphabet = "aZé ßµª²¼ \n\t\r\x0b\x85\xa0\x1c'stdmrvel.,!<|>0123_×÷\x00" + "漢Ω"
    texts = [t or "" for t in corpus] + ["<|endoftext|> I'll we've don't 's", "  a  b \n\n c\n"]
    texts += ["".join(rng.choice(alphabet[: len(alphabet) - rng.choice((0, 2))]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    encode = tokens.Encoder(tokenizer(name), kept=300)  # a small store: it is emptied again and again
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        got = [np.frombuffer(b, encode.dtype).tolist() for b in encode.encode(part)]
        assert got == [model.encode(t, add_special_tokens=False).ids for t in part]


def test_crc32c_known_values_and_damage():
    assert records.crc32c([b"123456789", b"", bytes(32), b"abc"]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x364B3FB7]
    rng = random.Random(1)
    buffers = [rng.randbytes(n) for n in (3, 4, 511, 512, 513, 5000)]
    framed = records.frames(buffers)
    assert records.parse(framed) == buffers
    for at in (0, 9, 20, len(framed[-1]) - 1):
        broken = bytearray(framed[-1])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.parse([bytes(broken)])


def test_records_round_trip(spark, corpus):
    ids = [None, 3, 3, *range(10, 10 + len(corpus) - 3)]
    docs = table(spark, corpus, ids)
    path = tokenizer(BYTE)
    index = records.write_records(docs, path)
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    order = sorted(zip(ids, (t or "" for t in corpus), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    want, start = [], 0
    for doc_id, text in order:
        coded = np.array([*model.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(coded), zlib.crc32(coded.tobytes())))
        start += len(coded)
    found = records.record_digests(index, path).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    one = records.read_records(index.filter("doc_id = 12"), path).collect()
    assert len(one) == 1 and one[0]["doc_id"] == 12
    assert records.record_digests(records.write_records(docs.limit(0), path), path).collect() == []


def test_packing_is_whole_and_gapless(spark, corpus):
    path = tokenizer(WORD)
    docs = table(spark, corpus)
    found = packing.pieces(docs, path, length=64)
    rows = sorted(found.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    at = 0
    for r in rows:
        assert divmod(at, 64) == (r["sequence_id"], r["offset"])
        at += r["length"]
    for k, text in enumerate(corpus):
        coded = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == coded.tobytes()
        assert {r["doc_tokens"] for r in own} == {len(coded)}
        assert all(zlib.crc32(coded[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    whole = sorted(packing.sequences(found, 64).collect(), key=lambda r: r["sequence_id"])
    assert [r["n_tokens"] for r in whole[:-1]] == [64] * (len(whole) - 1)
    assert packing.pieces(docs.limit(0), path).collect() == []


def test_exact_dedup_index_over_batches(spark, corpus):
    index = exact_dedup.fresh_index(spark, buckets=4)
    ids = [None, *range(1, len(corpus))]
    first = index.add(table(spark, corpus, ids)).collect()
    clean = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in corpus]
    for row in first:
        k = row["doc_id"] or 0
        same = [j for j in range(len(corpus)) if clean[j] == clean[k]]
        best = max(same, key=lambda j: (len(corpus[j] or ""), ids[j] is not None, -(ids[j] or 0)))
        assert (row["keep_id"], row["group_size"]) == (ids[best], len(same))
        assert row["kept"] == (ids[k] == ids[best])
        assert row["digest"] == hashlib.sha256(clean[k].encode()).hexdigest()
    n = index.rows().count()
    assert n == len(set(clean))
    again = index.add(table(spark, corpus, ids)).collect()
    assert sorted(map(str, again)) == sorted(map(str, first)) and index.rows().count() == n
    late = index.add(table(spark, ["one", "brand new"], [900, 901])).collect()
    by_id = {r["doc_id"]: r for r in late}
    assert (by_id[900]["keep_id"], by_id[900]["kept"], by_id[900]["group_size"]) == (3, False, 2)
    assert by_id[901]["kept"] and index.rows().count() == n + 1
    assert index.add(table(spark, [], [])).collect() == []


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    docs = table(spark, ["a b", "a b", "ab", "c", None, ""], [5, 5, 4, 6, None, None])
    kept = exact_dedup.unique_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == [(-1, ""), (5, "a b"), (6, "c")]


def water(sizes, weights, most=3):
    open_, target = set(sizes), {}
    left = sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over


def test_mixing_targets_and_copies(spark):
    rng = random.Random(3)
    texts, sources = [], []
    for source, n in (("a", 700), ("b", 30), ("c", 200), ("é", 5), (None, 150)):
        for _ in range(n):
            texts.append(words(rng, rng.randrange(60)) if rng.random() < 0.95 else None)
            sources.append(source)
    docs = table(spark, texts, sources=sources)
    rows = mixing.mix(docs, block_rows=64).collect()
    assert len(rows) == len(texts)
    again = mixing.mix(docs.repartition(7), block_rows=64).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == {r["doc_id"]: r["copies"] for r in again}
    size = {}
    for t, s in zip(texts, sources, strict=True):
        size[s] = size.get(s, 0) + len((t or "").split())
    want = water(size, dict(zip(("a", "b", "c", "é", None), (5, 2, 1, 5, 2), strict=True)))
    taken = {}
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for source, goal in want.items():
        assert taken[source] == pytest.approx(goal, rel=0.02, abs=40)
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns and applied.count() == sum(
        r["copies"] for r in mixing.mix(docs).collect()
    )
    assert mixing.mix(docs.limit(0)).collect() == []


def test_pivot_keeps_the_sum_and_the_chances():
    rates = np.array([0.3, 0.3, 0.8, 2.5, 1.0, 0.0, 0.1])
    rng = np.random.default_rng(0)
    runs = [mixing.pivot(rates, rng.random(8), True)[0] for _ in range(4000)]
    assert all(r.sum() in (5, 5.0) for r in runs)
    assert np.allclose(np.mean(runs, axis=0), rates, atol=0.04)


def test_quality_learns_and_defines_odd_cases(spark):
    rng = random.Random(9)
    good = [words(rng, rng.randrange(40, 200)).capitalize() + "." for _ in range(150)]
    junk = [" ".join([rng.choice(["SPAM!!", "$$$", "click###"])] * rng.randrange(30, 90)) for _ in range(60)]
    docs = table(spark, [*good, *junk, None, ""])
    labels = [(k, int(k < 150)) for k in range(210) if k % 3] + [(5000, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, label int")
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == 212 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [k for k in range(210) if k % 3 == 0]
    assert sum(rows[k]["predicted"] == int(k < 150) for k in held) >= len(held) - 1
    assert rows[210]["score"] == rows[211]["score"]
    none = {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()}
    assert none == {0.5}
    assert {r["score"] for r in quality.classify(docs, labels.filter("label = 1")).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).collect() == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(s):
        return [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(reversed(d))) % 10 == 0

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_personal_data_base_and_added_spans(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1234567890.@@..-+ ()%é") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8", "256.1.1.1 000000000255.1.1.1", "4111 1111 1111 1111", "+1 (375) 555-4393 x", "a@b.c@d.e", "9" * 5000]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text
    rows = [f"mail é jo.x{k}@site.com or call +1 (375) 555-{1000 + k} or phone (375) 555-{2000 + k} now" for k in range(60)]
    docs = table(spark, [*rows, None, "", "nothing here 12 34"])
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(found) == 63 and found[60]["spans"] == found[61]["spans"] == found[62]["spans"] == []
    for k, text in enumerate(rows):
        base = [(s["kind"], s["start"], s["end"]) for s in found[k]["base"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in found[k]["spans"]]
        assert base == plain_spans(text) and set(base) <= set(spans)
    assert pii.find(docs.limit(0)).collect() == []
    assert pii.redacted("a x@y.zz b", [("email", 2, 8)]) == "a <email> b"


def test_reliabilities_tell_a_good_labeler_from_noise():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.5
    good = np.where(rng.random((4000, 3)) < 0.9, truth[:, None], ~truth[:, None]).astype(int)
    noise = rng.integers(0, 2, (4000, 2))
    p = pii.reliabilities(np.zeros(4000, int), np.concatenate([good, noise], axis=1), np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95


def test_url_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?q", "https://example.net/de/", "http://example.net", "x://net/#a/b", None, "",
            "no scheme/net/", "ftp://ORG/fr/a", "http://forg/fr/", "http://a.b.example.com/de/1#t", "://org/fr/://x"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("x", None, None)]
    shards = url_rules.build(spark.createDataFrame(rules, "host string, path string, verdict string"))
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, shards).collect()}
    assert rows[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows[1] == ("example.net", "/de/", "net/", "block")
    assert rows[2] == ("example.net", "", None, "allow")
    assert rows[3] == ("net", "/", "net/", "block")
    assert rows[4] == rows[5] == rows[6] == ("", "", None, "allow")
    assert rows[7] == ("org", "/fr/a", "org/fr/", "allow")
    assert rows[8] == ("forg", "/fr/", None, "allow")
    assert rows[9] == ("a.b.example.com", "/de/1", "example.com/de/", "block")
    assert rows[10] == ("org", "/fr/://x", "org/fr/", "allow")
    empty = url_rules.build(spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in url_rules.judge(pages, empty).collect()} == {"allow"}


def test_url_digests_that_collide_are_told_apart(tmp_path):
    """Equal digests: the stored string decides."""
    texts = [b"block\taa", b"allow\tbb"]
    import xxhash

    value = xxhash.xxh64_intdigest("bb")
    shard = value >> 60
    np.save(tmp_path / "n.digests.npy", np.array([value, value], np.uint64))
    np.save(tmp_path / "n.ends.npy", np.array([0, 8, 16]))
    np.save(tmp_path / "n.texts.npy", np.frombuffer(b"".join(texts), np.uint8))
    array = url_rules.DigestArray(str(tmp_path), {shard: "n"}, [0], 4)
    assert array.probe(["bb", "cc"]) == ["allow", None]


def test_fingerprints_of_edited_texts(spark, corpus):
    ids = list(range(len(corpus)))
    ids[5] = ids[6] = 6
    docs = table(spark, corpus, ids)
    rows = fingerprints.compare_edited(docs).collect()
    order = sorted(zip(ids, (t or "" for t in corpus), strict=True), key=lambda r: (-r[0], r[1].encode()))
    want = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(tuple(r["print"]), []).append(r["doc_id"])
    same = {r["doc_id"]: tuple(r["print"]) for r in rows}
    assert same[0] == same[1] and same[9] == same[49]
    assert fingerprints.compare_edited(docs.limit(0)).collect() == []


def test_fuzzy_lines(spark):
    rng = random.Random(8)
    base = [words(rng, 25) for _ in range(60)] + ["tiny", "short line of few words", "x" * 400, "漢字仮名" * 20]
    texts = []
    for k in range(120):
        own = [rng.choice(base) for _ in range(4)]
        if k % 3 == 0:
            own[0] = own[0].replace("the", "tha", 1)
        texts.append("\n".join([*own, "", "  "]))
    texts += [None, "", "\n"]
    docs = table(spark, texts)
    rows = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_classes(docs).collect()}
    first, where = {}, {}
    for doc_id, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            where[doc_id, n] = line
            if line.strip():
                first.setdefault(line, (doc_id, n))
    names = list(first)
    grams = [{s[i : i + 5] for i in range(len(s) - 4)} for s in names]
    links = [(a, b) for a, b in itertools.combinations(range(len(names)), 2)
             if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    tops = groups_of(len(names), links)
    head = {}
    for k, name in enumerate(names):
        head[tops[k]] = min(head.get(tops[k], first[name]), first[name])
    assert len(rows) == len(where)
    for place, line in where.items():
        want = head[tops[names.index(line)]] if line.strip() else place
        assert (rows[place]["class_doc_id"], rows[place]["class_line_no"]) == want
        assert rows[place]["kept"] == (want == place)
    assert line_dedup.line_classes(docs.limit(0)).collect() == []
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()}
    assert cleaned[0].split("\n")[-2:] == ["", "  "] and len(cleaned) == len(texts)
