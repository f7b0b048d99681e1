"""Components and assignment against one-at-a-time brute force."""

import random

import pytest

from factledger.operators import identity


def sequential(records):
    owner_of, documents, out = {}, {}, {}
    for record, source, doc, arrival in sorted(records, key=lambda r: r[3]):
        keys = [("s", source)] + ([("d", doc)] if doc else [])
        owners = {owner_of[k] for k in keys if k in owner_of}
        if len(owners) > 1:
            out[record] = (None, "distinct_owners")
            continue
        owner = owners.pop() if owners else (f"document:{doc}" if doc else f"source:{source}")
        if doc and documents.get(owner, doc) != doc:
            out[record] = (None, "different_document")
            continue
        first = ("s", source) not in owner_of
        for k in keys:
            owner_of.setdefault(k, owner)
        if doc:
            documents[owner] = doc
        out[record] = (owner, "registered" if first else "joined")
    return out


@pytest.mark.parametrize("seed,sources,docs", [(1, 6, 5), (2, 15, 4), (3, 4, 30), (4, 40, 25)])
def test_assign_equals_sequential_arrival(spark, seed, sources, docs):
    rng = random.Random(seed)
    arrivals = rng.sample(range(1000), 150)
    records = [
        (n, f"S{rng.randrange(sources)}", f"D{rng.randrange(docs)}" if rng.random() < 0.6 else None, arrivals[n])
        for n in range(150)
    ]
    df = spark.createDataFrame(records, "record long, source_key string, doc_key string, arrival long")
    assert {r.record: (r.owner, r.outcome) for r in identity.assign(df).collect()} == sequential(records)


def test_assign_one_document_wanted_by_most_sources(spark):
    records = [(n, f"S{n}", None, n) for n in range(60)] + [(100 + n, f"S{n}", "D", 1000 - n) for n in range(60)]
    df = spark.createDataFrame(records, "record long, source_key string, doc_key string, arrival long")
    got = {r.record: (r.owner, r.outcome) for r in identity.assign(df).collect()}
    assert got == sequential(records)
    assert got[159] == ("source:S59", "joined") and got[100][1] == "distinct_owners"


def greedy(wishes):
    sources, docs, taken = set(), set(), set()
    for source, doc, at in sorted(wishes, key=lambda w: w[2]):
        if source not in sources and doc not in docs:
            sources.add(source)
            docs.add(doc)
            taken.add(at)
    return taken


def chain(n):
    """Pairs of which each shares one end with the one before: n links of a path."""
    return [(f"S{(k + 1) // 2}", f"D{k // 2}", k) for k in range(n)]


@pytest.mark.parametrize("rounds,wishes", [(12, chain(500)), (4, [(f"S{k}", "D", k) for k in range(80)]), (3, [("S", f"D{k}", k) for k in range(80)])])
def test_matching_settles_chains_in_logarithmic_rounds(spark, monkeypatch, rounds, wishes):
    seen, doubled = [], identity._doubled
    monkeypatch.setattr(identity, "_doubled", lambda *args: seen.append(1) or doubled(*args))
    df = spark.createDataFrame(wishes, "source_key string, doc_key string, at long")
    assert {r["at"] for r in identity._earliest_matching(df).collect()} == greedy(wishes)
    assert len(seen) <= rounds


@pytest.mark.parametrize("seed", range(4))
def test_matching_equals_greedy_choice(spark, seed):
    rng = random.Random(seed)
    at = rng.sample(range(10_000), 400)
    pairs = {(f"S{rng.randrange(20 + 80 * seed)}", f"D{rng.randrange(150)}") for _ in range(300)}
    wishes = [(s, d, at[k]) for k, (s, d) in enumerate(sorted(pairs))]
    df = spark.createDataFrame(wishes, "source_key string, doc_key string, at long")
    assert {r["at"] for r in identity._earliest_matching(df).collect()} == greedy(wishes)
    assert identity._earliest_matching(df.limit(0)).count() == 0


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_chain_star_and_singletons(spark):
    keys = [(n, "doc", f"k{n // 2}") for n in range(0, 60)] + [(n, "src", f"s{(n + 1) // 2}") for n in range(0, 60)]
    keys += [(1000 + n, "doc", "hot") for n in range(200)] + [(5000, "src", "alone")]
    df = spark.createDataFrame(keys, "record long, kind string, key string")
    got = {r.record: r.component for r in identity.components(df, "record").collect()}
    by_key = {}
    for record, kind, key in keys:
        by_key.setdefault((kind, key), []).append(record)
    pairs = [(members[0], m) for members in by_key.values() for m in members[1:]]
    assert got == union_find(pairs, {k[0] for k in keys})


def test_owner_match_conflict_and_new(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "record long")
    found = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8)], "record long, owner long")
    got = {r.record: (r.outcome, r.owner) for r in identity.match_owners(records, found, "record").collect()}
    assert got == {1: ("matched", 7), 2: ("conflict", None), 3: ("new", None)}


def test_mixed_types_and_document_conflicts(spark):
    rows = spark.createDataFrame([(1, "a", "person"), (1, "b", "company"), (2, "a", "person"), (2, None, "person")], "g long, doc string, typ string")
    assert [r.g for r in identity.mixed_types(rows, "g", "typ").collect()] == [1]
    assert [(r.g, r.documents) for r in identity.document_conflicts(rows, "g", "doc").collect()] == [(1, 2)]
    assert identity.document_conflicts(rows, "g", "doc", "typ").isEmpty()


def test_edges_with_a_name_alone_stay_pending(spark):
    from factledger.operators import relations

    rows = [("A", "mother", "B", None), ("A", "father", None, 5), ("A", "spouse", None, None)]
    edges = spark.createDataFrame(rows, "owner string, rel string, target_id string, target_document long")
    assert [tuple(r) for r in relations.pending_identity(edges).collect()] == [("A", "spouse", "pending_identity", None)]
