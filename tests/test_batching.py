"""Batch cuts against cutting one record after another, deep digests, records set aside."""

import json
import random

import pytest

from factledger.operators import batching, flatten


def one_by_one(sizes, records, atoms, size):
    batch, held, a, b, out = 0, records, 0, 0, []
    for x, y in sizes:
        if held == records or a + x > atoms or b + y > size:
            batch, held, a, b = batch + 1, 0, 0, 0
        held, a, b = held + 1, a + x, b + y
        out.append((batch, held))
    return out


@pytest.mark.parametrize("seed,n,records,block", [(1, 700, 10, 40), (2, 350, 7, 7), (3, 1000, 50, 64), (4, 5, 10, 10), (5, 41, 1, 5), (6, 900, 30, 5000)])
def test_cuts_equal_a_sequential_cut(spark, seed, n, records, block):
    rng = random.Random(seed)
    sizes = [(rng.choice([0, 1, 5, 30, 120]), rng.choice([0, 3, 50, 900])) for _ in range(n)]
    keys = rng.sample(range(10 * n), n)
    rows = [(key, a, b, "x") for key, (a, b) in zip(sorted(keys), sizes)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "record long, atoms long, bytes long, batch_note string")
    cut = batching.batches(frame, ["record"], "atoms", "bytes", records, max_atoms=100, max_bytes=1000, block_rows=block)
    found = [(r["batch"], r["place"]) for r in cut.orderBy("ordinal").collect()]
    assert found == one_by_one(sizes, records, 100, 1000)


def test_empty_load_and_wrong_block(spark):
    frame = spark.createDataFrame([], "record long, atoms long, bytes long")
    assert batching.batches(frame, ["record"], "atoms", "bytes").count() == 0
    with pytest.raises(ValueError):
        batching.batches(frame, ["record"], "atoms", "bytes", records=10, block_rows=9)


EQUAL = [
    ["1", "1.0", "10e-1", "0.1E+1", "1.000"],
    ["0", "-0", "0.00", "0e9", "-0.0e-3"],
    ["-12", "-1.2e1", "-12.0"],
    ["true"], ["false"], ["null"], ['"1"', '"\\u0031"'], ['"true"'], ["[]"], ["{}"], ['""'],
    ['{"a": 1, "b": [1.0, true]}', '{"b": [1, true], "a": 10e-1}'],
    ["[1, 2]", "[1.0, 2e0]"], ["[2, 1]"], ["[[1], 2]"], ["[[1, 2]]"], ['{"a": {"b": null}}'], ['{"a": null, "b": null}'], ['["a", "b"]'], ['["a\\", \\"b"]'],
    ["100000000000000000000000000000001"], ["100000000000000000000000000000002"], ['"\\ud800"'], ['{"0": 1}'], ["[1]"],
]


def test_digests_tell_values_apart():
    classes = [{flatten.value_digest(text) for text in group} for group in EQUAL]
    assert all(len(c) == 1 for c in classes) and len(set().union(*classes)) == len(EQUAL)


def test_every_node_has_the_digest_of_its_value(spark):
    doc = {"a": [1, {"b": [None, True, "x"], "c/d": {}}, []], "e": "y", "f": {"g": [[2.5]]}}
    flat = flatten.flatten_json(spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "id long, raw string"), "id", "raw", digests=True)

    def at(pointer):
        value = doc
        for step in pointer.split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            value = value[int(step)] if isinstance(value, list) else value[step]
        return json.dumps(value)

    rows = flat.filter("id = 1").collect()
    assert all(r["digest"] == flatten.value_digest(at(r["source_path"])) for r in rows) and len(rows) > 12
    assert [r["digest"] for r in flat.filter("id > 1").collect()] == [None, None]
    plain = flatten.flatten_json(spark.createDataFrame([(1, json.dumps(doc))], "id long, raw string"), "id", "raw")
    assert "digest" not in plain.columns and plain.count() == len(rows)


def test_deep_records_keep_their_digest():
    deep = "[" * 900 + "]" * 900
    assert flatten.value_digest(deep) != flatten.value_digest("[" * 899 + "]" * 899)


def test_refused_records_come_out_whole(spark):
    raws = [(1, "[1]"), (2, "[" + "0," * 20_000 + "0]"), (3, "{"), (4, None), (5, "[" * 70 + "]" * 70)]
    records = spark.createDataFrame(raws, "id long, raw string")
    limits = flatten.record_limits(records, flatten.flatten_json(records, "id", "raw"), "id", "raw")
    kept, refused = flatten.set_aside(records, limits, "id")
    assert [tuple(r) for r in kept.collect()] == [(1, "[1]")]
    want = {2: "leaves", 3: "json_invalid", 4: "json_missing", 5: "depth"}
    assert {r["id"]: (r["refused"], r["raw"]) for r in refused.collect()} == {k: (want[k], raw) for k, raw in raws if k in want}
