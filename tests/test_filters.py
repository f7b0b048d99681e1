"""Filters as rows against walking each tree for each entity."""

import json
import random
import uuid

import pytest

from factledger.functions.text import fold_text
from factledger.operators import filters
from factledger.operators.flatten import value_digest

VALUES = "entity long, item long, field string, value string, json_type string, digest string, folded string"
FIELDS = ["name", "status", "price", "gift"]


def json_type(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "decimal", str: "text", list: "array", dict: "object"}[type(value)]


def equal(a, b):
    return value_digest(json.dumps(a)) == value_digest(json.dumps(b))


def compare(values, field, op, wanted):
    if op == "exists":
        return bool(values) == wanted
    if op == "is_null":
        return any((v is None) == wanted for v in values)

    def one(v):
        if op in ("eq", "in"):
            several = wanted if op == "in" else [wanted]
            if field == "name" and isinstance(v, str):
                return any(isinstance(w, str) and fold_text(w) == fold_text(v) for w in several)
            return any(equal(v, w) for w in several)
        if op == "range":
            if isinstance(v, bool) or not isinstance(v, (int, float, str)):
                return False
            if any(b is not None and isinstance(b, str) != isinstance(v, str) for b in wanted):
                return False
            return (wanted[0] is None or v >= wanted[0]) and (wanted[1] is None or v <= wanted[1])
        if not isinstance(v, str):
            return False
        return fold_text(wanted) in fold_text(v) if op == "contains" else fold_text(v).startswith(fold_text(wanted))

    return any(one(v) for v in values)


def matches(items, tree, every=None):
    if "and" in tree:
        return all(matches(items, t) for t in tree["and"])
    if "or" in tree:
        return any(matches(items, t) for t in tree["or"])
    if "item" in tree:
        return any(matches({i: rows}, tree["item"]) for i, rows in items.items())
    values = [v for rows in items.values() for f, v in rows if f == tree["field"]]
    return compare(values, tree["field"], tree.get("op", "eq"), tree.get("value"))


def tree(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {rng.choice(["and", "or"]): [tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]}
    if depth < 4 and kind < 0.55:
        return {"item": tree(rng, depth + 1)}
    op = rng.choice(filters.OPERATORS)
    value = {
        "exists": lambda: rng.random() < 0.5,
        "is_null": lambda: rng.random() < 0.5,
        "range": lambda: rng.choice([[1, 3], [None, 2.5], ["a", None], [None, None], ["a", "f"], [2, None]]),
        "in": lambda: rng.sample(STOCK, 3),
        "contains": lambda: rng.choice(["abc", "\u00c9LA", "ela"]),
        "prefix": lambda: rng.choice(["a", "\u00e9", "EL"]),
    }.get(op, lambda: rng.choice(STOCK))()
    return {"field": rng.choice(FIELDS), "op": op, "value": value}


STOCK = [None, True, False, 1, 1.0, 2, 2.5, 3, "1", "abc", "\u00c9lan", "elan", "zabcz", "f", [1, 2], [1.0, 2], {"k": 1}, ""]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(17)
    entities = {e: {i: [(rng.choice(FIELDS), rng.choice(STOCK)) for _ in range(rng.randrange(1, 5))] for i in range(rng.randrange(4))} for e in range(40)}
    rows = [
        (e, i, f, v if isinstance(v, str) else None if v is None else json.dumps(v), json_type(v), value_digest(json.dumps(v)), fold_text(v) if isinstance(v, str) else None)
        for e, items in entities.items() for i, found in items.items() for f, v in found
    ]
    return entities, spark.createDataFrame(rows, VALUES)


def test_trees_equal_a_walk_of_each_tree(spark, world):
    entities, values = world
    rng = random.Random(23)
    trees = {f"e{k}": tree(rng) for k in range(60)}
    nodes = filters.filter_table(spark, trees).withColumnRenamed("filter_id", "input_id")
    links = [(name, e) for name in [*trees, "free"] for e in entities if rng.random() < 0.8]
    found = filters.passing(spark.createDataFrame([*links, links[0]], "input_id string, entity long"), nodes, values, "entity")
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((name, e) for name, e in links if name == "free" or matches(entities[e], trees[name]))
    assert 200 < len(got) < len(links)


def test_no_links_and_no_filters(spark, world):
    nodes = filters.filter_table(spark, {"a": {"field": "name", "value": "x"}}).withColumnRenamed("filter_id", "input_id")
    links = spark.createDataFrame([("b", 1)], "input_id string, entity long")
    assert filters.passing(links.limit(0), nodes, world[1], "entity").count() == 0
    assert [tuple(r) for r in filters.passing(links, nodes.limit(0), world[1], "entity").collect()] == [("b", 1)]


def test_values_are_made_once(spark, world, tmp_path):
    def noted(batches):
        for batch in batches:
            (tmp_path / uuid.uuid4().hex).touch()
            yield batch

    values = world[1].coalesce(1).mapInArrow(noted, world[1].schema)
    trees = {"a": {"and": [{"field": "name", "value": "abc"}, {"item": {"field": "name", "op": "exists", "value": True}}]}}
    nodes = filters.filter_table(spark, trees).withColumnRenamed("filter_id", "input_id")
    links = spark.createDataFrame([("a", e) for e in range(40)], "input_id string, entity long")
    filters.passing(links, nodes, values, "entity").collect()
    assert len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize(
    "bad",
    [
        {"and": []}, {"or": "x"}, {"and": [{}], "or": [{}]}, {"field": "a", "op": "like", "value": 1}, {"field": "a", "op": "exists", "value": 1},
        {"field": "a", "op": "range", "value": [1]}, {"field": "a", "op": "range", "value": [1, "b"]}, {"field": "a", "op": "range", "value": [True, None]},
        {"field": "a", "op": "contains", "value": "ab"}, {"field": "a", "op": "in", "value": [1] * 1001}, {"field": "a", "note": 1}, [],
        {"and": [{"and": [{"and": [{"and": [{"and": [{"and": [{"and": [{"and": [{"item": {"field": "a", "value": 1}}]}]}]}]}]}]}]}]},
    ],
)
def test_filters_that_are_refused(bad):
    with pytest.raises(ValueError):
        filters.filter_rows(bad)
