"""Filters given as rows, one tree per list entry, evaluated by joins.

A filter is a tree of ``and``, ``or`` and ``item`` nodes over comparisons of one
field. Trees are rows, so a list of any length brings its filters as a table:
every candidate link meets the comparisons of its entry and the values of its
entity by equality, and truth is folded up the trees level by level. Nothing is
planned or written per entry.

Comparisons below an ``item`` node must hold on one and the same item; the
others may hold on any. Values are compared as JSON: by the digest of
:func:`factledger.operators.flatten.value_digest`, by folded text, or in order.
"""

from __future__ import annotations

import json
from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.functions.text import fold_text
from factledger.operators.flatten import value_digest
from factledger.workspace import pin

MAX_DEPTH = 8
MAX_CHILDREN = 50
MAX_OPERANDS = 1000
OPERATORS = ("eq", "in", "contains", "prefix", "range", "exists", "is_null")
#: Texts of these fields are equal when their folded forms are.
FOLDED_FIELDS = ("name",)

NODES = (
    "node int, parent int, depth int, shape string, in_item boolean, field string, op string, wanted boolean, "
    "operands array<struct<digest: string, folded: string>>, low string, high string"
)


def _spelled(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def _comparison(given: Mapping) -> tuple:
    """``(field, op, wanted, operands, low, high)`` of one comparison."""
    field, op, value = given.get("field"), given.get("op", "eq"), given.get("value")
    if not isinstance(field, str) or op not in OPERATORS or set(given) - {"field", "op", "value"}:
        raise ValueError("a comparison has a field, a known operator and a value")
    if op in ("exists", "is_null"):
        if not isinstance(value, bool):
            raise ValueError(f"{op} needs true or false")
        return field, op, value, [], None, None
    if op == "range":
        if not isinstance(value, list) or len(value) != 2:
            raise ValueError("a range has two bounds")
        bounds = [v for v in value if v is not None]
        if any(isinstance(v, bool) or not isinstance(v, (int, float, str)) for v in bounds):
            raise ValueError("bounds are numbers or texts")
        if len({isinstance(v, str) for v in bounds}) > 1:
            raise ValueError("bounds are of one type")
        return field, op, None, [], *[None if v is None else _spelled(v) for v in value]
    several = value if op == "in" else [value]
    if not isinstance(several, list) or len(several) > MAX_OPERANDS:
        raise ValueError(f"in needs a list of at most {MAX_OPERANDS} values")
    if op in ("contains", "prefix") and (not isinstance(value, str) or len(value) < (3 if op == "contains" else 1)):
        raise ValueError("the text to look for is too short")
    operands = [(value_digest(_spelled(v)), fold_text(v) if isinstance(v, str) else None) for v in several]
    return field, op, None, operands, None, None


def filter_rows(tree: Mapping) -> list[tuple]:
    """The rows of one filter in the order of :data:`NODES`; node 0 is the root."""
    rows: list[tuple] = []

    def walk(given: Mapping, parent: int | None, depth: int, in_item: bool) -> None:
        if depth > MAX_DEPTH or not isinstance(given, Mapping):
            raise ValueError("a filter is too deep or no filter")
        node = len(rows)
        shape = next((key for key in ("and", "or", "item") if key in given), None)
        if shape is None:
            rows.append((node, parent, depth, "leaf", in_item, *_comparison(given)))
            return
        children = [given[shape]] if shape == "item" else given[shape]
        if set(given) != {shape} or not isinstance(children, list) or not 1 <= len(children) <= MAX_CHILDREN:
            raise ValueError(f"a group has 1 to {MAX_CHILDREN} members")
        rows.append((node, parent, depth, shape, in_item, None, None, None, [], None, None))
        for child in children:
            walk(child, node, depth + 1, in_item or shape == "item")

    walk(tree, None, 0, False)
    return rows


def filter_table(spark: SparkSession, trees: Mapping[str, Mapping]) -> DataFrame:
    """``(filter_id, ...NODES)`` of named filters: those a list's entries refer to."""
    rows = [(name, *row) for name, tree in trees.items() for row in filter_rows(tree)]
    return spark.createDataFrame(rows, f"filter_id string, {NODES}")


def _within(value: Column, json_type: Column) -> Column:
    """The value lies within the node's bounds, numbers and texts apart."""

    def bound(name: str) -> tuple[Column, Column]:
        text = F.get_json_object(F.concat(F.lit('{"v":'), F.col(name), F.lit("}")), "$.v")
        return text, F.startswith(F.col(name), F.lit('"'))

    number = value.try_cast("decimal(38,12)")
    numeric = json_type.isin("integer", "decimal")
    good = F.lit(True)
    for name, holds in (("low", lambda a, b: a >= b), ("high", lambda a, b: a <= b)):
        text, is_text = bound(name)
        as_number = numeric & ~is_text & holds(number, text.try_cast("decimal(38,12)"))
        as_text = (json_type == "text") & is_text & holds(value, text)
        good = good & (F.col(name).isNull() | as_number | as_text)
    return good & (numeric | (json_type == "text"))


def _holds() -> Column:
    """Whether one value satisfies its comparison; null where there is no value at all."""
    op = F.col("op")
    folded_field = F.col("field").isin(*FOLDED_FIELDS) & (F.col("json_type") == "text")
    equal = F.when(
        folded_field, F.exists("operands", lambda o: o["folded"] == F.col("folded"))
    ).otherwise(F.exists("operands", lambda o: o["digest"] == F.col("digest")))
    none = F.col("json_type") == "null"
    first = F.get(F.col("operands"), F.lit(0))["folded"]
    return (
        F.when(op.isin("eq", "in"), equal)
        .when(op == "contains", F.contains("folded", first))
        .when(op == "prefix", F.startswith("folded", first))
        .when(op == "range", _within(F.col("value"), F.col("json_type")))
        .when(op == "exists", F.lit(True))
        .when(op == "is_null", F.when(F.col("wanted"), none).otherwise(~none))
    )


def _truth(asked: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, node, parent, truth)`` of comparisons asked of an entity or an item."""
    found = asked.join(values, [c for c in keys if c != "input_id"] + ["field"], "left")
    there = F.col("json_type").isNotNull()
    any_holds = F.bool_or(F.coalesce(there & _holds(), F.lit(False)))
    absent = (F.first("op") == "exists") & ~F.first("wanted")
    return found.groupBy(*keys, "node", "parent").agg(F.when(absent, ~F.bool_or(there)).otherwise(any_holds).alias("truth"))


def passing(links: DataFrame, nodes: DataFrame, values: DataFrame, entity: str) -> DataFrame:
    """The links ``(input_id, <entity>)`` whose entry has no filter or one that holds.

    ``nodes`` is ``(input_id, ...NODES)``; ``values`` is ``(<entity>, item, field,
    value, json_type, digest, folded)``, one row per value, items that may not
    be searched left out.
    """
    pairs = pin(links.select("input_id", entity).distinct(), "filter-links")
    nodes = pin(nodes, "filter-nodes")
    # three steps read the values: made once, of the linked entities alone
    values = pin(values.join(pairs.select(entity).distinct(), entity, "left_semi"), "filter-values")
    leaves = nodes.filter("shape = 'leaf'")
    asked = pairs.join(leaves.select("input_id", "node", "parent", "in_item", "field", "op", "wanted", "operands", "low", "high"), "input_id")
    plain = _truth(asked.filter("NOT in_item").drop("in_item"), values.drop("item"), ["input_id", entity])
    items = values.select(entity, "item").distinct()
    each = asked.filter("in_item").drop("in_item").join(items, entity)
    inside = _truth(each, values, ["input_id", entity, "item"])
    truth = pin(plain.withColumn("item", F.lit(None).cast(values.schema["item"].dataType)).unionByName(inside), "filter-truth")
    inner = nodes.filter("shape <> 'leaf'").select("input_id", "node", F.col("parent").alias("above"), "depth", "shape", "in_item")
    for depth in range(MAX_DEPTH, -1, -1):
        level = inner.filter(F.col("depth") == depth)
        if level.isEmpty():
            continue
        below = truth.withColumnRenamed("node", "child").withColumnRenamed("parent", "node").join(level, ["input_id", "node"])
        # truth found on items becomes the entity's at the item node
        item = F.when((F.col("shape") == "item") & ~F.col("in_item"), None).otherwise(F.col("item"))
        every = below.withColumn("item", item)
        # an entity without items fails its item nodes
        bare = pairs.join(level.filter("shape = 'item' AND NOT in_item"), "input_id")
        bare = bare.withColumn("truth", F.lit(False)).withColumn("item", F.lit(None).cast(values.schema["item"].dataType))
        columns = ["input_id", entity, "item", "node", "above", "shape", "truth"]
        every = every.select(*columns).unionByName(bare.select(*columns))
        folded = F.when(F.first("shape") == "and", F.bool_and("truth")).otherwise(F.bool_or("truth"))
        up = every.groupBy("input_id", entity, "item", "node", "above").agg(folded.alias("truth")).withColumnRenamed("above", "parent")
        truth = pin(truth.unionByName(up), "filter-truth")
    good = truth.filter("node = 0 AND truth").select("input_id", entity).distinct()
    free = pairs.join(nodes.select("input_id").distinct(), "input_id", "left_anti")
    return free.unionByName(pairs.join(good, ["input_id", entity], "left_semi"))
