"""JSON records to rows: every leaf and every container, nothing dropped."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.workspace import pin

MAX_LEAVES = 20_000
MAX_BYTES = 2 * 1024 * 1024
MAX_DEPTH = 64
#: Why a record is one ``error`` row, in code point order.
ERRORS = ("json_duplicate_keys", "json_invalid", "json_missing", "json_non_finite")
_ROWS_PER_YIELD = 50_000


class _Number(str):
    """A number kept as the text it was written with."""

    __slots__ = ()  # without a dictionary each, the collector has nothing to visit


class _Integer(_Number):
    __slots__ = ()


class _Refused(ValueError):
    pass


def _object(pairs):
    fields = dict(pairs)
    if len(fields) != len(pairs):
        raise _Refused("json_duplicate_keys")
    return fields


def _constant(_):
    raise _Refused("json_non_finite")


def _spelled(text: str) -> str:
    """Lone surrogates as their escapes: they have no place in UTF-8."""
    return text.encode("utf-8", "backslashreplace").decode()


_DECODER = json.JSONDecoder(parse_float=_Number, parse_int=_Integer, parse_constant=_constant, object_pairs_hook=_object)


def _load(raw: str):
    """The value of a JSON text, numbers with their spelling; refuses what can't be kept."""
    return _DECODER.decode(raw)


_PARTS = re.compile(r"(-?)([0-9]+)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?")


def _number_key(text: str) -> str:
    """One spelling for all spellings of a number: digits without zeros at either end, and an exponent."""
    sign, whole, fraction, power = _PARTS.fullmatch(text).groups(default="")
    digits = (whole + fraction).lstrip("0")
    kept = digits.rstrip("0")
    return f"{sign}{kept}e{int(power or 0) - len(fraction) + len(digits) - len(kept)}" if kept else "0"


_quoted = json.encoder.encode_basestring_ascii
#: Texts up to this length are looked up in the bounded tables of steps and digests.
_SHORT = 64


def _sha(spelled: str) -> str:
    return hashlib.sha256(spelled.encode()).hexdigest()


def _scalar_digest(value) -> str:
    if isinstance(value, _Number):
        return _sha("number " + _number_key(value))
    return _sha(json.dumps(value))


@lru_cache(maxsize=1 << 14)
def _short_digest(kind: type, text: str) -> str:
    return _scalar_digest(text if kind is str else _Number(text))


#: The digests of values that have no text.
_FIXED = {None: _scalar_digest(None), True: _scalar_digest(True), False: _scalar_digest(False)}


def _digests(nodes: list[tuple]) -> list[str]:
    """The digest of every node ``(value, number of the parent, key)``; children stand behind their parents.

    Nodes are equal in JSON terms when their digests are: numbers by value,
    members of an object in any order, no other type equal to another.
    """
    below: dict[int, list] = {}
    found = [""] * len(nodes)
    for number in range(len(nodes) - 1, -1, -1):
        value, parent, key = nodes[number]
        kind = type(value)
        # members are spelled as ``json.dumps`` spells a list of pairs
        if kind is dict:
            members = ", ".join([f'[{_quoted(k)}, "{d}"]' for k, d in sorted(below.pop(number, ()))])
            digest = _sha(f"object[{members}]")
        elif kind is list:
            members = ", ".join([f'[{k}, "{d}"]' for k, d in sorted(below.pop(number, ()))])
            digest = _sha(f"array[{members}]")
        elif value is None or kind is bool:
            digest = _FIXED[value]
        elif len(value) <= _SHORT:
            digest = _short_digest(str if kind is str else _Number, value)
        else:
            digest = _scalar_digest(value)
        found[number] = digest
        if parent is not None:
            if parent in below:
                below[parent].append((key, digest))
            else:
                below[parent] = [(key, digest)]
    return found


def _nodes(root) -> list[tuple]:
    """``(value, number of the parent, key)`` of every node in the order of :func:`_walk`."""
    nodes: list[tuple] = []
    todo = [(root, None, "")]
    while todo:
        node = todo.pop()
        number = len(nodes)
        nodes.append(node)
        value = node[0]
        if type(value) is dict:
            todo.extend([(child, number, name) for name, child in value.items()])
        elif type(value) is list:
            todo.extend([(child, number, n) for n, child in enumerate(value)])
    return nodes


def value_digest(raw: str) -> str:
    """The digest of one JSON text: the operand of a comparison by value."""
    return _digests(_nodes(_load(raw)))[0]


def _step(key: str) -> str:
    """A member's part of a path."""
    return "/" + _spelled(key).replace("~", "~0").replace("/", "~1")


_short_step = lru_cache(maxsize=1 << 12)(_step)


def _places(path: str, n: int) -> list[str]:
    """The paths of a list's members, last to first."""
    steps = _PLACES[:n]
    steps.reverse()
    if n <= len(_PLACES):
        return [path + step for step in steps]
    return [f"{path}/{i}" for i in range(n - 1, len(_PLACES) - 1, -1)] + [path + step for step in steps]


#: The steps of positions in lists that records within their limits have.
_PLACES = [f"/{i}" for i in range(MAX_LEAVES)]
_BOXES, _NUMBERS = {dict, list}, {_Integer, _Number}
_SHAPES = {_Integer: "integer", _Number: "decimal"}


def _scalar(value) -> tuple[str, str | None]:
    """Type and text of a value that holds no others."""
    kind = type(value)
    if kind is str:
        if not value.isascii() and (shown := _spelled(value)) != value:
            return "unsafe_text", shown
        return "text", value
    if kind in _SHAPES:
        return _SHAPES[kind], value
    if value is None:
        return "null", None
    return "boolean", ("true" if value else "false")


def _walk(root, columns: list[list], digests: bool) -> int:
    """Append the rows of one value to the columns of :data:`_FIELDS`; returns their number."""
    kinds, paths, bases, types, values, sizes, depths, marks = columns
    before = len(kinds)
    found = _digests(_nodes(root)) if digests else None
    number = -1
    todo = [("", "", root, 0)]
    while todo:
        path, base, value, depth = todo.pop()
        number += 1
        kind = type(value)
        if kind is dict or kind is list:
            kinds.append("container")
            paths.append(path)
            bases.append(base)
            types.append("object" if kind is dict else "array")
            values.append(None)
            sizes.append(len(value))
            depths.append(depth)
            if found:
                marks.append(found[number])
            if value:
                below = depth + 1
                children = list(value.values()) if kind is dict else value
                inner = set(map(type, children))
                steps = [_short_step(key) if len(key) <= _SHORT else _step(key) for key in value] if kind is dict else None
                if not inner.isdisjoint(_BOXES):
                    if steps:
                        todo.extend([(path + step, base + step, child, below) for step, child in zip(steps, children)])
                    else:
                        todo.extend([(f"{path}/{i}", base, child, below) for i, child in enumerate(children)])
                    continue
                # leaves alone: appended at once, last to first as the others are popped
                n = len(children)
                if steps:
                    steps.reverse()
                    paths.extend([path + step for step in steps])
                    bases.extend([base + step for step in steps])
                else:
                    paths.extend(_places(path, n))
                    bases.extend([base] * n)
                if len(inner) == 1 and inner <= _NUMBERS:
                    types.extend([_SHAPES[inner.pop()]] * n)
                    values.extend(children[::-1])
                else:
                    for child in reversed(children):
                        shape, text = _scalar(child)
                        types.append(shape)
                        values.append(text)
                kinds.extend(["leaf"] * n)
                sizes.extend([None] * n)
                depths.extend([below] * n)
                if found:
                    marks.extend(found[number + 1 : number + 1 + n])
                number += n
                continue
            shape, text = ("empty_object" if kind is dict else "empty_array"), None
        else:
            shape, text = _scalar(value)
        kinds.append("leaf")
        paths.append(path)
        bases.append(base)
        types.append(shape)
        values.append(text)
        sizes.append(None)
        depths.append(depth)
        if found:
            marks.append(found[number])
    return len(kinds) - before


def _rows(raw: str | None, columns: list[list], digests: bool) -> int:
    """Append (kind, path, base, type, value, size, depth, digest) of one record; returns the number of rows."""
    error, root = None, None
    try:
        if raw is None:
            error = "json_missing"
        else:
            root = _load(raw)
    except _Refused as refused:
        error = str(refused)
    except (ValueError, RecursionError):
        error = "json_invalid"
    if error is None:
        return _walk(root, columns, digests)
    for column, cell in zip(columns, ("error", "", "", error, None, None, 0, None)):
        column.append(cell)
    return 1


_FIELDS = (
    ("row_kind", pa.string(), "string"),
    ("source_path", pa.string(), "string"),
    ("base_field", pa.string(), "string"),
    ("json_type", pa.string(), "string"),
    ("value", pa.string(), "string"),
    ("size", pa.int64(), "long"),
    ("depth", pa.int64(), "long"),
    ("digest", pa.string(), "string"),
)


def flatten_json(records: DataFrame, record: str, raw: str, digests: bool = False) -> DataFrame:
    """One row per leaf and container of every record.

    Paths are JSON pointers; ``base_field`` leaves array positions out. Numbers
    keep their spelling. A record that cannot be read faithfully becomes one
    ``error`` row. Records are independent, so this is a single narrow pass.
    With ``digests`` every leaf and container has the digest of its value, by
    which values of any depth are compared as a column.
    """
    fields = _FIELDS if digests else _FIELDS[:-1]

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idents = batch.column(0)
            columns: list[list] = [[] for _ in _FIELDS]
            first, counts, held = 0, [], 0
            for place, text in enumerate(batch.column(1).to_pylist(), 1):
                counts.append(_rows(text, columns, digests))
                held += counts[-1]
                if held >= _ROWS_PER_YIELD:
                    yield _batch(record, idents, first, counts, columns, fields)
                    first, counts, held, columns = place, [], 0, [[] for _ in _FIELDS]
            if held:
                yield _batch(record, idents, first, counts, columns, fields)

    kind = records.schema[record].dataType.simpleString()
    schema = ", ".join([f"{record} {kind}", *[f"{name} {ddl}" for name, _, ddl in fields]])
    return records.select(record, raw).mapInArrow(flatten, schema)


def _batch(record: str, idents: pa.Array, first: int, counts: list[int], columns: list[list], fields: tuple) -> pa.RecordBatch:
    """The rows of the records from ``first`` on, of which each gave so many."""
    arrays = [idents.take(pa.array(np.repeat(np.arange(first, first + len(counts)), counts)))]
    arrays += [pa.array(values, kind) for values, (_, kind, _) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[record, *[name for name, _, _ in fields]])


def leaves(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("row_kind") == "leaf").drop("row_kind", "size")


def containers(flat: DataFrame) -> DataFrame:
    return flat.filter(F.col("row_kind") == "container").drop("row_kind", "value", "base_field")


def structure_rows(flat: DataFrame) -> DataFrame:
    """Nested value as sheet rows: pointer, type, scalar; containers first-class."""
    shown = flat.filter(~F.col("json_type").isin("empty_object", "empty_array") & (F.col("row_kind") != "error"))
    number = F.col("json_type").isin("integer", "decimal")
    return shown.withColumn("type", F.when(number, "number").otherwise(F.col("json_type")))


def record_limits(records: DataFrame, flat: DataFrame, record: str, raw: str) -> DataFrame:
    """Size of every record and the limit it breaks, if any; records stay whole."""
    errors = F.array(*[F.lit(e) for e in ERRORS])
    # the greatest error by its number: a greatest text would have Spark sort every leaf by record
    sizes = flat.groupBy(record).agg(
        F.sum(F.when(F.col("row_kind") == "leaf", 1).otherwise(0)).alias("leaves"), F.max("depth").alias("depth"),
        F.max(F.when(F.col("row_kind") == "error", F.array_position(errors, F.col("json_type")))).alias("error"),
    )
    sizes = sizes.withColumn("error", F.try_element_at(errors, F.col("error").cast("int")))
    measured = records.select(record, F.octet_length(raw).cast("long").alias("bytes")).join(sizes, record)
    refused = measured.withColumn(
        "refused",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("depth") > MAX_DEPTH, "depth")
        .when(F.col("leaves") > MAX_LEAVES, "leaves")
        .when(F.col("bytes") > MAX_BYTES, "bytes"),
    )
    return refused.drop("error")


def quarantine(records: DataFrame, flat: DataFrame, record: str) -> DataFrame:
    """Records that could not be read, whole, with the ``error`` code."""
    codes = flat.filter(F.col("row_kind") == "error").select(record, F.col("json_type").alias("error"))
    return records.join(codes, record)


def set_aside(records: DataFrame, limits: DataFrame, record: str) -> tuple[DataFrame, DataFrame]:
    """Records within their limits, and the others, whole, with the limit they break."""
    # written first: the few refused ones are then sent to the records, not the records' texts dealt by key
    refused = pin(limits.filter(F.col("refused").isNotNull()).select(record, "refused"), "refused")
    return records.join(refused.select(record), record, "left_anti"), records.join(refused, record)
