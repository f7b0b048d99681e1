"""Ordering records by one to five criteria.

Every record gets one binary key that already holds the whole order: for each
criterion a byte that puts missing values last, then the value in bytes that
compare as it does, inverted for a descending criterion. So any plan is one
range sort, and one keyset page on a single column.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions.temporal import parse_date, utc_instant
from factledger.functions.text import sort_text
from factledger.operators.search import not_invalid

MAX_CRITERIA = 5

# Sortable fields, the item kind they belong to (None: the record) and their type.
FIELDS: dict[str, tuple[str | None, str]] = {
    "name": ("identity", "text"),
    "updated_at": (None, "instant"),
    "id": (None, "text"),
    "birth_date": ("identity", "date"),
    "city": ("address", "text"),
    "state": ("address", "text"),
    "postal_code": ("address", "text"),
}

_HEX, _INVERTED = "0123456789ABCDEF", "FEDCBA9876543210"
_PRESENT, _MISSING = "01", "02"


@dataclass(frozen=True)
class Criterion:
    field: str
    direction: str
    mode: str | None = None


def sort_plan(sorts: Sequence[Mapping[str, str]], fields: Mapping[str, tuple[str | None, str]] = FIELDS) -> tuple[Criterion, ...]:
    """Checked criteria, ended by the ascending ``id`` unless it is given.

    A field with several values per record is represented by its least or
    greatest one (``mode``): least when ascending, greatest when descending.
    """
    if not 1 <= len(sorts) <= MAX_CRITERIA:
        raise ValueError(f"one to {MAX_CRITERIA} criteria are needed")
    plan: list[Criterion] = []
    for place, given in enumerate(sorts):
        unknown = set(given) - {"field", "direction", "mode"}
        if unknown or not {"field", "direction"} <= set(given):
            raise ValueError("a criterion has a field, a direction and perhaps a mode")
        field, direction, mode = given["field"], given["direction"], given.get("mode")
        if field not in fields:
            raise ValueError(f"{field} cannot be sorted by")
        if any(c.field == field for c in plan):
            raise ValueError(f"{field} is given twice")
        if field == "id" and place != len(sorts) - 1:
            raise ValueError("id must be the last criterion")
        if direction not in ("asc", "desc"):
            raise ValueError("a direction is asc or desc")
        several = fields[field][0] is not None
        if "mode" in given and (not several or mode not in ("min", "max")):
            raise ValueError("a mode is min or max, for fields of items only")
        if several and mode is None:
            mode = "min" if direction == "asc" else "max"
        plan.append(Criterion(field, direction, mode))
    if all(c.field != "id" for c in plan):
        plan.append(Criterion("id", "asc"))
    return tuple(plan)


def _whole(number: Column) -> Column:
    """64-bit integer as 16 hex digits that compare as it does."""
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def _spelled(value: Column, folded: Column, kind: str) -> Column:
    """Hex digits of a value that compare as it does; null when it has no such value."""
    if kind == "date":
        return _whole(F.unix_date(parse_date(value)))
    if kind == "instant":
        return _whole(F.unix_micros(utc_instant(value)))
    if kind == "integer":
        return _whole(value.try_cast("bigint"))
    # zero bytes end a text, so those inside one are marked
    marked = F.replace(folded, F.lit("\x00"), F.lit("\x00\x01"))
    return F.concat(F.hex(F.encode(marked, "UTF-8")), F.lit("0000"))


def _step(spelled: Column, direction: str) -> Column:
    if direction == "desc":
        spelled = F.translate(spelled, _HEX, _INVERTED)
    return F.coalesce(F.concat(F.lit(_PRESENT), spelled), F.lit(_MISSING))


def with_sort_key(
    records: DataFrame,
    plan: Sequence[Criterion],
    items: DataFrame | None = None,
    fields: Mapping[str, tuple[str | None, str]] = FIELDS,
    include_invalid: bool = False,
    name: str = "sort_key",
) -> DataFrame:
    """``records`` with the binary key of ``plan``.

    ``records`` has ``id`` and the record's own sort fields as text (an
    ``integer`` field may be a number). ``items`` has ``id, kind, field, value,
    json_type, valid``: one row per value. Values of another JSON type than
    text (whole numbers for ``integer``), dates that do not exist and instants
    without an offset count as missing; items whose flag says invalid are left
    out unless asked for. Texts compare by the code points of their composed
    casefolded form.
    """
    own = [c for c in plan if fields[c.field][0] is None]
    several = [c for c in plan if fields[c.field][0] is not None]
    steps: dict[str, Column] = {}
    rows = records
    for c in own:
        kind = fields[c.field][1]
        value = F.col(c.field)
        folded = sort_text(value.cast("string")) if kind == "text" else value
        rows = rows.withColumn(f"_own_{c.field}", _spelled(value, folded, kind))
        steps[c.field] = F.col(f"_own_{c.field}")
    if several:
        assert items is not None, "these criteria need the records' items"
        asked = [F.struct(F.lit(fields[c.field][0]).alias("kind"), F.lit(c.field).alias("field")) for c in several]
        wanted = items.filter(F.struct("kind", "field").isin(*asked))
        if not include_invalid:
            wanted = wanted.filter(not_invalid(F.col("valid")))
        wanted = wanted.withColumn("_folded", sort_text(F.when(F.col("json_type") == "text", F.col("value"))))
        found = []
        for c in several:
            item, kind = fields[c.field]
            typed = F.col("json_type") == ("integer" if kind == "integer" else "text")
            mine = (F.col("kind") == item) & (F.col("field") == c.field) & typed
            spelled = F.when(mine, _spelled(F.col("value"), F.col("_folded"), kind))
            found.append((F.min if c.mode == "min" else F.max)(spelled).alias(f"_item_{c.field}"))
            steps[c.field] = F.col(f"_item_{c.field}")
        rows = rows.join(wanted.groupBy("id").agg(*found), "id", "left")
    key = F.unhex(F.concat(*[_step(steps[c.field], c.direction) for c in plan]))
    return rows.withColumn(name, key).drop(*[f"_own_{c.field}" for c in own], *[f"_item_{c.field}" for c in several])
