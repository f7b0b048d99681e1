"""Record search over multi-valued items.

A record matches when one of its eligible items does. Conditions on one item
are combined on the item row and become a left-semi join; conditions that may
hold on different items are aggregated to one flag each per record.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions.text import fold, fold_text

UNRESOLVED = ("pending", "ambiguous", "unclassified")  # fixed values: unresolved statuses


def in_range(value: Column, low=None, high=None) -> Column:
    """Inclusive range; an open bound adds no predicate, so the rest pushes down."""
    condition = value.isNotNull()
    if low is not None:
        condition = condition & (value >= F.lit(low))
    if high is not None:
        condition = condition & (value <= F.lit(high))
    return condition


def fold_contains(value: Column, query: str) -> Column:
    """Accent- and case-insensitive substring; wildcards are literal."""
    if len(query) < 3:
        raise ValueError("contains needs at least three characters")
    return F.contains(fold(value), F.lit(fold_text(query)))


def fold_prefix(value: Column, query: str, beside_selective: bool = False) -> Column:
    """Accent- and case-insensitive prefix; one character only beside a selective filter."""
    if len(query) < (1 if beside_selective else 2):
        raise ValueError("a one-character prefix needs a selective filter beside it")
    return F.startswith(fold(value), F.lit(fold_text(query)))


def with_item(records: DataFrame, items: DataFrame, on: str | Sequence[str], condition: Column | None = None) -> DataFrame:
    """Records with at least one item satisfying the whole condition."""
    wanted = items if condition is None else items.filter(condition)
    return records.join(wanted.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def without_item(records: DataFrame, items: DataFrame, on: str, condition: Column | None = None) -> DataFrame:
    """Records with no item satisfying the condition."""
    wanted = items if condition is None else items.filter(condition)
    return records.join(wanted.select(on), on, "left_anti")


def record_flags(items: DataFrame, on: str, conditions: dict[str, Column]) -> DataFrame:
    """One boolean per condition and record: does any item satisfy it?"""
    return items.groupBy(on).agg(
        *[F.coalesce(F.max(c), F.lit(False)).alias(name) for name, c in conditions.items()]
    )


def not_invalid(flag: Column) -> Column:
    """Only an explicit ``false`` excludes; unknown does not."""
    return ~F.coalesce(flag == F.lit(False), F.lit(False))


def resolved(status: Column) -> Column:
    return ~status.isin(*UNRESOLVED)


def is_live(applicable: Column, expires: Column, at: Column) -> Column:
    """A confirmation that still speaks for the value at the given instant."""
    return applicable & (expires.isNull() | (expires > at))


def live_flag(flag: Column, applicable: Column, expires: Column, at: Column, expected: bool | None) -> Column:
    """Flag equals ``expected`` and is live; ``None`` asks for no live answer."""
    live = F.coalesce(is_live(applicable, expires, at), F.lit(False))
    if expected is None:
        return ~(live & flag.isNotNull())
    return live & F.coalesce(flag == F.lit(expected), F.lit(False))


def keyset_page(rows: DataFrame, order: Sequence[str], after: Sequence | None, limit: int, descending: bool = False) -> DataFrame:
    """One page after a composite key, with ``has_more``.

    The key predicate is lexicographic on plain columns, so the first column
    prunes row groups; one extra row answers ``has_more``. At most limit + 1
    rows reach the numbering window.
    """
    wanted = rows
    if after is not None:
        past = None
        for position in reversed(range(len(order))):
            column, bound = F.col(order[position]), F.lit(after[position])
            strict = column < bound if descending else column > bound
            past = strict if past is None else strict | ((column == bound) & past)
        wanted = wanted.filter(past)
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    page = wanted.orderBy(*direction).limit(limit + 1)
    everything = Window.partitionBy(F.lit(0))
    numbered = page.withColumns(
        {
            "position": F.row_number().over(everything.orderBy(*direction)).cast("long"),
            "has_more": F.count(F.lit(1)).over(everything) > limit,
        }
    )
    return numbered.filter(F.col("position") <= limit)


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One numbered page with the total and whether it ends the result."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.withColumns({"total": total, "complete": total <= F.lit(offset + limit)})


def byte_page(rows: DataFrame, order: Sequence[str], size: Column, limit: int, budget: int, envelope: int = 0) -> DataFrame:
    """Leading rows whose running size fits the budget, at most ``limit`` of them."""
    page = rows.withColumn("row_bytes", size).orderBy(*order).limit(limit + 1)
    ordered = Window.partitionBy(F.lit(0)).orderBy(*order)
    running = F.sum("row_bytes").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + envelope
    numbered = page.withColumns({"position": F.row_number().over(ordered).cast("long"), "running_bytes": running})
    fits = (F.col("running_bytes") <= budget) & (F.col("position") <= limit)
    everything = Window.partitionBy(F.lit(0))
    return numbered.withColumns(
        {
            "in_page": fits,
            "error": F.when((F.col("position") == 1) & (F.col("running_bytes") > budget), "row_too_large"),
            "has_more": F.max(~fits).over(everything),
        }
    ).filter(F.col("in_page") | F.col("error").isNotNull())


def bounded_total(rows: DataFrame, bound: int = 10000) -> DataFrame:
    """Exact count up to ``bound``, otherwise "at least" it.

    At most ``bound + 1`` empty rows are counted: a large result is not read to
    its end, and nothing comes to the driver.
    """
    found = rows.select(F.lit(1).alias("one")).limit(bound + 1).agg(F.count(F.lit(1)).alias("n"))
    return found.select(
        F.least("n", F.lit(bound).cast("long")).alias("value"), F.when(F.col("n") > bound, "gte").otherwise("eq").alias("relation")
    )
