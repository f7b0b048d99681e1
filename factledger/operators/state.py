"""Event-sourced field state: which observation of a field is current, and why.

Rows carry ``owner, item, path, dimension, id, value, effective, received,
status, source, version, seq``. ``version`` counts an owner's operations from 1
and ``seq`` the rows inside one operation, so (version, seq) is arrival order.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.ordered import BLOCK, BLOCK_ROWS, before, outgrown, version_block, with_ordinal

FIELD_KEY = ("owner", "item", "path", "dimension")
UNDATED = "0001-01-01 00:00:00"


def undated_floor() -> Column:
    """The instant undated observations rank at: below every real date."""
    return F.lit(UNDATED).cast("timestamp")


def is_future(effective: Column, received: Column) -> Column:
    """Dated more than five minutes after it was received."""
    return F.coalesce(effective > received + F.expr("INTERVAL 5 MINUTES"), F.lit(False))


def rank_of(effective: Column, received: Column, ident: Column) -> Column:
    """Orderable precedence rank: dated beats undated, then newest, then id."""
    return F.struct(
        F.coalesce(effective, undated_floor()).alias("e"), received.alias("r"), ident.alias("i")
    )


def _scan(rows: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Running maxima and the first resolved winner, block by block.

    Needs ``_elig``, ``_res`` and ``_k``. Adds ``_m`` and ``_mr``, the highest
    earlier rank of eligible and of eligible resolved rows, and ``_settled``:
    a resolved row already won the field before this one.

    A resolved row wins when its rank beats everything earlier. Inside a block
    the local winners rise in rank, so a block holds a winner exactly when its
    highest local winner beats the maximum carried into the block.
    """
    inside = Window.partitionBy(*keys, BLOCK).orderBy("version", "seq")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    k, resolved = F.col("_k"), F.col("_elig") & F.col("_res")

    def scanned(some: DataFrame) -> DataFrame:
        return some.withColumn(BLOCK, version_block(F.col("version"), block_rows)).withColumns(
            {
                "_lm": F.max(F.when(F.col("_elig"), k)).over(earlier),
                "_lmr": F.max(F.when(resolved, k)).over(earlier),
            }
        )

    beats_local = resolved & (F.col("_lm").isNull() | (k > F.col("_lm")))
    blocks = (
        scanned(outgrown(rows, keys[0], "version", block_rows))
        .groupBy(*keys, BLOCK)
        .agg(
            F.max(F.when(F.col("_elig"), k)).alias("_bm"),
            F.max(F.when(resolved, k)).alias("_bmr"),
            F.max(F.when(beats_local, k)).alias("_bc"),
        )
        .withColumns({"_cm": F.max("_bm").over(across), "_cmr": F.max("_bmr").over(across)})
        .withColumn(
            "_won", F.col("_bc").isNotNull() & (F.col("_cm").isNull() | (F.col("_bc") > F.col("_cm")))
        )
        .withColumn("_cwon", F.coalesce(F.max("_won").over(across), F.lit(False)))
        .select(*keys, BLOCK, "_cm", "_cmr", "_cwon")
    )
    joined = scanned(rows).join(blocks, [*keys, BLOCK], "left").withColumns(
        {"_m": F.greatest("_lm", "_cm"), "_mr": F.greatest("_lmr", "_cmr")}
    )
    wins = resolved & (F.col("_m").isNull() | (k > F.col("_m")))
    return (
        joined.withColumn("_win", wins)
        .withColumn("_settled", F.coalesce(F.col("_cwon"), F.lit(False)) | F.coalesce(F.max("_win").over(earlier), F.lit(False)))
        .drop("_lm", "_lmr", "_cm", "_cmr", "_cwon", "_win", BLOCK)
    )


def _decide(scanned: DataFrame, mismatch: Column) -> DataFrame:
    """``applied`` and ``pending_reason`` from the scan columns."""
    k, m, mr = F.col("_k"), F.col("_m"), F.col("_mr")
    floor = undated_floor()
    current = F.when(F.col("_settled"), mr).otherwise(m)
    beats = current.isNull() | (k > current)
    held = F.col("_settled") & ~F.col("_res")
    applied = F.col("_elig") & ~held & beats
    undated = F.col("effective").isNull() & (current["e"] > floor)
    reason = (
        F.when(mismatch, "value_mismatch")
        .when(held, "pending_against_resolved")
        .when(F.col("_future"), "future_date")
        .when(undated, "undated_against_dated")
        .when(~beats, "older_observation")
    )
    return scanned.withColumns({"applied": applied, "pending_reason": reason}).drop(
        "_k", "_m", "_mr", "_elig", "_res", "_future", "_settled"
    )


def field_precedence(
    obs: DataFrame, keys: Sequence[str] = FIELD_KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Decide for every observation whether it became the field's value."""
    rows = obs.withColumns(
        {
            "_future": is_future(F.col("effective"), F.col("received")),
            "_res": F.col("status") != "pending",
            "_k": rank_of(F.col("effective"), F.col("received"), F.col("id")),
        }
    ).withColumn("_elig", ~F.col("_future"))
    return _decide(_scan(rows, keys, block_rows), F.lit(False))


def field_precedence_by_date(
    obs: DataFrame, keys: Sequence[str] = FIELD_KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Variant where only dates decide and the later arrival wins a tie."""
    dated = F.coalesce("effective", undated_floor())
    rows = obs.withColumn("_future", is_future(F.col("effective"), F.col("received")))
    scanned = before(rows, keys, ["version", "seq"], {"_m": ("max", F.when(~F.col("_future"), dated))}, block_rows)
    applied = ~F.col("_future") & (F.col("_m").isNull() | (dated >= F.col("_m")))
    return scanned.withColumns(
        {"applied": applied, "pending_reason": F.when(F.col("_future"), "future_timestamp")}
    ).drop("_future", "_m")


def flag_precedence(
    values: DataFrame,
    flags: DataFrame,
    binding_of: Column,
    keys: Sequence[str] = ("owner", "item", "path"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Precedence of flag rows that must match the value current on arrival.

    ``values`` are decided value rows (with ``applied``); ``flags`` carry a
    ``binding``; ``binding_of`` turns a value row into its binding.
    """
    keys = list(keys)
    seen = F.when(F.col("applied"), F.struct("version", "seq", binding_of.alias("b")))
    value_marks = values.select(*keys, "version", "seq", seen.alias("_mark"), F.lit(None).cast("long").alias("id"))
    flag_marks = flags.select(*keys, "version", "seq", F.lit(None).cast(value_marks.schema["_mark"].dataType).alias("_mark"), "id")
    marks = value_marks.unionByName(flag_marks)
    current = before(marks, keys, ["version", "seq"], {"_now": ("max", F.col("_mark"))}, block_rows)
    bound = current.filter(F.col("id").isNotNull()).select(
        *keys, "version", "seq", F.col("_now.b").alias("current_binding")
    )
    rows = flags.join(bound, [*keys, "version", "seq"]).withColumns(
        {
            "_match": F.coalesce(F.col("binding") == F.col("current_binding"), F.lit(False)),
            "_future": is_future(F.col("effective"), F.col("received")),
            "_res": F.col("status") != "pending",
            "_k": rank_of(F.col("effective"), F.col("received"), F.col("id")),
        }
    ).withColumn("_elig", F.col("_match") & ~F.col("_future"))
    decided = _decide(_scan(rows, [*keys, "dimension"], block_rows), ~F.col("_match"))
    return decided.withColumnRenamed("_match", "binding_matches")


def previous_applied(
    decided: DataFrame, keys: Sequence[str] = FIELD_KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Id and value that were current when each observation arrived."""
    mark = F.when(F.col("applied"), F.struct("version", "seq", "id", "value"))
    return (
        before(decided, keys, ["version", "seq"], {"_prev": ("max", mark)}, block_rows)
        .withColumns({"previous_id": F.col("_prev.id"), "previous_value": F.col("_prev.value")})
        .drop("_prev")
    )


def current_state(decided: DataFrame, keys: Sequence[str] = FIELD_KEY, at_version: int | None = None) -> DataFrame:
    """Latest applied row per key, optionally as of an entity version.

    ``max_by`` pre-aggregates on the map side, so a hot key costs one row per
    map task in the shuffle.
    """
    rows = decided.filter(F.col("applied"))
    if at_version is not None:
        rows = rows.filter(F.col("version") <= at_version)
    rest = [c for c in decided.columns if c not in (*keys, "applied", "pending_reason")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("version", "seq")).alias("_row"))
    return latest.select(*keys, "_row.*")


def item_version_as_of(obs: DataFrame, at_version: int) -> DataFrame:
    """How many operations touched each item up to an entity version."""
    return (
        obs.filter(F.col("version") <= at_version)
        .groupBy("owner", "item")
        .agg(F.countDistinct("version").alias("item_version"), F.max("version").alias("last_version"))
    )


def number_versions(operations: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Entity version per operation: dense arrival rank inside an owner."""
    return with_ordinal(operations, arrival, keys=["owner"], name="version")


def number_items(versioned: DataFrame) -> DataFrame:
    """Item version: rank of the operation among those that touched the item."""
    touched = versioned.select("owner", "item", "version").distinct()
    ranks = with_ordinal(touched, ["version"], keys=["owner", "item"], name="item_version")
    return versioned.join(ranks, ["owner", "item", "version"])


def version_gaps(versions: DataFrame) -> DataFrame:
    """Operations whose predecessor version is absent."""
    have = versions.select("owner", "version").distinct()
    follows = have.select("owner", (F.col("version") + 1).alias("version"))
    return have.filter(F.col("version") > 1).join(follows, ["owner", "version"], "left_anti")


def flag_applicability(flag_state: DataFrame, value_state: DataFrame, binding_of: Column) -> DataFrame:
    """A stored flag speaks only for the value it was given for."""
    keys = ["owner", "item", "path"]
    now = value_state.select(*keys, binding_of.alias("_now"))
    return (
        flag_state.join(now, keys, "left")
        .withColumn("applicable", F.coalesce(F.col("binding") == F.col("_now"), F.lit(False)))
        .drop("_now")
    )


def flag_details(applicability: DataFrame, at: Column) -> DataFrame:
    """Effective flag value, last result, evidence and staleness at a given instant.

    ``method, reference, checked_at`` of the evidence are kept where the rows
    have them; a flag without a time of its check was checked when it was observed.
    """
    evidence = {name: F.lit(None).cast("string") for name in ("method", "reference") if name not in applicability.columns}
    checked = F.coalesce("checked_at", "effective") if "checked_at" in applicability.columns else F.col("effective")
    return applicability.withColumns(
        {
            **evidence,
            "checked_at": checked,
            "last_result": F.col("flag"),
            "flag_value": F.when(F.col("applicable"), F.col("flag")),
            "stale": F.coalesce(F.col("expires") <= at, F.lit(False)),
        }
    )


def nested_records(
    state: DataFrame, owner: str = "owner", fields_per_part: int = 9000
) -> DataFrame:
    """One nested document per owner, in parts of bounded size.

    ``state`` has ``owner, item, path, dimension, value``. Owners are split into
    as many parts as their field count needs, so no owner becomes one row of
    unbounded size and none is cut short.
    """
    sizes = state.groupBy(owner).agg(F.ceil(F.count(F.lit(1)) / fields_per_part).cast("long").alias("parts"))
    placed = state.join(sizes, owner).withColumn("part", F.pmod(F.xxhash64("item", "path", "dimension"), F.col("parts")))
    items = placed.groupBy(owner, "parts", "part", "item").agg(
        F.array_sort(
            F.collect_list(F.struct("dimension", "path", F.col("value").cast("string").alias("value")))
        ).alias("fields")
    )
    return items.groupBy(owner, "parts", "part").agg(
        F.array_sort(F.collect_list(F.struct("item", "fields"))).alias("items")
    )
