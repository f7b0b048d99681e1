import random

from pyspark.sql import functions as F

from factledger.operators.ordered import before, beside, pin_layout, with_ordinal


def test_global_and_keyed_ordinals(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), v) for v in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    ordered = sorted(v for _, v in rows)
    got = {r.v: r.ordinal for r in with_ordinal(df, [F.col("v").asc()]).collect()}
    assert got == {v: i for i, v in enumerate(ordered, 1)}
    keyed = {(r.k, r.v): r.n for r in with_ordinal(df, ["v"], keys=["k"], name="n").collect()}
    for key in "ab":
        own = sorted(v for k, v in rows if k == key)
        assert [keyed[key, v] for v in own] == list(range(1, len(own) + 1))


def test_more_blocks_than_shuffle_partitions(spark):
    rows = [(n * 7 % 101,) for n in range(101)]
    df = spark.createDataFrame(rows, "v long").repartition(3)
    laid = pin_layout(df, ["v"], block_rows=4)
    assert laid.select("_block").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.v: r.ordinal for r in with_ordinal(df, ["v"], block_rows=4).collect()}
    assert got == {v: v + 1 for v in range(101)}


def test_missing_values_sort_last_in_both_directions(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id long, v long")
    down = with_ordinal(df, [F.col("v").desc_nulls_last(), F.col("id").asc()])
    up = with_ordinal(df, [F.col("v").asc_nulls_last(), F.col("id").asc()])
    assert [r.id for r in down.orderBy("ordinal").collect()] == [3, 2, 1]
    assert [r.id for r in up.orderBy("ordinal").collect()] == [2, 3, 1]


def test_before_carries_across_blocks(spark):
    rng = random.Random(8)
    rows = [(key, n, rng.randint(0, 50) if rng.random() < 0.8 else None) for key in (1, 2) for n in range(1, 41)]
    df = spark.createDataFrame(rows, "k long, n long, x long")
    got = before(df, ["k"], ["n"], {"top": ("max", F.col("x")), "total": ("sum", F.col("x")), "low": ("min", F.col("x"))}, block_rows=4)
    for r in got.collect():
        seen = [x for k, n, x in rows if k == r.k and n < r.n and x is not None]
        assert (r.top, r.low, r.total) == (max(seen, default=None), min(seen, default=None), sum(seen))


def test_beside_is_lag_and_lead(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, pos long, x string")
    back = {(r.k, r.pos): r.prev_x for r in beside(df, ["k"], "pos", ["x"]).collect()}
    ahead = {(r.k, r.pos): r.next_x for r in beside(df, ["k"], "pos", ["x"], step=1).collect()}
    assert back == {(1, 1): None, (1, 2): "a", (2, 1): None}
    assert ahead == {(1, 1): "b", (1, 2): None, (2, 1): None}
