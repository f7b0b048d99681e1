"""Exactly-once appends and publication: what a batch reads, replays, ended compactions."""

import random

import pytest
from pyspark.sql import functions as F

from factledger.streaming import batches, idstore, publish
from factledger.streaming.idstore import IdStore
from factledger.workspace import new_path

IDS = "id string, n long"


def ids(spark, names):
    return spark.createDataFrame([(name, 1) for name in names], IDS)


def bucket_of(spark, names):
    rows = ids(spark, names).select("id", idstore.id_bucket(F.col("id")).alias("b")).collect()
    return {r["id"]: r["b"] for r in rows}


def test_store_reads_only_folders_that_may_hold_an_id(spark):
    store = IdStore(spark, new_path(spark, "ids"), ids(spark, ["x"]).schema["id"].dataType)
    assert store.folders(ids(spark, ["a"]), "id", before=5) == []
    early, late = [f"a{k}" for k in range(300)], [f"b{k}" for k in range(300)]
    store.add(ids(spark, [*early, None]), "id", 0)
    store.add(ids(spark, late), "id", 1)
    asked = ["a7", "b9", "a200"]
    place = bucket_of(spark, asked)
    assert store.folders(ids(spark, [*asked, None]), "id", before=2) == sorted({(0, place["a7"]), (0, place["a200"]), (1, place["b9"])})
    assert store.folders(ids(spark, asked), "id", before=1) == sorted({(0, place["a7"]), (0, place["a200"])})
    files = store.known(ids(spark, asked), "id", before=2).inputFiles()
    assert {f.split("/ids/batch=")[1].split("/part")[0] for f in files} == {
        f"0/bucket={place['a7']}", f"0/bucket={place['a200']}", f"1/bucket={place['b9']}"
    }
    fresh = [f"c{k}" for k in range(400)]
    opened = store.folders(ids(spark, fresh), "id", before=2)
    assert len(opened) < 12  # false positives only
    every = store.folders(ids(spark, early + late), "id", before=2)
    assert set(every) == {(0, b) for b in bucket_of(spark, early).values()} | {(1, b) for b in bucket_of(spark, late).values()}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_append_once_over_batches_and_replays(spark, kind):
    source, target, checkpoint = (new_path(spark, name) for name in ("source", "target", "cp"))
    rng = random.Random(3)
    schema = f"operation {kind}, value long"
    for _ in range(4):
        rows = [(k if kind == "long" else f"op-{k * 7919 % 1000}", rng.randrange(100)) for k in (rng.randrange(120) for _ in range(90))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    struct = spark.createDataFrame([], schema).schema
    run = lambda: batches.append_once(batches.file_stream(spark, source, struct), "operation", target, checkpoint)
    run()
    first = sorted(map(tuple, batches.read_parts(spark, target, struct).collect()))
    seen = {r["operation"] for r in spark.read.parquet(source).collect()}
    assert len(first) == len(seen) and {r[0] for r in first} == seen
    checkpoint = new_path(spark, "cp")  # all batches run again
    run()
    assert sorted(map(tuple, batches.read_parts(spark, target, struct).collect())) == first


CHANGES = "entity string, version long, content string"


@pytest.fixture
def changes(spark):
    source = new_path(spark, "changes")
    rng = random.Random(9)
    every = []
    for number in range(7):
        rows = [(f"e{rng.randrange(30)}", rng.randrange(number * 2 + 3), rng.choice("xy")) for _ in range(25)]
        every += rows
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
    return source, spark.createDataFrame([], CHANGES).schema


def test_publication_with_and_without_compaction_agree(spark, changes):
    source, schema = changes
    states = []
    for every in (100, 2, 1):
        target, decisions, checkpoint = (new_path(spark, name) for name in ("published", "decisions", "cp"))
        publish.publish(batches.file_stream(spark, source, schema), target, decisions, checkpoint, compact_every=every)
        first = sorted(map(tuple, publish.published(spark, target, schema).collect()))
        judged = sorted(map(str, spark.read.parquet(decisions).collect()))
        states.append((first, judged))
        # everything runs again: earlier batches are judged by what was there before them
        publish.publish(batches.file_stream(spark, source, schema), target, decisions, new_path(spark, "cp"), compact_every=every)
        assert sorted(map(str, spark.read.parquet(decisions).collect())) == judged
        assert sorted(map(tuple, publish.published(spark, target, schema).collect())) == first
        assert (publish.pointer(spark, target) is None) == (every == 100)
    assert states[0] == states[1] == states[2] and len(states[0][0]) > 20


def test_ended_compaction_changes_nothing(spark, changes, monkeypatch):
    source, schema = changes
    target, decisions = new_path(spark, "published"), new_path(spark, "decisions")
    publish.publish(batches.file_stream(spark, source, schema), target, decisions, new_path(spark, "cp"), compact_every=3)
    before, at = sorted(map(tuple, publish.published(spark, target, schema).collect())), publish.pointer(spark, target)

    class Ended(Exception):
        pass

    def no_pointer(*args, **kwargs):
        raise Ended

    monkeypatch.setattr(type(spark), "createDataFrame", no_pointer)
    rows = publish.stored
    monkeypatch.setattr(publish, "stored", lambda s, p, c, before=None: rows_without_frame(s, p, c))

    def rows_without_frame(s, path, fields):
        found = s.read.parquet(f"{path}/changes")
        return found.select("entity", "version", F.lit("broken").alias("content"), "batch", "bucket")

    with pytest.raises(Ended):  # the base is written, the pointer is not
        publish.compact(spark, target, schema, 6)
    monkeypatch.undo()
    assert rows is publish.stored and publish.pointer(spark, target) == at
    assert sorted(map(tuple, publish.published(spark, target, schema).collect())) == before
    publish.compact(spark, target, schema, 6)
    assert publish.pointer(spark, target) == (at[0] + 1, 6)
    assert sorted(map(tuple, publish.published(spark, target, schema).collect())) == before


def test_a_batch_reads_only_the_buckets_of_its_entities(spark, changes):
    source, schema = changes
    target = new_path(spark, "published")
    publish.publish(batches.file_stream(spark, source, schema), target, new_path(spark, "decisions"), new_path(spark, "cp"), compact_every=4)
    one = spark.createDataFrame([("e3", 1, "x")], CHANGES).select(publish.entity_bucket(F.col("entity")).alias("b")).first()["b"]
    rows = publish.stored(spark, target, schema).filter(F.col("bucket").isin([one]))
    files = {r["f"] for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all(f"bucket={one}/" in f for f in files)
    assert any("/base/" in f for f in files)
