"""Streams over files derived from the tables, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.plans import sqltext as q
from factledger.plans.registry import query
from factledger.plans.state_queries import OBS_COLUMNS
from factledger.plans.tables import Tables
from factledger.streaming import batches, field_state, publish
from factledger.workspace import new_path


BATCHES = 4


def add_files(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def as_stream(df: DataFrame, name: str, slice_of: Column) -> tuple[str, int]:
    """Write ``df`` in four appends; the files make about four micro-batches."""
    path = new_path(df.sparkSession, name)
    sliced = df.withColumn("_slice", F.pmod(slice_of, F.lit(BATCHES)))
    for number in range(BATCHES):
        add_files(sliced.filter(F.col("_slice") == number).drop("_slice"), path)
    files = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    return path, max(1, files // BATCHES)


@query("stream_ingest_replay", "SELECT event_id, event_type, value, CAST(1 AS BIGINT) AS copies, TRUE AS second_run_replayed FROM events")
def stream_ingest_replay(t: Tables):
    rows = t.events.select("event_id", "event_type", "value")
    path, files = as_stream(rows, "incoming", F.col("event_id"))
    target, receipts = new_path(t.spark, "ingested"), new_path(t.spark, "receipts")
    run = lambda: batches.ingest(
        batches.file_stream(t.spark, path, rows.schema, files), target, receipts, new_path(t.spark, "cp")
    )
    first, again = run(), run()
    replayed = again == {"written": 0, "replayed": first["written"]}
    stored = batches.read_parts(t.spark, target, rows.schema)
    return (
        stored.groupBy("event_id", "event_type", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("second_run_replayed", F.lit(replayed))
    )


@query("stream_dedup", "SELECT event_id, event_type, CAST(1 AS BIGINT) AS copies FROM events")
def stream_dedup(t: Tables):
    rows = t.events.select("event_id", "event_type")
    doubled = rows.withColumn("_at", F.col("event_id") % 3).unionByName(
        rows.filter(F.col("event_id") % 2 == 0).withColumn("_at", (F.col("event_id") + 1) % 3)
    ).unionByName(rows.filter(F.col("event_id") % 5 == 0).withColumn("_at", F.col("event_id") % 3))
    path, files = as_stream(doubled, "repeated", F.col("_at"))
    target = new_path(t.spark, "once")
    stream = batches.file_stream(t.spark, path, doubled.schema, files).drop("_at")
    batches.append_once(stream, "event_id", target, new_path(t.spark, "cp"))
    stored = batches.read_parts(t.spark, target, rows.schema)
    return stored.groupBy("event_id", "event_type").agg(F.count(F.lit(1)).alias("copies"))


@query("stream_field_state", q.with_(q.CURRENT, f"SELECT {OBS_COLUMNS} FROM value_state"))
def stream_field_state(t: Tables):
    """Observations arrive in version order: one append, one run of the stream."""
    most = t.obs.agg(F.max("version")).first()[0]
    path, schema = new_path(t.spark, "observed"), t.obs.schema
    history, winners, checkpoint = (new_path(t.spark, name) for name in ("history", "winners", "cp"))
    for number in range(BATCHES):
        low, high = most * number // BATCHES, most * (number + 1) // BATCHES
        add_files(t.obs.filter((F.col("version") > low) & (F.col("version") <= high)), path)
        stream = batches.file_stream(t.spark, path, schema, files_per_batch=None)
        field_state.maintain(stream, history, winners, checkpoint, every=3)
    return field_state.winners_before(t.spark, winners, schema, BATCHES, every=3).select(*schema.names)


@query(
    "stream_publish",
    q.with_(q.CURRENT, "SELECT owner || '/' || item AS entity, version, CAST(id AS VARCHAR) AS content FROM value_state"),
)
def stream_publish(t: Tables):
    entity = F.concat_ws("/", F.col("owner").cast("string"), "item")
    changes = t.decided.filter(F.col("applied")).select(entity.alias("entity"), "version", F.col("id").cast("string").alias("content"))
    schema = changes.schema
    path, files = as_stream(changes, "changes", F.xxhash64("content"))
    target = new_path(t.spark, "published")
    stream = batches.file_stream(t.spark, path, schema, files)
    publish.publish(stream, target, new_path(t.spark, "decisions"), new_path(t.spark, "cp"), compact_every=3)
    return publish.published(t.spark, target, schema)
