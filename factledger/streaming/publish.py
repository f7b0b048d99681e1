"""Publishing changes with a monotone version per entity.

What is published lies in buckets by entity: a compacted base and the changes of
the batches since. A batch reads the buckets of its own entities only. From time
to time the base is written anew below a new generation, and a pointer to it
last; until then everybody reads the old one, so a compaction that is ended
midway changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from factledger.operators.reconcile import publish_decisions
from factledger.streaming.batches import nothing_there, part, run_available

BUCKETS = 64
COMPACT_EVERY = 16
_POINTER = "generation long, upto long"


def entity_bucket(entity: Column) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, root: str, folder: str, schema: StructType, *places: StructField) -> DataFrame | None:
    """Rows below a folder with the columns its path has; none if it is not written yet."""
    try:
        return spark.read.schema(StructType([*schema.fields, *places])).option("basePath", root).parquet(folder)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return None


def pointer(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, int] | None:
    """The newest ``(generation, batch it reaches to)``, or the newest before a batch."""
    pointers = _read(spark, f"{path}/pointer", f"{path}/pointer", StructType([StructField("generation", LongType()), StructField("upto", LongType())]))
    if pointers is None:
        return None
    if before is not None:
        pointers = pointers.filter(F.col("upto") < before)
    found = pointers.agg(F.max(F.struct("generation", "upto")).alias("p")).first()["p"]
    return tuple(found) if found else None


def stored(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """All rows that decide what is published: the base and the changes since, with their bucket."""
    bucket, batch = StructField("bucket", IntegerType()), StructField("batch", LongType())
    at = pointer(spark, path, before)
    changes = _read(spark, f"{path}/changes", f"{path}/changes", schema, batch, bucket)
    rows = spark.createDataFrame([], StructType([*schema.fields, batch, bucket]))
    if changes is not None:
        late = F.lit(True) if at is None else F.col("batch") > at[1]
        rows = changes.filter(late if before is None else late & (F.col("batch") < before))
    if at is not None:
        base = f"{path}/base/generation={at[0]}"
        held = _read(spark, base, base, schema, bucket)
        if held is not None:
            rows = rows.unionByName(held.withColumn("batch", F.lit(-1).cast("long")))
    return rows


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("entity", "bucket").agg(F.max_by(F.struct("version", "content"), F.struct("version", "batch")).alias("n"))
    return newest.select("entity", "n.*", "bucket")


def published(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Newest published content per entity."""
    return _newest(stored(spark, path, schema)).drop("bucket")


def compact(spark: SparkSession, path: str, schema: StructType, upto: int) -> None:
    """Write a new base of everything up to a batch, then the pointer to it."""
    at = pointer(spark, path)
    generation = at[0] + 1 if at else 0
    state = _newest(stored(spark, path, schema, before=upto + 1))
    laid = state.repartitionByRange("bucket", "entity").sortWithinPartitions("bucket", "entity")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/generation={generation}")
    place = spark.createDataFrame([(generation, upto)], _POINTER).coalesce(1)
    place.write.mode("overwrite").parquet(f"{path}/pointer/to={generation}")


def publish(stream: DataFrame, target: str, decisions: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Append newer versions; keep every decision, conflicts included.

    A batch that runs again sees what was published before it, whatever has been
    compacted since, and replaces its own decisions and changes.
    """
    schema = StructType([f for f in stream.schema.fields if f.name in ("entity", "version", "content")])

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = [r["bucket"] for r in batch.select(entity_bucket(F.col("entity")).alias("bucket")).distinct().collect()]
        there = _newest(stored(spark, target, schema, before=number).filter(F.col("bucket").isin(touched)))
        decided = publish_decisions(batch, there.drop("bucket"), "entity")
        decided.write.mode("overwrite").parquet(part(decisions, number))
        again = spark.read.schema(decided.schema).parquet(part(decisions, number))
        fresh = again.filter(F.col("decision") == "indexed").select(*schema.names).withColumn("bucket", entity_bucket(F.col("entity")))
        laid = fresh.repartitionByRange("bucket", "entity").sortWithinPartitions("bucket", "entity")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(part(f"{target}/changes", number))
        if number % compact_every == compact_every - 1:
            compact(spark, target, schema, number)

    run_available(stream, each, checkpoint)
