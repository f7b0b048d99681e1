"""Current field state kept up to date from a stream of observations.

Late and future observations are decided and kept in the history like all
others, so there is no watermark. Between batches only the winner of each field
is carried: a winner put in front of the next rows of its field makes the batch
scan continue exactly where the stream stopped, and it stays balanced when one
field receives most of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factledger.operators import state
from factledger.streaming.batches import part, read_parts, run_available

KEY = list(state.FIELD_KEY)


# Every so many batches one folder repeats all winners, so that a reader never
# opens more than this many folders.
COMPACT_EVERY = 20


def winners(rows: DataFrame) -> DataFrame:
    """Latest winner per field out of the per-batch winners."""
    rest = [c for c in rows.columns if c not in KEY]
    latest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("_w"))
    return latest.select(*KEY, "_w.*")


def winners_before(spark: SparkSession, path: str, schema: StructType, batch: int, every: int = COMPACT_EVERY) -> DataFrame:
    """Winners after all batches before ``batch``; older folders are pruned."""
    complete = batch // every * every - 1
    return winners(read_parts(spark, path, schema, before=batch).filter(F.col("batch") >= complete)).drop("batch")


def decide_batch(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Decisions for a batch given the winners so far.

    Winners enter as version 0, before everything; a first eligible row always
    wins, so each comes out applied and is dropped again.
    """
    touched = current.join(batch.select(*KEY).distinct(), KEY, "left_semi").select(*batch.columns)
    carried = touched.withColumn("version", F.lit(0).cast("long"))
    return state.field_precedence(carried.unionByName(batch)).filter(F.col("version") > 0)


def maintain(stream: DataFrame, history: str, winner_path: str, checkpoint: str, every: int = COMPACT_EVERY) -> None:
    """Decide every micro-batch, append its history and its new winners."""
    schema = stream.schema

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = winners_before(spark, winner_path, schema, number, every)
        decided = decide_batch(batch.select(*schema.names), current)
        decided.write.mode("overwrite").parquet(part(history, number))
        again = spark.read.schema(decided.schema).parquet(part(history, number))
        fresh = state.current_state(again).select(*schema.names)
        if number % every == every - 1:
            untouched = current.join(fresh.select(*KEY), KEY, "left_anti").select(*schema.names)
            fresh = fresh.unionByName(untouched)
        fresh.write.mode("overwrite").parquet(part(winner_path, number))

    run_available(stream, each, checkpoint)
