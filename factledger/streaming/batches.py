"""Micro-batch building blocks: numbered parts, receipts, exactly-once appends.

Every micro-batch writes into its own ``batch=<id>`` folder, so running a batch
again after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from factledger.operators.reconcile import digest
from factledger.streaming.idstore import IdStore


class ReplayConflict(RuntimeError):
    """A committed batch came back with different content."""


def file_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = 1, fmt: str = "parquet"
) -> DataFrame:
    """Files of a folder as a stream, oldest first; ``None`` takes all new files at once."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches, then stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def nothing_there(error: AnalysisException) -> bool:
    """Is a folder not written yet? Any other error is one."""
    return error.getCondition() == "PATH_NOT_FOUND"


def part(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def batch_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch", LongType())])


def read_parts(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of the committed batches, optionally only those before one batch."""
    try:
        rows = spark.read.schema(batch_schema(schema)).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return spark.createDataFrame([], batch_schema(schema))
    return rows if before is None else rows.filter(F.col("batch") < before)


RECEIPT = "rows long, xor_hash long, sum_hash string, batch long"


def receipts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RECEIPT).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return spark.createDataFrame([], RECEIPT)


def ingest(stream: DataFrame, target: str, receipt_path: str, checkpoint: str) -> dict[str, int]:
    """Append batches with a receipt each; replays are no-ops, changes conflict.

    Data is written before its receipt: a batch without receipt is written
    again, a batch with an equal receipt is skipped.
    """
    counts = {"written": 0, "replayed": 0}

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, xor_hash, sum_hash = digest(batch, batch.columns)
        found = receipts(spark, receipt_path).filter(F.col("batch") == number).first()
        if found is not None:
            if (found.rows, found.xor_hash, found.sum_hash) != (rows, xor_hash, str(sum_hash)):
                raise ReplayConflict(f"batch {number} was committed with other content")
            counts["replayed"] += 1
            return
        batch.write.mode("overwrite").parquet(part(target, number))
        evidence = spark.createDataFrame([(rows, xor_hash, str(sum_hash))], "rows long, xor_hash long, sum_hash string")
        evidence.coalesce(1).write.mode("overwrite").parquet(part(receipt_path, number))
        counts["written"] += 1

    run_available(stream, each, checkpoint)
    return counts


def append_once(stream: DataFrame, operation: str, target: str, checkpoint: str, ids: str | None = None) -> None:
    """Exactly-once by operation id, without streaming state.

    Copies inside a batch collapse by a partial aggregation and known
    operations drop out by an anti-join against the ids kept below ``ids``
    (beside the target if not given), of which only folders that may hold one of
    the batch are read. A batch that runs again sees earlier batches only and
    replaces its own rows and ids.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = IdStore(spark, ids or f"{target}-ids", batch.schema[operation].dataType)
        rest = [c for c in batch.columns if c != operation]
        once = batch.groupBy(operation).agg(F.min(F.struct(*rest)).alias("_row")).select(operation, "_row.*")
        known = store.known(batch, operation, before=number)
        fresh = once if known is None else once.join(known.select(F.col("id").alias(operation)), operation, "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(part(target, number))
        store.add(spark.read.schema(batch.schema).parquet(part(target, number)), operation, number)

    run_available(stream, each, checkpoint)
