"""Ids seen so far, kept so that a batch reads only what may hold one of its ids.

Every batch writes its ids below ``batch=<n>/bucket=<b>`` by hash, and for each
of these folders a Bloom filter: a table of 64-bit words ``(word, bits)``, sized
by the folder's own number of ids. A later batch first asks the filters of its
buckets, by equality joins, and then reads the folders that answered. An id that
is new opens a folder only by a false positive, about once in 500 ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType
from pyspark.sql.utils import AnalysisException

BUCKETS = 64
BITS_PER_ID = 16
PROBES = 4
_FILTER = StructType([StructField(c, LongType()) for c in ("size", "word", "bits")] + [StructField("batch", LongType()), StructField("bucket", IntegerType())])


def id_bucket(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(BUCKETS)).cast("int")


def _probes(ident: str) -> Column:
    """``(word, bit)`` of an id in a filter of ``size`` bits, a power of two."""
    low = F.lit((1 << 40) - 1)  # parts of 40 bits: sums stay within 64
    first, second = (F.xxhash64(F.lit(seed), F.col(ident)).bitwiseAND(low) for seed in (1, 2))
    second = second.bitwiseOR(F.lit(1))
    places = [(first + F.lit(k) * second).bitwiseAND(F.col("size") - 1) for k in range(PROBES)]
    return F.array(*[F.struct(F.shiftright(p, 6).alias("word"), (p % 64).cast("int").alias("bit")) for p in places])


class IdStore:
    """The store below one folder, for ids of one type."""

    def __init__(self, spark: SparkSession, path: str, id_type: DataType):
        self.spark, self.path, self.id_type = spark, path, id_type

    def add(self, ids: DataFrame, ident: str, batch: int) -> None:
        """Keep the ids of a batch; the same batch again replaces itself. Filters come last."""
        rows = ids.select(F.col(ident).alias("id")).filter("id IS NOT NULL").withColumn("bucket", id_bucket(F.col("id")))
        laid = rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/batch={batch}")
        kept = self._ids([f"{self.path}/ids/batch={batch}"])
        count = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        bits = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") * BITS_PER_ID, F.lit(64))))).cast("long")
        probes = kept.join(count.select("bucket", bits.alias("size")), "bucket").select("bucket", "size", F.inline(_probes("id")))
        words = probes.groupBy("bucket", "size", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        words = words.repartition("bucket").sortWithinPartitions("bucket", "word")
        words.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/batch={batch}")

    def _ids(self, folders: list[str]) -> DataFrame:
        schema = StructType([StructField("id", self.id_type), StructField("batch", LongType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/ids").parquet(*folders)

    def folders(self, ids: DataFrame, ident: str, before: int) -> list[tuple[int, int]]:
        """``(batch, bucket)`` of the folders of earlier batches that may hold one of the ids."""
        try:
            filters = self.spark.read.schema(_FILTER).option("basePath", f"{self.path}/filters").parquet(f"{self.path}/filters")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        asked = ids.select(F.col(ident).alias("id")).filter("id IS NOT NULL").distinct().withColumn("bucket", id_bucket(F.col("id")))
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        filters = filters.filter(F.col("bucket").isin(touched) & (F.col("batch") < before))
        sizes = filters.select("batch", "bucket", "size").distinct()
        probes = asked.join(sizes, "bucket").select("id", "batch", "bucket", F.explode(_probes("id")).alias("p"))
        probes = probes.select("id", "batch", "bucket", F.col("p.word").alias("word"), F.col("p.bit").alias("bit"))
        hit = probes.join(filters.drop("size"), ["batch", "bucket", "word"]).filter(F.expr("shiftright(bits, bit) & 1") == 1)
        held = hit.groupBy("batch", "bucket", "id").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") == PROBES)
        # one row for each folder, not for each id
        return sorted((r["batch"], r["bucket"]) for r in held.select("batch", "bucket").distinct().collect())

    def known(self, ids: DataFrame, ident: str, before: int) -> DataFrame | None:
        """``(id, batch, bucket)`` of the folders that may hold one of the ids; none if there is no such folder."""
        found = self.folders(ids, ident, before)
        return self._ids([f"{self.path}/ids/batch={batch}/bucket={bucket}" for batch, bucket in found]) if found else None
