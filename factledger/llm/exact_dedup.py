"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is aggregated by
digest, a sort-merge anti-join against the index finds the digests that are
new, and these are appended. Adding a batch again changes nothing, so a job
that died after the append is simply repeated. DataFrame functions only.

Texts are equal when identical without the characters of
``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal texts in a batch the row
with the most code points in the original text stays, then the smallest
``doc_id``; rows without an id come last (their ``keep_id`` is null if no
other row is equal). A text that an earlier batch has put into the index stays
there: the later rows name it in ``keep_id``. Rows that repeat an id and a text
are one document: each says ``kept``, ``unique_rows`` leaves one of them. An
empty batch gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm.common import new_path, pin, prepare, text_or_empty

#: Buckets of the index: choose it so that a bucket's digests fit into a task.
BUCKETS = 64


def digest(text: str = "text") -> Column:
    """SHA-256 of the text without white space, as lowercase hex."""
    return F.sha2(F.translate(text_or_empty(text), " \t\n\x0b\x0c\r", ""), 256)


class DigestIndex:
    """Digests that are known, with the document that stays for each."""

    SCHEMA = "digest STRING, keep_id BIGINT"

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int = BUCKETS):
        """Open ``table``, made at ``path`` in the shared folder if it isn't there yet."""
        self.spark, self.table = prepare(spark), table
        if not spark.catalog.tableExists(table):
            path = path or new_path(spark, "digest-index")
            spark.sql(
                f"CREATE TABLE {table} ({self.SCHEMA}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
            )
        self.buckets = int(buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Decide every row of ``docs`` and append the digests that are new.

        Returns ``(doc_id, digest, n_chars, keep_id, group_size, kept)``.
        ``group_size`` counts the equal rows of the batch, and the indexed one
        where it is not among them.
        """
        batch = pin(
            docs.select(
                F.col("doc_id").cast("long"),
                digest().alias("digest"),
                F.length(text_or_empty()).cast("long").alias("n_chars"),
            ),
            "exact-batch",
        )
        # ~id turns the order of ids round and can't overflow
        best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("flipped")))
        groups = pin(
            batch.groupBy("digest")
            .agg(best.alias("best"), F.count("*").alias("group_size"))
            .select("digest", "group_size", F.bitwise_not(F.col("best.flipped")).alias("keep_id")),
            "exact-groups",
        )
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        self.append(fresh.select("digest", "keep_id"))
        known = self.rows().withColumnRenamed("keep_id", "known_id").hint("merge")
        settled = (
            groups.join(known, "digest")
            .withColumn("seen", ~F.col("keep_id").eqNullSafe(F.col("known_id")))
            .select("digest", F.col("known_id").alias("keep_id"), (F.col("group_size") + F.col("seen").cast("long")).alias("group_size"))
        )
        return batch.join(settled, "digest").select(
            "doc_id",
            "digest",
            "n_chars",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        )

    def append(self, fresh: DataFrame) -> None:
        """One sorted file for each bucket."""
        (
            fresh.repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.table)
        )


def fresh_index(spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
    """An empty index in the shared folder under a name of its own."""
    path = new_path(spark, "digest-index")
    return DigestIndex(spark, "digests_" + path.rsplit("-", 1)[-1], path, buckets)


def unique_rows(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, whole, one for each class of equal texts."""
    index = index or fresh_index(docs.sparkSession)
    stay = index.add(docs).filter("kept").select(F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest")).distinct()
    # the row travels whole in one column, so its own columns may have any names
    marked = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", digest().alias("digest"))
    same = (F.col("digest") == F.col("stay_digest")) & F.col("doc_id").eqNullSafe(F.col("stay_id"))
    return marked.join(stay, same, "left_semi").dropDuplicates(["digest"]).select("row.*")
