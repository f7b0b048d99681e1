"""Input tables and the registry-shaped tables derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators import state, textindex
from factledger.workspace import new_path

# Append-only tables are written once per application and input folder, the way
# the registry keeps them, and read back by every query that needs them.
_STAGED: dict[tuple[str, str, str], tuple[str, object]] = {}

RECEIVED_FROM = "2024-01-10 00:00:00"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


class Tables:
    """One input folder; attributes are lazily planned DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for CPU-heavy row work: dealt out to at least as many tasks as there are cores.

        A table in few files is few tasks, however costly its rows are.
        """
        rows = self.read(name)
        return rows.repartition(max(self.spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))

    def staged(self, name: str, build, codec: str = "snappy") -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGED:
            df = build()
            path = new_path(self.spark, name)
            df.write.option("compression", codec).parquet(path)
            _STAGED[key] = (path, df.schema)
        path, schema = _STAGED[key]
        return self.spark.read.schema(schema).parquet(path)

    customer = cached_property(lambda self: self.read("customer"))
    supplier = cached_property(lambda self: self.read("supplier"))
    nation = cached_property(lambda self: self.read("nation"))
    region = cached_property(lambda self: self.read("region"))
    part = cached_property(lambda self: self.read("part"))
    orders = cached_property(lambda self: self.read("orders"))
    lineitem = cached_property(lambda self: self.read("lineitem"))
    events = cached_property(lambda self: self.read("events"))
    documents = cached_property(lambda self: self.read("documents"))
    pages = cached_property(lambda self: self.read("pages"))
    benchmark = cached_property(lambda self: self.read("benchmark"))
    labels = cached_property(lambda self: self.read("labels"))
    conversations = cached_property(lambda self: self.read("conversations"))
    embeddings = cached_property(lambda self: self.read("embeddings"))

    @cached_property
    def text_index(self) -> textindex.TextIndex:
        """The index of ``documents``, built once per application and input folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, "text_index")
        if key not in _STAGED:
            index = textindex.build(self.spread("documents"), "doc_id", "text")
            _STAGED[key] = (index.path, index.key_type)
        return textindex.TextIndex(self.spark, *_STAGED[key])

    # ---- observation log -------------------------------------------------

    @cached_property
    def arrivals(self) -> DataFrame:
        """``events`` as operations in a permuted arrival order."""
        perm = (F.col("event_id") * F.lit(1103515245) + 12345) % F.lit(2147483647)
        received = F.lit(RECEIVED_FROM).cast("timestamp") + F.make_dt_interval(
            secs=F.floor(F.col("perm") / 1000).cast("decimal(18,6)")
        )
        ident = F.col("event_id")
        return (
            self.events.withColumn("perm", perm)
            .withColumn("received", received)
            .select(
                F.col("user_id").alias("owner"),
                F.col("event_type").alias("item"),
                F.lit("value").alias("path"),
                F.lit("value").alias("dimension"),
                ident.alias("id"),
                "value",
                F.when(ident % 5 != 0, F.col("ts").cast("timestamp")).alias("effective"),
                "received",
                F.when(ident % 7 == 0, "pending").otherwise("mapped").alias("status"),
                (ident % 3).cast("int").alias("source"),
                "perm",
            )
        )

    @cached_property
    def obs(self) -> DataFrame:
        """The observation log with its stored entity versions."""

        def build() -> DataFrame:
            numbered = state.number_versions(self.arrivals, ["perm"])
            return numbered.withColumn("seq", F.lit(1).cast("long")).drop("perm")

        return self.staged("obs", build)

    @cached_property
    def decided(self) -> DataFrame:
        """The observation log with the outcome stored at write time."""
        return self.staged("decided", lambda: state.field_precedence(self.obs))

    @cached_property
    def flagobs(self) -> DataFrame:
        """``view`` observations read as flags on the ``purchase`` item."""
        ident = F.col("id")
        return self.obs.filter(F.col("item") == "view").select(
            "owner",
            F.lit("purchase").alias("item"),
            "path",
            F.lit("flag:valid").alias("dimension"),
            "id",
            F.when(ident % 3 == 0, True).when(ident % 3 == 1, False).alias("flag"),
            (ident % 4).cast("long").alias("binding"),
            "effective",
            "received",
            (F.col("received") + F.make_dt_interval(days=(ident % 20).cast("int"))).alias("expires"),
            "status",
            "source",
            "version",
            "seq",
        )

    value_binding = staticmethod(lambda: F.floor(F.col("value")).cast("long") % 4)

    @cached_property
    def decided_flags(self) -> DataFrame:
        def build() -> DataFrame:
            values = self.decided.filter(F.col("item") == "purchase")
            return state.flag_precedence(values, self.flagobs, self.value_binding())

        return self.staged("decided_flags", build)

    @cached_property
    def value_state(self) -> DataFrame:
        return state.current_state(self.decided)

    @cached_property
    def flag_state(self) -> DataFrame:
        rows = self.decided_flags.drop("current_binding", "binding_matches")
        return state.flag_applicability(
            state.current_state(rows), self.value_state.filter(F.col("item") == "purchase"), self.value_binding()
        )

    # ---- identity ----------------------------------------------------------

    @cached_property
    def idrec(self) -> DataFrame:
        """Every order as a source record with a source and a document key."""
        key = F.col("o_orderkey")
        doc = F.round(F.col("o_totalprice") * 100).cast("long") % 100003
        return self.orders.select(
            key.alias("record"),
            F.concat(F.lit("C"), F.col("o_custkey"), F.lit("."), key % 4).alias("source_key"),
            F.when(key % 3 != 0, F.concat(F.lit("D"), doc)).alias("doc_key"),
            key.alias("arrival"),
        )
