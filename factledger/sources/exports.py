"""Sinks: history buckets, export volumes, per-kind tables, verification."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType

from factledger.operators.ordered import with_ordinal
from factledger.operators.reconcile import digest_columns
from factledger.workspace import pin

BUCKETS = 64
VOLUME_ROWS = 50_000
COLUMN_LIMIT = 16_384
#: Facts of one part of the cells; parts are sorted in memory.
PART_FACTS = 500_000


def owner_bucket(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


def append_history(observations: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Append observations below one of 64 bucket folders, sorted for skipping.

    Bucket sizes (64 rows) are counted first; a bucket gets one writer per
    ``rows_per_file`` rows, so an owner with a third of all rows is spread.
    """
    placed = observations.withColumn("bucket", owner_bucket(F.col("owner")))
    sizes = placed.groupBy("bucket").count().collect()
    if not sizes:
        return
    writers = F.create_map(*[F.lit(x) for r in sizes for x in (r["bucket"], -(-r["count"] // rows_per_file))])
    (
        placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.element_at(writers, F.col("bucket"))))
        .sortWithinPartitions("bucket", "owner", "version", "seq")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_history(spark: SparkSession, path: str, schema, owner=None) -> DataFrame:
    """The history, pruned to one bucket folder when an owner is given."""
    rows = spark.read.schema(schema).parquet(path)
    if owner is not None:
        rows = rows.filter((F.col("bucket") == owner_bucket(F.lit(owner).cast(schema["owner"].dataType))) & (F.col("owner") == owner))
    return rows


def with_volume(rows: DataFrame, order: Sequence[Column], size: int = VOLUME_ROWS) -> DataFrame:
    """Global ordinal and the numbered volume it falls into."""
    placed = with_ordinal(rows, order, name="ordinal")
    return placed.withColumn("volume", F.floor((F.col("ordinal") - 1) / size) + 1)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path there."""
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _exists(path: str) -> bool:
    store, root = _store(path)
    return store.get_file_info(root).type != fs.FileType.NotFound


def write_volumes(rows: DataFrame, path: str) -> None:
    """One folder per volume with one Parquet file, rows in ordinal order.

    A task writes the files of its volumes through Arrow's file systems. A file's
    name and content depend on its volume alone and it takes its name when it is
    whole, so a task that runs again writes the same files.
    """
    dealt = rows.repartition("volume").sortWithinPartitions("volume", "ordinal")
    place = dealt.columns.index("volume")
    kept = [k for k in range(len(dealt.columns)) if k != place]
    if _exists(path):
        raise FileExistsError(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)

        def finish(volume: int, parts: list[pa.RecordBatch]) -> None:
            folder = f"{root}/volume={volume}"
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/_{uuid.uuid4().hex}"  # names Spark does not read
            pq.write_table(pa.Table.from_batches(parts).select(kept), draft, filesystem=store, compression="snappy")
            store.move(draft, f"{folder}/part-0.parquet")

        volume, parts, written = None, [], 0
        for batch in batches:
            volumes = batch.column(place).to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(volumes)) + 1).tolist(), len(volumes)]
            for start, end in zip(borders, borders[1:]):
                if start == end:
                    continue
                if parts and volumes[start] != volume:
                    finish(volume, parts)
                    parts, written = [], written + 1
                volume = int(volumes[start])
                parts.append(batch.slice(start, end - start))
        if parts:
            finish(volume, parts)
            written += 1
        yield pa.RecordBatch.from_pydict({"written": pa.array([written], pa.int64())})

    written = dealt.mapInArrow(write, "written long").agg(F.sum("written")).first()[0]
    if not written:  # a table without a row is there all the same
        rows.limit(0).write.partitionBy("volume").parquet(path)


def verify_volumes(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and content digest per volume, before writing and read back."""
    wrote = before.groupBy("volume").agg(*digest_columns(columns))
    wrote = wrote.select(F.col("volume").cast("long").alias("volume"), F.struct("rows", "xor_hash", "sum_hash").alias("b"))
    found = after.groupBy("volume").agg(*digest_columns(columns))
    found = found.select(F.col("volume").cast("long").alias("volume"), F.struct("rows", "xor_hash", "sum_hash").alias("a"))
    joined = wrote.join(found, "volume", "full_outer")
    return joined.select(
        "volume",
        F.col("b.rows").alias("rows"),
        F.col("b.rows").eqNullSafe(F.col("a.rows")).alias("rows_match"),
        F.col("b").eqNullSafe(F.col("a")).alias("content_match"),
    )


def kind_tables(facts: DataFrame, kind: str, item: Sequence[str], width: int = COLUMN_LIMIT) -> list[DataFrame]:
    """Wide tables of one item kind over the columns found for it.

    More columns than ``width`` continue in further tables with the same item
    key. Column names are schema, so the driver holds them as it holds any
    schema; rows stay distributed.
    """
    rows = facts.filter(F.col("target_kind") == kind)
    names = sorted(r.key for r in rows.select("key").distinct().collect())
    parts = [names[n : n + width] for n in range(0, len(names), width)]
    return [rows.groupBy(*item).pivot("key", part).agg(F.max("value")) for part in parts]


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """Write each table and return the row counts read back."""
    counts = None
    for name, table in tables.items():
        table.write.format(fmt).save(f"{path}/{name}")
        again = table.sparkSession.read.schema(table.schema).format(fmt).load(f"{path}/{name}")
        one = again.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts


def kind_cells(facts: DataFrame, item: Sequence[str], width: int = COLUMN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The sheets of all kinds as cells, and the table that names their columns.

    Columns ``(kind, key, sheet, place)`` are numbered per kind, a further sheet
    of the same items begins after ``width`` of them; cells are ``(*item, kind,
    sheet, place, value)``. Both stay distributed, however many keys there are.
    Facts are read, not kept: they are dealt out once, by item and with a number for
    their column, so that the rows of an item lie together and take little room.
    """
    facts = facts.select(*item, F.col("target_kind").alias("kind"), "key", "value")
    keys = pin(facts.select("kind", "key").distinct(), "keys")
    numbered = with_ordinal(keys, [F.col("key")], keys=["kind"], name="number")
    columns = numbered.select(
        "kind", "key", F.expr(f"(number - 1) div {width} + 1").alias("sheet"), F.expr(f"(number - 1) % {width} + 1").alias("place")
    )
    columns = pin(columns.withColumn("_column", F.monotonically_increasing_id()), "columns")
    parts = max(facts.sparkSession.sparkContext.defaultParallelism, 1 + facts.count() // PART_FACTS)
    placed = facts.join(columns.select("kind", "key", "_column"), ["kind", "key"]).select(*item, "_column", "value")
    cells = placed.repartition(parts, *item).groupBy(*item, "_column").agg(F.max("value").alias("value"))
    cells = cells.join(columns.drop("key"), "_column").select(*item, "kind", "sheet", "place", "value")
    return cells, columns.drop("_column")


# ---- exports of several tables with a manifest ------------------------------------

MANIFEST = "level string, table string, volume long, rows long, ids long, sum string, mix long"


def _evidence(columns: Sequence[str]) -> list[Column]:
    """Order-free evidence of rows: their number, and the sum and mix of 60 bits of each row's digest."""
    texts = [F.col(c).cast("string") for c in columns]
    # every text after its length, nothing for null: no value can pass for another
    spelled = F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])
    mark = F.conv(F.substring(F.sha2(spelled, 256), 1, 15), 16, 10).cast("long")
    return [F.count(F.lit(1)).alias("rows"), F.sum(mark.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(mark).alias("mix")]


def volume_evidence(rows: DataFrame, table: str, ident: str, columns: Sequence[str]) -> DataFrame:
    """The manifest rows of one table's volumes."""
    found = rows.groupBy(F.col("volume").cast("long").alias("volume")).agg(*_evidence(columns), F.countDistinct(ident).alias("ids"))
    return found.select(F.lit("volume").alias("level"), F.lit(table).alias("table"), "volume", "rows", "ids", "sum", "mix")


def _above(volumes: DataFrame) -> DataFrame:
    """Tables over their volumes and the export over its tables, by the same evidence."""
    columns = ["level", "table", "volume", "rows", "ids", "sum", "mix"]

    def fold(rows: DataFrame, level: str, keys: list[str]) -> DataFrame:
        evidence = [c for c in _evidence(["table", "volume", "rows", "ids", "sum", "mix"])[1:]]
        found = rows.groupBy(*keys).agg(F.sum("rows").alias("n"), F.sum("ids").alias("ids"), *evidence)
        named = found if keys else found.withColumn("table", F.lit(""))
        return named.select(F.lit(level).alias("level"), "table", F.lit(None).cast("long").alias("volume"), F.col("n").alias("rows"), "ids", "sum", "mix")

    tables = fold(volumes, "table", ["table"])
    return volumes.select(columns).unionByName(tables).unionByName(fold(tables, "export", []))


def write_export(tables: dict[str, tuple[DataFrame, str, Sequence[Column]]], path: str, volume_rows: int = VOLUME_ROWS) -> DataFrame:
    """Write tables ``name: (rows, id column, order)`` in volumes and, last, the manifest.

    ``order`` makes rows distinct. The manifest is a tree of digests: of rows in
    a volume, of volumes in a table, of tables in the export. An export without
    one was not finished.
    """
    volumes = None
    for name, (rows, ident, order) in tables.items():
        placed = pin(with_volume(rows, order, volume_rows), f"export-{name}")
        write_volumes(placed, f"{path}/{name}")
        one = volume_evidence(placed, name, ident, rows.columns)
        volumes = one if volumes is None else volumes.unionByName(one)
    assert volumes is not None, "an export has a table"
    manifest = pin(_above(volumes), "manifest")
    manifest.write.parquet(f"{path}/_manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def read_volumes(table: DataFrame, path: str, name: str, volume: int | None = None) -> DataFrame:
    """Rows of a written table with the columns of ``table``, of one volume or all."""
    schema = StructType([*table.schema.fields, StructField("ordinal", LongType()), StructField("volume", LongType())])
    reader, folder = table.sparkSession.read.schema(schema), f"{path}/{name}"
    if volume is None:
        return reader.parquet(folder)
    one = f"{folder}/volume={volume}"  # the folders of the others are not even listed
    if not _exists(one):
        return table.sparkSession.createDataFrame([], schema)
    return reader.option("basePath", folder).parquet(one)


def check_export(tables: dict[str, tuple[DataFrame, str]], path: str, volume: int | None = None) -> DataFrame:
    """The manifest beside what is there now: ``(level, table, volume, rows, ids, matches)``.

    ``tables`` names the tables to check, ``name: (any frame of its columns, id
    column)``. With a ``volume`` only that volume of them is read.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    manifest = read_manifest(spark, path)
    found = None
    for name, (table, ident) in tables.items():
        one = volume_evidence(read_volumes(table, path, name, volume), name, ident, table.columns)
        found = one if found is None else found.unionByName(one)
    if volume is None:
        wanted = manifest.filter(F.col("table").isin(*tables) | (F.col("level") == "export"))
        now = _above(found)
    else:
        wanted = manifest.filter((F.col("level") == "volume") & (F.col("volume") == volume) & F.col("table").isin(*tables))
        now = found
    key = ["level", "table", "volume"]
    evidence = F.struct("rows", "ids", "sum", "mix")
    left = wanted.select(*key, "rows", "ids", evidence.alias("was"))
    right = now.select(*[F.col(c).alias(f"_{c}") for c in key], evidence.alias("now"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = left.join(right, same, "full_outer")
    matches = F.col("was").eqNullSafe(F.col("now"))
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) for c in key], "rows", "ids", matches.alias("matches"))


# ---- pins of source files -----------------------------------------------------------

CHUNK_BYTES = 64 * 1024 * 1024


def file_pins(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(file_name, bytes, digest)`` of every file below a folder, whatever its format.

    Files are listed by Spark and read in chunks by as many tasks as there are
    chunks; a file's digest is that of its chunks' digests in order, so a file
    of any size is pinned without one task reading it all. ``file_name`` is the
    path below the folder. Spark lists no file without a byte: such files have no
    pin. Chunks are read with Arrow's file systems.
    """
    root = path.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long"))
    chunks = listed.select("path", "length", F.posexplode(starts).alias("place", "start"))
    tasks = max(spark.sparkContext.defaultParallelism, chunks.count() // 16)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(uri)
                mark = hashlib.sha256()
                with store.open_input_file(name) as file:
                    file.seek(start)
                    left = chunk_bytes
                    while left and (part := file.read(min(left, 1 << 20))):
                        mark.update(part)
                        left -= len(part)
                found.append(mark.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], ["path", "length", "place", "mark"])

    marked = chunks.repartition(tasks).mapInArrow(digests, "path string, length long, place int, mark string")
    tree = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "mark"))), lambda c: c["mark"]), "")
    pins = marked.groupBy("path", "length").agg(F.sha2(tree, 256).alias("digest"))
    # the path as Spark writes it: after the folder's own name
    below = F.regexp_replace("path", rf"\A.*?{re.escape(root.split('://')[-1].lstrip('/'))}/", "")
    return pins.select(below.alias("file_name"), F.col("length").alias("bytes"), "digest")


def check_pins(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``unchanged``, ``changed``, ``missing`` or ``new`` per file."""
    evidence = F.struct("bytes", "digest")
    left = recorded.select("file_name", evidence.alias("was"))
    right = found.select("file_name", evidence.alias("now"))
    verdict = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("was").isNull(), "new")
        .when(F.col("was") == F.col("now"), "unchanged")
        .otherwise("changed")
    )
    joined = left.join(right, "file_name", "full_outer")
    return joined.select("file_name", F.col("now.bytes").alias("bytes"), verdict.alias("status"))


def schema_digest(table: DataFrame) -> str:
    """One digest for equal schemas: names, types and nesting, members of a structure in any order."""

    def plain(kind):
        if isinstance(kind, StructType):
            return {"struct": {f.name: plain(f.dataType) for f in kind.fields}}
        if isinstance(kind, ArrayType):
            return {"array": plain(kind.elementType)}
        if isinstance(kind, MapType):
            return {"map": [plain(kind.keyType), plain(kind.valueType)]}
        return kind.simpleString()

    return hashlib.sha256(json.dumps(plain(table.schema), sort_keys=True).encode()).hexdigest()
