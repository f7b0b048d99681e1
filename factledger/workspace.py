"""Where intermediate tables live.

Iterations and layouts are pinned by writing them to the shared folder the
cluster names in ``spark.checkpoint.dir``, so a lost executor only costs a
re-read. A private folder is made only in local mode, where nothing is shared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The configured shared folder, or a private one in local mode."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="factledger-")
        context.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/factledger/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, keeps columns prunable."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
