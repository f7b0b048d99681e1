"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()

RUNTIME_SETTINGS = {
    # Instants are compared and printed in UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small partitions, split hot join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python helpers are unpickled by module name, so workers must be able to
    import them wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="factledger-ship-"), os.path.basename(package))
    spark.sparkContext.addPyFile(
        shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
    )
    _SHIPPED.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and ship the package the jobs depend on."""
    ship(spark)
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(name: str, cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
