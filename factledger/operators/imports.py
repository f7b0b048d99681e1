"""Row-isolated imports: a bad row is recorded, the others are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judge_rows(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Status and first failing code per row; no row leaves the table."""
    code = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])
    judged = rows.withColumn("error_code", code)
    return judged.withColumn("status", F.when(F.col("error_code").isNull(), "succeeded").otherwise("failed"))


def applied(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("status") == "succeeded").drop("status", "error_code")
