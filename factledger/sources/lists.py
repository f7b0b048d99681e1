"""Pasted lists and source inventories."""

from __future__ import annotations

import csv
import io
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(ArrayType(StringType()))
def csv_cells(text: pd.Series) -> pd.Series:
    """Non-blank cells of a CSV text in reading order, trimmed."""

    csv.field_size_limit(sys.maxsize)  # a cell may be as long as the text

    def one(value: str) -> list[str]:
        cells = (cell.strip() for row in csv.reader(io.StringIO(value)) for cell in row)
        return [cell for cell in cells if cell]

    return text.map(one, na_action="ignore")


def list_entries(lists: DataFrame, ident: str, text: str) -> DataFrame:
    """One entry per non-blank cell, numbered from 1 inside each list."""
    cells = lists.select(ident, F.posexplode(csv_cells(text)).alias("pos", "value"))
    return cells.select(ident, (F.col("pos") + 1).cast("string").alias("input_id"), "value")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """Entries of uploaded CSV files, one list per file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return list_entries(files, "file", "value")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """CSV inventory ``source_id, field, type``."""
    return spark.read.csv(path, header=True, schema="source_id string, field string, type string")


def map_inventory(inventory: DataFrame, rules: DataFrame, fallback: Column, default: tuple[str, str]) -> DataFrame:
    """Target and status of every inventoried field: rule, pattern, default."""
    joined = inventory.join(rules, "field", "left")
    hit = F.col("target").isNotNull()
    return joined.withColumns(
        {
            "target": F.when(hit, F.col("target")).when(fallback, "custom.original_contact").otherwise(default[0]),
            "status": F.when(hit, F.col("status")).when(fallback, "pending_contact_parse").otherwise(default[1]),
        }
    )
