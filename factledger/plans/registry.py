"""Registration of queries: a Spark plan and, where SQL can say it, its twin."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from factledger.plans.tables import Tables
from factledger.session import tune

Plan = Callable[[Tables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register ``plan`` under ``name`` with its optional SQL twin."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return plan

    return register
