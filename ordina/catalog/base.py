"""A registry of queries with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import restored, sized

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            restored(spark)
            return query(spark, sf_dir)

        self.queries[name] = run
        if sql:
            self.sql[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def events_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, v): whole numbers around zero, in order of events."""
    value = F.round(F.col("value") * 100).cast("long") - 5000
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), value.alias("v"))


def orders_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, v): customers of orders, small whole numbers with repeats."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"))


#: The same inputs for the SQL side.
EVENTS = "ev AS (SELECT event_id AS pos, round(value * 100)::BIGINT - 5000 AS v FROM events)"
ORDERS = "od AS (SELECT o_orderkey AS pos, o_custkey AS v FROM orders)"
