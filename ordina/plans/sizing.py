"""How many partitions a shuffle starts from, by the size of the tables that a query reads.

A fixed number of partitions makes each of them grow with the input, and with it what a task sorts or hashes
in memory. Here a partition stands for a fixed share of the input instead; adaptive execution merges small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

#: Bytes of Parquet for each partition, and the most that adaptive execution merges: a million short rows or so.
SHARE, MOST = 4 << 20, 8 << 20

#: What the settings were before they were changed here, by application.
_before: dict[str, dict[str, str | None]] = {}


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(PARTS, None) or 0))


def restored(spark: SparkSession) -> None:
    """Undoes what ``sized`` has set, so that a small query after a large one is not cut as finely."""
    for key, value in _before.pop(spark.sparkContext.applicationId, {}).items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def sized(df: DataFrame) -> DataFrame:
    """df; from now on shuffles of its session start from a partition for each share of its size at least.

    Both settings are read when a plan runs, so that they stay until ``restored``.
    """
    spark = df.sparkSession
    wanted = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SHARE
    if wanted > partitions(spark):
        _before.setdefault(spark.sparkContext.applicationId, {key: spark.conf.get(key, None) for key in (PARTS, ADVISORY)})
        spark.conf.set(PARTS, wanted)
        held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ADVISORY))
        spark.conf.set(ADVISORY, min(held, MOST))
    return df
