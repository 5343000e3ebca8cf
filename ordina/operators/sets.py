"""Dedup, keyed tables, multiset comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def largest_wins(pairs: DataFrame) -> DataFrame:
    """(key, second): one row per key, the larger second."""
    return pairs.groupBy("key").agg(F.max("second").alias("second"))


def upserted(items: DataFrame, priority: str) -> DataFrame:
    """(key, value ...): per key the row of the highest priority."""
    others = [c for c in items.columns if c != "key"]
    return items.groupBy("key").agg(F.max_by(F.struct(*others), priority).alias("_r")).select("key", "_r.*")


def looked_up(keys: DataFrame, held: DataFrame) -> DataFrame:
    """Each key with its value, null where there is none."""
    return keys.join(held, "key", "left")


def deleted(held: DataFrame, keys: DataFrame) -> DataFrame:
    return held.join(keys, "key", "left_anti")


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do both hold the same rows, as often? One shuffle: counts of a minus counts of b."""
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    differ = both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return differ.agg((F.count(F.lit(1)) == 0).alias("same"))
