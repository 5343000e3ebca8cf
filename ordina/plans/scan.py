"""Ordered scans and dense positions without a window over all rows in one task.

Positions fall into blocks of ``block`` positions, each block is aggregated, the blocks themselves fall
into blocks of blocks, and a window inside of each starts from the prefix of the one that holds it. Only
the top level is scanned in one task: a row for ``block * block`` positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .sizing import partitions

BLOCK = 8192


@dataclass(frozen=True)
class Monoid:
    """An associative operation by Spark's own aggregates: name, identity, and how to combine two values."""

    name: str
    identity: object
    aggregate: callable
    combine: callable


SUM = Monoid("sum", 0, F.sum, lambda a, b: a + b)
MIN = Monoid("min", (1 << 63) - 1, F.min, F.least)
MAX = Monoid("max", -(1 << 63), F.max, F.greatest)
COUNT = Monoid("count", 0, F.count, lambda a, b: a + b)
AND = Monoid("and", True, F.bool_and, lambda a, b: a & b)
OR = Monoid("or", False, F.bool_or, lambda a, b: a | b)
#: The right operand unless it is null: takes the last value seen.
LAST = Monoid("last", None, lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("pos"))), lambda a, b: F.coalesce(b, a))


def scan(df: DataFrame, value: Column | str, monoid: Monoid = SUM, out: str = "s", *, inclusive: bool = True, back: bool = False, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """df with the scan of value in order of pos; ``back`` scans from the end."""
    value = F.col(value) if isinstance(value, str) else value
    lifted = df.withColumn("_v", value).withColumn("_blk", F.floor(F.col(pos) / block).cast("long"))
    identity = F.lit(monoid.identity)
    order = (lambda c: F.col(c).desc()) if back else (lambda c: F.col(c).asc())
    held = monoid.aggregate(F.col("_v"))
    if monoid.name == "last":
        held = F.max_by("_v", F.when(F.col("_v").isNotNull(), -F.col(pos) if back else F.col(pos)))
    blocks = lifted.groupBy("_blk").agg(held.alias("_b"))
    combined = F.sum if monoid.name == "count" else monoid.aggregate
    if monoid.name == "last":
        joined, folded = (lambda a, b: F.coalesce(b, a)), lambda c: F.last(c, ignorenulls=True)
        top = F.max_by("_b", F.when(F.col("_b").isNotNull(), -F.col("_blk") if back else F.col("_blk")))
    else:
        joined, folded, top = (lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(monoid.combine(a, b))), combined, combined(F.col("_b"))
    blocks = blocks.withColumn("_top", F.floor(F.col("_blk") / block).cast("long"))
    tops = blocks.groupBy("_top").agg(top.alias("_t"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(order(keys[-1])).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_top", folded(F.col("_t")).over(before("_top")).alias("_t"))
    blocks = blocks.withColumn("_b", folded(F.col("_b")).over(before("_top", "_blk"))).join(tops, "_top")
    blocks = blocks.select("_blk", joined(F.col("_t"), F.col("_b")).alias("_pre"))
    inside = Window.partitionBy("_blk").orderBy(order(pos)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = F.last("_v", ignorenulls=True).over(inside) if monoid.name == "last" else monoid.aggregate(F.col("_v")).over(inside)
    if monoid.name == "last":
        total = F.coalesce(F.col("_in"), F.col("_pre"))
    else:
        total = monoid.combine(F.coalesce(F.col("_pre"), identity), F.coalesce(F.col("_in"), identity))
    return lifted.withColumn("_in", within).join(blocks, "_blk").withColumn(out, total).drop("_v", "_in", "_blk", "_pre")


def reindexed(df: DataFrame, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """df with pos made dense, 0-based, in the same order: the rank is a count scan over blocks."""
    return scan(df, F.lit(1), COUNT, "_rank", inclusive=False, pos=pos, block=block).withColumn(pos, F.col("_rank")).drop("_rank")


def positioned(df: DataFrame, *keys: Column | str, pos: str = "pos") -> DataFrame:
    """df sorted by the keys, with dense positions: a range partitioning, a sort in each partition, and
    a prefix over the partitions' counts.

    The sorted partitions are written first: bounds of a range partitioning come from a sample that
    a second evaluation need not draw alike, and counts and rows must be of the same partitions.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33).alias("_part")
    ranged = written(ranged, "sorted")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row per partition
    return numbered.withColumn(pos, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")
