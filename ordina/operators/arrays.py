"""Operators on sequences: DataFrames with an explicit 0-based position ``pos`` and a value ``v``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import scan as plan

VALUE_MIN, VALUE_MAX = -(1 << 63), (1 << 63) - 1


# Projections, reshaping, filters


def mapped(xs: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return xs.withColumn("v", f(F.col("v")))


def map_pair(xs: DataFrame, ys: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Position by position; as long as the shorter one."""
    return xs.join(ys.withColumnRenamed("v", "w"), "pos").select("pos", f(F.col("v"), F.col("w")).alias("v"))


def sliced(xs: DataFrame, lo: int, hi: int) -> DataFrame:
    return xs.where((F.col("pos") >= lo) & (F.col("pos") < hi)).withColumn("pos", F.col("pos") - lo)


def take(xs: DataFrame, n: int) -> DataFrame:
    return xs.where(F.col("pos") < n)


def drop(xs: DataFrame, n: int) -> DataFrame:
    return xs.where(F.col("pos") >= n).withColumn("pos", F.col("pos") - n)


def ktimes(xs: DataFrame, k: int) -> DataFrame:
    copies = xs.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return copies.withColumn("pos", F.col("pos") * k + F.col("_j")).drop("_j")


def duplicate(xs: DataFrame) -> DataFrame:
    return ktimes(xs, 2)


def filtered(xs: DataFrame, p: Callable[[Column], Column]) -> DataFrame:
    """Stable, with dense positions."""
    return plan.reindexed(xs.where(p(F.col("v"))))


def pack(flags: DataFrame, xs: DataFrame) -> DataFrame:
    """Items whose flag (flags: pos, flag) at the same position is set."""
    return plan.reindexed(xs.join(flags.where("flag").select("pos"), "pos", "left_semi"))


def pack_index(flags: DataFrame) -> DataFrame:
    return plan.reindexed(flags.where("flag").select("pos", F.col("pos").alias("v")))


def enumerated(flags: DataFrame) -> DataFrame:
    """Exclusive rank of set flags."""
    return plan.scan(flags, F.col("flag").cast("long"), plan.SUM, "rank", inclusive=False)


def two_sided(xs: DataFrame, left: Callable[[Column], Column], right: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Items with left > 0, and items with right > 0; an item may be in both or in none."""
    return plan.reindexed(xs.where(left(F.col("v")) > 0)), plan.reindexed(xs.where(right(F.col("v")) > 0))


def concat(*parts: DataFrame) -> DataFrame:
    """One after another; each part has dense positions from 0."""
    sizes = [part.agg(F.count(F.lit(1)).alias("_n")) for part in parts]  # a row each
    out, before = parts[0], sizes[0]
    for part, size in zip(parts[1:], sizes[1:], strict=True):
        out = out.unionByName(part.crossJoin(F.broadcast(before)).withColumn("pos", F.col("pos") + F.col("_n")).drop("_n"))
        before = before.withColumnRenamed("_n", "_m").crossJoin(F.broadcast(size)).select((F.col("_m") + F.col("_n")).alias("_n"))
    return out


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("c").alias("r"), F.col("r").alias("c"), *[x for x in matrix.columns if x not in ("r", "c")])


def block_transposed(blocks: DataFrame) -> DataFrame:
    """(r, c, i, v): blocks of any length -> v in order of (c, r, i)."""
    return plan.positioned(blocks.select("c", "r", "i", "v"), "c", "r", "i").select("pos", "v")


# Reductions


def reduced(xs: DataFrame, monoid: plan.Monoid, lift: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """One row, the identity where there is no item."""
    return xs.agg(F.coalesce(monoid.aggregate(lift(F.col("v"))), F.lit(monoid.identity)).alias("v"))


def max_index(xs: DataFrame) -> DataFrame:
    """The smallest position of the largest value."""
    return xs.agg(F.max_by("pos", F.struct("v", -F.col("pos"))).alias("pos"), F.max("v").alias("v"))


# Scans


def mcss(xs: DataFrame, block: int = plan.BLOCK) -> DataFrame:
    """Largest sum of a contiguous, non-empty run; VALUE_MIN where there is none.

    One pass over blocks of positions gives each block's total, its least and largest prefix and its best
    run; runs over several blocks come from the few block rows.
    """
    inside = Window.partitionBy("b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = xs.select(F.floor(F.col("pos") / block).alias("b"), "pos", F.coalesce("v", zero).alias("v"))
    rows = rows.withColumn("s", F.sum("v").over(inside))
    rows = rows.withColumn("m", F.min(F.col("s") - F.col("v")).over(inside))  # least prefix before here, the block's start included
    blocks = rows.groupBy("b").agg(F.sum("v").alias("total"), F.min("s").alias("low"), F.max("s").alias("high"), F.max(F.col("s") - F.col("m")).alias("best"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("total").over(earlier), zero))
    blocks = blocks.withColumn("least", F.least(F.coalesce(F.min(F.col("base") + F.col("low")).over(earlier), zero), zero))
    return blocks.agg(F.coalesce(F.max(F.greatest("best", F.col("base") + F.col("high") - F.col("least"))), F.lit(VALUE_MIN)).alias("mcss"))


def next_nonempty(counts: DataFrame, m: int) -> DataFrame:
    """(key, n) -> first index of each key 0..m-1; an empty key has that of the next one."""
    keys = counts.sparkSession.range(m).withColumnRenamed("id", "key").join(counts, "key", "left").select(F.col("key").alias("pos"), F.coalesce("n", F.lit(0)).alias("v"))
    return plan.scan(keys, "v", plan.SUM, "start", inclusive=False).select(F.col("pos").alias("key"), "start")


def measured_prefix(xs: DataFrame, weight: Column, p: Callable[[Column], Column]) -> DataFrame:
    """The first position whose running weight satisfies p, null where none does."""
    return plan.scan(xs, weight, plan.SUM, "m").agg(F.min(F.when(p(F.col("m")), F.col("pos"))).alias("pos"))


# Order


def sort(xs: DataFrame, *keys: Column | str) -> DataFrame:
    keys = keys or ("v",)
    return plan.positioned(xs.drop("pos"), *keys)


def stable_sort(xs: DataFrame, *keys: Column | str) -> DataFrame:
    return plan.positioned(xs.withColumnRenamed("pos", "_was"), *keys, "_was").drop("_was")


def merge(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Of two sorted sequences; of equal values, those of xs come first."""
    both = xs.withColumn("_of", F.lit(0)).unionByName(ys.withColumn("_of", F.lit(1))).withColumnRenamed("pos", "_was")
    return plan.positioned(both, "v", "_of", "_was").select("pos", "v")


def lower_bound(xs: DataFrame, value: int) -> DataFrame:
    """The first position of a value not under the given one; the length where there is none."""
    return xs.agg(F.coalesce(F.min(F.when(F.col("v") >= value, F.col("pos"))), F.count(F.lit(1))).alias("pos"))
