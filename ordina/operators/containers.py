"""Ordered containers: deques, stacks, bags and maps as (pos, v) and (key, value) rows.

Every operator returns dense positions. A bag is a sequence whose positions have no meaning.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import string_compare
from ..plans import scan as plan
from ..plans.shipping import ship

MEASURES = {"trivial": lambda v: F.lit(0), "uniform": lambda v: F.lit(1), "weight": lambda v: F.abs(v) % 10}


def filled(spark: SparkSession, n: int, v: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(v).cast("long").alias("v"))


def size(xs: DataFrame) -> DataFrame:
    return xs.agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) == 0).alias("empty"))


def length(xs: DataFrame) -> DataFrame:
    """The length as a one-row table, to be broadcast: positions are never collected."""
    return F.broadcast(xs.agg(F.count(F.lit(1)).alias("_n")))


def ends(xs: DataFrame) -> DataFrame:
    return xs.agg(F.min_by("v", "pos").alias("front"), F.max_by("v", "pos").alias("back"))


def put(xs: DataFrame, at: int, value: int) -> DataFrame:
    return xs.withColumn("v", F.when(F.col("pos") == at, F.lit(value).cast("long")).otherwise(F.col("v")))


def one(xs: DataFrame, value: int, pos: Column) -> DataFrame:
    return length(xs).select(pos.cast("long").alias("pos"), F.lit(value).cast("long").alias("v"))


def push_front(xs: DataFrame, value: int) -> DataFrame:
    return one(xs, value, F.lit(0)).unionByName(xs.withColumn("pos", F.col("pos") + 1))


def push_back(xs: DataFrame, value: int) -> DataFrame:
    return xs.unionByName(one(xs, value, F.col("_n")))


def split(xs: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """[0, i) and [i, n), both from position 0."""
    return xs.where(F.col("pos") < i), xs.where(F.col("pos") >= i).withColumn("pos", F.col("pos") - i)


def split_half(xs: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = xs.crossJoin(length(xs)).withColumn("_h", F.floor(F.col("_n") / 2))
    left, right = known.where("pos < _h"), known.where("pos >= _h").withColumn("pos", F.col("pos") - F.col("_h"))
    return left.select("pos", "v"), right.select("pos", "v")


def popn_front(xs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """What is taken, what is left."""
    return split(xs, n)


def popn_back(xs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    known = xs.crossJoin(length(xs)).withColumn("_i", F.col("_n") - n)
    out = known.where("pos >= _i").withColumn("pos", F.col("pos") - F.col("_i"))
    return out.select("pos", "v"), known.where("pos < _i").select("pos", "v")


def frontn(xs: DataFrame, n: int) -> DataFrame:
    return split(xs, n)[0]


def backn(xs: DataFrame, n: int) -> DataFrame:
    return popn_back(xs, n)[0]


def tagged(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    left, right = parts
    return left.withColumn("part", F.lit(0)).unionByName(right.withColumn("part", F.lit(1)))


def pivoted(xs: DataFrame, weight: Column, p: Callable[[Column], Column]) -> DataFrame:
    """xs with _i, the first position at which p holds of the running weight (null: none)."""
    first = plan.scan(xs, weight, plan.SUM, "_m").agg(F.min(F.when(p(F.col("_m")), F.col("pos"))).alias("_i"))
    return xs.crossJoin(F.broadcast(first))


def split_by(xs: DataFrame, weight: Column, p: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Split at the first position at which p holds of the running weight; no split if it never does."""
    known = pivoted(xs, weight, p)
    right = known.where("pos >= _i").withColumn("pos", F.col("pos") - F.col("_i"))
    return known.where("_i is null or pos < _i").select("pos", "v"), right.select("pos", "v")


def split_middle(xs: DataFrame, weight: Column, p: Callable[[Column], Column]) -> DataFrame:
    """(part, pos, v) with the pivot as a part of its own."""
    known = pivoted(xs, weight, p)
    left = F.col("_i").isNull() | (F.col("pos") < F.col("_i"))
    part = F.when(left, "left").when(F.col("pos") == F.col("_i"), "middle").otherwise("right")
    pos = F.when(left, F.col("pos")).when(F.col("pos") == F.col("_i"), 0).otherwise(F.col("pos") - F.col("_i") - 1)
    return known.select(part.alias("part"), pos.alias("pos"), "v")


def insert(xs: DataFrame, at: int, value: int) -> DataFrame:
    moved = xs.withColumn("pos", F.when(F.col("pos") < at, F.col("pos")).otherwise(F.col("pos") + 1))
    return moved.unionByName(one(xs, value, F.lit(at)))


def erase(xs: DataFrame, first: int, last: int) -> DataFrame:
    left = xs.where((F.col("pos") < first) | (F.col("pos") >= last))
    return left.withColumn("pos", F.when(F.col("pos") < first, F.col("pos")).otherwise(F.col("pos") - (last - first)))


def swapped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both contents after a swap, by name."""
    return b.withColumn("of", F.lit("first")).unionByName(a.withColumn("of", F.lit("second")))


def keep_if(xs: DataFrame, p: Callable[[Column], Column]) -> DataFrame:
    return plan.reindexed(xs.where(p(F.col("v"))))


def to_array(xs: DataFrame) -> DataFrame:
    """All items in one row, in order: for sequences that a row can hold."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"].cast("string"))
    return xs.agg(F.array_join(ordered, ",").alias("items"))


def range_sum(xs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sum over [lo, hi) by the group's inverse: the prefix before hi less the prefix before lo. Bounds beyond
    the end count as the end; an empty range has no sum (null)."""
    sums = plan.scan(xs, "v", plan.SUM, "s")
    before = lambda bound: F.max_by("s", F.when(F.col("pos") < bound, F.col("pos")))
    some = F.count_if((F.col("pos") >= lo) & (F.col("pos") < hi)) > 0
    return sums.agg(F.when(some, before(hi) - F.coalesce(before(lo), F.lit(0))).alias("total"))


def stream(xs: DataFrame, f: Callable) -> DataFrame:
    """A consumer over chunks: f maps an Arrow array of values, batch by batch."""
    ship(xs.sparkSession)

    def run(batches):
        for batch in batches:
            values = batch.column("v")
            probe = f(_Vector(values))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), probe.array], names=["pos", "v"])

    return xs.select("pos", "v").mapInArrow(run, "pos long, v long")


class _Vector:
    """The arithmetic of an Arrow array, so that a consumer reads like one of a value."""

    def __init__(self, array):
        self.array = array

    def __mul__(self, k):
        return _Vector(pc.multiply(self.array, k))

    def __add__(self, k):
        return _Vector(pc.add(self.array, k))

    def __rsub__(self, k):
        return _Vector(pc.subtract(pa.scalar(k, pa.int64()), self.array))


def produced(spark: SparkSession, n: int) -> DataFrame:
    """A producer: values by offset, a batch at a time."""
    ship(spark)

    def run(batches):
        for batch in batches:
            pos = batch.column("id")
            square = pc.multiply(pos, pos)
            rest = pc.subtract(square, pc.multiply(pc.divide(square, 1009), 1009))
            yield pa.RecordBatch.from_arrays([pos, rest], names=["pos", "v"])

    return spark.range(n).mapInArrow(run, "pos long, v long")


def combined_partials(xs: DataFrame) -> DataFrame:
    return xs.agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def flat_mapped(xs: DataFrame, n: Callable[[Column], Column]) -> DataFrame:
    """Position i gives n(i) items v + j, in order of (i, j)."""
    some = xs.withColumn("_c", n(F.col("pos"))).where("_c > 0")
    items = some.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c").cast("long") - 1)))
    return plan.positioned(items.select(F.col("pos").alias("i"), "j", (F.col("v") + F.col("j")).alias("v")), "i", "j").select("pos", "v")


def upserts(items: DataFrame) -> DataFrame:
    """(key, value, seq): the last write of each key wins."""
    return items.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def string_compare_scan(rows: DataFrame) -> DataFrame:
    """First non-zero comparison in order of positions: a monoid that does not commute."""
    c = string_compare(F.col("a"), F.col("b"))
    return rows.select("pos", c.alias("c")).where("c <> 0").agg(F.coalesce(F.min_by("c", "pos"), F.lit(0)).alias("result"))


def fork_join(xs: DataFrame, grain: int = 1000) -> DataFrame:
    """Blocks of ``grain`` items are solved apart and joined in order."""
    parts = xs.groupBy(F.floor(F.col("pos") / grain).alias("b")).agg(F.max("v").alias("m"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: x["m"].cast("string")), ",").alias("maxima"))
