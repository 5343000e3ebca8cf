"""Table-valued generators of sequences and points; every value is a function of its index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..plans.scratch import scratch_scope, written


def log2_up(i: int) -> int:
    return max(0, (i - 1).bit_length()) if i > 1 else 0


def tabulated(spark: SparkSession, n: int, f) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), f(F.col("id")).alias("v"))


def filled(spark: SparkSession, n: int, v: int) -> DataFrame:
    return tabulated(spark, n, lambda i: F.lit(v).cast("long"))


def empty(spark: SparkSession) -> DataFrame:
    return filled(spark, 0, 0)


def random_sequence(spark: SparkSession, n: int, seed: int = 23423, most: int = 1 << 20) -> DataFrame:
    """abs(hash(i + seed)) modulo most; the absolute value of the least long is taken as itself."""
    h = H.hash64shift(F.col("id") + seed)
    value = H.let(h, lambda x: F.when(x == -(1 << 63), -((1 << 63) % most)).otherwise(F.abs(F.greatest(x, F.lit(-(1 << 63) + 1))) % most))
    return spark.range(n).select(F.col("id").alias("pos"), value.cast("long").alias("v"))


def swapped(spark: SparkSession, n: int, swaps: list[tuple[int, int]]) -> DataFrame:
    """0 .. n-1 after swaps of positions, in order. Only touched positions are kept on the driver."""
    now: dict[int, int] = {}
    for a, b in swaps:
        now[a], now[b] = now.get(b, b), now.get(a, a)
    moved = spark.createDataFrame(sorted(now.items()), "pos long, w long")
    return spark.range(n).withColumnRenamed("id", "pos").join(F.broadcast(moved), "pos", "left").select("pos", F.coalesce("w", "pos").alias("v"))


def almost_sorted(spark: SparkSession, n: int, swaps: int) -> DataFrame:
    index = lambda k: H.hash64shift_int(k) % (1 << 64) % n
    return swapped(spark, n, [(index(2 * i), index(2 * i + 1)) for i in range(swaps)])


def almost_sorted_32(spark: SparkSession, start: int, n: int, swaps: int) -> DataFrame:
    return swapped(spark, n, [(H.hash32_int(2 * i) % n, H.hash32_int(2 * i + 1) % n) for i in range(start, start + swaps)])


def exponential(spark: SparkSession, n: int, seed: int) -> DataFrame:
    levels = log2_up(n) + 1
    key = 2 * (F.col("id") + seed)
    span = F.call_function("shiftleft", F.lit(1).cast("long"), H.random_index(key, F.lit(levels)).cast("int"))
    value = H.let(span, lambda r: H.hash64shift(r + H.random_index(key, r)))
    return spark.range(n).select(F.col("id").alias("pos"), value.alias("v"))


def exponential_32(spark: SparkSession, start: int, n: int) -> DataFrame:
    levels = log2_up(n) + 1
    key = 2 * (F.col("id") + start)
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (H.hash32(key) % levels).cast("int"))
    value = H.let(span, lambda r: H.hash_int(r + H.hash32(key + 1) % r))
    return spark.range(n).select(F.col("id").alias("pos"), value.alias("v"))


def random_32(spark: SparkSession, start: int, end: int, kind: str = "int") -> DataFrame:
    f = {"int": H.hash_int, "uint": H.hash32, "double": H.hash_double}[kind]
    return spark.range(end - start).select(F.col("id").alias("pos"), f(F.col("id") + start).alias("v"))


# Points


def unit_square(i: Column) -> Column:
    second = i + H.hash32(i)
    return F.struct((2 * H.hash_double(i) - 1).alias("x"), (2 * H.hash_double(second) - 1).alias("y"))


def unit_cube(i: Column) -> Column:
    second = i + H.hash32(i)
    third = 2 * i + H.hash32(second)
    return F.struct(*[(2 * H.hash_double(k) - 1).alias(n) for n, k in (("x", i), ("y", second), ("z", third))])


def squared(p: Column, d: int) -> Column:
    return p["x"] * p["x"] + p["y"] * p["y"] + (p["z"] * p["z"] if d == 3 else F.lit(0.0))


#: A point of the square is in the disc with probability 0.785: 64 tries fail once in 10**42.
TRIES = 64


def in_sphere(i: Column, d: int = 2) -> Column:
    """The first of a row of candidates that lies in the unit sphere."""
    offsets = F.array(*[F.lit(H.hash32_int(j) & 0x7FFFFFFF).cast("long") for j in range(TRIES)])
    point = unit_square if d == 2 else unit_cube
    return F.element_at(F.filter(F.transform(offsets, lambda o: point(o + i)), lambda p: squared(p, d) <= 1.0), 1)


def scaled(p: Column, k: Column, d: int) -> Column:
    return F.struct(*[(p[a] * k).alias(a) for a in ("x", "y", "z")[:d]])


def on_sphere(i: Column, d: int = 2) -> Column:
    return H.let(in_sphere(i, d), lambda p: scaled(p, 1 / F.sqrt(squared(p, d)), d))


def kuzmin(i: Column) -> Column:
    s = H.hash_double(H.hash_int(i))
    return H.let(on_sphere(i, 2), lambda p: scaled(p, F.sqrt(1 / ((1 - s) * (1 - s)) - 1), 2))


def plummer(i: Column) -> Column:
    s = F.pow(H.hash_double(H.hash_int(i)), F.lit(2 / 3))
    return H.let(on_sphere(i, 3), lambda p: scaled(p, F.sqrt(s / (1 - s)), 3))


def points(spark: SparkSession, n: int, f) -> DataFrame:
    return spark.range(n).select("id", f(F.col("id")).alias("p")).select("id", "p.*")


# Permutations


def random_permutation(spark: SparkSession, n: int) -> DataFrame:
    """The shuffle that swaps i with hash(i) mod (i + 1), from the last i down, without doing the swaps in turn.

    Followed back from the end, what lies at p was moved there by swap p, from place j(p) (earlier swaps do not reach p).
    There it had come by the next swap with that same j, if there is one, at whose own place the story
    goes on with the first swap whose j is that place. So each swap leads to at most one later swap, and
    the ends of these chains are found by pointer doubling: rounds by the logarithm of the longest.
    """
    i, j = F.col("i"), F.col("j")
    with scratch_scope(spark):
        drawn = spark.range(n).select(F.col("id").alias("i"), (H.hash32(F.col("id")) % (F.col("id") + 1)).alias("j"))
        # A place is drawn by ln n swaps on average, place 0 by ln n as well.
        swaps = written(drawn.withColumn("after", F.lead("i").over(Window.partitionBy("j").orderBy("i"))), "swaps")
        first = swaps.where(i > j).groupBy("j").agg(F.min("i").alias("to")).select(F.col("j").alias("at"), "to")
        hops = written(first, "hops")
        while True:
            onward = hops.select(F.col("at").alias("to"), F.col("to").alias("further"))
            longer = written(hops.join(onward, "to", "left").select("at", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hops")
            if longer.where("moved").isEmpty():
                break
            hops = longer.select("at", "to")
        ends = hops.withColumnRenamed("at", "after")
        out = swaps.join(ends, "after", "left").select(i.alias("pos"), F.coalesce("to", "after", "j").alias("v"))
        return written(out, "permutation", keep=True)
