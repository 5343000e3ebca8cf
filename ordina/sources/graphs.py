"""Graph generators: edges (src, dst) from index arithmetic on spark.range."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..plans.shipping import ship
from .generators import log2_up


def edges(df: DataFrame, src: Column, dst: Column) -> DataFrame:
    return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"))


def times(df: DataFrame, n: Column | int, name: str) -> DataFrame:
    """Each row once for each of 0 .. n-1; none where n is 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("_n", n.cast("long")).where("_n > 0").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")


def complete(spark: SparkSession, n: int) -> DataFrame:
    """All ordered pairs of different vertices; n * n rows by definition."""
    pairs = times(spark.range(n), n, "v")
    return edges(pairs.where("id <> v"), F.col("id"), F.col("v"))


def phased(spark: SparkSession, phases: int, k: int, at_most: int, arity: int) -> DataFrame:
    """Layers of k vertices after a source; vertex j of a layer meets (j + e) mod k of the next one."""
    cells = times(spark.range(max(0, phases - 1)).withColumnRenamed("id", "r"), k, "j")
    first = edges(spark.range(k if phases > 1 else 0), F.lit(0), F.col("id") + 1)
    full = times(cells, F.when(F.col("j") < at_most, F.lit(k)).otherwise(F.lit(arity)), "e")
    return first.unionByName(edges(full, 1 + F.col("r") * k + F.col("j"), 1 + (F.col("r") + 1) * k + (F.col("j") + F.col("e")) % k))


def parallel_paths(spark: SparkSession, phases: int, paths: int, length: int) -> DataFrame:
    cells = times(spark.range(phases).withColumnRenamed("id", "r"), paths, "k")
    start = F.col("r") * (paths * length + 1)
    begin = start + 1 + F.col("k") * length
    inner = times(cells, length - 1, "p")
    end = edges(cells, begin + length - 1, start + paths * length + 1)
    return edges(cells, start, begin).unionByName(edges(inner, begin + F.col("p"), begin + F.col("p") + 1)).unionByName(end)


def chain(spark: SparkSession, m: int) -> DataFrame:
    return edges(spark.range(m), F.col("id"), F.col("id") + 1)


def circular(spark: SparkSession, n: int, k: int) -> DataFrame:
    return edges(times(spark.range(n), k, "k"), F.col("id"), (F.col("id") + F.col("k") + 1) % n)


def star(spark: SparkSession, m: int) -> DataFrame:
    return edges(spark.range(m), F.lit(0), F.col("id") + 1)


def grid_2d(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A torus: each cell to the one below and to the one on its right."""
    cells, w = spark.range(width * height), width
    row, column = F.floor(F.col("id") / w), F.col("id") % w
    below, right = (row + 1) % height * w + column, row * w + (column + 1) % w
    return edges(cells, F.col("id"), below).unionByName(edges(cells, F.col("id"), right))


def cube(spark: SparkSession, n: int) -> DataFrame:
    cells, i = spark.range(n**3), F.col("id")
    x, y, z = F.floor(i / n**2), F.floor(i / n) % n, i % n
    at = lambda x, y, z: x % n * n**2 + y % n * n + z % n
    return edges(cells, i, at(x + 1, y, z)).unionByName(edges(cells, i, at(x, y + 1, z))).unionByName(edges(cells, i, at(x, y, z + 1)))


def tree(spark: SparkSession, branching: int, height: int) -> DataFrame:
    """Vertices numbered by level: the parent of c is (c - 1) div branching."""
    m = sum(branching**level for level in range(1, height + 1))
    return edges(spark.range(1, m + 1), F.floor((F.col("id") - 1) / branching), F.col("id"))


def tree_depth_2(spark: SparkSession, b: int) -> DataFrame:
    leaves = times(spark.range(1, b + 1), b, "j")
    return edges(spark.range(b), F.lit(0), F.col("id") + 1).unionByName(edges(leaves, F.col("id"), F.col("id") * b + F.col("j") + 1))


def tree_2(spark: SparkSession, b1: int, b2: int, phases: int) -> DataFrame:
    roots = times(spark.range(phases).withColumn("root", F.col("id") * (b1 + b1 * b2)), b1, "i")
    leaves = times(roots, b2, "j")
    source = F.col("root") + F.col("i") + 1
    return edges(roots, F.col("root"), source).unionByName(edges(leaves, source, F.col("root") + b1 + F.col("i") * b2 + F.col("j") + 1))


def unbalanced_tree(spark: SparkSession, trunk: int, branches: int) -> DataFrame:
    vertex = F.col("id") * (1 + branches)
    stem = spark.range(trunk - 1)
    twigs = times(stem, branches - 1, "j")
    return edges(stem, vertex, vertex + 1 + branches).unionByName(edges(twigs, vertex + F.col("j"), vertex + F.col("j") + 1))


def rmat(spark: SparkSession, n: int, m: int, seed: int, a: float, b: float, c: float, distinct: bool = True) -> DataFrame:
    """Recursive quadrant draws; n is rounded up to a power of two. Probabilities sum to 1 at most."""
    if a + b + c > 1:
        raise ValueError("a + b + c exceed 1")
    levels = log2_up(n)
    h = H.hash32_int(seed)
    start, stride = H.hash32(2 * F.col("id") * h), H.hash32((2 * F.col("id") + 1) * h)
    if levels == 0:
        drawn = spark.range(m).select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
        return drawn.distinct() if distinct else drawn
    draws = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda l: F.struct(H.hash_double(F.col("start") + l * F.col("stride")).alias("r"), F.call_function("shiftright", F.lit(1 << levels).cast("long"), l + 1).alias("half")))
    zero = F.lit(0).cast("long")
    sides = F.transform(F.col("draws"), lambda x: F.struct(F.when(x["r"] >= a + b, x["half"]).otherwise(0).alias("s"), F.when(((x["r"] >= a) & (x["r"] < a + b)) | (x["r"] >= a + b + c), x["half"]).otherwise(0).alias("t")))
    total = lambda f: F.aggregate("sides", zero, lambda acc, x: acc + x[f])
    drawn = spark.range(m).withColumn("start", start).withColumn("stride", stride).withColumn("draws", draws).withColumn("sides", sides)
    out = edges(drawn, total("s"), total("t"))
    return out.distinct() if distinct else out


def random_local(spark: SparkSession, dim: int, degree: int, rows: int) -> DataFrame:
    """Each of rows * degree edges draws hashes until its target differs from its source."""
    if rows < 2 and degree > 0:
        raise ValueError("one vertex has no other to lead to")
    ship(spark)

    def targets(k: np.ndarray) -> np.ndarray:
        """All rows draw together; those that have a target leave."""
        out, at = np.empty(len(k), np.int64), np.arange(len(k))
        source, h, power = k // degree, k.copy(), np.full(len(k), dim + 2)
        while len(at):
            h = H.hash32_int(h) & 0x7FFFFFFF
            ready = np.ones(len(at), bool) if dim == 0 else h % 1000003 >= 500001
            power[~ready] += dim
            if dim:
                h[ready] = H.hash32_int(h[ready]) & 0x7FFFFFFF
            # A hash has 31 bits, a higher power leaves it as it is.
            reach = source + h % (1 << np.minimum(power, 31)) if dim else h
            found = ready & (reach % rows != source)
            out[at[found]] = reach[found] % rows
            at, source, h, power = (x[~found] for x in (at, source, h, power))
        return out

    def run(batches):
        for batch in batches:
            k = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(k // degree), pa.array(targets(k))], names=["src", "dst"])

    return spark.range(rows * degree).mapInArrow(run, "src long, dst long")


#: By-size choices of the generators: a number of edges -> a graph of about that size.
BY_SIZE: dict[str, Callable[[SparkSession, int], DataFrame]] = {
    "complete": lambda s, m: complete(s, int((4 * m + 1) ** 0.5 + 1) // 2),
    "phased": lambda s, m: phased(s, max(1, m // 1600), 40, 20, 1),
    "parallel_paths": lambda s, m: parallel_paths(s, 3, 10, max(1, m // 30)),
    "chain": lambda s, m: chain(s, max(2, m)),
    "circular_knext": lambda s, m: circular(s, max(2, m), 1),
    "rmat": lambda s, m: rmat(s, int(0.2 * m), m, 12334, 0.5, 0.1, 0.1),
    "random": lambda s, m: random_local(s, 10, 8, max(2, m // 8)),
    "square_grid": lambda s, m: grid_2d(s, int((m / 2) ** 0.5), int((m / 2) ** 0.5)),
    "cube_grid": lambda s, m: cube(s, int(round((m / 3) ** (1 / 3), 9))),
    "star": star,
    "tree_binary": lambda s, m: tree(s, 2, max(1, log2_up(m) - 1)),
}


def chosen(spark: SparkSession, m: int, seed: int) -> DataFrame:
    """One of the generators, by a hash of the seed."""
    names = sorted(BY_SIZE)
    return BY_SIZE[names[H.hash32_int(seed) % len(names)]](spark, m)


def relabelled(graph: DataFrame, vertices: DataFrame, seed: int) -> DataFrame:
    """Both ends of each edge by one random permutation of the vertices (id)."""
    from ..plans.scan import positioned

    table = positioned(vertices.select("id", H.hash64shift(F.col("id") + seed).alias("h")), "h", "id", pos="new").select("id", "new")
    out = graph.join(table.withColumnRenamed("id", "src"), "src").select(F.col("new").alias("s"), "dst")
    return out.join(table.withColumnRenamed("id", "dst"), "dst").select(F.col("s").alias("src"), F.col("new").alias("dst"))


