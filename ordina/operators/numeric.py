"""Dense linear algebra in long form, and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dots(rows: DataFrame) -> DataFrame:
    """(vec_id, row array): row . (1, 2, 3 ...)."""
    products = F.transform("row", lambda x, i: x * (i.cast("long") + 1))
    return rows.select("vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x).alias("dot"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(r, c, val) times (c, x) -> (r, v). The vector joins by column; partial sums meet by row."""
    return matrix.join(vector, "c").groupBy("r").agg(F.sum(F.col("val") * F.col("x")).alias("v"))


def speedups(runs: DataFrame) -> DataFrame:
    """(workers, t): mean time of the fewest workers over the mean time of each number."""
    means = runs.groupBy("workers").agg(F.sum("t").alias("total"), F.count(F.lit(1)).alias("n"))
    base = means.agg(F.min_by(F.struct("total", "n"), "workers").alias("b"))
    own = F.col("total").cast("double") / F.col("n")
    return means.crossJoin(F.broadcast(base)).select("workers", F.round(F.col("b.total").cast("double") / F.col("b.n") / own, 6).alias("speedup"))
