"""Skeletons that run in rounds: folds by a caller's associative function, and worklists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import BLOCK
from .scratch import scratch_scope, written
from .shipping import ship


def fold(xs: DataFrame, combine: Callable, identity: object, kind: str = "long", block: int = BLOCK) -> DataFrame:
    """(pos, v) -> one row (v): the values in order of pos, combined by an associative Python function that
    need not commute. Blocks of positions are folded apart, then blocks of blocks, so that no task has
    more than ``block`` rows; an empty table gives the identity."""
    spark = xs.sparkSession
    ship(spark)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pos": [key[0]], "v": [reduce(combine, frame.sort_values("pos")["v"].tolist())]})

    with scratch_scope(spark):
        now, rows = xs.select("pos", "v"), None
        while rows is None or rows > 1:
            blocks = now.groupBy(F.floor(F.col("pos") / block).cast("long").alias("b"))
            now = written(blocks.applyInPandas(run, f"pos long, v {kind}"), "fold")
            rows = now.count()
        if rows == 0:
            now = spark.createDataFrame([(identity,)], f"v {kind}")
        return written(now.select("v"), "folded", keep=True)


def worklist(first: DataFrame, expand: Callable[[DataFrame], DataFrame], most: int = 100_000) -> DataFrame:
    """(id) -> (id, round): all items that the first ones lead to, each taken up once, in the first round that
    names it. ``expand`` maps a table of items (id) to the items (id) that they put on the list."""
    with scratch_scope(first.sparkSession):
        todo = written(first.select("id").distinct(), "worklist")
        done = todo.withColumn("round", F.lit(0))
        for turn in range(1, most):
            todo = written(expand(todo).select("id").distinct().join(done, "id", "left_anti"), "worklist")
            if todo.isEmpty():
                return written(done, "worklist-done", keep=True)
            done = done.unionByName(todo.withColumn("round", F.lit(turn)))
            if turn % 16 == 0:  # keeps the plan of what is done short
                done = written(done, "worklist-done")
    raise RuntimeError("the list did not run empty")
