"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written in the blocks of ``scratch_scope`` that are open, innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that setting is absent (local runs) a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ordina-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ordina/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder by whatever file system it is on."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end of the block, but for those written with keep=True,
    which belong to the block around it. What is used afterwards must rest on kept tables alone."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            delete(spark, path)


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends here, and a lost
    executor costs a task of the writing job but never what has been written."""
    path = scratch_path(df.sparkSession, name)
    scopes = _open.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
