"""What the training-data operators share: the shared scratch folder and Arrow row helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.scratch import scratch_path, scratch_scope, written
from ..plans.shipping import ship

__all__ = ["WORD", "bit_at", "crc32_mod", "decoded", "extended", "map_arrow", "possible", "scratch_path", "scratch_scope", "ship", "small_batches", "texts", "with_id", "written"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def decoded(raw: bytes | None) -> str:
    return "" if raw is None else raw.decode("utf-8", "replace")


def extended(schema: StructType, more: str) -> StructType:
    """A new schema with more columns; a DataFrame's own schema is never changed."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


#: Rows and bytes of an Arrow batch at the most (a single longer row is a batch by itself).
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limits of Arrow batches: texts are long, and a worker holds a batch and what
    it makes of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow over batches; fn yields batches for one; empty batches are skipped."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def with_id(docs: DataFrame, more: str) -> StructType:
    """The schema of a table's doc_id, of whatever type, and more columns."""
    return extended(StructType([docs.schema["doc_id"]]), more)


def bit_at(bits: str, place: Column) -> Column:
    """Whether the bit at this place of a binary column is set."""
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1


def possible(table: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows of table whose key passes the filter of the keys, by a join with the filter's parts: 4 KB
    each and 2**bits / 2**15 of them at the most, whatever the tables."""
    low = F.col(key).bitwiseAND((1 << bits) - 1)
    parts = keys.groupBy(F.shiftright(low, 15).alias("_part")).agg(F.bitmap_construct_agg(low.bitwiseAND(32767)).alias("_bits"))
    place = low.bitwiseAND(32767)
    joined = table.withColumn("_part", F.shiftright(low, 15)).join(F.broadcast(parts), "_part")
    return joined.where(bit_at("_bits", place)).select(*table.columns)


def crc32_mod(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor
