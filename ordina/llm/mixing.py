"""Mixing sources to target weights.

Words are summed per source, a target is derived for each source and with it a repetition rate
(target / size). A document is emitted floor(rate) times, and once more if a number that is a hash
of (seed, doc_id, text) falls under the rate's fraction. The decision is a function of the row
alone, so that a task that is run again decides the same.

Defined results
  null source     a source of its own, after all others
  null text       size 0; it is emitted like any document of its source
  empty source    a source whose documents have no word: target 0, rate 0, no copies
  repeated rows   equal (doc_id, text) get equal decisions
  null doc_id     takes part as the empty id
  empty table     no rows
  extra columns   kept, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A source table of up to this many rows (about 100 bytes each) is sent to all executors; a larger
#: one is joined by a shuffle whose skew Spark splits.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) -> with target.

    Sources in order of code points (null last) take the weights in turn and share the sum of all
    sizes. No target exceeds ``most`` times its source's size: in order of size per weight, those
    that stay under their share stop at that bound, and the rest share what is left by weight.
    The table has a row per source, and the windows run over it, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    # size_a / weight_a < size_b / weight_b in whole numbers would need a common multiple; the
    # quotients of equal ratios are equal doubles, and the name settles the rest.
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(total))
        .withColumn("left", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(after))
        .withColumn("capped", most * F.col("source_size") * F.col("weights") <= F.col("left") * F.col("weight"))
    )
    # The capped ones come first; all others share by the first row that is not capped (of equal
    # ratios the one with most left).
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), -F.col("left"), "left", "weights"))).over(total)
    share = (first["left"] * F.col("weight")).cast("double") / first["weights"]
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the columns as text."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def planned(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> DataFrame:
    """docs -> doc (the row of docs), size, source_size, target, rate and copies (how often the mix takes it)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    sized = rows.withColumn("size", word_count(F.col("doc.text")))
    # Partial sums before the shuffle: a source of any size sends one row per task.
    sizes = sized.groupBy(F.col("doc.source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = common.written(source_targets(sizes, weights, most), "source-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    whole = F.floor("rate")
    once_more = uniform(seed, F.col("doc.doc_id"), F.col("doc.text")) < F.col("rate") - whole
    return (
        sized.join(targets, F.col("doc.source").eqNullSafe(F.col("source")), "left")
        .drop("source")
        .withColumn("rate", rate)
        .withColumn("copies", (whole + once_more.cast("long")).cast("int"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    copies = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))
    return planned(docs, weights, most, seed).select("doc", copies.alias("copy")).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return planned(docs).select(
        "doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM sizes
), ranked AS (
  SELECT *, total - 3 * coalesce((sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS lft,
         (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
  FROM weighted WINDOW r AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), capped AS (
  SELECT *, 3 * source_size * weights <= lft * weight AS cap FROM ranked
), free AS (
  SELECT lft, weights FROM capped WHERE NOT cap ORDER BY source_size::DOUBLE / weight, lft DESC LIMIT 1
), targets AS (
  SELECT c.source, c.source_size,
         CASE WHEN cap THEN (3 * source_size)::DOUBLE ELSE (f.lft * c.weight)::DOUBLE / f.weights::DOUBLE END AS target
  FROM capped c LEFT JOIN free f ON true
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('1|' || coalesce(s.doc_id::VARCHAR, '') || '|' || coalesce(s.text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated
"""
