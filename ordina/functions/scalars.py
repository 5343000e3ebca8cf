"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import scan as plan

#: Functors of two values a and b.
FUNCTORS = {
    "identity": lambda a, b: a,
    "add": lambda a, b: a + b,
    "abs": lambda a, b: F.abs(a),
    "zero": lambda a, b: F.lit(0),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "first": lambda a, b: a,
    "second": lambda a, b: b,
}


def log2_up(i: Column) -> Column:
    """Ceiling of the binary logarithm; 0 up to 1. The digits of i - 1, so that powers of 2 are exact."""
    return F.when(i <= 1, 0).otherwise(F.length(F.bin(i - 1)))


def log2_down(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def n_log_n(n: Column) -> Column:
    return n * log2_down(n)


def median_of_3(a: Column, b: Column, c: Column) -> Column:
    return F.element_at(F.array_sort(F.array(a, b, c)), 2)


def triangular_root(x: Column) -> Column:
    return F.floor((F.sqrt(4 * x + 1) + 1) / 2).cast("long")


def fibonacci(n: int) -> int:
    a, b = 0, 1
    for _ in range(n):
        a, b = b, a + b
    return a


def string_compare(x: Column, y: Column) -> Column:
    """Sign of the first difference over the common length; 0 if one begins with the other."""
    n = F.least(F.length(x), F.length(y))
    a, b = F.left(x, n), F.left(y, n)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def paren_value(c: Column) -> Column:
    return F.when(c == "(", F.lit(1)).when(c == ")", F.lit(-1)).cast("long")


def value_paren(v: Column) -> Column:
    return F.when(v == 1, "(").when(v == -1, ")")


def matching(parens: DataFrame) -> DataFrame:
    """(pos, v = 1 or -1): are they balanced? No prefix is negative, and the sum is 0."""
    depth = plan.scan(parens, "v", plan.SUM, "depth", inclusive=False)
    return depth.agg((F.coalesce(F.bool_and(F.col("depth") >= 0), F.lit(True)) & (F.coalesce(F.sum("v"), F.lit(0)) == 0)).alias("matching"))


def parsed_number(text: Column, kind: str = "double") -> Column:
    """As C reads a number: what isn't one is 0."""
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(0).cast(kind))


def readable_time(us: Column) -> Column:
    """Microseconds as seconds, milliseconds or microseconds."""
    return (
        F.when(us >= 1_000_000, F.format_string("%.1f seconds", us / 1e6))
        .when(us >= 100_000, F.format_string("%.2f seconds", us / 1e6))
        .when(us >= 10_000, F.format_string("%.1f milliseconds", us / 1e3))
        .when(us >= 1_000, F.format_string("%.2f milliseconds", us / 1e3))
        .otherwise(F.format_string("%d microseconds", us.cast("long")))
    )


def colour_step(p: Column) -> Column:
    """A share of 0..1 -> a step of 0..1530 of the colour circle."""
    return F.least(F.greatest(F.floor(p * 1530), F.lit(0)), F.lit(1530)).cast("long")
