"""Buffers of a fixed capacity: sequences (pos, v) that refuse to hold more than they may.

Whether a buffer keeps within its capacity, and has what is taken from it, is counted at once, an aggregate over
positions; where it does not, the operation raises ValueError and the buffer stays as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, containers


@dataclass(frozen=True)
class Buffer:
    """A ring buffer or a stack: which end is used is the caller's choice, as positions have no cost."""

    items: DataFrame
    capacity: int

    def made(self, items: DataFrame) -> Buffer:
        """A buffer of the same capacity with these items, which must fit."""
        if items.count() > self.capacity:
            raise ValueError(f"more than {self.capacity} items")
        return Buffer(items, self.capacity)

    def state(self) -> DataFrame:
        """One row: size, and whether it is empty, full, or neither."""
        n = F.count(F.lit(1))
        return self.items.agg(n.alias("size"), (n == 0).alias("empty"), (n == self.capacity).alias("full"), ((n > 0) & (n < self.capacity)).alias("partial"))

    def push_front(self, v: int) -> Buffer:
        return self.made(containers.push_front(self.items, v))

    def push_back(self, v: int) -> Buffer:
        return self.made(containers.push_back(self.items, v))

    def pushn_front(self, xs: DataFrame) -> Buffer:
        return self.made(arrays.concat(xs, self.items))

    def pushn_back(self, xs: DataFrame) -> Buffer:
        return self.made(arrays.concat(self.items, xs))

    def has(self, n: int) -> DataFrame:
        """The items, which must be n at least."""
        if self.items.count() < n:
            raise ValueError(f"fewer than {n} items")
        return self.items

    def popn_front(self, n: int) -> tuple[DataFrame, Buffer]:
        out, left = containers.popn_front(self.has(n), n)
        return out, Buffer(left, self.capacity)

    def popn_back(self, n: int) -> tuple[DataFrame, Buffer]:
        out, left = containers.popn_back(self.has(n), n)
        return out, Buffer(left, self.capacity)

    def split(self, i: int) -> tuple[Buffer, Buffer]:
        """The first i items and the rest."""
        left, right = containers.split(self.has(i), i)
        return Buffer(left, self.capacity), Buffer(right, self.capacity)

    def concat(self, other: Buffer) -> Buffer:
        """All items of both, in the capacity of the first."""
        return self.made(arrays.concat(self.items, other.items))

    def transfer_back_to_front(self, other: Buffer, n: int) -> tuple[Buffer, Buffer]:
        """The last n items move to the front of the other buffer."""
        out, left = self.popn_back(n)
        return left, other.pushn_front(out)

    def transfer_front_to_back(self, other: Buffer, n: int) -> tuple[Buffer, Buffer]:
        """The first n items move to the back of the other buffer."""
        out, left = self.popn_front(n)
        return left, other.pushn_back(out)

    def put(self, at: int, v: int) -> Buffer:
        return Buffer(containers.put(self.has(at + 1), at, v), self.capacity)
