"""Suffix-array dedup after distributed prefix doubling.

A byte is removed if it lies in a string of ``threshold`` bytes that also starts anywhere else. As in
prefix doubling, positions carry the rank of the string that starts there, Spark brings (rank, rank at an
offset) pairs together, positions whose rank is unique drop out, and the rounds end once the strings
reach the threshold. ``doubled`` is that method to the letter, from 8 bytes on and for every byte. It shuffles
many times its input, so ``spans``, which the query uses, differs in two ways: a rank is a 64-bit hash of its string rather
than a dense number, and rounds start at long strings of few positions rather than at short ones of all.

Not all positions need to enter at once. A position is an anchor if a hash of its next 8 bytes says
so (one in ``step``, on average); the strings' own bytes alone decide, so that equal strings have
the same anchors. Window starts are grouped by the first anchor after them, cut into pieces of
``step`` starts, and a group enters with

  j  the rank of the bytes that all of its windows share, ``threshold - step`` of them;
  t  the rank of all the bytes that its windows cover, ``threshold`` or more.

Round 1 drops groups whose j is unique: no window of theirs can repeat. Round 2 ranks (j, t) pairs;
where a pair is found twice, all windows of the group repeat. Round 3 takes the window starts of
what is left, one by one, with the ranks of their first and second halves, and keeps pairs found
twice; one group of each repeated pair stands by for its copies there. Windows without an anchor
enter round 3 directly. So all repeats are found, and only the edges of shared passages come down to
single positions.

Filters (bit maps of hashed keys) spare rows and texts the shuffle that have no match; what they let
through wrongly is dropped by the join that follows. A filter has SPARSE bits for each key, 32 MB at
the most: it is sent to all executors.

Defined results
  null or empty text   no bytes, nothing removed
  short text           under the threshold: nothing removed
  very long text       read whole
  repeated rows        copies of a text of threshold bytes or more are removed wholly
  empty table          no rows
  doc_id of any type   kept
  extra columns        kept by ``deduplicated``, whatever their names; ``spans`` reads the text alone
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import positioned
from . import common

THRESHOLD = 400
CONTEXT = 8
#: Positions whose hashes are worked out at once.
BLOCK = 1 << 20
#: Bits of a filter for each key, and the most bits that it has, as a power of two.
SPARSE, MOST_BITS = 16, 28
MIX = np.uint64(0x9E3779B97F4A7C15)


def identity(raw: bytes) -> tuple[int, int]:
    """Two longs that stand for a text."""
    both = xxhash.xxh3_128_intdigest(raw)
    return signed(both >> 64), signed(both & 0xFFFFFFFFFFFFFFFF)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def step_of(threshold: int) -> int:
    return max(4, threshold * 4 // 25)


def groups(raw: bytes, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, lo, hi) of the groups of window starts lo..hi, whose shared bytes start at v."""
    n, step = len(raw), step_of(threshold)
    nothing = np.empty(0, np.int64)
    if n < threshold:
        return nothing, nothing, nothing
    eight = np.ndarray((n - CONTEXT + 1,), "<u8", raw, strides=(1,))
    parts = [np.flatnonzero((eight[at : at + BLOCK] * MIX) >> np.uint64(32) < np.uint64((1 << 32) // step)) + at for at in range(0, len(eight), BLOCK)]
    a = np.concatenate(parts)
    if not len(a):
        return nothing, nothing, nothing
    before = np.concatenate(([-1], a[:-1]))
    pieces = np.minimum((a - before - 1) // step + 1, (threshold - CONTEXT) // step + 1)
    of = np.repeat(np.arange(len(a)), pieces)
    m = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    v = a[of] - step * m
    lo = np.maximum.reduce([v - step + 1, before[of] + 1, a[of] + CONTEXT - threshold, np.zeros_like(v)])
    hi = np.minimum(v, n - threshold)
    use = np.flatnonzero(lo <= hi)
    use = use[np.argsort(lo[use], kind="stable")]
    return v[use], lo[use], hi[use]


def bare(lo: np.ndarray, hi: np.ndarray, n: int, threshold: int) -> list[tuple[int, int]]:
    """Ranges of window starts that no group holds."""
    if n < threshold:
        return []
    starts = np.concatenate(([0], hi + 1))
    ends = np.concatenate((lo - 1, [n - threshold]))
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if a <= b]


def ranked(raw: bytes, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, j) of the groups."""
    v, lo, hi = groups(raw, threshold)
    view, digest, shared = memoryview(raw), xxhash.xxh64_intdigest, threshold - step_of(threshold)
    j = np.fromiter((digest(view[x : x + shared]) for x in v.tolist()), np.uint64, len(v)).view(np.int64)
    return lo, hi, j


def covers(raw: bytes, lo: np.ndarray, hi: np.ndarray, threshold: int) -> np.ndarray:
    view, digest = memoryview(raw), xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a : b + threshold], 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo)).view(np.int64)


def windowed(raw: bytes, ranges: list[tuple[int, int]], threshold: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Windows that start in the ranges, by the ranks of their halves.

    -> (j, t, start) of those found once in this text, (j, t) of each kind found more often, and
    (lo, hi) of the starts of the latter, which repeat whatever other texts hold. A periodic text
    so comes to a few rows.
    """
    view, digest, half = memoryview(raw), xxhash.xxh64_intdigest, threshold // 2
    at = np.concatenate([np.arange(a, b + 1) for a, b in ranges])
    starts = at.tolist()
    one = np.array([digest(view[i : i + half]) for i in starts], np.uint64)
    two = np.array([digest(view[i + half : i + threshold], 1) for i in starts], np.uint64)
    _, first, back, count = np.unique(one * MIX ^ two, return_index=True, return_inverse=True, return_counts=True)
    often = count[back] > 1
    alone, kinds = np.flatnonzero(~often), first[count > 1]
    one, two = one.view(np.int64), two.view(np.int64)
    again = np.sort(at[often])
    edge = np.flatnonzero(np.diff(again) > 1)
    lo, hi = (again[np.concatenate(([0], edge + 1))], again[np.concatenate((edge, [-1]))]) if len(again) else (again, again)
    return [one[alone], two[alone], at[alone]], [one[kinds], two[kinds]], [lo, hi]


# Filters


def bits_for(keys: DataFrame) -> int:
    """Last bits of a key that a filter of these keys goes by."""
    return min(MOST_BITS, max(15, (keys.count() * SPARSE).bit_length()))


class Filter:
    """A bit for each value of the key's last bits."""

    def __init__(self, keys: DataFrame, key: str):
        self.bits = bits_for(keys)
        low = F.col(key).bitwiseAND((1 << self.bits) - 1)
        # 4 KB a row, 2**bits / 32768 rows at the most.
        rows = keys.groupBy(F.shiftright(low, 15).alias("part")).agg(F.bitmap_construct_agg(low.bitwiseAND(32767)).alias("bits")).toArrow()
        table = np.zeros(((1 << self.bits) // 32768, 4096), np.uint8)
        table[rows["part"].to_numpy()] = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(-1, 4096)
        self.table = table.ravel()

    def within(self, keys: np.ndarray) -> np.ndarray:
        low = keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.table[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# The rounds

ROWS = "kind int, j long, t long, u1 long, u2 long, lo int, hi int"


#: Kinds of rows: a group of windows, a window, a kind of windows found in one text more than once
#: (no position), and a range of starts that repeat.
GROUP, WINDOW, OFTEN, REPEATS = range(4)
NAMES = ["kind", "j", "t", "u1", "u2", "lo", "hi"]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def rows_of(out: list[list[np.ndarray]], names: list[str] = NAMES, kinds: list = KINDS) -> Iterator[pa.RecordBatch]:
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(out, kinds, strict=True)], names=names)


def add(out: list[list[np.ndarray]], kind: int, j, t, who: tuple[int, int], lo, hi) -> None:
    n = len(j)
    for column, values in zip(out, (np.full(n, kind), j, t, np.full(n, who[0]), np.full(n, who[1]), lo, hi), strict=True):
        column.append(values)


def add_windows(out: list[list[np.ndarray]], raw: bytes, ranges: list[tuple[int, int]], who: tuple[int, int], threshold: int) -> int:
    alone, often, repeats = windowed(raw, ranges, threshold)
    add(out, WINDOW, alone[0], alone[1], who, alone[2], alone[2])
    none = np.zeros(len(often[0]), np.int64)
    add(out, OFTEN, often[0], often[1], who, none, none)
    none = np.zeros(len(repeats[0]), np.int64)
    add(out, REPEATS, none, none, who, repeats[0], repeats[1])
    return len(alone[0]) + len(often[0])


def first_ranks(docs: DataFrame, threshold: int) -> DataFrame:
    """j of every group of every text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [ranked(raw, threshold)[2] for raw in common.texts(batch) if raw and len(raw) >= threshold]
        yield from rows_of([[x for x in found if len(x)]], ["j"], [pa.int64()])

    return common.map_arrow(docs.select("text"), run, "j long")


def second_ranks(docs: DataFrame, threshold: int, filter_) -> DataFrame:
    """Groups whose j passes the filter, with t (GROUP), and what windows without an anchor come to."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for raw in common.texts(batch):
            if not raw or len(raw) < threshold:
                continue
            lo, hi, j = ranked(raw, threshold)
            who = None
            some = filter_.value.within(j)
            if some.any():
                who = identity(raw)
                add(out, GROUP, j[some], covers(raw, lo[some], hi[some], threshold), who, lo[some], hi[some])
            without = bare(lo, hi, len(raw), threshold)
            if without:
                add_windows(out, raw, without, who or identity(raw), threshold)
        yield from rows_of(out)

    return common.map_arrow(docs.select("text"), run, ROWS)


def known(batch: pa.RecordBatch, filter_) -> tuple[np.ndarray, np.ndarray]:
    """u1 and u2 of each text, and whether the filter lets it through."""
    who = np.array([identity(raw or b"") for raw in common.texts(batch)], np.int64).reshape(-1, 2)
    return who, filter_.value.within(np.ascontiguousarray(who[:, 0]))


def passing(docs: DataFrame, filter_) -> DataFrame:
    """docs with u1 and u2 of their text, of those that the filter lets through."""
    schema = common.extended(docs.schema, "u1 long, u2 long")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        who, through = known(batch, filter_)
        some = np.flatnonzero(through)
        if len(some):
            part = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(who[some, 0]), pa.array(who[some, 1])], names=[*part.schema.names, "u1", "u2"])

    return common.map_arrow(docs, run, schema)


def windows(texts: DataFrame, threshold: int) -> DataFrame:
    """(text, u1, u2, ranges) -> what the windows that start in the ranges come to."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, size = [[] for _ in NAMES], 0
        for raw, u1, u2, ranges in zip(common.texts(batch), *(batch.column(c).to_pylist() for c in ("u1", "u2", "ranges")), strict=True):
            size += add_windows(out, raw, [(r["lo"], r["hi"]) for r in ranges], (u1, u2), threshold)
            if size > 1 << 18:
                yield from rows_of(out)
                out, size = [[] for _ in NAMES], 0
        yield from rows_of(out)

    return common.map_arrow(texts, run, ROWS)


def spans(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs -> (u1, u2, ranges): per text with any, ranges lo..hi of starts of windows that repeat."""
    if threshold < 32:
        raise ValueError("the threshold is at least 32 bytes")
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    often = common.written(first_ranks(docs, threshold).groupBy("j").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("j"), "ranks-1")
    second = common.written(second_ranks(docs, threshold, share(Filter(often, "j"))), "ranks-2")
    live = second.where(F.col("kind") == GROUP).join(often, "j").select("j", "t", "u1", "u2", "lo", "hi")
    pair = common.written(live.groupBy("j", "t").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u1", "u2", "lo", "hi")).alias("one")), "pairs")
    whole = pair.where("n > 1").select("j", "t")
    sure = second.where(F.col("kind") == GROUP).join(whole, ["j", "t"]).select("u1", "u2", "lo", "hi")
    doubt = pair.where("n = 1").select("j").distinct()
    todo = common.written(pair.join(doubt, "j", "left_semi").select("one.*"), "windows-todo")
    wanted = todo.groupBy("u1", "u2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    texts = passing(docs.select("text"), share(Filter(todo, "u1"))).groupBy("u1", "u2").agg(F.first("text").alias("text"))
    third = windows(texts.join(wanted, ["u1", "u2"]).select("text", "u1", "u2", "ranges"), threshold)
    third = common.written(third, "ranks-3").unionByName(second.where(F.col("kind") != GROUP))
    # A kind that one text holds more than once counts for two; a text's copies have the same rows.
    count = F.sum(F.when(F.col("kind") == OFTEN, 2).otherwise(1))
    twice = third.where(F.col("kind").isin(WINDOW, OFTEN)).groupBy("j", "t").agg(count.alias("n")).where("n > 1").select("j", "t")
    twice = common.written(twice, "ranks-3-twice")
    single = common.possible(third.where(F.col("kind") == WINDOW), twice, "j", bits_for(twice)).join(twice, ["j", "t"]).select("u1", "u2", "lo", "hi")
    inside = third.where(F.col("kind") == REPEATS).select("u1", "u2", "lo", "hi")
    return sure.unionByName(single).unionByName(inside).groupBy("u1", "u2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def doubled(docs: DataFrame, threshold: int = THRESHOLD, first: int = 8) -> DataFrame:
    """docs -> (row, text, pos): all starts of repeated windows by prefix doubling over every byte, without anchors.

    Positions start with the rank of their first bytes. Each round drops positions whose rank is unique,
    pairs a position's rank with that at the offset reached, and reranks by the sorted pairs. It gives
    what ``spans`` gives, and is kept to check it: each round shuffles a row for every byte that still repeats.
    """
    halvings = max(0, (threshold // first).bit_length() - 1)
    length = -(-threshold // (1 << halvings))
    texts = common.written(docs.where("text is not null").select("text").withColumn("row", F.monotonically_increasing_id()), "doubling-texts", keep=True)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, raw in zip(batch.column("row").to_pylist(), common.texts(batch), strict=True):
            n = len(raw) - length + 1
            if n > 0:
                view, digest = memoryview(raw), xxhash.xxh64_intdigest
                ranks = np.fromiter((digest(view[i : i + length]) for i in range(n)), np.uint64, n).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array(np.arange(n)), pa.array(ranks)], names=["row", "pos", "rank"])

    with common.scratch_scope(docs.sparkSession):
        ranks = common.written(common.map_arrow(texts, run, "row long, pos long, rank long"), "doubling")
        while True:
            often = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank")
            ranks = ranks.join(often, "rank", "left_semi")
            if length >= threshold:
                return common.written(ranks.join(texts, "row").select("row", "text", "pos"), "doubled", keep=True)
            offset = min(length, threshold - length)
            pairs = common.written(ranks.join(ranks.select("row", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("second")), ["row", "pos"]), "doubling-pairs")
            kinds = positioned(pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank", "second"), "rank", "second", pos="fresh")
            ranks = common.written(pairs.join(kinds, ["rank", "second"]).select("row", "pos", F.col("fresh").alias("rank")), "doubling")
            length += offset


def runs(ranges: list[dict] | None, threshold: int) -> list[tuple[int, int]]:
    """Ranges of window starts -> maximal runs [start, end) of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + threshold)
        else:
            out.append([lo, hi + threshold])
    return [(a, b) for a, b in out]


def kept(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in removed:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs drawn in to the bounds of characters, so that what is kept stays valid UTF-8."""
    out = []
    for a, b in removed:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def applied(docs: DataFrame, fn, schema, threshold: int) -> DataFrame:
    """fn(batch, runs of each row) over all docs (doc, text); only texts with spans are shuffled to meet them."""
    with common.scratch_scope(docs.sparkSession):
        found = common.written(spans(docs, threshold), "spans", keep=True)
    shared = docs.sparkSession.sparkContext.broadcast(Filter(found, "u1"))

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rest = np.flatnonzero(~known(batch, shared)[1])
        if len(rest):
            yield from fn(batch.take(pa.array(rest)), [[]] * len(rest))

    plain = common.map_arrow(docs, whole, schema)
    met = passing(docs, shared).join(found, ["u1", "u2"], "left").select("doc", "text", "ranges")
    cut = common.map_arrow(met, lambda batch: fn(batch, [runs(r, threshold) for r in batch.column("ranges").to_pylist()]), schema)
    return plain.unionByName(cut)


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the repeated strings, cut at whole characters; other columns stay, whatever their names."""
    others = [c for c in docs.columns if c.lower() != "text"]
    whole = docs.select(F.struct(F.lit(True), *[F.col(f"`{c}`") for c in others]).alias("doc"), "text")

    def run(batch: pa.RecordBatch, removed: list) -> Iterator[pa.RecordBatch]:
        texts = [raw if raw is None or not r else kept(raw, whole_characters(raw, r)) for raw, r in zip(common.texts(batch), removed, strict=True)]
        text = pa.array(texts, pa.binary()).cast(batch.schema.field("text").type)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), text], names=["doc", "text"])

    cut = applied(whole, run, whole.schema, threshold)
    return cut.select(*[F.col("text") if c.lower() == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: bytes, bytes removed, maximal runs removed, digest of what is kept, and the text kept,
    where runs are drawn in to whole characters."""

    def run(batch: pa.RecordBatch, removed: list) -> Iterator[pa.RecordBatch]:
        rows = []
        for raw, r in zip(common.texts(batch), removed, strict=True):
            raw = raw or b""
            rows.append((len(raw), sum(b - a for a, b in r), len(r), hashlib.sha256(kept(raw, r)).hexdigest(), kept(raw, whole_characters(raw, r))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        columns[-1] = columns[-1].cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    schema = common.with_id(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return applied(docs.select(F.col("doc_id").alias("doc"), "text"), run, schema, threshold)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
