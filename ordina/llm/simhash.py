"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints. A text's words (A-Z lower-cased) give shingles, repeats included; a shingle's XXH64
votes on each of 64 bits, and a bit is set if over half of the shingles set it.

Links. Two fingerprints link at ``radius`` or fewer differing bits. A fingerprint is embedded as
the vector of its bit counts in SEGMENTS segments. The Manhattan distance of two such vectors never
exceeds the number of differing bits, so all links lie within ``radius`` in the embedding. The
coordinates are dealt to BLOCKS blocks: a pair within ``radius`` agrees wholly on all blocks but
``radius`` of them, so a grid whose cells are the coordinates of each choice of BLOCKS - radius
blocks has a cell for every pair. Inside a cell pairs are filtered by their Manhattan distance and
then verified by exact Hamming distance.

Crowded cells. A cell of more than CROWDED distinct fingerprints would emit all its pairs; there the
exact way is another: two fingerprints within 2 bits share a midpoint (a point within 1 bit of
both), and all that share a point are within 2 bits of each other. Every member of a crowded cell
therefore names its 65 points within 1 bit, and each point links its members to the smallest of
them: 65 rows a member whatever the size of the cell, and the same components.

Components are found by alternating star contractions over links of distinct fingerprints; copies
are not links.

Deduplication. ``deduplicated`` keeps one row of each group. Its links are those above, of the whole texts'
fingerprints by embedding, grid, Manhattan bound and exact Hamming distance, and besides them those of
``similar``, for near copies that lie further apart than ``radius`` bits.

Similarity. ``similar`` serves thresholds of Jaccard similarity over shingles. At 0.8 some 15 % of the
bits of two whole texts' fingerprints differ, far beyond what a grid can serve whatever the number of
texts. So a text has PRINTS fingerprints there, each of the SAMPLE shingles that come first under one
of PRINTS random orders. Two texts of similarity s draw the same sample with a probability of about
s**SAMPLE, and equal samples have equal fingerprints: at 0.8 a pair shares one of 14 with 0.996, at
0.9 with more than 0.9999, in any number of texts. Embedding and grid are those for a radius of zero, where a
cell is the fingerprint itself. Candidates are verified exactly, by the shingles of whole texts.

Groups. Texts of equal shingles are one node. In each cell every member is verified against the
smallest, unless other cells have connected them; so a cell gives no more pairs than it has members. Cells whose members these links
leave in several components are then compared wholly: in blocks of bounded size, a pair of blocks is a
task's work, only links between components come back, and blocks of one component are not paired. So
each pair of a cell is compared or already connected; the work in a cell of many texts that are no
near copies grows with the square of its size, but no rows do.

Defined results
  null or empty text   no shingles, fingerprint zero, linked like any other
  few words            the whole sequence is the only shingle
  very long text       all of its shingles vote, in blocks
  ties in a vote       exactly half does not set the bit
  repeated rows        equal rows, equal results; equal doc_ids stay as they are
  null doc_id          never the smallest of its component unless all are null
  shared doc_ids       each row is a document by itself; ``deduplicated`` keeps one row of a group,
                       that of the smallest doc_id, and among equal ids the first one stored
  equal shingle sets   one node, which takes the links of each fingerprint that its repeats give
  doc_id of any type   kept; components are named by the smallest one
  empty table          no rows
  extra columns        not read; ``deduplicated`` keeps them, whatever their names
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SEGMENTS, BLOCKS = 32, 4
CROWDED = 64
#: Shingles voted on at once.
VOTES = 1 << 16


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; a shorter text is one shingle, no words are none."""
    found = (raw or b"").lower().split()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)] if found else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    bounds = zip([0, *ends[: len(found) - words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in bounds), np.uint64, len(found) - words + 1)


def fingerprint(raw: bytes | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    hashes, votes = shingles(raw, words), np.zeros(64, np.int64)
    total = len(hashes)
    for at in range(0, total, VOTES):
        part = hashes[at : at + VOTES]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs -> (doc_id, fp), fp as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(raw, words) for raw in common.texts(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return common.map_arrow(docs.select("doc_id", "text"), run, common.with_id(docs, "fp long"))


def embedded(fp: Column) -> Column:
    """Bit counts of the SEGMENTS segments, one in each 64 / SEGMENTS bits of a long.

    With segments of two bits this is the first step of the usual parallel bit count.
    """
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    # Two-bit sums never carry into the neighbouring segment: both = 10, one = 01, none = 00.
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embedded vectors of two-bit coordinates 0, 1 and 2."""
    odd = F.lit(0x5555555555555555)
    parts = []
    for x, y in ((a, b), (b, a)):  # |x - y| >= 1 and |x - y| = 2, coordinate by coordinate
        parts.append((F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(F.shiftrightunsigned(y, 1).bitwiseOR(y)))).bitwiseAND(odd))
    differ = a.bitwiseXOR(b)
    some = F.shiftrightunsigned(differ, 1).bitwiseOR(differ).bitwiseAND(odd)
    return F.bit_count(some) + F.bit_count(parts[0]) + F.bit_count(parts[1])


def cells(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of the coordinates that make up a cell: each choice of blocks - radius blocks."""
    width = 64 // blocks
    return [sum(((1 << width) - 1) << (width * b) for b in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(points: DataFrame, radius: int = 2, blocks: int = BLOCKS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints (fp): all pairs within radius outside of crowded
    cells, and for those of crowded cells links that connect the same fingerprints."""
    if radius != 2:
        raise ValueError("midpoints of crowded cells are worked out for a radius of 2")
    shape = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(signed(m)).alias("m")) for k, m in enumerate(cells(radius, blocks))])
    grid = (
        points.withColumn("v", embedded(F.col("fp")))
        .select("fp", "v", F.explode(shape).alias("s"))
        .select(F.col("s.k").alias("k"), F.col("v").bitwiseAND(F.col("s.m")).alias("cell"), "fp", "v")
    )
    counts = common.written(grid.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    sparse = grid.join(counts.where(F.col("n") <= crowded), ["k", "cell"]).select("k", "cell", "fp", "v")
    near = sparse.groupBy("k", "cell").agg(F.collect_list(F.struct("fp", "v")).alias("members"))
    pairs = near.select(F.explode("members").alias("x"), "members").select("x", F.explode(F.filter("members", lambda y: y["fp"] > F.col("x.fp"))).alias("y"))
    found = (
        pairs.where(manhattan(F.col("x.v"), F.col("y.v")) <= radius)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )
    full = counts.where(F.col("n") > crowded)
    if full.isEmpty():
        return common.written(found.distinct(), "links")
    members = grid.join(full, ["k", "cell"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)])
    around = members.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("point"))
    least = around.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "a")
    star = around.join(least, "point").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return common.written(found.unionByName(star).distinct(), "links")


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """Edges (a, b) -> (node, root), root the smallest node reachable; nodes of edges only.

    Each round hangs every node under the smallest node that it or a neighbour knows (a large star)
    and then short-cuts parents (a small star). Only longs move, each round's result is written, so
    that plans stay short, and the number of rounds grows as the logarithm of a component's width.
    """
    now = edges
    for _ in range(most):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = common.written(large.where("x <> y").distinct(), "stars")
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.explode(F.array(F.struct(F.col("x").alias("b"), F.col("m").alias("a")), F.struct(F.col("y").alias("b"), F.col("m").alias("a")))).alias("e"))
        after = common.written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        # Done when the links are stars around roots: no root is under another, each node has one parent.
        crossed = after.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = after.select(F.col("a").alias("b")).join(after.select("b"), "b", "left_semi")
        now = after
        if crossed.isEmpty() and deep.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, component_id): the smallest doc_id reachable over links."""
    first = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints-distinct")
    edges = links(first.select("fp"), radius)
    if edges.isEmpty():
        roots = first.select("fp", F.col("first").alias("component_id"))
    else:
        linked = components(edges)
        named = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
        roots = named.join(smallest, "root").select("fp", "component_id")
    roots = common.written(roots, "print-classes")
    return prints.join(roots, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs -> (doc_id, fp, component_id)."""
    return classes(common.written(fingerprints(docs, words), "prints"), radius)


# Similarity

#: Fingerprints of a text, and shingles in the sample of each.
PRINTS, SAMPLE = 14, 5
#: Shingles and texts of a block: what one task compares with as many others at once.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 19, 1024
#: Shingles laid out as columns at once when a block is compared.
COLUMNS = 2048
#: Bit maps of rows that are broadcast at the most: 32 MB, for 268 million rows.
MAPS = 8192
ORDERS = np.random.default_rng(SEED).integers(1, 1 << 63, PRINTS, np.uint64)


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(shingles(raw, words))


def sampled(found: np.ndarray) -> np.ndarray:
    """The distinct fingerprints of the samples of a shingle set: bits set in over half of a sample."""
    if len(found) <= SAMPLE:
        samples = found[None]
    else:
        picked = []
        for orders in np.array_split(ORDERS, 1 if len(found) < VOTES else PRINTS):
            mixed = (found[None] ^ orders[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            picked.append(found[np.argpartition(mixed, SAMPLE - 1, axis=1)[:, :SAMPLE]])
        samples = np.concatenate(picked)
    bits = np.unpackbits(np.ascontiguousarray(samples).view(np.uint8).reshape(*samples.shape, 8), axis=2, bitorder="little")
    return np.unique(np.packbits(bits.sum(axis=1) * 2 > samples.shape[1], axis=1, bitorder="little").view("<u8"))


def shingled(docs: DataFrame, words: int) -> DataFrame:
    """docs -> a numbered row each: row, doc (the document), u1 and u2 (a digest of its shingle set), n
    (its size), cells (its samples' fingerprints) and fp (the whole text's)."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one, two, sizes, cells_, fps = [], [], [], [], []
        for raw in common.texts(pa.RecordBatch.from_struct_array(batch.column("doc"))):
            found = shingle_set(raw, words)
            both = xxhash.xxh3_128_intdigest(found.tobytes())
            one.append(signed(both >> 64))
            two.append(signed(both & (1 << 64) - 1))
            sizes.append(len(found))
            cells_.append(sampled(found).view(np.int64))
            fps.append(signed(fingerprint(raw)))
        columns = [batch.column("doc"), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cells_, pa.list_(pa.int64())), pa.array(fps, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "u1", "u2", "n", "cells", "fp"])

    found = common.map_arrow(whole, run, common.extended(whole.schema, "u1 long, u2 long, n long, cells array<long>, fp long"))
    return common.written(found.withColumn("row", F.monotonically_increasing_id()), "shingled", keep=True)


def picked(every: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``shingled`` whose number is in rows (row): by a bit map for each 32768 numbers. Up to
    MAPS of them (4 KB each) are broadcast, so that texts are not shuffled; more are joined."""
    place = F.col("row").bitwiseAND(32767)
    maps = common.written(rows.groupBy(F.shiftright("row", 15).alias("part")).agg(F.bitmap_construct_agg(place).alias("bits")), "picked", keep=True)
    sent = F.broadcast(maps) if maps.count() <= MAPS else maps
    return every.withColumn("part", F.shiftright("row", 15)).join(sent, "part").where(common.bit_at("bits", place)).drop("part", "bits")


def texts_of(every: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows named by ids (id)."""
    return picked(every.select("row", F.col("doc.text").alias("text")), ids.select(F.col("id").alias("row"))).select(F.col("row").alias("id"), "text")


def common_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left x right sets, exactly."""
    out = np.zeros((len(left), len(right)), np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[column] > 1)
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[part], column[part] - at] = 1
        out += held[left] @ held[right].T
    return out


def bridges(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of roots that similar pairs of left x right join, as few as connect the same."""
    sizes = np.array([len(x) for x in sets], np.float32)
    shared = common_shingles(sets, left, right)
    close = shared >= similarity * (sizes[left][:, None] + sizes[right][None] - shared) - 1e-4
    i, j = np.nonzero(close & (roots[left][:, None] != roots[right][None]))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in np.unique(np.stack([roots[left[i]], roots[right[j]]], axis=1), axis=0).tolist():
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b)))
    return out


def crowded_links(members: DataFrame, every: DataFrame, words: int, similarity: float) -> DataFrame:
    """(cell, id, n, root) -> links (a, b) of roots: with them, similar texts of a cell are connected."""
    several = members.groupBy("cell").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("same")
    )
    # Cells of two have been compared; cells of the same members are compared once.
    several = several.where("lo < hi and m > 2").groupBy("m", "same", "lo", "hi").agg(F.min("cell").alias("cell")).select("cell")
    members = common.written(members.join(several, "cell", "left_semi"), "crowded-members")
    if members.isEmpty():
        return members.select(F.col("root").alias("a"), F.col("root").alias("b"))
    # A component of more than a block has blocks of its own, the others of a cell share theirs.
    sizes = members.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_SHINGLES, F.col("m") / BLOCK_TEXTS, F.lit(1)))
    sizes = common.written(sizes.withColumn("parts", parts), "crowded-sizes")
    rest = sizes.where("parts = 1").groupBy("cell").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).withColumn("parts", parts).select("cell", "parts")
    large = sizes.where("parts > 1").select("cell", "root", "parts")
    block = F.struct("own", F.pmod(F.xxhash64("id", "cell"), F.col("parts")).alias("k"))
    own = lambda large_, root: F.struct(F.lit(large_).alias("large"), root.alias("root"))
    inside = members.join(large, ["cell", "root"]).withColumn("own", own(True, F.col("root")))
    mixed = members.join(large.select("cell", "root"), ["cell", "root"], "left_anti").join(rest, "cell").withColumn("own", own(False, F.lit(0).cast("long")))
    placed = common.written(inside.select("cell", "id", "root", block.alias("block")).unionByName(mixed.select("cell", "id", "root", block.alias("block"))), "crowded-blocks")
    blocks = placed.select("cell", "block").distinct()
    x, y = blocks.withColumnRenamed("block", "x"), blocks.withColumnRenamed("block", "y")
    tasks = x.join(y, "cell").where("x <= y and not (x.own.large and x.own = y.own)")
    tasks = tasks.select("cell", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    texts = texts_of(every, members.select("id"))
    work = placed.join(tasks, ["cell", "block"]).join(texts, "id")
    work = work.select(F.xxhash64("cell", "x", "y").alias("task"), "root", "text", (F.col("block") == F.col("x")).alias("in_x"), (F.col("block") == F.col("y")).alias("in_y"))

    def compare(table: pa.Table) -> pa.Table:
        sets = [shingle_set(raw, words) for batch in table.to_batches() for raw in common.texts(batch)]
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("in_x", "in_y"))
        found = bridges(sets, table.column("root").to_numpy(), left, right, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return work.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, every: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose texts are similar."""
    pairs = common.written(pairs, "pairs")
    texts = common.written(texts_of(every, pairs.select(F.explode(F.array("a", "b")).alias("id"))), "pair-texts")
    named = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit, last, held = [], None, np.empty(0, np.uint64)
        for i, (a, b) in enumerate(zip(common.texts(batch, "text_a"), common.texts(batch, "text_b"), strict=True)):
            if i == 0 or a != last:
                last, held = a, shingle_set(a, words)
            other = shingle_set(b, words)
            shared = len(np.intersect1d(held, other, assume_unique=True))
            if shared >= similarity * (len(held) + len(other) - shared) - 1e-9:
                hit.append(i)
        if hit:
            yield batch.select(["a", "b"]).take(pa.array(hit))

    both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "text_a", "text_b")
    return common.written(common.map_arrow(both, near, "a long, b long"), "links")


def rooted(nodes: DataFrame, links_: DataFrame) -> DataFrame:
    """Rows (id, root) of all nodes (id): the smallest that its links reach."""
    if links_.isEmpty():
        return nodes.select("id", F.col("id").alias("root"))
    linked = components(links_).withColumnRenamed("node", "id")
    return common.written(nodes.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "rooted")


def star_links(members: DataFrame, every: DataFrame, words: int, similarity: float) -> DataFrame:
    """(cell, id, n, rep) -> links (a, b) of each cell's smallest member and those similar to it, as many
    as connect the same: a text is first verified against the smallest of all its cells, and then only
    against those of cells that this has left apart."""
    ratio = F.least("n", "rep.n") >= similarity * F.greatest("n", "rep.n") - 1e-9
    pairs = members.where((F.col("id") != F.col("rep.id")) & ratio).select(F.col("rep.id").alias("a"), F.col("id").alias("b"))
    first = verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), every, words, similarity)
    roots = rooted(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), first)
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").select("a", "b")
    return first.unionByName(verified(apart, every, words, similarity))


def print_links(every: DataFrame, first: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of shingle sets (u1, u2, id) that connect those whose texts' fingerprints ``classes`` connects."""
    prints = every.select("u1", "u2", "fp").distinct().join(first.select("u1", "u2", "id"), ["u1", "u2"])
    found = classes(common.written(prints.select(F.col("id").alias("doc_id"), "fp"), "prints"), radius)
    return found.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))


def grouped(docs: DataFrame, words: int, similarity: float, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs -> their numbered rows (see ``shingled``), and (u1, u2, least) by shingle set: the doc_id and
    the row of the smallest document that its group reaches. With a radius, fingerprints of whole texts
    within it are links too."""
    with common.scratch_scope(docs.sparkSession):
        every = shingled(docs, words)
        least = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.col("row"))
        first = every.groupBy("u1", "u2").agg(F.min("row").alias("id"), F.min(least).alias("least"), F.min_by(F.struct("n", "cells"), "row").alias("s"))
        first = common.written(first.select("u1", "u2", "id", "least", "s.n", "s.cells"), "distinct-sets")
        grid = first.select("id", "n", F.explode("cells").alias("cell"))
        reps = grid.groupBy("cell").agg(F.min(F.struct("id", "n")).alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
        members = common.written(grid.join(common.written(reps, "shared-cells"), "cell"), "members")
        near = star_links(members, every, words, similarity)
        if radius is not None:
            near = common.written(near.unionByName(print_links(every, first, radius)).distinct(), "near")
        roots = rooted(first.select("id"), near)
        more = crowded_links(members.where("m > 2").select("cell", "id", "n").join(roots, "id"), every, words, similarity)
        more = common.written(more, "crowded-links")
        if not more.isEmpty():
            top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = roots.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        named = first.select("u1", "u2", "id", "least").join(roots, "id")
        smallest = named.groupBy("root").agg(F.min("least").alias("least"))
        return every, common.written(named.drop("least").join(smallest, "root").select("u1", "u2", "least"), "classes", keep=True)


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs -> (doc_id, component_id): texts linked whose shingle sets have this Jaccard similarity at least."""
    every, classes_ = grouped(docs, words, similarity)
    return every.select("u1", "u2", F.col("doc.doc_id").alias("doc_id")).join(classes_, ["u1", "u2"]).select("doc_id", F.col("least.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id: texts link if ``near_duplicates`` links
    them, and also if their shingle sets are similar."""
    every, classes_ = grouped(docs, words, similarity, radius)
    return picked(every.select("row", "doc"), classes_.select("least.row").distinct()).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
