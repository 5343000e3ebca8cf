"""Spatial operators on points (id, x, y[, z]): cells, nearest neighbours, hull, forces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import positioned
from ..plans.scratch import scratch_scope, written
from ..plans.shipping import ship
from ..plans.sizing import partitions


def bounding_box(points: DataFrame, d: int = 2) -> DataFrame:
    """Least and largest coordinates, centre, and the largest side."""
    axes = "xyz"[:d]
    box = points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])
    sides = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]
    return box.select("*", *[((F.col(f"max_{a}") + F.col(f"min_{a}")) / 2).alias(f"centre_{a}") for a in axes], F.greatest(*sides).alias("side"))


def centre_of_mass(points: DataFrame, d: int = 3) -> DataFrame:
    mass = F.sum("mass")
    return points.agg(mass.alias("mass"), *[(F.sum(F.col("mass") * F.col(a)) / mass).alias(a) for a in "xyz"[:d]])


def boxed(points: DataFrame, d: int) -> tuple[list[float], float]:
    row = bounding_box(points, d).first()
    if row is None or row.side is None:
        return [0.0] * d, 1.0
    return [row[f"min_{a}"] for a in "xyz"[:d]], row.side or 1.0


# Trees


def coded(points: DataFrame, depth: int, d: int = 2) -> DataFrame:
    """points with ``code``: the path of quadrants from the root, d bits a level; bit set where a
    coordinate lies in the upper half."""
    low, side = boxed(points, d)
    steps = 1 << depth
    code = F.lit(0).cast("long")
    for bit, axis in enumerate("xyz"[:d]):
        cell = F.least(F.floor((F.col(axis) - low[bit]) / side * steps).cast("long"), F.lit(steps - 1))
        for level in range(depth):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(cell, level).bitwiseAND(1), d * level + bit))
    return points.withColumn("code", code)


def tree(points: DataFrame, depth: int = 12, most: int = 16, d: int = 2) -> DataFrame:
    """Nodes (level, prefix, n, leaf): cells split while they hold more than ``most`` points.

    All levels come from one aggregation of codes; a node exists if its parent is split.
    """
    cells = written(coded(points, depth, d).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "cells")
    levels = cells.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "code", "n")
    prefix = F.call_function("shiftright", F.col("code"), (d * (depth - F.col("level"))).cast("int"))
    nodes = written(levels.select("level", prefix.alias("prefix"), "n").groupBy("level", "prefix").agg(F.sum("n").alias("n")), "nodes")
    parents = nodes.where(F.col("n") > most).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("up"))
    live = nodes.withColumn("up", F.shiftright("prefix", d)).join(parents, ["level", "up"], "left_semi").drop("up")
    root = nodes.where("level = 0")
    return root.unionByName(live.select(*root.columns)).withColumn("leaf", (F.col("n") <= most) | (F.col("level") == depth))


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.max("level").alias("depth"), F.sum(F.when(F.col("leaf"), F.col("n"))).alias("size"), F.count_if("leaf").alias("leaves"))


def flattened(points: DataFrame, depth: int = 12, d: int = 2) -> DataFrame:
    """Points in order of leaves."""
    return positioned(coded(points, depth, d).select("id", "code"), "code", "id").select("pos", "id")


# Nearest neighbours


def distance2(d: int) -> Column:
    total = F.lit(0.0)
    for a in "xyz"[:d]:
        total = total + (F.col(f"q.{a}") - F.col(f"p.{a}")) * (F.col(f"q.{a}") - F.col(f"p.{a}"))
    return total


#: Pairs of near points for a task.
PAIRS = 1_000_000


def nearest(queries: DataFrame, points: DataFrame, k: int, d: int = 2, per_cell: int = 4, rounds: int = 24) -> DataFrame:
    """Exact k nearest points of each query, itself (by id) excluded: (id, rank, ngh, dist2).

    Queries meet the points of their own and the adjacent cells of a grid. A query is done once its k-th
    distance is within the cell's width; the rest goes on with cells of twice the width. Ties go to the
    smaller id. With fewer than k points, a query has fewer rows.
    """
    points = written(points.select("id", *"xyz"[:d]), "points")
    total = points.count()
    if total == 0:
        return queries.select("id").limit(0).select("id", F.lit(0).alias("rank"), F.col("id").alias("ngh"), F.lit(0.0).alias("dist2"))
    low, side = boxed(points, d)
    width = side / max(1.0, (total / per_cell) ** (1 / d))
    open_, done = written(queries.select("id", *"xyz"[:d]), "queries"), []
    for _ in range(rounds):
        cell = [F.floor((F.col(a) - low[i]) / width).cast("long").alias(f"c{a}") for i, a in enumerate("xyz"[:d])]
        near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
        around = open_.select(F.struct("id", *"xyz"[:d]).alias("p"), *cell)
        for a in "xyz"[:d]:
            around = around.withColumn("_o", F.explode(near)).withColumn(f"c{a}", F.col(f"c{a}") + F.col("_o")).drop("_o")
        held = points.select(F.struct("id", *"xyz"[:d]).alias("q"), *cell)
        # A part of the cells has about PAIRS pairs, which its task sorts; crowded cells are met from all sides.
        cells = [f"c{a}" for a in "xyz"[:d]]
        crowds = open_.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).join(points.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")), cells)
        met = crowds.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        parts = max(partitions(points.sparkSession), -(-met * 3**d // PAIRS))
        pairs = around.repartition(parts, *cells).join(held.repartition(parts, *cells), cells).where("p.id <> q.id").select(F.col("p.id").alias("id"), F.struct(distance2(d).alias("dist2"), F.col("q.id").alias("ngh")).alias("n"))
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("n"))).where(F.col("rank") <= k)
        best = written(best.select("id", "rank", "n.ngh", "n.dist2"), "nearest")
        whole = width >= 2 * side + 1e-300 or 3 * width > 4 * side
        sure = best.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.max("dist2").alias("far")).where((F.col("c") >= min(k, total - 1)) & (F.col("far") <= width * width)).select("id")
        sure = open_.select("id") if whole else sure
        sure = written(sure.distinct(), "settled")
        done.append(best.join(sure, "id", "left_semi"))
        open_ = written(open_.join(sure, "id", "left_anti"), "queries")
        if open_.isEmpty():
            break
        width *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


# Hull


def local_hull(xs: np.ndarray, ys: np.ndarray) -> list[int]:
    """Indices of the strict hull, from the leftmost point over the upper chain to the right, and back."""
    order = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
    unique = [i for n, i in enumerate(order) if n == 0 or (xs[i], ys[i]) != (xs[order[n - 1]], ys[order[n - 1]])]

    def chain(indices):
        out: list[int] = []
        for i in indices:
            while len(out) > 1 and (xs[out[-1]] - xs[out[-2]]) * (ys[i] - ys[out[-2]]) - (ys[out[-1]] - ys[out[-2]]) * (xs[i] - xs[out[-2]]) >= 0:
                out.pop()
            out.append(i)
        return out

    if len(unique) < 3:
        return unique
    upper, lower = chain(unique), chain(unique[::-1])
    return upper[:-1] + lower[:-1]


DIRECTIONS, MERGED = 64, 8


def hull(points: DataFrame) -> DataFrame:
    """(pos, id): clockwise from the leftmost point; collinear points are dropped.

    Points strictly inside of the polygon of the extreme points in DIRECTIONS directions can't be on
    the hull. What is left goes to a hull per partition, in rounds, until one task can finish.
    """
    ship(points.sparkSession)
    angles = [2 * math.pi * i / DIRECTIONS for i in range(DIRECTIONS)]
    extreme = points.agg(*[F.max_by(F.struct("x", "y"), F.col("x") * math.cos(a) + F.col("y") * math.sin(a)).alias(f"e{i}") for i, a in enumerate(angles)]).first()
    corners = [(extreme[i].x, extreme[i].y) for i in range(DIRECTIONS) if extreme[i] is not None]
    polygon = [corners[i] for i in local_hull(np.array([c[0] for c in corners]), np.array([c[1] for c in corners]))] if corners else []
    left = points
    if len(polygon) > 2:
        inside = F.lit(True)
        for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            inside = inside & ((bx - ax) * (F.col("y") - ay) - (by - ay) * (F.col("x") - ax) < -1e-9 * (abs(bx - ax) + abs(by - ay)))
        left = points.where(~inside)

    def shrink(batches):
        frames = [f for f in batches if len(f)]
        if frames:
            held = pd.concat(frames).sort_values("id").reset_index(drop=True)
            yield held.iloc[local_hull(held["x"].to_numpy(), held["y"].to_numpy())]

    # A hull has far fewer points than the input unless all are on it; each round merges MERGED partitions.
    schema, parts = "id long, x double, y double", None
    with scratch_scope(points.sparkSession):
        left = left.select("id", "x", "y")
        while parts is None or parts > MERGED:
            left = left if parts is None else left.coalesce(-(-parts // MERGED))
            left = written(left.mapInPandas(shrink, schema), "hull")
            parts = left.rdd.getNumPartitions()
        left = written(left, "hull", keep=True)

    def finish(batches):
        frames = [f for f in batches if len(f)]
        if frames:
            held = pd.concat(frames).sort_values("id").reset_index(drop=True)
            ring = held.iloc[local_hull(held["x"].to_numpy(), held["y"].to_numpy())]
            yield pd.DataFrame({"pos": range(len(ring)), "id": ring["id"].to_numpy()})

    return left.coalesce(1).mapInPandas(finish, "pos long, id long")


# Forces


#: Particles of a block, blocks that meet in a task on each side, and pairs that are worked on at once.
BODIES, MET, TILE = 4096, 8, 1 << 16


def block_forces(own: dict[str, np.ndarray], other: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forces (n, 3) of the other particles on one's own; which of these have a partner, and one of known mass."""
    n, rows = len(own["id"]), max(1, TILE // len(other["id"]))
    out, met, known = np.zeros((n, 3)), np.zeros(n, bool), np.zeros(n, bool)
    weighed = ~np.isnan(other["mass"])
    mass = np.where(weighed, other["mass"], 0.0)
    for a in range(0, n, rows):
        here = slice(a, a + rows)
        v = [other[c][None, :] - own[c][here, None] for c in "xyz"]
        r2 = v[0] * v[0]
        r2 += v[1] * v[1]
        r2 += v[2] * v[2]
        pair = ~(r2 <= 0)
        pair &= other["id"][None, :] != own["id"][here, None]
        if not pair.all():
            r2[~pair] = np.inf
        r2 *= np.sqrt(r2)
        size = np.divide(own["mass"][here, None] * mass[None, :], r2, out=r2)
        for i in range(3):
            out[here, i] = np.einsum("ij,ij->i", v[i], size)
        met[here] = pair.any(axis=1)
        known[here] = met[here] if weighed.all() else (pair & weighed).any(axis=1)
    return out, met, known


def exact_forces(particles: DataFrame) -> DataFrame:
    """(id, fx, fy, fz) by all pairs, for checking others: quadratic work, by pairs of blocks.

    A task has some blocks on both sides and one pair of them in memory, whatever the number of particles.
    Particles without a place have no pairs, those without a mass no known force.
    """
    spark, fields = particles.sparkSession, ("id", "x", "y", "z", "mass")
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)  # a row holds two blocks
    kind = particles.schema["id"].dataType.simpleString()
    placed = positioned(particles.select("id", *[F.col(c).cast("double").alias(c) for c in fields[1:]]).where("id is not null and x is not null and y is not null and z is not null"), "id")
    blocks = placed.groupBy(F.floor(F.col("pos") / BODIES).cast("long").alias("block")).agg(F.collect_list(F.struct(*fields)).alias("of"))
    blocks = written(blocks.select("block", *[F.col(f"of.{c}").alias(c) for c in fields]), "blocks")
    total = blocks.count()
    parts = max(1, min(total, 4), -(-total // MET))
    dealt = blocks.repartitionByRange(parts, "block")

    def particles_of(batch: pa.RecordBatch, side: str, row: int) -> dict[str, np.ndarray]:
        return {c: batch.column(side + c)[row].values.to_numpy(zero_copy_only=False) for c in fields}

    def forces(block: tuple) -> pa.RecordBatch:
        _, own, force, met, known = block
        known = known & ~np.isnan(own["mass"])
        return pa.RecordBatch.from_arrays([pa.array(own["id"][met]), *[pa.array(force[met, i], mask=~known[met]) for i in range(3)]], names=["id", "fx", "fy", "fz"])

    def run(batches):
        held = None  # pairs of a block come one after the other
        for batch in batches:
            for row in range(batch.num_rows):
                block, own = batch.column("block")[row].as_py(), particles_of(batch, "", row)
                more = block_forces(own, particles_of(batch, "o_", row))
                if held is not None and held[0] == block:
                    held = (block, own, held[2] + more[0], held[3] | more[1], held[4] | more[2])
                else:
                    if held is not None:
                        yield forces(held)
                    held = (block, own, *more)
        if held is not None:
            yield forces(held)

    others = dealt.select(*[F.col(c).alias(f"o_{c}") for c in fields]).hint("shuffle_replicate_nl")
    parted = dealt.crossJoin(others).mapInArrow(run, f"id {kind}, fx double, fy double, fz double")
    return parted.groupBy("id").agg(*[F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"])


def mass_cells(bodies: DataFrame, depth: int, most: int) -> DataFrame:
    """Bodies with codes -> cells (level, prefix, mass, cx, cy, cz, leaf): masses and their centres."""
    axes = "xyz"
    sums = [F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), *[F.sum(F.col("mass") * F.col(a)).alias(f"m{a}") for a in axes]]
    cells = bodies.groupBy("code").agg(*sums)
    levels = cells.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "code", "n", "mass", *[f"m{a}" for a in axes])
    prefix = F.call_function("shiftright", F.col("code"), (3 * (depth - F.col("level"))).cast("int"))
    nodes = levels.groupBy("level", prefix.alias("prefix")).agg(*[F.sum(c).alias(c) for c in ("n", "mass", *[f"m{a}" for a in axes])])
    leaf = (F.col("n") <= most) | (F.col("level") == depth)
    return nodes.select("level", "prefix", "mass", *[(F.col(f"m{a}") / F.col("mass")).alias(f"c{a}") for a in axes], leaf.alias("leaf"))


def barnes_hut(particles: DataFrame, alpha: float = 1.0, depth: int = 10, most: int = 16) -> DataFrame:
    """(id, fx, fy, fz, direct, far): forces by cells of an octree.

    All particles go down the tree together, a join a level: a cell farther than alpha times its side acts
    as one mass, the particles of a near leaf act one by one, other cells give way to their children.
    """
    with scratch_scope(particles.sparkSession):
        low, side = boxed(particles, 3)
        bodies = written(coded(particles.select("id", "x", "y", "z", "mass"), depth, 3), "bodies")
        nodes = written(mass_cells(bodies, depth, most), "mass-cells")
        others = bodies.select("code", *[F.col(c).alias(f"o_{c}") for c in ("id", "x", "y", "z", "mass")])
        open_ = bodies.select("id", "x", "y", "z", "mass", F.lit(0).cast("long").alias("prefix"))
        found = [bodies.select("id", *[F.lit(0.0).alias(f"f{a}") for a in "xyz"], F.lit(0).cast("long").alias("direct"), F.lit(0).cast("long").alias("far"))]
        for level in range(depth + 1):
            here = nodes.where(F.col("level") == level).select("prefix", F.col("mass").alias("m"), "cx", "cy", "cz", "leaf")
            v = [F.col(f"c{a}") - F.col(a) for a in "xyz"]
            r2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
            met = written(open_.join(here, "prefix").withColumn("r2", r2).withColumn("is_far", F.col("r2") > alpha * alpha * (side / (1 << level)) ** 2), "met")
            pull = F.col("mass") * F.col("m") / (F.col("r2") * F.sqrt("r2"))
            whole = met.where("is_far").groupBy("id").agg(*[F.sum(x * pull).alias(f"f{a}") for x, a in zip(v, "xyz", strict=True)], F.count(F.lit(1)).alias("far"))
            found.append(written(whole.select("id", "fx", "fy", "fz", F.lit(0).cast("long").alias("direct"), "far"), "far"))
            inside = others.withColumn("prefix", F.shiftright("code", 3 * (depth - level)))
            pairs = met.where("not is_far and leaf").select("prefix", "id", "x", "y", "z", "mass").join(inside, "prefix").where("id <> o_id")
            w = [F.col(f"o_{a}") - F.col(a) for a in "xyz"]
            pairs = pairs.withColumn("r2", w[0] * w[0] + w[1] * w[1] + w[2] * w[2]).where("r2 > 0")
            pull = F.col("mass") * F.col("o_mass") / (F.col("r2") * F.sqrt("r2"))
            near = pairs.groupBy("id").agg(*[F.sum(x * pull).alias(f"f{a}") for x, a in zip(w, "xyz", strict=True)], F.count(F.lit(1)).alias("direct"))
            found.append(written(near.select("id", "fx", "fy", "fz", "direct", F.lit(0).cast("long").alias("far")), "near"))
            below = met.where("not is_far and not leaf")
            if below.isEmpty():
                break
            child = F.explode(F.array(*[F.col("prefix") * 8 + q for q in range(8)]))
            open_ = below.select("id", "x", "y", "z", "mass", child.alias("prefix"))
        every = found[0]
        for part in found[1:]:
            every = every.unionByName(part)
        sums = every.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("fx", "fy", "fz", "direct", "far")])
        return written(sums, "forces", keep=True)


def force_error(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean relative error."""
    both = approximate.join(exact.select("id", *[F.col(f"f{a}").alias(f"e{a}") for a in "xyz"]), "id")
    off = sum(((F.col(f"f{a}") - F.col(f"e{a}")) * (F.col(f"f{a}") - F.col(f"e{a}")) for a in "xyz"), F.lit(0.0))
    size = sum((F.col(f"e{a}") * F.col(f"e{a}") for a in "xyz"), F.lit(0.0))
    return both.agg(F.avg(F.sqrt(off / size)).alias("error"))


# Multipoles


def multipole(points: np.ndarray, mass: np.ndarray, centre: np.ndarray, terms: int) -> np.ndarray:
    """Moments of a set of masses about a centre, by spherical harmonics up to ``terms`` degrees."""
    return (mass[:, None] * np.conj(harmonics(points - centre, terms)[0])).sum(axis=0)


def harmonics(v: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Regular and irregular solid harmonics of vectors, flat over (l, m), m = -l .. l."""
    r = np.sqrt((v * v).sum(axis=1))
    cos = np.divide(v[:, 2], r, out=np.ones_like(r), where=r > 0)
    phi = np.arctan2(v[:, 1], v[:, 0])
    sin = np.sqrt(np.maximum(0, 1 - cos * cos))
    legendre = {(0, 0): np.ones_like(r)}
    for m in range(1, terms):
        legendre[m, m] = -(2 * m - 1) * sin * legendre[m - 1, m - 1]
    for m in range(terms):
        for l in range(m + 1, terms):
            legendre[l, m] = ((2 * l - 1) * cos * legendre[l - 1, m] - (l + m - 1) * legendre.get((l - 2, m), 0)) / (l - m)
    regular, irregular = [], []
    safe = np.where(r > 0, r, 1)
    for l in range(terms):
        for m in range(-l, l + 1):
            k = abs(m)
            norm = math.sqrt(math.factorial(l - k) / math.factorial(l + k))
            y = norm * legendre[l, k] * np.exp(1j * k * phi)
            y = y if m >= 0 else (-1) ** k * np.conj(y)
            regular.append(y * r**l)
            irregular.append(y / safe ** (l + 1))
    return np.stack(regular, axis=1), np.stack(irregular, axis=1)


def multipole_potential(moments: np.ndarray, points: np.ndarray, centre: np.ndarray, terms: int) -> np.ndarray:
    """Potential, sum of m / r, of far points by the moments."""
    return (harmonics(points - centre, terms)[1] * moments).sum(axis=1).real


def scales(terms: int) -> np.ndarray:
    """sqrt((l - m)! (l + m)!) over (l, m): harmonics over these add up without further weights."""
    return np.array([math.sqrt(math.factorial(l - m) * math.factorial(l + m)) for l in range(terms) for m in range(-l, l + 1)])


def degrees_of(terms: int) -> list[tuple[int, int]]:
    return [(l, m) for l in range(terms) for m in range(-l, l + 1)]


def moved_moments(moments: np.ndarray, shift: np.ndarray, terms: int) -> np.ndarray:
    """Moments about a centre -> about another one; ``shift`` leads from the other one to the first."""
    s = scales(terms)
    inner, step = moments / s, np.conj(harmonics(shift[None], terms)[0][0]) / s
    out = np.zeros(len(s), complex)
    for i, (l, m) in enumerate(degrees_of(terms)):
        for j, (k, q) in enumerate(degrees_of(l + 1)):
            if abs(m - q) <= l - k:
                out[i] += inner[j] * step[(l - k) ** 2 + (l - k) + (m - q)]
    return out * s


def local_expansion(moments: np.ndarray, shift: np.ndarray, terms: int) -> np.ndarray:
    """Moments about a centre -> expansion about a far point, ``shift`` from that centre."""
    s = scales(terms)
    wide = 2 * terms - 1
    outer = harmonics(shift[None], wide)[1][0] * scales(wide)
    out = np.zeros(len(s), complex)
    for i, (k, q) in enumerate(degrees_of(terms)):
        for j, (l, m) in enumerate(degrees_of(terms)):
            n = l + k
            out[i] += (-1) ** k * moments[j] / s[j] * outer[n * n + n + m + q]
    return out


def moved_expansion(local: np.ndarray, shift: np.ndarray, terms: int) -> np.ndarray:
    """An expansion about a point -> about another one, ``shift`` from it."""
    step = np.conj(harmonics(shift[None], terms)[0][0]) / scales(terms)
    out = np.zeros(len(local), complex)
    for j, (k, q) in enumerate(degrees_of(terms)):
        for i, (a, b) in enumerate(degrees_of(k + 1)):
            if abs(q - b) <= k - a:
                out[i] += local[j] * step[(k - a) ** 2 + (k - a) + (q - b)]
    return out


def local_potential(local: np.ndarray, points: np.ndarray, centre: np.ndarray, terms: int) -> np.ndarray:
    """Potential of points by the expansion about a centre near them."""
    return (np.conj(harmonics(points - centre, terms)[0]) / scales(terms) * local).sum(axis=1).real


def cell_moments(particles: DataFrame, terms: int = 4, depth: int = 2) -> DataFrame:
    """Moments per cell of a grid about the cell's centre of mass: code, n, centre, and re, im over (l, m)."""
    ship(particles.sparkSession)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        points, mass = frame[["x", "y", "z"]].to_numpy(float), frame["mass"].to_numpy(float)
        centre = (points * mass[:, None]).sum(axis=0) / mass.sum()
        moments = multipole(points, mass, centre, terms)
        return pd.DataFrame({"code": [key[0]], "n": [len(frame)], "centre": [centre.tolist()], "re": [moments.real.tolist()], "im": [moments.imag.tolist()]})

    coded_ = coded(particles, depth, 3).select("code", "id", "x", "y", "z", "mass")
    return coded_.groupBy("code").applyInPandas(run, "code long, n long, centre array<double>, re array<double>, im array<double>")


def whole_moments(particles: DataFrame, terms: int = 4, depth: int = 2) -> DataFrame:
    """(k, re, im): moments of all particles about the middle of their box, where those of its cells are moved."""
    low, side = boxed(particles, 3)
    middle = np.array(low) + side / 2

    def run(batches):
        for frame in batches:
            moved = [moved_moments(np.array(re) + 1j * np.array(im), np.array(c) - middle, terms) for c, re, im in zip(frame["centre"], frame["re"], frame["im"], strict=True)]
            if moved:
                total = np.sum(moved, axis=0)
                yield pd.DataFrame({"k": range(len(total)), "re": total.real, "im": total.imag})

    cells = cell_moments(particles, terms, depth).select("centre", "re", "im")
    return cells.mapInPandas(run, "k long, re double, im double").groupBy("k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def far_potential(sources: DataFrame, targets: DataFrame, terms: int = 6, depth: int = 2) -> DataFrame:
    """(id, potential) of targets (id, x, y, z) far from the sources' box: the sources' moments become one
    expansion about the targets' middle, moved to each target's cell and evaluated there.

    Only the moments, terms * terms numbers, pass the driver.
    """
    ship(targets.sparkSession)
    low, side = boxed(sources, 3)
    to, width = boxed(targets, 3)
    moments = np.zeros(terms * terms, complex)
    for row in whole_moments(sources, terms, depth).collect():
        moments[row.k] = row.re + 1j * row.im
    middle, cell = np.array(to) + width / 2, width / (1 << depth)
    local = local_expansion(moments, middle - (np.array(low) + side / 2), terms)

    def run(batches):
        for frame in batches:
            points = frame[["x", "y", "z"]].to_numpy(float)
            place = np.minimum(np.floor((points - np.array(to)) / cell), (1 << depth) - 1) if cell else np.zeros_like(points)
            out = np.empty(len(points))
            for at in np.unique(place, axis=0):
                some, centre = (place == at).all(axis=1), np.array(to) + (at + 0.5) * cell
                out[some] = local_potential(moved_expansion(local, centre - middle, terms), points[some], centre, terms)
            yield pd.DataFrame({"id": frame["id"], "potential": out})

    return targets.select("id", "x", "y", "z").mapInPandas(run, "id long, potential double")
