"""Literal examples and brute-force checks of operators that SQL can't state."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordina.functions import hashing as H
from ordina.functions import scalars
from ordina.operators import arrays, buffers, containers, graph, spatial, telemetry
from ordina.plans import rounds
from ordina.plans import scan as plan
from ordina.sources import files, generators, graphs


def seq(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, v long")


def listed(df, column="v"):
    return [r[column] for r in df.orderBy("pos").collect()]


def test_literals(spark):
    assert listed(generators.tabulated(spark, 5, lambda i: i * 2)) == [0, 2, 4, 6, 8]
    assert listed(plan.scan(seq(spark, [2, 1, 8, 3]), "v"), "s") == [2, 3, 11, 14]
    assert listed(plan.scan(seq(spark, [2, 1, 8, 3]), "v", inclusive=False), "s") == [0, 2, 3, 11]
    assert listed(arrays.sliced(seq(spark, [1, 2, 3, 4, 5]), 1, 3)) == [2, 3]
    assert listed(arrays.concat(seq(spark, [1, 2, 3]), seq(spark, [4, 5]))) == [1, 2, 3, 4, 5]
    assert listed(arrays.filtered(seq(spark, [3, 5, 8, 12, 2, 13, 0]), lambda v: v % 2 == 0)) == [8, 12, 2, 0]
    flags = spark.createDataFrame(list(enumerate([True, False, False, True, False, True, True])), "pos long, flag boolean")
    assert listed(arrays.pack(flags, seq(spark, [34, 13, 5, 1, 41, 11, 10]))) == [34, 1, 11, 10]
    assert listed(arrays.merge(seq(spark, [5, 10, 13, 14]), seq(spark, [1, 8, 10, 100, 101]))) == [1, 5, 8, 10, 10, 13, 14, 100, 101]
    assert listed(arrays.merge(seq(spark, [4, 6]), seq(spark, [5, 5, 13, 21]))) == [4, 5, 5, 6, 13, 21]


@pytest.mark.parametrize(("values", "want"), [([-2, 1, -3, 4, -1, 2, 1, -5, 4], 6), ([-3, -1, -2], -1), ([], arrays.VALUE_MIN)])
def test_mcss(spark, values, want):
    assert arrays.mcss(seq(spark, values)).first().mcss == want


def test_scans_by_blocks(spark):
    rng = random.Random(3)
    values = [rng.randrange(-50, 50) for _ in range(300)]
    got = listed(plan.scan(seq(spark, values), "v", block=16), "s")
    assert got == np.cumsum(values).tolist()
    back = listed(plan.scan(seq(spark, values), "v", plan.MIN, back=True, block=7), "s")
    assert back == np.minimum.accumulate(values[::-1])[::-1].tolist()


def test_positions_with_ties(spark):
    values = [i % 3 for i in range(200)]
    assert listed(arrays.sort(seq(spark, values))) == sorted(values)
    stable = arrays.stable_sort(seq(spark, values).withColumn("item", F.col("pos")), "v").orderBy("pos").collect()
    assert [r.item for r in stable] == sorted(range(200), key=lambda i: (values[i], i))


@pytest.mark.parametrize(("text", "want"), [("(()())", True), ("())(", False), ("", True)])
def test_parens(spark, text, want):
    rows = [(i, 1 if c == "(" else -1) for i, c in enumerate(text)]
    assert scalars.matching(spark.createDataFrame(rows, "pos long, v long")).first().matching is want


def test_weighted_split(spark):
    words = ["Let's", "divide", "this", "sequence", "of", "strings", "into", "two", "pieces"]
    xs = spark.createDataFrame([(i, len(w)) for i, w in enumerate(words)], "pos long, v long")
    even = F.when(F.col("v") % 2 == 0, 1).otherwise(0)
    left, right = containers.split_by(xs, even, lambda m: m >= 3)
    assert (left.count(), right.count()) == (3, 6)


EDGES = [(0, 1), (0, 3), (5, 1), (3, 0), (3, 5), (3, 2), (5, 3), (4, 6), (6, 2)]


def test_search(spark):
    g = spark.createDataFrame(EDGES, "src long, dst long")
    by = lambda df, c: [r[c] for r in df.orderBy("vertex").collect()]
    assert by(graph.reachable(g, 7, 0), "visited") == [1, 1, 1, 1, 0, 1, 0]
    assert by(graph.reachable(g, 7, 4), "visited") == [0, 0, 1, 0, 1, 0, 1]
    assert by(graph.bfs_distances(g, 7, 0), "dist") == [0, 1, 2, 1, -1, 2, -1]
    new = graph.edge_map(g, spark.createDataFrame([(3,)], "id long"), spark.createDataFrame([(0,), (1,), (3,)], "id long"))
    assert {r.id for r in new.collect()} == {5, 2}


def reaching(n, edges):
    label = [-1] * n
    for s in range(n):
        if label[s] < 0:
            todo = [s]
            label[s] = s
            while todo:
                u = todo.pop()
                for a, b in edges:
                    if a == u and label[b] < 0:
                        label[b] = s
                        todo.append(b)
    return label


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(i, i + 1) for i in range(40, 59)]
    got = graph.components(spark.createDataFrame(edges, "src long, dst long"), 60).orderBy("vertex").collect()
    assert [r.label for r in got] == reaching(60, edges)


def local_edge(dim, degree, rows, k):
    i, h, power = k // degree, k, dim + 2
    while True:
        h = H.hash32_int(h) & 0x7FFFFFFF
        if dim:
            while h % 1000003 < 500001:
                power += dim
                h = H.hash32_int(h) & 0x7FFFFFFF
            h = H.hash32_int(h) & 0x7FFFFFFF
        j = (i + h % (1 << power)) % rows if dim else h % rows
        if j != i:
            return i, j


def test_generators(spark):
    n = 50
    now = list(range(n))
    for i in range(20):
        a, b = (H.hash64shift_int(k) % (1 << 64) % n for k in (2 * i, 2 * i + 1))
        now[a], now[b] = now[b], now[a]
    assert listed(generators.almost_sorted(spark, n, 20)) == now
    now = list(range(n))
    for i in range(3, 23):
        a, b = H.hash32_int(2 * i) % n, H.hash32_int(2 * i + 1) % n
        now[a], now[b] = now[b], now[a]
    assert listed(generators.almost_sorted_32(spark, 3, n, 20)) == now
    for n in (1, 2, 100):
        now = list(range(n))
        for i in range(n - 1, 0, -1):
            j = H.hash32_int(i) % (i + 1)
            now[i], now[j] = now[j], now[i]
        assert listed(generators.random_permutation(spark, n)) == now
    assert generators.random_permutation(spark, 0).count() == 0
    sphere = generators.points(spark, 200, lambda i: generators.in_sphere(i, 3)).toPandas()
    assert (sphere[["x", "y", "z"]] ** 2).sum(axis=1).max() <= 1
    ring = generators.points(spark, 200, generators.on_sphere).toPandas()
    assert np.allclose(ring.x**2 + ring.y**2, 1)
    for far in (generators.points(spark, 50, generators.kuzmin), generators.points(spark, 50, generators.plummer)):
        assert np.isfinite(far.toPandas().to_numpy()).all()
    for dim in (0, 10):
        local = {(r.src, r.dst, r.k) for r in graphs.random_local(spark, dim, 8, 30).withColumn("k", F.monotonically_increasing_id()).collect()}
        assert sorted((a, b) for a, b, _ in local) == sorted(local_edge(dim, 8, 30, k) for k in range(240))
    with pytest.raises(ValueError):
        graphs.random_local(spark, 10, 8, 1)
    assert graphs.chosen(spark, 60, 1).count() > 0
    relabelled = graphs.relabelled(graphs.chain(spark, 30), spark.range(31), 4).toPandas()
    assert sorted(set(relabelled.src) | set(relabelled.dst)) == list(range(31)) and relabelled.src.nunique() == 30


def test_hull_and_neighbours(spark):
    rng = np.random.default_rng(2)
    xy = np.round(rng.normal(size=(500, 2)), 2)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    ring = [r.id for r in spatial.hull(points).orderBy("pos").collect()]
    assert xy[ring[0], 0] == xy[:, 0].min()
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        d = xy[b] - xy[a]
        side = d[0] * (xy[:, 1] - xy[a, 1]) - d[1] * (xy[:, 0] - xy[a, 0])
        assert side.max() <= 1e-9
    got = spatial.nearest(points, points, 3).toPandas()
    dist = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    for i in range(0, 500, 29):
        want = sorted((dist[i, j], j) for j in range(500) if j != i)[:3]
        assert got[got.id == i].sort_values("rank").ngh.tolist() == [j for _, j in want]
    few = points.where("id < 3")
    assert spatial.nearest(few, few, 5).count() == 6


def test_hull_of_a_circle_in_rounds(spark, monkeypatch):
    # All points are on the hull, in more partitions than a round merges.
    monkeypatch.setattr(spatial, "MERGED", 2)
    n = 90
    ring = [(i, math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    points = spark.createDataFrame(ring + [(n + i, 0.0, 0.1 * i) for i in range(5)], "id long, x double, y double").repartition(7)
    got = [r.id for r in spatial.hull(points).orderBy("pos").collect()]
    assert got[0] == n // 2 and sorted(got) == list(range(n))
    assert all((a - b) % n == 1 for a, b in zip(got, got[1:]))


def test_range_sum(spark):
    values = [5, -2, 7, 0, 3]
    xs = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
    for lo, hi in ((0, 5), (0, 99), (1, 3), (2, 2), (4, 9), (5, 9), (7, 3)):
        assert containers.range_sum(xs, lo, hi).first().total == (sum(values[lo:hi]) if values[lo:hi] else None)


def test_components_equal_brute_force(spark):
    rnd = random.Random(6)
    n = 60
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(70)} | {(i, i + 1) for i in range(40, 59)}
    reach = [[i == j for j in range(n)] for i in range(n)]
    for i, j in edges:
        reach[i][j] = True
    for k in range(n):
        for i in range(n):
            if reach[i][k]:
                reach[i] = [a or b for a, b in zip(reach[i], reach[k])]
    got = {r.vertex: r.label for r in graph.components(spark.createDataFrame(sorted(edges), "src long, dst long"), n).collect()}
    assert got == {v: min(u for u in range(n) if reach[u][v]) for v in range(n)}


def test_folds_equal_loops(spark):
    rnd = random.Random(9)
    rows = [(f"e{rnd.randrange(3)}", rnd.randrange(2), i, rnd.uniform(0.01, 100)) for i in range(400)]
    table = spark.createDataFrame(rows, "estimator string, proc long, seq long, m double")
    want, shared = {}, {}
    for e, p, _, m in rows:
        want[e, p] = (8 * want[e, p] + m) / 9 if (e, p) in want else m
        shared.setdefault(e, []).append(m)
    got = {(r.estimator, r.proc): r.cst for r in telemetry.private_constants(table).collect()}
    assert got == pytest.approx(want)
    halved = {r.estimator: r.shared for r in telemetry.shared_constants(table.withColumnRenamed("m", "c")).collect()}
    assert halved == {e: telemetry.shared_constant(values) for e, values in shared.items()}


def test_mcss_over_blocks(spark):
    rnd = random.Random(3)
    for n in (1, 5, 23):
        for low in (-9, -20):
            values = [rnd.randrange(low, 10) for _ in range(n)]
            want = max(sum(values[i:j]) for i in range(n) for j in range(i + 1, n + 1))
            for block in (1, 3, 100):
                assert arrays.mcss(seq(spark, values), block).first().mcss == want


def test_user_folds(spark):
    # Joining strings does not commute; positions may have gaps.
    words = [(7 * i + i % 3, f"w{i}") for i in range(50)]
    xs = spark.createDataFrame(words, "pos long, v string").repartition(5)
    assert rounds.fold(xs, lambda a, b: a + b, "", "string", block=8).first().v == "".join(w for _, w in words)
    assert rounds.fold(xs.where("false"), lambda a, b: a + b, "none", "string").first().v == "none"


def test_worklist(spark):
    expand = lambda items: items.select((F.col("id") + 3).alias("id")).where("id < 100").unionByName(items.where("id = 1").select(F.lit(0).cast("long").alias("id")))
    got = {r.id: r["round"] for r in rounds.worklist(spark.createDataFrame([(1,), (1,)], "id long"), expand).collect()}
    assert got == {1 + 3 * k: k for k in range(33)} | {3 * k: k + 1 for k in range(34)}
    assert rounds.worklist(spark.range(0), expand).isEmpty()


def test_barnes_hut(spark):
    points = generators.points(spark, 120, generators.plummer).withColumn("mass", F.lit(1.0))
    near = spatial.barnes_hut(points)
    assert spatial.force_error(near, spatial.exact_forces(points)).first().error < 0.1
    counts = near.agg(F.sum("direct").alias("d"), F.sum("far").alias("f")).first()
    assert 0 < counts.d + counts.f <= 120 * 119


def test_multipoles():
    rng = np.random.default_rng(1)
    points, mass = rng.uniform(-0.5, 0.5, (40, 3)), rng.uniform(1, 2, 40)
    moments = spatial.multipole(points, mass, np.zeros(3), 8)
    far = np.array([[4.0, 1.0, -2.0], [-3.0, 3.0, 3.0]])
    exact = [(mass / np.sqrt(((points - p) ** 2).sum(axis=1))).sum() for p in far]
    assert np.allclose(spatial.multipole_potential(moments, far, np.zeros(3), 8), exact, rtol=1e-5)


def test_moved_multipoles(spark):
    rng = np.random.default_rng(3)
    points, mass = rng.uniform(-0.5, 0.5, (60, 3)), rng.uniform(1, 2, 60)
    far = rng.uniform(-0.5, 0.5, (20, 3)) + np.array([5.0, -4.0, 3.0])
    exact = [(mass / np.sqrt(((points - p) ** 2).sum(axis=1))).sum() for p in far]
    here, there = np.array([0.1, -0.2, 0.05]), np.zeros(3)
    moved = spatial.moved_moments(spatial.multipole(points, mass, here, 6), here - there, 6)
    assert np.allclose(moved, spatial.multipole(points, mass, there, 6))
    middle = np.array([5.0, -4.0, 3.0])
    local = spatial.local_expansion(moved, middle - there, 6)
    assert np.allclose(spatial.local_potential(local, far, middle, 6), exact, rtol=1e-4)
    beside = middle + 0.2
    assert np.allclose(spatial.local_potential(spatial.moved_expansion(local, beside - middle, 6), far, beside, 6), spatial.local_potential(local, far, middle, 6))
    sources = spark.createDataFrame([(i, *map(float, p), float(m)) for i, (p, m) in enumerate(zip(points, mass, strict=True))], "id long, x double, y double, z double, mass double")
    targets = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(far)], "id long, x double, y double, z double")
    got = {r.id: r.potential for r in spatial.far_potential(sources, targets).collect()}
    assert np.allclose([got[i] for i in range(20)], exact, rtol=1e-4)


def test_deep_search(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGED", 3)
    edges = graphs.chain(spark, 9).unionByName(spark.createDataFrame([(2, 0), (9, 1)], "src long, dst long"))
    got = {r.vertex: r.dist for r in graph.bfs_distances(edges, 12, 0).collect()}
    assert got == {v: v if v < 10 else -1 for v in range(12)}


def test_buffers(spark):
    made = lambda vs: spark.createDataFrame(list(enumerate(vs)), "pos long, v long")
    full = buffers.Buffer(made([1, 2, 3]), 4).push_back(9)
    assert listed(full.items) == [1, 2, 3, 9] and full.state().first().asDict() == {"size": 4, "empty": False, "full": True, "partial": False}
    for wrong in (lambda: full.push_front(0), lambda: full.popn_back(5), lambda: full.concat(full), lambda: full.put(4, 1), lambda: full.split(5)):
        with pytest.raises(ValueError):
            wrong()
    out, left = full.popn_back(3)
    assert listed(out) == [2, 3, 9] and listed(left.items) == [1]
    a, b = full.transfer_front_to_back(left, 2)
    assert listed(a.items) == [3, 9] and listed(b.items) == [1, 1, 2] and listed(a.put(0, 7).items) == [7, 9]
    none = buffers.Buffer(made([]), 2)
    assert none.state().first().empty and listed(none.pushn_front(made([5, 6])).items) == [5, 6]


def test_two_level_scans(spark):
    rng = random.Random(8)
    vs = [rng.choice([None, *range(-9, 10)]) for _ in range(60)]
    xs = spark.createDataFrame(list(enumerate(vs)), "pos long, v long")
    for back in (False, True):
        now, last, want_sum, want_last = 0, None, {}, {}
        for i in range(59, -1, -1) if back else range(60):
            now, last = now + (vs[i] or 0), last if vs[i] is None else vs[i]
            want_sum[i], want_last[i] = now, last
        assert {r.pos: r.s for r in plan.scan(xs, "v", plan.SUM, back=back, block=3).collect()} == want_sum
        assert {r.pos: r.s for r in plan.scan(xs, "v", plan.LAST, back=back, block=3).collect()} == want_last


def test_matrix_kinds(spark, tmp_path):
    def read(name, text, **options):
        (tmp_path / name).write_text(text)
        return sorted(tuple(r) for r in files.read_matrix(spark, str(tmp_path / name), **options).collect())

    head = "%%MatrixMarket matrix "
    assert read("a", head + "array real general\n% note\n\n2 3\n1\n2\n3\n4\n5\n6\n") == [(0, 0, 1.0, 0.0), (0, 1, 3.0, 0.0), (0, 2, 5.0, 0.0), (1, 0, 2.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 6.0, 0.0)]
    assert read("b", head + "coordinate pattern symmetric\n3 3 2\n1 1\n3 2\n", mirrored=True) == [(0, 0, 1.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 1.0, 0.0)]
    assert read("c", head + "coordinate complex hermitian\n2 2 1\n2 1 1.5 -2\n", mirrored=True) == [(0, 1, 1.5, 2.0), (1, 0, 1.5, -2.0)]
    assert read("d", head + "coordinate integer general\n2 2 0\n") == []
    for bad in ("no banner\n1 1 0\n", head + "coordinate quaternion general\n1 1 0\n", head + "array real symmetric\n1 1\n1\n", head + "coordinate real general\n"):
        with pytest.raises(ValueError):
            read(f"bad{len(bad)}", bad)


def test_estimates(spark):
    assert telemetry.shared_constant([10, 8, 3, 4, 1]) == 2.5
    rows = [("a", i, float(c)) for i, c in enumerate([10, 8, 3, 4, 1])]
    assert telemetry.shared_constants(spark.createDataFrame(rows, "estimator string, seq long, c double")).first().shared == 2.5
    ema = telemetry.private_constants(spark.createDataFrame([("a", 0, 0, 10.0), ("a", 0, 1, 1.0)], "estimator string, proc long, seq long, m double"))
    assert ema.first().cst == 9.0


def test_files(spark, tmp_path):
    snap = tmp_path / "g.snap"
    snap.write_text("# a\n# b\n# Nodes: 2 Edges: 3\n# c\n101\t102\n101 104\n101\t107\n")
    assert {(r.src, r.dst) for r in files.read_graph(spark, str(snap)).collect()} == {(101, 102), (101, 104), (101, 107)}
    snap.write_text("# Edges: 4\n1 2\n")
    with pytest.raises(ValueError, match="edges"):
        files.read_snap(spark, str(snap))
    uri = f"file://{tmp_path}/g.adj_bin"
    g = spark.createDataFrame(EDGES, "src long, dst long")
    files.write_graph(g, uri, 7)
    back = files.read_adjacency(spark, uri, vertices_per_partition=2)
    assert sorted((r.src, r.dst) for r in back.collect()) == sorted(EDGES)
    rows = [(5, 1, 9, [77]), (6, 0, 4, []), (9, 1, 19, [1, 2, 3])]
    assert telemetry.parse_binary(telemetry.write_binary(rows)) == rows


def test_hashes(spark):
    rows = spark.range(-50, 50).select("id", H.hash64shift(F.col("id")).alias("h"), H.hash32(F.col("id")).alias("g")).collect()
    assert all(r.h == H.hash64shift_int(r.id) and r.g == H.hash32_int(r.id) for r in rows)


def test_adjacency_file_in_parts(spark, tmp_path):
    """Gaps, a hub whose edges fall into several partitions, vertices behind the last source, and no edge at all."""
    rnd = random.Random(5)
    many = [(4, d) for d in range(3000)] + [(rnd.randrange(9, 2000), rnd.randrange(5000)) for _ in range(2000)]
    for name, rows, n, bits in (("hub", many, 5000, 32), ("wide", many, 5000, 64), ("one", [(3, 1)], 5, 32), ("none", [], 3, 32)):
        uri = f"file://{tmp_path}/new/{name}.adj_bin"
        files.write_adjacency(spark.createDataFrame(rows, "src long, dst long"), uri, n, bits)
        src, dst = np.array(sorted(rows), "i8").reshape(-1, 2).T
        offsets = np.searchsorted(src, np.arange(n + 1))
        want = files.HEAD.pack(files.MAGIC, bits, n, len(rows), 0) + np.concatenate((offsets, dst)).astype(f"<u{bits // 8}").tobytes()
        assert [p.name for p in (tmp_path / "new").glob(f"{name}*")] == [f"{name}.adj_bin"]
        assert (tmp_path / "new" / f"{name}.adj_bin").read_bytes() == want
        assert sorted((r.src, r.dst) for r in files.read_adjacency(spark, uri, 700).collect()) == sorted(rows)


def many_lines(spark, tmp_path, values):
    """A folder of several files in order, larger ones in between, each read in several splits."""
    for i, a in enumerate(range(0, len(values), 7)):
        (tmp_path / f"part-{i:05}.txt").write_text("".join(f"{v}\n" for v in values[a : a + 7]) + "\n" * (i * 37 % 11))
    return str(tmp_path)


def test_lines_of_many_files(spark, tmp_path):
    values = [f"{i} {'x' * (i * 31 % 17)}" for i in range(60)]
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48")
    try:
        got = files.numbered_lines(spark, many_lines(spark, tmp_path, values)).where("value <> ''").orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [r.value for r in got] == values


def test_lines_are_written_by_many_tasks(spark, tmp_path):
    from ordina.catalog.graphs import round_trip

    kept = []
    lines = spark.range(20000).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("value"))
    round_trip(spark, lines, lambda s, p: kept.append(p), "x")
    rows = spark.read.text(kept[0]).groupBy(F.col("_metadata.file_name")).count().collect()
    assert sum(r["count"] for r in rows) == 20000
    assert max(r["count"] for r in rows) < 15000


def test_shared_constants_in_few_passes(spark, monkeypatch):
    """Zeros halve a constant down to nothing; values repeat, rise, and start at odd ones."""
    rnd = random.Random(12)
    lists = {
        "zeros": [7.3] + [0.0] * 1100 + [1e-320, -1.0],
        "few": [100.0, 1.0, 1.0, 30.0, 2.0, 1.0, 0.1, 0.1, 6.0, 0.1],
        "mixed": [1e5, *[rnd.choice([0.0, 2.0 ** -rnd.randrange(200), rnd.random() * 1e5]) for _ in range(400)]],
        "tiny": [5e-324 * 1001, *[5e-324 * rnd.randrange(1500) for _ in range(60)]],
        "nothing": [0.0, -1.0, 3.0], "endless": [math.inf, 3.0, math.inf], "rising": [-8.0, -9.0, -3.0, -5.0, -1.0, 4.0],
    }
    rows = [(name, i, c) for name, cs in lists.items() for i, c in enumerate(cs)]
    passes, put = [], telemetry.written
    monkeypatch.setattr(telemetry, "written", lambda df, name, **k: (passes.append(name), put(df, name, **k))[1])
    got = {r.estimator: r.shared for r in telemetry.shared_constants(spark.createDataFrame(rows, "estimator string, seq long, c double").repartition(3)).collect()}
    assert got == {name: telemetry.shared_constant(cs) for name, cs in lists.items()}
    assert passes.count("moved") < 30


def test_readers_of_many_files(spark, tmp_path):
    """Folders whose files are not of one size, which Spark reads by size: the places of values are kept."""

    def made(name, lines):
        (tmp_path / name).mkdir()
        return many_lines(spark, tmp_path / name, lines)

    rows = [(i, i * i % 13) for i in range(40)]
    banner = "%%MatrixMarket matrix "
    market = made("m.mmarket", [banner + "coordinate real general", "% x", "99 99 40", *[f"{a + 1} {b + 1} 0.5" for a, b in rows]])
    assert sorted((r.src, r.dst) for r in files.read_graph(spark, market).collect()) == rows
    assert sorted(files.read_matrix(spark, market).collect()) == [(a, b, 0.5, 0.0) for a, b in rows]
    array = made("array", [banner + "array real general", "% x", "4 10", *map(str, range(40))])
    assert {(r.r, r.c): r.re for r in files.read_matrix(spark, array).collect()} == {(i % 4, i // 4): float(i) for i in range(40)}
    assert listed(files.read_sequence(spark, made("ints", ["sequenceInt", *[str(b) for _, b in rows]]))) == [b for _, b in rows]
    pairs = files.read_sequence(spark, made("pairs", ["sequenceStringIntPair", *[f"w{b} {a}" for a, b in rows]]))
    assert [(r.first, r.second) for r in pairs.orderBy("pos").collect()] == [(f"w{b}", a) for a, b in rows]
    points = files.read_points(spark, made("points", ["pbbs_sequencePoint2d", *[f"{a} {b}" for a, b in rows]]))
    assert [(r.x, r.y) for r in points.orderBy("id").collect()] == rows


def test_exact_forces_in_blocks(spark, monkeypatch):
    """Blocks smaller than the set: no plan holds all particles, sums equal a loop; equal places, ids and gaps count as in SQL."""
    monkeypatch.setattr(spatial, "BODIES", 7)
    rnd = random.Random(4)
    rows = [(i, rnd.random(), rnd.random(), rnd.random(), float(i % 3 + 1)) for i in range(40)]
    rows += [(40, *rows[3][1:]), (5, 0.5, 0.5, 0.5, 2.0), (41, None, 0.1, 0.1, 1.0), (42, 0.2, 0.3, 0.4, None)]
    table = spark.createDataFrame(rows, "id long, x double, y double, z double, mass double")
    found = spatial.exact_forces(table)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want: dict = {}
    for i, x, y, z, m in rows:
        for j, a, b, c, w in rows:
            if i != j and x is not None and a is not None and (r2 := (a - x) ** 2 + (b - y) ** 2 + (c - z) ** 2) > 0:
                force = want.setdefault(i, [None, None, None])
                for k, d in enumerate((a - x, b - y, c - z)) if m is not None and w is not None else ():
                    force[k] = (force[k] or 0.0) + d * m * w / r2**1.5
    got = {r.id: [r.fx, r.fy, r.fz] for r in found.collect()}
    assert set(got) == set(want)
    assert got[42] == want[42] == [None] * 3
    assert all(got[i] == pytest.approx(want[i]) for i in want if i != 42)
    assert spatial.exact_forces(table.limit(0)).count() == 0


def test_near_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 1000)  # pairs by far exceed it
    points, plans, put = generators.points(spark, 300, generators.plummer), [], spatial.written
    monkeypatch.setattr(spatial, "written", lambda df, name, **k: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), put(df, name, **k))[1])
    got = spatial.nearest(points, points, 3, 3).toPandas()
    assert len(got) == 900
    parts = [int(x) for x in re.findall(r"RepartitionByExpression \[cx.*, (\d+)", next(p for n, p in plans if n == "nearest"))]
    assert len(parts) == 2 and parts[0] == parts[1] > 30


def test_shuffles_are_sized_by_the_tables(spark, monkeypatch):
    from ordina.catalog import QUERIES
    from ordina.plans import sizing

    data, start = "/root/testdata/sf0.001", sizing.partitions(spark)
    monkeypatch.setattr(sizing, "SHARE", 10_000)
    for name in ("G5_degrees_both", "G6_symmetric", "G28_bag", "U11_vertex_weight"):
        found = QUERIES[name](spark, data)
        assert sizing.partitions(spark) > 2 * start
        assert found.count() > 0
    QUERIES["S1_fill"](spark, data)
    assert sizing.partitions(spark) == start


def test_components_start_from_the_edges(spark, monkeypatch):
    plans, put = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, **k: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), put(df, name, **k))[1])
    edges = [(3, 1), (1, 2), (2, 0), (5, 5), (2, 7)]
    got = {r.vertex: r.label for r in graph.components(spark.createDataFrame(edges, "src long, dst long"), 9).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1, 8: 8}
    assert "Join" not in next(p for n, p in plans[1:] if n == "labels" and "Aggregate" in p)
