"""Queries of scalar functions, points, trees, neighbours, forces and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as P
from ..functions import scalars as X
from ..operators import spatial as K
from ..operators import telemetry as T
from ..plans import scan as plan
from .base import Catalog, table

CATALOG = Catalog()
add = CATALOG.add

# Points of orders and embeddings

PT = "pt AS (SELECT o_orderkey AS id, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders)"
EM = "em AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (label + 1)::DOUBLE AS mass FROM embeddings)"


def points(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))


def particles(s, d):
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("label") + 1).cast("double").alias("mass"))


add("A7_min_max_index", lambda s, d: points(s, d).agg(F.min_by("id", F.struct("x", "y", "id")).alias("leftmost"), F.max_by("id", F.struct("x", -F.col("id"))).alias("rightmost")), f"WITH {PT} SELECT (SELECT id FROM pt ORDER BY x, y, id LIMIT 1) AS leftmost, (SELECT id FROM pt ORDER BY x DESC, id LIMIT 1) AS rightmost")
add("A8_bounding_box", lambda s, d: K.bounding_box(points(s, d)), f"WITH {PT} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, (max(x) + min(x)) / 2 AS centre_x, (max(y) + min(y)) / 2 AS centre_y, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM pt")
add("A9_centre_of_mass", lambda s, d: K.centre_of_mass(particles(s, d)).select(*[F.round(c, 6).alias(c) for c in ("mass", "x", "y", "z")]), f"WITH {EM} SELECT round(sum(mass), 6) AS mass, round(sum(mass * x) / sum(mass), 6) AS x, round(sum(mass * y) / sum(mass), 6) AS y, round(sum(mass * z) / sum(mass), 6) AS z FROM em")
add("A10_node_counts", lambda s, d: points(s, d).groupBy(F.floor(F.col("x") / 50000).cast("long").alias("cx"), F.floor(F.col("y") / 100).cast("long").alias("cy")).agg(F.count(F.lit(1)).alias("n")), f"WITH {PT} SELECT floor(x / 50000)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy, count(*) AS n FROM pt GROUP BY 1, 2")

# Scalar functions

nums = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n"))
NM = "nm AS (SELECT o_orderkey AS id, o_custkey AS n FROM orders)"
LG = "CASE WHEN {0} <= 1 THEN 0 ELSE length(ltrim(bin({0} - 1), '0')) END"
add("X7_log2_up", lambda s, d: nums(s, d).select("id", X.log2_up(F.col("n")).cast("long").alias("lg")), f"WITH {NM} SELECT id, ({LG.format('n')})::BIGINT AS lg FROM nm")
add("X8_log_functions", lambda s, d: nums(s, d).where("n > 0").select("id", X.log2_down(F.col("n")).cast("long").alias("lgn"), X.n_log_n(F.col("n")).cast("long").alias("nlgn"), (F.col("n") * F.col("n")).alias("nsq"), (F.col("n") * F.col("n") * F.col("n")).alias("ncub")), f"WITH {NM}, l AS (SELECT id, n, (length(ltrim(bin(n), '0')) - 1)::BIGINT AS lg FROM nm WHERE n > 0) SELECT id, lg AS lgn, n * lg AS nlgn, n * n AS nsq, n * n * n AS ncub FROM l")
add("X9_median_of_3", lambda s, d: nums(s, d).select("id", X.median_of_3(F.col("n"), F.col("id") % 997, F.col("n") * 7 % 1009).alias("m")), f"WITH {NM} SELECT id, list_sort([n, id % 997, n * 7 % 1009])[2] AS m FROM nm")
add("X10_triangular_root", lambda s, d: nums(s, d).select("id", X.triangular_root(F.col("n")).alias("r")), f"WITH {NM} SELECT id, floor((sqrt(4 * n + 1) + 1) / 2)::BIGINT AS r FROM nm")
add("X11_fibonacci", lambda s, d: s.createDataFrame([(i, X.fibonacci(i)) for i in range(60)], "n long, f long"), "WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 59) SELECT n, a AS f FROM f")
CMP = "CASE WHEN left(a, least(length(a), length(b))) < left(b, least(length(a), length(b))) THEN -1 WHEN left(a, least(length(a), length(b))) > left(b, least(length(a), length(b))) THEN 1 ELSE 0 END"
add("X12_string_compare", lambda s, d: table(s, d, "part").select("p_partkey", X.string_compare(F.col("p_name"), F.col("p_type")).alias("c")), f"SELECT p_partkey, {CMP} AS c FROM (SELECT p_partkey, p_name AS a, p_type AS b FROM part)")
add("X13_string_compare_prefix", lambda s, d: table(s, d, "part").select("p_partkey", X.string_compare(F.col("p_name"), F.left("p_name", F.lit(3))).alias("c")), "SELECT p_partkey, 0 AS c FROM part")
add("X14_parens", lambda s, d: nums(s, d).select("id", X.paren_value(X.value_paren(F.col("n") % 2 * 2 - 1)).alias("v")), f"WITH {NM} SELECT id, n % 2 * 2 - 1 AS v FROM nm")
add("X15_string_order", lambda s, d: table(s, d, "part").select("p_partkey", (F.col("p_name") < F.col("p_type")).alias("less")), "SELECT p_partkey, p_name < p_type AS less FROM part")


def vectors(s, d):
    e = particles(s, d)
    return e.select("id", P.vec(F.col("x"), F.col("y"), F.col("z")).alias("a"), P.vec(F.col("y"), F.col("z"), F.col("x")).alias("b"), P.vec(F.col("z"), F.col("x"), F.col("y")).alias("c"))


VE = f"WITH {EM}, ve AS (SELECT id, x, y, z, y AS bx, z AS b_y, x AS bz, z AS cx, x AS cy, y AS cz FROM em)"
r6 = lambda c: F.round(c, 6)


def abc(f):
    """A query over the vectors a, b and c of each row; columns are made when it runs."""
    return lambda s, d: vectors(s, d).select("id", *f(F.col("a"), F.col("b"), F.col("c")))


add("X16_vector_algebra", abc(lambda a, b, c: [r6(P.plus(a, b, 3)["x"]).alias("sum_x"), r6(P.minus(a, b, 3)["y"]).alias("diff_y"), r6(P.times(a, 3.0, 3)["z"]).alias("times_z"), r6(P.over(a, 4.0, 3)["x"]).alias("over_x"), r6(P.dot(a, b, 3)).alias("dot"), r6(P.cross3(a, b)["x"]).alias("cross_x"), r6(P.cross2(a, b)).alias("cross2"), r6(P.max_dim(a, 3)).alias("max_dim"), r6(P.length(a, 3)).alias("length")]), f"{VE} SELECT id, round(x + bx, 6) AS sum_x, round(y - b_y, 6) AS diff_y, round(z * 3, 6) AS times_z, round(x / 4, 6) AS over_x, round(x * bx + y * b_y + z * bz, 6) AS dot, round(y * bz - z * b_y, 6) AS cross_x, round(x * b_y - y * bx, 6) AS cross2, greatest(round(x, 6), round(y, 6), round(z, 6)) AS max_dim, round(sqrt(x * x + y * y + z * z), 6) AS length FROM ve")
add("X17_point_ops", abc(lambda a, b, c: [r6(P.min_coords(a, b)["x"]).alias("min_x"), r6(P.max_coords(a, b)["y"]).alias("max_y"), P.quadrant(a, b, 3).alias("quadrant"), r6(P.offset_point(b, P.quadrant(a, b, 3), 0.5, 3)["z"]).alias("offset_z"), P.out_of_box(a, b, 0.25, 3).alias("out")]), f"{VE} SELECT id, round(least(x, bx), 6) AS min_x, round(greatest(y, b_y), 6) AS max_y, (x > bx)::INT + 2 * (y > b_y)::INT + 4 * (z > bz)::INT AS quadrant, round(bz + CASE WHEN z > bz THEN 0.5 ELSE -0.5 END, 6) AS offset_z, x - 0.25 > bx OR x + 0.25 < bx OR y - 0.25 > b_y OR y + 0.25 < b_y OR z - 0.25 > bz OR z + 0.25 < bz AS out FROM ve")
AREA = "((bx - x) * (cy - y) - (b_y - y) * (cx - x))"
add("X18_tri_area", abc(lambda a, b, c: [r6(P.tri_area(a, b, c)).alias("area"), P.counter_clockwise(a, b, c).alias("ccw")]), f"{VE} SELECT id, round({AREA}, 6) AS area, {AREA} > 0 AS ccw FROM ve")
add("X18_tri_area_normalized", abc(lambda a, b, c: [F.round(P.tri_area_normalized(a, b, c), 5).alias("area")]), f"{VE} SELECT id, round({AREA} / (sqrt((bx - x) * (bx - x) + (b_y - y) * (b_y - y)) * sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y))), 5) AS area FROM ve")
origin = lambda: P.vec(F.lit(0.125), F.lit(-0.25))
IC = "(SELECT id, x - 0.125 AS ax, y + 0.25 AS ay, bx - 0.125 AS bx, b_y + 0.25 AS b_y, cx - 0.125 AS cx, cy + 0.25 AS cy FROM ve)"
add("X19_in_circle", abc(lambda a, b, c: [F.round(P.in_circle_value(a, b, c, origin()), 5).alias("v")]), f"{VE}, p AS (SELECT *, ax * ax + ay * ay AS az, bx * bx + b_y * b_y AS bz, cx * cx + cy * cy AS cz FROM {IC}) SELECT id, round((ay * bz - az * b_y) * cx + (az * bx - ax * bz) * cy + (ax * b_y - ay * bx) * cz, 5) AS v FROM p")
add("X20_angles", abc(lambda a, b, c: [F.round(P.angle(a, b, c), 3).alias("angle")]), f"{VE} SELECT id, round(acos(((bx - x) * (cx - x) + (b_y - y) * (cy - y)) / (sqrt((bx - x) * (bx - x) + (b_y - y) * (b_y - y)) * sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)))) * 180 / 3.14159::DOUBLE, 3) AS angle FROM ve")
add("X21_parsed_numbers", lambda s, d: table(s, d, "part").select("p_partkey", X.parsed_number(F.regexp_extract("p_brand", "#?(.*)$", 1), "long").alias("n")), "SELECT p_partkey, coalesce(try_cast(trim(regexp_extract(p_brand, '#?(.*)$', 1)) AS BIGINT), 0) AS n FROM part")
add("X22_atomics", lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("added"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most")), "SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS added, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem GROUP BY 1")
add("X23_gravity", abc(lambda a, b, c: [F.round(P.gravity(a, P.vec(F.lit(9.0), F.lit(8.0), F.lit(7.0)), F.lit(2.0), F.lit(3.0))["x"], 7).alias("fx")]), f"{VE}, r AS (SELECT id, 9 - x AS dx, (9 - x) * (9 - x) + (8 - y) * (8 - y) + (7 - z) * (7 - z) AS r2 FROM ve) SELECT id, round(dx * 6 / (r2 * sqrt(r2)), 7) AS fx FROM r")
# Decimal digits rounded half up, in whole numbers.
TIME = "CASE WHEN us >= 1000000 THEN ((us + 50000) // 100000) // 10 || '.' || ((us + 50000) // 100000) % 10 || ' seconds' WHEN us >= 100000 THEN ((us + 5000) // 10000) // 100 || '.' || lpad((((us + 5000) // 10000) % 100)::VARCHAR, 2, '0') || ' seconds' WHEN us >= 10000 THEN ((us + 50) // 100) // 10 || '.' || ((us + 50) // 100) % 10 || ' milliseconds' WHEN us >= 1000 THEN ((us + 5) // 10) // 100 || '.' || lpad((((us + 5) // 10) % 100)::VARCHAR, 2, '0') || ' milliseconds' ELSE us || ' microseconds' END"
add("X24_readable_time", lambda s, d: nums(s, d).select("id", X.readable_time((F.col("n") * F.col("n")).cast("double")).alias("t")), f"WITH {NM} SELECT id, {TIME} AS t FROM (SELECT id, n * n AS us FROM nm)")
add("X25_colour_step", lambda s, d: nums(s, d).select("id", X.colour_step(F.col("n") / 1024).alias("c")), f"WITH {NM} SELECT id, least(greatest(floor(n / 1024 * 1530), 0), 1530)::BIGINT AS c FROM nm")

# Trees, neighbours, hull, forces

CODE = "cd AS (SELECT id, least(floor((x - mx) / side * 64)::BIGINT, 63) AS cx, least(floor((y - my) / side * 64)::BIGINT, 63) AS cy FROM pt, (SELECT min(x) AS mx, min(y) AS my, greatest(max(x) - min(x), max(y) - min(y)) AS side FROM pt) b), zz AS (SELECT id, (" + " + ".join(f"((cx >> {i}) & 1) * {4**i} + ((cy >> {i}) & 1) * {2 * 4**i}" for i in range(6)) + ")::BIGINT AS code FROM cd)"
NODES = f"WITH RECURSIVE {PT}, {CODE}, nd AS (SELECT l.range::INT AS level, code >> (2 * (6 - l.range))::INT AS prefix, count(*) AS n FROM zz, range(7) l GROUP BY 1, 2), live AS (SELECT level, prefix, n FROM nd WHERE level = 0 UNION ALL SELECT nd.level, nd.prefix, nd.n FROM live JOIN nd ON nd.level = live.level + 1 AND nd.prefix >> 2 = live.prefix WHERE live.n > 16), fin AS (SELECT level, prefix, n, n <= 16 OR level = 6 AS leaf FROM live)"
add("K1_tree", lambda s, d: K.tree(points(s, d), depth=6).select("level", "prefix", "n", "leaf"), f"{NODES} SELECT level, prefix, n, leaf FROM fin")
add("K2_tree_stats", lambda s, d: K.tree_stats(K.tree(points(s, d), depth=6)), f"{NODES} SELECT max(level) AS depth, sum(CASE WHEN leaf THEN n END)::BIGINT AS size, count(*) FILTER (WHERE leaf) AS leaves FROM fin")
add("K2_flatten", lambda s, d: K.flattened(points(s, d), 6), f"WITH {PT}, {CODE} SELECT row_number() OVER (ORDER BY code, id) - 1 AS pos, id FROM zz")
DIST = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)"
KNN = f"WITH {EM}, pr AS (SELECT p.id, q.id AS ngh, 0.0::DOUBLE + {{0}} AS dist2 FROM em p, em q WHERE p.id <> q.id), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist2, ngh) AS rank FROM pr) SELECT id, rank::INT AS rank, ngh, round(dist2, 9) AS dist2 FROM rk WHERE rank <= {{1}}"
knn = lambda df: df.select("id", "rank", "ngh", F.round("dist2", 9).alias("dist2"))
add("K3_nearest", lambda s, d: knn(K.nearest(particles(s, d), particles(s, d), 1)), KNN.format(DIST, 1))
add("K4_all_knn", lambda s, d: knn(K.nearest(particles(s, d), particles(s, d), 5)), KNN.format(DIST, 5))
add("K5_knn_3d", lambda s, d: knn(K.nearest(particles(s, d), particles(s, d), 3, 3)), KNN.format(f"{DIST} + (q.z - p.z) * (q.z - p.z)", 3))
#: The ring step by step: from each corner the point that needs the least turn to the right.
WRAP = f"""WITH RECURSIVE {PT}, ring AS (
  SELECT 0::BIGINT AS pos, id, x, y, pi() / 2 AS ang, id AS start FROM (SELECT * FROM pt ORDER BY x, y, id LIMIT 1)
  UNION ALL
  SELECT pos, id, x, y, ang, start FROM (
    SELECT *, CASE WHEN was - ang < -1e-12 THEN was - ang + 2 * pi() ELSE was - ang END AS turn
    FROM (SELECT r.pos + 1 AS pos, p.id, p.x, p.y, r.ang AS was, atan2(p.y - r.y, p.x - r.x) AS ang, start, (p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) AS far FROM ring r, pt p)
    WHERE far > 0 ORDER BY turn, far DESC, id LIMIT 1
  ) WHERE id <> start
)"""
add("K6_hull", lambda s, d: K.hull(points(s, d)), f"{WRAP} SELECT pos, id FROM ring")
#: The same tree by cells of each level: depth 10, leaves of 16, alpha 1.
_AXES = (("x", "ix"), ("y", "iy"), ("z", "iz"))
_WIDE = "(SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM em) b"
_R2 = "(nd.cx - w.x) * (nd.cx - w.x) + (nd.cy - w.y) * (nd.cy - w.y) + (nd.cz - w.z) * (nd.cz - w.z)"
_FAR = f"{_R2} > w.side * w.side / pow(4, w.l)"
TREE_FORCES = f"""WITH RECURSIVE {EM},
c AS (SELECT em.*, side, {", ".join(f"least(floor(({a} - l{a}) / side * 1024)::BIGINT, 1023) AS {i}" for a, i in _AXES)} FROM em, {_WIDE}),
nd AS (SELECT l, ix >> (10 - l) AS i, iy >> (10 - l) AS j, iz >> (10 - l) AS k, count(*) AS n, sum(mass) AS m, sum(mass * x) / sum(mass) AS cx, sum(mass * y) / sum(mass) AS cy, sum(mass * z) / sum(mass) AS cz
       FROM c, (SELECT range AS l FROM range(11)) GROUP BY 1, 2, 3, 4),
w AS (
  SELECT id, x, y, z, mass, side, 0::BIGINT AS l, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS k FROM c
  UNION ALL
  SELECT w.id, w.x, w.y, w.z, w.mass, w.side, ch.l, ch.i, ch.j, ch.k FROM w JOIN nd USING (l, i, j, k) JOIN nd ch ON ch.l = nd.l + 1 AND ch.i >> 1 = nd.i AND ch.j >> 1 = nd.j AND ch.k >> 1 = nd.k
  WHERE NOT ({_FAR}) AND nd.n > 16 AND nd.l < 10
),
met AS (SELECT w.*, nd.n, nd.m, nd.cx - w.x AS dx, nd.cy - w.y AS dy, nd.cz - w.z AS dz, {_R2} AS r2, {_FAR} AS far FROM w JOIN nd USING (l, i, j, k)),
one AS (SELECT met.id, met.mass, o.mass AS m, o.x - met.x AS dx, o.y - met.y AS dy, o.z - met.z AS dz FROM met JOIN c o ON o.ix >> (10 - l) = i AND o.iy >> (10 - l) = j AND o.iz >> (10 - l) = k AND o.id <> met.id WHERE NOT far AND (n <= 16 OR l = 10)),
pull AS (
  SELECT id, dx, dy, dz, mass * m / (r2 * sqrt(r2)) AS f, 0 AS direct, 1 AS far FROM met WHERE far
  UNION ALL
  SELECT id, dx, dy, dz, mass * m / (r2 * sqrt(r2)), 1, 0 FROM (SELECT *, dx * dx + dy * dy + dz * dz AS r2 FROM one) WHERE r2 > 0
),
bh AS (SELECT id, sum(dx * f) AS fx, sum(dy * f) AS fy, sum(dz * f) AS fz, sum(direct)::BIGINT AS direct, sum(far)::BIGINT AS far FROM pull GROUP BY 1)
"""
_EXACT = "(SELECT p.id, sum((q.x - p.x) * p.mass * q.mass / (r2 * sqrt(r2))) AS ex, sum((q.y - p.y) * p.mass * q.mass / (r2 * sqrt(r2))) AS ey, sum((q.z - p.z) * p.mass * q.mass / (r2 * sqrt(r2))) AS ez FROM em p, em q, LATERAL (SELECT (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS r2) WHERE r2 > 0 GROUP BY 1)"
add("K7_barnes_hut", lambda s, d: K.barnes_hut(particles(s, d)).select("id", *[F.round(f"f{a}", 3).alias(f"f{a}") for a in "xyz"]), f"{TREE_FORCES} SELECT id, round(fx, 3) AS fx, round(fy, 3) AS fy, round(fz, 3) AS fz FROM bh")
FORCE = f"WITH {EM}, pr AS (SELECT p.id, p.mass * q.mass AS mm, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz FROM em p, em q WHERE p.id <> q.id), r AS (SELECT *, dx * dx + dy * dy + dz * dz AS r2 FROM pr) SELECT id, round(sum(dx * mm / (r2 * sqrt(r2))), 3) AS fx, round(sum(dy * mm / (r2 * sqrt(r2))), 3) AS fy FROM r WHERE r2 > 0 GROUP BY id"
add("K7_exact_forces", lambda s, d: K.exact_forces(particles(s, d)).select("id", F.round("fx", 3).alias("fx"), F.round("fy", 3).alias("fy")), FORCE)
add("K8_force_error", lambda s, d: K.force_error(K.barnes_hut(particles(s, d)), K.exact_forces(particles(s, d))).select((F.col("error") < 0.1).alias("ok"), F.round("error", 9).alias("error")), f"{TREE_FORCES} SELECT error < 0.1 AS ok, round(error, 9) AS error FROM (SELECT avg(sqrt(((fx - ex) * (fx - ex) + (fy - ey) * (fy - ey) + (fz - ez) * (fz - ez)) / (ex * ex + ey * ey + ez * ez))) AS error FROM bh JOIN {_EXACT} USING (id))")
add("K9_interactions", lambda s, d: K.barnes_hut(particles(s, d)).agg(F.sum("direct").alias("direct"), F.sum("far").alias("far")), f"{TREE_FORCES} SELECT sum(direct)::BIGINT AS direct, sum(far)::BIGINT AS far FROM bh")
add("K10_cell_moments", lambda s, d: K.cell_moments(particles(s, d)).select("code", "n", F.round(F.col("re")[0], 6).alias("mass")), f"WITH {EM}, cd AS (SELECT mass, " + ", ".join(f"least(floor(({a} - m{a}) / side * 4)::BIGINT, 3) AS c{a}" for a in "xyz") + " FROM em, (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM em) b) SELECT (" + " + ".join(f"((c{a} >> {i}) & 1) * {8**i * (1 << bit)}" for i in range(2) for bit, a in enumerate("xyz")) + ")::BIGINT AS code, count(*) AS n, round(sum(mass), 6) AS mass FROM cd GROUP BY 1")
#: Moments up to degree 2 about the middle of the box, straight from the particles.
_U = "(SELECT mass AS m, x - mx - side / 2 AS x, y - my - side / 2 AS y, z - mz - side / 2 AS z FROM em, (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM em))"
_DEGREES = [("1", "0"), ("x / sqrt(2)", "y / sqrt(2)"), ("z", "0"), ("-x / sqrt(2)", "y / sqrt(2)"), ("sqrt(0.375) * (x * x - y * y)", "sqrt(0.375) * 2 * x * y"), ("sqrt(1.5) * x * z", "sqrt(1.5) * y * z"), ("z * z - (x * x + y * y) / 2", "0"), ("-sqrt(1.5) * x * z", "sqrt(1.5) * y * z"), ("sqrt(0.375) * (x * x - y * y)", "-sqrt(0.375) * 2 * x * y")]
add("K10_whole_moments", lambda s, d: K.whole_moments(particles(s, d), 3, 2).select("k", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("re", "im")]), f"WITH {EM}, u AS {_U} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, round(sum(m * ({re}))::DOUBLE, 4) + 0.0::DOUBLE AS re, round(sum(m * ({im}))::DOUBLE, 4) + 0.0::DOUBLE AS im FROM u" for k, (re, im) in enumerate(_DEGREES)))

# Event logs: users as processors, views and clicks as waits, purchases and sign-ups as the computation

NAMES = {"view": "enter_wait", "click": "exit_wait", "purchase": "enter_algo", "signup": "exit_algo", "error": "communicate"}


#: Microseconds of a timestamp without a zone, whatever the session's zone.
MICROS = ("datediff(to_date(ts), date'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(SECOND FROM ts) * 1000000 AS bigint)")


def log(s, d):
    kind = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("event_type")]
    return table(s, d, "events").select(F.expr(MICROS).alias("time"), F.col("user_id").alias("proc"), F.col("event_id").alias("seq"), kind.alias("type"))


LOG = "lg AS (SELECT epoch_us(ts) AS time, user_id AS proc, event_id AS seq, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES.items()) + " END AS type FROM events)"
PAIR = f"{LOG}, sm AS (SELECT *, lag(type) OVER w AS before, lag(time) OVER w AS began, lead(type) OVER w AS after FROM lg WHERE type IN ('enter_wait', 'exit_wait') WINDOW w AS (PARTITION BY proc ORDER BY time, seq)), iv AS (SELECT proc, began AS start, time AS stop FROM sm WHERE type = 'exit_wait' AND before = 'enter_wait')"
add("O17_event_merge", lambda s, d: T.merged(log(s, d).where("seq % 2 = 0"), log(s, d).where("seq % 2 = 1")).select("pos", "seq"), f"WITH {LOG} SELECT row_number() OVER (ORDER BY time, proc, seq) - 1 AS pos, seq FROM lg")
add("T1_tracked", lambda s, d: T.tracked(log(s, d), ["phases"]).groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n")), f"WITH {LOG} SELECT 'phases' AS kind, type, count(*) AS n FROM lg WHERE type <> 'communicate' GROUP BY 2")
add("T2_merge_sort", lambda s, d: T.merged(log(s, d)).select("pos", "time", "proc", "seq"), f"WITH {LOG} SELECT row_number() OVER (ORDER BY time, proc, seq) - 1 AS pos, time, proc, seq FROM lg")
add("T4_idle_intervals", lambda s, d: T.intervals(log(s, d), "enter_wait", "exit_wait"), f"WITH {PAIR} SELECT proc, start, stop FROM iv")
add("T4_idle_problems", lambda s, d: T.paired(log(s, d), "enter_wait", "exit_wait").where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n")), f"WITH {PAIR}, pb AS (SELECT CASE WHEN type = 'exit_wait' AND coalesce(before <> 'enter_wait', true) THEN 'exit without enter' WHEN type = 'enter_wait' AND after IS NULL THEN 'missing exit' WHEN type = 'enter_wait' AND after = 'enter_wait' THEN 'double enter' END AS problem FROM sm) SELECT problem, count(*) AS n FROM pb WHERE problem IS NOT NULL GROUP BY 1")
add("T5_locality_intervals", lambda s, d: T.intervals(log(s, d).withColumn("type", F.when(F.col("type") == "enter_algo", "locality_start").when(F.col("type") == "exit_algo", "locality_stop")), "locality_start", "locality_stop").select("*", ((F.col("start") + F.col("stop")) / 2).alias("middle")), f"WITH {LOG}, sm AS (SELECT *, lag(type) OVER w AS before, lag(time) OVER w AS began FROM lg WHERE type IN ('enter_algo', 'exit_algo') WINDOW w AS (PARTITION BY proc ORDER BY time, seq)) SELECT proc, began AS start, time AS stop, (began + time)::DOUBLE / 2 AS middle FROM sm WHERE type = 'exit_algo' AND before = 'enter_algo'")
add("T6_ranges", lambda s, d: T.ranges(log(s, d), "enter_algo", "exit_algo"), f"WITH {LOG} SELECT min(time) FILTER (WHERE type = 'enter_algo') AS start, max(time) FILTER (WHERE type = 'exit_algo') AS stop, min(time) AS first, max(time) AS last, 1 + max(proc) AS nb_proc FROM lg")


def clip(s, d):
    box = T.intervals(log(s, d), "enter_wait", "exit_wait")
    bounds = T.ranges(log(s, d), "enter_algo", "exit_algo").select(F.col("start").alias("a"), F.col("stop").alias("b"))
    return T.clipped(box.crossJoin(F.broadcast(bounds)), F.col("a"), F.col("b")).select("proc", "start", "stop", F.floor(T.scaled_x(F.col("start"), F.col("a"), F.col("b"), 1000)).alias("x"))


add("T7_clip_zoom", clip, f"WITH {PAIR}, g AS (SELECT min(time) FILTER (WHERE type = 'enter_algo') AS a, max(time) FILTER (WHERE type = 'exit_algo') AS b FROM lg), c AS (SELECT proc, greatest(start, a) AS start, least(stop, b) AS stop, a, b FROM iv, g) SELECT proc, start, stop, floor(((start - a) * 1000)::DOUBLE / (b - a))::BIGINT AS x FROM c WHERE start < stop")


def utilized(s, d):
    r = T.ranges(log(s, d), "enter_wait", "exit_wait").first()
    return T.utilization(T.intervals(log(s, d), "enter_wait", "exit_wait"), float(r.last - r.first), r.nb_proc).select("idle", F.round("utilization", 9).alias("utilization"))


add("T8_utilization", utilized, f"WITH {PAIR}, g AS (SELECT max(time) - min(time) AS du, 1 + max(proc) AS n FROM lg) SELECT sum(stop - start)::BIGINT AS idle, round(1 - sum(stop - start)::DOUBLE / (max(du)::DOUBLE * max(n)), 9) AS utilization FROM iv, g")
MEASURES = "ms AS (SELECT event_type AS estimator, user_id AS proc, event_id AS seq, value AS m FROM events), od AS (SELECT *, row_number() OVER (PARTITION BY estimator, proc ORDER BY seq) AS i, count(*) OVER (PARTITION BY estimator, proc) AS n FROM ms)"
measures = lambda s, d: table(s, d, "events").select(F.col("event_type").alias("estimator"), F.col("user_id").alias("proc"), F.col("event_id").alias("seq"), F.col("value").alias("m"))
CLOSED = "sum(m * CASE WHEN i = 1 THEN pow(8.0 / 9, n - 1) ELSE pow(8.0 / 9, n - i) / 9 END)"
add("T9_private_constants", lambda s, d: T.private_constants(measures(s, d)).withColumn("cst", F.round("cst", 6)), f"WITH {MEASURES} SELECT estimator, proc, round({CLOSED}, 6) AS cst FROM od GROUP BY 1, 2")
add("T9_shared_constants", lambda s, d: T.shared_constants(measures(s, d).select("estimator", "seq", F.col("m").alias("c"))), "WITH RECURSIVE r AS (SELECT event_type AS estimator, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, value::DOUBLE AS m FROM events), f AS (SELECT estimator, i, m AS s FROM r WHERE i = 1 UNION ALL SELECT r.estimator, r.i, CASE WHEN r.m < f.s / 2 THEN f.s / 2 ELSE f.s END FROM f JOIN r ON r.estimator = f.estimator AND r.i = f.i + 1) SELECT estimator, arg_max(s, i) AS shared FROM f GROUP BY 1")
add("T10_predict", lambda s, d: measures(s, d).select("seq", T.predicted(F.when(F.col("m") > 10, F.col("m")), F.when(F.col("seq") % 10 > 0, F.col("seq"))).alias("cost"), T.predicted_iterations(F.col("m") + 1, 665.0).alias("n")), "SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN -3.0::DOUBLE ELSE coalesce(CASE WHEN value > 10 THEN value END, 1.0) * event_id END AS cost, greatest(floor(665.0::DOUBLE / (value + 1)), 1)::BIGINT AS n FROM events")
add("T11_counters", lambda s, d: T.counters(log(s, d)), f"WITH {LOG} SELECT type, count(*) AS n FROM lg GROUP BY 1")


def text_log(s, d):
    from .graphs import round_trip

    numbered = T.merged(log(s, d)).withColumn("args", F.col("seq").cast("string"))
    return round_trip(s, T.log_lines(numbered), lambda s, p: T.parse_log(s.read.text(p)), "log").select(F.col("time").cast("long").alias("time"), "proc", "type", "args")


add("IO17_text_log", text_log, f"WITH {LOG} SELECT time, proc, type, seq::VARCHAR AS args FROM lg")


def binary_log(s, d):
    """Codes with and without payload, written as one file and parsed again."""
    from ..plans.scratch import scratch_path
    from ..sources.files import fs_write

    rows = [(i * 10, i % 4, code, list(range(T.PAYLOAD.get(code, 0)))) for i, code in enumerate([0, 2, 4, 5, 7, 9, 10, 16, 19, 3, 1] * 20)]
    path = scratch_path(s, "log") + "/log.bin"
    fs_write(path, T.write_binary(rows))
    return T.read_binary(s, path).select("time", "proc", "code", F.size("payload").alias("words"))


CODES = "[0, 2, 4, 5, 7, 9, 10, 16, 19, 3, 1]"
BINARY = f"SELECT range * 10 AS time, range % 4 AS proc, {CODES}[range % 11 + 1] AS code, [0, 0, 0, 0, 1, 1, 1, 2, 3, 0, 0][range % 11 + 1] AS words FROM range(220)"
add("IO18_binary_log", binary_log, BINARY)
add("T3_parse", binary_log, BINARY)
add("O16_bounded_topk", lambda s, d: points(s, d).withColumn("rank", F.row_number().over(plan.Window.partitionBy("y").orderBy("x", "id"))).where("rank <= 3").select("y", "rank", "id"), f"WITH {PT}, r AS (SELECT y, id, row_number() OVER (PARTITION BY y ORDER BY x, id) AS rank FROM pt) SELECT y, rank, id FROM r WHERE rank <= 3")
