"""Queries of generators, files and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import graph as G
from ..sources import files, generators, graphs
from .base import Catalog, table

CATALOG = Catalog()
add = CATALOG.add

# SQL of the hashes: a chain of CTEs over huge integers.


def hash64_sql(source: str, key: str = "k") -> str:
    """CTEs h0 .. h7: columns of source, and u, the unsigned hash of the key; ``h`` is signed."""
    m = "18446744073709551616"
    return (
        f"h0 AS (SELECT *, (({key})::HUGEINT % {m} + {m}) % {m} AS u FROM {source}), "
        f"h1 AS (SELECT * REPLACE (((18446744073709551615 - u) + u * 2097152) % {m} AS u) FROM h0), "
        f"h2 AS (SELECT * REPLACE (xor(u, u // 16777216) AS u) FROM h1), h3 AS (SELECT * REPLACE (u * 265 % {m} AS u) FROM h2), "
        f"h4 AS (SELECT * REPLACE (xor(u, u // 16384) AS u) FROM h3), h5 AS (SELECT * REPLACE (u * 21 % {m} AS u) FROM h4), "
        f"h6 AS (SELECT * REPLACE (xor(u, u // 268435456) AS u) FROM h5), h7 AS (SELECT * REPLACE (u * 2147483649 % {m} AS u) FROM h6), "
        f"h AS (SELECT *, (CASE WHEN u >= 9223372036854775808 THEN u - {m} ELSE u END)::BIGINT AS s FROM h7)"
    )


def hash32_sql(source: str, key: str, out: str, tag: str) -> str:
    """CTEs ending in ``tag``: columns of source and out, the 32-bit hash of the key."""
    c, low = H.HASH32_CONSTANTS, 0xFFFFFFFF
    steps = [f"({{x}} + {c[0]} + {{x}} * 4096) & {low}", f"xor(xor({{x}}, {c[1]}), {{x}} >> 19)", f"({{x}} + {c[2]} + {{x}} * 32) & {low}", f"xor(({{x}} + {c[3]}) & {low}, ({{x}} * 512) & {low})", f"({{x}} + {c[4]} + {{x}} * 8) & {low}", f"xor(xor({{x}}, {c[5]}), {{x}} >> 16)"]
    ctes = [f"{tag}0 AS (SELECT *, (({key})::BIGINT & {low}) AS {out} FROM {source})"]
    for i, step in enumerate(steps, 1):
        name = tag if i == len(steps) else f"{tag}{i}"
        ctes.append(f"{name} AS (SELECT * REPLACE ({step.format(x=out)} AS {out}) FROM {tag}{i - 1})")
    return ", ".join(ctes)


def hash32_of(x: str) -> str:
    """The 32-bit hash as one expression, for terms of a recursion."""
    c, low = H.HASH32_CONSTANTS, 0xFFFFFFFF
    out = f"(({x})::BIGINT & {low})"
    for step in (f"(x + {c[0]} + x * 4096) & {low}", f"xor(xor(x, {c[1]}), x >> 19)", f"(x + {c[2]} + x * 32) & {low}", f"xor((x + {c[3]}) & {low}, (x * 512) & {low})", f"(x + {c[4]} + x * 8) & {low}", f"xor(xor(x, {c[5]}), x >> 16)"):
        out = f"list_transform([{out}], lambda x: {step})[1]"
    return out


def swaps_sql(n: int) -> str:
    """What lies at each of n places after the swaps sw (t, a, b) in order of t: each place is followed back
    through the swaps that touch it."""
    return (
        f"tr AS (SELECT range AS pos, range AS q, 1::BIGINT << 40 AS t FROM range({n}) UNION ALL "
        "SELECT pos, arg_max(CASE WHEN a = q THEN b ELSE a END, s.t) AS q, max(s.t) AS t FROM tr JOIN (SELECT t, a, b, unnest(list_distinct([a, b])) AS c FROM sw) s ON c = q AND s.t < tr.t GROUP BY pos) "
        "SELECT pos, arg_min(q, t) AS v FROM tr GROUP BY pos"
    )


# Generators of sequences and points

N = 5000
add("S1_fill", lambda s, d: generators.filled(s, N, 9), f"SELECT range AS pos, 9 AS v FROM range({N})")
add("S2_empty_singleton", lambda s, d: generators.empty(s).unionByName(generators.filled(s, 1, 4)), "SELECT 0 AS pos, 4 AS v")
add("S3_tabulate", lambda s, d: generators.tabulated(s, N, lambda i: i * 2), f"SELECT range AS pos, range * 2 AS v FROM range({N})")
add("S4_new_array", lambda s, d: generators.filled(s, N, 0), f"SELECT range AS pos, 0 AS v FROM range({N})")
add("S5_random_sequence", lambda s, d: generators.random_sequence(s, N), f"WITH i AS (SELECT range AS pos FROM range({N})), {hash64_sql('i', 'pos + 23423')} SELECT pos, abs(s) % 1048576 AS v FROM h")
SWAPS64 = f"WITH RECURSIVE i AS (SELECT range AS k FROM range(2000)), {hash64_sql('i')}, sw AS (SELECT a.k // 2 AS t, (a.u % {N})::BIGINT AS a, (b.u % {N})::BIGINT AS b FROM h a JOIN h b ON b.k = a.k + 1 WHERE a.k % 2 = 0), "
add("S6_almost_sorted", lambda s, d: generators.almost_sorted(s, N, 1000), SWAPS64 + swaps_sql(N))
EXP = f"WITH i AS (SELECT range AS pos, 2 * (range + 12323) AS k FROM range({N})), {hash64_sql('i', 'k')}, r AS (SELECT pos, u, (1::BIGINT << (u % 14)::INT) AS r FROM h), "
add("S7_exponential", lambda s, d: generators.exponential(s, N, 12323), EXP + hash64_sql("(SELECT pos, (r + u % r)::BIGINT AS k FROM r)", "k").replace("h0 ", "g0 ").replace("FROM h", "FROM g").replace(" h1 ", " g1 ").replace(" h2 ", " g2 ").replace(" h3 ", " g3 ").replace(" h4 ", " g4 ").replace(" h5 ", " g5 ").replace(" h6 ", " g6 ").replace(" h7 ", " g7 ").replace(" h AS", " g AS") + " SELECT pos, s AS v FROM g")
I32 = f"WITH i AS (SELECT range AS pos FROM range({N})), "
add("S8_random_int", lambda s, d: generators.random_32(s, 100, 100 + N), I32 + hash32_sql("i", "pos + 100", "h", "t") + " SELECT pos, h & 2147483647 AS v FROM t")
add("S8_random_double", lambda s, d: generators.random_32(s, 0, N, "double"), I32 + hash32_sql("i", "pos", "h", "t") + " SELECT pos, (h & 2147483647)::DOUBLE / 2147483648.0::DOUBLE AS v FROM t")
add("S9_random_range", lambda s, d: generators.random_32(s, 0, N).withColumn("v", F.col("v") % 1000), I32 + hash32_sql("i", "pos", "h", "t") + " SELECT pos, (h & 2147483647) % 1000 AS v FROM t")
add("S10_random_payload", lambda s, d: generators.random_32(s, 7, N + 7, "uint").select("pos", F.col("v").alias("key"), F.lit(None).cast("long").alias("payload")), I32 + hash32_sql("i", "pos + 7", "h", "t") + " SELECT pos, h AS key, NULL::BIGINT AS payload FROM t")
SWAPS32 = f"WITH RECURSIVE i AS (SELECT range AS t FROM range(500)), {hash32_sql('i', '2 * t', 'x', 'p')}, {hash32_sql('p', '2 * t + 1', 'y', 'w')}, sw AS (SELECT t, x % {N} AS a, y % {N} AS b FROM w), "
add("S11_almost_sorted_32", lambda s, d: generators.almost_sorted_32(s, 0, N, 500), SWAPS32 + swaps_sql(N))
add("S12_same", lambda s, d: generators.filled(s, N, 3), f"SELECT range AS pos, 3 AS v FROM range({N})")
add("S13_exponential_32", lambda s, d: generators.exponential_32(s, 0, N), I32 + hash32_sql("i", "2 * pos", "a", "t") + ", " + hash32_sql("(SELECT pos, (1::BIGINT << (a % 14)::INT) AS r FROM t)", "2 * pos + 1", "b", "w") + ", " + hash32_sql("w", "r + b % r", "c", "z") + " SELECT pos, c & 2147483647 AS v FROM z")
rounded = lambda df: df.select("id", *[F.round(c, 9).alias(c) for c in df.columns if c != "id"])
U = "round(2 * ({0} & 2147483647)::DOUBLE / 2147483648.0::DOUBLE - 1, 9)"
ID32 = f"WITH i AS (SELECT range AS id FROM range({N})), " + hash32_sql("i", "id", "a", "t") + ", " + hash32_sql("t", "id + a", "b", "w")
add("S14_rand2d", lambda s, d: rounded(generators.points(s, N, generators.unit_square)), f"{ID32} SELECT id, {U.format('a')} AS x, {U.format('b')} AS y FROM w")
add("S14_rand3d", lambda s, d: rounded(generators.points(s, N, generators.unit_cube)), f"{ID32}, {hash32_sql('w', '2 * id + b', 'c', 'z')} SELECT id, {U.format('a')} AS x, {U.format('b')} AS y, {U.format('c')} AS z FROM z")
# Candidates of each point by the hashes of 0 .. 63, the first one inside of the sphere, and z = 0 in the plane.
def sphere_sql(ids: str, d: int) -> str:
    unit = "(2 * ({0} & 2147483647)::DOUBLE / 2147483648.0::DOUBLE - 1)"
    size = "x * x + y * y" + (" + z * z" if d == 3 else " + 0")
    return (
        f"{ids}, o AS (SELECT range AS j FROM range({generators.TRIES})), {hash32_sql('o', 'j', 'oh', 'oz')}, k AS (SELECT id, j, id + (oh & 2147483647) AS k FROM i, oz), "
        f"{hash32_sql('k', 'k', 'a', 'ka')}, {hash32_sql('ka', 'k + a', 'b', 'kb')}, {hash32_sql('kb', '2 * k + b', 'c', 'kc')}, "
        f"cand AS (SELECT id, j, {unit.format('a')} AS x, {unit.format('b')} AS y, {unit.format('c')} AS z FROM kc), "
        f"inn AS (SELECT id, unnest(arg_min({{'x': x, 'y': y, 'z': z}}, j)) FROM cand WHERE {size} <= 1 GROUP BY id), "
        f"onn AS (SELECT id, x * f AS x, y * f AS y, z * f AS z FROM (SELECT *, 1 / sqrt({size}) AS f FROM inn))"
    )


IDS = f"WITH i AS (SELECT range AS id FROM range({N}))"
SCALED = f"{hash32_sql('onn', 'id', 'h1', 'hh')}, {hash32_sql('hh', 'h1 & 2147483647', 'h2', 'hg')}, sc AS (SELECT *, (h2 & 2147483647)::DOUBLE / 2147483648.0::DOUBLE AS s FROM hg)"
add("S15_in_sphere", lambda s, d: rounded(generators.points(s, N, lambda i: generators.in_sphere(i, 3))), f"{sphere_sql(IDS, 3)} SELECT id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM inn")
add("S15_on_sphere", lambda s, d: rounded(generators.points(s, N, lambda i: generators.on_sphere(i, 2))), f"{sphere_sql(IDS, 2)} SELECT id, round(x, 9) AS x, round(y, 9) AS y FROM onn")
add("S16_kuzmin", lambda s, d: rounded(generators.points(s, N, generators.kuzmin)), f"{sphere_sql(IDS, 2)}, {SCALED} SELECT id, round(x * f, 9) AS x, round(y * f, 9) AS y FROM (SELECT *, sqrt(1 / ((1 - s) * (1 - s)) - 1) AS f FROM sc)")
plummer = lambda s, d: generators.points(s, N, generators.plummer).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])
add("S17_plummer", plummer, f"{sphere_sql(IDS, 3)}, {SCALED} SELECT id, round(x * f, 6) AS x, round(y * f, 6) AS y, round(z * f, 6) AS z FROM (SELECT *, sqrt(pow(s, 2.0::DOUBLE / 3) / (1 - pow(s, 2.0::DOUBLE / 3))) AS f FROM sc)")
# Place p was last moved by swap p from place j, and there by the next swap with that place.
add(
    "S19_random_permutation",
    lambda s, d: generators.random_permutation(s, N),
    f"WITH RECURSIVE i AS (SELECT range AS i FROM range({N})), {hash32_sql('i', 'i', 'h', 't')}, sw AS (SELECT i AS t, i AS a, h % (i + 1) AS b FROM t WHERE i > 0), "
    f"tr AS (SELECT range AS pos, range AS q, 0::BIGINT AS t FROM range({N}) UNION ALL SELECT pos, arg_min(CASE WHEN a = q THEN b ELSE a END, s.t), min(s.t) FROM tr JOIN (SELECT t, a, b, unnest(list_distinct([a, b])) AS c FROM sw) s ON c = q AND s.t > tr.t GROUP BY pos) "
    "SELECT pos, arg_max(q, t) AS v FROM tr GROUP BY pos",
)

# Generators of graphs

LEVELS = ", ".join(["l AS (SELECT range AS l FROM range(10))"])
RMAT = (
    "WITH i AS (SELECT range AS id FROM range(4000)), sd AS (SELECT 12334 AS k), " + hash32_sql("sd", "k", "h", "q") + ", ih AS (SELECT id, 2 * id * h AS a0, (2 * id + 1) * h AS b0 FROM i, q), "
    + hash32_sql("ih", "a0", "start", "ua") + ", " + hash32_sql("ua", "b0", "stride", "ub") + ", lv AS (SELECT id, l, start + l * stride AS k FROM ub, (SELECT range AS l FROM range(10)) z), " + hash32_sql("lv", "k", "x", "uc")
    + ", dr AS (SELECT id, 1024 >> (l + 1)::INT AS half, (x & 2147483647)::DOUBLE / 2147483648.0::DOUBLE AS r FROM uc), e AS (SELECT id, sum(CASE WHEN r >= 0.5::DOUBLE + 0.1::DOUBLE THEN half ELSE 0 END)::BIGINT AS src, sum(CASE WHEN (r >= 0.5 AND r < 0.5::DOUBLE + 0.1::DOUBLE) OR r >= 0.5::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE THEN half ELSE 0 END)::BIGINT AS dst FROM dr GROUP BY id)"
)
add("S18_rmat_edges", lambda s, d: graphs.rmat(s, 1000, 4000, 12334, 0.5, 0.1, 0.1, distinct=False), f"{RMAT} SELECT src, dst FROM e")
add("S25_rmat", lambda s, d: graphs.rmat(s, 1000, 4000, 12334, 0.5, 0.1, 0.1), f"{RMAT} SELECT DISTINCT src, dst FROM e")
add("S20_complete", lambda s, d: graphs.complete(s, 60), "SELECT a.range AS src, b.range AS dst FROM range(60) a, range(60) b WHERE a.range <> b.range")
add("S21_phased", lambda s, d: graphs.phased(s, 5, 20, 10, 3), "SELECT 0 AS src, range + 1 AS dst FROM range(20) UNION ALL SELECT 1 + r.range * 20 + j.range, 1 + (r.range + 1) * 20 + (j.range + e.range) % 20 FROM range(4) r, range(20) j, range(20) e WHERE e.range < CASE WHEN j.range < 10 THEN 20 ELSE 3 END")
add("S22_parallel_paths", lambda s, d: graphs.parallel_paths(s, 3, 10, 8), "WITH c AS (SELECT r.range * 81 AS s, r.range * 81 + 1 + k.range * 8 AS b FROM range(3) r, range(10) k) SELECT s AS src, b AS dst FROM c UNION ALL SELECT b + p.range, b + p.range + 1 FROM c, range(7) p UNION ALL SELECT b + 7, s + 81 FROM c")
add("S23_chain", lambda s, d: graphs.chain(s, N), f"SELECT range AS src, range + 1 AS dst FROM range({N})")
add("S24_circular_knext", lambda s, d: graphs.circular(s, 1000, 4), "SELECT i.range AS src, (i.range + k.range + 1) % 1000 AS dst FROM range(1000) i, range(4) k")
DRAW = f"({hash32_of('h')} & 2147483647)"
LOCAL = (
    "WITH RECURSIVE r AS (SELECT range AS k, range // 8 AS src, range AS h, 12 AS power, 0 AS step, -1::BIGINT AS dst FROM range(4000) UNION ALL "
    f"SELECT k, src, h, CASE WHEN step = 0 AND h % 1000003 < 500001 THEN power + 10 ELSE power END, CASE WHEN step = 0 AND h % 1000003 >= 500001 THEN 1 ELSE 0 END, CASE WHEN step = 1 AND j <> src THEN j ELSE -1 END "
    f"FROM (SELECT *, (src + CASE WHEN power > 30 THEN h ELSE h % (1::BIGINT << power) END) % 500 AS j FROM (SELECT k, src, power, step, {DRAW} AS h FROM r WHERE dst < 0))) SELECT src, dst FROM r WHERE dst >= 0"
)
add("S26_random_local", lambda s, d: graphs.random_local(s, 10, 8, 500), LOCAL)
add("S27_grid_2d", lambda s, d: graphs.grid_2d(s, 30, 20), "WITH c AS (SELECT range AS i, range // 30 AS r, range % 30 AS c FROM range(600)) SELECT i AS src, (r + 1) % 20 * 30 + c AS dst FROM c UNION ALL SELECT i, r * 30 + (c + 1) % 30 FROM c")
add("S28_cube_grid", lambda s, d: graphs.cube(s, 9), "WITH c AS (SELECT range AS i, range // 81 AS x, range // 9 % 9 AS y, range % 9 AS z FROM range(729)) SELECT i AS src, (x + 1) % 9 * 81 + y * 9 + z AS dst FROM c UNION ALL SELECT i, x * 81 + (y + 1) % 9 * 9 + z FROM c UNION ALL SELECT i, x * 81 + y * 9 + (z + 1) % 9 FROM c")
add("S29_star", lambda s, d: graphs.star(s, N), f"SELECT 0 AS src, range + 1 AS dst FROM range({N})")
add("S30_tree_binary", lambda s, d: graphs.tree(s, 2, 10), "SELECT (range - 1) // 2 AS src, range AS dst FROM range(1, 2047)")
add("S31_tree_depth_2", lambda s, d: graphs.tree_depth_2(s, 40), "SELECT 0 AS src, range + 1 AS dst FROM range(40) UNION ALL SELECT i.range, i.range * 40 + j.range + 1 FROM range(1, 41) i, range(40) j")
add("S32_tree_2", lambda s, d: graphs.tree_2(s, 10, 5, 4), "WITH r AS (SELECT range * 60 AS root FROM range(4)) SELECT root AS src, root + i.range + 1 AS dst FROM r, range(10) i UNION ALL SELECT root + i.range + 1, root + 10 + i.range * 5 + j.range + 1 FROM r, range(10) i, range(5) j")
add("S33_unbalanced_tree", lambda s, d: graphs.unbalanced_tree(s, 50, 6), "SELECT range * 7 AS src, (range + 1) * 7 AS dst FROM range(49) UNION ALL SELECT i.range * 7 + j.range, i.range * 7 + j.range + 1 FROM range(49) i, range(5) j")
add("S34_random_graph", lambda s, d: graphs.chosen(s, 1000, 5), "SELECT (range - 1) // 2 AS src, range AS dst FROM range(1, 1023)")
add("S35_small_generators", lambda s, d: graphs.tree(s, 2, 6).unionByName(graphs.cube(s, 4)), "SELECT (range - 1) // 2 AS src, range AS dst FROM range(1, 127) UNION ALL (WITH c AS (SELECT range AS i, range // 16 AS x, range // 4 % 4 AS y, range % 4 AS z FROM range(64)) SELECT i, (x + 1) % 4 * 16 + y * 4 + z FROM c UNION ALL SELECT i, x * 16 + (y + 1) % 4 * 4 + z FROM c UNION ALL SELECT i, x * 16 + y * 4 + (z + 1) % 4 FROM c)")
NEW = f"WITH i AS (SELECT range AS id FROM range(1001)), {hash64_sql('i', 'id + 11')}, pm AS (SELECT id, row_number() OVER (ORDER BY s, id) - 1 AS new FROM h)"
add("S36_permuted_ids", lambda s, d: graphs.relabelled(graphs.chain(s, 1000), s.range(1001), 11), f"{NEW} SELECT a.new AS src, b.new AS dst FROM pm a JOIN pm b ON b.id = a.id + 1")

# Hashes

HK = "i AS (SELECT event_id AS pos, event_id * 7919 - 5000 AS k FROM events)"
key = lambda s, d: table(s, d, "events").select(F.col("event_id").alias("pos"), (F.col("event_id") * 7919 - 5000).alias("k"))
add("X1_hash64", lambda s, d: key(s, d).select("pos", H.hash64shift(F.col("k")).alias("h"), H.random_index(F.col("k"), F.lit(1000)).alias("i")), f"WITH {HK}, {hash64_sql('i')} SELECT pos, s AS h, (u % 1000)::BIGINT AS i FROM h")
add("X2_abs_hash_mod", lambda s, d: key(s, d).select("pos", (F.abs(H.hash64shift(F.col("k"))) % 4096).alias("v")), f"WITH {HK}, {hash64_sql('i')} SELECT pos, abs(s) % 4096 AS v FROM h")
add("X3_hash32", lambda s, d: key(s, d).select("pos", H.hash32(F.col("k")).alias("h"), H.hash_int(F.col("k")).alias("i"), H.linear_congruence(F.col("pos")).alias("l")), f"WITH {HK}, {hash32_sql('i', 'k', 'h', 't')} SELECT pos, h, h & 2147483647 AS i, ((pos * 1103515245 & 4294967295) + 12345 & 4294967295) % 4294967295 AS l FROM t")
add("X4_hash_double", lambda s, d: key(s, d).select("pos", H.hash_double(F.col("k")).alias("v")), f"WITH {HK}, {hash32_sql('i', 'k', 'h', 't')} SELECT pos, (h & 2147483647)::DOUBLE / 2147483648.0::DOUBLE AS v FROM t")
add(
    "X5_string_hash",
    lambda s, d: table(s, d, "part").select("p_partkey", H.sdbm(F.col("p_name")).alias("h")),
    "WITH RECURSIVE b AS (SELECT p_partkey, hex(encode(p_name)) AS x FROM part), r AS (SELECT p_partkey, x, 0 AS i, 0::BIGINT AS h FROM b UNION ALL SELECT p_partkey, x, i + 1, (h * 65599 + CASE WHEN c > 127 THEN c - 256 ELSE c END) & 4294967295 FROM (SELECT *, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT AS c FROM r WHERE i < length(x) // 2)) SELECT p_partkey, h FROM r WHERE i = length(x) // 2",
)

# Graph operators

EDGES = "e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def edges(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


def vertices(s, d) -> int:
    return G.vertex_count(edges(s, d)).first().nb_vertices


add("A16_search_report", lambda s, d: G.search_report(edges(s, d), 1), f"WITH RECURSIVE {EDGES}, r AS (SELECT 1::BIGINT AS v, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN e ON v = src WHERE d < 24), m AS (SELECT v, min(d) AS d FROM r GROUP BY v) SELECT max(d)::BIGINT AS max_dist, count(*) AS nb_visited, (SELECT max(n) FROM (SELECT count(*) AS n FROM m GROUP BY d)) AS peak_frontier, (SELECT count(*) FROM e WHERE src IN (SELECT v FROM m)) AS nb_edges_processed FROM m")
add("A17_vertex_count", lambda s, d: G.vertex_count(edges(s, d)), f"WITH {EDGES} SELECT max(greatest(src, dst)) + 1 AS nb_vertices FROM e")
add("A18_degrees", lambda s, d: G.degrees(edges(s, d), vertices(s, d)), f"WITH {EDGES}, n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e) SELECT range AS vertex, count(dst) AS degree FROM range((SELECT n FROM n)) LEFT JOIN e ON src = range GROUP BY 1")
add("G1_adjacency", lambda s, d: G.adjacency(edges(s, d)).select("src", F.array_join("out", ",").alias("targets")), f"WITH {EDGES} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS targets FROM e GROUP BY 1")
add("G1_offsets", lambda s, d: G.offsets(edges(s, d), vertices(s, d)), f"WITH {EDGES}, n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e), g AS (SELECT range AS vertex, count(dst) AS degree FROM range((SELECT n FROM n)) LEFT JOIN e ON src = range GROUP BY 1) SELECT vertex, degree, coalesce(sum(degree) OVER (ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM g")
add("G3_edge_list", lambda s, d: G.edge_list(G.adjacency(edges(s, d))), f"WITH {EDGES} SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS j, dst FROM e")
add("G5_degrees_both", lambda s, d: G.both_degrees(edges(s, d)), f"WITH {EDGES} SELECT vertex, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS vertex, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1")
add("G6_symmetric", lambda s, d: G.symmetric(edges(s, d)), f"WITH {EDGES} SELECT src, dst FROM e UNION SELECT dst, src FROM e")
add("G7_validate", lambda s, d: G.validated(edges(s, d), vertices(s, d)).unionByName(G.validated(edges(s, d), 1000)), f"WITH {EDGES} SELECT max(greatest(src, dst)) < n AND min(least(src, dst)) >= 0 AS ok, count(*) AS nb_edges FROM e, (SELECT unnest([max(greatest(src, dst)) + 1, 1000]) AS n FROM e) GROUP BY n")
BFS = f"WITH RECURSIVE {EDGES}, n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e), r AS (SELECT 1::BIGINT AS v, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN e ON v = src WHERE d < 24), m AS (SELECT v, min(d) AS d FROM r GROUP BY v)"
add("G8_bfs_distances", lambda s, d: G.bfs_distances(edges(s, d), vertices(s, d), 1), f"{BFS} SELECT range AS vertex, coalesce(d, -1)::BIGINT AS dist FROM range((SELECT n FROM n)) LEFT JOIN m ON v = range")
shallow = lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
SHALLOW = BFS.replace(EDGES, "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)")
for name in ("G9_bfs_dynamic", "G10_bfs_dual_arrays", "G11_bfs_dual_frontiers", "G12_bfs_segments", "G13_layered_bfs", "G14_parallel_bfs", "G15_lazy_bfs", "G16_scan_bfs"):
    # Search orders differ, distances do not: the frontier join serves them all, here on a shallow graph.
    add(name, lambda s, d: G.bfs_distances(shallow(s, d), G.vertex_count(shallow(s, d)).first().nb_vertices, 1), f"{SHALLOW} SELECT range AS vertex, coalesce(d, -1)::BIGINT AS dist FROM range((SELECT n FROM n)) LEFT JOIN m ON v = range")
REACH = f"{SHALLOW} SELECT range AS vertex, (d IS NOT NULL)::BIGINT AS visited FROM range((SELECT n FROM n)) LEFT JOIN m ON v = range"
for name in ("G17_bfs_visited", "G18_bfs_seq", "G20_dfs", "G21_dfs_frontier", "G22_pseudo_dfs", "G23_pseudo_dfs_levels"):
    add(name, lambda s, d: G.reachable(shallow(s, d), G.vertex_count(shallow(s, d)).first().nb_vertices, 1), REACH)
add("G19_edge_map", lambda s, d: G.edge_map(edges(s, d), s.range(0, 300), s.range(0, 600)), f"WITH {EDGES} SELECT DISTINCT dst AS id FROM e WHERE src < 300 AND dst >= 600")
#: Labels that fall along edges, 40 rounds of them: no way here is as long.
LABELS = "ls AS (SELECT 0 AS it, range AS id, range AS label FROM range((SELECT max(greatest(src, dst)) + 1 FROM e)) UNION ALL SELECT it + 1, id, min(label) FROM (SELECT it, id, label FROM ls UNION ALL SELECT it, dst, label FROM ls JOIN e ON id = src) WHERE it < 40 GROUP BY it, id)"
add("G25_components", lambda s, d: G.components(edges(s, d), vertices(s, d)), f"WITH RECURSIVE {EDGES}, {LABELS} SELECT id AS vertex, label FROM ls WHERE it = 40")
BOTH = "e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem UNION SELECT l_partkey, l_suppkey FROM lineitem)"
add("O15_largest_components", lambda s, d: G.largest_components(G.components(G.symmetric(shallow(s, d)), G.vertex_count(shallow(s, d)).first().nb_vertices)), f"WITH RECURSIVE {BOTH}, {LABELS} SELECT label, count(*) AS size FROM ls WHERE it = 40 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add("G26_peak_frontier", lambda s, d: G.search_report(shallow(s, d), 1).select("peak_frontier"), f"{SHALLOW} SELECT max(n) AS peak_frontier FROM (SELECT count(*) AS n FROM m GROUP BY d)")


def frontier_parts(s, d):
    left, right = G.split_outedges(G.outedge_frontier(edges(s, d), s.range(100, 400)), 500)
    return left.withColumn("part", F.lit(0)).unionByName(right.withColumn("part", F.lit(1)))


add("G27_frontier_outedges", frontier_parts, f"WITH {EDGES}, f AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge, src, dst FROM e WHERE src BETWEEN 100 AND 399) SELECT edge, src, dst, (edge >= 500)::INT AS part FROM f")
add("G28_bag", lambda s, d: edges(s, d).unionByName(edges(s, d)).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), f"WITH {EDGES} SELECT src, dst, 2::BIGINT AS n FROM e")
add("G29_summary", lambda s, d: edges(s, d).agg(F.count(F.lit(1)).alias("nb_edges"), (F.max(F.greatest("src", "dst")) + 1).alias("nb_vertices")), f"WITH {EDGES} SELECT count(*) AS nb_edges, max(greatest(src, dst)) + 1 AS nb_vertices FROM e")

# Files: texts made from tables, written, and read back


def round_trip(s, lines, read, name):
    from ..plans.scratch import scratch_path

    path = f"{scratch_path(s, 'file')}/{name}"
    files.write_lines(lines, path)
    return read(s, path)


def adj_bin(s, d):
    from ..plans.scratch import scratch_path

    uri = scratch_path(s, "graph") + ".adj_bin"
    files.write_adjacency(edges(s, d), uri, vertices(s, d))
    return files.read_graph(s, uri)


edge_lines = lambda df: df.select((F.col("src") * 100000 + F.col("dst") + 10).alias("pos"), F.concat_ws("\t", "src", "dst").alias("value"))
add("IO1_read_adj_bin", adj_bin, f"WITH {EDGES} SELECT src, dst FROM e")
add("IO3_read_snap", lambda s, d: round_trip(s, edge_lines(edges(s, d)).unionByName(edges(s, d).agg(F.lit(0).cast("long").alias("pos"), F.format_string("# Nodes: 0 Edges: %d", F.count(F.lit(1))).alias("value"))), files.read_snap, "g.snap"), f"WITH {EDGES} SELECT src, dst FROM e")
add("IO4_read_pairs", lambda s, d: round_trip(s, edge_lines(edges(s, d)), files.read_pairs, "g.twitter"), f"WITH {EDGES} SELECT src, dst FROM e UNION SELECT dst, src FROM e")


def matrix_trip(s, d):
    cells = edges(s, d).select(F.col("src").alias("r"), F.col("dst").alias("c"), (F.col("src") / 4).alias("val"))
    n = vertices(s, d)
    return round_trip(s, files.matrix_market_lines(cells, n, n, cells.count()), files.read_matrix_market, "g.mmarket")


add("IO5_read_matrix_market", matrix_trip, f"WITH {EDGES} SELECT src, dst FROM e")
add("IO6_write_matrix_market", lambda s, d: files.matrix_market_lines(edges(s, d).select(F.col("src").alias("r"), F.col("dst").alias("c"), F.lit(2.0).alias("val")), 7, 8, 9), f"WITH {EDGES} SELECT 0 AS pos, '%%MatrixMarket matrix coordinate real general' AS value UNION ALL SELECT 1, '7 8 9' UNION ALL SELECT row_number() OVER (ORDER BY src, dst) + 1, (src + 1) || ' ' || (dst + 1) || ' 2.000000000000000' FROM e")


def matrices(s, d):
    """Each kind of matrix file, written and read back: (kind, r, c, re, im)."""
    cells = edges(s, d).select(F.col("src").alias("r"), F.col("dst").alias("c"), (F.col("src") / 4).alias("re"), (0 - F.col("dst") / 8).alias("im"))
    n, m = vertices(s, d), cells.count()
    out = None
    for kind in ("real", "complex", "integer", "pattern"):
        lines = files.matrix_lines(cells.withColumn("re", F.floor("re").cast("double")) if kind == "integer" else cells, n, n, m, kind)
        part = round_trip(s, lines, files.read_matrix, f"{kind}.mtx").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    dense = table(s, d, "orders").select((F.col("o_orderkey") % 4).alias("r"), F.floor(F.col("o_orderkey") / 4).cast("long").alias("c"), (F.col("o_custkey") / 2).alias("re"), F.lit(0.0).alias("im"))
    dense = dense.where(F.col("c") < F.lit(dense.count() // 4))
    lines = files.array_lines(dense, 4, dense.count() // 4, "real")
    return out.unionByName(round_trip(s, lines, files.read_matrix, "array.mtx").withColumn("kind", F.lit("array")))


add(
    "IO6_matrix_kinds",
    matrices,
    f"WITH {EDGES}, k AS (SELECT unnest(['real', 'complex', 'integer', 'pattern']) AS kind) SELECT kind, src AS r, dst AS c, CASE kind WHEN 'pattern' THEN 1.0::DOUBLE WHEN 'integer' THEN floor(src::DOUBLE / 4) ELSE src::DOUBLE / 4 END AS re, CASE kind WHEN 'complex' THEN 0 - dst::DOUBLE / 8 ELSE 0.0::DOUBLE END AS im FROM e, k "
    "UNION ALL SELECT 'array', o_orderkey % 4, o_orderkey // 4, o_custkey::DOUBLE / 2, 0.0::DOUBLE FROM orders WHERE o_orderkey // 4 < (SELECT count(*) // 4 FROM orders)",
)
add("IO7_graphviz", lambda s, d: files.graphviz_lines(edges(s, d)), f"WITH {EDGES} SELECT 0 AS pos, 'digraph {{' AS value UNION ALL SELECT row_number() OVER (ORDER BY src, dst), src || ' -> ' || dst || ';' FROM e UNION ALL SELECT count(*) + 1, '}}' FROM e")
WORDS = "w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\x00]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\x00]+'), lambda x: x <> ''), 1) AS j FROM documents)"
add("IO10_words", lambda s, d: files.words(table(s, d, "documents").select(F.col("doc_id").alias("line"), F.col("text").alias("value"))), f"WITH {WORDS} SELECT row_number() OVER (ORDER BY doc_id, j) - 1 AS pos, word FROM w")
ints = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"))
add("IO11_int_array", lambda s, d: round_trip(s, files.sequence_lines(ints(s, d), "sequenceInt"), files.read_sequence, "a"), "SELECT o_orderkey AS pos, o_custkey AS v FROM orders")
add("IO12_array_to_string", lambda s, d: files.sequence_lines(ints(s, d).withColumn("v", F.col("v") / 8), "sequenceDouble"), "SELECT 0 AS pos, 'sequenceDouble' AS value UNION ALL SELECT o_orderkey + 1, printf('%.11e', o_custkey::DOUBLE / 8) FROM orders")
add("IO13_sequence_pairs", lambda s, d: round_trip(s, files.sequence_lines(table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("first"), F.col("o_custkey").alias("second")), "sequenceStringIntPair"), files.read_sequence, "p"), "SELECT o_orderkey AS pos, o_orderstatus AS first, o_custkey AS second FROM orders")
pts = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") / 2).alias("y"))
add("IO14_points", lambda s, d: round_trip(s, files.point_lines(pts(s, d), 2), files.read_points, "q"), "SELECT o_orderkey AS id, o_totalprice AS x, o_custkey::DOUBLE / 2 AS y FROM orders")
add("IO16_point_text", lambda s, d: files.point_lines(pts(s, d).withColumn("x", F.col("id")).withColumn("y", F.col("id") * 2), 2), "SELECT 0 AS pos, 'pbbs_sequencePoint2d' AS value UNION ALL SELECT o_orderkey + 1, o_orderkey || ' ' || o_orderkey * 2 FROM orders")


def triangles(s, d):
    n = 300
    lines = [(0, "pbbs_triangles"), (1, str(n)), (2, "100"), *[(3 + i, f"{i} {i * i % 97}") for i in range(n)], *[(3 + n + i, f"{3 * i} {3 * i + 1} {3 * i + 2}") for i in range(100)]]
    return round_trip(s, s.createDataFrame(lines, "pos long, value string"), lambda s, p: files.read_triangles(s, p)[1], "t")


add("IO15_triangles", triangles, "SELECT range AS id, range * 3 AS c0, range * 3 + 1 AS c1, range * 3 + 2 AS c2 FROM range(100)")
constants = lambda s, d: table(s, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") / 4).alias("cst"))
add("IO19_constants", lambda s, d: files.parse_constants(files.constant_lines(constants(s, d).withColumn("name", F.translate("name", " ", "_")))), "SELECT replace(n_name, ' ', '_') AS name, n_nationkey::DOUBLE / 4 AS cst FROM nation")
add("IO20_tokenize_ids", lambda s, d: files.parse_snap(edge_lines(edges(s, d))), f"WITH {EDGES} SELECT src, dst FROM e")
