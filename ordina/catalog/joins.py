"""Queries of the joins that stand for pointer-chasing, and of the places where users' functions enter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays, containers, graph, numeric, sets, spatial
from ..plans import rounds
from ..plans import scan as plan
from ..sources import graphs
from .base import EVENTS, ORDERS, Catalog, events_seq, orders_seq, table
from .graphs import EDGES, adj_bin, edges
from .sequences import MATRIX, matrix
from .spatial import DIST, FORCE, KNN, knn, particles

CATALOG = Catalog()
add = CATALOG.add

# Joins

add("J1_gather", lambda s, d: orders_seq(s, d).withColumnRenamed("v", "at").join(events_seq(s, d).withColumnRenamed("pos", "at"), "at").select("pos", "v"), f"WITH {EVENTS}, {ORDERS} SELECT od.pos, ev.v FROM od JOIN ev ON ev.pos = od.v")
add("J2_frontier_expansion", lambda s, d: edges(s, d).join(s.range(0, 200).withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.count(F.lit(1)).alias("n")), f"WITH {EDGES} SELECT dst, count(*) AS n FROM e WHERE src < 200 GROUP BY 1")
add("J3_not_visited", lambda s, d: edges(s, d).select(F.col("dst").alias("id")).distinct().join(s.range(0, 1000), "id", "left_anti"), f"WITH {EDGES} SELECT DISTINCT dst AS id FROM e WHERE dst >= 1000")
add("J4_lookup", lambda s, d: sets.looked_up(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_nationkey")), "SELECT o_orderkey, o_custkey AS key, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
add("J5_range_join", lambda s, d: knn(spatial.nearest(particles(s, d), particles(s, d), 2)), KNN.format(DIST, 2))
add("J6_all_pairs_force", lambda s, d: spatial.exact_forces(particles(s, d)).select("id", F.round("fx", 3).alias("fx"), F.round("fy", 3).alias("fy")), FORCE)
add("J7_complete", lambda s, d: graphs.complete(s, 25).where("src < dst"), "SELECT a.range AS src, b.range AS dst FROM range(25) a, range(25) b WHERE a.range < b.range")
add("J8_matvec", lambda s, d: numeric.matvec(matrix(s, d), s.range(64).select(F.col("id").alias("c"), (F.col("id") * 3 - 90).alias("x"))), f"WITH {MATRIX} SELECT r, sum(val * (c * 3 - 90))::BIGINT AS v FROM mx GROUP BY 1")

# Users' functions

E_ = f"WITH {EVENTS}"
add("U2_predicate", lambda s, d: arrays.filtered(events_seq(s, d), lambda v: (v > 100) & (v % 3 == 0)), f"{E_} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, v FROM ev WHERE v > 100 AND v % 3 = 0")
add("U3_user_fold", lambda s, d: rounds.fold(events_seq(s, d), lambda a, b: b if b % 7 == 0 else a, 0, block=256), f"{E_} SELECT coalesce(max_by(v, pos) FILTER (WHERE v % 7 = 0 AND pos > 0), min_by(v, pos), 0) AS v FROM ev")
doubled_or_more = lambda items: items.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 3 + 1)).alias("id")).where("id <= 2000")
add("U13_worklist", lambda s, d: rounds.worklist(s.range(1, 2), doubled_or_more).select("id"), "WITH RECURSIVE w(id) AS (SELECT 1::BIGINT UNION SELECT x FROM (SELECT unnest([2 * id, 3 * id + 1]) AS x FROM w) t WHERE x <= 2000) SELECT id FROM w")
add("U4_measure_with_inverse", lambda s, d: containers.range_sum(events_seq(s, d), 50, 5000), f"{E_} SELECT sum(v)::BIGINT AS total FROM ev WHERE pos >= 50 AND pos < 5000")
add("U5_split_predicate", lambda s, d: arrays.measured_prefix(events_seq(s, d), F.col("v") * F.col("v") % 11, lambda m: m >= 2000), f"{E_}, x AS (SELECT pos, sum(v * v % 11) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ev) SELECT min(pos) FILTER (WHERE m >= 2000) AS pos FROM x")
add("U7_key_extractor", lambda s, d: arrays.stable_sort(orders_seq(s, d).withColumn("item", F.col("pos")), F.col("v") % 16).select("pos", "item"), f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY v % 16, pos) - 1 AS pos, pos AS item FROM od")
add("U8_hash_descriptor", lambda s, d: sets.upserted(table(s, d, "orders").select((F.col("o_custkey") % 100).alias("key"), "o_orderkey", "o_custkey"), "o_orderkey"), "SELECT o_custkey % 100 AS key, max(o_orderkey) AS o_orderkey, max_by(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY 1")
add("U10_table_function", lambda s, d: containers.produced(s, 300).unionByName(containers.stream(events_seq(s, d), lambda v: v * 2)), f"{E_} SELECT range AS pos, range * range % 1009 AS v FROM range(300) UNION ALL SELECT pos, v * 2 FROM ev")
add("U11_vertex_weight", lambda s, d: plan.scan(graph.both_degrees(edges(s, d)).withColumnRenamed("vertex", "pos"), "out_degree", plan.SUM, "weight").select("pos", "weight"), f"WITH {EDGES}, g AS (SELECT v AS pos, sum(o) AS o FROM (SELECT src AS v, 1 AS o FROM e UNION ALL SELECT dst, 0 FROM e) GROUP BY 1) SELECT pos, (sum(o) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS weight FROM g")

# Formats and views

add("IO2_write_adj_bin", adj_bin, f"WITH {EDGES} SELECT src, dst FROM e")


def aliased(s, d):
    edges(s, d).createOrReplaceTempView("ordina_edges")
    return s.table("ordina_edges").groupBy("src").agg(F.max("dst").alias("last"))


add("G4_alias_view", aliased, f"WITH {EDGES} SELECT src, max(dst) AS last FROM e GROUP BY 1")
add("G24_mark_once", lambda s, d: graph.edge_map(edges(s, d), s.range(0, 50), s.range(0, 50)), f"WITH {EDGES} SELECT DISTINCT dst AS id FROM e WHERE src < 50 AND dst >= 50")
