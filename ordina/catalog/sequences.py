"""Queries on sequences: projections, reductions, scans, order, sets, containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import arrays, buffers, containers, numeric, sets
from ..plans import scan as plan
from .base import EVENTS, ORDERS, Catalog, events_seq, orders_seq, table

CATALOG = Catalog()
add = CATALOG.add
even = lambda v: v % 2 == 0
E_, O_ = f"WITH {EVENTS}", f"WITH {ORDERS}"


def flags(spark, d):
    return events_seq(spark, d).select("pos", even(F.col("v")).alias("flag"))


# Projections, reshaping, filters

add("P1_map", lambda s, d: arrays.mapped(events_seq(s, d), lambda v: v * 2 + 1), f"{E_} SELECT pos, v * 2 + 1 AS v FROM ev")
add("P2_map_pair", lambda s, d: arrays.map_pair(events_seq(s, d), orders_seq(s, d), lambda a, b: a - b), f"{E_}, {ORDERS} SELECT ev.pos, ev.v - od.v AS v FROM ev JOIN od USING (pos)")
add("P3_slice", lambda s, d: arrays.sliced(events_seq(s, d), 100, 700), f"{E_} SELECT pos - 100 AS pos, v FROM ev WHERE pos >= 100 AND pos < 700")
add("P4_take", lambda s, d: arrays.take(events_seq(s, d), 500), f"{E_} SELECT pos, v FROM ev WHERE pos < 500")
add("P4_drop", lambda s, d: arrays.drop(events_seq(s, d), 500), f"{E_} SELECT pos - 500 AS pos, v FROM ev WHERE pos >= 500")
add("P5_copy", events_seq, f"{E_} SELECT pos, v FROM ev")
add("P6_duplicate", lambda s, d: arrays.duplicate(events_seq(s, d)), f"{E_} SELECT pos * 2 + j AS pos, v FROM ev, range(2) t(j)")
add("P7_ktimes", lambda s, d: arrays.ktimes(events_seq(s, d), 3), f"{E_} SELECT pos * 3 + j AS pos, v FROM ev, range(3) t(j)")
FILTERED = f"{E_} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, v FROM ev WHERE v % 2 = 0"
add("P8_filter", lambda s, d: arrays.filtered(events_seq(s, d), even), FILTERED)
add("P9_pack", lambda s, d: arrays.pack(flags(s, d), events_seq(s, d)), FILTERED)
add("P10_pack_stable", lambda s, d: plan.reindexed(events_seq(s, d).where(even(F.col("v")))), FILTERED)


def pack2(s, d):
    low, high = arrays.two_sided(events_seq(s, d), lambda v: F.lit(0) - v, lambda v: v - 100)
    return low.withColumn("side", F.lit(1)).unionByName(high.withColumn("side", F.lit(2)))


PACK2 = f"{E_} SELECT 1 AS side, row_number() OVER (ORDER BY pos) - 1 AS pos, v FROM ev WHERE v < 0 UNION ALL SELECT 2, row_number() OVER (ORDER BY pos) - 1, v FROM ev WHERE v > 100"
add("P11_pack2", pack2, PACK2)
add("P12_pack_index", lambda s, d: arrays.pack_index(flags(s, d)), f"{E_} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, pos AS v FROM ev WHERE v % 2 = 0")
add("P13_filter_stable", lambda s, d: arrays.filtered(events_seq(s, d), lambda v: v > 0), f"{E_} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, v FROM ev WHERE v > 0")
add(
    "P14_enumerate",
    lambda s, d: arrays.enumerated(flags(s, d)),
    f"{E_} SELECT pos, v % 2 = 0 AS flag, coalesce(sum((v % 2 = 0)::BIGINT) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM ev",
)
add("P15_sum_flags", lambda s, d: flags(s, d).agg(F.count_if("flag").alias("n")), f"{E_} SELECT count(*) FILTER (WHERE v % 2 = 0) AS n FROM ev")
add("P16_pkeep_if", lambda s, d: containers.keep_if(events_seq(s, d), lambda v: v % 2 != 0), f"{E_} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, v FROM ev WHERE v % 2 <> 0")
add(
    "P17_pcopy_if",
    lambda s, d: arrays.concat(arrays.take(orders_seq(s, d), 100), arrays.filtered(events_seq(s, d), even)),
    f"{E_}, {ORDERS} SELECT pos, v FROM od WHERE pos < 100 UNION ALL SELECT 100 + row_number() OVER (ORDER BY pos) - 1, v FROM ev WHERE v % 2 = 0",
)
add("P18_split_two_sided", pack2, PACK2)


def matrix(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "x")).select("r", F.col("c").cast("long").alias("c"), F.round(F.col("x").cast("double") * 1000).cast("long").alias("val"))


MATRIX = "mx AS (SELECT vec_id AS r, (generate_subscripts(embedding, 1) - 1)::BIGINT AS c, round(unnest(embedding)::DOUBLE * 1000)::BIGINT AS val FROM embeddings)"
add("P19_transpose", lambda s, d: arrays.transposed(matrix(s, d)), f"WITH {MATRIX} SELECT c AS r, r AS c, val FROM mx")


def ragged(s, d):
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("r"), F.col("l_linenumber").alias("c"), F.struct("l_orderkey", "l_partkey").alias("i"), F.col("l_quantity").cast("long").alias("v"))


add(
    "P20_block_transpose",
    lambda s, d: arrays.block_transposed(ragged(s, d).groupBy("r", "c", "i").agg(F.sum("v").alias("v"))),
    """SELECT row_number() OVER (ORDER BY c, r, o, p) - 1 AS pos, v FROM (SELECT l_suppkey AS r, l_linenumber AS c, l_orderkey AS o, l_partkey AS p, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)""",
)
add("P21_out_degrees", lambda s, d: table(s, d, "lineitem").where("l_orderkey <> -1").groupBy(F.col("l_orderkey").alias("vertex")).agg(F.count(F.lit(1)).alias("degree")), "SELECT l_orderkey AS vertex, count(*) AS degree FROM lineitem WHERE l_orderkey <> -1 GROUP BY 1")
add(
    "P22_functors",
    lambda s, d: events_seq(s, d).select("pos", *[f(F.col("v"), F.col("pos")).alias(n) for n, f in scalars.FUNCTORS.items()]),
    f"{E_} SELECT pos, v AS identity, v + pos AS add, abs(v) AS abs, 0 AS zero, greatest(v, pos) AS max, least(v, pos) AS min, v AS first, pos AS second FROM ev",
)
add("P23_lambdas", lambda s, d: events_seq(s, d).select("pos", (F.col("v") + 1).alias("plus1"), (even(F.col("v")) & (F.col("v") > 0)).alias("both"), even(F.col("v")).cast("long").alias("is_even")), f"{E_} SELECT pos, v + 1 AS plus1, v % 2 = 0 AND v > 0 AS both, (v % 2 = 0)::BIGINT AS is_even FROM ev")

# Reductions

add("A1_reduce", lambda s, d: arrays.reduced(events_seq(s, d), plan.SUM, lambda v: v * v), f"{E_} SELECT coalesce(sum(v * v), 0)::BIGINT AS v FROM ev")
add("A2_sum_max_min", lambda s, d: events_seq(s, d).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("sum"), F.coalesce(F.max("v"), F.lit(arrays.VALUE_MIN)).alias("max"), F.coalesce(F.min("v"), F.lit(arrays.VALUE_MAX)).alias("min")), f"{E_} SELECT coalesce(sum(v), 0)::BIGINT AS sum, coalesce(max(v), -9223372036854775807 - 1) AS max, coalesce(min(v), 9223372036854775807) AS min FROM ev")
add("A3_reduce_nonempty", lambda s, d: events_seq(s, d).agg(F.min("v").alias("v")), f"{E_} SELECT min(v) AS v FROM ev")
add("A4_plus_max_reduce", lambda s, d: events_seq(s, d).agg(F.sum("v").alias("plus"), F.max("v").alias("max")), f"{E_} SELECT sum(v)::BIGINT AS plus, max(v) AS max FROM ev")
add("A5_map_reduce", lambda s, d: arrays.reduced(events_seq(s, d), plan.MAX, lambda v: F.abs(v) % 977), f"{E_} SELECT max(abs(v) % 977) AS v FROM ev")
add("A6_max_index", lambda s, d: arrays.max_index(events_seq(s, d)), f"{E_} SELECT min(pos) AS pos, v FROM ev WHERE v = (SELECT max(v) FROM ev) GROUP BY v")
add("A11_reduce_atomic", lambda s, d: arrays.reduced(orders_seq(s, d), plan.SUM), f"{O_} SELECT sum(v)::BIGINT AS v FROM od")
add("A12_partial_final", lambda s, d: containers.combined_partials(events_seq(s, d)), f"{E_} SELECT sum(v)::BIGINT AS total, count(*) AS n FROM ev")
add("A13_combine", lambda s, d: containers.flat_mapped(events_seq(s, d), lambda pos: pos % 4), f"{E_}, x AS (SELECT pos AS i, unnest(range(0, pos % 4)) AS j, v FROM ev) SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, v + j AS v FROM x")
add("A14_container_combine", lambda s, d: containers.flat_mapped(events_seq(s, d), lambda pos: F.lit(2)), f"{E_}, x AS (SELECT pos AS i, unnest(range(0, 2)) AS j, v FROM ev) SELECT row_number() OVER (ORDER BY i, j) - 1 AS pos, v + j AS v FROM x")
add("A15_weighted_size", lambda s, d: events_seq(s, d).agg(F.sum(F.abs("v") % 7).alias("weight")), f"{E_} SELECT sum(abs(v) % 7)::BIGINT AS weight FROM ev")
add("A19_bucket_offsets", lambda s, d: arrays.next_nonempty(table(s, d, "lineitem").groupBy((F.col("l_quantity").cast("long") * 2).alias("key")).agg(F.count(F.lit(1)).alias("n")), 104), "WITH k AS (SELECT range AS key FROM range(104)), c AS (SELECT (l_quantity::BIGINT) * 2 AS key, count(*) AS n FROM lineitem GROUP BY 1) SELECT k.key, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k LEFT JOIN c ON k.key = c.key")
add(
    "A20_speedup",
    lambda s, d: numeric.speedups(table(s, d, "lineitem").select(F.col("l_linenumber").alias("workers"), F.col("l_quantity").cast("long").alias("t"))),
    "WITH m AS (SELECT l_linenumber AS workers, sum(l_quantity::BIGINT)::BIGINT AS total, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT total AS t1, n AS n1 FROM m WHERE workers = (SELECT min(workers) FROM m)) SELECT workers, round((t1::DOUBLE / n1) / (total::DOUBLE / n), 6) AS speedup FROM m, b",
)
add(
    "A21_list_stats",
    lambda s, d: events_seq(s, d).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 3).alias("stddev"), F.percentile("v", 0.5).alias("median"), F.max("v").alias("max"), F.min("v").alias("min")),
    f"{E_} SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 3) AS stddev, quantile_cont(v, 0.5)::DOUBLE AS median, max(v) AS max, min(v) AS min FROM ev",
)

# Scans

W_ = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
add("W1_scan_incl", lambda s, d: plan.scan(events_seq(s, d), "v", plan.SUM), f"{E_} SELECT pos, v, (sum(v) OVER (ORDER BY pos {W_} CURRENT ROW))::BIGINT AS s FROM ev")
add("W1_scan_incl_max", lambda s, d: plan.scan(events_seq(s, d), "v", plan.MAX), f"{E_} SELECT pos, v, max(v) OVER (ORDER BY pos {W_} CURRENT ROW) AS s FROM ev")


def scan_excl(s, d):
    xs = events_seq(s, d)
    return plan.scan(xs, "v", plan.SUM, inclusive=False).crossJoin(F.broadcast(xs.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("total"))))


add("W2_scan_excl", scan_excl, f"{E_} SELECT pos, v, coalesce(sum(v) OVER (ORDER BY pos {W_} 1 PRECEDING), 0)::BIGINT AS s, (SELECT sum(v)::BIGINT FROM ev) AS total FROM ev")
add("W3_prefix_sums", lambda s, d: plan.scan(plan.scan(orders_seq(s, d), "v", plan.SUM, "excl", inclusive=False), "v", plan.SUM, "incl"), f"{O_} SELECT pos, v, coalesce(sum(v) OVER (ORDER BY pos {W_} 1 PRECEDING), 0)::BIGINT AS excl, (sum(v) OVER (ORDER BY pos {W_} CURRENT ROW))::BIGINT AS incl FROM od")


def four_scans(s, d):
    xs = events_seq(s, d)
    for name, inclusive, back in (("ff", False, False), ("fi", True, False), ("be", False, True), ("bi", True, True)):
        xs = plan.scan(xs, "v", plan.SUM, name, inclusive=inclusive, back=back)
    return xs


add("W4_scan_modes", four_scans, f"{E_} SELECT pos, v, coalesce(sum(v) OVER (ORDER BY pos {W_} 1 PRECEDING), 0)::BIGINT AS ff, (sum(v) OVER (ORDER BY pos {W_} CURRENT ROW))::BIGINT AS fi, coalesce(sum(v) OVER (ORDER BY pos DESC {W_} 1 PRECEDING), 0)::BIGINT AS be, (sum(v) OVER (ORDER BY pos DESC {W_} CURRENT ROW))::BIGINT AS bi FROM ev")
add("W5_scan_back", lambda s, d: plan.scan(events_seq(s, d), "v", plan.MAX, back=True), f"{E_} SELECT pos, v, max(v) OVER (ORDER BY pos DESC {W_} CURRENT ROW) AS s FROM ev")
add("W6_suffix_min", lambda s, d: plan.scan(events_seq(s, d), "v", plan.MIN, back=True), f"{E_} SELECT pos, v, min(v) OVER (ORDER BY pos DESC {W_} CURRENT ROW) AS s FROM ev")
MCSS = f"{E_}, p AS (SELECT pos, sum(v) OVER (ORDER BY pos {W_} CURRENT ROW) AS s FROM ev), q AS (SELECT s, coalesce(min(s) OVER (ORDER BY pos {W_} 1 PRECEDING), 0) AS m FROM p) SELECT max(s - least(m, 0))::BIGINT AS mcss FROM q"
add("W7_mcss", lambda s, d: arrays.mcss(events_seq(s, d)), MCSS)


def parens(s, d):
    return events_seq(s, d).select("pos", F.when(F.col("v") % 2 == 0, "(").otherwise(")").alias("c")).select("pos", "c", scalars.paren_value(F.col("c")).alias("v"))


P_ = f"{E_}, pa AS (SELECT pos, CASE WHEN v % 2 = 0 THEN '(' ELSE ')' END AS c, CASE WHEN v % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS v FROM ev)"
add("W8_nesting_depth", lambda s, d: plan.scan(parens(s, d), "v", plan.SUM, "depth", inclusive=False), f"{P_} SELECT pos, c, v, coalesce(sum(v) OVER (ORDER BY pos {W_} 1 PRECEDING), 0)::BIGINT AS depth FROM pa")
add("W9_matching_parens", lambda s, d: scalars.matching(parens(s, d)), f"{P_}, x AS (SELECT coalesce(sum(v) OVER (ORDER BY pos {W_} 1 PRECEDING), 0) AS s, v FROM pa) SELECT bool_and(s >= 0) AND sum(v) = 0 AS matching FROM x")
add("W10_measured_prefix", lambda s, d: arrays.measured_prefix(events_seq(s, d), F.abs("v") % 10, lambda m: m > 1000), f"{E_}, x AS (SELECT pos, sum(abs(v) % 10) OVER (ORDER BY pos {W_} CURRENT ROW) AS m FROM ev) SELECT min(pos) FILTER (WHERE m > 1000) AS pos FROM x")
add("W11_size_scan", lambda s, d: plan.scan(events_seq(s, d).where("v > 0"), F.lit(1), plan.COUNT, "size"), f"{E_} SELECT pos, v, row_number() OVER (ORDER BY pos) AS size FROM ev WHERE v > 0")

# Order

SORTED = f"{E_} SELECT row_number() OVER (ORDER BY v) - 1 AS pos, v FROM ev"
for name in ("O1_sort", "O2_quicksort", "O3_mergesort", "O4_mergesort_seq", "O5_mergesort_ex", "O6_cilksort", "O10_sample_sort", "O11_quick_sort_pbbs"):
    # One range-partitioned sort serves all: their results are the same.
    add(name, lambda s, d: arrays.sort(events_seq(s, d)), SORTED)


def halves(s, d):
    xs = events_seq(s, d)
    return arrays.sort(xs.where("pos % 2 = 0")), arrays.sort(xs.where("pos % 2 = 1"))


add("O7_merge", lambda s, d: arrays.merge(*halves(s, d)), SORTED)
add("O8_cilkmerge", lambda s, d: arrays.merge(*halves(s, d)), SORTED)
add("O9_lower_bound", lambda s, d: arrays.lower_bound(arrays.sort(events_seq(s, d)), 0), f"{E_} SELECT count(*) FILTER (WHERE v < 0) AS pos FROM ev")
add("O12_radix_sort", lambda s, d: arrays.stable_sort(table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("long").alias("key")).groupBy("pos", "key").count().select("pos", "key", F.col("pos").alias("item")), "key"), "WITH l AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS pos, l_quantity::BIGINT AS key FROM lineitem) SELECT row_number() OVER (ORDER BY key, pos) - 1 AS pos, key, pos AS item FROM l")
add("O13_payload_sort", lambda s, d: arrays.stable_sort(table(s, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_totalprice", F.col("o_orderkey").alias("item")), "o_totalprice"), "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_totalprice, o_orderkey AS item FROM orders")
add("O14_string_sort", lambda s, d: arrays.sort(table(s, d, "part").select(F.lit(0).alias("pos"), F.col("p_name").alias("v"))), "SELECT row_number() OVER (ORDER BY p_name) - 1 AS pos, p_name AS v FROM part")

# Concatenation, sets and dedup

add("C1_concat", lambda s, d: arrays.concat(events_seq(s, d), orders_seq(s, d), events_seq(s, d)), f"{E_}, {ORDERS}, n AS (SELECT (SELECT count(*) FROM ev) AS e, (SELECT count(*) FROM od) AS o) SELECT pos, v FROM ev UNION ALL SELECT pos + e, v FROM od, n UNION ALL SELECT pos + e + o, v FROM ev, n")
DISTINCT = f"{O_} SELECT DISTINCT v FROM od"
add("DD1_remove_duplicates", lambda s, d: sets.distinct(orders_seq(s, d).select("v")), DISTINCT)
add("DD2_remove_duplicates_int", lambda s, d: sets.distinct(orders_seq(s, d).select("v")), DISTINCT)
add("DD3_remove_duplicates_string", lambda s, d: sets.distinct(table(s, d, "orders").select(F.col("o_orderpriority").alias("v"))), "SELECT DISTINCT o_orderpriority AS v FROM orders")
add("DD4_remove_duplicates_pair", lambda s, d: sets.largest_wins(table(s, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("second"))), "SELECT o_orderpriority AS key, max(o_custkey) AS second FROM orders GROUP BY 1")
EDGES = "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem"


def raw_edges(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


add("DD5_remove_duplicates_edge", lambda s, d: sets.distinct(raw_edges(s, d)), EDGES)
add("DD6_edge_list_dedup", lambda s, d: sets.distinct(raw_edges(s, d)).agg(F.count(F.lit(1)).alias("nb_edges"), (F.max(F.greatest("src", "dst")) + 1).alias("nb_vertices")), f"WITH e AS ({EDGES}) SELECT count(*) AS nb_edges, max(greatest(src, dst)) + 1 AS nb_vertices FROM e")


def hash_table(s, d):
    items = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    held = sets.upserted(items, "value")
    gone = sets.deleted(held, table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("key")))
    return sets.looked_up(table(s, d, "customer").select(F.col("c_custkey").alias("key")), gone)


add("DD7_hash_table", hash_table, "SELECT c_custkey AS key, max(o_orderkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_nationkey <> 3 GROUP BY 1")
add("DD8_edges_equal", lambda s, d: sets.same_multiset(raw_edges(s, d), raw_edges(s, d).orderBy("dst")), "SELECT true AS same")
add("DD9_adjacency_equal", lambda s, d: sets.same_multiset(sets.distinct(raw_edges(s, d)), raw_edges(s, d)), f"SELECT (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM ({EDGES})) AS same")
add(
    "DD10_list_helpers",
    lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linenumber").alias("a"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("b")).select(
        "l_suppkey", *[F.array_join(F.array_sort(x), ",").alias(n) for n, x in (("minus", F.array_except("a", "b")), ("inter", F.array_intersect("a", "b")))], (F.size(F.array_except("b", "a")) == 0).alias("included")
    ),
    """WITH g AS (SELECT l_suppkey, list_distinct(list(l_linenumber)) AS a, coalesce(list_distinct(list(l_linenumber) FILTER (WHERE l_returnflag = 'R')), []) AS b FROM lineitem GROUP BY 1)
    SELECT l_suppkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS minus, array_to_string(list_sort(list_intersect(a, b)), ',') AS inter, true AS included FROM g""",
)
add("DD10_cartesian", lambda s, d: table(s, d, "region").select("r_name").crossJoin(F.broadcast(table(s, d, "nation").select("n_name"))), "SELECT r_name, n_name FROM region, nation")

# Containers

seq = events_seq
SQ = f"{E_}, sq AS (SELECT pos, v FROM ev), nn AS (SELECT count(*) AS n FROM ev)"
add("Q1_construct", lambda s, d: containers.filled(s, 50, 7).withColumn("of", F.lit("fill")).unionByName(seq(s, d).withColumn("of", F.lit("copy"))), f"{SQ} SELECT 'fill' AS of, range AS pos, 7 AS v FROM range(50) UNION ALL SELECT 'copy', pos, v FROM sq")
add("Q2_size", lambda s, d: containers.size(seq(s, d)), f"{SQ} SELECT count(*) AS size, count(*) = 0 AS empty FROM sq")
add("Q3_front_back", lambda s, d: containers.ends(seq(s, d)), f"{SQ} SELECT min_by(v, pos) AS front, max_by(v, pos) AS back FROM sq")
add("Q4_index_read_write", lambda s, d: containers.put(seq(s, d), 7, -1), f"{SQ} SELECT pos, CASE WHEN pos = 7 THEN -1 ELSE v END AS v FROM sq")
add("Q5_push", lambda s, d: containers.push_back(containers.push_front(seq(s, d), -5), -6), f"{SQ} SELECT pos + 1 AS pos, v FROM sq UNION ALL SELECT 0, -5 UNION ALL SELECT n + 1, -6 FROM nn")
add("Q6_pop", lambda s, d: containers.popn_back(containers.popn_front(seq(s, d), 1)[1], 1)[1], f"{SQ} SELECT pos - 1 AS pos, v FROM sq, nn WHERE pos BETWEEN 1 AND n - 2")
add("Q7_pushn", lambda s, d: arrays.concat(arrays.take(orders_seq(s, d), 20), seq(s, d), arrays.take(orders_seq(s, d), 30)), f"{SQ}, {ORDERS} SELECT pos, v FROM od WHERE pos < 20 UNION ALL SELECT pos + 20, v FROM sq UNION ALL SELECT pos + 20 + n, v FROM od, nn WHERE pos < 30")
add("Q8_popn", lambda s, d: containers.popn_back(seq(s, d), 300)[0].withColumn("of", F.lit("out")).unionByName(containers.popn_back(seq(s, d), 300)[1].withColumn("of", F.lit("left"))), f"{SQ} SELECT CASE WHEN pos < n - 300 THEN pos ELSE pos - (n - 300) END AS pos, v, CASE WHEN pos < n - 300 THEN 'left' ELSE 'out' END AS of FROM sq, nn")
add("Q9_frontn_backn", lambda s, d: containers.frontn(seq(s, d), 5).withColumn("of", F.lit("front")).unionByName(containers.backn(seq(s, d), 5).withColumn("of", F.lit("back"))), f"{SQ} SELECT pos, v, 'front' AS of FROM sq WHERE pos < 5 UNION ALL SELECT pos - (n - 5), v, 'back' FROM sq, nn WHERE pos >= n - 5")
add("Q10_stream_backn", lambda s, d: containers.stream(seq(s, d), lambda v: v * 3), f"{SQ} SELECT pos, v * 3 AS v FROM sq")
add("Q11_stream_pushn", lambda s, d: containers.produced(s, 500), "SELECT range AS pos, range * range % 1009 AS v FROM range(500)")
add("Q12_stream_popn", lambda s, d: containers.stream(containers.popn_front(seq(s, d), 250)[0], lambda v: v + 1), f"{SQ} SELECT pos, v + 1 AS v FROM sq WHERE pos < 250")
add("Q13_concat", lambda s, d: arrays.concat(seq(s, d), arrays.take(orders_seq(s, d), 10)), f"{SQ}, {ORDERS} SELECT pos, v FROM sq UNION ALL SELECT pos + n, v FROM od, nn WHERE pos < 10")
SPLIT = "SELECT CASE WHEN pos < {0} THEN 0 ELSE 1 END AS part, CASE WHEN pos < {0} THEN pos ELSE pos - {0} END AS pos, v FROM sq"
add("Q14_split", lambda s, d: containers.tagged(containers.split(seq(s, d), 333)), f"{SQ} {SPLIT.format(333)}")
add("Q15_split_approximate", lambda s, d: containers.tagged(containers.split_half(seq(s, d))), f"{SQ} {SPLIT.format("n // 2")}, nn")
add("Q16_split_by_predicate", lambda s, d: containers.tagged(containers.split_by(seq(s, d), F.abs("v") % 10, lambda m: m > 1000)), f"{SQ}, x AS (SELECT pos, v, sum(abs(v) % 10) OVER (ORDER BY pos) AS m FROM sq), c AS (SELECT coalesce(min(pos) FILTER (WHERE m > 1000), (SELECT n FROM nn)) AS i FROM x) SELECT CASE WHEN pos < i THEN 0 ELSE 1 END AS part, CASE WHEN pos < i THEN pos ELSE pos - i END AS pos, v FROM sq, c")
add("Q17_split_middle", lambda s, d: containers.split_middle(seq(s, d), F.abs("v") % 10, lambda m: m > 1000), f"{SQ}, x AS (SELECT pos, v, sum(abs(v) % 10) OVER (ORDER BY pos) AS m FROM sq), c AS (SELECT min(pos) FILTER (WHERE m > 1000) AS i FROM x) SELECT CASE WHEN i IS NULL OR pos < i THEN 'left' WHEN pos = i THEN 'middle' ELSE 'right' END AS part, CASE WHEN i IS NULL OR pos < i THEN pos WHEN pos = i THEN 0 ELSE pos - i - 1 END AS pos, v FROM sq, c")
add("Q18_insert_erase", lambda s, d: containers.erase(containers.insert(seq(s, d), 10, -9), 100, 200), f"{SQ}, i AS (SELECT CASE WHEN pos < 10 THEN pos ELSE pos + 1 END AS pos, v FROM sq UNION ALL SELECT 10, -9) SELECT CASE WHEN pos < 100 THEN pos ELSE pos - 100 END AS pos, v FROM i WHERE pos < 100 OR pos >= 200")
add("Q19_clear_swap", lambda s, d: containers.swapped(seq(s, d).where("pos < 0"), arrays.take(orders_seq(s, d), 5)), f"{O_} SELECT 'first' AS of, pos, v FROM od WHERE pos < 5")
add("Q20_search_by", lambda s, d: arrays.measured_prefix(seq(s, d), F.lit(1), lambda m: m > 123), "SELECT 123 AS pos")
add("Q21_for_each", lambda s, d: containers.stream(seq(s, d), lambda v: 0 - v), f"{SQ} SELECT pos, -v AS v FROM sq")
add("Q22_cached_measure", lambda s, d: seq(s, d).agg(F.sum(F.abs("v") % 10).alias("weight"), F.count(F.lit(1)).alias("size")), f"{SQ} SELECT sum(abs(v) % 10)::BIGINT AS weight, count(*) AS size FROM sq")
add("Q23_to_array", lambda s, d: containers.to_array(seq(s, d)), f"{SQ} SELECT string_agg(v::VARCHAR, ',' ORDER BY pos) AS items FROM sq")


def buffered(s, d):
    """Two buffers of 1000: the ends of one change, and its last items move to the other, which is full then."""
    one = buffers.Buffer(containers.frontn(seq(s, d), 990), 1000).push_front(-1).push_back(-2)
    two = buffers.Buffer(containers.frontn(orders_seq(s, d), 700), 1000)
    one, two = one.transfer_back_to_front(two, 300)
    out = one.items.select(F.lit("one").alias("of"), "pos", "v").unionByName(two.items.select(F.lit("two").alias("of"), "pos", "v"))
    return out.join(two.state().select(F.lit("two").alias("of"), "full"), "of", "left")


add(
    "Q25_fixed_capacity",
    buffered,
    f"{SQ}, {ORDERS}, o AS (SELECT pos + 1 AS pos, v FROM sq WHERE pos < 990 UNION ALL SELECT 0, -1 UNION ALL SELECT 991, -2) SELECT 'one' AS of, pos, v, NULL::BOOLEAN AS full FROM o WHERE pos < 692 UNION ALL SELECT 'two', pos - 692, v, true FROM o WHERE pos >= 692 UNION ALL SELECT 'two', pos + 300, v, true FROM od WHERE pos < 700",
)
add("Q27_measures", lambda s, d: seq(s, d).agg(*[F.sum(m(F.col("v"))).alias(n) for n, m in containers.MEASURES.items()]), f"{SQ} SELECT 0::BIGINT AS trivial, count(*) AS uniform, sum(abs(v) % 10)::BIGINT AS weight FROM sq")
add("Q28_algebra_inverse", lambda s, d: containers.range_sum(seq(s, d), 100, 900), f"{SQ} SELECT sum(v)::BIGINT AS total FROM sq WHERE pos >= 100 AND pos < 900")
add("Q29_cached_combiner", lambda s, d: plan.scan(plan.scan(seq(s, d), F.lit(1), plan.COUNT, "size"), F.abs("v") % 10, plan.SUM, "weight"), f"{SQ} SELECT pos, v, row_number() OVER (ORDER BY pos) AS size, (sum(abs(v) % 10) OVER (ORDER BY pos))::BIGINT AS weight FROM sq")

ITEMS = "m AS (SELECT o_custkey AS key, max_by(o_orderkey * 3, o_orderkey) AS value FROM orders GROUP BY 1)"


def ordered_map(s, d):
    return containers.upserts(table(s, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") * 3).alias("value"), F.col("o_orderkey").alias("seq")))


add("M1_upsert", ordered_map, f"WITH {ITEMS} SELECT key, value FROM m")
add("M2_find", lambda s, d: sets.looked_up(s.range(-5, 50).withColumnRenamed("id", "key"), ordered_map(s, d)), f"WITH {ITEMS} SELECT r.range AS key, m.value FROM range(-5, 50) r LEFT JOIN m ON m.key = r.range")
add("M3_erase", lambda s, d: sets.deleted(ordered_map(s, d), s.range(0, 700).withColumnRenamed("id", "key")), f"WITH {ITEMS} SELECT key, value FROM m WHERE key >= 700")
add("M4_stream", lambda s, d: plan.positioned(ordered_map(s, d), F.col("key").desc()), f"WITH {ITEMS} SELECT row_number() OVER (ORDER BY key DESC) - 1 AS pos, key, value FROM m")
add("M5_take_right", lambda s, d: plan.scan(events_seq(s, d).withColumn("k", F.when(F.col("v") % 5 == 0, F.col("v"))), "k", plan.LAST), f"{E_}, x AS (SELECT pos, v, CASE WHEN v % 5 = 0 THEN v END AS k FROM ev) SELECT pos, v, k, last_value(k IGNORE NULLS) OVER (ORDER BY pos {W_} CURRENT ROW) AS s FROM x")

# Numbers

add("N1_ddotprod", lambda s, d: numeric.dots(table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("row"))), f"WITH {MATRIX} SELECT r AS vec_id, sum(val * (c + 1))::BIGINT AS dot FROM mx GROUP BY 1")
add("N2_dmdvmult", lambda s, d: numeric.matvec(matrix(s, d), s.range(64).select(F.col("id").alias("c"), (F.col("id") % 7 - 3).alias("x"))), f"WITH {MATRIX} SELECT r, sum(val * (c % 7 - 3))::BIGINT AS v FROM mx GROUP BY 1")

# User-defined parts

add("U1_scalar_fn", lambda s, d: arrays.mapped(events_seq(s, d), lambda v: F.pmod(v * 7, F.lit(13))), f"{E_} SELECT pos, ((v * 7) % 13 + 13) % 13 AS v FROM ev")
add("U3_custom_monoid", lambda s, d: containers.string_compare_scan(table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("a"), F.col("p_type").alias("b"))), "SELECT coalesce(min_by(c, pos), 0) AS result FROM (SELECT p_partkey AS pos, CASE WHEN left(p_name, least(length(p_name), length(p_type))) < left(p_type, least(length(p_name), length(p_type))) THEN -1 WHEN left(p_name, least(length(p_name), length(p_type))) > left(p_type, least(length(p_name), length(p_type))) THEN 1 ELSE 0 END AS c FROM part) WHERE c <> 0")
add("U6_comparator_sort", lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)), ",").alias("names")), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY length(n_name), n_name) AS names FROM nation GROUP BY 1")
add("U9_node_monoid", lambda s, d: table(s, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low")), "SELECT floor(l_quantity / 10)::BIGINT AS cell, count(*) AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1")
add("U12_forkjoin", lambda s, d: containers.fork_join(events_seq(s, d)), f"{E_} SELECT string_agg(m::VARCHAR, ',' ORDER BY b) AS maxima FROM (SELECT pos // 1000 AS b, max(v) AS m FROM ev GROUP BY 1)")
