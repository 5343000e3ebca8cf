"""Graph operators over edges (src, dst). Vertices that have no edge are given by their number.

Traversals are loops on the driver over distributed frontiers: each level joins the frontier with
the edges, drops what has been visited, and is written to the shared folder, so that plans stay
short and no level is computed twice. Only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scan as plan
from ..plans.scratch import scratch_path, scratch_scope, written


def vertex_count(graph: DataFrame) -> DataFrame:
    return graph.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("nb_vertices"))


def adjacency(graph: DataFrame) -> DataFrame:
    """src -> its targets in ascending order; a multigraph keeps repeats."""
    return graph.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("out"))


def offsets(graph: DataFrame, n: int) -> DataFrame:
    """Row offsets of a compressed adjacency: (vertex, degree, offset)."""
    degree = degrees(graph, n).select(F.col("vertex").alias("pos"), "degree")
    return plan.scan(degree, "degree", plan.SUM, "offset", inclusive=False).withColumnRenamed("pos", "vertex")


def edge_list(adjacent: DataFrame) -> DataFrame:
    return adjacent.select("src", F.posexplode("out").alias("j", "dst"))


def degrees(graph: DataFrame, n: int) -> DataFrame:
    """Out-degrees of vertices 0 .. n-1."""
    counted = graph.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.sparkSession.range(n).withColumnRenamed("id", "vertex").join(counted, "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0)).alias("degree"))


def both_degrees(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.select(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("vertex").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def symmetric(graph: DataFrame) -> DataFrame:
    return graph.unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def validated(graph: DataFrame, n: int) -> DataFrame:
    """One row: are all ids in range?"""
    wrong = ~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)
    return graph.agg((F.count_if(wrong) == 0).alias("ok"), F.count(F.lit(1)).alias("nb_edges"))


def edge_map(graph: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Targets (id) of the frontier (id) that are not visited (id)."""
    reached = graph.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return reached.join(visited, "id", "left_anti")


#: Tables of levels that are kept apart.
MERGED = 16


class Levels:
    """Levels of a traversal: written tables (id, dist), the size of each, and edges looked at."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.sizes = spark, [], []

    def add(self, level: DataFrame, dist: int) -> int:
        path = scratch_path(self.spark, "level")
        level.select("id", F.lit(dist).cast("long").alias("dist")).write.parquet(path)
        n = self.spark.read.schema("id long, dist long").parquet(path).count()
        if n:
            self.paths.append(path)
            self.sizes.append(n)
        return n

    def visited(self) -> DataFrame:
        """All levels so far. Many tables become one beside the last, so that a round opens a bounded number."""
        if len(self.paths) > MERGED:
            path = scratch_path(self.spark, "levels")
            self.spark.read.schema("id long, dist long").parquet(*self.paths[:-1]).write.parquet(path)
            self.paths = [path, self.paths[-1]]
        return self.spark.read.schema("id long, dist long").parquet(*self.paths)

    def last(self) -> DataFrame:
        return self.spark.read.schema("id long, dist long").parquet(self.paths[-1])


def levels(graph: DataFrame, source: int) -> Levels:
    """Breadth-first levels from a source. A source's own level is 0."""
    spark = graph.sparkSession
    graph = written(graph.select("src", "dst").distinct(), "edges")
    found = Levels(spark)
    found.add(spark.range(source, source + 1), 0)
    while found.add(edge_map(graph, found.last().select("id"), found.visited().select("id")), len(found.sizes)):
        pass
    return found


def with_all(spark: SparkSession, n: int, found: Levels) -> DataFrame:
    return spark.range(n).join(found.visited(), "id", "left")


def bfs_distances(graph: DataFrame, n: int, source: int) -> DataFrame:
    """(vertex, dist), -1 where there is no way."""
    return with_all(graph.sparkSession, n, levels(graph, source)).select(F.col("id").alias("vertex"), F.coalesce("dist", F.lit(-1)).alias("dist"))


def reachable(graph: DataFrame, n: int, source: int) -> DataFrame:
    """(vertex, visited 0/1): the visited set is the same in any order of search."""
    return with_all(graph.sparkSession, n, levels(graph, source)).select(F.col("id").alias("vertex"), F.col("dist").isNotNull().cast("long").alias("visited"))


def search_report(graph: DataFrame, source: int) -> DataFrame:
    """max_dist, nb_visited, the largest frontier, and the edges of visited vertices."""
    found = levels(graph, source)
    visited = found.visited()
    edges = graph.join(visited.withColumnRenamed("id", "src"), "src", "left_semi").agg(F.count(F.lit(1)).alias("nb_edges_processed"))
    return visited.agg(F.max("dist").alias("max_dist"), F.count(F.lit(1)).alias("nb_visited"), F.lit(max(found.sizes)).cast("long").alias("peak_frontier")).crossJoin(F.broadcast(edges))


def components(graph: DataFrame, n: int, most: int = 200) -> DataFrame:
    """(vertex, label): the smallest vertex that reaches it along edges; on a symmetric graph, its component.

    Each round takes the smallest label over incoming edges, then the label of the label: reaching is
    transitive, so that a chain takes rounds by the logarithm of its length. Only labels that fell in
    the round before are sent along edges again.
    """
    spark = graph.sparkSession
    with scratch_scope(spark):
        graph = written(graph.select("src", "dst").where("src <> dst").distinct(), "edges")
        now = written(spark.range(n).select("id", F.col("id").alias("label"), F.lit(True).alias("fell")), "labels")
        for turn in range(most):
            # At first each vertex is its own label, which the edges have themselves.
            labelled = now.where("fell").select(F.col("id").alias("src"), "label").join(graph, "src") if turn else graph.withColumn("label", F.col("src"))
            sent = labelled.groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("label"))
            least = now.select("id", "label", F.col("label").alias("old")).unionByName(sent.withColumn("old", F.lit(None).cast("long")))
            least = written(least.groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
            jump = least.select(F.col("id").alias("label"), F.col("label").alias("further"))
            after = least.join(jump, "label").select("id", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("fell"))
            now = written(after, "labels")
            if now.where("fell").isEmpty():
                return written(now.select(F.col("id").alias("vertex"), "label"), "components", keep=True)
    raise RuntimeError("labels did not settle")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def largest_components(labels: DataFrame, k: int = 10) -> DataFrame:
    return component_sizes(labels).orderBy(F.col("size").desc(), "label").limit(k)


def outedge_frontier(graph: DataFrame, frontier: DataFrame) -> DataFrame:
    """A frontier as its out-edges, numbered by (vertex, target): (edge, src, dst). Vertices without
    out-edges leave."""
    some = graph.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    return plan.positioned(some, "src", "dst", pos="edge")


def split_outedges(numbered: DataFrame, nb: int) -> tuple[DataFrame, DataFrame]:
    """The first nb out-edges and the rest; a vertex's edges may be cut."""
    return numbered.where(F.col("edge") < nb), numbered.where(F.col("edge") >= nb)
