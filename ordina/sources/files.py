"""File formats: edge lists, matrices, number sequences, points, triangles, event logs, binary adjacency."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.scalars import parsed_number
from ..plans.scan import positioned, reindexed
from ..plans.scratch import written
from ..plans.sizing import partitions

BLANKS = r"[ \t\r\n\x00]+"


# Text


def words(lines: DataFrame) -> DataFrame:
    """(line, value) -> (pos, word): all tokens in order."""
    tokens = lines.select("line", F.posexplode(F.split("value", BLANKS)).alias("j", "word")).where("word <> ''")
    return positioned(tokens, "line", "j").select("pos", "word")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines in order, of one file or of a folder's files by their names.

    The id of a row rises within a split of a file, and splits are ranked by file and place: Spark deals them
    to tasks by size.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    read = written(spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("id")), "lines")
    splits = read.select("file", "start").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file", "start")) - 1)
    line = F.shiftleft(F.col("rank").cast("long"), 33) + F.col("id").bitwiseAND((1 << 33) - 1)
    return read.join(F.broadcast(splits), ["file", "start"]).select(line.alias("line"), "value")  # a row per split


def pairs(value: Column) -> list[Column]:
    parts = F.split(F.trim(F.translate(value, "\t", " ")), " +")
    return [F.element_at(parts, i + 1).cast("long").alias(n) for i, n in enumerate(("src", "dst"))]


def parse_snap(lines: DataFrame) -> DataFrame:
    """Edge lines after headers that begin with '#'."""
    return lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(*pairs(F.col("value")))


def read_snap(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    graph = parse_snap(lines)
    said = lines.where(F.col("value").contains("Edges:")).select(F.regexp_extract("value", r"Edges:\s*(\d+)", 1).cast("long")).first()
    if said and said[0] is not None and said[0] != graph.count():
        raise ValueError(f"the header says {said[0]} edges")
    return graph


def read_pairs(spark: SparkSession, path: str, symmetric: bool = True) -> DataFrame:
    """Pairs without a header; made symmetric unless told otherwise."""
    from ..operators.graph import symmetric as both

    graph = spark.read.text(path).where(F.trim("value") != "").select(*pairs(F.col("value")))
    return both(graph) if symmetric else graph


def parse_matrix_market(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, value) -> one row of sizes, and 0-based triples (r, c, val)."""
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), " +")
    first = body.agg(F.min("line").alias("first"))
    sized = body.crossJoin(F.broadcast(first))
    number = lambda i: F.element_at(parts, i)
    sizes = sized.where("line = first").select(*[number(i + 1).cast("long").alias(n) for i, n in enumerate(("rows", "columns", "entries"))])
    cells = sized.where("line > first").select((number(1).cast("long") - 1).alias("r"), (number(2).cast("long") - 1).alias("c"), F.coalesce(F.get(parts, 2).cast("double"), F.lit(1.0)).alias("val"))
    return sizes, cells


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a real coordinate matrix; values are dropped, symmetric entries are not mirrored."""
    banner = spark.read.text(path).where(F.col("value").startswith("%%MatrixMarket")).first()
    kind = banner.value.lower().split() if banner else []
    if kind[1:4] != ["matrix", "coordinate", "real"]:
        raise ValueError("only real coordinate matrices are read")
    return parse_matrix_market(numbered_lines(spark, path))[1].select(F.col("r").alias("src"), F.col("c").alias("dst"))


def matrix_market_lines(cells: DataFrame, rows: int, columns: int, entries: int) -> DataFrame:
    """(pos, value): banner, sizes and 1-based triples."""
    spark = cells.sparkSession
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{rows} {columns} {entries}")], "pos long, value string")
    body = positioned(cells, "r", "c").select((F.col("pos") + 2).alias("pos"), F.format_string("%d %d %.16g", F.col("r") + 1, F.col("c") + 1, "val").alias("value"))
    return head.unionByName(body)


#: Numbers of a cell by the kind of the matrix.
WIDTHS = {"pattern": 0, "real": 1, "integer": 1, "complex": 2}


def numbers_text(kind: str) -> Column:
    """The numbers (re, im) of a cell as a file of this kind has them."""
    if kind == "integer":
        return F.format_string("%d", F.col("re").cast("long"))
    return F.format_string("%.16g %.16g", "re", "im") if kind == "complex" else F.format_string("%.16g", "re")


def matrix_lines(cells: DataFrame, rows: int, columns: int, entries: int, kind: str = "real", shape: str = "general") -> DataFrame:
    """(r, c, re, im) -> (pos, value) of a coordinate file: banner, sizes and 1-based cells."""
    head = cells.sparkSession.createDataFrame([(0, f"%%MatrixMarket matrix coordinate {kind} {shape}"), (1, f"{rows} {columns} {entries}")], "pos long, value string")
    place = F.format_string("%d %d", F.col("r") + 1, F.col("c") + 1)
    text = F.concat_ws(" ", place, numbers_text(kind)) if WIDTHS[kind] else place
    return head.unionByName(positioned(cells, "r", "c").select((F.col("pos") + 2).alias("pos"), text.alias("value")))


def array_lines(cells: DataFrame, rows: int, columns: int, kind: str = "real") -> DataFrame:
    """(r, c, re, im), every cell once -> (pos, value) of an array file: the numbers column by column."""
    if not WIDTHS[kind]:
        raise ValueError("an array has numbers")
    head = cells.sparkSession.createDataFrame([(0, f"%%MatrixMarket matrix array {kind} general"), (1, f"{rows} {columns}")], "pos long, value string")
    place = F.col("c") * rows + F.col("r")
    return head.unionByName(cells.select((place + 2).alias("pos"), numbers_text(kind).alias("value")))


def read_matrix(spark: SparkSession, path: str, mirrored: bool = False) -> DataFrame:
    """(r, c, re, im), 0-based, of a coordinate or array file of real, integer, complex or pattern kind.

    A pattern's cells count 1. ``mirrored`` adds the other half of symmetric, skew-symmetric and
    hermitian matrices, which files hold but once. Arrays are read where they are general.
    """
    banner = spark.read.text(path).where(F.lower(F.col("value")).startswith("%%matrixmarket")).first()
    what = banner.value.lower().split() if banner else []
    if len(what) < 5 or what[1] != "matrix" or what[2] not in ("coordinate", "array") or what[3] not in WIDTHS:
        raise ValueError("not a matrix file")
    _, _, form, kind, shape = what[:5]
    body = numbered_lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), "[ \t]+")
    body = written(body.select("line", parts.alias("parts")), "matrix")
    first = body.orderBy("line").first()
    if first is None:
        raise ValueError("the file ends before its sizes")
    cells = body.where(F.col("line") > first.line)
    at = 2 if form == "coordinate" else 0
    number = lambda i: F.get("parts", F.lit(i)).cast("double")
    re = number(at) if WIDTHS[kind] else F.lit(1.0)
    im = number(at + 1) if kind == "complex" else F.lit(0.0)
    if form == "array":
        if shape != "general":
            raise ValueError("only general arrays are read")
        rows = int(first.parts[0])
        place = reindexed(cells, "line")
        return place.select((F.col("line") % rows).alias("r"), F.floor(F.col("line") / rows).cast("long").alias("c"), re.alias("re"), im.alias("im"))
    index = lambda i: F.get("parts", F.lit(i)).cast("long") - 1
    found = cells.select(index(0).alias("r"), index(1).alias("c"), re.alias("re"), im.alias("im"))
    if not mirrored or shape == "general":
        return found
    signs = {"symmetric": (1, 1), "skew-symmetric": (-1, -1), "hermitian": (1, -1)}[shape]
    other = found.where("r <> c").select(F.col("c").alias("r"), F.col("r").alias("c"), (F.col("re") * signs[0]).alias("re"), (F.col("im") * signs[1]).alias("im"))
    return found.unionByName(other)


def graphviz_lines(graph: DataFrame, directed: bool = True) -> DataFrame:
    """(pos, value) of a dot file."""
    spark, arrow = graph.sparkSession, "->" if directed else "--"
    body = positioned(graph, "src", "dst").select((F.col("pos") + 1).alias("pos"), F.format_string(f"%d {arrow} %d;", "src", "dst").alias("value"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit("digraph {" if directed else "graph {").alias("value"))
    tail = body.agg((F.coalesce(F.max("pos"), F.lit(0)) + 1).alias("pos")).withColumn("value", F.lit("}"))
    return head.unionByName(body).unionByName(tail)


def write_lines(lines: DataFrame, path: str) -> None:
    """(pos, value) as text files whose names are in order of positions."""
    lines.repartitionByRange(partitions(lines.sparkSession), "pos").sortWithinPartitions("pos").select("value").write.text(path)


# Number sequences and points

HEADERS = {"sequenceInt": "long", "sequenceDouble": "double", "sequenceChar": "string"}
PAIR_HEADERS = {"sequenceIntPair": "long", "sequenceStringIntPair": "string"}


def parse_sequence(tokens: DataFrame, header: str) -> DataFrame:
    """(pos, word) with the header at 0 -> (pos, v) or (pos, first, second), typed by the header."""
    body = tokens.where("pos > 0").withColumn("pos", F.col("pos") - 1)
    if header in HEADERS:
        kind = HEADERS[header]
        value = F.col("word") if kind == "string" else parsed_number(F.col("word"), kind)
        return body.select("pos", value.alias("v"))
    kind = PAIR_HEADERS[header]
    both = body.groupBy(F.floor(F.col("pos") / 2).cast("long").alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("word"))).alias("first"), F.max(F.when(F.col("pos") % 2 == 1, F.col("word"))).alias("second"))
    return both.select("pos", F.col("first").cast(kind).alias("first"), F.col("second").cast("long").alias("second"))


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    tokens = words(numbered_lines(spark, path))
    head = tokens.where("pos = 0").first()
    if head is None or head.word not in {**HEADERS, **PAIR_HEADERS}:
        raise ValueError("not a sequence file")
    return parse_sequence(tokens, head.word)


def sequence_lines(values: DataFrame, header: str) -> DataFrame:
    """(pos, v ...) -> (pos, value), the header first; doubles with 11 decimals."""
    if header == "sequenceDouble":
        text = F.format_string("%.11e", "v")
    elif header in PAIR_HEADERS:
        text = F.concat_ws(" ", "first", "second")
    else:
        text = F.col("v").cast("string")
    head = values.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit(header).alias("value"))
    return head.unionByName(values.select((F.col("pos") + 1).alias("pos"), text.alias("value")))


def parse_points(tokens: DataFrame, d: int) -> DataFrame:
    """(pos, word) without a header -> (id, x, y[, z])."""
    number = parsed_number(F.col("word"))
    place = lambda i: F.max(F.when(F.col("pos") % d == i, number))
    return tokens.groupBy(F.floor(F.col("pos") / d).cast("long").alias("id")).agg(*[place(i).alias(n) for i, n in enumerate("xyz"[:d])])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    tokens = words(numbered_lines(spark, path))
    head = tokens.where("pos = 0").first()
    d = {"pbbs_sequencePoint2d": 2, "pbbs_sequencePoint3d": 3}.get(head.word if head else "")
    if not d:
        raise ValueError("not a point file")
    return parse_points(tokens.where("pos > 0").withColumn("pos", F.col("pos") - 1), d)


def point_lines(points: DataFrame, d: int) -> DataFrame:
    head = points.sparkSession.range(1).select(F.lit(0).cast("long").alias("pos"), F.lit(f"pbbs_sequencePoint{d}d").alias("value"))
    return head.unionByName(points.select((F.col("id") + 1).alias("pos"), F.concat_ws(" ", *"xyz"[:d]).alias("value")))


def read_triangles(spark: SparkSession, path: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Header, two counts, points, index triples -> points and triangles."""
    tokens = words(numbered_lines(spark, path))
    head = {r.pos: r.word for r in tokens.where("pos < 3").collect()}
    if head.get(0) != "pbbs_triangles":
        raise ValueError("not a triangle file")
    n = int(head[1])
    body = tokens.where("pos > 2").withColumn("pos", F.col("pos") - 3)
    corners = parse_points(body.where(F.col("pos") >= 2 * n).withColumn("pos", F.col("pos") - 2 * n), 3)
    return parse_points(body.where(F.col("pos") < 2 * n), 2), corners.select("id", *[(F.col(a).cast("long") - offset).alias(b) for a, b in zip("xyz", ("c0", "c1", "c2"), strict=True)])


# Estimator constants


def parse_constants(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), " +")
    return lines.where(F.trim("value") != "").select(F.element_at(parts, 1).alias("name"), F.element_at(parts, 2).cast("double").alias("cst"))


def constant_lines(constants: DataFrame) -> DataFrame:
    return constants.select(F.format_string("%s %f", "name", "cst").alias("value"))


# Binary adjacency

MAGIC = 0xDEADBEEF
HEAD = struct.Struct("<5Q")
#: Numbers that are held at a time.
PIECE = 1 << 20


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class AdjacencyReader(DataSourceReader):
    """Vertices are dealt to partitions; each reads its offsets, and its edges a piece at a time, as ranges of bytes."""

    def __init__(self, options):
        self.path = options["path"]
        self.vertices = int(options.get("vertices_per_partition", 1 << 20))

    def open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith(("/", "file:")) else f"/{self.path}")
        return store.open_input_file(path)

    def header(self, file) -> tuple[np.dtype, int, int]:
        magic, bits, n, m, _ = HEAD.unpack(file.read_at(HEAD.size, 0))
        if magic != MAGIC or bits not in (32, 64):
            raise ValueError("not a binary adjacency file")
        if file.size() != HEAD.size + (n + 1 + m) * bits // 8:
            raise ValueError("the size of the file and its header disagree")
        return np.dtype(f"<u{bits // 8}"), n, m

    def partitions(self):
        with self.open() as file:
            _, n, _ = self.header(file)
        return [Rows(a, min(n, a + self.vertices)) for a in range(0, n, self.vertices)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with self.open() as file:
            kind, n, _ = self.header(file)
            size = kind.itemsize
            at = np.frombuffer(file.read_at((partition.last - partition.first + 1) * size, HEAD.size + partition.first * size), kind).astype(np.int64)
            for a in range(int(at[0]), int(at[-1]), PIECE):
                b = min(a + PIECE, int(at[-1]))
                targets = np.frombuffer(file.read_at((b - a) * size, HEAD.size + (n + 1 + a) * size), kind).astype(np.int64)
                sources = np.repeat(np.arange(partition.first, partition.last), np.diff(np.clip(at, a, b)))
                yield pa.RecordBatch.from_arrays([pa.array(sources), pa.array(targets)], names=["src", "dst"])


class Part(WriterCommitMessage):
    """A task's edges: their place in the order, where they lie, how many, and the first and last source."""

    def __init__(self, number: int, path: str, edges: int, first: int, last: int):
        self.number, self.path, self.edges, self.first, self.last = number, path, edges, first, last


class AdjacencyWriter(DataSourceArrowWriter):
    """Rows must come sorted by (src, dst), within partitions and over them.

    The format is one file: each task writes its targets, and its sources' offsets from its own first edge, to
    files beside it; the commit strings them together a piece at a time.
    """

    def __init__(self, options):
        self.path, self.n, self.bits = options["path"], int(options["nb_vertices"]), int(options.get("bits", 32))

    def place(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        return store, path, f"{path}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        from pyspark import TaskContext

        store, _, folder = self.place()
        store.create_dir(folder, recursive=True)
        own, kind = f"{folder}/{uuid.uuid4().hex}", f"<u{self.bits // 8}"
        edges, first, last = 0, -1, -1
        with store.open_output_stream(f"{own}.at", compression=None) as at, store.open_output_stream(f"{own}.to", compression=None) as to:
            for batch in iterator:
                src, dst = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("src", "dst"))
                if not len(src):
                    continue
                if batch.column(0).null_count or batch.column(1).null_count or src[0] < 0 or dst.min() < 0 or src[-1] >= self.n or dst.max() >= min(1 << self.bits, 1 << 63):
                    raise ValueError("a vertex is out of range")
                if not edges:
                    first = last = int(src[0])
                for a in range(last + 1, int(src[-1]) + 1, PIECE):
                    at.write((edges + np.searchsorted(src, np.arange(a, min(a + PIECE, int(src[-1]) + 1)))).astype("<i8").tobytes())
                to.write(dst.astype(kind).tobytes())
                edges, last = edges + len(src), int(src[-1])
        return Part(TaskContext.get().partitionId(), own, edges, first, last)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path, folder = self.place()
        parts = sorted((p for p in messages if p is not None and p.edges), key=lambda p: p.number)
        kind, total = f"<u{self.bits // 8}", sum(p.edges for p in parts)
        if total >= 1 << self.bits:
            raise ValueError("offsets need more bits")

        def pieces(name: str) -> Iterator[bytes]:
            with store.open_input_stream(name, compression=None) as held:
                while piece := held.read(8 * PIECE):
                    yield piece

        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path, compression=None) as out:

            def same(offset: int, times: int) -> None:
                for a in range(0, times, PIECE):
                    out.write(np.full(min(PIECE, times - a), offset, kind).tobytes())

            out.write(HEAD.pack(MAGIC, self.bits, self.n, total, 0))
            begun, vertex = 0, 0  # edges before the part, and the first vertex whose offset is due
            for part in parts:
                same(begun, part.first + 1 - vertex)
                for piece in pieces(f"{part.path}.at"):
                    out.write((begun + np.frombuffer(piece, "<i8")).astype(kind).tobytes())
                begun, vertex = begun + part.edges, part.last + 1
            same(total, self.n + 1 - vertex)
            for part in parts:
                for piece in pieces(f"{part.path}.to"):
                    out.write(piece)
        self.dropped(store, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, folder = self.place()
        self.dropped(store, folder)

    def dropped(self, store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class AdjacencySource(DataSource):
    """``spark.read.format("adj_bin").load(uri)`` and ``df.write.format("adj_bin")``."""

    @classmethod
    def name(cls) -> str:
        return "adj_bin"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> DataSourceReader:
        return AdjacencyReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return AdjacencyWriter(self.options)


def write_adjacency(graph: DataFrame, uri: str, n: int, bits: int = 32) -> None:
    from ..plans.shipping import ship

    ship(graph.sparkSession)
    graph.sparkSession.dataSource.register(AdjacencySource)
    ordered = graph.select("src", "dst").repartitionByRange(partitions(graph.sparkSession), "src", "dst").sortWithinPartitions("src", "dst")
    ordered.write.format("adj_bin").option("nb_vertices", n).option("bits", bits).mode("append").save(uri)


def read_adjacency(spark: SparkSession, uri: str, vertices_per_partition: int = 1 << 20) -> DataFrame:
    from ..plans.shipping import ship

    ship(spark)
    spark.dataSource.register(AdjacencySource)
    return spark.read.format("adj_bin").option("vertices_per_partition", vertices_per_partition).load(uri)


# Dispatch


def read_graph(spark: SparkSession, uri: str) -> DataFrame:
    """By the extension, which begins at the first dot of the file's name."""
    extension = uri.rsplit("/", 1)[-1].partition(".")[2]
    readers = {"adj_bin": read_adjacency, "snap": read_snap, "twitter": read_pairs, "mmarket": read_matrix_market}
    if extension not in readers:
        raise ValueError(f"no reader for .{extension}")
    return readers[extension](spark, uri)


def write_graph(graph: DataFrame, uri: str, n: int) -> None:
    extension = uri.rsplit("/", 1)[-1].partition(".")[2]
    if extension == "adj_bin":
        write_adjacency(graph, uri, n)
    elif extension == "dot":
        write_lines(graphviz_lines(graph), uri)
    else:
        raise ValueError(f"no writer for .{extension}")


def fs_write(uri: str, data: bytes) -> None:
    """A small file, written by the driver to a store that all can read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)
