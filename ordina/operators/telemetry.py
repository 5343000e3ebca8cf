"""Analytics of event logs: (time, proc, type, ...) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scan import positioned
from ..plans.scratch import scratch_scope, written

# Event types in order of their codes, with their kinds (null: not tracked).
TYPES = (
    ("enter_launch", "phases"),
    ("exit_launch", "phases"),
    ("enter_algo", "phases"),
    ("exit_algo", "phases"),
    ("enter_wait", "phases"),
    ("exit_wait", "phases"),
    ("communicate", "comm"),
    ("interrupt", "comm"),
    ("algo_phase", "phases"),
    ("locality_start", "locality"),
    ("locality_stop", "locality"),
    ("thread_start", None),
    ("thread_stop", None),
    ("thread_create", "threads"),
    ("thread_schedule", "threads"),
    ("thread_pop", "threads"),
    ("thread_send", "transfer"),
    ("thread_exec", "threads"),
    ("thread_finish", "threads"),
    ("thread_fork", "threads"),
    ("estim_name", "estims"),
    ("estim_predict", "estims"),
    ("estim_report", "estims"),
    ("estim_update", "csts"),
    ("steal_success", "stdws"),
    ("steal_fail", "stdws"),
    ("steal_abort", "stdws"),
)


def types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(TYPES)], "code int, type string, kind string")


def tracked(events: DataFrame, kinds: list[str]) -> DataFrame:
    """events with their kind, of the kinds asked for."""
    dim = types(events.sparkSession).where(F.col("kind").isin(kinds)).select("type", "kind")
    return events.join(F.broadcast(dim), "type")  # a row per type


def merged(*logs: DataFrame) -> DataFrame:
    """One log in order of (time, proc, seq), with positions."""
    from ..plans.scan import positioned

    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return positioned(out, "time", "proc", "seq")


def paired(events: DataFrame, opens: str, closes: str) -> DataFrame:
    """(proc, start, stop, problem): an opening event and the next closing one of the same processor.

    Of two openings in a row the later one counts, and the earlier one is reported; a closing event
    without an opening and an opening without a closing are reported too.
    """
    own = Window.partitionBy("proc").orderBy("time", "seq")
    some = events.where(F.col("type").isin(opens, closes)).select("proc", "time", "seq", "type")
    seen = some.withColumn("before", F.lag("type").over(own)).withColumn("began", F.lag("time").over(own)).withColumn("after", F.lead("type").over(own))
    closed, opened = F.col("type") == closes, F.col("type") == opens
    problem = F.when(closed & F.coalesce(F.col("before") != opens, F.lit(True)), "exit without enter").when(opened & F.col("after").isNull(), "missing exit").when(opened & (F.col("after") == opens), "double enter")
    good = closed & (F.col("before") == opens)
    return seen.withColumn("problem", problem).where(good | problem.isNotNull()).select("proc", F.when(good | closed, F.when(good, F.col("began"))).otherwise(F.col("time")).alias("start"), F.when(closed, F.col("time")).alias("stop"), "problem")


def intervals(events: DataFrame, opens: str, closes: str) -> DataFrame:
    return paired(events, opens, closes).where("problem is null").select("proc", "start", "stop")


def ranges(events: DataFrame, enter: str, leave: str) -> DataFrame:
    """The range of the computation, of the whole log, and the number of processors."""
    return events.agg(
        F.min(F.when(F.col("type") == enter, F.col("time"))).alias("start"),
        F.max(F.when(F.col("type") == leave, F.col("time"))).alias("stop"),
        F.min("time").alias("first"),
        F.max("time").alias("last"),
        (1 + F.max("proc")).alias("nb_proc"),
    )


def clipped(boxes: DataFrame, start: Column, stop: Column) -> DataFrame:
    """The part of each interval within a range; those outside go."""
    inside = boxes.withColumn("start", F.greatest("start", start)).withColumn("stop", F.least("stop", stop))
    return inside.where("start < stop")


def scaled_x(time: Column, start: Column, stop: Column, width: int) -> Column:
    return (time - start) * width / (stop - start)


def utilization(idle: DataFrame, duration: float, workers: int) -> DataFrame:
    """1 - idle time over all workers' time; intervals in the unit of the duration."""
    total = F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))
    return idle.agg(total.alias("idle"), (1 - total / (duration * workers)).alias("utilization"))


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# Estimates

WEIGHT = 8.0
REPORT = 2.0
PESSIMISTIC = 1.0
TINY = -3.0


def private_constants(measures: DataFrame) -> DataFrame:
    """(estimator, proc, seq, m) -> the constant of each after its measures: the first one, and then
    (8 c + m) / 9, in order.

    The k-th measure from the end weighs (8/9)**k / 9, and the first one (8/9)**(n - 1). Its place comes from
    dense positions over all rows, so that an estimator with most of the measures is split like any other.
    """
    keys = ["estimator", "proc"]
    placed = written(positioned(measures.select(*keys, "seq", "m"), *keys, "seq"), "measures")
    last = placed.groupBy(*keys).agg(F.max("pos").alias("last"))
    keep = WEIGHT / (WEIGHT + 1)
    age = F.col("last") - F.col("pos")
    sums = F.sum(F.col("m") * F.pow(F.lit(keep), age)) / (WEIGHT + 1) + F.max_by("m", age) * F.pow(F.lit(keep), F.max(age) + 1)
    return placed.join(last, keys).groupBy(*keys).agg(sums.alias("cst"))


def shared_constant(values: list[float]) -> float | None:
    """The shared constant after some private ones: it never rises, and halves when undercut by half."""
    shared: float | None = None
    for value in values:
        if shared is None:
            shared = value
        elif value < shared / REPORT:
            shared = shared / REPORT
    return shared


#: Halvings that one pass finds.
STEPS = 64


def shared_constants(updates: DataFrame) -> DataFrame:
    """(estimator, seq, c) -> the shared constant of each, by the same rule as an ordered fold.

    A value's level is the number of the coming halvings, STEPS at most, at which it would still undercut. A
    value of level k counts only while less than k of them are done, so that the first k of a level
    suffice. A pass folds these few, wherever they stand, and leaves the values under the constant to the
    next one; a double halves 2098 times at most, which bounds the passes. A negative constant rises,
    with a pass for each halving.
    """
    with scratch_scope(updates.sparkSession):
        rows = written(updates.select("estimator", "seq", F.col("c").cast("double").alias("c")), "updates")
        now = written(rows.groupBy("estimator").agg(F.min("seq").alias("at"), F.min_by("c", "seq").alias("shared"), F.lit(True).alias("open")), "shared")
        half = F.col("shared") / REPORT
        most = F.when(F.col("shared") > 0, STEPS).otherwise(1)
        # Halved step by step: powers would round otherwise where numbers are tiny.
        halves = F.aggregate(F.sequence(F.lit(2), most, F.lit(1)), F.array(half), lambda held, _: F.concat(held, F.array(F.element_at(held, -1) / REPORT)))
        while True:
            current = now.where(F.col("open") & (half != F.col("shared"))).select("estimator", F.col("at").alias("since"), "shared", most.alias("most"), F.when(most > 1, halves).otherwise(F.array(half)).alias("halves"))
            live = rows.join(current, "estimator").where((F.col("seq") > F.col("since")) & (F.col("c") < F.greatest(half, F.lit(0.0))))
            rows = written(live.select("estimator", "seq", "c"), "updates")
            level = F.size(F.filter("halves", lambda x: F.col("c") < x))
            own = Window.partitionBy("estimator", "level").orderBy("seq")
            some = live.withColumn("level", level).where("level > 0").withColumn("n", F.row_number().over(own)).where((F.col("n") <= STEPS) & (F.col("n") <= F.col("level")))

            def step(held: Column, x: Column) -> Column:
                hit = (held["n"] < held["most"]) & (x["c"] < held["shared"] / REPORT)
                return F.struct(F.when(hit, held["shared"] / REPORT).otherwise(held["shared"]).alias("shared"), F.when(hit, x["seq"]).otherwise(held["at"]).alias("at"), F.when(hit, held["n"] + 1).otherwise(held["n"]).alias("n"), held["most"].alias("most"))

            taken = some.groupBy("estimator", "since", "shared", "most").agg(F.array_sort(F.collect_list(F.struct("seq", "c"))).alias("xs"))
            start = F.struct(F.col("shared").alias("shared"), F.col("since").alias("at"), F.lit(0).alias("n"), F.col("most").alias("most"))
            moved = written(taken.select("estimator", F.aggregate("xs", start, step).alias("to")), "moved")
            if moved.isEmpty():
                return written(now.select("estimator", "shared"), "shared", keep=True)
            now = written(now.join(moved, "estimator", "left").select("estimator", F.coalesce("to.at", "at").alias("at"), F.coalesce("to.shared", "shared").alias("shared"), F.coalesce(F.col("to.n") == F.col("to.most"), F.lit(False)).alias("open")), "shared")


def predicted(constant: Column, complexity: Column) -> Column:
    """Cost of a complexity; a tiny one (null) costs TINY, an unknown constant is pessimistic."""
    return F.when(complexity.isNull(), F.lit(TINY)).otherwise(F.coalesce(constant, F.lit(PESSIMISTIC)) * complexity)


def predicted_iterations(constant: Column, kappa: float) -> Column:
    return F.greatest(F.floor(kappa / F.coalesce(constant, F.lit(PESSIMISTIC))), F.lit(1)).cast("long")


# Files


def log_lines(events: DataFrame) -> DataFrame:
    """(pos, value): time, processor, type and arguments, parted by tabs."""
    return events.select("pos", F.concat_ws("\t", F.format_string("%f", F.col("time").cast("double")), "proc", "type", F.coalesce("args", F.lit(""))).alias("value"))


def parse_log(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "\t")
    return lines.select(F.get(parts, F.lit(0)).cast("double").alias("time"), F.get(parts, F.lit(1)).cast("long").alias("proc"), F.get(parts, F.lit(2)).alias("type"), F.nullif(F.get(parts, F.lit(3)), F.lit("")).alias("args"))


#: Payload of binary events by code: a number of 8-byte words after (time, proc, code); others have none.
PAYLOAD = {7: 1, 8: 1, 9: 1, 10: 1, 13: 1, 14: 1, 15: 1, 16: 2, 17: 1, 18: 1, 19: 3, 21: 3, 22: 4, 23: 2}


def write_binary(rows: list[tuple[int, int, int, list[int]]]) -> bytes:
    import struct

    return b"".join(struct.pack(f"<{3 + len(p)}q", t, proc, code, *p) for t, proc, code, p in rows)


def parse_binary(data: bytes) -> list[tuple[int, int, int, list[int]]]:
    """Words of 8 bytes: time, processor, code, and what the code's payload has."""
    import struct

    words, out, at = struct.unpack(f"<{len(data) // 8}q", data[: len(data) // 8 * 8]), [], 0
    while at + 3 <= len(words):
        time, proc, code = words[at : at + 3]
        n = PAYLOAD.get(code, 0)
        out.append((time, proc, code, list(words[at + 3 : at + 3 + n])))
        at += 3 + n
    return out


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Binary logs, a file a task: events are of several lengths, so that a file is read from its start."""
    import pyarrow as pa

    from ..plans.shipping import ship

    ship(spark)

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = parse_binary(data)
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["time", "proc", "code", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "time long, proc long, code int, payload array<long>")
