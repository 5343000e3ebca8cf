"""Streamed pairing equals the batch operator when micro-batches come in order of time."""

import random

from ordina.operators import telemetry
from ordina.streaming import intervals


def test_stream_equals_batch(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for i in range(120):
        rows.append((rnd.randrange(4), i * 10, i, rnd.choice(["enter_wait", "exit_wait", "communicate"])))
    schema = "proc long, time long, seq long, type string"
    batch = spark.createDataFrame(rows, schema)
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = intervals.paired(stream, "enter_wait", "exit_wait").writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(tuple(r) for r in spark.table("paired").collect())
    assert got == sorted(tuple(r) for r in telemetry.intervals(batch, "enter_wait", "exit_wait").collect())
