"""The stream in event time equals the batch scan on shuffled input; rows behind the watermark are counted."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gleanery.operators import history as batch
from gleanery.streaming import ordered

SCHEMA = "id long, u long, at timestamp, v double"
START = dt.datetime(2024, 1, 1)


def run(spark, folder, parts, delay):
    ordered.prepare(spark)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/p{k}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
        out = ordered.prior_history(stream, "u", "at", "id", "v", delay)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(240)
        yield query


def test_shuffled_stream_equals_batch_and_late_rows_are_counted(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, i % 3, START + dt.timedelta(minutes=i // 2), None if i % 5 == 0 else float(i * i % 7)) for i in range(60)]
    mixed = [rows[k] for lo in range(0, 60, 20) for k in rng.sample(range(lo, lo + 20), 20)]
    flush = (999, 9, START + dt.timedelta(days=9), 0.0)
    late = (1000, 1, START, 5.0)
    parts = [mixed[:25], mixed[25:], [flush], [late, (1001, 9, START + dt.timedelta(days=9, hours=2), 0.0)]]
    dropped = sum(ordered.late_rows(q) for q in run(spark, str(tmp_path), parts, "30 minutes"))
    got = {r.id: (r.u, r.at, r.prior_count, r.prior_avg) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.id < 900}
    frame = spark.createDataFrame(rows, SCHEMA)
    want = batch.prior_history(frame, "u", ["at", "id"], {"m": "v"}, "n")
    assert got == {r.id: (r.u, r["at"], r.n, r.m) for r in want.select("id", "u", "at", "n", F.col("m")).collect()}
    assert dropped == 1
