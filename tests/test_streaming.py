"""The streaming history equals the batch one when rows come in order."""

from gleanery.operators import history as batch
from gleanery.streaming import history


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, k % 3, k, None if k % 5 == 0 else float(k * k % 7)) for k in range(30)]
    schema = "id long, u long, ts long, v double"
    for part in (rows[:10], rows[10:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = history.prior_history(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "u", ["ts"], "v", "id")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.id: (r.prior_count, r.prior_avg) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = batch.prior_history(spark.createDataFrame(rows, schema), "u", ["ts"], {"m": "v"}, "n")
    assert got == {r.id: (r.n, r.m) for r in want.collect()}
