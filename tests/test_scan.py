"""Scans of large keys in ranges, against plain windows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.operators import clean, history, scan


def rows_of(spark, n=6_000):
    """A key of half the rows, a null key, many small ones; ties of instants; null values."""
    i = F.col("id")
    key = F.when(i % 2 == 0, 1).when(i % 11 == 0, None).otherwise(i % 97)
    return spark.range(n).select(key.alias("u"), (F.xxhash64("id") % 500).alias("t"), i, F.when(i % 5 != 0, i % 13).alias("v"), F.when(i % 3 == 0, 0).otherwise(i % 7).alias("votes"))


def same(a, b):
    rows = lambda df: sorted(str(tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in sorted(df.columns))) for r in df.collect())
    assert rows(a) == rows(b)


@pytest.mark.parametrize("most", [50, 700])
def test_scan_equals_window(spark, most):
    rows = rows_of(spark)
    window = W.partitionBy("u").orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)
    plain = rows.withColumns({"n": F.count("*").over(window), "m": F.avg("v").over(window)})
    same(history.prior_history(rows, "u", ["t", "id"], {"m": "v"}, "n", most=most), plain)
    same(history.arrival_position(rows, "u", ["t", "id"], most=most), rows.withColumn("arrival_position", F.row_number().over(W.partitionBy("u").orderBy("t", "id"))))


def test_strict_scan_equals_range_window(spark):
    rows = rows_of(spark)
    window = W.partitionBy("u").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    plain = rows.withColumns({"n": F.count("*").over(window), "m": F.avg("v").over(window)})
    same(history.prior_history(rows, "u", ["t"], {"m": "v"}, "n", strict=True, most=100), plain)


def test_whole_key_measures_of_large_keys(spark):
    rows = rows_of(spark)
    whole = W.partitionBy("u")
    same(history.whole_history(rows, "u", "v", "x", most=100), rows.withColumns({"x_avg_helpful": F.avg("v").over(whole), "x_review_count": F.count("*").over(whole)}))
    for most in (100, scan.MOST):
        got = clean.item_percentile(rows, "u", "votes", most=most)
        same(got, rows.withColumns({"product_review_count": F.count("*").over(whole), "within_product_pct_rank": F.when(F.count("*").over(whole) >= 5, F.percent_rank().over(whole.orderBy("votes")))}))


def test_empty_table_and_instant_of_many_rows(spark):
    rows = rows_of(spark)
    assert history.prior_history(rows.limit(0), "u", ["t", "id"], {"m": "v"}, "n", most=10).count() == 0
    tied = rows.withColumn("t", F.lit(5))
    got = history.prior_history(tied, "u", ["t"], {}, "n", strict=True, most=100)
    assert got.agg(F.max("n")).first()[0] == 0


def test_one_key_of_a_million_rows_is_dealt_evenly(spark):
    """No task reads over twice the median."""
    rows = spark.range(1_000_000).select(F.lit(7).alias("u"), F.xxhash64("id").alias("t"), "id", (F.col("id") % 10).alias("v"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = history.prior_history(rows, "u", ["t", "id"], {"m": "v"}, "n", most=5_000)
        each = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("rows"), F.max("n").alias("top")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = sorted(r["rows"] for r in each)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4] and max(r["top"] for r in each) == 999_999
