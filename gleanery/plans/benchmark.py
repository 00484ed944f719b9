"""Timed workloads that consume every column they compute."""

from __future__ import annotations

from statistics import median
from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_by(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows"), *[F.avg(v).alias(f"avg_{v}") for v in values])


def windowed_history(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumns({"position": F.row_number().over(w), "prior_avg": F.avg(value).over(w.rowsBetween(W.unboundedPreceding, -1))})


def text_scan(df: DataFrame, text: str, pattern: str = r"\d") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(text).rlike(pattern)).alias("matching"), F.sum(F.length(text)).alias("chars"))


def timed(df: DataFrame, repeats: int = 3) -> float:
    """Median seconds to write everything nowhere, after a warm-up."""
    times = []
    for k in range(repeats + 1):
        start = perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times += [perf_counter() - start] if k else []
    return median(times)


def pandas_workloads(key: str, order: list[str], value: str, text: str) -> dict:
    """The same three workloads on a pandas frame."""
    return {
        "group": lambda d: d.groupby(key)[value].agg(["size", "mean"]),
        "history": lambda d: d.sort_values([key, *order]).groupby(key)[value].transform(lambda v: v.shift().expanding().mean()),
        "scan": lambda d: (d[text].str.contains(r"\d", na=False).sum(), d[text].str.len().sum()),
    }


def sweep(df: DataFrame, key: str, order: list[str], value: str, text: str, sizes: tuple[int, ...] = (10_000, 50_000, 100_000, 250_000, 500_000), repeats: int = 3) -> DataFrame:
    """(workload, rows, spark_s, other_s): median seconds of each workload on the first `sizes` rows, here and in pandas, which holds them on the driver."""
    found, spark = [], df.sparkSession
    there = df.count()
    for n in sorted({min(n, there) for n in sizes}):
        part = df.limit(n).persist()
        local = part.toPandas()
        plans = {"group": group_by(part, key, [value]), "history": windowed_history(part, key, order, value), "scan": text_scan(part, text)}
        for name, run in pandas_workloads(key, order, value, text).items():
            times = []
            for k in range(repeats + 1):
                start = perf_counter()
                run(local)
                times += [perf_counter() - start] if k else []
            found.append((name, n, timed(plans[name], repeats), median(times)))
        part.unpersist()
    return spark.createDataFrame(found, "workload string, rows long, spark_s double, other_s double")


def crossover(results: DataFrame) -> DataFrame:
    """From (workload, rows, spark_s, other_s): the least rows at which Spark is faster, and whether its ratio falls."""
    ratio = F.col("spark_s") / F.col("other_s")
    w = W.partitionBy("workload").orderBy("rows")
    rows = results.withColumn("ratio", ratio).withColumn("falls", F.coalesce(F.col("ratio") <= F.lag("ratio").over(w), F.lit(True)))
    return rows.groupBy("workload").agg(F.min(F.when(F.col("ratio") < 1, F.col("rows"))).alias("crossover_rows"), F.bool_and("falls").alias("ratio_falls"))
