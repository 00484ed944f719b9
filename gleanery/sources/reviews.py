"""Declared review schema; scans, alignment and sinks."""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in (
        ("asin", T.StringType()), ("helpful_vote", T.IntegerType()), ("images", T.StringType()), ("parent_asin", T.StringType()),
        ("rating", T.DoubleType()), ("text", T.StringType()), ("timestamp", T.LongType()), ("title", T.StringType()),
        ("user_id", T.StringType()), ("verified_purchase", T.BooleanType()), ("Category", T.StringType()),
    )]
)
RAW_SCHEMA = T.StructType([f for f in SCHEMA if f.name != "Category"])
CORRUPT = "_corrupt_record"


def align(df: DataFrame, schema: T.StructType = SCHEMA) -> DataFrame:
    """The schema's columns in its order: present ones cast (null where a value does not fit), missing ones as typed nulls."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """Quoted multi-line CSV; malformed records are kept in CORRUPT so that they can be counted."""
    wide = T.StructType([*schema, T.StructField(CORRUPT, T.StringType(), True)])
    return spark.read.schema(wide).options(header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path)


def read_json_lines(spark: SparkSession, path: str, category: str, partitions: int | None = None) -> DataFrame:
    """A raw dump in JSON lines, gzip or not; a gzip file is one task, so it is dealt out at once."""
    rows = spark.read.schema(RAW_SCHEMA).json(path).withColumn("Category", F.lit(category))
    return align(rows.repartition(partitions) if partitions else rows)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Parquet where the path says or holds it, JSON lines by suffix, else CSV; always in the declared schema."""
    name = path.rstrip("/").lower()
    if name.endswith((".jsonl", ".json", ".jsonl.gz", ".json.gz")):
        return align(spark.read.schema(SCHEMA).json(path))
    if name.endswith(".parquet") or _holds(spark, path, ".parquet"):
        return align(spark.read.parquet(path))
    return align(read_csv(spark, path))


def _holds(spark: SparkSession, path: str, suffix: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(folder) and fs.getFileStatus(folder).isDirectory() and any(s.getPath().getName().endswith(suffix) for s in fs.listStatus(folder)))


def resolve_path(given: str | None = None, variable: str = "REVIEW_DATA_PATH", default: str | None = None) -> str:
    """Argument, else environment, else default; a local path must exist, a URI is taken as it is."""
    path = given or os.environ.get(variable) or default
    if not path:
        raise ValueError(f"no data path: pass one or set {variable}")
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def union_categories(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_table(df: DataFrame, folder: str, name: str) -> str:
    """A small result table as one CSV file in folder/name."""
    path = f"{folder.rstrip('/')}/{name}"
    write(df.coalesce(1), path, "csv")
    return path


def manifest(corpus: DataFrame, by: str = "Category") -> DataFrame:
    """Rows, users and items of each category."""
    return corpus.groupBy(by).agg(F.count("*").alias("reviews"), F.countDistinct("user_id").alias("users"), F.countDistinct("parent_asin").alias("items"))


def peek(df: DataFrame) -> DataFrame:
    """Reviews, mean votes and share with any vote, by year."""
    return df.groupBy(F.year(F.timestamp_millis("timestamp")).alias("year")).agg(F.count("*").alias("reviews"), F.avg("helpful_vote").alias("avg_votes"), F.avg((F.col("helpful_vote") >= 1).cast("double")).alias("share_any"))
