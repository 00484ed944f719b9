"""The test tables in the roles of a review corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLLECTED = "2002-01-01"
#: A total order of the rows of a user or item.
ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
SEARCH, EXPERIENCE = ["ECONOMY", "STANDARD", "MEDIUM"], ["SMALL", "LARGE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order and part: a review per line, integers only where results must be exact."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    quantity = F.col("l_quantity").cast("int")
    h = (F.col("l_partkey") * 7 + F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 100
    kind = F.when(F.col("p_type").isin(SEARCH), "search").when(F.col("p_type").isin(EXPERIENCE), "experience").otherwise("unmapped")
    return rows.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("parent_asin"), F.col("p_brand").alias("brand"), F.col("p_type").alias("Category"), F.col("p_name").alias("title"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_shipdate").cast("timestamp").alias("event_time"),
        (1 + quantity % 5).cast("double").alias("rating"),
        F.when(h < 75, 0).when(h < 90, 1).when(h < 97, 2 + quantity % 4).otherwise(quantity).alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.05), '["i"]').otherwise("[]").alias("images"),
        kind.alias("product_type"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )


#: The same frame as a DuckDB common table expression named r.
REVIEWS_SQL = """r AS (SELECT o_custkey AS user_id, l_partkey AS parent_asin, p_brand AS brand, p_type AS Category, p_name AS title, epoch_ms(l_shipdate) AS ts, l_shipdate AS event_time,
  CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) AS rating,
  CASE WHEN (l_partkey * 7 + l_orderkey * 13 + l_linenumber) % 100 < 75 THEN 0 WHEN (l_partkey * 7 + l_orderkey * 13 + l_linenumber) % 100 < 90 THEN 1
       WHEN (l_partkey * 7 + l_orderkey * 13 + l_linenumber) % 100 < 97 THEN 2 + CAST(l_quantity AS INT) % 4 ELSE CAST(l_quantity AS INT) END AS helpful_vote,
  l_returnflag <> 'R' AS verified_purchase, CASE WHEN l_linestatus = 'F' AND l_discount >= 0.05 THEN '["i"]' ELSE '[]' END AS images,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'MEDIUM') THEN 'search' WHEN p_type IN ('SMALL', 'LARGE') THEN 'experience' ELSE 'unmapped' END AS product_type,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
ORDER_SQL = ", ".join(ORDER)
