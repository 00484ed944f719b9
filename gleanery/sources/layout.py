"""Tables laid out by a key: bucketed and sorted files, so that windows, joins and groupings by that key need no exchange.

A layout is a folder of Parquet files and what a session must know of it (key,
order, number of buckets), which is kept beside the files.  `lay_out` writes one,
`attach` makes a table of it in this or any later session.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
FACTS = "_layout"


def _name() -> str:
    return f"layout_{uuid.uuid4().hex}"


def lay_out(df: DataFrame, path: str, key: str, order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Writes the rows in `buckets` files by a hash of the key, each sorted by key and `order`, and returns them as a table.

    One exchange, here; a bucket is one task, so `buckets` is chosen by the
    table's size.  Column names must not differ in case alone.
    """
    spark, order = df.sparkSession, order or []
    facts = json.dumps({"key": key, "order": order, "buckets": buckets, "schema": df.schema.jsonValue()})
    name = _name()
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order).option("path", path).format("parquet").mode("overwrite").saveAsTable(name)
    spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.{FACTS}")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('layout' = '{key}')")
    return spark.table(name)


def attach(spark: SparkSession, path: str) -> DataFrame:
    """The table of a layout that an earlier session wrote, with its buckets known to the planner."""
    facts = json.loads(spark.read.text(f"{path.rstrip('/')}.{FACTS}").first()["value"])
    columns = ", ".join(f"`{f['name']}` {_ddl(f['type'])}" for f in facts["schema"]["fields"])
    name = _name()
    by = f"CLUSTERED BY (`{facts['key']}`) SORTED BY ({', '.join(f'`{c}`' for c in [facts['key'], *facts['order']])}) INTO {facts['buckets']} BUCKETS"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} LOCATION '{path}'")
    return spark.table(name)


def _ddl(kind) -> str:
    """The SQL name of a type in its JSON form."""
    if isinstance(kind, str):
        return kind
    if kind["type"] == "array":
        return f"array<{_ddl(kind['elementType'])}>"
    if kind["type"] == "map":
        return f"map<{_ddl(kind['keyType'])}, {_ddl(kind['valueType'])}>"
    return f"struct<{', '.join(f'`{f['name']}`: {_ddl(f['type'])}' for f in kind['fields'])}>"


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan of a DataFrame has."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition") + plan.count("Exchange RoundRobin")


def profile(laid_out: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of each key; without an exchange where the table is laid out by it."""
    return laid_out.groupBy(key).agg(F.count("*").alias("n"))
