"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Fixed for results (time zone); the rest are defaults that a cluster's own configuration overrides.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # Texts may be long: a Python worker holds a batch of them at a time.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def get_or_create(app: str = "gleanery", master: str | None = None, **conf: str) -> SparkSession:
    """The active session if there is one (never stopped here), else a new one."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
