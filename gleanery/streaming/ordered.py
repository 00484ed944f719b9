"""Prior history over a stream in event time: rows wait until the watermark has passed them, so late ones are placed exactly.

State is, per key, three totals and the rows that are not yet due; the rows of a
key within the watermark's delay bound it.  A timer at the least waiting time
wakes a key when the watermark passes it; all rows that are due then are given
out in order of (time, id) and added to the totals.  Rows that come behind the
watermark are dropped by Spark and counted in the progress of the query
(`late_rows`).  The state store must be RocksDB's (`STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PriorHistory(StatefulProcessor):
    """Rows (key, id, us, value) in; (id, key, us, prior_count, prior_avg) out, when they are due."""

    def __init__(self, key: str, id_column: str):
        self.key, self.id = key, id_column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "rows long, n long, total double")
        self.waiting = handle.getListState("waiting", "us long, id string, value double, there boolean")

    def _due(self, us: int) -> int:
        """The first millisecond at which the row is surely passed."""
        return -(-us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        there = found["value"].notna()
        values = zip(found["us"].tolist(), found["id"].astype(str).tolist(), found["value"].fillna(0.0).tolist(), there.tolist(), strict=True)
        self.waiting.appendList([(int(us), i, float(v), bool(t)) for us, i, v, t in values])
        self.handle.registerTimer(self._due(int(found["us"].min())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((r for r in held if self._due(r[0]) <= now), key=lambda r: (r[0], *self._order(r[1])))
        later = [r for r in held if self._due(r[0]) > now]
        if not due:
            return
        rows, n, total = self.totals.get() if self.totals.exists() else (0, 0, 0.0)
        out = []
        for us, i, value, there in due:
            out.append((i, key[0], us, rows, total / n if n else None))
            rows, n, total = rows + 1, n + there, total + value
        self.totals.update((rows, n, total))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(self._due(min(r[0] for r in later)))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["id", self.key, "us", "prior_count", "prior_avg"]).astype({"prior_avg": float})

    def _order(self, i: str) -> tuple:
        return (0, int(i), "") if i.lstrip("-").isdigit() else (1, 0, i)

    def close(self) -> None:
        pass


def prior_history(stream: DataFrame, key: str, time: str, id_column: str, value: str, delay: str = "1 hour") -> DataFrame:
    """(id, key, event time, prior_count, prior_avg) of every row, against all earlier rows of its key by (time, id).

    The result equals a batch scan over the rows that come at most `delay` behind
    the latest time seen; a row is given out once the watermark has passed it.
    `prior_avg` is the mean of the values that are not null.  Rows without a
    time are dropped: they have no place.  `id` may be of any type that casts to
    a string and back; whole numbers are ordered as such.
    """
    kinds = dict(stream.dtypes)
    rows = stream.filter(F.col(time).isNotNull()).select(F.col(key), F.col(id_column).cast("string").alias("id"), F.col(time).cast("timestamp").alias("_time"), F.col(value).cast("double").alias("value"))
    marked = rows.withWatermark("_time", delay).withColumn("us", F.unix_micros("_time"))
    schema = f"id string, `{key}` {kinds[key]}, us long, prior_count long, prior_avg double"
    out = marked.groupBy(key).transformWithStateInPandas(PriorHistory(key, id_column), schema, "Append", "EventTime")
    return out.select(F.col("id").cast(kinds[id_column]).alias(id_column), key, F.timestamp_micros("us").alias(time), "prior_count", F.when(~F.isnan("prior_avg"), F.col("prior_avg")).alias("prior_avg"))


def prepare(spark: SparkSession) -> None:
    """The state store that this needs."""
    spark.conf.set(*STORE)


def late_rows(query) -> int:
    """How many rows a streaming query has dropped behind its watermark, as far as its kept progress tells."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p.get("stateOperators", []))
