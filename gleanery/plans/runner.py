"""The batch study as named stages with a status row each, and a store that finished stages are read from again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from time import perf_counter

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from gleanery.operators.lineage import remove_folder

STATUS = "stage string, status string, seconds double, detail string"


class Store:
    """Stage results under a path that driver and executors share, by a fingerprint of what they depend on.

    Tables are Parquet, fitted pipelines are saved as such, and plain values are
    JSON; lists, tuples and dicts may hold any of these.  A result counts as
    stored once its description is written, which comes last, so a run that ends
    in the middle of one leaves none behind.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{fingerprint}"

    @staticmethod
    def fingerprint(*what) -> str:
        """A hash of plain values and of tables: their schema, files and number of rows."""
        parts = []
        for x in what:
            if isinstance(x, DataFrame):
                files = sorted(x.inputFiles())
                parts.append(f"{x.schema.json()} {files} {x.count()}")
            else:
                parts.append(repr(x))
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]

    def _lines(self, path: str) -> list[str]:
        return [r["value"] for r in self.spark.read.text(path).collect()]  # one line

    def has(self, name: str) -> bool:
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/done/_SUCCESS")
        return bool(where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where))

    def write(self, name: str, value):
        """Stores the value, and returns it as it is read again."""
        remove_folder(self.spark, f"{self.path}/{name}")
        told = json.dumps(self._put(value, f"{self.path}/{name}/v"))
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.path}/{name}/done")
        return self.read(name)

    def read(self, name: str):
        return self._get(json.loads(self._lines(f"{self.path}/{name}/done")[0]))

    def _put(self, x, path: str):
        if isinstance(x, DataFrame):
            x.write.mode("overwrite").parquet(path)
            x.unpersist()
            return {"table": path}
        if isinstance(x, PipelineModel):
            x.write().overwrite().save(path)
            return {"pipeline": path}
        if isinstance(x, dict):
            return {"dict": [[self._put(k, ""), self._put(v, f"{path}_{i}")] for i, (k, v) in enumerate(x.items())]}
        if isinstance(x, (list, tuple)):
            return {type(x).__name__: [self._put(v, f"{path}_{i}") for i, v in enumerate(x)]}
        if x is None or isinstance(x, (bool, int, float, str)):
            return {"plain": x}
        raise TypeError(f"a stage result of type {type(x).__name__} can't be stored")

    def _get(self, told: dict):
        ((kind, x),) = told.items()
        if kind == "table":
            return self.spark.read.parquet(x)
        if kind == "pipeline":
            return PipelineModel.load(x)
        if kind == "dict":
            return {self._get(k): self._get(v) for k, v in x}
        if kind in ("list", "tuple"):
            return (tuple if kind == "tuple" else list)(self._get(v) for v in x)
        return x


class Study:
    """Stages in order; each may use the results of those it names, and is skipped if one of those failed.

    With a store, a stage's result is written when it ends well, and a later run
    with the same store reads it instead of making it again.
    """

    def __init__(self, store: Store | None = None):
        self.stages: list[tuple[str, Callable, tuple[str, ...]]] = []
        self.results: dict[str, object] = {}
        self.status: list[tuple[str, str, float, str]] = []
        self.store, self.views = store, set()

    def stage(self, name: str, *needs: str, view: bool = False):
        """`view`: the result is a cheap selection of others, which is made anew and not stored."""

        def add(f):
            self.stages.append((name, f, needs))
            self.views |= {name} if view else set()
            return f

        return add

    def run(self, stop_on_error: bool = False) -> dict[str, object]:
        for name, f, needs in self.stages:
            missing = [n for n in needs if n not in self.results]
            if missing:
                self.status.append((name, "skipped", 0.0, f"needs {', '.join(missing)}"))
                continue
            start = perf_counter()
            try:
                store = None if name in self.views else self.store
                if store and store.has(name):
                    self.results[name] = store.read(name)
                    self.status.append((name, "read", perf_counter() - start, ""))
                    continue
                found = f(*[self.results[n] for n in needs])
                self.results[name] = store.write(name, found) if store else found
                self.status.append((name, "ok", perf_counter() - start, ""))
            except Exception as error:
                self.status.append((name, "failed", perf_counter() - start, f"{type(error).__name__}: {error}"[:500]))
                if stop_on_error:
                    raise
        return self.results

    def status_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.status, STATUS)
