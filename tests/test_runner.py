"""A study that is stopped goes on where it ended."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from gleanery.plans.runner import Store, Study
from gleanery.plans.study import Settings


def build(spark, path, calls, broken=False, settings=None):
    rows = spark.range(30).select(F.col("id"), (F.col("id") % 5).cast("double").alias("x"))
    study = Study(Store(spark, path, Store.fingerprint(settings or Settings("2020-01-01"), rows)))

    def stage(name, f, *needs, **kw):
        def run(*got):
            calls.append(name)
            return f(*got)

        study.stage(name, *needs, **kw)(run)

    def last(_):
        if broken:
            raise RuntimeError("executor lost")
        return spark.range(1)

    stage("frame", lambda: rows.withColumn("y", F.col("x") * 2).persist())
    stage("some", lambda f: f.filter("x > 1"), "frame", view=True)
    stage("fitted", lambda f: ({"scaler": Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v"), StandardScaler(inputCol="v", outputCol="s")]).fit(f)}, f.groupBy("x").count(), {2: 0.5, 3: None}, [1, "a"]), "some")
    stage("last", last, "fitted")
    return study


def test_a_stopped_study_goes_on_without_refitting(spark, tmp_path):
    calls = []
    first = build(spark, str(tmp_path), calls, broken=True)
    first.run()
    assert calls == ["frame", "some", "fitted", "last"] and [s for _, s, *_ in first.status] == ["ok", "ok", "ok", "failed"]
    calls.clear()
    again = build(spark, str(tmp_path), calls)
    again.run(stop_on_error=True)
    assert calls == ["some", "last"] and [s for _, s, *_ in again.status] == ["read", "ok", "read", "ok"]
    models, counts, plain, listed = again.results["fitted"]
    assert counts.count() == 3 and plain == {2: 0.5, 3: None} and listed == [1, "a"] and models["scaler"].transform(again.results["frame"]).count() == 30
    calls.clear()
    build(spark, str(tmp_path), calls, settings=Settings("2021-01-01")).run()
    assert calls == ["frame", "some", "fitted", "last"]  # other settings share nothing


def test_a_half_written_stage_is_made_again(spark, tmp_path):
    store = Store(spark, str(tmp_path), "f")
    with pytest.raises(TypeError):
        store.write("x", [spark.range(3), object()])
    assert not store.has("x")
    assert store.write("x", [spark.range(3)])[0].count() == 3 and store.has("x")
