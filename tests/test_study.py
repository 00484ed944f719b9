"""The whole study on the smallest tables, with small models."""

import pytest
from pyspark.sql import functions as F

from gleanery.adapters import COLLECTED, ORDER, reviews
from gleanery.plans import figures, sections, study
from tests.test_oracle import SF, pytestmark  # noqa: F401


@pytest.fixture(scope="module")
def done(spark):
    rows = reviews(spark, SF).withColumns({"text": F.concat_ws(" ", "title", "Category"), "timestamp": F.col("ts"), "asin": F.col("parent_asin").cast("string")})
    audit = spark.createDataFrame([(0, "raw", 100), (1, "valid rating", 90)], "step_no int, step string, rows long")
    settings = study.Settings(COLLECTED, order=ORDER, trees=2, rounds=2, max_iter=3, ks=range(2, 4), pagerank_rounds=2, text_features=False)
    out = study.build(spark, rows, settings, audit)
    out.run()
    yield out
    study.finish(out)


def test_every_stage_ends_well(done, spark):
    assert [(n, d) for n, status, _, d in done.status if status != "ok"] == []
    assert len(study.tables(done)) > 25 and done.status_table(spark).count() == len(done.stages)
    name, model, threshold = study.best_model(done)
    assert name in done.results["fitted"][0] and 0 <= threshold <= 1 and model.stages


def test_report_and_figures_come_from_the_tables(done):
    tables = study.tables(done)
    text = sections.report_of(tables)
    assert text.count("\n## ") == 7 and "_not available_" not in text and "Of 100 raw reviews 90" in text
    best = max(r["pr_auc"] for r in tables["models"].collect())
    assert f"{best:.4f}" in text
    data = figures.figure_data(done.results)
    assert set(data) == set(figures.FIGURES) and data["leakage"].count() == 4 and data["shrinkage"].agg(F.sum("products")).first()[0] == done.results["products"].count()
    assert sections.report_of({}).count("_not available_") == 7
