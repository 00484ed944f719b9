"""Audits gathered while writing, layouts by key, mergeable sketches."""

import pytest
from pyspark.sql import functions as F

from gleanery import catalog
from gleanery.adapters import COLLECTED, reviews
from gleanery.operators import clean, history
from gleanery.sources import layout, sketches
from tests.test_oracle import SIZES, pytestmark  # noqa: F401

SF = SIZES[1]


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    out = f()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_audit_is_gathered_while_rows_are_written(spark, tmp_path):
    dirty = catalog._dirty(spark, SF)
    got = clean.write_audited(spark, dirty, f"{tmp_path}/clean", catalog._IDS).collect()
    want = clean.audit(clean.staged(dirty, catalog._IDS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    written = spark.read.parquet(f"{tmp_path}/clean")
    assert written.count() == got[-1]["rows"] and "stage" not in written.columns
    more = {r.step: r.rows for r in clean.write_audited(spark, dirty, f"{tmp_path}/exposed", catalog._IDS, COLLECTED).collect()}
    assert more["exposed"] == spark.read.parquet(f"{tmp_path}/exposed").count() == clean.exposure(written, COLLECTED).count()


def test_layout_needs_no_exchange_below_history_and_profiles(spark, tmp_path):
    rows = reviews(spark, SF)
    laid = layout.lay_out(rows, f"{tmp_path}/by_user", "user_id", ["ts"], buckets=4)
    again = layout.attach(spark, f"{tmp_path}/by_user")
    order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    before = history.prior_history(rows, "user_id", order, {"m": "rating"}, "n")
    assert layout.exchanges(before) > 0
    for table in (laid, again):
        found = history.prior_history(table, "user_id", order, {"m": "rating"}, "n")
        assert layout.exchanges(found) == 0 and layout.exchanges(layout.profile(table, "user_id")) == 0
        assert found.agg(F.sum("n"), F.round(F.sum("m"), 6)).first() == before.agg(F.sum("n"), F.round(F.sum("m"), 6)).first()
        assert table.schema == rows.schema or [f.dataType for f in table.schema] == [f.dataType for f in rows.schema]


def test_sketches_keep_their_bounds_and_grow_by_union(spark, tmp_path):
    rows = reviews(spark, SF).withColumn("timestamp", F.col("ts"))
    whole = sketches.sketched(rows)
    first, second = rows.filter("l_orderkey % 3 = 0"), rows.filter("l_orderkey % 3 <> 0")
    sketches.append(spark, f"{tmp_path}/store", first, "a")
    sketches.append(spark, f"{tmp_path}/store", second, "b")
    grown = sketches.append(spark, f"{tmp_path}/store", second, "b")
    got = {r.Category: r for r in sketches.estimates(grown).collect()}
    for r in rows.groupBy("Category").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.countDistinct("parent_asin").alias("i")).collect():
        assert got[r.Category].reviews == r.n and got[r.Category].users == pytest.approx(r.u, rel=0.06) and got[r.Category].items == pytest.approx(r.i, rel=0.06)
    rebuilt = {r.Category: r for r in sketches.estimates(sketches.merged(whole)).collect()}
    assert all(got[c].users == pytest.approx(rebuilt[c].users, rel=0.03) and got[c].items == pytest.approx(rebuilt[c].items, rel=0.03) for c in rebuilt)
    shares = {r.split: r.n / rows.count() for r in sketches.split(rows, grown, "ts").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert shares["train"] == pytest.approx(0.70, abs=0.02) and shares["val"] == pytest.approx(0.15, abs=0.02)
