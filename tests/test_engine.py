"""Micro fixtures and invariants of the engine's own operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery import catalog
from gleanery.functions import text as tx
from gleanery.operators import clean, graph, history, metrics, ranking, running, segments
from gleanery.plans import benchmark, ml, report, runner, scorer, stats
from gleanery.sources import reviews as src


def one(df):
    return df.first().asDict()


# --- sources ---------------------------------------------------------------


def test_formats_and_alignment(spark, tmp_path):
    row = ("a1", 3, "[]", "p1", 4.0, 'said "hi",\nthen left', 1_600_000_000_000, "t", "u1", True, "Books")
    df = spark.createDataFrame([row], src.SCHEMA)
    for kind in ("parquet", "csv"):
        src.write(df, f"{tmp_path}/{kind}", kind)
        assert tuple(src.read_reviews(spark, f"{tmp_path}/{kind}").first()) == row
    df.drop("Category").coalesce(1).write.option("compression", "gzip").json(f"{tmp_path}/dump")
    back = src.read_json_lines(spark, f"{tmp_path}/dump", "Books", partitions=3)
    assert tuple(back.first()) == row and back.rdd.getNumPartitions() == 3
    odd = src.align(spark.createDataFrame([("x", "bad")], "user_id string, rating string"))
    assert odd.columns == src.SCHEMA.names and odd.first()["rating"] is None


def test_corrupt_csv_rows_can_be_counted(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("asin,helpful_vote,images,parent_asin,rating,text,timestamp,title,user_id,verified_purchase,Category\na,notanumber,[],p,5.0,t,1,x,u,true,c\na,1,[],p,5.0,t,1,x,u,true,c\n")
    assert src.read_csv(spark, str(path)).cache().filter(F.col(src.CORRUPT).isNotNull()).count() == 1


def test_path_resolution(monkeypatch, tmp_path):
    monkeypatch.setenv("REVIEW_DATA_PATH", str(tmp_path))
    assert src.resolve_path() == str(tmp_path) and src.resolve_path("s3://bucket/x") == "s3://bucket/x"
    with pytest.raises(FileNotFoundError):
        src.resolve_path("/no/such/path")


# --- cleaning --------------------------------------------------------------


def test_each_cleaning_step_fails_once(spark):
    good = ("u", "a", 1000, 5.0, "long enough text for it", "t", 1, 0)
    bad = [good, ("u", "b", 1000, 9.0, *good[4:]), ("u", "c", -1, *good[3:]), (*good[:-1], 1), ("u", "d", 1000, 5.0, "nan", *good[5:]), ("u", "e", 1000, 5.0, "short", *good[5:]), ("u", "f", 1000, 5.0, *good[4:6], -1, 0), ("u", "g", 1000, 5.0, good[4], None, 2, 0)]
    df = spark.createDataFrame(bad, "user_id string, asin string, timestamp long, rating double, text string, title string, helpful_vote int, n int")
    marked = clean.staged(df, ["n"])
    assert [r.rows for r in clean.audit(marked).orderBy("step_no").collect()] == [8, 7, 6, 5, 4, 3, 2]
    assert sorted(r.title for r in clean.clean(df, ["n"]).collect()) == ["", "t"]


@pytest.mark.parametrize("token", clean.NA_TOKENS)
def test_na_tokens(spark, token):
    assert spark.createDataFrame([(token,)], "t string").select(clean.nullify(F.col("t"))).first()[0] is None


def test_exposure_edges(spark):
    days = {"2001-01-01": 365, "2001-01-02": 364, "2000-12-31": 366, "2002-06-01": -151}
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("event_time", F.to_timestamp("d"))
    assert {r.d for r in clean.exposure(df, "2002-01-01").collect()} == {"2001-01-01", "2000-12-31"}


# --- history ---------------------------------------------------------------

TIES = [(1, 10, 1, 2.0), (1, 10, 2, 4.0), (1, 20, 3, 6.0), (2, 5, 4, 1.0)]


def test_history_of_ties_and_first_rows(spark):
    df = spark.createDataFrame(TIES, "u long, ts long, seq long, v double")
    rows = history.prior_history(df, "u", ["ts", "seq"], {"m": "v"}, "n")
    assert {r.seq: (r.n, r.m) for r in rows.collect()} == {1: (0, None), 2: (1, 2.0), 3: (2, 3.0), 4: (0, None)}
    strict = history.prior_history(df, "u", ["ts", "seq"], {"m": "v"}, "n", strict=True)
    assert {r.seq: (r.n, r.m) for r in strict.collect()} == {1: (0, None), 2: (0, None), 3: (2, 3.0), 4: (0, None)}


def test_later_rows_do_not_change_history(spark):
    schema = "u long, ts long, seq long, v double"
    take = lambda rows: {r.seq: (r.n, r.m) for r in history.prior_history(spark.createDataFrame(rows, schema), "u", ["ts", "seq"], {"m": "v"}, "n").collect()}
    more = take([*TIES, (1, 99, 9, 100.0), (2, 98, 8, 50.0)])
    assert all(more[k] == v for k, v in take(TIES).items())


def test_splits_keep_keys_together_and_ignore_layout(spark):
    df = spark.range(2000).selectExpr("id % 300 AS u", "id AS ts")
    sampled = [{r.u for r in history.sample_users(df.repartition(n), "u", 0.3).select("u").distinct().collect()} for n in (1, 5)]
    assert sampled[0] == sampled[1] and 50 < len(sampled[0]) < 130
    counts = {r.split: r["count"] for r in history.temporal_split(df, "ts").groupBy("split").count().collect()}
    assert counts == {"train": 1399, "val": 300, "test": 301}


# --- features --------------------------------------------------------------


def test_text_edges(spark):
    texts = ["", "   ", "no end", "...", "Été à 7h!", "a\tb\nc", "123"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r.i: r for r in tx.sentiment(tx.lexical(tx.structural(df))).collect()}
    assert [rows[i].review_word_count for i in range(7)] == [0, 0, 2, 1, 3, 3, 1]
    assert [rows[i].sentence_count for i in range(7)] == [1, 1, 1, 1, 1, 1, 1]
    assert rows[6].digit_ratio == 1 and rows[4].exclamation_count == 1 and rows[0].type_token_ratio == 1


def test_all_features_are_finite_numbers(spark):
    df = spark.createDataFrame([("good bad", "t", None, None, None, 0, None, 1.0), (None, None, "[]", 5.0, True, 1, 2.0, float("inf"))], "text string, title string, images string, rating double, verified_purchase boolean, is_first_review_of_product int, product_prior_avg_rating double, log_exposure_days double")
    for row in tx.add_features(df).collect():
        assert all(np.isfinite(row[c]) for c in tx.ALL_NUMERIC if c in row.asDict())
    assert len(tx.ALL_NUMERIC) == 35


# --- metrics ---------------------------------------------------------------


def scores(spark, pairs):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, y int, p double")


def test_rank_metrics_on_ties_and_edges(spark):
    c = lambda pairs: metrics.curve(scores(spark, pairs), "y", "p")
    assert one(metrics.roc_auc(c([(1, 0.5), (0, 0.5)])))["roc_auc"] == 0.5
    assert one(metrics.roc_auc(c([(1, 0.5), (1, 0.2)])))["roc_auc"] is None
    assert one(metrics.average_precision(c([(1, 0.9), (0, 0.1)])))["pr_auc"] == 1
    assert one(metrics.average_precision(c([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)])))["pr_auc"] == 0.5
    assert one(metrics.best_f1(c([(1, 0.9), (1, 0.8), (0, 0.1)])))["f1"] == 1
    rng = np.random.default_rng(0)
    pairs = [(int(rng.random() < 0.3), float(rng.integers(8))) for _ in range(200)]
    y, p = np.array(pairs).T
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
    assert one(metrics.roc_auc(c(pairs)))["roc_auc"] == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))


def test_ndcg_guards(spark):
    rows = [(g, r, float(s), k) for g, items in {1: [(2, 5), (0, 4), (0, 3), (1, 2), (0, 1)], 2: [(1, 1)] * 4, 3: [(0, 1)] * 6, 4: [(5000, 1), (0, 2), (0, 3), (0, 4), (0, 5)]}.items() for k, (r, s) in enumerate(items)]
    got = one(metrics.ndcg(spark.createDataFrame(rows, "g int, rel int, s double, k int"), "g", "rel", "s", ["k"]))
    assert got["n_products_ranked"] == 2 and 0 < got["ndcg"] <= 1


# --- ranking, graph --------------------------------------------------------


def test_wilson_and_gini_edges(spark):
    n = spark.createDataFrame([(1.0, 1), (0.0, 4), (1.0, 100)], "p double, n int").select(ranking.wilson(F.col("p"), F.col("n")).alias("w")).collect()
    assert 0 < n[0].w < 0.5 and n[1].w == pytest.approx(0, abs=1e-12) and n[2].w > 0.95
    g = lambda v: one(ranking.gini(spark.createDataFrame([(x,) for x in v], "v double"), "v"))["gini"]
    assert g([3.0, 3.0, 3.0]) == pytest.approx(0) and g([0.0, 0.0, 0.0, 8.0]) == pytest.approx(0.75) and g([0.0, 0.0]) is None and g([]) is None


def test_bayes_without_variance_falls_back(spark):
    stats_ = spark.createDataFrame([(10, 0.5, 5.0), (20, 0.5, 10.0)], "n int, p_positive double, n_positive double")
    assert [r.bayesian for r in ranking.with_bayes(stats_).orderBy("n").collect()] == pytest.approx([6 / 12, 11 / 22])


def test_components_of_long_paths(spark):
    edges = [(f"u:{k}", f"p:{k}") for k in range(20)] + [(f"u:{k + 1}", f"p:{k}") for k in range(19)] + [("u:x", "p:x"), ("u:x", "p:x")]
    labels = graph.components(spark.createDataFrame(edges, "src string, dst string"))
    assert sorted(r["size"] for r in graph.component_sizes(labels).collect()) == [2, 40]


def test_graph_summary_is_of_all_orders(spark, tmp_path):
    lines = [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 3), (3, 2, 3), (4, 1, 4)]
    lines = [(o, n, p, 1, 1.0, 5.0, 0.0, "N", "O") for o, n, p in lines]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string, l_linestatus string").selectExpr("*", "date'1998-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 10 + k) for k in range(1, 5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, "b", "t", "n") for k in range(1, 5)], "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    row = catalog.graph_summary(spark, str(tmp_path)).first()
    assert (row.vertices, row.reviewers, row.products, row.edges, row.components, row.largest) == (6, 3, 3, 6, 2, 4)


def test_interaction_model_finds_planted_moderation(spark):
    """Depth helps search goods more, so its interaction with experience is negative."""
    rng = np.random.default_rng(4)
    n = 4000
    kind = rng.random(n) < 0.5
    depth, extremity = rng.normal(size=n), rng.normal(size=n)
    eta = -0.5 + depth * np.where(kind, 0.2, 1.2) + 0.3 * extremity
    label = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = [(float(d), float(e), "experience" if k else "search", int(y), float(i % 3 == 0), float(i % 4 == 0)) for i, (d, e, k, y) in enumerate(zip(depth, extremity, kind, label))]
    df = spark.createDataFrame(rows, "log_review_length double, rating_extremity double, product_type string, label int, verified_int double, has_images double")
    found = {r["term"]: r for r in stats.interaction_model(df)}
    assert found["depth_x_experience"]["coefficient"] < -0.7 and found["depth_x_experience"]["hypothesis"] == "supported"
    assert found["extremity_x_experience"]["hypothesis"] == "not supported" or abs(found["extremity_x_experience"]["coefficient"]) < 0.3
    assert stats.interaction_model(df.limit(500)) == []
    # effects at the mean by finite differences
    fit = {r["term"]: r for r in stats.logit(df.select("label", "log_review_length", "rating_extremity"), ["log_review_length", "rating_extremity"])}
    beta = np.array([fit[t]["coefficient"] for t in ("intercept", "log_review_length", "rating_extremity")])
    at = np.array([1.0, depth.mean(), extremity.mean()])
    p = lambda x: 1 / (1 + np.exp(-x @ beta))
    step = np.array([0, 1e-5, 0])
    assert fit["log_review_length"]["effect_at_mean"] == pytest.approx((p(at + step) - p(at - step)) / 2e-5, rel=1e-4)


def test_replication_needs_rows_and_counts_verdicts(spark):
    frame = spark.createDataFrame([(0.1 * i, float(i % 5), "search", i % 2) for i in range(50)], "log_review_length double, rating_extremity double, product_type string, label int").withColumns({c: F.lit(0.5) for c in ("flesch_reading_ease", "log_prior_review_count", "type_token_ratio", "rating_deviation_from_product", "sentiment_polarity", "log_exposure_days", "verified_int", "has_images")}).withColumn("arrival_position", F.lit(1))
    out = stats.replication(spark, frame, stats.registry_table(spark))
    assert [tuple(r) for r in stats.verdict_counts(out).collect()] == [("NOT TESTABLE", 12, 1.0)]


def test_samples_by_hash(spark):
    df = spark.range(4000).withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    some = history.stratified_sample(df, "g", {"a": 0.25, "b": 1.0}, "id")
    n = {r.g: r["count"] for r in some.groupBy("g").count().collect()}
    assert n["b"] == 2000 and 420 < n["a"] < 580
    assert history.stratified_sample(df, "g", {"c": 1.0}, "id").count() == 0
    assert sorted(r.id for r in some.repartition(3).collect()) == sorted(r.id for r in some.collect())


def test_running_totals_equal_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(running, "FEW", 3)
    rng = random.Random(3)
    keys = [None, *{round(rng.gauss(0, 50), 2) for _ in range(700)}]
    rows = [(k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "k double, n long")
    for down in (False, True):
        got = {r.k: r.upto for r in running.running_totals(df, "k", {"upto": "n"}, down, 16).collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0), reverse=down)
        total, want = 0, {}
        for k, n in order:
            total += n
            want[k] = total
        assert got == want
    assert running.running_totals(df.limit(0), "k", {"upto": "n"}).count() == 0


def test_lift_breaks_ties_at_the_cut_only(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.1, 0.2, 0.9, None]), int(rng.random() < 0.3)) for i in range(437)]
    df = spark.createDataFrame(rows, "i long, p double, y int")
    for share in (0.1, 0.02, 0.5, 1.0):
        top = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))[: max(1, int(437 * share))]
        want = sum(r[2] for r in top) / len(top) / (sum(r[2] for r in rows) / 437)
        assert metrics.lift_at(df, "y", "p", "i", share).first().lift == pytest.approx(want)
    assert metrics.lift_at(df.limit(0), "y", "p", "i").first().lift is None


def test_evaluate_holds_every_measure(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, i % 20, rng.random(), rng.randint(0, 3)) for i in range(300)], "i long, g int, p double, rel int").withColumn("y", (F.col("rel") > 1).cast("int"))
    row = metrics.evaluate(df, "y", "p", "i", "g", "rel").first()
    assert row.n == 300 and row.n_products_ranked == 20 and 0 < row.ndcg < 1
    assert row.pr_auc == pytest.approx(metrics.average_precision(metrics.curve(df, "y", "p")).first().pr_auc)


def test_graph_cap_guards_and_centrality(spark):
    df = spark.createDataFrame([(u, p, 1.0) for u in range(8) for p in range(u + 1)], "u int, p int, w double")
    edges, degree = graph.capped(df, "u", "p", "w", 9)
    assert degree > 2 and graph.vertices(edges).count() <= 9
    row = graph.guards(graph.summary(edges, graph.components(edges)), df).first()
    assert row.too_small and row.giant and row.edge_share == pytest.approx(edges.count() / df.count())
    top = graph.top_components(graph.components(edges)).collect()
    assert len(top) == 1 and top[0].share == 1.0
    assert graph.capped(df, "u", "p", "w", 1)[1] == graph.MOST_DEGREE
    ranks = spark.createDataFrame([("u:1", 0.1), ("u:2", 0.2), ("u:3", 0.3)], "id string, rank double")
    activity = spark.createDataFrame([("u:1", 1, 5), ("u:2", 2, 1), ("u:3", 3, 9)], "id string, n int, v int")
    assert graph.activity_link(ranks, activity, "n", "v").first().centrality == "restates activity"


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("u:1", "p:1"), ("u:1", "p:2"), ("u:2", "p:2"), ("u:3", "p:2")], "src string, dst string")
    ranks = {r.id: r["rank"] for r in graph.pagerank(edges, 4).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "p:2"


# --- models, inference -----------------------------------------------------


def planted(spark, n=4000):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = rng.random(n) < 1 / (1 + np.exp(-(-0.5 + 1.2 * x[:, 0] - 0.1 * x[:, 1])))
    return x, y.astype(float), spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "i int, a double, b double, label double")


def test_logit_against_newton(spark):
    x, y, df = planted(spark)
    design, beta = np.column_stack([np.ones(len(y)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        information = design.T @ (design * (p * (1 - p))[:, None])
        beta += np.linalg.solve(information, design.T @ (y - p))
    got = stats.logit(df, ["a", "b"])
    assert [r["coefficient"] for r in got] == pytest.approx(beta.tolist(), abs=1e-6)
    assert [r["std_error"] for r in got] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(information))).tolist(), rel=1e-4)
    assert got[1]["p_value"] < 1e-6


def test_verdicts(spark):
    cases = [(None, None, None, "positive", "NOT TESTABLE"), (1.0, 0.5, 0.1, "positive", "FAILS"), (-1.0, 0.0, -0.1, "positive", "REVERSES"), (1.0, 0.0, 0.001, "positive", "WEAKENS"), (1.0, 0.0, 0.1, "positive", "REPLICATES")]
    df = spark.createDataFrame(cases, "c double, p double, e double, x string, want string")
    assert all(r.v == r.want for r in df.withColumn("v", stats.verdict(F.col("c"), F.col("p"), F.col("e"), F.col("x"))).collect())
    tests = spark.createDataFrame([("reviewer_history", 0.01, False), ("product_history", 0.9, True)], "requirement string, share double, testable boolean")
    estimates = spark.createDataFrame([(f.term, 1.0, 0.0, 0.1) for f in stats.REGISTRY], "term string, coefficient double, p_value double, effect_at_mean double")
    got = {r.id: r.verdict for r in stats.verdicts(stats.registry_table(spark), estimates, tests).collect()}
    assert len(got) == 12 and got["F07"] == "NOT TESTABLE" and got["F09"] == "REPLICATES" and got["F02"] == "REVERSES"
    assert stats.hypothesis(-1, 0.01, "positive").endswith("opposite sign")


def test_models_beat_the_base_rate_and_reload(spark, tmp_path):
    _, _, df = planted(spark, 1500)
    df = df.withColumn("label", F.col("label").cast("int"))
    model, row = ml.fit_and_evaluate("lr", ml.linear_classifiers()["logistic_l2"], ml.feature_stages(["a", "b"]), df.filter("i % 3 > 0"), df.filter("i % 3 = 0"), "i")
    assert one(row)["pr_auc"] > one(row)["base_rate"] and one(row)["roc_auc"] > 0.6
    ml.save(model, str(tmp_path / "m"), 0.4, spark)
    again, threshold = ml.load(str(tmp_path / "m"), spark)
    assert threshold == 0.4 and again.transform(df).count() == 1500


def test_regression_metrics_and_mean(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k) for k in range(40)], "x double, y double")
    out = {(r.model, r.subset): r for r in ml.regression_zoo(df, df, ["x"], "y", {"linear": ml.regressors()["linear"]}).collect()}
    assert out["linear", "all"].r2 > 0.99 and out["training mean", "all"].r2 == pytest.approx(0)


def test_segment_names_go_to_the_largest_gaps(spark):
    rows = [(k, 5 * k + 6, *[v if m != "n_reviews" else 3.0 for m in segments.FEATURES]) for k, v in enumerate((1.0, 2.0, 9.0))]
    summary = spark.createDataFrame(rows, f"prediction int, reviewers long, {', '.join(f'{m} double' for m in segments.FEATURES)}")
    got = {r.prediction: r for r in segments.name_segments(summary).collect()}
    assert len({r.segment for r in got.values()}) == 3 and got[2].segment == "high avg_helpful" and got[0].segment == "low avg_helpful"
    assert [got[k].isolated for k in range(3)] == [True, False, False]
    alone = segments.name_segments(summary.limit(1)).first()
    assert alone.segment == "high avg_helpful" and segments.name_segments(summary.limit(0)).count() == 0
    assert len(segments.warnings(10, 1000, {2: 0.5, 3: 0.52}, 1)) == 4 and segments.warnings(500, 600, {2: 0.1, 3: 0.5}) == []


# --- scorer, report, runner ------------------------------------------------


def test_one_draft_scores_like_a_table(spark, capsys):
    text = "Bought 2 of these! GREAT value, works well. " * 4
    shown = scorer.main(["--text", text, "--rating", "5", "--category", "Electronics", "--unverified"], spark)
    row = spark.createDataFrame([(text.strip(), "", 5.0, "search", 0.0, "[]")], "text string, title string, rating double, product_type string, verified_int double, images string")
    scored = scorer.score(row).first()
    assert f"{scored.probability:.3f}" in shown and scored.verdict in shown and len(scorer.ADVICE) == len(scorer.CONDITIONS)
    assert {"Rating", "Verification"} <= {t.label for t in scored.tips}


def test_report_renders(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.25, None)], "name string, share double, note string")
    assert report.table(df.columns, df.collect()) == "| name | share | note |\n| --- | --- | --- |\n| a | 0.25 | - |"
    src.write_table(df, str(tmp_path), "t1")
    assert "0.25" in report.section("T", report.load_table(spark, str(tmp_path), "t1"))
    assert "not available" in report.section("T", report.load_table(spark, str(tmp_path), "missing"))
    assert report.leakage_note({"history": 0.07, "random split": 0.13}).startswith("random split")


def test_study_reports_failures(spark):
    study = runner.Study()
    study.stage("a")(lambda: 1)
    study.stage("b")(lambda: 1 / 0)
    study.stage("c", "b")(lambda b: b)
    study.stage("d", "a")(lambda a: a + 1)
    assert study.run() == {"a": 1, "d": 2}
    assert [r.status for r in study.status_table(spark).collect()] == ["ok", "failed", "skipped", "ok"]


def test_crossover(spark):
    df = spark.createDataFrame([("w", 10, 2.0, 1.0), ("w", 100, 1.0, 1.5), ("w", 1000, 1.0, 9.0)], "workload string, rows int, spark_s double, other_s double")
    assert one(benchmark.crossover(df)) == {"workload": "w", "crossover_rows": 100, "ratio_falls": True}
