"""The whole study of a review corpus: result tables by name, made in stages that report their own failures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as tx
from gleanery.operators import clean, graph, history, provenance, ranking, segments
from gleanery.plans import benchmark, ml, stats
from gleanery.plans.runner import Store, Study

TIEBREAK = "row_id"
DEPTH = ["review_length", "log_review_length", "review_word_count"]
EXTREMITY = ["rating_extremity", "is_extreme_rating"]


@dataclass
class Settings:
    """What a study depends on besides its rows."""

    collected: str
    user: str = "user_id"
    item: str = "parent_asin"
    time: str = "timestamp"
    #: A total order of the rows of a user or item.
    order: list[str] = field(default_factory=lambda: ["timestamp", "asin", "user_id"])
    text_features: bool = True
    interaction: bool = True
    bench: bool = True
    #: The most vertices of the graph, beyond which it is cut to a denser core; None: all.
    most_vertices: int | None = None
    trees: int = 100
    rounds: int = 60
    max_iter: int = 50
    pagerank_rounds: int = 10
    ks: range = range(2, 7)


def frame(reviews: DataFrame, s: Settings) -> DataFrame:
    """Cleaned reviews with exposure, targets, leak-free history, leaky history, arrival, features, split and row_id."""
    rows = clean.targets(clean.exposure(reviews, s.collected))
    rows = history.prior_history(rows, s.user, s.order, {"prior_avg_helpful": "helpful_vote", "prior_avg_rating": "rating", "prior_avg_length": F.length("text")}, "prior_review_count")
    rows = history.no_history_flags(rows, "prior_review_count", ["prior_avg_helpful", "prior_avg_rating", "prior_avg_length"], "is_first_review_by_user")
    rows = history.prior_history(rows, s.item, s.order, {"product_prior_avg_rating": "rating"}, "product_prior_review_count")
    rows = history.no_history_flags(rows, "product_prior_review_count", ["product_prior_avg_rating"], "is_first_review_of_product")
    rows = history.arrival_position(history.whole_history(rows, s.user, "helpful_vote"), s.item, s.order)
    rows = rows.withColumns({"LEAKY_user_review_count": F.col("LEAKY_user_review_count").cast("double"), TIEBREAK: F.xxhash64(*s.order)})
    return history.temporal_split(tx.add_features(rows), s.time)


def descriptives(rows: DataFrame) -> DataFrame:
    measures = {"reviews": F.count("*"), "avg_rating": F.avg("rating"), "pct_helpful": 100 * F.avg("label"), "avg_votes": F.avg("helpful_vote"), "avg_length": F.avg("review_length"), "pct_verified": 100 * F.avg("verified_int")}
    return rows.groupBy("Category", "product_type").agg(*[c.alias(n) for n, c in measures.items()]).orderBy(F.desc("reviews"), "Category")


def arrival_measures() -> dict[str, Column]:
    return {"pct_any_vote": 100 * F.avg("label"), "avg_votes": F.avg("helpful_vote"), "avg_rating": F.avg("rating"), "avg_length": F.avg("review_length"), "pct_verified": 100 * F.avg("verified_int"), "avg_exposure_days": F.avg("exposure_days")}


def leakage_conditions(rows: DataFrame, numeric: list[str]) -> dict[str, tuple[DataFrame, DataFrame, list[str]]]:
    """Random and temporal splits, with and without the history that knows the future."""
    leaky = [*numeric, "LEAKY_user_avg_helpful", "LEAKY_user_review_count"]
    dealt = history.hash_split(rows, TIEBREAK, 0.8)
    random, temporal = (dealt.filter("in_train"), dealt.filter("NOT in_train")), (rows.filter("split = 'train'"), rows.filter("split = 'test'"))
    return {"A random, leaky": (*random, leaky), "B temporal, leaky": (*temporal, leaky), "C random, honest": (*random, numeric), "D temporal, honest": (*temporal, numeric)}


def table_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A result table from rows of plain values; columns in the order of the first."""
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0])) if rows else spark.createDataFrame([], "empty string")


def coefficient_table(spark: SparkSession, fits: list[dict], types: DataFrame) -> DataFrame:
    """(Category, term, coefficient, product_type) of per-category fits; types: Category and product_type, a row a category."""
    flat = [(r["model"], t, float(c)) for r in fits for t, c in r["coefficients"].items()]
    return spark.createDataFrame(flat, "Category string, term string, coefficient double").join(F.broadcast(types.select(F.col("Category").cast("string"), "product_type").distinct()), "Category", "left")


def construct_table(coefficients: DataFrame) -> DataFrame:
    """Mean coefficient of depth and of extremity by product type, and the difference that each hypothesis is about."""
    construct = F.when(F.col("term").isin(DEPTH), "depth").when(F.col("term").isin(EXTREMITY), "extremity")
    return ml.construct_contrast(coefficients.withColumn("term", construct).filter("term IS NOT NULL")).withColumnRenamed("term", "construct")


def top_ranked(ranks: DataFrame, rows: DataFrame, user: str, most: int = 20) -> DataFrame:
    """The users of highest rank, with their reviews, votes and share of reviews with any vote: a report's limit."""
    top = ranks.filter(F.col("id").startswith("u:")).orderBy(F.desc("rank"), "id").limit(most)
    own = rows.join(F.broadcast(top.select(F.col("id").alias("_id"))), F.concat(F.lit("u:"), F.col(user).cast("string")) == F.col("_id"))  # `most` rows
    activity = own.groupBy(F.col("_id").alias("id")).agg(F.count("*").alias("reviews"), F.sum("helpful_vote").alias("votes"), F.avg("label").alias("hit_rate"))
    return top.join(activity, "id").orderBy(F.desc("rank"), "id")


def build(spark: SparkSession, reviews: DataFrame, s: Settings, cleaning: DataFrame | None = None, store: str | None = None) -> Study:
    """All stages, not yet run; `reviews` are cleaned rows with event_time, Category and product_type, `cleaning` the audit to report.

    With `store`, a path that driver and executors share, finished stages are
    kept there by a fingerprint of the settings and the reviews, and a study
    that is built again on the same goes on where the last one ended.
    """
    study = Study(Store(spark, store, Store.fingerprint(s, reviews)) if store else None)
    numeric = tx.ALL_NUMERIC
    stage = study.stage
    if cleaning is not None:
        stage("cleaning")(lambda: cleaning)
    stage("frame")(lambda: frame(reviews, s).persist(StorageLevel.MEMORY_AND_DISK))
    stage("train", "frame", view=True)(lambda f: f.filter("split = 'train'"))
    stage("test", "frame", view=True)(lambda f: f.filter("split = 'test'"))
    stage("provenance", "frame")(lambda f: provenance.summary(f, s.user, s.item))
    stage("provenance_checks", "provenance")(provenance.support_matrix)
    stage("reviewer_frequency", "frame")(lambda f: provenance.frequency(f, s.user))
    stage("feature_summary", "frame")(lambda f: tx.feature_summary(f, numeric))
    stage("descriptives", "frame")(descriptives)
    stage("leakage", "frame")(lambda f: ml.leakage_decomposition(leakage_conditions(f, numeric), TIEBREAK))
    text = "text" if s.text_features else None
    stage("ablation", "train", "test")(lambda a, b: table_of(spark, ml.ablation(a, b, TIEBREAK, text=text)))
    zoo = {**ml.linear_classifiers(max_iter=s.max_iter), **ml.tree_classifiers(trees=s.trees, rounds=s.rounds)}
    stage("fitted", "train", "test")(lambda a, b: ml.model_comparison(a, b, numeric, TIEBREAK, text=text, category="Category", zoo=zoo, group=s.item, relevance="helpful_vote"))
    stage("models", "fitted", "test")(lambda fitted, b: fitted[1].unionByName(ml.baselines(b, {"length alone": "review_length", "exposure alone": "log_exposure_days", "rating alone": "rating"}, TIEBREAK), allowMissingColumns=True))
    stage("per_category", "train", "test")(lambda a, b: ml.per_category(a, b, numeric, "Category"))
    stage("category_models", "per_category")(lambda fits: table_of(spark, [{k: v for k, v in r.items() if k != "coefficients"} for r in fits]))
    stage("category_coefficients", "per_category", "frame")(lambda fits, f: coefficient_table(spark, fits, f.select("Category", "product_type")))
    stage("constructs", "category_coefficients")(construct_table)
    if s.interaction:
        stage("interaction", "train")(lambda a: table_of(spark, stats.interaction_model(a)))
    stage("products", "frame")(lambda f: ranking.with_bayes(ranking.product_stats(f, [s.item], "rating", "helpful_vote").withColumn("wilson", ranking.wilson(F.col("p_positive"), F.col("n")))))
    stage("rankings", "products")(lambda p: ranking.rank_overlap(p, s.item))
    stage("arrival", "frame")(lambda f: ranking.arrival_bias(f, arrival_measures()).orderBy("bucket_no"))
    stage("concentration", "frame")(lambda f: ranking.gini(f, "helpful_vote"))
    stage("registry")(lambda: stats.registry_table(spark))
    stage("replication", "train", "registry")(lambda a, registry: stats.replication(spark, a, registry))
    stage("verdict_counts", "replication")(stats.verdict_counts)
    stage("profiles", "frame")(lambda f: segments.profiles(f, s.user, s.item).persist(StorageLevel.MEMORY_AND_DISK))
    stage("sweep", "profiles")(lambda p: segments.sweep(p, s.ks))
    stage("silhouettes", "sweep")(lambda found: table_of(spark, [{"k": k, "silhouette": v} for k, v in found[0].items()]))
    stage("segments", "sweep", "profiles")(lambda found, p: segments.name_segments(segments.profile_clusters(found[3].transform(p))))
    stage("segment_warnings", "sweep", "profiles", "segments", "provenance")(lambda found, p, named, prov: table_of(spark, [{"warning": w} for w in segments.warnings(p.count(), prov.first()["unique_reviewers"], found[0], named.filter("isolated").count())]))
    stage("edges", "frame")(lambda f: graph.capped(f, s.user, s.item, "helpful_vote", s.most_vertices)[0])
    stage("labels", "edges")(graph.components)
    stage("graph", "edges", "labels", "frame")(lambda e, labels, f: graph.guards(graph.summary(e, labels), f))
    stage("components", "labels")(graph.top_components)
    stage("ranks", "edges")(lambda e: graph.pagerank(e, s.pagerank_rounds))
    stage("centrality", "ranks", "edges")(lambda r, e: graph.activity_link(r, e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.sum("weight").alias("votes")), "n", "votes"))
    stage("top_ranked", "ranks", "frame")(lambda r, f: top_ranked(r, f, s.user))
    stage("zero_share", "test")(lambda b: ml.zero_share(b, "helpful_vote"))
    stage("regression", "train", "test")(lambda a, b: ml.regression_zoo(a, b, numeric, "log_helpful_vote", ml.regressors(s.trees, s.rounds), category="Category"))
    if s.bench:
        stage("benchmark", "frame")(lambda f: benchmark.sweep(f.select(s.user, s.time, "helpful_vote", "text"), s.user, [s.time], "helpful_vote", "text"))
        stage("crossover", "benchmark")(benchmark.crossover)
    return study


def tables(study: Study) -> dict[str, DataFrame]:
    """The result tables of a study that has run; its frames and models are left out."""
    inner = {"frame", "train", "test", "edges", "labels", "ranks", "profiles", "products"}
    return {name: x for name, x in study.results.items() if isinstance(x, DataFrame) and name not in inner}


def finish(study: Study) -> None:
    """Gives back what the stages held."""
    for name in ("frame", "profiles"):
        if name in study.results and not study.store:
            study.results[name].unpersist()


def best_model(study: Study):
    """(name, fitted pipeline, threshold) of the first row of the comparison."""
    models, table = study.results["fitted"]
    row = table.first()
    return row["model"], models[row["model"]], row["threshold"]


__all__ = ["Settings", "best_model", "build", "construct_table", "descriptives", "finish", "frame", "leakage_conditions", "tables"]
