"""The data behind a study's figures: for each, a small table in the order in which it is drawn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.plans import stats
from gleanery.plans.study import DEPTH, EXTREMITY


def leakage(t: DataFrame) -> DataFrame:
    """Bars of average precision by condition, and the base rate that a constant reaches."""
    return t.select("model", "pr_auc", "base_rate").orderBy("model")


def ablation(t: DataFrame) -> DataFrame:
    """A line over the steps, with what each block adds."""
    return t.select("step", F.col("model").alias("block"), "pr_auc", "marginal_pr_auc", "base_rate").orderBy("step")


def models(t: DataFrame) -> DataFrame:
    """Bars by average precision; baselines are told apart."""
    return t.select("model", "pr_auc", F.col("features").isNull().alias("baseline")).orderBy("pr_auc", "model")


def moderation(t: DataFrame) -> DataFrame:
    """Mean coefficients of two constructs by category, which has a type."""
    construct = F.when(F.col("term").isin(DEPTH), "depth").when(F.col("term").isin(EXTREMITY), "extremity")
    rows = t.withColumn("construct", construct).filter("construct IS NOT NULL")
    return rows.groupBy("construct", "Category", "product_type").agg(F.avg("coefficient").alias("coefficient")).orderBy("construct", "Category")


def replication(t: DataFrame) -> DataFrame:
    """Effects in percentage points with verdicts, and the least effect that counts."""
    return t.filter("effect_at_mean IS NOT NULL").select("id", "claim", "verdict", (100 * F.col("effect_at_mean")).alias("points"), F.lit(100 * stats.MIN_EFFECT).alias("least_points")).orderBy("points")


def shrinkage(t: DataFrame) -> DataFrame:
    """By the number of reviews, to a power of two: products, mean of the raw and of the shrunk rating; binned over all products, so none is left out."""
    size = F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long").alias("reviews_from")
    return t.groupBy(size).agg(F.count("*").alias("products"), F.avg("avg_rating").alias("raw"), F.stddev("avg_rating").alias("raw_spread"), F.avg(1 + 4 * F.col("bayesian")).alias("shrunk"), F.stddev(1 + 4 * F.col("bayesian")).alias("shrunk_spread")).orderBy("reviews_from")


def arrival(t: DataFrame) -> DataFrame:
    return t.select("bucket_no", "arrival_bucket", "pct_any_vote").orderBy("bucket_no")


def segments(t: DataFrame) -> DataFrame:
    """Two bars a segment: its share of reviewers and of votes."""
    return t.select("segment", "pct_of_reviewers", "pct_of_votes").orderBy(F.desc("pct_of_reviewers"))


def scaling(t: DataFrame) -> DataFrame:
    return t.select("workload", "rows", "spark_s", "other_s").orderBy("workload", "rows")


#: By figure: the result table that it draws, and how its data comes from it.
FIGURES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "leakage": ("leakage", leakage), "ablation": ("ablation", ablation), "models": ("models", models), "moderation": ("category_coefficients", moderation), "shrinkage": ("products", shrinkage),
    "arrival": ("arrival", arrival), "replication": ("replication", replication), "segments": ("segments", segments), "scaling": ("benchmark", scaling),
}


def figure_data(results: dict[str, object]) -> dict[str, DataFrame]:
    """The data of every figure whose table is among the results."""
    return {name: make(results[table]) for name, (table, make) in FIGURES.items() if isinstance(results.get(table), DataFrame)}
