"""What a corpus's sampling design supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PER_USER, MIN_PER_ITEM = 1.15, 1.5
#: (analysis, what it needs: None, "item" or "user").
ANALYSES = [("Review-level prediction", None), ("Temporal validation", None), ("Exposure / arrival analysis", "item"), ("Product ranking", "item"), ("Reviewer history features", "user"), ("Reviewer segmentation", "user"), ("Reviewer-product graph", "user")]


def summary(df: DataFrame, user: str, item: str) -> DataFrame:
    """One row of counts, ratios and singleton shares: two grouped passes, no distinct count over rows."""
    users = df.groupBy(user).agg(F.count("*").alias("n")).agg(F.sum("n").alias("reviews"), F.count("*").alias("unique_reviewers"), F.count_if(F.col("n") == 1).alias("u1"))
    items = df.groupBy(item).agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_products"), F.count_if(F.col("n") == 1).alias("p1"))
    share = lambda a, b: 100 * F.col(a) / F.greatest(F.col(b), F.lit(1))
    rpu, rpp = F.col("reviews") / F.greatest("unique_reviewers", F.lit(1)), F.col("reviews") / F.greatest("unique_products", F.lit(1))
    return users.crossJoin(F.broadcast(items)).select("reviews", "unique_reviewers", "unique_products", rpu.alias("reviews_per_reviewer"), rpp.alias("reviews_per_product"), share("u1", "unique_reviewers").alias("pct_single_review_users"), share("p1", "unique_products").alias("pct_single_review_products"), (rpu < MIN_PER_USER).alias("is_review_level_sample"))


def support_matrix(summary_row: DataFrame) -> DataFrame:
    """(analysis, supported) for each analysis."""
    ok = {None: F.lit(True), "item": F.col("reviews_per_product") >= MIN_PER_ITEM, "user": F.col("reviews_per_reviewer") >= MIN_PER_USER}
    return summary_row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("analysis"), ok[need].alias("supported")) for name, need in ANALYSES])).alias("x")).select("x.*")


def frequency(df: DataFrame, user: str, most: int = 10) -> DataFrame:
    """(reviews_written, n_users, pct_of_reviewers), the `most` least frequencies: a report's limit."""
    counts = df.groupBy(user).agg(F.count("*").alias("reviews_written")).groupBy("reviews_written").agg(F.count("*").alias("n_users"))
    total = counts.agg(F.sum("n_users").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("reviews_written", "n_users", (100 * F.col("n_users") / F.col("_all")).alias("pct_of_reviewers")).orderBy("reviews_written").limit(most)


def history_survives(p: Column, k: Column) -> Column:
    """Chance that two or more of a user's k reviews stay in a review-level sample of share p."""
    return 1 - F.pow(1 - p, k) - k * p * F.pow(1 - p, k - 1)
