"""Fair ranking of items, arrival bias and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .running import running_totals

Z = 1.96
BUCKETS = [(5, "1-5 (earliest)"), (20, "6-20"), (50, "21-50"), (200, "51-200")]
LAST_BUCKET = "200+ (latest)"


def product_stats(df: DataFrame, keys: list[str], rating: str, votes: str, min_rows: int = 5, liked: float = 4) -> DataFrame:
    good = (F.col(rating) >= liked).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(rating).alias("avg_rating"), F.avg(good).alias("p_positive"), F.sum(good).alias("n_positive"), F.avg(votes).alias("avg_helpful")).filter(F.col("n") >= min_rows)


def wilson(p: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the Wilson interval of a share."""
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def with_bayes(stats: DataFrame) -> DataFrame:
    """Adds the posterior mean under a Beta prior fitted by moments over the items; Beta(1, 1) where the moments fit none.

    The prior is a one-row aggregate joined in the plan.
    """
    prior = stats.agg(F.avg("p_positive").alias("mu"), F.variance("p_positive").alias("var"))
    fits = (F.col("var") > 0) & (F.col("var") < F.col("mu") * (1 - F.col("mu")))
    strength = F.col("mu") * (1 - F.col("mu")) / F.col("var") - 1
    prior = prior.select(F.when(fits, F.col("mu") * strength).otherwise(1.0).alias("alpha"), F.when(fits, (1 - F.col("mu")) * strength).otherwise(1.0).alias("beta"))
    return stats.crossJoin(F.broadcast(prior)).withColumn("bayesian", (F.col("n_positive") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))).drop("alpha", "beta")


def rank_overlap(scored: DataFrame, item: str, k: int = 20) -> DataFrame:
    """(ranking, overlap with the naive top k, median n) of the three rankings."""
    tops = {name: scored.orderBy(F.desc(col), item).limit(k).select(item, "n") for name, col in (("naive", "avg_rating"), ("wilson", "wilson"), ("bayesian", "bayesian"))}
    naive = tops["naive"].select(F.col(item).alias("_top"))
    rows = [top.join(naive, F.col(item) == F.col("_top"), "left").agg(F.lit(name).alias("ranking"), F.count("_top").alias("overlap"), F.median("n").alias("median_n")) for name, top in tops.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def bucket(position: Column) -> Column:
    out = F.when(position <= BUCKETS[0][0], BUCKETS[0][1])
    for most, name in BUCKETS[1:]:
        out = out.when(position <= most, name)
    return out.otherwise(LAST_BUCKET)


def arrival_bias(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Measures by bucket of `arrival_position`, with bucket_no to order by."""
    rows = df.withColumn("arrival_bucket", bucket(F.col("arrival_position"))).groupBy("arrival_bucket").agg(F.count("*").alias("reviews"), *[e.alias(n) for n, e in measures.items()])
    names = [*(b for _, b in BUCKETS), LAST_BUCKET]
    return rows.withColumn("bucket_no", F.array_position(F.array(*map(F.lit, names)), F.col("arrival_bucket")).cast("int"))


def _cumulated(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with counts and what lies below each."""
    groups = df.select(F.col(value).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    return cut(running_totals(groups, "x", {"upto": "n"}).select("x", "n", (F.col("upto") - F.col("n")).alias("below")))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: gini, and the share of the total that the top 1 % and 10 % of rows hold; null on no rows or an all-zero total."""
    groups = _cumulated(df, value)
    total = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("x")).alias("total"))
    g = groups.crossJoin(F.broadcast(total))  # one row
    ranks = F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2
    held = lambda q: F.sum(F.greatest(F.lit(0), F.col("below") + F.col("n") - F.greatest(F.col("below"), F.floor(F.col("rows") * F.lit(q)))) * F.col("x"))
    sums = g.agg(F.max("rows").alias("rows"), F.max("total").alias("total"), F.sum(ranks * F.col("x")).alias("weighted"), held(0.99).alias("top1"), held(0.90).alias("top10"))
    some = F.col("total") > 0
    return sums.select(F.when(some, 2 * F.col("weighted") / (F.col("rows") * F.col("total")) - (F.col("rows") + 1) / F.col("rows")).alias("gini"), F.when(some, F.col("top1") / F.col("total")).alias("top1_share"), F.when(some, F.col("top10") / F.col("total")).alias("top10_share"))
