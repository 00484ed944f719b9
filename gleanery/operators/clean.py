"""Cleaning with an audit, exposure control, targets and taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

# Tokens that stand for a missing text, and the category taxonomy.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SEARCH = ["Cell Phones", "Cell_Phones_and_Accessories", "Electronics", "Office Products", "Tools and Home Improvement"]
EXPERIENCE = ["Beauty", "All_Beauty", "Video Games", "Video_Games", "Movies and TV", "Books"]
TAXONOMY = dict.fromkeys(SEARCH, "search") | dict.fromkeys(EXPERIENCE, "experience")

MIN_CHARS = 20
MIN_EXPOSURE_DAYS = 365
STEPS = ["raw", "valid rating", "valid timestamp", "deduplicated", "non-empty text", "long enough text", "valid votes"]


def nullify(column: Column) -> Column:
    """Null in place of an NA token."""
    return F.when(column.isin(NA_TOKENS), None).otherwise(column)


def staged(df: DataFrame, tiebreak: list[str], key=("user_id", "asin", "timestamp"), min_chars: int = MIN_CHARS) -> DataFrame:
    """Adds `stage`: the number of cleaning steps that a row passes (0 to 6), in one pass.

    The one row of a key that survives deduplication is the first by `tiebreak`
    among rows that passed the steps before.  NA tokens become null, and a null
    title the empty string.
    """
    early = F.coalesce(F.col("rating").between(1, 5), F.lit(False))
    timed = F.coalesce(F.col("timestamp") > 0, F.lit(False)) & F.timestamp_millis("timestamp").isNotNull()
    rows = df.withColumns({"text": nullify(F.col("text")), "title": F.coalesce(nullify(F.col("title")), F.lit("")), "_early": F.when(~early, 0).when(~timed, 1).otherwise(2)})
    turn = F.row_number().over(W.partitionBy(*key, "_early").orderBy(*tiebreak))
    steps = F.when(F.col("_early") < 2, F.col("_early")).when(turn > 1, 2).when(F.col("text").isNull() | (F.trim("text") == ""), 3).when(F.length("text") < min_chars, 4).when(F.col("helpful_vote").isNull() | (F.col("helpful_vote") < 0), 5).otherwise(6)
    return rows.withColumn("stage", steps).drop("_early")


def clean(df: DataFrame, tiebreak: list[str], **kw) -> DataFrame:
    """The rows that pass every step, with event_time."""
    return staged(df, tiebreak, **kw).filter(F.col("stage") == 6).drop("stage").withColumn("event_time", F.timestamp_millis("timestamp"))


def audit(marked: DataFrame) -> DataFrame:
    """(step_no, step, rows): how many rows are left after each step, in one aggregation."""
    counts = marked.agg(*[F.count_if(F.col("stage") >= k).alias(str(k)) for k in range(len(STEPS))])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(s).alias("step"), F.col(str(k)).alias("rows")) for k, s in enumerate(STEPS)]))
    return counts.select(pairs.alias("x")).select("x.*")


def write_audited(spark: SparkSession, df: DataFrame, path: str, tiebreak: list[str], collected: str | None = None, min_days: int = MIN_EXPOSURE_DAYS, **kw) -> DataFrame:
    """Writes the cleaned rows (with `collected` also censored by exposure) as Parquet, and returns the audit (step_no, step, rows).

    The counts are gathered while the rows are written, so one job reads the
    corpus once; with `collected` the audit ends in the step "exposed".
    """
    seen, kept = Observation("cleaning"), Observation("exposure")
    marked = staged(df, tiebreak, **kw).observe(seen, *[F.count_if(F.col("stage") >= k).alias(str(k)) for k in range(len(STEPS))])
    rows = marked.filter(F.col("stage") == len(STEPS) - 1).drop("stage").withColumn("event_time", F.timestamp_millis("timestamp"))
    if collected:
        rows = exposure(rows, collected, min_days=min_days)
    rows.observe(kept, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    counts = [(k, step, int(seen.get[str(k)])) for k, step in enumerate(STEPS)]
    if collected:
        counts.append((len(STEPS), "exposed", int(kept.get["n"])))
    return spark.createDataFrame(counts, "step_no int, step string, rows long")


def exposure(df: DataFrame, collected: str, event_time: str = "event_time", min_days: int = MIN_EXPOSURE_DAYS) -> DataFrame:
    """Rows visible for `min_days` or more before collection, with exposure_days and its log."""
    days = F.datediff(F.to_timestamp(F.lit(collected)), F.col(event_time)).cast("double")
    return df.withColumn("exposure_days", days).filter(F.col("exposure_days") >= max(0, min_days)).withColumn("log_exposure_days", F.log1p("exposure_days"))


def targets(df: DataFrame, votes: str = "helpful_vote", threshold: int = 1) -> DataFrame:
    return df.withColumns({"label": (F.col(votes) >= threshold).cast("int"), "log_helpful_vote": F.log1p(votes)})


def item_percentile(df: DataFrame, item: str, votes: str, min_rows: int = 5, most: int = scan.MOST) -> DataFrame:
    """product_review_count and the percent rank of votes within the item, null under min_rows; an evaluation target, never a feature."""
    rows = scan.percent_ranks(df, item, votes, "within_product_pct_rank", "product_review_count", most)
    return rows.withColumn("within_product_pct_rank", F.when(F.col("product_review_count") >= min_rows, F.col("within_product_pct_rank")))


def product_type(df: DataFrame, category: str = "Category", mapping: dict[str, str] | None = None) -> DataFrame:
    """search, experience or unmapped, by one map lookup."""
    mapping = TAXONOMY if mapping is None else mapping
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("product_type", F.coalesce(F.try_element_at(lookup, F.col(category)), F.lit("unmapped")))


def scrub(df: DataFrame, columns: list[str]) -> DataFrame:
    """0.0 in place of null, NaN and infinities, as doubles, in one projection."""
    bad = lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(bad(F.col(c).cast("double")), 0.0).otherwise(F.col(c).cast("double")) for c in columns})
