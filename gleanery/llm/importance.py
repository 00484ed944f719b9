"""Target-distribution importance resampling over hashed word n-grams.

Words are [0-9a-z] and non-ASCII characters, A-Z lower-cased.  A document's
features are its runs of one to three words; a feature's bucket is the crc32 of
its bytes modulo BUCKETS.  Buckets that the target has more of, against the
documents, gain; a document's weight is the sum of its features' gains, and the
best of weight plus Gumbel noise (a hash of doc_id) are drawn.

Position table: each text's words are cut into pieces of PIECE words, each with
the next two words after it, and dealt by document and piece, so that a text of
any length is spread over tasks; posexplode gives a row a word, and window
lead() within a piece the words after it.  The table (document, three buckets a
word) is written to the shared folder once, as both passes over it need the same
rows: counts by bucket, then gains joined and summed by document.  Counts are
pre-aggregated; gains have BUCKETS rows and are broadcast.  Ranks come from
windows over ranges of the score, with the ranges' counts added.

Rows that are equal in doc_id and text are one row with a count (a hot one is
summed up before any shuffle) and are returned, and drawn, as often as they
occur; equal scores go by doc_id, null first, then by a hash of the text.  Null
or empty texts have no features and weight 0.  A null doc_id is hashed as an
empty one.  Without target texts every gain is that of t = T = 0.  Other columns
of the input are not read, so none can clash.
"""

from __future__ import annotations

import os
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import cut, remove_folder, shared_folder

ORDERS, BUCKETS = 3, 10_000
PIECE = 4_096
SHARE, LEAST_WORDS, SEED = 5, 20, 42
RANGES = 128
COPIES = 4_096

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_hash", "n_chars", "n_words", "copies"]


def _lower(word: Column) -> Column:
    """A-Z lower-cased; lower() does just that where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def positions(texts: DataFrame) -> DataFrame:
    """KEY and the buckets b1, b2, b3 of the features that start at each word of (doc_id, text); a row of null buckets where there are no words."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")
    read = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.char_length("text"), F.lit(-1)).alias("n_chars"), words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)).cast("int"), F.lit(PIECE)))
    cut_up = read.withColumn("first", first).withColumn("piece", F.array_join(F.slice("words", F.col("first") + 1, PIECE + ORDERS - 1), " ")).drop("words")
    by = ["doc_id", "text_hash", "n_chars", "n_words", "first"]
    pieces = cut_up.groupBy(*by).agg(F.count("*").alias("copies"), F.first("piece").alias("piece"))
    each = pieces.select(*by, "copies", F.posexplode_outer(F.array_remove(F.split("piece", " "), "")).alias("pos", "raw")).withColumn("word", _lower(F.col("raw"))).drop("raw")
    order = W.partitionBy(*by).orderBy("pos")
    ahead = each.select("*", *[F.lead("word", k).over(order).alias(f"word{k}") for k in range(1, ORDERS)])
    run = [F.col("word"), *[F.col(f"word{k}") for k in range(1, ORDERS)]]
    bucket = lambda k: F.when(run[k - 1].isNotNull(), (F.crc32(F.concat_ws(" ", *run[:k]).cast("binary")) % BUCKETS).cast("int")).alias(f"b{k}")
    return ahead.filter(f"pos IS NULL OR pos < {PIECE}").select(*KEY, *[bucket(k) for k in range(1, ORDERS + 1)])


def written(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, read again; and its path."""
    path = os.path.join(shared_folder(spark), f"positions-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def bucket_counts(table: DataFrame) -> DataFrame:
    """(bucket, n): the features of a position table; each order reads one column of buckets."""
    parts = [table.filter(f"b{k} IS NOT NULL").groupBy(F.col(f"b{k}").alias("bucket")).agg(F.sum("copies").alias("n")) for k in range(1, ORDERS + 1)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) for the buckets of the documents: BUCKETS rows at most."""
    both = documents.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    totals = documents.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).crossJoin(F.broadcast(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t"))))  # one row each
    named = both.crossJoin(F.broadcast(totals))  # one row
    ratio = (F.coalesce("t", F.lit(0)) + 1).cast("double") * (F.col("all_s") + BUCKETS).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS).cast("double"))
    return named.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def weights(table: DataFrame, gain: DataFrame) -> DataFrame:
    """KEY and weight of every document of a position table."""
    joined, total = table, F.lit(0).cast("long")
    for k in range(1, ORDERS + 1):
        joined = joined.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")  # BUCKETS rows
        total = total + F.coalesce(f"g{k}", F.lit(0))
    return joined.groupBy(*KEY).agg(F.sum(total).alias("weight"))


def noisy(weight: Column, doc_id: Column, seed: int) -> Column:
    """weight plus Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """Adds `rank` of the first copy: rows of least_words words or more by falling score, in ranges of the score; null beyond share percent of them."""
    able = F.col("n_words") >= least_words
    known = scored.filter(able).agg(F.sum("copies").alias("n"), F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts")).first()
    drawn = share * (known["n"] or 0) // 100
    cuts = F.array(*[F.lit(c) for c in sorted(set(known["cuts"] or []))]).cast("array<long>")
    ranged = scored.filter(able).withColumn("part", F.size(F.filter(cuts, lambda c: c < F.col("score"))))
    each = ranged.groupBy("part").agg(F.sum("copies").alias("n"))
    before = each.select("part", F.coalesce(F.sum("n").over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # RANGES rows
    own = W.partitionBy("part").orderBy(F.desc("score"), "doc_id", "text_hash", "n_chars").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("copies").over(own), F.lit(0)) + 1
    placed = ranged.join(F.broadcast(before), "part").withColumn("first_rank", place).drop("part", "before")
    return placed.unionByName(scored.filter(~able).withColumn("first_rank", F.lit(None).cast("long"))).withColumn("drawn", F.lit(drawn))


def resample(documents: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the `share` percent drawn of those with least_words words have ranks 1, 2, 3...

    documents: (doc_id, text); target: (text).
    """
    spark = documents.sparkSession
    table, path = written(spark, positions(documents.select("doc_id", "text")))
    aims, aim_path = written(spark, positions(target.select(F.lit(0).alias("doc_id"), "text")))
    gain = cut(gains(bucket_counts(table), bucket_counts(aims)))
    scored = cut(weights(table, gain).withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)))
    for done in (path, aim_path):
        remove_folder(spark, done)
    found = ranked(scored, share, least_words)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    copies = found.withColumn("from", blocks).withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("copies")) - 1)))
    features = sum((F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(1, ORDERS)), F.col("n_words"))
    rank = F.col("first_rank") + F.col("copy")
    return copies.select("doc_id", features.cast("long").alias("n_features"), "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))


def importance_ranks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `resample` with the benchmark's texts as the target."""
    return resample(documents, benchmark)
