"""The corpus pipeline: five stages over the documents, each one operator.

Every stage takes all rows that its predecessor kept.  All but the last return
the columns of documents; the last returns the encoded corpus.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontaminate, jaccard, passages, toxicity
from gleanery.llm.catalog import table, vocabulary
from gleanery.llm.textcore import one_of, remove_folder, shared_folder

#: Near copies are held by the common rule: five-word shingles, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model scores at the threshold or above."""
    name = one_of(docs.columns, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out=name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the least doc_id."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; drops documents of which no word is left."""
    words, removed, spans = (one_of(docs.columns, c) for c in ("n_words", "n_removed", "spans"))
    cut = passages.without_repeats(docs, (words, removed, spans))
    length = {c: F.length("text").cast(t) for c, t in docs.dtypes if c == "n_chars"}
    counts = [F.when(F.col(removed) > 0, length[c]).otherwise(F.col(c)).alias(c) if c in length else F.col(f"`{c}`") for c in docs.columns]
    return cut.filter((F.col(removed) == 0) | (F.col(removed) < F.col(words))).select(*counts)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that repeat benchmark passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens, token_ids and decoded_sha256 in place of text and n_chars; other columns stay, but for ones of these names."""
    made = [F.size("token_ids").cast("long").alias("n_tokens"), F.col("token_ids"), F.sha2("decoded", 256).alias("decoded_sha256")]
    kept = [c for c in docs.columns if c.lower() not in ("text", "n_chars", "n_tokens", "token_ids", "decoded", "decoded_sha256")]
    coded = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return coded.select(*[F.col(f"`{c}`") for c in kept], *made)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("substring_dedup", passage_stage),
    ("decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL can't express a trained model or a tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again, and deleted once the next ones are written."""
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
