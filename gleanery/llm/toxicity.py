"""Toxicity by a factorization machine over hashed terms.

Score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the distinct
hashed terms of a text, so a pair such as an insult with a group's name can
weigh more than its parts.  Terms are words of [0-9a-z] and non-ASCII
characters, ASCII lower-cased, hashed into 2^26 ids.

Training: at most MAX_POSITIVE + MAX_NEGATIVE labelled rows (a documented
bound; the ones with the least hashes of doc_id), each class weighted by how
many labelled rows it stands for, so that scores mean the same at every size.
Terms are chosen by chi-square among those in enough of these rows.  How many,
in how many rows, and the weight decay are chosen by cross-validation within
them, by the F1 at THRESHOLD.  Candidates are the best terms of all rows and of
each fold's complement, so a fold picks the terms that it would pick from all
without seeing its own labels; the driver takes each row as the numbers of its
candidates (two bytes each, so 100 MB at the very most).  Scoring is a map over
all rows; it sees the text alone.

Null or empty texts score sigmoid(b).  A doc_id with several labels is toxic
if any is 1; null labels do not count.  Of rows that share a doc_id one is
learnt from.  With no usable label every score is under 1e-12.  Ids may be of
any type that hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import ALNUM_OR_HIGH, LOWER_ASCII, cut, release, span_hash, text_slices, word_spans

MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
MAX_TERMS, LEAST_ROWS = 1_024, 3
TERM_BITS = 26
FACTORS = 4
EPOCHS = 150
THRESHOLD = 0.7
#: What cross-validation chooses from, on at most so many rows: terms kept, rows that a term must be in, weight decay.
CHOICES = [(terms, rows, decay) for terms in (128, MAX_TERMS) for rows in (LEAST_ROWS, 10) for decay in (1e-6, 1e-5, 1e-4)]
FOLDS, TRIAL_ROWS, TRIAL_EPOCHS = 3, 6_000, 80


def term_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed term id and row of every word."""
    data = LOWER_ASCII[data]
    starts, ends, first = word_spans(data, offsets, ALNUM_OR_HIGH)
    ids = (span_hash(data, starts, ends, seed=4) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    return ids, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


@dataclass
class FactorizationMachine:
    """terms: sorted ids; w, v: a weight and a factor row for each."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Of n rows, from the distinct (row, term position) entries."""
        linear = np.bincount(row, self.w[term], n)
        sums = np.stack([np.bincount(row, self.v[term, f], n) for f in range(self.v.shape[1])], axis=1)
        squares = np.bincount(row, (self.v[term] ** 2).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(self.terms):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        ids, row = term_ids(data, offsets)
        at = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        known = self.terms[at] == ids
        entries = np.unique(row[known] * len(self.terms) + at[known])
        x = self.logits(entries % len(self.terms), entries // len(self.terms), n)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fold_of(doc_hash):
    return doc_hash % FOLDS


def _chi(row: np.ndarray, term: np.ndarray, y: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Each term's rows and chi-square with the label."""
    n, rate = len(y), y.mean() if len(y) else 0.0
    docs, positive = np.bincount(term, minlength=n_terms).astype(float), np.bincount(term, y[row], n_terms)
    return docs, (positive - docs * rate) ** 2 / np.maximum(docs * rate * (1 - rate) * (1 - docs / max(n, 1)), 1e-9)


def _entries(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)


def train(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, weights: np.ndarray | None = None, terms: int = 1_024, least: int = 3, decay: float = 1e-4, epochs: int = EPOCHS, seed: int = 4) -> FactorizationMachine:
    """Fits by Adam on the weighted logistic loss; rows hold the places in `ids` of each text's distinct terms."""
    y, n = labels.astype(float), len(rows)
    if n == 0:
        return FactorizationMachine(np.zeros(0, np.int64), -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    c = np.ones(n) if weights is None else weights
    c = c / c.sum()
    row, term = _entries(rows)
    docs, chi = _chi(row, term, y, len(ids))
    able = np.flatnonzero((docs >= least) & (chi > 0))
    best = np.sort(able[np.argsort(-chi[able], kind="stable")[:terms]])
    place = np.full(len(ids), -1)
    place[best] = np.arange(len(best))
    used = place[term] >= 0
    term, row = place[term[used]], row[used]
    rate = float(c @ y)
    bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    m = FactorizationMachine(ids[best], bias, np.zeros(len(best)), np.random.default_rng(seed).normal(0, 0.01, (len(best), FACTORS)))
    params = [np.array([m.bias]), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        m.bias = float(params[0][0])
        x = m.logits(term, row, n)
        g = c * (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y)
        sums = np.stack([np.bincount(row, m.v[term, f], n) for f in range(FACTORS)], axis=1)
        gw = np.bincount(term, g[row], len(best)) + decay * m.w
        gv = np.stack([np.bincount(term, g[row] * (sums[row, f] - m.v[term, f]), len(best)) for f in range(FACTORS)], axis=1) + decay * m.v
        for k, (p, grad) in enumerate(zip(params, (np.array([g.sum()]), gw, gv), strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            p -= 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    m.bias = float(params[0][0])
    return m


def _scores(m: FactorizationMachine, rows: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    row, term = _entries(rows)
    if not len(m.terms):
        return np.full(len(rows), m.bias)
    at = np.minimum(np.searchsorted(m.terms, ids[term]), len(m.terms) - 1)
    known = m.terms[at] == ids[term]
    return m.logits(at[known], row[known], len(rows))


def chosen(rows: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, weights: np.ndarray, hashes: np.ndarray) -> tuple[int, int, float]:
    """(terms, least, decay) of the best F1 at THRESHOLD over FOLDS folds of the first TRIAL_ROWS rows, of the least log loss on ties; terms are picked anew in each fold."""
    rows, y, weights, fold = rows[:TRIAL_ROWS], labels[:TRIAL_ROWS].astype(float), weights[:TRIAL_ROWS], fold_of(hashes[:TRIAL_ROWS])
    if len(rows) < 10 * FOLDS or y.min() == y.max():
        return CHOICES[-1]
    found = {}
    for choice in CHOICES:
        x = np.zeros(len(rows))
        for k in range(FOLDS):
            own, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(own) and len(other):
                m = train([rows[i] for i in own], y[own], ids, weights[own], *choice, epochs=TRIAL_EPOCHS)
                x[other] = np.clip(_scores(m, [rows[i] for i in other], ids), -30, 30)
        said = x >= np.log(THRESHOLD / (1 - THRESHOLD))
        right = weights @ (said * y)
        f1 = 2 * right / max(weights @ (said + y), 1e-9)
        found[choice] = (round(f1, 6), -float(weights @ (np.logaddexp(0, x) - y * x)))
    return max(found, key=found.get)


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _candidates(held: DataFrame) -> np.ndarray:
    """The MAX_TERMS terms of the largest chi-square over all rows (doc_hash, toxic, terms) and over those outside each fold."""
    fold, toxic = F.pmod("doc_hash", F.lit(FOLDS)), F.col("toxic") == 1
    parts = [F.lit(True), *[fold != k for k in range(FOLDS)]]
    each = held.select("toxic", "doc_hash", F.explode("terms").alias("term")).groupBy("term").agg(*[x for i, p in enumerate(parts) for x in (F.count_if(p).alias(f"n{i}"), F.count_if(p & toxic).alias(f"p{i}"))])
    counts = cut(each.filter(F.col("n0") >= LEAST_ROWS))
    totals = held.agg(*[x for i, p in enumerate(parts) for x in (F.count_if(p).alias(f"n{i}"), F.count_if(p & toxic).alias(f"p{i}"))]).first()
    found = []
    for i in range(len(parts)):
        n, rate, docs = totals[f"n{i}"], (totals[f"p{i}"] / totals[f"n{i}"] if totals[f"n{i}"] else 0.0), F.col(f"n{i}")
        spread = F.greatest(docs * rate * (1 - rate) * (1 - docs / max(n, 1)), F.lit(1e-9))
        best = counts.filter(docs >= LEAST_ROWS).orderBy(F.desc(F.pow(F.col(f"p{i}") - docs * rate, F.lit(2.0)) / spread), "term").limit(MAX_TERMS)
        found.append(np.asarray(best.select("term").toArrow()["term"], np.int64))
    return np.unique(np.concatenate(found))


def fit(docs: DataFrame, labels: DataFrame) -> FactorizationMachine:
    """A model from a bounded sample of the labelled rows outside the held-out third."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out())
    marked = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    picked = [marked.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # 12,000 small rows broadcast at most

    def run(batches):
        for rows, data, offsets in text_slices(batches, "text"):
            ids, row = term_ids(data, offsets)
            entries = np.unique(row << TERM_BITS | ids)
            cuts = np.searchsorted(entries, np.arange(rows.num_rows + 1) << TERM_BITS)
            terms = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(entries & ((1 << TERM_BITS) - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], terms], names=["doc_hash", "toxic", "terms"])

    held = cut(sample.select(F.xxhash64("doc_id").alias("doc_hash"), "toxic", "text").mapInArrow(run, "doc_hash long, toxic int, terms array<int>"))
    ids = _candidates(held)
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def numbered(batches):
        for batch in batches:
            lists = batch.column(2)
            values, owner = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_parent_indices())
            at = np.minimum(np.searchsorted(shared.value, values), max(len(shared.value) - 1, 0))
            known = shared.value[at] == values if len(shared.value) else np.zeros(len(values), bool)
            cuts = np.searchsorted(owner[known], np.arange(batch.num_rows + 1))
            terms = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at[known], pa.int16()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], terms], names=["doc_hash", "toxic", "terms"])

    got = held.mapInArrow(numbered, "doc_hash long, toxic int, terms array<smallint>").toArrow().combine_chunks().sort_by([("doc_hash", "ascending"), ("toxic", "ascending")])
    rows, y, hashes = [np.asarray(x.values, np.int64) for x in got["terms"]], np.asarray(got["toxic"]), np.asarray(got["doc_hash"])
    taken = np.bincount(y, minlength=2) if len(y) else np.ones(2)
    weights = np.array([total.get(t, 0) / max(taken[t], 1) for t in (0, 1)])[y] if len(y) else np.zeros(0)
    terms, least, decay = chosen(rows, y, ids, weights, hashes)
    model = train(rows, y, ids, weights, terms, least, decay)
    del got, rows
    release()
    return model


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """Adds each row's score; every input column stays (one named like the output is replaced)."""
    kept = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches):
        for part, data, offsets in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(data, offsets), pa.float64())], names=[*part.schema.names, out])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{out}` double"]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
