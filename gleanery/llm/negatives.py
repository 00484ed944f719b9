"""Hard-negative mining by blocked matrix products.

A row's score with an anchor is the inner product of their components, each
floor(SCALE * x).  The anchors are taken in blocks of about ANCHORS rows, dealt
by a hash, so that what is broadcast at a time has a fixed size whatever the
table's.  For each block two maps pass over all rows, in blocks too, and a
matrix product in float64 scores a block against the other; it is exact, as the
largest sum that the two blocks could make is held under 2^53, and blocks beyond
that are multiplied in whole numbers of any length.

First pass: each task keeps an anchor's best rows of its own label; a window
merges the tasks' lists into its positives.  Second pass: each task keeps, for
each positive, the best rows of other labels whose score lies in the positive's
window, and a window merges these too.  A task holds a block of scores and
lists of fixed length, so no anchor, label or vector can be too frequent.

Rows with a null id, label or vector, or with a null or non-finite component,
take no part.  Vectors of different lengths meet over the components that both
have.  Scores beyond +-2^56 count as +-2^56.  Rows that repeat an id count each
for themselves, but a row never counts as a positive of an anchor of its own id;
of anchors that are equal in id, label and vector one is taken.  With no anchor
or no row to return the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import cut

SCALE = 256
ANCHORS = 16_384
ANCHOR_BLOCK, ROW_BLOCK = 512, 4_096
EXACT, MOST = 1 << 53, 1 << 56
NONE = np.iinfo(np.int64).min

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, x): the rows that take part, with components floor(SCALE * x) as doubles."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is not less
    scaled = F.transform(F.col(vector), lambda x: _floor(F.lit(float(SCALE)) * x.cast("double")))
    taking_part = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))
    return rows.filter(taking_part).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("x"))


def _floor(x: Column) -> Column:
    """floor as a double: numbers of 2^53 and more are whole already, and might not fit a long."""
    return F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix of `width` columns (the longest list's, if None); shorter lists end in zeros, longer ones are cut."""
    offsets = np.asarray(column.offsets, np.int64)
    sizes = np.diff(offsets)
    values = np.asarray(column.values, np.float64)
    if width is None:
        width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(offsets[0], offsets[-1])
    place = at - offsets[:-1][row]
    inside = place < width
    out[row[inside], place[inside]] = values[at[inside]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as whole numbers, exact, held to +-MOST."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -MOST, MOST).astype(np.int64)


class Best:
    """The `most` entries of the highest score, then of the least id, in each of n slots; lists merge by adding one's entries to another."""

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.most
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        last = place == self.most - 1
        self.least[slot[last]] = score[last]


@dataclass
class Block:
    """Anchors that are broadcast together; low and high hold the window of each one's positives, one column a positive."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _row_blocks(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of about ROW_BLOCK rows each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROW_BLOCK:
            yield _packed(held, width)
            held, n = [], 0
    if n:
        yield _packed(held, width)


def _packed(batches: list[pa.RecordBatch], width: int):
    ids, labels = (np.concatenate([np.asarray(b.column(k), np.int64) for b in batches]) for k in (0, 1))
    return ids, labels, np.concatenate([matrix(b.column(2), width) for b in batches])


def _positives(block: Block, most: int) -> Callable:
    def found(a: slice, best: Best, ids, labels, s) -> None:
        fits = (block.labels[a, None] == labels) & (block.ids[a, None] != ids) & (s >= best.least[:, None])
        slot, at = np.nonzero(fits)
        best.add(slot, s[slot, at], ids[at])

    return found


def _negatives(block: Block, most: int) -> Callable:
    width = block.low.shape[1]

    def found(a: slice, best: Best, ids, labels, s) -> None:
        other = block.labels[a, None] != labels
        for k in range(width):
            slots = np.arange(len(s)) * width + k
            low = np.maximum(block.low[a, k], best.least[slots])
            fits = other & (s >= low[:, None]) & (s <= block.high[a, k, None])
            row, at = np.nonzero(fits)
            best.add(row * width + k, s[row, at], ids[at])

    return found


def _scan(rows: DataFrame, shared, search: Callable, slots: int, most: int) -> DataFrame:
    """(slot, score, id): each task's best rows for each slot of the broadcast block; `slots` slots an anchor."""

    def run(batches):
        block = shared.value
        starts = range(0, len(block.ids), ANCHOR_BLOCK)
        parts = [slice(lo, min(lo + ANCHOR_BLOCK, len(block.ids))) for lo in starts]
        best = [Best((p.stop - p.start) * slots, most) for p in parts]
        found = search(block, most)
        for ids, labels, x in _row_blocks(batches, block.x.shape[1]):
            for part, own in zip(parts, best, strict=True):
                found(part, own, ids, labels, products(block.x[part], x))
        for part, own in zip(parts, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(own.slot + part.start * slots), pa.array(own.score), pa.array(own.id)], names=["slot", "score", "id"])

    merged = W.partitionBy("slot").orderBy(F.desc("score"), "id")
    lists = rows.mapInArrow(run, "slot long, score long, id long")
    return lists.withColumn("place", F.row_number().over(merged)).filter(F.col("place") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchors: int = ANCHORS) -> DataFrame:
    """Hard negatives of the rows of `usable` that `is_anchor` names, as SCHEMA.

    An anchor's positives are its best `positives` other rows of its label; of
    each, the best `negatives` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score are returned, ranked from 1.
    """
    spark = rows.sparkSession
    picked = rows.filter(is_anchor).distinct()
    n = -(-picked.count() // anchors)
    found = []
    for k in range(n):
        own = picked.filter(F.pmod(F.xxhash64("id", "label", "x"), F.lit(n)) == k).toArrow().combine_chunks().to_batches()  # about `anchors` rows
        if not own:
            continue
        ids, labels = (np.asarray(own[0].column(i), np.int64) for i in (0, 1))
        order = np.argsort(ids, kind="stable")
        block = Block(ids[order], labels[order], matrix(own[0].column(2))[order])
        shared = spark.sparkContext.broadcast(block)
        near = _scan(rows, shared, _positives, 1, positives).toArrow()  # `positives` rows an anchor at most
        shared.unpersist()
        slot, score, other, place = (np.asarray(near[c], np.int64) for c in ("slot", "score", "id", "place"))
        block.low, block.high = np.full((len(ids), positives), MOST), np.full((len(ids), positives), -MOST)  # no score fits both
        names, scores = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        at = (slot, place - 1)
        names[at], scores[at] = other, score
        whole = score.astype(object)
        block.low[at] = (-(-low * whole // 100)).astype(np.int64)
        block.high[at] = (high * whole // 100).astype(np.int64)
        shared = spark.sparkContext.broadcast(block)
        pairs = spark.createDataFrame(pa.table({"slot": np.arange(names.size), "anchor_id": np.repeat(block.ids, positives), "positive_id": names.ravel(), "positive_score": scores.ravel()}))
        lists = _scan(rows, shared, _negatives, positives, negatives).join(F.broadcast(pairs), "slot")  # `positives` rows an anchor
        part = lists.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if n == 1:
            return part
        found.append(cut(part))
        shared.unpersist()
    out = spark.createDataFrame([], SCHEMA)
    for part in found:
        out = out.unionByName(part)
    return out


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The rows of SCHEMA: anchors are rows whose vec_id is divisible by 100; labels of ids divisible by 7 move up by one, modulo 10."""
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(embeddings).withColumn("label", moved), F.col("id") % 100 == 0)
