"""Language identification by the nearest of several centroids per language.

Features are runs of 2 to 4 bytes of the lower-cased text, in which every stretch
of ASCII characters that are not letters is one space, hashed into DIMENSIONS
places.  A text's vector holds (1 + ln count) * idf, of length 1; its language is
that of the centroid of the largest cosine, its distance 1 - cosine.

Training: at most SAMPLE rows of each of the LANGUAGES most frequent languages
(documented bounds; of a language the rows with the least hashes of doc_id, one
row a doc_id, texts with a letter).  idf comes from these rows, and spherical
k-means makes at most CENTROIDS centroids a language, each language in a task of
its own.  The distance that rejects is the REJECT quantile of the distances of a
language's own rows, by the number of different features (short texts lie
further away); a class without rows takes the next longer one's, and no class
less than a longer one.

Texts of any length are counted in pieces, whole; a task holds BLOCK vectors.
Null texts and texts without a letter are `und` with score 0 and are not learnt
from.  Without a language to learn every text is `und`.  A null doc_id counts as
an empty one for `held_out`.  Input columns stay where `identify` adds its own;
one that is named like an added one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import byte_class, cut, one_of, text_slices

SAMPLE, LANGUAGES, CENTROIDS, ROUNDS = 600, 200, 4, 12
DIMENSIONS = 1 << 13
ORDERS = (2, 3, 4)
REJECT = 0.995
#: Texts of fewer different features than each of these are a class of their own for the distance that rejects.
SIZES = (32, 128, 512, 2048)
BLOCK, PIECE = 256, 1 << 20
UNKNOWN = "und"

_LETTERS = byte_class([*range(0x61, 0x7B), *range(0x80, 0x100)])
_PLAIN = np.where(_LETTERS, np.arange(256), 0x20).astype(np.uint8)
_FACTOR = np.uint32(0x9E3779B1)
_BITS = np.uint32(32 - (DIMENSIONS.bit_length() - 1))


def squeezed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-cased rows with each stretch of non-letters as one space, and the rows' new offsets."""
    n = int(offsets[-1])
    plain = _PLAIN[data[:n]]
    space = plain == 0x20
    double = np.zeros(n, bool)
    double[1:] = space[1:] & space[:-1]
    double[offsets[:-1][offsets[:-1] < n]] = False
    kept = np.concatenate([[0], np.cumsum(~double)])
    return plain[~double], kept[offsets]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each row (of squeezed bytes) has a feature of each place."""
    rows, n = len(offsets) - 1, int(offsets[-1])
    out = np.zeros(rows * DIMENSIONS, np.int64)
    padded = np.concatenate([data[:n], np.zeros(ORDERS[-1], np.uint8)])
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        part = padded[lo : hi + ORDERS[-1]].astype(np.uint32)
        first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (lo, hi - 1))
        row = np.repeat(np.arange(first, last + 1), np.diff(np.clip(offsets[first : last + 2], lo, hi)))
        left = offsets[row + 1] - np.arange(lo, hi)
        value, keys = np.zeros(hi - lo, np.uint32), []
        for k in range(ORDERS[-1]):
            value |= part[k : k + hi - lo] << np.uint32(8 * k)
            if k + 1 in ORDERS:
                place = ((value ^ np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF)) * _FACTOR) >> _BITS
                keys.append((row * DIMENSIONS + place)[left > k])
        out += np.bincount(np.concatenate(keys), minlength=len(out))
    return out.reshape(rows, DIMENSIONS)


def blocks(batches, text: str):
    """(rows, counts) of BLOCK texts at most; their lower case is taken a batch at a time."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        lower = pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(at).cast(pa.large_string()))], names=["lower"])
        done = 0
        for part, data, offsets in text_slices([lower], "lower"):
            for lo in range(0, part.num_rows, BLOCK):
                hi = min(lo + BLOCK, part.num_rows)
                own = data[offsets[lo] : offsets[hi]]
                yield batch.slice(done + lo, hi - lo), counts(*squeezed(own, offsets[lo : hi + 1] - offsets[lo]))
            done += part.num_rows


@dataclass
class Centroids:
    """languages: of each centroid; cuts: the rejecting distance of each centroid's language by class of size."""

    languages: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    cuts: np.ndarray


def vectors(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of rows of counts (zero where there are none), and how many features each has."""
    row, place = np.nonzero(found)
    value = (1 + np.log(found[row, place])) * idf[place]
    length = np.sqrt(np.bincount(row, value**2, len(found)))
    out = np.zeros(found.shape, np.float32)
    out[row, place] = value / length[row]
    return out, np.bincount(row, minlength=len(found))


def clustered(x: np.ndarray, most: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: spherical k-means from rows that are far from each other; ties go to the first."""
    centre = x.mean(axis=0)
    starts = [int(np.argmax(x @ centre))]
    near = x @ x[starts[0]]
    while len(starts) < min(most, len(x)) and near.min() < 1 - 1e-6:
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    c, before = x[starts], None
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        if before is not None and (own == before).all():
            break
        before = own
        c = np.stack([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def rejecting(distance: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The REJECT quantile of the distances in each class of size; a class takes no less than any longer one."""
    own = np.searchsorted(SIZES, features, "right")
    out, least = np.ones(len(SIZES) + 1), None
    for k in range(len(SIZES), -1, -1):
        if (own == k).any():
            here = float(np.quantile(distance[own == k], REJECT))
            least = here if least is None else max(least, here)
        out[k] = 1.0 if least is None else least
    return out


def has_letter(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _sample(docs: DataFrame) -> DataFrame:
    """(lang, text): SAMPLE rows of each language at most; the choice reads doc_id and lang alone."""
    able = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    frequent = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    least = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # twice as many as are learnt from, as some texts may have no letter: 2 * SAMPLE * LANGUAGES short rows
    chosen = able.join(F.broadcast(frequent), "lang").distinct().withColumn("place", F.row_number().over(least)).filter(F.col("place") <= 2 * SAMPLE)
    lettered = docs.filter(F.col("lang").isNotNull() & ~held_out() & has_letter("text")).select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    texts = lettered.join(F.broadcast(chosen), ["lang", "id"])
    one = texts.groupBy("lang", "id", "place").agg(F.min("text").alias("text"))
    return one.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("place"))).filter(F.col("n") <= SAMPLE).select("lang", "n", "text")


def fit(docs: DataFrame) -> Centroids:
    """A model from (doc_id, text, lang) of a bounded sample of the rows outside the held-out quarter."""

    def run(batches):
        for rows, found in blocks(batches, "text"):
            row, place = np.nonzero(found)
            cuts = np.searchsorted(row, np.arange(rows.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (place, found[row, place])]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], names=["lang", "n", "place", "times"])

    held = cut(_sample(docs).mapInArrow(run, "lang string, n int, place array<int>, times array<int>"))
    idf = np.zeros(DIMENSIONS)
    documents = held.select(F.explode("place").alias("place")).groupBy("place").count().toArrow()  # DIMENSIONS rows at most
    idf[np.asarray(documents["place"])] = np.asarray(documents["count"])
    idf = np.log((1 + held.count()) / (1 + idf)) + 1

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        found = np.zeros((len(rows), DIMENSIONS), np.int64)
        for i, (place, times) in enumerate(zip(rows["place"], rows["times"], strict=True)):
            found[i, place] = times
        x, features = vectors(found, idf)
        c = clustered(x)
        distance = 1 - np.max(x @ c.T, axis=1)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "k": np.arange(len(c)), "vector": [v.astype("<f4").tobytes() for v in c], "cuts": [rejecting(distance, features)] * len(c)})

    made = held.groupBy("lang").applyInPandas(centroids, "lang string, k int, vector binary, cuts array<double>").toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])  # LANGUAGES * CENTROIDS rows at most
    pack = lambda items, width: np.stack(items) if items else np.zeros((0, width), np.float32)
    return Centroids(made["lang"].to_pylist(), idf, pack([np.frombuffer(v, "<f4") for v in made["vector"].to_pylist()], DIMENSIONS), pack([np.array(c) for c in made["cuts"].to_pylist()], len(SIZES) + 1))


def identify(docs: DataFrame, model: Centroids, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the nearest language, the cosine with its centroid (0 to 1), and whether the distance is beyond the language's own."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x.lower() for x in out}]
    lettered = one_of([*[f.name for f in kept], *out], "lettered")
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], has_letter(f"`{text}`").alias(lettered))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        languages = np.array([*m.languages, UNKNOWN], object)
        for part, found in blocks(batches, text):
            x, features = vectors(found, m.idf)
            near = x @ m.vectors.T if len(m.languages) else np.zeros((len(x), 1), np.float32)
            best = np.argmax(near, axis=1)
            score = np.clip(near[np.arange(len(x)), best].astype(float), 0, 1)
            known = np.asarray(part.column(part.num_columns - 1).to_numpy(zero_copy_only=False), bool) & (features > 0) & bool(m.languages)
            cuts = m.cuts[best, np.searchsorted(SIZES, features, "right")] if len(m.languages) else np.ones(len(x))
            best = np.where(known, best, len(m.languages))
            columns = [pa.array(languages[best], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(~known | (1 - score > cuts))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *out])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{out[0]}` string", f"`{out[1]}` double", f"`{out[2]}` boolean"])
    return rows.mapInArrow(run, schema)


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; a rejected text keeps its nearest language."""
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
