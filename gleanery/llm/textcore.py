"""Vectorised work on the bytes of Arrow text columns, and shared Spark helpers.

Texts are handled as UTF-8 bytes in slices of a few megabytes, so a Python
worker's memory is bounded by one slice (or by one document that is longer).
A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from gleanery.operators.lineage import cut, remove_folder, shared_folder  # noqa: F401  for the operators

SLICE_BYTES = 1 << 20
#: What bounds an Arrow batch of texts, where the session has no setting of its own: Python workers and buffers then hold a tenth as much.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
PAD = 8

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def byte_class(members) -> np.ndarray:
    """A 256-entry mask with the given byte values set."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, lower-case letters, every non-ASCII byte.
ALNUM_OR_HIGH = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (padded) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if wide == pa.large_binary() else "", wide))
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(PAD, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(raw) + PAD, np.uint8)
    out[: len(raw)] = raw
    return out, offsets - offsets[0]


def text_slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about `limit` bytes of text; free memory goes back to the system at the end."""
    try:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
                hi = min(hi, lo + 4096)
                yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi] + PAD], offsets[lo : hi + 1] - offsets[lo]
                lo = hi
            del data
    finally:
        release()


def word_spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of maximal runs of kept bytes, and each row's first word number (n + 1)."""
    n = int(offsets[-1])
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = keep[data[:n]]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; data carries PAD bytes after the last span."""
    length = ends - starts
    h = mix(length.astype(np.uint64) * _STEP + np.uint64(seed))
    if not len(starts):
        return h
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    rows, at, left = None, starts, length
    while True:
        value = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        if rows is None:
            h = mix((h ^ value) * _M1 + _STEP)
        else:
            h[rows] = mix((h[rows] ^ value) * _M1 + _STEP)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def chain(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q consecutive entries of h (len(h) - q + 1 of them)."""
    n = len(h) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(q), np.uint64)
    for k in range(q):
        out = (out ^ h[k : k + n]) * _M2
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(h: np.ndarray, first: np.ndarray, q: int) -> list[np.ndarray]:
    """Each row's sorted distinct q-word shingle hashes; all words as one shingle where there are fewer."""
    grams = chain(h, q)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(grams[a : b - q + 1]) if n >= q else chain(h[a:b], n) if n else np.zeros(0, np.uint64))
    return out


def binaries(items) -> pa.Array:
    return pa.array([x.tobytes() for x in items], pa.binary())


def bounded_batches(spark: SparkSession) -> None:
    """Sets the BATCHES that the session has no value of its own for."""
    own = spark._jsparkSession.sessionState().conf()
    for key, value in BATCHES.items():
        if not own.contains(key):
            spark.conf.set(key, value)


def release() -> None:
    """Gives memory that is not in use back to the system, where the C library can; workers wait for their next task without it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library than GNU's
        return None


_TRIM = _trimmer()


def one_of(names, wanted: str) -> str:
    """A column name that does not clash, ignoring case, with those given."""
    taken, name = {x.lower() for x in names}, wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name
