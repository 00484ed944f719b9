"""Very frequent contents: known from a sample before a shuffle, and streamed after it.

A content that holds a 2^-16 share of all rows, or more, is told from a sample
of the documents; there are 2^16 of them at most.  Map tasks settle nearly all of
its rows where they are, so no task gets them all.  What the sample does not
name is right all the same, as every other row goes the general way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import last_change
from .textcore import mix

ONE_IN, LEAST_SAMPLED, MOST = 64, 32, 1 << 16
#: Parts that settled rows of one group are dealt to.
SALTS = 63


def content_hash(group: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(mix(group.view(np.uint64)) ^ content.view(np.uint64)).view(np.int64)


def frequent(docs: DataFrame, hashes: Callable[[DataFrame], DataFrame]) -> np.ndarray:
    """The sorted hashes of very frequent contents; `hashes` makes the rows (one long) of some documents."""
    rows = hashes(docs.sample(1.0 / ONE_IN, seed=ONE_IN)).toDF("h")
    each = rows.groupBy("h").agg(F.count("*").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    often = each.crossJoin(F.broadcast(total)).filter((F.col("n") >= LEAST_SAMPLED) & (F.col("n") * MOST >= F.col("total"))).select("h")  # MOST rows at most
    return np.sort(np.asarray(often.toArrow()["h"], np.int64))


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def salts(keys: np.ndarray) -> np.ndarray:
    """1 to SALTS."""
    return (1 + (mix(keys.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64)).astype(np.int32)


def portions(batches, groups: list[str], content: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, part of a larger group): rows that come sorted, in tables that end where a group does.

    A group of more than `most` rows goes in parts that end where a content
    does; the first row of a content of more than `most` rows heads each of its
    parts.  Every row is copied a fixed number of times.
    """
    held: list[pa.Table] = []
    n, part, key = 0, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = pa.Table.from_batches([batch])
        last = tuple(x[g][-1].as_py() for g in groups)
        held.append(x)
        n += x.num_rows
        if last == key and n <= most:  # what is held is of one group
            continue
        rows = pa.concat_tables(held).combine_chunks()
        cut = max((last_change(np.asarray(rows[g])) for g in groups), default=0)
        if cut:
            yield rows.slice(0, cut).combine_chunks(), part
            rows, part = rows.slice(cut), False
        if rows.num_rows > most:
            cut, part = last_change(np.asarray(rows[content])), True
            yield (rows.slice(0, cut) if cut else rows).combine_chunks(), True
            rows = rows.slice(cut) if cut else rows.slice(0, 1)
        held, n, key = [rows.combine_chunks()], rows.num_rows, last
    if held:
        yield pa.concat_tables(held).combine_chunks(), part
