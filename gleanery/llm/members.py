"""A Bloom filter of 64-bit hashes: which rows a join can need, before they are shuffled.

A filter may say yes for a hash that it was not given, never no for one that it
was, so an exact join follows.  Its size is bounded whatever the number of
hashes: beyond MAX_BITS it says yes more often, and more rows reach the join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import release

BITS_EACH = 12
LEAST_BITS = 1 << 12
MAX_BITS = 1 << 27


def bloom_words(hashes: DataFrame) -> np.ndarray:
    """The filter of the hashes (one long column), as 64-bit words: MAX_BITS at most, 16 MB."""
    column = hashes.columns[0]
    n = hashes.count()
    bits = LEAST_BITS
    while bits < min(MAX_BITS, BITS_EACH * n):
        bits *= 2
    mask = F.lit(bits - 1).cast("long")
    place = F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))).alias("place")
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    found = hashes.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(found["word"], np.int64)] = np.asarray(found["bits"], np.int64).view(np.uint64)
    del found
    release()
    return words


def maybe_in(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False for hashes that were surely not given."""
    h, mask = hashes.astype(np.int64).view(np.uint64), np.uint64(64 * len(words) - 1)
    found = np.ones(len(h), bool)
    for place in (h & mask, (h >> np.uint64(32)) & mask):
        found &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found
