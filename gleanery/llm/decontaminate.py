"""Benchmark decontamination with suffix arrays of the training texts.

Words are runs of [0-9a-z] and non-ASCII characters after ASCII lower-casing.
Each slice of documents is a shard with its own word-level suffix array, over
the suffixes that start as many benchmark words in a row as the shortest
window has.  Every suffix of a benchmark item is looked up by binary search,
word by word, in all shards, to the depth of a window; its range of suffixes
gives every occurrence.  An occurrence that no earlier suffix of the item has
one word before is followed on, word by word, to its end: the longest verbatim
match there, with its place.  Words within any window are hit; hit words that
touch or overlap join to spans.

The benchmark is read in blocks of BLOCK_BYTES of text: one block is all that
the driver or a worker holds, and a further block is a further map over the
rows.  No shuffle.

Null or empty texts have no words and no hits.  Items of the same id are one
item; items with a null id or without words are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import joined
from .textcore import ALNUM_OR_HIGH, LOWER_ASCII, one_of, span_hash, text_slices, utf8, word_spans

WINDOW = 13
BLOCK_BYTES = 8 << 20


class TestSuffixes:
    """The windows of one block of benchmark items, as numbers of words in its vocabulary."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        data, offsets = utf8(pa.array(texts, pa.string()))
        data = LOWER_ASCII[data]
        starts, ends, first = word_spans(data, offsets, ALNUM_OR_HIGH)
        words = span_hash(data, starts, ends)
        self.vocabulary, number = np.unique(words, return_inverse=True)
        count = np.diff(first)
        length = np.minimum(count, window)
        n = np.where(count > 0, count - length + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), n)
        at = first[:-1][self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(n) - n, n)
        self.length = length[self.item]
        self.depth = int(self.length.max(initial=0))
        padded = np.concatenate([number + 1, np.zeros(window + 1, np.int64)]).astype(np.int64)
        #: All items' words with a 0 after each, and where in it each window starts.
        self.stream = np.zeros(len(number) + len(ids) + 1, np.int64)
        self.stream[np.arange(len(number)) + np.repeat(np.arange(len(ids)), count)] = number + 1
        self.at = at + self.item
        #: A row for each window; columns past its length are not looked at.
        self.words = padded[at[:, None] + np.arange(self.depth)[None, :]] if len(at) else np.zeros((0, 0), np.int64)
        self.shortest = int(self.length.min(initial=window))
        self.ids = ids
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.vocabulary >> np.uint64(44)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary of each word, 0 where it is not there."""
        out = np.zeros(len(words), np.int64)
        maybe = np.flatnonzero(self.filter[words >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == words[maybe], at + 1, 0)
        return out


def suffix_array(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `text` that start at `at`, ordered by their first `depth` numbers (text is padded by depth zeros)."""
    keys = [text[at + d] << 32 | (text[at + d + 1] if d + 1 < depth else 0) for d in range(0, depth, 2)]
    return at[np.lexsort(keys[::-1])]


def ranges(text: np.ndarray, suffixes: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test windows with a match, first and end of the range of suffixes that start with it)."""
    alive = np.arange(len(tests.length))
    lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(suffixes))
    for d in range(tests.depth):
        going = np.flatnonzero(tests.length[alive] > d)
        want = tests.words[alive[going], d]
        bounds = []
        for side in (0, 1):  # binary search of all windows at once: the first suffix with a number >= want, or > want
            a, b = lo[going].copy(), hi[going].copy()
            while len(open_ := np.flatnonzero(a < b)):
                mid = (a[open_] + b[open_]) >> 1
                less = text[suffixes[mid] + d] < want[open_] + side
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            bounds.append(a)
        lo[going], hi[going] = bounds
        left = lo < hi
        alive, lo, hi = alive[left], lo[left], hi[left]
        if not len(alive):
            break
    return alive, lo, hi


def longest(text: np.ndarray, found: np.ndarray, window: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences that begin a match, words that each goes on for)."""
    if not len(found):
        return found, found
    shift, at = found - tests.at[window], tests.at[window]
    order = np.lexsort([at, shift])
    new = np.concatenate([[True], (shift[order][1:] != shift[order][:-1]) | (at[order][1:] != at[order][:-1] + 1)])
    head = order[new]
    length, going = tests.length[window[head]].copy(), np.arange(len(head))
    while len(going):
        word = text[np.minimum(found[head[going]] + length[going], len(text) - 1)]
        going = going[(word > 0) & (word == tests.stream[at[head[going]] + length[going]])]
        length[going] += 1
    return head, length


def shard_matches(tests: TestSuffixes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word counts; document, first word, end word, item of each occurrence; those that begin a match, and its words) of one slice."""
    data = LOWER_ASCII[data]
    starts, ends, first = word_spans(data, offsets, ALNUM_OR_HIGH)
    count = np.diff(first)
    number = tests.numbers(span_hash(data, starts, ends))
    doc = np.repeat(np.arange(len(count)), count)
    text = np.zeros(len(number) + len(count) + tests.depth + 2, np.int64)  # a zero ends each document
    place = np.arange(len(number)) + doc
    text[place] = number
    stop = np.flatnonzero(text == 0)
    known = np.flatnonzero(text)
    run = stop[np.searchsorted(stop, known)] - known
    at = known[run >= tests.shortest]
    none = np.zeros(0, np.int64)
    if not len(at) or not len(tests.length):
        return count, none, none, none, none, none, none
    suffixes = suffix_array(text, at, tests.depth)
    window, lo, hi = ranges(text, suffixes, tests)
    n = hi - lo
    window = np.repeat(window, n)
    found = suffixes[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(window))]
    of = np.searchsorted(first[:-1] + np.arange(len(count)), found, "right") - 1
    start = found - (first[:-1] + np.arange(len(count)))[of]
    return count, of, start, start + tests.length[window], tests.item[window], *longest(text, found, window, tests)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """(item ids, texts) of the benchmark in blocks of about `limit` bytes."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += 4 * len(text)
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


_MADE = ["match_words", "match_spans", "match_items", "match_longest"]
_LONGEST = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item_id", pa.string())])
_NONE = (0, None, None)


def _found(tests: TestSuffixes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict]:
    """Word counts, and by row with a match: first words, end words, item ids and the longest match (the first of the least item on ties)."""
    count, of, start, end, item, head, length = shard_matches(tests, data, offsets)
    hit: dict[int, tuple] = {}
    best: dict[int, tuple] = {}
    for h, n in zip(head.tolist(), length.tolist(), strict=True):
        row, one = int(of[h]), (n, int(start[h]), tests.ids[item[h]])
        if row not in best or (-one[0], *one[1:]) < (-best[row][0], *best[row][1:]):
            best[row] = one
    if len(of):
        order = np.argsort(of, kind="stable")
        of, start, end, item = of[order], start[order], end[order], item[order]
        cuts = [*np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist(), len(of)]
        hit = {int(of[a]): (start[a:b], end[a:b], {tests.ids[i] for i in np.unique(item[a:b])}, best[int(of[a])]) for a, b in zip(cuts, cuts[1:], strict=False)}
    return count, hit


def find_matches(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Adds to every row: match_words (word count), match_spans (first and end word of each span of hit words, in turn), match_items (ids, sorted) and match_longest (words, first word and item of the longest verbatim match)."""
    kept = [c for c in docs.columns if c.lower() not in _MADE]
    names = [f"`{c}` {t}" for c, t in docs.dtypes if c in kept]
    schema = ", ".join([*names, "match_words long, match_spans array<int>, match_items array<string>, match_longest struct<words:bigint,at:bigint,item_id:string>"])
    out, context = docs.select(*[F.col(f"`{c}`") for c in kept]), docs.sparkSession.sparkContext
    for turn, (ids, texts) in enumerate(blocks(benchmark, limit)):
        if turn and not ids:
            break
        block = context.broadcast((ids, texts))

        def run(batches, block=block, turn=turn):
            tests = TestSuffixes(*block.value)
            for rows, data, offsets in text_slices(batches, "text"):
                count, hit = _found(tests, data, offsets)
                if turn:
                    spans, items = rows.column(len(kept) + 1).to_pylist(), rows.column(len(kept) + 2).to_pylist()
                    most = [(x["words"], x["at"], x["item_id"]) for x in rows.column(len(kept) + 3).to_pylist()]
                else:
                    spans, items, most = [[] for _ in count], [[] for _ in count], [_NONE] * len(count)
                for i, (start, end, found, one) in hit.items():
                    old = np.array(spans[i], np.int64).reshape(-1, 2)
                    spans[i] = np.stack(joined(np.concatenate([old[:, 0], start]), np.concatenate([old[:, 1], end])), 1).ravel().tolist()
                    items[i] = sorted({*items[i], *found})
                    most[i] = one if not most[i][0] else min(most[i], one, key=lambda x: (-x[0], *x[1:]))
                longest_ = pa.array([dict(zip(("words", "at", "item_id"), x, strict=True)) for x in most], _LONGEST)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), longest_], names=[*kept, *_MADE])

        out = out.mapInArrow(run, schema)
    return out


def _hit_words():
    """The words within the spans."""
    lengths = F.transform("match_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b).cast("long")


def _contaminated(hit, words):
    return (hit > 0) & (20 * hit >= words)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of which less than a twentieth of the words repeat a benchmark window; columns as given, those named like the matches too."""
    aside = {c: one_of([*docs.columns, *_MADE], f"own_{c}") for c in docs.columns if c.lower() in _MADE}
    found = find_matches(docs.withColumnsRenamed(aside), benchmark).filter(~_contaminated(_hit_words(), F.col("match_words")))
    return found.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match (longest_words, 0 for none, and longest_at, its first word) of every document."""
    found = find_matches(docs.select("doc_id", "text"), benchmark).select("doc_id", "match_words", "match_items", "match_longest", _hit_words().alias("n_hit"))
    return found.select(
        "doc_id",
        F.col("match_words").alias("n_words"),
        "n_hit",
        F.size("match_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match_items", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit"), F.col("match_words")).alias("contaminated"),
        F.col("match_longest.words").alias("longest_words"),
        F.col("match_longest.at").alias("longest_at"),
    )
