r"""Substring dedup: near-duplicate passages by compact windows over token min-hashes.

Tokens are 5-word shingles (words: runs of characters other than the space and
\t-\r, ASCII lower-cased); passages are windows of TOKENS tokens, 50 words, or
more.  Under one hash, the node of a document's Cartesian tree with minimum c
and span l to r stands for all subsequences that hold c within l to r: a
compact window.  Only nodes with a span of TOKENS or more matter, and those are
the leftmost minima of the windows of that many tokens.

1. Each compact window of HASHES independent hashes is one row: the run of
   window starts that have its minimum, with that minimum as signature.  One
   shuffle deals the rows by signature; a signature that is alone has no
   near-duplicate.
2. Runs of one signature with equal tokens throughout repeat verbatim.
3. The different contents of a signature are compared, across documents: where
   their intervals of window starts meet, windows of equal distance from the
   minimum are passages of one another if the Jaccard similarity of their
   tokens is SIMILARITY or more.  Runs of whose windows too few tokens stand in
   any other document of the group drop out before, as do pairs of which all
   that can repeat is known to and pairs that share too little by their
   bitmaps.  Signatures of more than MAX_GROUP contents are dealt over pairs of
   blocks.
4. Of each verified pair, the passage in the document with the larger doc_id
   is the repeat; the least of each class stays.  A row's repeats all hold its
   minimum, so they are one span, and links that connect what pairs connect
   suffice: at most two for each row.  Classes of documents are the components
   of these links.

Verbatim repeats of 50 words share every signature and are compared, so none is
missed.  One minimum in common is enough: at a similarity of 0.8 all HASHES
fail a window with probability 0.2 ** 3, 0.8 %, and a longer passage has several
windows (tests measure recall).  Passages are compared across documents, not
within one.

Null and empty texts, and texts under 50 words, have no passages.  Repeated
rows of the same doc_id and text count as one document.  A null doc_id sorts
before all others.  Ids that are no integers are ordered by their hash: the
document of the larger hash is the repeat, and a class has its least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import window_least
from .components import components
from .hot import content_hash, frequent, is_in, portions, salts
from .members import bloom_words, maybe_in
from .spans import joined, last_change, once_a_row
from .textcore import LOWER_ASCII, NOT_SPACE, chain, cut, mix, one_of, span_hash, text_slices, word_spans

SHINGLE = 5
TOKENS = 46
SIMILARITY = 0.8
HASHES = 3
MAX_GROUP = 4_000
PAIRS = 1 << 13
HELD_ROWS = 1 << 20
VERBATIM, PARTIAL, SAMPLE = 0, 1, 2
NO_ID = -(1 << 63)
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_RUN = ["signature", "content", "doc", "text_key", "at", "first", "last", "again"]


def _doubled(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m (a power of two) consecutive entries."""
    factor, k = 0x9FB21C651E98DF25, 1
    while k < m:
        h = h[:-k] * np.uint64(factor) + h[k:]
        factor, k = factor * factor % (1 << 64), 2 * k
    return mix(h)


def compact_windows(tokens: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, first and last start of the windows of `width` tokens that have it): the Cartesian tree's nodes of that span or more, by the hash of one seed."""
    if len(tokens) < width:
        return (np.zeros(0, np.int64),) * 3
    pick = _least_places(tokens, width, seed)
    new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
    return pick[new], new, np.append(new[1:], len(pick)) - 1


def _least_places(tokens: np.ndarray, width: int, seed: int) -> np.ndarray:
    keys = (mix(tokens ^ _SEEDS[seed]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(tokens), dtype=np.uint64)
    return (window_least(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def signature_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, signature, content, place of the minimum, first and last window start) of a slice's runs; places count words in the row."""
    data = LOWER_ASCII[data]
    starts, ends, begin = word_spans(data, offsets, NOT_SPACE)
    count = np.maximum(np.diff(begin) - SHINGLE - TOKENS + 2, 0)
    if not count.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    tokens = chain(span_hash(data, starts, ends, seed=2), SHINGLE)
    valid = np.repeat(begin[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = np.repeat(np.arange(len(count)), count)
    block, found = _doubled(tokens, 32), []
    for k in range(HASHES):
        pick = _least_places(tokens, TOKENS, k)[valid]
        new = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])]))
        first, last, at = valid[new], valid[np.append(new[1:], len(valid)) - 1], pick[new]
        content, end = (last - first).astype(np.uint64), last + TOKENS - 32
        for m in (0, 32, 64):
            content = mix((content ^ block[np.minimum(first + m, end)]) * _SEEDS[0])
        base = begin[row[new]]
        found.append((row[new], mix(mix(tokens[at]) + np.uint64(k + 1)), mix(content ^ block[end]), at - base, first - base, last - base))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _number(docs: DataFrame) -> Column:
    """A document's id as a long, NO_ID for none: the id itself, or a hash of one that is no integer."""
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    return F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.lit(NO_ID))


def _keyed(docs: DataFrame) -> list[Column]:
    """doc and text_key, by which a row is known."""
    return [_number(docs).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


def _fresh(batches):
    """Batches of (doc, text_key, text) without rows that this task has had."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        rows = []
        for r, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                rows.append(r)
        yield batch.take(pa.array(rows, pa.int64())) if len(rows) < batch.num_rows else batch


def _run_key(signature: np.ndarray, doc: np.ndarray, text_key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash that names one run."""
    u = lambda x: x.astype(np.int64).view(np.uint64)
    return mix(mix(mix(u(signature) + _SEEDS[1]) ^ u(doc)) + u(text_key) ^ mix(u(at) + _SEEDS[2])).view(np.int64)


def _first_runs(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """A slice's runs, once a document, signature and content: (row, signature, content, at, first, last), and the first window starts of further occurrences."""
    found = signature_runs(data, offsets)
    keep, cuts, others = once_a_row(found[0], [found[1], found[2]], found[4])
    return [x[keep] for x in found], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(others, pa.int32()))


def _frequent(docs: DataFrame) -> np.ndarray:
    """The hashes of very frequent contents of runs."""

    def run(batches):
        for _, data, offsets in text_slices(batches, "text"):
            _, signature, content, *_ = signature_runs(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(content_hash(signature, content))], names=["h"])

    return frequent(docs.select("text"), lambda some: some.mapInArrow(run, "h long"))


def _runs(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """A row per document, signature and content; `again` holds the first window starts of its further occurrences in the document.

    Of a very frequent content a task sends the run of its least document the
    general way (salt 0).  Its others surely repeat that one (`other`), and have
    a salt that deals them over parts of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        least: dict[int, pa.RecordBatch] = {}
        for part, data, offsets in text_slices(_fresh(batches), "text"):
            (row, signature, content, at, first, last), again = _first_runs(part, data, offsets)
            doc, key = (np.asarray(part.column(c), np.int64)[row] for c in (0, 1))
            h = content_hash(signature, content)
            often = is_in(shared.value, h)
            salt, other = np.where(often, salts(key), 0).astype(np.int32), doc.copy()
            rows = pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (signature, content)), pa.array(doc), pa.array(key), *(pa.array(x.astype(np.int32)) for x in (at, first, last)), again], names=_RUN)
            settled = lambda x, s, o: pa.RecordBatch.from_arrays([*x.columns, pa.array(s, pa.int32()), pa.array(o, pa.int64())], names=[*_RUN, "salt", "other"])
            for r in np.flatnonzero(often).tolist():
                name, known = int(h[r]), least.get(int(h[r]))
                if known is None or doc[r] < known.column(2)[0].as_py():
                    if known is not None:
                        yield settled(known, [1], [int(doc[r])])
                    least[name] = rows.slice(r, 1)
                    salt[r] = -1  # goes at the end
                else:
                    other[r] = known.column(2)[0].as_py()
                    if other[r] == doc[r]:  # another text of the same id: it repeats what is of a lesser one still, if any is
                        salt[r] = -1 if doc[r] == NO_ID else 0
            going = np.flatnonzero(salt >= 0)
            yield settled(rows, salt, other).take(pa.array(going))
        for known in least.values():
            yield settled(known, [0], [known.column(2)[0].as_py()])

    return docs.select(*_keyed(docs), "text").mapInArrow(run, "signature long, content long, doc long, text_key long, at int, first int, last int, again array<int>, salt int, other long")


def _marked(runs: DataFrame) -> DataFrame:
    """Runs whose signature repeats.  VERBATIM: equal to an earlier document's run (`other`); PARTIAL: content is alone; SAMPLE: the earliest of equal runs, where other documents share the signature.  `many`: the signature may have more than MAX_GROUP contents."""

    def classify(x: pa.Table, forced: bool):
        signature, content, doc, salt = (np.asarray(x[c]) for c in ("signature", "content", "doc", "salt"))
        group_new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (salt[1:] != salt[:-1])])
        new = group_new | np.concatenate([[True], content[1:] != content[:-1]])
        run, group = np.cumsum(new) - 1, np.cumsum(group_new) - 1
        size, head, plain = np.bincount(run), np.flatnonzero(new), salt == 0
        contents, heads = np.bincount(group, new), np.flatnonzero(group_new)
        several = ((contents >= 2) & (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)))[group] | forced
        many = (contents > MAX_GROUP)[group] | forced
        other = np.where(plain, doc[head[run]], np.asarray(x["other"]))
        verbatim = ((size[run] >= 2) | ~plain) & (doc != other)
        partial, sample = plain & (size[run] == 1) & several, plain & (size[run] >= 2) & new & several
        places = [np.flatnonzero(m) for m in (verbatim, partial, sample)]
        at = np.concatenate(places)
        kind = np.repeat([VERBATIM, PARTIAL, SAMPLE], [len(p) for p in places]).astype(np.int32)
        key = _run_key(signature[at], doc[at], np.asarray(x["text_key"])[at], np.asarray(x["at"])[at])
        marks = x.drop_columns(["content", "at", "salt", "other"]).take(pa.array(at))
        for name, values in (("kind", kind), ("other", other[at]), ("many", many[at]), ("key", key)):
            marks = marks.append_column(name, pa.array(values))
        yield from marks.combine_chunks().to_batches()

    most = HELD_ROWS

    def run(batches):
        for rows, part in portions(batches, ["signature", "salt"], "content", most):
            yield from classify(rows, part)

    return runs.repartition("signature", "salt").sortWithinPartitions("signature", "salt", "content", "doc", "first").mapInArrow(run, "signature long, doc long, text_key long, first int, last int, again array<int>, kind int, other long, many boolean, key long")


def _contexts(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """The runs that are compared with their words, in cells (i, j) of their signature with their own block.

    Each pair of blocks is a cell, so any two runs of a signature meet in one.
    Runs are found anew in the texts, and a Bloom filter of the marks says which
    to send; the few that it takes for marks are runs of the signature too.
    """
    compared = marks.filter(F.col("kind") != VERBATIM)
    shared = docs.sparkSession.sparkContext.broadcast(bloom_words(compared.select("key")))
    names = ["signature", "at", "first", "last", "doc", "text_key", "bytes", "again"]

    def run(batches):
        for part, data, offsets in text_slices(_fresh(batches), "text"):
            (row, signature, _, at, first, last), again = _first_runs(part, data, offsets)
            doc, key = (np.asarray(part.column(c), np.int64)[row] for c in (0, 1))
            wanted = np.flatnonzero(maybe_in(shared.value, _run_key(signature.view(np.int64), doc, key, at)))
            if not len(wanted):
                continue
            row, signature, at, first, last, doc, key = (x[wanted] for x in (row, signature, at, first, last, doc, key))
            starts, ends, begin = word_spans(data, offsets, NOT_SPACE)
            a, b = starts[begin[row] + first], ends[begin[row] + last + TOKENS + SHINGLE - 2]
            raw = data.tobytes()
            cut = pa.array([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at, first, last)), pa.array(doc), pa.array(key), cut, again.take(pa.array(wanted))], names=names)

    rows = docs.select(*_keyed(docs), "text").mapInArrow(run, _CONTEXT)
    large = cut(compared.filter("many").groupBy("signature").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_GROUP).select("signature"))  # a row for MAX_GROUP marks or more
    if large.limit(1).count():
        rows = cut(rows)
        alive = cut(_with_support(rows.join(F.broadcast(large), "signature", "left_semi")))
        rows = rows.join(F.broadcast(large), "signature", "left_anti").unionByName(alive)
        sizes = alive.groupBy("signature").agg(F.ceil(F.count("*") / MAX_GROUP).cast("int").alias("blocks"))
        rows = rows.join(F.broadcast(sizes), "signature", "left")
    else:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    dealt = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("doc", "text_key", "first"), F.col("blocks")).cast("int")
    meets = dealt.withColumn("block", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meets.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o", "blocks")


_CONTEXT = "signature long, at int, first int, last int, doc long, text_key long, bytes binary, again array<int>"


def _tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each row's words, and where each row's begin (n + 1)."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, data, offsets in text_slices([pa.RecordBatch.from_arrays([column], names=["bytes"])], "bytes"):
        low = LOWER_ASCII[data]
        starts, ends, begin = word_spans(low, offsets, NOT_SPACE)
        chained = chain(span_hash(low, starts, ends, seed=2), SHINGLE)
        size = np.diff(begin) - SHINGLE + 1
        parts.append(chained[np.repeat(begin[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        sizes.append(size)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _with_support(rows: DataFrame) -> DataFrame:
    """The runs of large signatures with a window that may be similar to one of another document.

    A token that no other document of the signature has can't be shared.  Tokens
    are counted by signature, with partial aggregation, before any run is copied
    to blocks; a Bloom filter of those in two documents or more, of bounded size,
    judges the runs where they are, and keeps what it is not sure of.
    """

    def named(signature: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return mix(tokens ^ mix(signature.view(np.uint64))).view(np.int64)

    def tokens(batches):
        for batch in batches:
            if batch.num_rows:
                found, begin = _tokens_of(batch.column(6))
                row = np.repeat(np.arange(batch.num_rows), np.diff(begin))
                signature, doc = (np.asarray(batch.column(k), np.int64)[row] for k in (0, 4))
                yield pa.RecordBatch.from_arrays([pa.array(named(signature, found)), pa.array(doc)], names=["h", "doc"])

    each = rows.mapInArrow(tokens, "h long, doc long").groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"))
    shared = rows.sparkSession.sparkContext.broadcast(bloom_words(cut(each.filter("a <> b").select("h"))))

    def judged(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found, begin = _tokens_of(batch.column(6))
            signature, at, first, doc = (np.asarray(batch.column(k), np.int64) for k in (0, 1, 2, 4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            supported = maybe_in(shared.value, named(signature[row], found))
            contexts = Contexts(found, begin, at - first, np.zeros(batch.num_rows, np.int64), doc, supported)
            yield batch.take(pa.array(np.flatnonzero(contexts.alive)))

    return rows.mapInArrow(judged, _CONTEXT)


def _supported(tokens: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which tokens stand in runs of two documents or more of their group."""
    if not len(tokens):
        return np.zeros(0, bool)
    key = mix(tokens ^ mix(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    docs = doc[order]
    several = np.minimum.reduceat(docs, new) != np.maximum.reduceat(docs, new)
    out = np.empty(len(tokens), bool)
    out[order] = np.repeat(several, np.diff(np.append(new, len(order))))
    return out


class Contexts:
    """Runs' tokens in rows of SPAN places with the minimum at TOKENS - 1, and bitmaps that bound what two of them share."""

    SPAN = 2 * TOKENS - 1

    def __init__(self, tokens: np.ndarray, begin: np.ndarray, center: np.ndarray, group: np.ndarray, doc: np.ndarray, supported: np.ndarray | None = None):
        """`supported`: which tokens other documents of the group have, where that is known."""
        n, length = len(center), np.diff(begin)
        row = np.repeat(np.arange(n), length)
        self.low, self.high = TOKENS - 1 - center, length - 1 - center  # first and last start of a window
        place = np.arange(len(row)) - begin[row] + self.low[row]
        self.tokens = np.zeros((n, self.SPAN), np.uint64)
        self.tokens[row, place] = tokens
        bits = np.zeros((n, 1024), np.uint8)
        bits[row, (mix(tokens ^ np.uint64(0x5151)) % np.uint64(1024)).astype(np.int64)] = 1
        self.maps = np.packbits(bits, axis=1).view(np.uint64)
        order = np.lexsort([place, tokens, row])
        same = (tokens[order][1:] == tokens[order][:-1]) & (row[order][1:] == row[order][:-1])
        before = np.full(len(row), -1)  # the last place of the same token
        before[order[1:][same]] = place[order[:-1][same]]
        again = np.bincount(row[before >= 0], minlength=n)
        self.spill = length - again - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        self.again = again > 0
        #: By start of a window: its number of different tokens, and whether it is one.
        start = np.arange(TOKENS)
        self.within = (start >= self.low[:, None]) & (start <= self.high[:, None])
        self.different = self._counted(row, place, before, np.ones(len(row), bool))
        self.fewest = np.where(self.within, self.different, TOKENS).min(axis=1).astype(np.int64)
        self._reach(row, place, before, _supported(tokens, group[row], doc[row]) if supported is None else supported)

    def _counted(self, row: np.ndarray, place: np.ndarray, before: np.ndarray, which: np.ndarray) -> np.ndarray:
        """By row and start of a window: how many different tokens of those in `which` it has; a token counts at its first place in the window."""
        row, place, before = row[which], place[which], before[which]
        first, last = np.maximum(before + 1, place - TOKENS + 1), np.minimum(place, TOKENS - 1)
        some = first <= last
        at, cells = row[some] * (TOKENS + 1), len(self.low) * (TOKENS + 1)
        steps = np.bincount(at + first[some], minlength=cells) - np.bincount(at + last[some] + 1, minlength=cells)
        return np.cumsum(steps.reshape(-1, TOKENS + 1), axis=1, dtype=np.int16)[:, :-1]

    def _reach(self, row: np.ndarray, place: np.ndarray, before: np.ndarray, supported: np.ndarray) -> None:
        """`alive`: rows with a window that may be similar to one of another document; `least` and `most`: how far from the minimum a repeat can reach.

        A window can share only tokens that another document of the group has.
        Where windows match place by place, ends of a repeat are such tokens.
        """
        may = self.within & (self._counted(row, place, before, supported) >= SIMILARITY * self.different - 1e-9)
        self.alive = may.any(axis=1)
        first, end = may.argmax(axis=1), 2 * (TOKENS - 1) - may[:, ::-1].argmax(axis=1)
        grid = np.zeros((len(self.low), self.SPAN), bool)
        grid[row, place] = supported
        where = np.arange(self.SPAN)
        inside = grid & (where >= first[:, None]) & (where <= end[:, None])
        trim = ~self.again & self.alive
        first[trim], end[trim] = inside[trim].argmax(axis=1), self.SPAN - 1 - inside[trim][:, ::-1].argmax(axis=1)
        self.least, self.most = first - TOKENS + 1, end - TOKENS + 1

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most different tokens that the two can share."""
        return np.bitwise_count(self.maps[a] & self.maps[b]).sum(axis=1, dtype=np.int64) + np.minimum(self.spill[a], self.spill[b])

    @staticmethod
    def _enough(shared: np.ndarray, different: np.ndarray) -> np.ndarray:
        """Whether sets of so many elements, together, that share so many have SIMILARITY or more."""
        return (1 + SIMILARITY) * shared >= SIMILARITY * different - 1e-9

    def similar(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, first and last distance from the minima): where windows of a and b have SIMILARITY or more; pulled in to tokens that are equal, if windows match place by place."""
        shared = self.shared(a, b)
        some = np.flatnonzero(self._enough(shared, self.fewest[a] + self.fewest[b]))
        a, b, shared = a[some], b[some], shared[some]
        within = self.within[a] & self.within[b]
        different = self.different[a] + self.different[b]
        plain = np.flatnonzero(~(self.again[a] | self.again[b]))
        same = self.tokens[a[plain]] == self.tokens[b[plain]]
        total = np.concatenate([np.zeros((len(plain), 1), np.int16), np.cumsum(same, axis=1, dtype=np.int16)], axis=1)
        alike = total[:, TOKENS:] - total[:, :-TOKENS]
        enough = self._enough(alike, 2 * TOKENS) & within[plain]
        hit = enough.any(axis=1)
        at = np.flatnonzero(hit)
        first, end = enough[at].argmax(axis=1), 2 * (TOKENS - 1) - enough[at][:, ::-1].argmax(axis=1)
        place = np.arange(self.SPAN)
        inside = same[at] & (place >= first[:, None]) & (place <= end[:, None])
        first, end = inside.argmax(axis=1), self.SPAN - 1 - inside[:, ::-1].argmax(axis=1)
        # Windows share at most what is equal place by place and what the two share elsewhere.
        low, high = np.maximum(self.low[a[plain]], self.low[b[plain]]), np.minimum(self.high[a[plain]], self.high[b[plain]])
        every = np.arange(len(plain))
        whole = np.where(low <= high, total[every, np.maximum(high, 0) + TOKENS] - total[every, np.minimum(low, TOKENS - 1)], 0)
        bound = np.broadcast_to(shared[:, None], within.shape).copy()
        bound[plain] = np.minimum(bound[plain], alike + np.maximum(shared[plain] - whole, 0)[:, None])
        open_ = within & self._enough(bound, different)
        open_[plain[hit]] = False
        pair, start = np.nonzero(open_)
        ok = np.concatenate([np.zeros(0, bool), *(self._sets(a[pair[k : k + PAIRS]], b[pair[k : k + PAIRS]], start[k : k + PAIRS]) for k in range(0, len(pair), PAIRS))])
        pair, start = pair[ok], start[ok]
        head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)])
        tail = np.append(head[1:], len(pair))[: len(head)] - 1
        distance = np.concatenate([first, start[head]]) - TOKENS + 1, np.concatenate([end, start[tail] + TOKENS - 1]) - TOKENS + 1
        return some[np.concatenate([plain[at], pair[head]])], *distance

    def _sets(self, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        place = start[:, None] + np.arange(TOKENS)
        x, y = np.sort(self.tokens[a[:, None], place], axis=1), np.sort(self.tokens[b[:, None], place], axis=1)
        twice = lambda z: (z[:, 1:] == z[:, :-1]).sum(axis=1)
        p, q = twice(x), twice(y)
        both = twice(np.sort(np.concatenate([x, y], axis=1), axis=1)) - p - q
        return both >= SIMILARITY * (2 * TOKENS - p - q - both)


def _pairs(end: np.ndarray, most: int):
    """Places a < b < end[a], in portions of about `most`."""
    left = end - np.arange(len(end)) - 1
    total, at = np.cumsum(left), 0
    while at < len(end):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        a = np.repeat(np.arange(at, stop), left[at:stop])
        if len(a):
            yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left[at:stop]) - left[at:stop], left[at:stop])
        at = stop


def _joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the least label that the links a - b reach on all of their places."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _compared(x: pa.Table) -> tuple[np.ndarray, ...]:
    """(row, first and last distance from its minimum, other row) of rows sorted by cell and document: the repeats of each row and links that connect what pairs connect."""
    signature, i, j, block, doc = (np.asarray(x[c]) for c in ("signature", "i", "j", "block", "doc"))
    n = len(doc)
    tokens, begin = _tokens_of(x["bytes"].combine_chunks())
    new = np.concatenate([[True], (signature[1:] != signature[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    group = np.cumsum(new) - 1
    contexts = Contexts(tokens, begin, np.asarray(x["at"], np.int64) - np.asarray(x["first"]), group, doc)
    rows = np.flatnonzero(contexts.alive)
    heads = np.flatnonzero(np.concatenate([[True], group[rows][1:] != group[rows][:-1]])[: len(rows)])
    end = np.repeat(np.append(heads[1:], len(rows))[: len(heads)], np.diff(np.append(heads, len(rows))))
    first, last, label, partner = np.full(n, TOKENS), np.full(n, -TOKENS), np.arange(n), np.full(n, -1)
    for a, b in _pairs(end, 8 * PAIRS):
        for k in range(0, len(a), PAIRS):
            early, late = rows[a[k : k + PAIRS]], rows[b[k : k + PAIRS]]  # rows come in the order of doc
            settled = (first[late] <= contexts.least[late]) & (last[late] >= contexts.most[late]) & (label[early] == label[late])  # all of late that can repeat does, and they are linked
            keep = np.flatnonzero(~settled & (doc[early] != doc[late]) & ((i[early] == j[early]) | (block[early] != block[late])))
            early, late = early[keep], late[keep]
            pair, lo, hi = contexts.similar(early, late)
            early, late = early[pair], late[pair]
            np.minimum.at(first, late, lo)
            np.maximum.at(last, late, hi)
            partner[early] = late
            _joined_labels(label, early, late)
    late = np.flatnonzero(last > -TOKENS)
    only = np.flatnonzero((last == -TOKENS) & (label != np.arange(n)))
    row = np.concatenate([late, partner[only]])
    return row, first[row], last[row], np.concatenate([label[late], only])


def _verified(contexts: DataFrame) -> DataFrame:
    """(doc, text_key, first, end, other): a passage (words first to end) of `doc` near one of a smaller id; `other` shares its class."""
    names = ["doc", "text_key", "first", "end", "other"]

    def found(x: pa.Table):
        row, lo, hi, other = _compared(x)
        doc, key, at, first = (np.asarray(x[c], np.int64) for c in ("doc", "text_key", "at", "first"))
        again = x["again"].combine_chunks().take(pa.array(row))
        extra = np.asarray(again.value_parent_indices())
        which = np.concatenate([np.arange(len(row)), extra])
        start = np.concatenate([first[row], np.asarray(again.flatten(), np.int64)]) + (at - first)[row[which]]
        columns = doc[row[which]], key[row[which]], start + lo[which], start + hi[which] + SHINGLE, doc[other[which]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = pa.Table.from_batches([batch])
            held = (x if held is None else pa.concat_tables([held, x])).combine_chunks()
            cut = max(last_change(np.asarray(held[c])) for c in ("signature", "i", "j")) if held.num_rows > 1 else 0
            if cut:
                yield from found(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None:
            yield from found(held.combine_chunks())

    cell = ["signature", "i", "j"]
    return contexts.repartition(*cell).sortWithinPartitions(*cell, "doc", "first").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc, text_key, first, end, other): passages that repeat one of a document of a smaller id."""
    marks = cut(_marked(_runs(docs, _frequent(docs))))
    every = F.explode(F.concat(F.array("first"), F.col("again"))).alias("start")
    verbatim = marks.filter(F.col("kind") == VERBATIM).select("doc", "text_key", (F.col("last") - F.col("first")).alias("width"), "other", every)
    verbatim = verbatim.select("doc", "text_key", F.col("start").cast("long").alias("first"), (F.col("start") + F.col("width") + TOKENS + SHINGLE - 1).cast("long").alias("end"), "other")
    return verbatim.unionByName(_verified(_contexts(marks, docs)))


def _word_spans_of(repeats: DataFrame) -> DataFrame:
    return repeats.groupBy("doc", "text_key").agg(F.collect_list(F.struct("first", "end")).alias("repeats"), F.collect_set("other").alias("others"))


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, doc, text_key and n_words of every row, without its text."""
    rows = docs.select("doc_id", *_keyed(docs), "text")

    def run(batches):
        for part, data, offsets in text_slices(batches, "text"):
            words = np.diff(word_spans(data, offsets, NOT_SPACE)[2])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(words, pa.int64())], names=["doc_id", "doc", "text_key", "n_words"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, doc long, text_key long, n_words long")


def _joined_spans(batches):
    """A map that turns `repeats` (the last column) into n_removed and spans."""
    for part in batches:
        removed, spans = [], []
        for found in part.column(part.num_columns - 1):
            start, end = joined(*(np.asarray(c) for c in found.values.flatten())) if found.values is not None and len(found.values) else (np.zeros(0, np.int64),) * 2
            removed.append(int((end - start).sum()))
            spans.append(np.stack([start, end], 1).ravel().tolist())
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=[*part.schema.names[:-1], "n_removed", "spans"])


def _without(columns: list[str], names: tuple[str, str, str]):
    """A map that cuts the spans in the last column out of `text` and gives their counts under `names`."""

    def run(batches):
        for part, data, offsets in text_slices(batches, "text"):
            starts, ends, begin = word_spans(data, offsets, NOT_SPACE)
            raw, lists = data.tobytes(), part.column(len(columns))
            words, at = np.diff(begin), part.schema.get_field_index("text")
            given = part.column(at).is_valid().to_pylist()
            text, removed, spans = [], [], []
            for r in range(part.num_rows):
                a, b, w = int(offsets[r]), int(offsets[r + 1]), int(begin[r])
                found = lists[r].values
                if found is None or not len(found):
                    text.append(raw[a:b] if given[r] else None)
                    removed.append(0)
                    spans.append([])
                    continue
                start, end = joined(*(np.asarray(c) for c in found.flatten()))
                cut_from, cut_to = starts[w + start].tolist(), ends[w + end - 1].tolist()
                text.append(b"".join(raw[i:j] for i, j in zip([a, *cut_to], [*cut_from, b], strict=True)))
                removed.append(int((end - start).sum()))
                spans.append(np.stack([start, end], 1).ravel().tolist())
            made = [pa.array(text, pa.binary()).cast(pa.string()) if k == at else c for k, c in enumerate(part.columns[: len(columns)])]
            yield pa.RecordBatch.from_arrays([*made, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=[*columns, *names])

    return run


def without_repeats(docs: DataFrame, names: tuple[str, str, str] = ("n_words", "n_removed", "spans")) -> DataFrame:
    """The rows with repeated passages cut out of `text`, and under `names` their words, words removed and spans (first and end word of each cut, in turn); an input column of such a name is replaced.

    Rows without repeats, as a Bloom filter of those with them says, are not shuffled.
    """
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    doc, text_key, mark = (one_of([*own, *names, "repeats"], c) for c in ("doc", "text_key", "hash"))
    number, key = _keyed(docs)
    rows = docs.select(*[F.col(f"`{c}`") for c in own], number.alias(doc), key.alias(text_key))
    found = repeated_passages(docs.select("doc_id", "text"))
    spans = cut(_word_spans_of(found).drop("others").withColumnsRenamed({"doc": doc, "text_key": text_key, "repeats": f"{doc}_repeats"}))
    shared = docs.sparkSession.sparkContext.broadcast(bloom_words(spans.select(F.xxhash64(doc, text_key).alias("h"))))
    kinds = dict(docs.dtypes)
    given = ", ".join(f"`{c}` {kinds[c]}" for c in own)

    def picked(wanted: bool):
        def run(batches):
            for batch in batches:
                held = maybe_in(shared.value, np.asarray(batch.column(batch.num_columns - 1)))
                yield batch.take(pa.array(np.flatnonzero(held == wanted))).select(range(batch.num_columns - 1))

        hashed = rows.select(*[F.col(f"`{c}`") for c in rows.columns], F.xxhash64(doc, text_key).alias(mark))
        return hashed.mapInArrow(run, f"{given}, `{doc}` long, `{text_key}` long")

    with_spans = picked(True).join(spans, [doc, text_key], "left").select(*[F.col(f"`{c}`") for c in own], f"{doc}_repeats")
    without = picked(False).select(*[F.col(f"`{c}`") for c in own], F.lit(None).cast("array<struct<first:bigint,end:bigint>>").alias(f"{doc}_repeats"))
    made = f"{given}, `{names[0]}` long, `{names[1]}` long, `{names[2]}` array<long>"
    return with_spans.mapInArrow(_without(own, names), made).unionByName(without.mapInArrow(_without(own, names), made))


def passage_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans, repeats (a passage of it stands in another document too), class_id (least doc_id that shared passages reach, its own included), a row per input row."""
    found = repeated_passages(docs)
    each = cut(_word_spans_of(found))
    roots = components(each.select(F.col("doc").alias("a"), F.explode("others").alias("b")))
    rows = _counted(docs).join(each.select("doc", "text_key", "repeats"), ["doc", "text_key"], "left").select("doc_id", "doc", "n_words", "repeats")
    kind = dict(docs.dtypes)["doc_id"]
    measured = rows.mapInArrow(_joined_spans, f"doc_id {kind}, doc long, n_words long, n_removed long, spans array<long>")
    named = measured.join(roots.withColumnsRenamed({"node": "doc"}), "doc", "left")
    root = F.coalesce("root", "doc")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return named.select("doc_id", "n_words", "n_removed", "spans", F.col("root").isNotNull().alias("repeats"), F.when(root != NO_ID, root).cast(kind).alias("class_id"))
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    placed = named.join(least, "root", "left")
    return placed.select("doc_id", "n_words", "n_removed", "spans", F.col("root").isNotNull().alias("repeats"), F.coalesce("least", "doc_id").alias("class_id"))
