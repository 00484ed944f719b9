"""Removal of bytes that 200-byte repeats cover, by suffixes at content-defined anchors.

Texts are UTF-8 bytes and matches stay within a document.  Equal windows meet
at anchors of equal gram (see `anchors`), so only the suffixes at anchors are
ordered:

1. One shuffle deals the anchors by gram.  An anchor whose gram is alone has no
   repeat; anchors whose whole context (all bytes of their windows) is equal
   repeat in every window.
2. What is left, about one anchor in thirty, are contexts that agree in part.
   Their bytes are fetched, and each gram's texts to the right of the anchor,
   and to the left read backwards, are put in order by deep-shallow sorting.
   From the common prefixes of neighbours follow, for every pair, the windows
   that both hold; grams of more than MAX_GROUP contexts are dealt over pairs
   of blocks.
3. The covered spans of each text are joined and cut out.  A Bloom filter of
   bounded size picks the texts that have any; the others are not shuffled.

Equal texts have equal results, so texts are known by a 64-bit hash and their
length, and a task sends each different text once.  A text of LENGTH bytes or
more that occurs again is one span, with no further work.  Grams and contexts
are compared by 64-bit hashes in step 1 and byte by byte in step 2.  Null text:
as the empty text, nothing to remove.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, LENGTH, anchors
from .components import cells
from .deepshallow import deep_shallow
from .hot import MOST, content_hash, frequent, is_in, portions, salts
from .jaccard import grouped
from .members import bloom_words, maybe_in
from .spans import joined, once_a_row
from .textcore import cut, one_of, text_slices

MAX_GROUP = 20_000
EACH_AGAINST_ALL = 100
HELD_ROWS = 1 << 20
OFTEN = 64
REPEAT, PARTIAL, SAMPLE = 0, 1, 2
_ANCHOR = ["gram", "context", "text_key", "n_bytes", "at", "first", "last", "again", "salt"]
_MARK = "gram long, text_key long, n_bytes long, at int, first int, last int, again array<int>, kind int"


_KEYS = ["text_key", "n_bytes"]


def _keyed() -> list[Column]:
    """The hash and length that a text is known by."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes")]


def _once(seen: set, keys: np.ndarray) -> np.ndarray:
    """The rows whose key was not seen before in this task."""
    rows = []
    for r, key in enumerate(keys.tolist()):
        if key not in seen:
            seen.add(key)
            rows.append(r)
    return np.array(rows, np.int64)


def _frequent(docs: DataFrame) -> np.ndarray:
    """The hashes of very frequent contexts."""

    def run(batches):
        for _, data, offsets in text_slices(batches, "text"):
            *_, gram, context = anchors(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(content_hash(gram, context))], names=["h"])

    return frequent(docs.select("text"), lambda some: some.mapInArrow(run, "h long"))


def _anchor_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """A row per text and context; `again` holds the first window starts of its further occurrences in the text.

    Of a very frequent context a task sends one row a slice the general way
    (salt 0), twice if the slice has more of it; the others surely repeat, and
    have a salt that deals them over parts of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        seen: set[int] = set()
        sent: dict[int, int] = {}
        for batch in batches:
            fresh = batch.take(pa.array(_once(seen, np.asarray(batch.column(1)))))
            for part, data, offsets in text_slices([fresh], "text"):
                row, at, first, last, gram, context = anchors(data, offsets)
                keep, cuts, others = once_a_row(row, [gram, context], first)
                again = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(others, pa.int32()))
                row, at, first, last, gram, context = (x[keep] for x in (row, at, first, last, gram, context))
                key, size = (np.asarray(part.column(c))[row] for c in (1, 2))
                h = content_hash(gram, context)
                often = np.flatnonzero(is_in(shared.value, h))
                salt, twice = np.zeros(len(h), np.int32), []
                if len(often):
                    salt[often] = salts(key[often])
                    names, heads, n = np.unique(h[often], return_index=True, return_counts=True)
                    for name, head, times in zip(names.tolist(), often[heads].tolist(), n.tolist(), strict=True):
                        if sent.get(name, 0) < 2:
                            salt[head] = 0
                            twice += [head] * (times > 1)
                            sent[name] = sent.get(name, 0) + 1 + (times > 1)
                rows = pa.RecordBatch.from_arrays([*(pa.array(x) for x in (gram.view(np.int64), context.view(np.int64), key, size, at.astype(np.int32), first.astype(np.int32), last.astype(np.int32))), again, pa.array(salt)], names=_ANCHOR)
                yield rows
                if twice:
                    yield rows.take(pa.array(twice))

    rows = docs.filter(F.octet_length("text") >= LENGTH).select("text", *_keyed())
    return rows.mapInArrow(run, "gram long, context long, text_key long, n_bytes long, at int, first int, last int, again array<int>, salt int")


def _marked(rows: DataFrame) -> DataFrame:
    """Anchors that repeat: wholly (REPEAT), perhaps in part (PARTIAL), and one of each whole repeat to compare those with (SAMPLE)."""

    def classify(x: pa.Table, forced: bool):
        gram, context, settled = (np.asarray(x[c]) for c in ("gram", "context", "salt"))
        times = 1 + np.asarray(pc.list_value_length(x["again"]))
        group_new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (settled[1:] != settled[:-1])])
        new = group_new | np.concatenate([[True], context[1:] != context[:-1]])
        run, group = np.cumsum(new) - 1, np.cumsum(group_new) - 1
        plain = settled == 0
        whole = (np.bincount(run, times) >= 2)[run] | ~plain
        several = (np.bincount(group, new) >= 2)[group] | forced
        partial = ~whole & several
        mixed = (np.bincount(group, partial) > 0)[group] | forced
        sample = whole & new & mixed & plain
        places = [np.flatnonzero(m) for m in (whole, partial, sample)]
        kind = np.repeat([REPEAT, PARTIAL, SAMPLE], [len(m) for m in places]).astype(np.int32)
        marks = x.drop_columns(["context", "salt"]).take(pa.array(np.concatenate(places))).append_column("kind", pa.array(kind))
        yield from marks.combine_chunks().to_batches()

    most = HELD_ROWS

    def run(batches):
        for rows, part in portions(batches, ["gram", "salt"], "context", most):
            yield from classify(rows, part)

    return rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "context").mapInArrow(run, _MARK)


def _picked_texts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """text, text_key and n_bytes of the texts that the Bloom filter may hold, each once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            picked = batch.take(pa.array(np.flatnonzero(maybe_in(shared.value, np.asarray(batch.column(1))))))
            yield picked.take(pa.array(_once(seen, np.asarray(picked.column(1)))))

    return docs.select("text", *_keyed()).mapInArrow(run, "text string, text_key long, n_bytes long")


def _contexts(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """The marks with the bytes of their windows."""
    dealt = cells(marks, "gram", "context_id", MAX_GROUP)
    each = cut(dealt.groupBy(*_KEYS).agg(F.collect_set(F.struct("cell.k", "cell.i", "cell.j", "at", "first", "last", "kind")).alias("marks")))
    rows = _picked_texts(docs, bloom_words(each.select("text_key"))).join(each, _KEYS)
    where = {c: rows.columns.index(c) for c in ("text_key", "n_bytes", "marks")}

    def run(batches):
        for part, data, offsets in text_slices(batches, "text"):
            lists = part.column(where["marks"])
            parent = np.asarray(lists.value_parent_indices())
            k, i, j, at, first, last, kind = (np.asarray(c) for c in lists.flatten().flatten())
            start, end = offsets[parent] + first, offsets[parent] + last + LENGTH
            raw = data.tobytes()
            cut = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            key, size = (np.asarray(part.column(where[c]))[parent] for c in ("text_key", "n_bytes"))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (k, i, j, key, size, at, first, last, kind)), pa.array(cut, pa.binary())], names=["k", "i", "j", "text_key", "n_bytes", "at", "first", "last", "kind", "bytes"])

    found = rows.mapInArrow(run, "k long, i long, j long, text_key long, n_bytes long, at int, first int, last int, kind int, bytes binary")
    return found.dropDuplicates(["k", "i", "j", "text_key", "n_bytes", "at"])


def shared_windows(left: list[bytes], right: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    """For each wanted text, how far left of the anchor its repeated windows start.

    left: the bytes before each anchor, backwards; right: those from it on.  A
    pair that shares b bytes backwards and f forwards holds alike the windows
    that start LENGTH - f to b bytes before the anchor.
    """
    n, most = len(right), LENGTH - GRAM + 1
    shares = []
    for texts, start in ((left, 0), (right, GRAM)):
        order, common = deep_shallow(texts, start)
        order, common = np.array(order), np.array(common)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        shares.append((order, common, place))
    if n > EACH_AGAINST_ALL:
        return _by_classes(shares, wanted, most)
    out = []
    for x in wanted.tolist():
        reach = []
        for order, common, place in shares:
            r, share = place[x], np.empty(n, np.int64)
            share[order[r + 1 :]] = np.minimum.accumulate(common[r + 1 :])
            share[order[:r]] = np.minimum.accumulate(common[1 : r + 1][::-1])[::-1]
            share[x] = -1
            reach.append(share)
        back, low = np.minimum(reach[0], most - 1), np.maximum(LENGTH - reach[1], 0)
        ok = (low <= back) & (reach[1] >= 0)
        depth = np.bincount(low[ok], minlength=most + 1) - np.bincount(back[ok] + 1, minlength=most + 1)
        out.append(np.flatnonzero(np.cumsum(depth) > 0))
    return out


def _by_classes(shares: list[tuple], wanted: np.ndarray, most: int) -> list[np.ndarray]:
    """The same for many texts: by distance d, texts that agree on d bytes backwards and on LENGTH - d forwards are neighbours in both orders."""
    repeats = np.zeros((len(wanted), most), bool)
    for d in range(most):
        names = []
        for (_, common, place), depth in zip(shares, (d, LENGTH - d), strict=True):
            names.append((np.cumsum(common < depth) - 1)[place])
        both = names[0] * len(names[0]) + names[1]
        _, which, times = np.unique(both, return_inverse=True, return_counts=True)
        repeats[:, d] = times[which][wanted] > 1
    return [np.flatnonzero(r) for r in repeats]


def _partial_repeats(contexts: DataFrame) -> DataFrame:
    """(text_key, n_bytes, first, last) of the repeated windows of partial contexts."""

    def run(batches):
        held: list[list] = [[], [], [], []]
        for table in grouped(batches, 3):
            kind = np.asarray(table["kind"])
            wanted = np.flatnonzero(kind == PARTIAL)
            if len(kind) < 2 or not len(wanted):
                continue
            key, size, at, first = (np.asarray(table[c]) for c in ("text_key", "n_bytes", "at", "first"))
            raw, back = table["bytes"].to_pylist(), (at - first).tolist()
            found = shared_windows([r[:b][::-1] for r, b in zip(raw, back, strict=True)], [r[b:] for r, b in zip(raw, back, strict=True)], wanted)
            for x, before in zip(wanted.tolist(), found, strict=True):
                if len(before):
                    a, b = joined(before, before + 1)
                    for low, high in zip(a.tolist(), b.tolist(), strict=True):
                        for c, v in zip(held, (key[x], size[x], at[x] - high + 1, at[x] - low), strict=True):
                            c.append(int(v))
            if len(held[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["text_key", "n_bytes", "first", "last"])
                held = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["text_key", "n_bytes", "first", "last"])

    return contexts.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "text_key long, n_bytes long, first long, last long")


def _copies(docs: DataFrame) -> DataFrame:
    """text_key, n_bytes and n of the texts of LENGTH bytes or more that occur again."""
    return docs.filter(F.octet_length("text") >= LENGTH).select(*_keyed()).groupBy(*_KEYS).agg(F.count("*").alias("n")).filter("n > 1")


def _often_copied(copies: DataFrame) -> np.ndarray:
    """The sorted hashes of (text_key, n_bytes) of the texts that a 2^-16 share of all copies, or more, are of: 2^16 at most."""
    total = copies.agg(F.sum("n").alias("total"))
    often = copies.crossJoin(F.broadcast(total)).filter((F.col("n") >= OFTEN) & (F.col("n") * MOST >= F.col("total")))  # one row
    found = often.select(*_KEYS).toArrow()
    return np.sort(content_hash(*(np.asarray(found[c], np.int64) for c in _KEYS)))


def _spans(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """text_key, n_bytes and repeats (first and last start of repeated windows) of every text that has any."""
    whole_text = copies.select(*_KEYS, F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - LENGTH).alias("last"))
    marks = cut(_marked(_anchor_rows(docs, _frequent(docs))))
    every = F.explode(F.concat(F.array("first"), F.col("again"))).alias("start")
    whole = marks.filter(F.col("kind") == REPEAT).select(*_KEYS, (F.col("last") - F.col("first")).alias("width"), every).select(*_KEYS, F.col("start").cast("long").alias("first"), (F.col("start") + F.col("width")).cast("long").alias("last"))
    partial = _partial_repeats(_contexts(marks.filter(F.col("kind") != REPEAT).withColumn("context_id", F.xxhash64(*_KEYS, "at")), docs))
    return cut(whole_text.unionByName(whole).unionByName(partial).groupBy(*_KEYS).agg(F.collect_set(F.struct("first", "last")).alias("repeats")))


_MADE = ["n_bytes", "n_removed", "n_spans", "removed", "kept"]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Adds to every row: n_bytes, n_removed, n_spans, removed (first and end byte of each span, in turn) and kept (the remaining bytes).

    Input columns stay, but for ones of these names.  Rows of a text that is
    copied very often lose all their bytes where they are; other texts with
    repeats are joined with their spans.
    """
    columns = [c for c in docs.columns if c.lower() not in _MADE]
    kinds = dict(docs.dtypes)
    key, size, found = (one_of([*columns, *_MADE], c) for c in ("text_key", "text_bytes", "repeats"))
    own = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    copies = cut(_copies(docs.select("text")))
    spans = _spans(docs.select("text"), copies).withColumnsRenamed({"text_key": key, "n_bytes": size, "repeats": found})
    shared = docs.sparkSession.sparkContext.broadcast((bloom_words(spans.select(key)), _often_copied(copies)))
    named = [F.col(f"`{c}`") for c in columns]
    rows = docs.select(*named, *[c.alias(n) for c, n in zip(_keyed(), (key, size), strict=True)])

    def picked(kind: int):
        """0: rows without repeats, 1: that may have spans, 2: of texts that are copied very often."""

        def run(batches):
            for batch in batches:
                keys, sizes = (np.asarray(batch.column(batch.num_columns - k), np.int64) for k in (2, 1))
                which = np.where(is_in(shared.value[1], content_hash(keys, sizes)), 2, maybe_in(shared.value[0], keys).astype(int))
                yield batch.take(pa.array(np.flatnonzero(which == kind)))

        return rows.mapInArrow(run, f"{own}, `{key}` long, `{size}` long")

    def run(batches):
        for part, data, offsets in text_slices(batches, "text"):
            raw = data[: offsets[-1]].tobytes()
            kept, removed, n, spans = [], [], [], []
            lists = part.column(len(columns))
            for r in range(part.num_rows):
                a, b = int(offsets[r]), int(offsets[r + 1])
                found = lists[r].values
                if found is None or not len(found):
                    kept.append(raw[a:b])
                    removed.append([])
                    n.append(0)
                    spans.append(0)
                    continue
                start, end = joined(*(lambda f, t: (f, t + LENGTH))(*(np.asarray(c) for c in found.flatten())))
                kept.append(b"".join(raw[a + s : a + e] for s, e in zip([0, *end.tolist()], [*start.tolist(), b - a], strict=True)))
                removed.append(np.stack([start, end], 1).ravel().tolist())
                n.append(int((end - start).sum()))
                spans.append(len(start))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(removed, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=[*columns, *_MADE])

    joined_rows = picked(1).join(spans, [key, size], "left").select(*named, found)
    cut_rows = joined_rows.mapInArrow(run, f"{own}, n_bytes long, n_removed long, n_spans long, removed array<long>, kept binary")
    zero, all_bytes = F.lit(0).cast("long"), F.col(f"`{size}`")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = picked(0).select(*named, all_bytes.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.array().cast("array<bigint>").alias("removed"), text.alias("kept"))
    gone = picked(2).select(*named, all_bytes.alias("n_bytes"), all_bytes.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.array(zero, all_bytes).alias("removed"), F.lit("").cast("binary").alias("kept"))
    return cut_rows.unionByName(whole).unionByName(gone)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
