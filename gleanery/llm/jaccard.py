r"""N-gram Jaccard join with signature trees, exact at its threshold.

A document's set holds its distinct shingles of `shingle` words (words are runs
of characters other than the space and \t-\r, ASCII lower-cased; all words as
one shingle where there are fewer).  Documents link when
100 * intersection >= percent * union.  By default 4 words and 85.

1. Equal sets become one node.  Every node lists the shingles that any partner
   must share one of: the first s - ceil(percent * s / 100) + 1 in an order that
   puts the most frequent ones last (a bounded list; any order is exact).
2. Nodes that share such a shingle are compared by size and by the parity
   bitmap of their sets, whose differing bits never exceed the symmetric
   difference.  What passes joins nodes into clusters, a superset of the links.
3. In a cluster, a signature tree holds OR-combined bitmaps and size ranges;
   a dual traversal drops pairs of tree nodes by the most that they can share
   or as already joined, and leaves are compared exactly.

Groups of more than MAX_GROUP nodes are dealt into blocks and connected in steps
(see `components.connections`), and the nodes of a shingle are streamed beyond
HELD_NODES, so no task holds an unbounded group.  Shingles are 64-bit hashes, sets 128-bit digests.  Only the texts of
clustered nodes are shuffled: a Bloom filter of bounded size picks them before.

Null or empty texts, and texts without words, have no set: n_shingles 0 and
component_id their own doc_id.  Repeated rows get a row each.  A null doc_id
counts as no id: components take the least id that is not null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, connections
from .members import bloom_words, maybe_in
from .textcore import LOWER_ASCII, NOT_SPACE, binaries, cut, mix, one_of, shingle_sets, span_hash, text_slices, word_spans

SHINGLE = 4
PERCENT = 85
FREQUENT = 1 << 16
MAX_GROUP = 4_000
HELD_NODES = 1 << 18
LEAF = 32


def sets_of(data: np.ndarray, offsets: np.ndarray, q: int = SHINGLE) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    data = LOWER_ASCII[data]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    return shingle_sets(span_hash(data, starts, ends, seed=3), first, q)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each place, flipped by every shingle there; as many bits as the set has elements, to a power of two from 64 to 8192."""
    bits = min(8192, max(64, 1 << (len(s) - 1).bit_length()))
    flips = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def frequent_shingles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(h, n): at most FREQUENT shingles that slices of the documents repeat most, with counts."""

    def run(batches):
        seen, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, data, offsets in text_slices(batches, "text"):
            sets = sets_of(data, offsets, shingle)
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= 4
            seen, counts = np.concatenate([seen, h[often]]), np.concatenate([counts, n[often]])
            if len(seen) > 4 * FREQUENT:
                seen, counts = _summed(seen, counts)
        seen, counts = _summed(seen, counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(counts)], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)


def _summed(seen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(seen, return_inverse=True)
    n = np.bincount(at, counts, len(h)).astype(np.int64)
    top = np.sort(np.argsort(-n, kind="stable")[:FREQUENT])
    return h[top], n[top]


def profiles(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest, sketch and keys (the prefix) of every row."""
    often = frequent_shingles(docs, shingle).toArrow().combine_chunks().sort_by("h")
    heavy = np.asarray(often["h"], np.int64).view(np.uint64)
    order = np.argsort(heavy)
    shared = docs.sparkSession.sparkContext.broadcast((heavy[order], np.asarray(often["n"], np.int64)[order]))  # at most FREQUENT entries

    def run(batches):
        heavy, counts = shared.value
        for rows, data, offsets in text_slices(batches, "text"):
            sets = sets_of(data, offsets, shingle)
            keys = []
            for s in sets:
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                if len(heavy) and take:
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    weight = np.where(heavy[at] == s, counts[at], 0)
                    keys.append(s[np.argsort(weight, kind="stable")[:take]])
                else:
                    keys.append(s[:take])
            cuts = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(digest, sets)), pa.binary()), binaries(map(parity, sets)), listed], names=["doc_id", "n_shingles", "digest", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest binary, sketch binary, keys array<long>")


def grouped(batches, keys: int):
    """Runs of rows with equal values in the first `keys` columns of batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = np.asarray(batch.column(k))
            new[1:] |= column[1:] != column[:-1]
            if held:
                new[0] |= held[-1].column(k)[-1].as_py() != column[0]
        cuts = np.flatnonzero(new)
        last = 0
        for c in cuts.tolist():
            if c > last:
                held.append(batch.slice(last, c - last))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, last = [], c
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sharing(nodes: DataFrame) -> DataFrame:
    """(grp, node): the nodes that share a key, once for all keys that the same nodes share."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")

    def run(batches):
        last_key, held, streamed = None, np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if streamed:  # a key of very many nodes goes on: its nodes pass as they come
                n = int(np.argmin(key == last_key)) if key[-1] != last_key else len(key)
                yield named(last_key, node[:n])
                key, node = key[n:], node[n:]
                if not len(key):
                    continue
                streamed = False
            if held.size:
                key, node = np.concatenate([np.full(len(held), last_key), key]), np.concatenate([held, node])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last_key, held = key[-1], node[starts[-1] :]
            yield from emit(node, starts, starts[-1])
            if held.size > HELD_NODES:
                yield named(last_key, held)
                held, streamed = held[:0], True
        if held.size:
            yield from emit(held, np.zeros(1, np.int64), len(held))

    def named(key, node):
        """The nodes under a group of the key alone."""
        grp = mix(np.array([key], np.int64).view(np.uint64) ^ np.uint64(0xA5A5)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(grp, len(node))), pa.array(node)], names=["grp", "node"])

    def emit(node, starts, stop):
        ends = np.append(starts[1:], stop)
        n = np.minimum(ends, stop) - starts
        many = np.flatnonzero(n >= 2)
        if not len(many):
            return
        row = np.repeat(starts[many], n[many]) + np.arange(n[many].sum()) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
        members = node[row]
        at = np.cumsum(n[many]) - n[many]
        grp = mix(np.add.reduceat(mix(members.astype(np.uint64)), at) + n[many].astype(np.uint64))
        group = np.repeat(grp.view(np.int64), n[many])
        pairs = np.unique(np.stack([group, members], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["grp", "node"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "grp long, node long").distinct()


class Forest:
    """Union-find over 0 .. n - 1 with each item's root at hand as an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = {i: [i] for i in range(n)}
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, b: int) -> None:
        ra, rb = int(self.root[a]), int(self.root[b])
        if ra == rb:
            return
        if len(self.members[ra]) < len(self.members[rb]):
            ra, rb = rb, ra
        moved = self.members.pop(rb)
        self.root[moved] = ra
        self.members[ra] += moved
        self.edges.append((a, b))


def likely_links(groups: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): enough edges to connect all nodes of a group that size and parity bitmaps allow to link."""
    sketched = nodes.select("node", "n_shingles", "sketch")

    def run(batches):
        left, right = [], []
        for table in grouped(batches, 3):
            node, size, block = np.asarray(table["node"]), np.asarray(table["n_shingles"]), np.asarray(table["block"])
            across = table["i"][0] != table["j"][0]
            raw = table["sketch"].to_pylist()
            forest = Forest(len(node))
            words = np.array([len(x) // 8 for x in raw])
            least = int(words.min())
            folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least), axis=0) for x in raw])
            full = [np.frombuffer(x, np.uint64) for x in raw]
            stop = np.searchsorted(100 * size, percent * size, "left") if len(size) else []
            for i in range(1, len(node)):
                lo = int(stop[i])
                open_ = forest.root[lo:i] != forest.root[i]
                other = np.flatnonzero(open_ & (block[lo:i] != block[i]) if across else open_) + lo
                if not len(other):
                    continue
                apart = np.bitwise_count(folded[other] ^ folded[i]).sum(axis=1, dtype=np.int64)
                for j in other[(100 + percent) * apart <= (100 - percent) * (size[other] + size[i])].tolist():
                    if forest.root[i] != forest.root[j] and _may_link(full[i], full[j], int(size[i] + size[j]), percent):
                        forest.join(i, j)
            left += [int(node[a]) for a, _ in forest.edges]
            right += [int(node[b]) for _, b in forest.edges]
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def compare(celled: DataFrame) -> DataFrame:
        flat = celled.select("cell.k", "cell.i", "cell.j", "block", "node").join(sketched, "node")
        return flat.select("k", "i", "j", "block", "node", "n_shingles", "sketch").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "n_shingles").mapInArrow(run, "a long, b long")

    return connections(groups.select("grp", "node"), "grp", "node", MAX_GROUP, compare)


def _may_link(x: np.ndarray, y: np.ndarray, total: int, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * total


class SignatureTree:
    """Sets in leaves of LEAF, under nodes with OR-combined bitmaps and size ranges.

    A pair shares at most as many elements as bits common to both bitmaps, plus
    the elements of the one with fewer beyond one a bit (its spill).
    """

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, block: np.ndarray | None = None):
        """With `block` (sorted), only items of different blocks are compared."""
        n, self.percent, self.block = len(sets), percent, block
        self.size = np.array([len(s) for s in sets])
        bits = min(1 << 14, max(512, 1 << int(4 * self.size.max() - 1).bit_length()))
        maps = np.zeros((n, bits // 64), np.uint64)
        for i, s in enumerate(sets):
            place = np.unique(mix(s ^ np.uint64(0x5151)) % np.uint64(bits))
            np.bitwise_or.at(maps[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.maps, self.spill = maps, self.size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.ids, self.first = ids, np.concatenate([[0], np.cumsum(self.size)])
        self.universe = int(ids.max()) + 1
        #: Each level: first item, end item, bitmap, least and greatest size, greatest spill; the leaves come first.
        at = np.arange(0, n, LEAF)
        level = [at, np.append(at[1:], n), np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(self.size, at), np.maximum.reduceat(self.size, at), np.maximum.reduceat(self.spill, at)]
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), 8)
            ends = np.append(at[1:], len(level[0])) - 1
            level = [level[0][at], level[1][ends], np.bitwise_or.reduceat(level[2], at, axis=0), np.minimum.reduceat(level[3], at), np.maximum.reduceat(level[4], at), np.maximum.reduceat(level[5], at)]
            self.levels.append(level)

    def possible(self, level: int, a: int, b: int) -> bool:
        _, _, maps, low, high, spill = self.levels[level]
        if 100 * high[a] < self.percent * low[b] or 100 * high[b] < self.percent * low[a]:
            return False
        most = min(int(np.bitwise_count(maps[a] & maps[b]).sum()) + min(spill[a], spill[b]), high[a], high[b])
        return (100 + self.percent) * most >= self.percent * (low[a] + low[b])

    def links(self) -> Forest:
        """A forest that connects exactly the items that links connect."""
        forest = Forest(len(self.size))
        mark = np.zeros(self.universe, bool)
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            first, end = self.levels[level][:2]
            roots = forest.root[first[a] : end[a]]
            if (roots == roots[0]).all() and (forest.root[first[b] : end[b]] == roots[0]).all():
                continue
            if self.block is not None and self.block[first[a]] == self.block[end[b] - 1] == self.block[first[b]] == self.block[end[a] - 1]:
                continue
            if not self.possible(level, a, b):
                continue
            if level == 0:
                self._leaves(int(first[a]), int(end[a]), int(first[b]), int(end[b]), forest, mark)
                continue
            below = len(self.levels[level - 1][0])
            for x in range(8 * a, min(8 * a + 8, below)):
                stack += [(level - 1, x, y) for y in range(max(8 * b, x) if a == b else 8 * b, min(8 * b + 8, below))]
        return forest

    def _leaves(self, a0: int, a1: int, b0: int, b1: int, forest: Forest, mark: np.ndarray) -> None:
        size, percent = self.size, self.percent
        for x in range(a0, a1):
            ys = np.arange(max(b0, x + 1) if a0 == b0 else b0, b1)
            s = size[x]
            if self.block is not None:
                ys = ys[self.block[ys] != self.block[x]]
            ys = ys[(forest.root[ys] != forest.root[x]) & (100 * size[ys] >= percent * s) & (100 * s >= percent * size[ys])]
            if not len(ys):
                continue
            most = np.bitwise_count(self.maps[ys] & self.maps[x]).sum(axis=1, dtype=np.int64) + np.minimum(self.spill[ys], self.spill[x])
            ys = ys[(100 + percent) * most >= percent * (size[ys] + s)]
            if not len(ys):
                continue
            own = self.ids[self.first[x] : self.first[x + 1]]
            mark[own] = True
            for y in ys.tolist():
                if forest.root[x] != forest.root[y]:
                    both = int(np.count_nonzero(mark[self.ids[self.first[y] : self.first[y + 1]]]))
                    if 100 * both >= percent * (s + size[y] - both):
                        forest.join(x, y)
            mark[own] = False


def _digested(docs: DataFrame, words: np.ndarray, shingle: int, name: str) -> DataFrame:
    """The rows whose doc_id the Bloom filter may hold, with the digest of their set under `name`."""
    shared, given = docs.sparkSession.sparkContext.broadcast(words), docs.columns
    mark = one_of([*given, name], "hash")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(mark)
            picked = batch.take(pa.array(np.flatnonzero(maybe_in(shared.value, np.asarray(batch.column(at))))))
            for rows, data, offsets in text_slices([picked], "text"):
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([digest(s) for s in sets_of(data, offsets, shingle)], pa.binary())], names=[*given, name])

    return docs.select(*[F.col(f"`{c}`") for c in given], F.xxhash64("doc_id").alias(mark)).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def exact_links(clusters: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): edges that connect exactly what links connect, from the texts of clustered nodes."""
    wanted = cut(clusters.join(nodes.select("node", "digest", F.col("doc_id").alias("rep")), "node"))
    texts = _digested(docs.select("doc_id", "text"), bloom_words(wanted.select(F.xxhash64("rep").alias("h"))), shingle, "digest")
    one = texts.join(wanted, (texts["digest"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(wanted["rep"])).select("root", "node", "text").dropDuplicates(["node"])

    def run(batches):
        for table in grouped(batches, 3):
            node, sets = np.asarray(table["node"]), []
            for _, data, offsets in text_slices(table.to_batches(), "text"):
                sets += sets_of(data, offsets, shingle)
            block = np.asarray(table["block"])
            across = table["i"][0] != table["j"][0]
            order = np.lexsort([[int(s[0] >> np.uint64(1)) for s in sets], [len(s) for s in sets], *([block] if across else [])])
            forest = SignatureTree([sets[i] for i in order], percent, block[order] if across else None).links()
            node = node[order]
            if forest.edges:
                yield pa.RecordBatch.from_arrays([pa.array([int(node[a]) for a, _ in forest.edges]), pa.array([int(node[b]) for _, b in forest.edges])], names=["a", "b"])

    def compare(celled: DataFrame) -> DataFrame:
        return celled.select("cell.k", "cell.i", "cell.j", "block", "node", "text").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "a long, b long")

    return connections(one, "root", "node", MAX_GROUP, compare, clusters)


def _placed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest, component_id of every row."""
    rows = cut(profiles(docs, shingle, percent))
    filled = rows.filter("n_shingles > 0")
    nodes = cut(filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    clusters = components(likely_links(cut(sharing(nodes)), nodes, percent))
    roots = components(exact_links(clusters, docs, nodes, shingle, percent))
    named = nodes.select("node", "digest", "doc_id").join(roots, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "root").select("digest", "component_id")
    plain = ["doc_id", "n_shingles", "digest"]
    return filled.select(*plain).join(of, "digest").select(*plain, "component_id").unionByName(rows.filter("n_shingles = 0").select(*plain, F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id that links reach, its own included."""
    return _placed(docs, shingle, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The row with the least doc_id of every component, columns as given.

    Rows of equal doc_id and equal set count once.  Rows without an id go if a
    row with one is in their component.  Rows that stay surely (all but the
    repeats and what the Bloom filter takes for one) are not shuffled.
    """
    stays, times, mark = (one_of(docs.columns, c) for c in ("stays", "times", "digest"))
    placed = _placed(docs, shingle, percent).select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("component_id")).alias(stays))
    verdicts = placed.groupBy("doc_id", "digest").agg(F.first(stays).alias(stays), F.count("*").alias(times))
    odd = cut(verdicts.filter(~F.col(stays) | (F.col(times) > 1)).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), stays))
    words = bloom_words(odd.select(F.xxhash64("_id").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def surely(batches):
        for batch in batches:
            yield batch.take(pa.array(np.flatnonzero(~maybe_in(shared.value, np.asarray(batch.column(batch.num_columns - 1)))))).select(docs_columns)

    docs_columns = docs.columns
    own = [F.col(f"`{c}`") for c in docs_columns]
    plain = docs.select(*own, F.xxhash64("doc_id").alias(mark)).mapInArrow(surely, docs.schema)
    rest = _digested(docs, words, shingle, mark)
    odd = odd.select(F.col("_id").alias(f"_{mark}_id"), F.col("_digest").alias(f"_{mark}_of"), stays)
    judged = rest.join(odd, rest["doc_id"].eqNullSafe(odd[f"_{mark}_id"]) & (rest[mark] == odd[f"_{mark}_of"]), "left")
    once = judged.filter(F.col(stays)).groupBy(f"_{mark}_id", f"_{mark}_of").agg(F.min_by(F.struct(*own), F.coalesce("text", F.lit(""))).alias("row"))
    back = once.select(*[F.col("row")[c].alias(c) for c in docs_columns])
    return plain.unionByName(judged.filter(F.col(stays).isNull()).select(*own)).unionByName(back)
