"""Joins and duplicate detection against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hot, jaccard, passages, suffixdedup
from gleanery.llm.components import components, connections
from gleanery.llm.deepshallow import deep_shallow

WORDS = [f"{a}{b}" for a in ("in", "the", "on", "er", "at", "re") for b in ("ta", "so", "mi", "ne", "lu", "ka")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base, passage = text(rng, 120).split(), text(rng, 60)
    rows = [(k, text(rng, rng.randint(0, 150))) for k in range(60)]
    for k in range(60, 110):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        rows.append((k, " ".join(near)))
    rows += [(k, f"{text(rng, rng.randint(0, 40))} {passage} {text(rng, rng.randint(0, 40))}") for k in range(110, 130)]
    rows += [(130, rows[3][1]), (131, rows[3][1].upper()), (132, None), (133, ""), (134, "   "), (135, "one"), (136, "ONE"), (137, "one two"), (139, "Zz " * 300), (140, "zz " * 299), (141, "é" * 400)]
    return rows


def sets(rows, q=4):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + q]) for k in range(len(w) - q + 1)} if len(w) >= q else {tuple(w)} if w else set()
    return out


def brute_components(rows, q=4, percent=85):
    s = sets(rows, q)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("most, q, percent", [(4000, 4, 85), (7, 4, 85), (4000, 5, 80)])
def test_jaccard_components_against_brute_force(spark, most, q, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_GROUP", most)
    monkeypatch.setattr(jaccard, "HELD_NODES", 1 << 18 if most > 7 else 5)
    rows = [*corpus(), (150, "very long " * 60_000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, KEYS int")
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(frame, q, percent).collect()}
    assert got == brute_components(rows, q, percent)


def test_one_of_each_keeps_what_no_link_reaches(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, i, i, i) for i, t in rows], "doc_id long, text string, Stays int, DIGEST int, hash int")
    kept = jaccard.one_of_each(frame, 5, 80)
    assert kept.columns == frame.columns
    component = brute_components(rows, 5, 80)
    assert sorted(tuple(r) for r in kept.collect()) == sorted((i, t, i, i, i) for i, t in rows if component[i][1] == i)
    text = spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")
    assert jaccard.one_of_each(text, 5, 80).count() == kept.count()


def test_bloom_words_lose_nothing(spark):
    from gleanery.llm import members

    for n in (0, 1, 3000):
        words = members.bloom_words(spark.range(n).selectExpr("xxhash64(id) AS h"))
        asked = spark.range(2 * n + 2000).selectExpr("xxhash64(id) AS h").toArrow()["h"].to_numpy()
        found = members.maybe_in(words, asked)
        assert found[:n].all() and found[n:].sum() < 0.1 * len(asked)


def test_one_of_each_and_edges(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, "x y z w"), (3, "x y z w"), (None, "q r s t u"), (None, "x y z w"), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard.jaccard_components(frame).count() == len(rows)
    kept = sorted((str(r.doc_id), r.text) for r in jaccard.one_of_each(frame).collect())
    assert kept == [("1", "a b c d e f"), ("3", "x y z w"), ("4", None), ("5", ""), ("None", "q r s t u")]
    other = spark.createDataFrame([(7, "one text of its own words"), (7, "and quite some other words"), (7, "and quite some other words")], "doc_id long, text string")
    assert jaccard.one_of_each(other).count() == 2 and jaccard.one_of_each(frame.limit(0)).count() == 0
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_signature_tree_prunes_nothing_that_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    items = []
    for _ in range(150):
        s = base.copy()
        at = rng.choice(200, rng.integers(0, 60), replace=False)
        s[at] = rng.integers(0, 1 << 62, len(at)).astype(np.uint64)
        items.append(np.unique(s))
    forest = jaccard.SignatureTree(items).links()
    root = list(range(150))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(items[i], items[j]))
            if 100 * both >= 85 * (len(items[i]) + len(items[j]) - both):
                root[find(i)] = find(j)
    same = lambda f: {frozenset(i for i in range(150) if f(i) == r) for r in {f(i) for i in range(150)}}
    assert same(find) == same(lambda i: int(forest.root[i]))


@pytest.mark.parametrize("hub", [2000, 3])
def test_components_of_a_long_path_and_a_star(spark, hub, monkeypatch):
    monkeypatch.setattr("gleanery.operators.components.HUB", hub)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)] + [(k, 300) for k in range(200, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys([*range(200, 240), 300], 200)}


def test_deep_shallow_orders_suffixes():
    rng = random.Random(4)
    for _ in range(60):
        whole = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 120))) * rng.randint(1, 3)
        texts = [whole[k:] for k in range(len(whole))] + [b"", whole]
        order, common = deep_shallow(texts)
        assert [texts[i] for i in order] == sorted(texts)
        for (x, y), n in zip(zip(order, order[1:]), common[1:], strict=False):
            a, b = texts[x], texts[y]
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_removed(rows):
    raw = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(b[p : p + 200] for b in raw.values() for p in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                cover[p : p + 200] = True
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[i] = (len(b), int(cover.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], cover.view(np.int8)])) == 1)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [4000, 3])
def test_suffix_dedup_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(suffixdedup, "MAX_GROUP", most)
    monkeypatch.setattr(suffixdedup, "EACH_AGAINST_ALL", 100 if most > 3 else 1)
    monkeypatch.setattr(suffixdedup, "HELD_ROWS", 1 << 20 if most > 3 else 5)
    rows = corpus(2)
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, Kept int")
    got = {r[0]: tuple(r[1:]) for r in suffixdedup.repeat_digests(frame).collect()}
    assert got == brute_removed(rows)
    assert suffixdedup.repeat_digests(frame.limit(0)).count() == 0


def tokens_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def test_compact_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    at, first, last = passages.compact_windows(h, 20)
    keys = (passages.mix(h ^ passages._SEEDS[0]) >> np.uint64(32)).tolist()
    nodes = set()
    for c in range(300):
        left, right = c, c
        while left and (keys[left - 1], left - 1) > (keys[c], c):
            left -= 1
        while right < 299 and (keys[right + 1], right + 1) > (keys[c], c):
            right += 1
        if right - left + 1 >= 20:
            nodes.add((c, max(left, c - 19), min(c, right - 19)))
    assert {(int(a), int(b), int(c)) for a, b, c in zip(at, first, last)} == nodes


def test_passages_that_repeat_are_cut_once(spark):
    rows = corpus(3)
    frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, Doc int")
    got = {r.doc_id: r for r in passages.passage_classes(frame).collect()}
    first = {}
    for i, t in sorted(rows):
        w = tokens_of(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    need = found = 0
    for i, t in rows:
        w, cover = tokens_of(t), set()
        for a, b in zip(got[i].spans[::2], got[i].spans[1::2]):
            cover |= set(range(a, b))
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                need += 50
                found += len(cover & set(range(p, p + 50)))
        assert got[i].n_words == len(w)
    assert found >= 0.98 * need > 0
    assert len({got[i].class_id for i in range(110, 130)}) == 1 and all(got[i].n_removed >= 50 for i in range(111, 130))
    assert all(got[i].n_removed == 0 and not got[i].repeats for i in range(60) if i != 3)
    assert got[132].n_words == 0 and not got[132].repeats
    cut = {r.doc_id: r for r in passages.without_repeats(frame).collect()}
    assert cut[5].text == dict(rows)[5] and len(tokens_of(cut[125].text)) == got[125].n_words - got[125].n_removed
    assert passages.passage_classes(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4000, 9])
def test_passages_around_a_frequent_line_are_all_compared(spark, most, monkeypatch):
    """Pairs share 51 words around one line that all documents hold, and one document repeats it in many contexts."""
    monkeypatch.setattr(passages, "MAX_GROUP", most)
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, rows, near = words(36), [], set()
    for k in range(60):
        left, right = words(7), words(8)
        for half in range(2):
            middle = left + line + right
            if half and k % 4 == 0:
                middle[-1:] = words(1)
                near.add(k)
            rows.append((k + 1000 * half, " ".join(words(40) + middle + words(40))))
    rows.append((500, " ".join(w for _ in range(40) for w in words(30) + line)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.passage_classes(frame).collect()}
    for k in range(60):
        assert got[k].n_removed == 0 and got[k].class_id == got[k + 1000].class_id == k
        spans = got[k + 1000].spans
        assert spans[0] <= 40 and spans[1] >= 40 + (50 if k in near else 51)
    assert got[500].n_removed == 0 and not got[500].repeats


def test_near_passages_recall(spark):
    """Passages of 150 words with a few words changed: pairs of 0.8 or more are found."""
    rng = random.Random(9)
    rows, pairs = [], 0
    vocabulary = [f"v{k}" for k in range(3000)]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(150)]
        near = list(base)
        for at in rng.sample(range(150), 2):
            near[at] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        pairs += 1
    got = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(60)) >= 0.9 * pairs


@pytest.mark.parametrize("n", [50, 55, 60])
def test_short_near_passages_recall(spark, n):
    """Passages of 50 to 60 words in other contexts, at a similarity of 0.80 to 0.85: nearly all pairs are found."""
    rng = random.Random(n)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(400):
        base = words(n)
        near = list(base)
        near[rng.randrange(n // 2 - 4, n // 2 + 4)] = "changed"
        rows += [(2 * k, " ".join(words(30) + base + words(30))), (2 * k + 1, " ".join(words(30) + near + words(30)))]
    got = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(400)) >= 0.97 * 400


def test_every_place_of_a_repeat_is_cut(spark):
    """A passage that stands several times in one document and once in an earlier one: each of its places goes, and nothing else."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, gaps = words(130), [words(90), words(70), words(60)]
    later = gaps[0] + passage + gaps[1] + passage + gaps[2]
    rows = [(1, " ".join(words(40) + passage + words(40))), (2, " ".join(later)), (3, "very long " + " ".join(words(150_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.passage_classes(frame).collect()}
    assert got[2].spans == [90, 220, 290, 420] and got[2].n_removed == 260 and got[1].n_removed == got[3].n_removed == 0
    cut = {r.doc_id: r.text.split() for r in passages.without_repeats(frame).collect()}
    assert cut[2] == gaps[0] + gaps[1] + gaps[2] and cut[1] == rows[0][1].split()


def test_all_short_verbatim_repeats_are_found(spark):
    """Pairs that share exactly 50 words, in groups of documents around a common core; ids may be strings."""
    rng = random.Random(22)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(6):
        core = words(35)
        for k in range(30):
            shared = words(7) + core + words(8)
            rows += [(2 * (30 * g + k) + half, " ".join(words(25) + shared + words(25))) for half in range(2)]
    got = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k].class_id == got[2 * k + 1].class_id == 2 * k and got[2 * k + 1].spans == [25, 75] and not got[2 * k].n_removed for k in range(180))
    named = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame([(f"d{i:03}", t) for i, t in rows], "doc_id string, text string")).collect()}
    assert all(named[f"d{2 * k:03}"].class_id == named[f"d{2 * k + 1:03}"].class_id == f"d{2 * k:03}" for k in range(180))
    assert sum(r.n_removed for r in named.values()) == 180 * 50


def brute_similar(texts):
    """Pairs of texts with windows of 50 words whose sets of five-word shingles have a similarity of 0.8 or more."""
    windows = {}
    for i, t in texts:
        w = tokens_of(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        windows[i] = [frozenset(grams[k : k + 46]) for k in range(len(grams) - 45)]
    found = set()
    for a in windows:
        for b in windows:
            if a < b and any(5 * len(x & y) >= 4 * len(x | y) for x in windows[a] for y in windows[b]):
                found.add((a, b))
    return found


def test_classes_against_brute_force(spark):
    """Short texts of few words, with repeated tokens: nearly all similar pairs share a class, and classes join nothing else."""
    rng = random.Random(23)
    base = [rng.choice(WORDS) for _ in range(70)]
    rows = []
    for k in range(60):
        w = list(base) if k < 40 else [rng.choice(WORDS) for _ in range(70)]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [rng.choice(WORDS)] * 2])
        rows.append((k, " ".join(w)))
    rows += [(60 + k, " ".join(["to"] * (30 + 5 * k) + ["of"] * 30)) for k in range(6)]
    similar = brute_similar(rows)
    got = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = {i: i for i, _ in rows}
    for a, b in sorted(similar):
        x, y = min(root[a], root[b]), max(root[a], root[b])
        root = {i: x if r == y else r for i, r in root.items()}
    assert all(root[i] == root[got[i]] for i in root)
    linked = sum(got[a] == got[b] for a, b in similar)
    assert len(similar) > 300 and linked >= 0.97 * len(similar)


def test_many_contexts_by_classes_equal_each_against_all(monkeypatch):
    rng = random.Random(31)
    gram = bytes(rng.choice(b"abcd") for _ in range(suffixdedup.GRAM))
    tails = [bytes(rng.choice(b"ab") for _ in range(136)) for _ in range(4)]
    mixed = lambda: (lambda t, k: t[:k] + bytes(rng.choice(b"ab") for _ in range(136 - k)))(rng.choice(tails), rng.randrange(137))
    left, right = [mixed() for _ in range(60)], [gram + mixed() for _ in range(60)]
    wanted = np.arange(0, 60, 2)
    plain = [x.tolist() for x in suffixdedup.shared_windows(left, right, wanted)]
    monkeypatch.setattr(suffixdedup, "EACH_AGAINST_ALL", 1)
    assert [x.tolist() for x in suffixdedup.shared_windows(left, right, wanted)] == plain and any(plain)


def test_thousands_of_copies(spark):
    """Copies of one text are whole repeats, and the text that shares a part with them loses that part."""
    rng = random.Random(32)
    page, tail = text(rng, 120), text(rng, 60)
    rows = [(i, page) for i in range(3000)] + [(5000, page[:300] + tail), (5001, tail[:150]), (5002, None), (5003, page.upper() * 400)]
    got = {r.doc_id: r for r in suffixdedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert all(got[i].n_removed == len(page) and got[i].n_spans == 1 for i in range(3000))
    assert 300 <= got[5000].n_removed < 330 and got[5001].n_removed == 0 and got[5003].n_removed == 400 * len(page)


@pytest.mark.parametrize("linked", [False, True])
def test_connections_compare_no_pair_twice(spark, linked):
    """All pairs, and not over 1.1 times as many, where nothing links; far fewer where all do."""
    n, most, seen = 900, 90, []

    def compare(celled):
        rows = [(r.k, r.i, r.j, r.block, r.node) for r in celled.select("cell.k", "cell.i", "cell.j", "block", "node").collect()]
        by = collections.defaultdict(list)
        for k, i, j, block, node in rows:
            by[(k, i, j)].append((block, node))
        edges = []
        for (_, i, j), members in by.items():
            for a, (block, x) in enumerate(members):
                for other, y in members[a + 1 :]:
                    if i == j or block != other:
                        seen.append((min(x, y), max(x, y)))
                        if linked or {x, y} <= {1, 5, 800}:
                            edges.append((max(x, y), min(x, y)))
        return spark.createDataFrame(edges, "a long, b long")

    items = spark.range(n).selectExpr("7 AS grp", "id AS node")
    edges = connections(items, "grp", "node", most, compare)
    roots = {r.node: r.root for r in components(edges).collect()}
    every = n * (n - 1) // 2
    if linked:
        assert len(seen) < every / 4 and set(roots.values()) == {0} and len(roots) == n
    else:
        assert len(set(seen)) == every and len(seen) <= 1.1 * every and roots == {1: 1, 5: 1, 800: 1}


def frequent_rows():
    """A passage in most documents, copies, one document id of several texts, no id at all."""
    rng = random.Random(12)
    passage, other = text(rng, 90), text(rng, 70)
    rows = [(i, f"{text(rng, rng.randint(0, 30))} {passage} {text(rng, rng.randint(0, 30))}") for i in range(90, 0, -1)]
    rows += [(200 + i, f"{other} {text(rng, 20)} {other}") for i in range(20)] + [(300 + i, rows[0][1]) for i in range(15)]
    rows += [(5, f"{text(rng, 12)} {passage}"), (5, f"{passage} {text(rng, 12)}"), (None, f"{passage} zz"), (None, f"yy {passage}"), (400, text(rng, 200)), (401, None)]
    return rows


@pytest.mark.parametrize("held", [1 << 20, 4])
def test_very_frequent_contents_are_settled_by_tasks(spark, held, monkeypatch):
    rows = frequent_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = sorted(map(str, passages.passage_classes(frame).collect()))
    monkeypatch.setattr(hot, "ONE_IN", 1)
    monkeypatch.setattr(hot, "LEAST_SAMPLED", 4)
    monkeypatch.setattr(suffixdedup, "OFTEN", 2)
    for module in (passages, suffixdedup):
        monkeypatch.setattr(module, "HELD_ROWS", held)
    assert len(passages._frequent(frame)) > 10 and len(suffixdedup._frequent(frame)) > 1
    assert sorted(map(str, passages.passage_classes(frame).collect())) == plain
    got = suffixdedup.repeat_digests(frame.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))).collect()
    want = brute_removed(list(enumerate(t for _, t in rows)))
    assert sorted(tuple(r) for r in got) == sorted((-1 if i is None else i, *want[k]) for k, (i, _) in enumerate(rows))


def test_portions_copy_rows_a_fixed_number_of_times():
    import time

    import pyarrow as pa

    def run(n):
        batches = (pa.RecordBatch.from_pydict({"g": np.zeros(1000, np.int64), "c": np.full(1000, 7), "v": np.arange(k, k + 1000)}) for k in range(0, n, 1000))
        start, rows = time.perf_counter(), 0
        for table, part in hot.portions(batches, ["g"], "c", 1 << 16):
            rows += table.num_rows
            assert table.num_rows <= (1 << 16) + 1001 and (part or rows == n)
        assert n <= rows <= n + n // (1 << 15)
        return time.perf_counter() - start

    run(200_000)
    assert run(2_000_000) < 6 * run(500_000) + 0.5


def test_suffix_dedup_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "ab " * 200, 5, 6, 7), (2, "x" + "ab " * 200, 5, 6, 7)], "doc_id long, text string, text_key int, repeats int, N_Spans int")
    out = suffixdedup.remove_repeats(rows)
    assert out.columns == ["doc_id", "text", "text_key", "repeats", "n_bytes", "n_removed", "n_spans", "removed", "kept"]
    assert {(r.text_key, r.repeats, r.n_spans) for r in out.collect()} == {(5, 6, 1)}


def test_runs_without_support_are_dropped_before_they_are_copied(spark, monkeypatch):
    """Around one frequent line, only contexts that share more than it with another document stay."""
    monkeypatch.setattr(passages, "MAX_GROUP", 10)
    rng = random.Random(31)
    line = " ".join(f"line{k}" for k in range(30))
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = fresh(50)
    rows = [(i, f"{fresh(60)} {line} {fresh(60)}") for i in range(60)] + [(100 + i, f"{fresh(20)} {shared} {line} {fresh(60)}") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = passages.cut(passages._marked(passages._runs(frame, passages._frequent(frame))))
    large = marks.filter("many").groupBy("signature").count().filter("count > 10").select("signature")
    before = marks.filter("kind > 0").join(large, "signature").select("doc").distinct().count()
    kept = {r.doc for r in passages._contexts(marks, frame).join(large, "signature").select("doc").distinct().collect()}
    assert before > 50 and kept <= {100, 101, 102}
    got = {r.doc_id for r in passages.passage_classes(frame).filter("repeats").collect()}
    assert got == {100, 101, 102}
