"""Language identification, importance resampling and hard negatives against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import catalog, importance, langid, negatives

SF = "/root/testdata/sf0.01"

# --- hard negatives


def brute_negatives(rows, positives=5, negatives_=5, low=80, high=100):
    held = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    held = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in held]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out, anchors = [], {(i, label, tuple(v)) for i, label, v in held if i % 100 == 0}
    for i, label, v in anchors:
        best = sorted((-dot(v, w), j) for j, m, w in held if m == label and j != i)[:positives]
        for s, j in best:
            fits = sorted((-dot(v, w), k) for k, m, w in held if m != label and low * -s <= 100 * dot(v, w) <= high * -s)[:negatives_]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fits)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, label_ string, Id int"


def vectors(n=400, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, 6))
    rows = [(i, (centre[i % 4] + rng.normal(size=6)).astype("float32").tolist(), int(rng.integers(3)), "x", 1) for i in range(n)]
    same = centre[0].astype("float32").tolist()
    rows += [(1000 + i, same, i % 3, "x", 1) for i in range(150)]  # a frequent vector, ties by id
    rows += [(2100, None, 1, "x", 1), (2200, same, None, "x", 1), (None, same, 1, "x", 1), (2300, [1.0, None], 1, "x", 1), (2400, [math.nan], 1, "x", 1), (2500, [math.inf], 1, "x", 1)]
    rows += [(2600, [], 1, "x", 1), (2700, [1.0, 2.0], 1, "x", 1), (2701, [*same, 9.0], 1, "x", 1), rows[100], rows[7], rows[7]]
    return rows


@pytest.mark.parametrize("anchors", [3, 16_384])
def test_negatives_match_brute_force(spark, anchors):
    """Ties, repeated rows, nulls, lengths, clashing columns; one block of anchors and many."""
    rows = vectors()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_negatives([(i, label, v) for i, v, label, *_ in rows])
    moved = negatives.usable(frame).selectExpr("id", "CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "x")
    got = negatives.mine(moved, moved["id"] % 100 == 0, anchors=anchors)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    if anchors > 1000:
        assert sorted(map(tuple, negatives.hard_negatives(frame).collect())) == want
        assert got.columns == [c.split()[0] for c in negatives.SCHEMA.split(", ")]


def test_negatives_of_huge_components_and_empty_tables(spark):
    rows = [(i, [float(2 ** (17 + i // 25 % 3)), 3.0 + i], i % 2) for i in range(0, 900, 25)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(frame).collect())) == brute_negatives([(i, label, v) for i, v, label in rows])
    wide = np.array([[1e200, 2.0]])
    assert negatives.products(wide, wide).tolist() == [[negatives.MOST]] and negatives.products(wide, -wide).tolist() == [[-negatives.MOST]]
    assert negatives.hard_negatives(frame.limit(0)).count() == 0
    assert negatives.hard_negatives(frame.filter("vec_id % 100 <> 0")).columns == negatives.hard_negatives(frame).columns


# --- importance resampling


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_importance(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    n, m = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in s}
    out = []
    for i, text in docs:
        words, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def test_importance_matches_brute_force(spark, monkeypatch):
    """Null, empty and long texts, pieces and their seams, repeated rows, one doc_id of several texts, a null id, few ranges."""
    monkeypatch.setattr(importance, "PIECE", 7)
    monkeypatch.setattr(importance, "COPIES", 3)
    monkeypatch.setattr(importance, "RANGES", 3)
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "9", "gamma-delta", "日本", "it's"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(150)] + [(200, None), (201, ""), (202, " -- "), (203, "A b C d e f g"), (204, "a b c d e f g h"), (205, text(400)), (None, text(30))]
    docs += [docs[3]] * 8 + [(7, text(25)), (7, text(25))]
    target = [text(40), "alpha beta x1", None]
    frame = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, N_words string").repartition(4)
    got = importance.importance_ranks(frame, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_importance(docs, target)


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    got = {r.doc_id: r for r in importance.importance_ranks(docs, none).collect()}
    assert got[1].n_features == 6 and got[2].weight == 0 and got[1].rank is None
    assert importance.importance_ranks(docs.limit(0), none).count() == 0


# --- language identification


def brute_counts(text):
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())
    found = Counter()
    for k in langid.ORDERS:
        for i in range(len(raw) - k + 1):
            value = int.from_bytes(raw[i : i + k], "little")
            found[(((value ^ ((k - 1) * 0x3C6EF372 & 0xFFFFFFFF)) * 0x9E3779B1 & 0xFFFFFFFF)) >> (32 - 13)] += 1
    return found


def test_language_counts_match_brute_force(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(langid, "PIECE", 11)
    texts = ["", "a", "Hello,  WORLD 12 again", "été À la plage -- ", "日本語 text", " x ", "ab" * 40, "!!!"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    ((rows, found),) = langid.blocks([batch], "text")
    assert rows.num_rows == len(texts)
    for text, row in zip(texts, found, strict=True):
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == brute_counts(text), text


def test_languages_of_whole_table_are_right_where_not_learnt(spark):
    docs = catalog.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in catalog.op11_language(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(want) and {r.lang_pred for r in rows.values()} <= set(want.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == want[i] for i in held) >= 0.98 * len(held)


def test_language_learns_nothing_from_held_out_rows_and_rejects_other_scripts(spark):
    docs = catalog.table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    spoilt = docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'junk ' || doc_id ELSE text END AS text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    again = langid.fit(spoilt)
    assert model.languages == again.languages and np.allclose(model.vectors, again.vectors, atol=1e-5) and max(Counter(model.languages).values()) > 1
    other = spark.createDataFrame([(1, "Это совершенно другой язык, и его здесь никто не учил. " * 30)], "doc_id long, text string")
    assert langid.identify(other, model).first().rejected
    assert not langid.identify(docs.filter("doc_id = 3"), model).first().rejected


def test_language_edges(spark):
    """Null and empty texts, no letters, repeated rows, null ids and languages, clashing columns, empty tables, very long texts."""
    docs = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 $$ 34", "en", 1), (4, "the cat and the dog", "en", 1), (4, "the cat and the dog", "en", 1), (None, "la mer et le ciel", "fr", 1), (6, "le chat et la souris", "fr", 1), (7, "le chat", None, 1), (9, "the cat " * 300_000, None, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, Score int")
    rows = langid.predicted_languages(frame).collect()
    assert len(rows) == len(docs) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id == 9} == {"en"} and {r.lang_pred for r in rows if r.doc_id is None} == {"fr"}
    assert langid.identify(frame, langid.fit(frame)).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    none = langid.predicted_languages(frame.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predicted_languages(frame.limit(0)).count() == 0
