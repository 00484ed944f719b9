"""The pipeline on a small table of its own."""

import random

import corpus_pipeline
from gleanery.llm import catalog


def write(spark, folder):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("an", "or", "el", "us", "im")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage = text(20), text(70)
    docs = [(i, text(80), "en", "s", 0) for i in range(40)]
    docs += [(40, docs[0][1], "en", "s", 0), (41, f"{text(60)} scum idiot", "en", "s", 0), (42, f"{text(30)} {passage}", "en", "s", 0), (43, f"{passage} {text(30)}", "en", "s", 0), (44, f"{text(40)} {item}", "en", "s", 0), (45, None, "en", "s", None)]
    docs += [(100 + i, text(30) + (" scum idiot" if i % 2 else ""), "en", "t", 0) for i in range(200)]
    docs = [(i, t, a, b, len(t) if t else None) for i, t, a, b, _ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(100 + i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_effect_in_turn(spark, tmp_path):
    docs = write(spark, str(tmp_path))
    frame = catalog.table(spark, str(tmp_path), "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        seen[name] = {r.doc_id: r for r in frame.collect()}
    clean = {i for i, *_ in docs if i < 40} | {42, 43, 45}
    toxic = {41} | {100 + i for i in range(200) if i % 2}
    assert toxic.isdisjoint(seen["toxicity"]) and clean | {40, 44} <= set(seen["toxicity"])
    assert set(seen["toxicity"]) - set(seen["jaccard_join"]) == {40}
    assert set(seen["substring_dedup"]) == set(seen["jaccard_join"])
    assert seen["substring_dedup"][43].n_chars == len(seen["substring_dedup"][43].text) < 350
    assert {i for i in seen["substring_dedup"] if seen["substring_dedup"][i].text != seen["jaccard_join"][i].text} == {43}
    assert set(seen["substring_dedup"]) - set(seen["decontamination"]) == {44}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(seen["decontamination"])
    assert all(r.n_tokens == len(r.token_ids) for r in out)


def test_stages_with_empty_tables_nulls_and_other_columns(spark, tmp_path):
    """Empty documents, labels or benchmark; repeated rows; columns named like what the stages add."""
    write(spark, str(tmp_path))
    full = catalog.table(spark, str(tmp_path), "documents")
    more = full.union(full.limit(60)).selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS Score", "2 AS stays", "3 AS n_removed", "4 AS Spans", "5 AS match_items", "6 AS token_ids", "7 AS doc", "8 AS text_key")
    more = more.union(spark.createDataFrame([(None, "no id " * 30, None, None, None, *range(1, 9))], more.schema))
    frame, names = more, more.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == names, name
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    rows = frame.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(tuple(r)[5:] == (1, 2, 3, 4, 5, 6, 7, 8) for r in rows)
    assert sum(r.doc_id is None for r in rows) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert {"doc_id", "Score", "doc", "n_tokens"} <= set(last.columns) and last.count() == len(rows)
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        catalog.table(spark, str(tmp_path), name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    nothing = tmp_path / "nothing"
    full.write.parquet(f"{nothing}/documents.parquet")
    for name in ("labels", "benchmark"):
        catalog.table(spark, str(tmp_path), name).limit(0).write.parquet(f"{nothing}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(nothing)).count() == full.count() - 1
