"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, importance, jaccard, langid, licenses, negatives, passages, quality, suffixdedup, toxicity, unigram
from .textcore import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; TOKENIZER_DIR overrides the folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op2_substring_dedup(spark, sf_dir):
    return passages.passage_classes(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark, sf_dir):
    return suffixdedup.repeat_digests(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return unigram.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), scores="rank")


def op8_bpe(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_chat(spark, sf_dir):
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op10_quality(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_language(spark, sf_dir):
    return langid.predicted_languages(table(spark, sf_dir, "documents"))


def op12_importance(spark, sf_dir):
    return importance.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "op11_language": op11_language,
    "op12_importance": op12_importance,
    "op13_negatives": op13_negatives,
}

OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS g FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
occ AS (SELECT pos.doc_id, pos.s, pos.n, win.item FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
bp AS (SELECT b, s AS p, least(13, len(w)) AS n, list_slice(w, s, s + least(13, len(w)) - 1) AS g FROM (SELECT *, row_number() OVER () AS b FROM bw), unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
al AS (SELECT pos.doc_id, b, pos.s, pos.s - p AS shift, pos.s - row_number() OVER (PARTITION BY pos.doc_id, b, pos.s - p ORDER BY pos.s) AS island, pos.n FROM pos JOIN bp ON pos.n = bp.n AND pos.g = bp.g),
run AS (SELECT doc_id, min(s) - 1 AS st, count(*) + min(n) - 1 AS words FROM al GROUP BY doc_id, b, shift, island),
lon AS (SELECT doc_id, words, st FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, st) = 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(lon.words, 0) AS BIGINT) AS longest_words, CAST(lon.st AS BIGINT) AS longest_at
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN lon USING (doc_id)
"""

_COMMON = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
_JS = """CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
  (CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2(2 * ({p}[i] / list_sum({p})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0.0 END)
  + (CASE WHEN {q}[i] > 0 THEN {q}[i] / list_sum({q}) * log2(2 * ({q}[i] / list_sum({q})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0.0 END))) / 2)), 9) ELSE 0.0 END"""
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT row, w[s:s + 4] AS g, s FROM d, unnest(range(1, len(w) - 3)) AS t(s)),
rep AS (SELECT row, s FROM (SELECT row, s, count(*) OVER (PARTITION BY row, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT row, count(DISTINCT p) AS n FROM rep, unnest(range(s, s + 5)) AS t(p) GROUP BY row),
m AS (SELECT d.row, doc_id, lang, len(w) AS n_words, length(text) AS n_all, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(cov.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS up, length(regexp_replace(text, '[^0-9]', '', 'g')) AS dig, length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS mk,
    list_transform([{_COMMON}], lambda c: CAST(len(list_filter(w, lambda x: lower(x) = c)) AS DOUBLE)) AS each
  FROM d LEFT JOIN cov ON d.row = cov.row),
h AS (SELECT *, [CAST(up AS DOUBLE), dig, mk, n_all - word_chars, word_chars - up - dig - mk] AS chars, list_append(each, n_words - list_sum(each)) AS common FROM m),
r AS (SELECT lang, [{", ".join(f"sum(chars[{i + 1}])" for i in range(5))}] AS rc, [{", ".join(f"sum(common[{i + 1}])" for i in range(len(quality.COMMON_WORDS) + 1))}] AS rw FROM h GROUP BY lang),
j AS (SELECT doc_id, h.lang, n_words, n_all, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    {_JS.format(p="chars", q="rc")} AS char_distance, {_JS.format(p="common", q="rw")} AS word_distance FROM h JOIN r ON h.lang IS NOT DISTINCT FROM r.lang),
th AS (SELECT *, CAST(ceil(1000 * char_distance) AS INT) AS ca, CAST(ceil(1000 * word_distance) AS INT) AS wa FROM j),
cc AS (SELECT lang, quantile_disc(ca, 0.5) AS h, quantile_disc(ca, 0.75) AS u FROM th WHERE NOT base_failed AND n_all >= {quality.MIN_CHARS} GROUP BY lang),
wc AS (SELECT lang, quantile_disc(wa, 0.5) AS h, quantile_disc(wa, 0.75) AS u FROM th WHERE NOT base_failed AND n_words >= {quality.MIN_COMMON} GROUP BY lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (n_all < {quality.MIN_CHARS} OR cc.h IS NULL OR ca <= cc.h + {quality.CHAR_FENCE} * greatest(cc.u - cc.h, {quality.LEAST_SPREAD})) AND (n_words < {quality.MIN_COMMON} OR wc.h IS NULL OR wa <= wc.h + {quality.WORD_FENCE} * greatest(wc.u - wc.h, {quality.LEAST_SPREAD})) AS kept, char_distance, word_distance
FROM th LEFT JOIN cc ON th.lang IS NOT DISTINCT FROM cc.lang LEFT JOIN wc ON th.lang IS NOT DISTINCT FROM wc.lang
"""

_LITERAL = lambda t: "'" + t.replace("'", "''") + "'"


def _canonical_sql(x: str) -> str:
    x = rf"regexp_replace(lower(coalesce({x}, '')), '(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', '', 'g')"
    x = f"' ' || regexp_replace({x}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for other, one in licenses.SPELLINGS.items():
        x = f"replace(replace({x}, ' {other} ', ' {one} '), ' {other}s ', ' {one}s ')"
    return f"sha256(trim(regexp_replace({x}, ' +', ' ', 'g')))"


OP1_SQL = rf"""
WITH k0 AS (SELECT {_canonical_sql("t")} AS d, id FROM (VALUES {", ".join(f"({_LITERAL(n)}, {_LITERAL(t)})" for n, ts in licenses.KNOWN.items() for t in ts)}) AS v(id, t)
  UNION ALL SELECT d, id FROM (VALUES {", ".join(f"('{n}', '{d}')" for n, ds in licenses.DIGESTS.items() for d in ds)}) AS v(id, d)),
k AS (SELECT d, min(id) AS id FROM k0 GROUP BY 1),
d AS (SELECT row_number() OVER () AS row, doc_id, text, {_canonical_sql("text")} AS digest FROM documents),
l AS (SELECT row, {_canonical_sql("x")} AS d FROM (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d) WHERE regexp_matches(lower(x), 'licen[cs]')),
n AS (SELECT row, count(*) AS n, list_sort(list_distinct(list(k.id))) AS ids FROM l JOIN k ON l.d = k.d GROUP BY row)
SELECT doc_id, digest, k.id AS license_id, coalesce(n, 0) AS n_notices, coalesce(ids, CAST([] AS VARCHAR[])) AS notice_ids FROM d LEFT JOIN k ON k.d = digest LEFT JOIN n ON n.row = d.row
"""

OP12_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
every AS (
  SELECT row_number() OVER () AS row, doc_id, text, FALSE AS aim FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, TRUE FROM benchmark),
words AS (SELECT row, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM every),
runs AS (SELECT row, aim, array_to_string(w[s:s + k - 1], ' ') AS f FROM words, unnest([1, 2, 3]) AS o(k), unnest(range(1, len(w) - k + 2)) AS p(s)),
kinds AS (SELECT DISTINCT f FROM runs),
bytes AS (SELECT f, hex(f) AS h FROM kinds),
crc AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(0, len(h) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS UBIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
found AS (SELECT row, aim, bucket, count(*) AS n FROM runs JOIN crc USING (f) GROUP BY ALL),
sums AS (SELECT bucket, sum(n) FILTER (NOT aim) AS s, sum(n) FILTER (aim) AS t FROM found GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS g FROM sums, alls WHERE s > 0),
weight AS (SELECT row, sum(n * g) AS weight FROM found JOIN gain USING (bucket) WHERE NOT aim GROUP BY row),
scored AS (SELECT row, doc_id, len(w) AS n_words, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM every JOIN words USING (row) LEFT JOIN weight USING (row) WHERE NOT every.aim),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_words + greatest(n_words - 1, 0) + greatest(n_words - 2, 0) AS BIGINT) AS n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (row)
"""

OP13_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""

ORACLE_SQL = {"op1_licenses": OP1_SQL, "op5_decontamination": OP5_SQL, "op10_quality": OP10_SQL, "op12_importance": OP12_SQL, "op13_negatives": OP13_SQL}
