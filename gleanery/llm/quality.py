r"""Quality rules: base counts of each text, and divergence from its language.

Native DataFrame expressions only.  Words are runs of characters other than
the space and \t-\r.  Every document's character-class and common-word
histograms are compared by Jensen-Shannon distance with those of its language,
which are summed over all documents of that language; texts under the length
guards are not compared, as short histograms are noise.  How far is too far is
a language's own too: the median of the distances of its documents (those that
the base rules and the guards let through), in thousandths, plus a number of
times what lies between the median and the upper quartile.  Both are exact,
from counts by thousandth.  Histograms and cuts make a small table that can be
saved, and used for other documents.

Null text: no words, so `base_failed`.  Null lang: a language of its own.  A
table without a column lang is one language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textcore import cut

# Frequent function words of the four languages.
COMMON_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "de", "la", "le", "et", "les", "des", "un", "une", "que", "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "el", "y", "los", "del", "se", "las", "con"]
CHAR_CLASSES = ["upper", "digit", "punctuation", "space", "other"]

MAX_BROADCAST = 10_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_CHARS = 200
MIN_COMMON = 50
#: Cuts: the median plus so many times the upper quartile's distance from it, which counts as LEAST_SPREAD thousandths at least.
CHAR_FENCE, WORD_FENCE = 16, 6
LEAST_SPREAD = 5


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \t-\r]+"), "")


def repeated_words(words: Column, grams: Column) -> Column:
    """Words that lie in a window found twice or more, from the hashes of all windows (null: none)."""

    def covered(ordered: Column) -> Column:
        same = lambda x, k: ordered[k]["h"] == x["h"]
        twice = F.filter(ordered, lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < F.size(ordered) - 1) & same(x, F.least(k + 1, F.size(ordered) - 1))))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda p, j: F.when(j < F.size(s) - 1, F.least(F.lit(WINDOW), s[F.least(j + 1, F.size(s) - 1)] - p)).otherwise(WINDOW)), F.lit(0), lambda a, b: a + b))

    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(grams.isNull() | (F.size(grams) == F.size(F.array_distinct(grams))), 0).otherwise(_let(ordered, covered)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms (`chars`, `common`) of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    split = docs.select("doc_id", lang, text.alias("text"), word_array(text).alias("words"), F.regexp_replace(text, r"\P{Punct}+", "").alias("marks"))
    hits = F.filter("words", lambda w: F.lower(w).isin(COMMON_WORDS))
    gram = lambda i: F.xxhash64(*[F.col("words")[i + k] for k in range(WINDOW)])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \t-\r]"))
    counted = split.select(
        "doc_id",
        "lang",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_all"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("marks").cast("long").alias("n_marks"),
        F.length(F.regexp_replace("marks", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("text", "[^0-9]+", "")).cast("long").alias("n_digits"),
        F.size(hits).alias("n_hits"),
        F.array_join(F.transform(hits, lambda w: F.concat(F.lit(" "), F.lower(w), F.lit(" "))), "").alias("hits"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), gram)).alias("grams"),
    )
    each = [(F.length("hits") - F.length(F.replace("hits", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in COMMON_WORDS]
    spaces = F.col("n_all") - F.col("word_chars")
    return counted.select(
        "doc_id",
        "lang",
        "n_words",
        "n_all",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("words"), F.col("grams")).alias("n_repeat_words"),
        F.array(*[x.cast("double") for x in (F.col("n_upper"), F.col("n_digits"), F.col("n_marks"), spaces, F.col("n_all") - F.col("n_upper") - F.col("n_digits") - F.col("n_marks") - spaces)]).alias("chars"),
        F.array(*[x.cast("double") for x in (*each, F.size("words") - F.col("n_hits"))]).alias("common"),
    )


def references(counts: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_common: the summed histograms of each language, from the rows of `measured`."""
    sums = lambda name, n: F.array(*[F.sum(F.col(name)[i]) for i in range(n)])
    return counts.groupBy("lang").agg(sums("chars", len(CHAR_CLASSES)).alias("ref_chars"), sums("common", len(COMMON_WORDS) + 1).alias("ref_common"))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance, base 2 (0 to 1), of two histograms of one length; 0 where either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, b: a + b)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def distance(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: part(a / sums["p"], b / sums["q"]) + part(b / sums["q"], a / sums["p"]))
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))).otherwise(0.0)

    return _let(F.struct(total(p).alias("p"), total(q).alias("q")), distance)


def thousandths(distance: str) -> Column:
    return F.ceil(1000 * F.col(distance)).cast("int")


def _fence(rows: DataFrame, distance: str, times: int, out: str) -> DataFrame:
    """(fence_lang, out): each language's cut in thousandths, from counts by thousandth."""
    each = rows.groupBy("lang", thousandths(distance).alias("at")).agg(F.count("*").alias("n"))  # 1001 rows a language
    by = W.partitionBy("lang")
    summed = each.withColumns({"upto": F.sum("n").over(by.orderBy("at")), "total": F.sum("n").over(by)})
    half, upper = F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("at"))), F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("at")))
    return summed.groupBy(F.col("lang").alias(f"{out}_lang")).agg((half + times * F.greatest(upper - half, F.lit(LEAST_SPREAD))).alias(out))


def _small(table: DataFrame, column: str) -> DataFrame:
    """A row a language: broadcast where counted as few, else joined by shuffle."""
    return F.broadcast(table) if table.select(column).limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else table


def _distances(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of `measured` with base_failed, both distances, and the reference columns."""
    named = refs.withColumnRenamed("lang", "ref_lang")
    rows = counts.join(_small(named, "ref_lang"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, "char_distance": F.round(js_distance(F.col("chars"), F.col("ref_chars")), 9), "word_distance": F.round(js_distance(F.col("common"), F.col("ref_common")), 9)})


def fitted(counts: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_common, char_cut, word_cut: the references of `measured` rows, with each language's cuts; a language without a text to take a cut from has none."""
    refs = references(counts)
    rows = _distances(counts, refs).filter("NOT base_failed")
    chars = _fence(rows.filter(F.col("n_all") >= MIN_CHARS), "char_distance", CHAR_FENCE, "char_cut")
    words = _fence(rows.filter(F.col("n_words") >= MIN_COMMON), "word_distance", WORD_FENCE, "word_cut")
    both = refs.join(chars, F.col("lang").eqNullSafe(F.col("char_cut_lang")), "left").join(words, F.col("lang").eqNullSafe(F.col("word_cut_lang")), "left")
    return both.select("lang", "ref_chars", "ref_common", "char_cut", "word_cut")


def quality_rules(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, both distances, a row per input row.

    `refs` is a table of `fitted` made before, so that a verdict depends on its
    own text alone; by default it is that of all of `docs`, whose counts are
    then written once and read again.  A text in a language that `refs` lacks is
    judged by the base rules alone.
    """
    counts = measured(docs)
    if refs is None:
        counts = cut(counts)
        refs = cut(fitted(counts))
    near = lambda col, guard, limit: (F.col(guard[0]) < guard[1]) | F.col(limit).isNull() | (thousandths(col) <= F.col(limit))
    return _distances(counts, refs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near("char_distance", ("n_all", MIN_CHARS), "char_cut") & near("word_distance", ("n_words", MIN_COMMON), "word_cut")).alias("kept"),
        "char_distance", "word_distance",
    )
