r"""Token counts of a unigram vocabulary by Viterbi, without building tokens.

Words are runs of characters other than the space and \t-\r, each with the
word mark in front.  In each word an Aho-Corasick automaton enumerates every
vocabulary piece that ends at each place, and dynamic programming carries only
the best score and its number of pieces.  Ties follow the tokenizer's rule: of
equal scores the piece that starts first wins.  A character without a piece of
its own costs the least score less UNKNOWN, and neighbouring ones are one token.

Pieces come from a SentencePiece file, whose path is a parameter; control,
unknown and byte pieces are left out.  `scores` says what to take for their log
probabilities: "file", the file's own scores, as a unigram file has them; or
"rank", for a BPE file, whose scores are ranks: what the Zipf-Mandelbrot law
gives a piece's rank, 1 / (rank + ZIPF) over their sum, as pieces come in the
order of how often they were merged.  A map over rows: no shuffle; a word of any
length takes the memory of its longest piece besides itself.

Null and empty texts count no words and no tokens.  Repeated rows get a row
each, and a null key stays.
"""

from __future__ import annotations

import re
from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = 10.0
ZIPF = 2.7
MARK = "▁"
CACHED_WORDS = 150_000
LONG_WORD = 400
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def read_pieces(path: str, scores: str = "file") -> list[tuple[str, float]]:
    """(piece, log probability) of a SentencePiece model's ordinary pieces, in order of id; `scores` is "file" or "rank"."""
    import sentencepiece

    if scores not in ("file", "rank"):
        raise ValueError(f"scores must be 'file' or 'rank', not {scores!r}")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()) if not special(i)]
    if scores == "file":
        return pieces
    total = log(sum(1 / (rank + ZIPF) for rank in range(len(pieces))))
    return [(piece, -log(rank + ZIPF) - total) for rank, (piece, _) in enumerate(pieces)]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.ring = max(len(piece) for piece, _ in pieces) + 2
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.young: dict[str, tuple[int, float, int]] = {}
        self.old: dict[str, tuple[int, float, int]] = {}

    def best(self, text: str) -> tuple[int, float, int]:
        """(tokens, score, unknown tokens) of the best segmentation; places are held as far back as a piece reaches."""
        n, low, m = len(text), float("-inf"), self.ring
        scores, counts, unknowns, last_unknown = [low] * m, [0] * m, [0] * m, [False] * m
        scores[0] = 0.0
        done, single = 0, False  # every end up to `done` is settled; `single`: a piece of one character ends at done + 1
        unknown = self.unknown

        def settle(done: int, single: bool) -> None:
            """Takes the character at `done` as unknown, where that is better, and makes room for the place after the next."""
            at, to = done % m, (done + 1) % m
            if not single and scores[at] + unknown > scores[to]:
                more = not last_unknown[at]
                scores[to], counts[to], unknowns[to], last_unknown[to] = scores[at] + unknown, counts[at] + more, unknowns[at] + more, True
            free = (done + 2) % m
            scores[free], last_unknown[free] = low, False

        for end, (length, score) in self.automaton.iter(text):  # by end, the earliest start first
            while done < end:
                settle(done, single)
                done, single = done + 1, False
            if length == 1:
                single = True
            start, to = (end + 1 - length) % m, (end + 1) % m
            value = scores[start] + score
            if value > scores[to]:
                scores[to], counts[to], unknowns[to] = value, counts[start] + 1, unknowns[start]
        while done < n:
            settle(done, single)
            done, single = done + 1, False
        return counts[n % m], scores[n % m], unknowns[n % m]

    def word(self, word: str) -> tuple[int, float, int]:
        found = self.old.get(word) or self.best(MARK + word)
        if len(word) <= LONG_WORD:
            if len(self.young) >= CACHED_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, int, float, int]:
        """(words, tokens, score, unknown tokens) of a text."""
        words = _WORDS(text) if text else []
        each = [self.young.get(w) or self.word(w) for w in words]
        return len(words), sum(e[0] for e in each), sum(e[1] for e in each), sum(e[2] for e in each)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", scores: str = "file") -> DataFrame:
    """key, n_words, n_tokens, n_unknown and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(path, scores))  # a vocabulary: 32,000 pieces here
    rows = docs.select(F.col(key), F.col(text))

    def run(batches):
        counter = UnigramCounter(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, tokens, score, unknown = zip(*map(counter.count, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64()), pa.array(score, pa.float64())], names=[key, "n_words", "n_tokens", "n_unknown", "score"])

    return rows.mapInArrow(run, f"`{key}` {rows.dtypes[0][1]}, n_words long, n_tokens long, n_unknown long, score double")
