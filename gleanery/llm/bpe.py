r"""BPE encoding and decoding with contiguous rank arrays.

A word is held as the boundaries of its parts and, beside them, the rank of
each pair of adjacent parts.  The least rank is found by scanning the array
(leftmost on ties), its boundary is deleted and the two neighbouring ranks are
looked up again.  Words of over LONG_WORD characters keep the same order of
merges with a heap, so that one huge word costs n log n.

Reads the vocabulary of a `tokenizers` JSON file: NFC, white space dropped,
lower case, pieces by pattern, byte-level symbols with an end-of-word suffix.
The file's path is a parameter and the file is read on every worker from bytes
that the driver ships once (1.7 MB here).

Null and empty texts have no ids and decode to the empty text.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 400
CACHED_WORDS = 150_000
NEVER = 1 << 60
# What the library's Unicode tables have that Python's may not, and white space as its patterns take it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MORE_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
MORE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Lower case by first and last code point and what is added.
MORE_LOWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
#: Its NFC is older: these marks are no marks to it, so they neither move nor compose.
NO_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0),
    (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]


#: Below, the library's tables and Python's agree.
COMMON = 0x7FD


def _class_of(kind: str, more: list[tuple[int, int]], end: int) -> str:
    """The members of a character class below `end`: Python's general category, and what the library has besides."""
    member = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(end)), bool, end)
    for a, b in more:
        member[a : b + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8))).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.tolist())


@cache
def _pieces(end: int = sys.maxunicode + 1):
    """Splits a normal text of characters below `end`."""
    letters, numbers = _class_of("L", MORE_LETTERS, end), _class_of("N", MORE_NUMBERS, end)
    return re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{SPACES}{letters}{numbers}]+").findall


_ASCII_PIECES = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r a-z0-9]+").findall
_LOWER = {c: c + more for a, b, more in MORE_LOWER for c in range(a, b + 1)}
_RARE = re.compile(f"[\\U{COMMON:08x}-\\U{sys.maxunicode:08x}]").search
_PARTS = re.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NO_MARKS) + "])")


def normal(text: str) -> str:
    """NFC and lower case as the library has them; each character by itself, so that a final sigma is none."""
    rare = _RARE(text)
    text = "".join(unicodedata.normalize("NFC", x) for x in _PARTS.split(text)) if rare else unicodedata.normalize("NFC", text)
    lower = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
    return lower.translate(_LOWER) if rare else lower


def pieces_of(text: str) -> list[str]:
    """The words and marks of a text that is not ASCII."""
    text = normal(text)
    return _pieces()(text) if _RARE(text) else _pieces(COMMON)(text)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable Latin-1, else the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class RankArrayBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: bytes):
        tokenizer = json.loads(spec)
        model = tokenizer["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        #: By a pair of adjacent part ids, packed: the rank of its merge; by rank, the id that it makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.ids[a] << 32 | self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        self.symbol = {c: i for c, i in self.ids.items() if len(c) == 1}
        self.last = {c[:1]: i for c, i in self.ids.items() if c[1:] == self.suffix}
        self.special = {t["content"]: t["id"] for t in tokenizer.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.table = {b: s for b, s in enumerate(byte_symbols())}
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def parts(self, word: str) -> list[int]:
        """The ids of a word of byte symbols; each boundary is held as the id of the part that it opens."""
        symbol, get, made = self.symbol, self.ranks.get, self.made
        parts = [symbol[c] for c in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG_WORD:
            return self._parts_by_heap(parts)
        rank = [get(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while rank:
            least = min(rank)
            if least == NEVER:
                break
            i = rank.index(least)
            parts[i] = made[least]
            del parts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(parts[i] << 32 | parts[i + 1], NEVER)
            if i:
                rank[i - 1] = get(parts[i - 1] << 32 | parts[i], NEVER)
        return parts

    def _parts_by_heap(self, parts: list[int]) -> list[int]:
        """Merges in the same order, least rank first and leftmost on ties, over linked parts."""
        n, get = len(parts), self.ranks.get
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := get(parts[i] << 32 | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], live[j], after[i] = self.made[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [parts[i] for i in range(n) if live[i]]

    def word_ids(self, piece: str) -> list[int]:
        """The ids of a piece that is not in the younger of the two caches."""
        found = self.older.get(piece)
        if found is None:
            found = self.parts(piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.table))
        if len(piece) <= LONG_WORD:
            if len(self.cache) >= CACHED_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.split_special(text) if self.split_special and "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                pieces = _ASCII_PIECES(part.lower())
            else:
                pieces = pieces_of(part)
            for piece in pieces:
                out += self.cache.get(piece) or self.word_ids(piece)
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space, as the file has no decoder; special tokens stay."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each row's whole text and the text that they decode to.

    Every input column stays; an input column named like an output is replaced.
    A map over rows: no shuffle, and a lost executor costs its own tasks only.
    """
    with open(path, "rb") as file:  # on the driver
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    source = text if text in kept else "__text"
    rows = df.select(*[F.col(f"`{c}`") for c in kept], *([] if text in kept else [F.col(f"`{text}`").alias(source)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)

    def run(batches):
        coder = RankArrayBpe(spec.value)
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                coded = [coder.encode(t) for t in part.column(at).to_pylist()]
                columns = [part.column(i) for i, name in enumerate(part.schema.names) if name in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.list_(pa.int32())), pa.array(map(coder.decode, coded), pa.string())], names=[*kept, ids, decoded])

    return rows.mapInArrow(run, f"{schema}{', ' if schema else ''}`{ids}` array<int>, `{decoded}` string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode_decode(docs.select("doc_id", "text"), path).select("doc_id", "token_ids", "decoded")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
