"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

States are a role and whether the line begins a turn or goes on with one.  A
line shows a marker class (a known speaker word before a colon, or none),
whether it follows a blank line, and a class of its length and last character.
Start, transition and emission tables are counts of labelled lines with one
added, summed in Spark over all rows; a conversation is read by the model of
the half of conversations that it is not in.  Viterbi recovers the roles, and
the lines are rendered as turns.

Transcripts are made from labelled turns: speaker words, whether a turn has one,
and whether turns are parted by a blank line or a mere line break are drawn by
hashes of the conversation, so no feature tells where a turn begins.  A turn's
own blank lines stay within it; those at its ends go.  A speaker word is taken
off the line that begins a turn of its role, and stays in any other line.

Rows are dealt in ranges of (conversation, turn), so a conversation of any
length is spread over tasks.  Where one crosses partitions, each part sends the
best scores from its first to its last state, a matrix of fixed size; the chain
of these matrices gives the states at the cuts, and the parts are read between
them.  The result is the Viterbi path of the whole conversation, and its
canonical text in pieces, one a turn, that give the whole when put together.

Turns with null text or a role other than ROLES are skipped: they come back
without a piece and leave the rest as it is.  Turns of equal number are read in
the order of role and text.  A null or empty transcript has no turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scan import positions

from .textcore import cut

ROLES = ["system", "user", "assistant"]
# Words that mark a speaker.
MARKERS = {"system": "system", "instruction": "system", "user": "user", "human": "user", "q": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant", "a": "assistant"}
PRIOR, MARK_PRIOR, TINY = 8, 100, 1e-12
_MARKED = re.compile(r"^\s*(?:#+\s*|\[|<\|?)?(" + "|".join(MARKERS) + r")(?:\]|\|?>)?\s*:\s*", re.I)
START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "turns array<struct<role:string,text:string>>"
_STATES = 2 * len(ROLES)
_EVERY = np.arange(_STATES)
_MARKS, _SHAPES = len(ROLES) + 1, 6


@dataclass
class Lines:
    """The lines that are not blank: as they are, without their marker, and how many blank lines stand before each; features: a row of (marker, after blank, shape) for each."""

    raw: list[str]
    bare: list[str]
    blanks: list[int]
    features: np.ndarray

    def shown(self, k: int, state: int) -> str:
        """What line k adds to the canonical form in a state, without the end of the turn before."""
        role, goes_on = divmod(int(state), 2)
        if goes_on:
            return "\n" * (1 + self.blanks[k]) + self.raw[k]
        own = self.features[k, 0] == 1 + role
        return f"{START}{ROLES[role]}\n{self.bare[k] if own else self.raw[k]}"


def observe(lines: list[str], blank: bool = False) -> Lines:
    """`blank`: whether a blank line stands before the first."""
    raw, bare, blanks, rows, before = [], [], [], [], int(blank)
    for line in lines:
        if not line.strip():
            before += 1
            continue
        found = _MARKED.match(line)
        text = line[found.end() :] if found else line
        mark = 1 + ROLES.index(MARKERS[found[1].lower()]) if found else 0
        size = 0 if len(text) < 80 else 1 if len(text) < 300 else 2
        rows.append((mark, int(before > 0), 2 * size + text.rstrip().endswith("?")))
        raw.append(line)
        bare.append(text)
        blanks.append(before)
        before = 0
    return Lines(raw, bare, blanks, np.array(rows, np.int64).reshape(-1, 3))


@dataclass
class RoleModel:
    """Log probabilities: start, transition, and one table for each feature."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def _shown(self, rows: np.ndarray) -> np.ndarray:
        return sum(table[:, rows[:, k]] for k, table in enumerate(self.emit)).T

    def viterbi(self, rows: np.ndarray, entry: int = -1, end: int = -1) -> list[int]:
        """The best states of the lines, after a line of state `entry` and up to one of state `end` where given."""
        if not len(rows):
            return []
        shown = self._shown(rows)
        score, back = (self.start if entry < 0 else self.move[entry]) + shown[0], []
        for step in shown[1:]:
            ways = score[:, None] + self.move
            best = ways.argmax(axis=0)
            back.append(best)
            score = ways[best, _EVERY] + step
        path = [int(score.argmax()) if end < 0 else end]
        for best in reversed(back):
            path.append(int(best[path[-1]]))
        return path[::-1]

    def between(self, rows: np.ndarray) -> np.ndarray:
        """The best score of the lines by state of the first and of the last."""
        shown = self._shown(rows)
        best = np.where(np.eye(_STATES, dtype=bool), shown[0], -np.inf)
        for step in shown[1:]:
            best = (best[:, :, None] + self.move).max(axis=1) + step
        return best

    def parse(self, transcript: str | None) -> list[dict]:
        """The turns in order: role and text."""
        if not transcript:
            return []
        lines = observe(transcript.split("\n"))
        turns: list[dict] = []
        for k, state in enumerate(self.viterbi(lines.features)):
            role, goes_on = ROLES[state // 2], state % 2
            if goes_on and turns and turns[-1]["role"] == role:
                turns[-1]["text"] += lines.shown(k, state)
            else:
                turns.append({"role": role, "text": lines.shown(k, state - goes_on).split("\n", 1)[1]})
        return turns


_TABLES = [(_STATES,), (_STATES, _STATES), (_STATES, _MARKS), (_STATES, 2), (_STATES, _SHAPES)]


def counted(segments) -> list[np.ndarray]:
    """start, move and emission counts of segments, each the (states, features) of lines in turn."""
    start, move, *emit = (np.zeros(shape, np.int64) for shape in _TABLES)
    for states, rows in segments:
        start[states[:1]] += 1
        np.add.at(move, (states[:-1], states[1:]), 1)
        for k, table in enumerate(emit):
            np.add.at(table, (states, rows[:, k]), 1)
    return [start, move, *emit]


def fit(counts: list[np.ndarray] | None = None) -> RoleModel:
    """The model of such counts."""
    start, move, *emit = (np.ones(shape) for shape in _TABLES)
    for role in range(len(ROLES)):  # before any data: a marker names its role, and a line that goes on has none
        emit[0][2 * role, 1 + role] += MARK_PRIOR
        emit[0][2 * role + 1, 0] += MARK_PRIOR
        move[2 * role : 2 * role + 2, 2 * role + 1] += PRIOR
    if counts:
        start, move, *emit = (a + b for a, b in zip((start, move, *emit), counts, strict=True))
    own = _EVERY // 2
    move[(own[:, None] != own[None, :]) & (_EVERY % 2 == 1)] = TINY  # a line goes on only with its own role's turn
    start[1::2] = TINY
    log = lambda t: np.log(t / t.sum(axis=-1, keepdims=True))
    return RoleModel(log(start), log(move), [log(t) for t in emit])


def parse_transcripts(df: DataFrame, model: RoleModel, text: str = "transcript") -> DataFrame:
    """Adds `turns` to every row; other columns stay (one of that name is replaced)."""
    kept = [f for f in df.schema.fields if f.name.lower() != "turns"]
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                turns = [model.parse(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], names=[*part.schema.names, "turns"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], TURNS]))


def render(turns: Column) -> Column:
    """The canonical form: each turn between role and end marks."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role (its number), shown (a turn's lines, marked), gap (a blank line parts turns) and fold, in ranges of conversation and turn; `part` numbers the partitions.

    Speaker words and gaps vary by conversation, and about a fifth of the turns have no speaker word.
    """
    rows = _known(turns).filter("role IS NOT NULL")
    words = F.when(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, _one_of(["System", "User", "Assistant"])).otherwise(_one_of(["Instruction", "Human", "AI"]))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    shown = F.when(bare, F.col("text")).otherwise(F.concat(words, F.lit(": "), "text"))
    order = ["conv_id", "turn", "role", "tie"]
    drawn = lambda seed: F.pmod(F.xxhash64("conv_id", F.lit(seed)), F.lit(2)).cast("int")
    made = rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("tie"), shown.alias("shown"), drawn(11).alias("gap"), drawn(9).alias("fold"))
    ranged = made.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return cut(ranged.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id", "turn", "tie", "role", "shown", "gap", "fold", "part"))


def _known(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text and role: its number, or null for a turn that is skipped."""
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")).cast("int") - 1
    return turns.select("conv_id", "turn", "text", F.when(F.col("text").isNotNull() & (role >= 0), role).alias("role"))


def _one_of(words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.col("role") + 1)


def _segments(batches):
    """The rows of each conversation of a partition: (first row's part and fold, table)."""
    held: list[pa.RecordBatch] = []
    whole = lambda: pa.Table.from_batches(held).combine_chunks()
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(batch.schema.get_field_index("conv")).to_pylist()
        at = batch.schema.get_field_index("conv")
        heads = [0, *(k for k in range(1, len(conv)) if conv[k] != conv[k - 1])]
        for a, b in zip(heads, [*heads[1:], len(conv)], strict=True):
            if held and held[0].column(at)[0].as_py() != conv[a]:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _observed(table: pa.Table) -> tuple[np.ndarray, Lines, np.ndarray]:
    """(turn of each line, the lines, true states) of a conversation's rows."""
    turn, parts = [], []
    for k, (shown, gap) in enumerate(zip(table["shown"].to_pylist(), table["gap"].to_pylist(), strict=True)):
        parts.append(observe(shown.strip("\n").split("\n"), bool(gap)))
        turn += [k] * len(parts[-1].raw)
    turn = np.array(turn, np.int64)
    first = np.concatenate([[True], turn[1:] != turn[:-1]])[: len(turn)]
    joined = Lines([x for p in parts for x in p.raw], [x for p in parts for x in p.bare], [x for p in parts for x in p.blanks], np.concatenate([p.features for p in parts]))
    return turn, joined, 2 * np.asarray(table["role"], np.int64)[turn] + ~first


def fit_on(rows: DataFrame) -> list[RoleModel]:
    """By fold, the model of the other fold's conversations; the driver holds a table of counts and two states for each partition."""

    def run(batches):
        counts, edges, part = [counted([]), counted([])], [], 0
        for table in _segments(batches):
            _, lines, states = _observed(table)
            part, fold, conv = (table[c][0].as_py() for c in ("part", "fold", "conv"))
            if len(states):
                counts[fold] = [a + b for a, b in zip(counts[fold], counted([(states, lines.features)]), strict=True)]
                edges = [*edges[:1], (conv, fold, int(states[0]), int(states[-1]))]
        for place, (conv, fold, first, last) in enumerate(edges):
            yield pa.RecordBatch.from_pylist([{"part": part, "place": place, "conv": conv, "fold": fold, "first": first, "last": last}], _EDGES)
        yield pa.RecordBatch.from_pylist([{"part": part, "counts": np.concatenate([t.ravel() for c in counts for t in c]).tolist()}], _EDGES)

    found = rows.mapInArrow(run, "part int, place int, conv string, fold int, first int, last int, counts array<long>")
    sums = found.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()["n"].to_numpy()
    sizes = [int(np.prod(shape)) for shape in _TABLES]
    tables = np.split(np.array(sums, np.int64) if len(sums) else np.zeros(2 * sum(sizes), np.int64), np.cumsum([*sizes, *sizes])[:-1])
    tables = [t.reshape(shape) for t, shape in zip(tables, [*_TABLES, *_TABLES], strict=True)]
    counts = [tables[: len(_TABLES)], tables[len(_TABLES) :]]
    before = None
    for edge in found.filter("conv IS NOT NULL").orderBy("part", "place").select("conv", "fold", "first", "last").collect():  # two a partition at most
        if before and before["conv"] == edge["conv"]:  # one conversation over a cut: it goes on there
            counts[edge["fold"]][0][edge["first"]] -= 1
            counts[edge["fold"]][1][before["last"], edge["first"]] += 1
        before = edge
    return [fit(counts[1]), fit(counts[0])]


_EDGES = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("conv", pa.string()), ("fold", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("counts", pa.list_(pa.int64()))])


def _states_at_cuts(rows: DataFrame, models: list[RoleModel]) -> dict[tuple[int, str], tuple[int, int, bool]]:
    """(state before, last state, whether it is the end) of each part of a conversation that crosses partitions; two a partition at most."""

    def run(batches):
        before = None
        first = True
        for table in _segments(batches):
            if first:
                yield ends(table)
            first, before = False, table if not first else None
        if before is not None:
            yield ends(before)

    def ends(table):
        part, fold, conv = (table[c][0].as_py() for c in ("part", "fold", "conv"))
        features = _observed(table)[1].features
        best = models[fold].between(features).ravel().tolist() if len(features) else []
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([conv]), pa.array([fold], pa.int32()), pa.array([best], pa.list_(pa.float64()))], names=["part", "conv", "fold", "best"])

    found = rows.mapInArrow(run, "part int, conv string, fold int, best array<double>").filter(F.size("best") > 0).collect()
    parts: dict[str, list] = {}
    for r in sorted(found, key=lambda r: r["part"]):
        parts.setdefault(r["conv"], []).append(r)
    cuts = {}
    for conv, chain in parts.items():
        if len(chain) < 2:
            continue
        model, ways, score = models[chain[0]["fold"]], [], None
        for r in chain:
            best = np.array(r["best"]).reshape(_STATES, _STATES)
            enter = model.start[None, :] if score is None else score[:, None] + model.move
            total = enter[:, :, None] + best[None, :, :]  # state before, first, last
            reach = total.max(axis=1)
            ways.append(reach.argmax(axis=0))
            score = reach.max(axis=0)
        last = int(score.argmax())
        for r, back in zip(reversed(chain), reversed(ways), strict=True):
            entry = int(back[last]) if r is not chain[0] else -1
            cuts[r["part"], conv] = (entry, last, r is chain[-1])
            last = entry
    return cuts


def read_turns(rows: DataFrame, models: list[RoleModel]) -> DataFrame:
    """conv_id, turn, role, tie, recovered (the turn is read as one, in its role) and piece (its share of the canonical form)."""
    cuts = _states_at_cuts(rows, models)
    shared = rows.sparkSession.sparkContext.broadcast((models, cuts))

    def run(batches):
        models, cuts = shared.value
        for table in _segments(batches):
            part, fold, conv = (table[c][0].as_py() for c in ("part", "fold", "conv"))
            entry, end, closes = cuts.get((part, conv), (-1, -1, True))
            turn, lines, truth = _observed(table)
            states = np.array(models[fold].viterbi(lines.features, entry, end), np.int64)
            n = np.bincount(turn, minlength=table.num_rows)
            right = (np.bincount(turn, states == truth, table.num_rows) == n) & (n > 0)
            pieces = [""] * table.num_rows
            for k, (t, state) in enumerate(zip(turn.tolist(), states.tolist(), strict=True)):
                close = END if state % 2 == 0 and (k or entry >= 0) else ""
                pieces[t] += close + lines.shown(k, state)
            if closes and (len(states) or entry >= 0):
                pieces[-1] += END
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("conv_id", "turn", "role", "tie")), pa.array(right), pa.array(pieces)], names=["conv_id", "turn", "role", "tie", "recovered", "piece"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role int, tie long, recovered boolean, piece string")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, place, recovered, piece: a row per turn.

    The pieces of a conversation, put together in the order of `place` (from 1),
    are its canonical text; a piece opens and closes turns as they are read, so
    it may hold none, or more than one.  Skipped turns have neither.
    """
    rows = ordered_turns(conversations)
    read = cut(read_turns(rows, fit_on(rows)))
    placed = positions(read, "conv_id", ["turn", "role", "tie"], "place").select("conv_id", "turn", "place", "recovered", "piece")
    skipped = _known(conversations).filter("role IS NULL")
    return placed.unionByName(skipped.select("conv_id", "turn", F.lit(None).cast("int").alias("place"), F.lit(None).cast("boolean").alias("recovered"), F.lit(None).cast("string").alias("piece")))
