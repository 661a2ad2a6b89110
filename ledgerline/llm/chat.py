"""Chat formatting: the roles of a transcript's lines by a hidden Markov model, then a canonical rendering of its turns.

A state is a role and whether a line begins a turn or goes on with it. A line shows its speaker marker, if any, its length and
whether it asks. Initial, transition and emission probabilities are counted, in Spark, over conversations whose roles are known
and whose crc32 is not 2 mod 4. Viterbi finds the likeliest states of a whole conversation.

A conversation may be longer than a task should hold. Turns are dealt, in order, to ranges of bounded size (``ranges``), and of
the conversations in a range only its first and its last can go on in others. Each of these two parts first becomes a matrix, the
best log probability from the start, and from every state before it, to every state at its end; a pass over the matrices of a
conversation picks the states between its parts; then every range finds its own paths. The result is that of one Viterbi pass.

Defined cases: a NULL text is an empty line; a NULL role leaves no marker and teaches nothing; a NULL turn comes first; rows
without a conv_id are one conversation; rows of the same turn go by the first bytes of their text, then by its hash; equal rows are
equal lines said again; an empty table gives no rows; without any known roles all probabilities are even.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut
from ledgerline.llm.ranges import in_ranges, number_key, text_key

ROLES = ("system", "user", "assistant")
# What transcripts call the roles.
CALLED = {"system": ("system", "instructions"), "user": ("user", "human", "question"), "assistant": ("assistant", "bot", "ai", "answer")}
ROLE_CALLED = {name: role for role, names in CALLED.items() for name in names}
MARKER = regex.compile(r"^\s*(?:#+\s*|<\|(?:im_start\|>)?|\[|\*\*)?(" + "|".join(ROLE_CALLED) + r")(?:\|>|\]|\*\*)?\s*(?::|\|>|\])\s*", regex.I)
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
LENGTHS = 12
KINDS = {"start": 1, "next": len(STATES), "marker": len(ROLES) + 1, "length": LENGTHS, "asks": 2}
FOLDS, HELD_OUT = 4, 2
# Bytes of a range of turns: a task holds the paths through one.
RANGE_BYTES = 8 << 20
# Counts added to each possibility that the states allow.
SMOOTHING = 0.5
NEVER = -1e9


def marker_of(line: str) -> tuple[str | None, str]:
    """The role that a line's marker names, and the line without it."""
    found = MARKER.match(line)
    return (ROLE_CALLED[found[1].lower()], line[found.end() :]) if found else (None, line)


def shown(line: str) -> tuple[int, int, int]:
    role, rest = marker_of(line)
    return ROLES.index(role) + 1 if role else 0, min(len(rest).bit_length(), LENGTHS - 1), int(rest.rstrip().endswith("?"))


def transcript_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``said``: the turn's text as a transcript has it, with a marker on every other turn.

    Which turns have one is decided by a hash; the marker's form goes by it too.
    """
    place = F.crc32(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))
    forms = [("", ": "), ("### ", ":\n"), ("[", "] "), ("<|", "|> ")]
    text = F.coalesce("text", F.lit(""))
    marked = F
    for number, (before, after) in enumerate(forms):
        spoken = F.concat(F.lit(before), F.initcap("role") if number < 2 else F.col("role"), F.lit(after.rstrip("\n")), text)
        marked = marked.when(F.pmod(F.shiftright(place, 1), F.lit(len(forms))) == number, spoken)
    has = F.col("role").isin(list(ROLES)) & (F.pmod(place, F.lit(2)) == 0)
    return conversations.select("conv_id", "turn", "role", F.when(has, marked).otherwise(text).alias("said"))


def _is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for role, said, before, long_before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first = ROLES.index(role) * 2
            previous = None if before is None else ROLES.index(before) * 2 + bool(long_before)
            for i, line in enumerate(said.split("\n")):
                state = first + (i > 0)
                total["start", 0, state] += previous is None
                if previous is not None:
                    total["next", previous, state] += 1
                for kind, value in zip(("marker", "length", "asks"), shown(line), strict=True):
                    total[kind, state, value] += 1
                previous = state
    rows = list(zip(*((k, a, b, n) for (k, a, b), n in total.items()), strict=True)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), *[pa.int64()] * 3), strict=True)],
                                     ["kind", "a", "b", "n"])


def fit(turns: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities, counted over the turns with known roles; some hundred counts come to the driver."""
    known = turns.filter(F.col("role").isin(list(ROLES)) & ~_is_held_out() & F.col("turn").isNotNull())
    before = known.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(
        F.min(F.struct("role", F.contains("said", F.lit("\n")).alias("long"))).alias("last"))
    rows = known.join(before, ["conv_id", "turn"], "left").select("role", "said", "last.role", "last.long")
    rows = rows.toDF("role", "said", "before", "long_before")
    cells = rows.mapInArrow(_counted, "kind string, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    s = len(STATES)
    counts = {kind: np.zeros((1 if kind == "start" else s, s if kind in ("start", "next") else size)) for kind, size in KINDS.items()}
    for cell in cells.collect():
        counts[cell.kind][cell.a, cell.b] = cell.n
    model = {}
    for kind, count in counts.items():
        smoothed = count + SMOOTHING
        model[kind] = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
    for state, (role, begins) in enumerate(STATES):
        if not begins:  # only the same turn goes on, and never first
            model["start"][0, state] = NEVER
            model["next"][[i for i, (of, _) in enumerate(STATES) if of != role], state] = NEVER
    return model


def _emissions(lines: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    marker, length, asks = np.array([shown(line) for line in lines]).T
    return model["marker"][:, marker].T + model["length"][:, length].T + model["asks"][:, asks].T


def _lines(said: list[str]) -> list[str]:
    return [line for text in said for line in text.split("\n")]


def _matrix(lines: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    """From the start (row 0) and from each state before (the others) to each state at the end, the best log probability."""
    emitted = _emissions(lines, model)
    best = np.concatenate([model["start"], model["next"]]) + emitted[0]
    for row in emitted[1:]:
        best = (best[:, :, None] + model["next"][None]).max(axis=1) + row
    return best


def _path(lines: list[str], model: dict[str, np.ndarray], entry: int | None = None, end: int | None = None) -> list[int]:
    """The likeliest states of lines, from the start or after a state, up to a given state or the best one."""
    emitted = _emissions(lines, model)
    best = (model["start"][0] if entry is None else model["next"][entry]) + emitted[0]
    came = np.zeros(emitted.shape, np.int8)
    for k, row in enumerate(emitted[1:], start=1):
        ways = best[:, None] + model["next"]
        came[k] = ways.argmax(axis=0)
        best = ways.max(axis=0) + row
    states = [int(best.argmax()) if end is None else end]
    for back in came[:0:-1]:
        states.append(int(back[states[-1]]))
    return states[::-1]


def _between(matrices: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """Of each block the state before it and at its end, on the best path through all."""
    best, came = matrices[0][0], []
    for matrix in matrices[1:]:
        ways = best[:, None] + matrix[1:]
        came.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    ends = [int(best.argmax())]
    for back in reversed(came):
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return list(zip([None, *ends[:-1]], ends, strict=True))


def rendered_line(line: str, state: int, is_first: bool, is_last: bool) -> str:
    role, begins = STATES[state]
    out = f"{'' if is_first else '<|end|>\n'}<|{role}|>\n{marker_of(line)[1]}" if begins else f"\n{line}"
    return out + ("<|end|>\n" if is_last else "")


def _parts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of one conversation after the other, of rows in order; the conversation is the first of the names."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _found(part: list[tuple], model: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Of rows of (conversation, turn, role, said, entry, end, begins, closes) the states, and what they render to."""
    conv, *_, entry, end, begins, closes = part[0]
    states = iter(_path(_lines([row[3] for row in part]), model, entry, end))
    out = []
    for i, (_, turn, role, said, *_) in enumerate(part):
        lines = said.split("\n")
        own = [next(states) for _ in lines]
        marks = "".join(STATES[k][0][0].upper() if STATES[k][1] else STATES[k][0][0] for k in own)
        text = "".join(
            rendered_line(line, k, begins and i == j == 0, closes and i == len(part) - 1 and j == len(lines) - 1)
            for j, (line, k) in enumerate(zip(lines, own, strict=True)))
        out.append((conv, turn, role, len(lines), marks, text))
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                      ["conv_id", "turn", "role", "n_lines", "states", "rendered"])


def recovered(turns: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Of each turn ``conv_id``, ``turn``, ``role``, ``n_lines``, the ``states`` found for its lines, and its ``rendered`` part.

    The parts of a conversation, in order, are its rendering. ``states`` has a letter for each line: of the role, a capital where
    a turn begins.
    """
    shape = (1 + len(STATES), len(STATES))
    key = F.concat(number_key("conv_id", nulls_last=False), number_key("turn", nulls_last=False), text_key(F.col("said"), F.col("role")))
    typed = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "said")
    ordered = cut(in_ranges(typed.withColumn("key", key), "said", RANGE_BYTES).select("range", "conv_id", "turn", "role", "said"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for part in _parts(batches, ("conv_id", "range", "said")):
            first, last = first or part, part
        ends = [] if first is None else [first] if first is last else [first, last]
        flat = [_matrix(_lines([row[2] for row in part]), model).ravel() for part in ends]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part[0][0] for part in ends], pa.int64()), pa.array([part[0][1] for part in ends], pa.int32()),
             pa.array(flat, pa.list_(pa.float64()))], ["conv_id", "range", "matrix"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "parts")), strict=True):
                found = _between([np.array(part["matrix"]).reshape(shape) for part in parts])
                out += [(conv, part["range"], entry, end, k == 0, k == len(parts) - 1)
                        for k, (part, (entry, end)) in enumerate(zip(parts, found, strict=True))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["of", "of_range", "entry", "end", "begins", "closes"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, ("conv_id", "turn", "role", "said", "entry", "end", "begins", "closes")):
            yield _found(part, model)

    reduced = ordered.select("conv_id", "range", "said").mapInArrow(matrices, "conv_id long, range int, matrix array<double>")
    # Two rows for a range at most, of some hundred bytes; a conversation has one for each range that it is in.
    gathered = reduced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "matrix"))).alias("parts"))
    between = gathered.mapInArrow(ends, "of long, of_range int, entry long, end long, begins boolean, closes boolean")
    # Broadcast, as the rows must stay in order: two short rows for a range at most, so a fixed small share of the input's bytes.
    joined = ordered.join(F.broadcast(between), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")), "left")
    whole = F.lit(True)
    return joined.select("conv_id", "turn", "role", "said", "entry", "end", F.coalesce("begins", whole).alias("begins"),
                         F.coalesce("closes", whole).alias("closes")).mapInArrow(
        paths, "conv_id long, turn long, role string, n_lines long, states string, rendered string")


def formatted(conversations: DataFrame) -> DataFrame:
    """``recovered`` over whole conversations, with ``right``: all lines found in the given role, only the first as a beginning."""
    turns = transcript_turns(conversations.select("conv_id", "turn", "role", "text"))
    found = recovered(turns, fit(turns))
    letter = F.substring("role", 1, 1)
    expected = F.concat(F.upper(letter), F.repeat(letter, (F.col("n_lines") - 1).cast("int")))
    return found.withColumn("right", F.col("states") == expected).withColumn("held_out", _is_held_out())
