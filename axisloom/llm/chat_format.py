"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are (role, whether a turn begins here).  A line emits independent features: the kind of speaker
marker at its head, its length, its last character, and whether it is the first of its row.  Inside a row a turn begins
only where a role's marker stands, so that the lines of a row without one vote on one role together.  Start,
transition and emission probabilities are smoothed counts of labelled transcripts; Viterbi recovers the states.

A transcript comes as rows (conversation, turn, text), in order of turn; its length isn't bounded.  Viterbi is
a product of matrices under (max, +): every row gives a matrix of best scores from the state before it to
the state at its end, blocks of rows multiply theirs, one row per block is chained per conversation, and
the states found at the ends of blocks are carried back to rows and to lines.

Rows are sorted once, in ranges that may end anywhere, also between rows that are equal, so that a conversation
or a turn with any number of rows is dealt to many tasks.  A block is at most ``BLOCK`` rows of one
conversation that follow each other in a range.  No task holds more than a block of rows, or one matrix (392 bytes)
per block of a conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

ROLES = ("system", "user", "assistant")
# Words that announce a speaker.
MARKERS = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "question", "q", "me", "customer"),
    "assistant": ("assistant", "ai", "answer", "a", "bot", "model"),
}
_WORDS = {w: r for r, ws in MARKERS.items() for w in ws}
_MARK = re.compile(r"\s*(?:[\[<(#*|]{0,4}\s*)(" + "|".join(sorted(_WORDS, key=len, reverse=True)) + r")\s*(?:[\])>*|]{0,4}\s*[:\-]|[\])>|]+)\s*", re.IGNORECASE)
_QUOTE = re.compile(r"\s*(?:>|--?)\s+")
#: Rows of a conversation whose matrices are multiplied in one task.
BLOCK = 2048
S = 2 * len(ROLES)
#: The state before a transcript.
START = S
_NEVER = -1e9
_KINDS, _SIZES, _ENDS = 5, 5, 4
#: Added to the code of a row's first line.
_FIRST = _KINDS * _SIZES * _ENDS


def _marker(line: str) -> tuple[int, int]:
    """(kind, length) of the marker at the head of a line: 0 none, 1 to 3 a role's word, 4 a quote sign."""
    m = _MARK.match(line)
    if m:
        return 1 + ROLES.index(_WORDS[m[1].lower()]), m.end()
    m = _QUOTE.match(line)
    return (4, m.end()) if m else (0, 0)


def _observe(line: str) -> tuple[int, int, int]:
    kind, cut = _marker(line)
    size = min(len(line.strip()).bit_length() // 2, _SIZES - 1)
    last = line.rstrip()[-1:]
    end = 0 if not last else 1 if last == "?" else 2 if last in ".!:;" else 3
    return kind, size, end


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _codes(text: str | None) -> bytes:
    """What is observed of the lines of a text, a byte a line."""
    return bytes((k * _SIZES + s) * _ENDS + e + _FIRST * (i == 0) for i, (k, s, e) in enumerate(map(_observe, _lines(text))))


@dataclass(frozen=True)
class ChatModel:
    """Log probabilities: steps (from S states and START to as many), emissions by feature (S x values), and that a
    line is the first of its row (S)."""

    step: np.ndarray
    kind: np.ndarray
    size: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def emission(self, codes: bytes) -> np.ndarray:
        """Log probability of each line's features in each state, and of none in START."""
        o = np.frombuffer(codes, dtype=np.uint8)
        first, o = o >= _FIRST, o % _FIRST
        kind = o // (_SIZES * _ENDS)
        seen = (self.kind[:, kind] + self.size[:, o // _ENDS % _SIZES] + self.end[:, o % _ENDS] + self.first[:, None] * first).T
        seen[:, ::2][~first & ((kind == 0) | (kind == 4))] = _NEVER
        return np.hstack([seen, np.full((len(o), 1), _NEVER)])


def _log(counts: np.ndarray, add: float = 0.5) -> np.ndarray:
    p = counts + add
    return np.log(p / p.sum(axis=-1, keepdims=True))


def _backed(counts: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """_log of the counts of a feature by state, backed by ``prior`` counts spread as the states that begin turns, or those
    that continue them, have it together: a role seldom seen has the lines of the others."""
    out = counts.copy()
    for side in (0, 1):
        pool = counts[side::2].sum(axis=0) + 0.5
        out[side::2] += prior * pool / pool.sum()
    return _log(out, 0.1)


def fit_chat_model(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> ChatModel:
    """Counts over transcripts with known roles; rows of other roles and null texts are left out.

    A row's first line begins a turn of its role, the others continue it.  Steps between rows are counted from a
    turn to the next number (a join on both keys).  Repeated rows count as often as they occur; an empty table gives
    the model of no counts, in which all values of a feature are equally likely.
    """
    known = turns.filter(F.col(role).isin(*ROLES) & F.col(text).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))

    def count(batches):
        totals: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = 2 * ROLES.index(r)
                for i, line in enumerate(_lines(x)):
                    s = k + (i > 0)
                    obs = _observe(line)
                    for what, v in zip(("kind", "size", "end"), obs, strict=True):
                        totals[what, s, v] = totals.get((what, s, v), 0) + 1
                    if i:
                        totals["step", s - (i == 1), s] = totals.get(("step", s - (i == 1), s), 0) + 1
                n = len(_lines(x))
                totals["rows", k + (n > 1), k] = totals.get(("rows", k + (n > 1), k), 0) + 1
        yield pa.RecordBatch.from_pylist([{"what": w, "a": a, "b": b, "n": n} for (w, a, b), n in totals.items()], schema=pa.schema([("what", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    got = known.select("r", "x").mapInArrow(count, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    tables = {"kind": np.zeros((S, _KINDS)), "size": np.zeros((S, _SIZES)), "end": np.zeros((S, _ENDS)), "step": np.zeros((S, S)), "rows": np.zeros((S, S))}
    for r in got:
        tables[r.what][r.a, r.b] += r.n
    multi = F.instr("x", "\n") > 0
    here = known.select("c", "t", F.col("r").alias("r1"), multi.alias("m"))
    after = known.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("r2"))
    for r in here.join(after, ["c", "t"]).groupBy("r1", "m", "r2").count().collect():
        tables["step"][2 * ROLES.index(r.r1) + int(r.m), 2 * ROLES.index(r.r2)] += r["count"]
    start = np.zeros(S)
    first = known.groupBy("c").agg(F.min(F.struct("t", "r")).alias("f")).groupBy("f.r").count()
    for r in first.collect():
        start[2 * ROLES.index(r[0])] += r["count"]
    step = np.full((S + 1, S + 1), _NEVER)
    inside = tables["step"][1::2].sum()
    stay = sum(tables["step"][b, b] for b in range(1, S, 2)) / inside if inside else 0.5
    for b in range(1, S, 2):  # a role seldom seen goes on as the others do
        tables["step"][b - 1 : b + 1, b] += 2 * stay
    step[:S, :S] = _log(tables["step"])
    step[START, :S] = _log(start)
    for k in range(len(ROLES)):  # what the words of MARKERS say before any count
        tables["kind"][2 * k, k + 1] += 2
        tables["kind"][2 * k + 1, 0] += 2
    began = tables["end"].sum(axis=1)
    first = np.where(np.arange(S) % 2 == 0, _log(np.stack([began, 0 * began], axis=1))[:, 0], _log(np.stack([0 * began, began], axis=1))[:, 0])
    # a transcript begins with a turn, and a turn is continued in its own role
    for b in range(1, S, 2):
        for a in range(S + 1):
            if a == START or a // 2 != b // 2:
                step[a, b] = _NEVER
    return ChatModel(step, _log(tables["kind"]), _backed(tables["size"]), _backed(tables["end"]), first)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product under (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


class _Matrices:
    """Row matrices by what is observed; those of short rows, which come again and again, are kept."""

    def __init__(self, model: ChatModel):
        self.model, self.kept = model, {}

    def of(self, codes: bytes) -> np.ndarray:
        found = self.kept.get(codes)
        if found is None:
            e = self.model.emission(codes)
            found = self.model.step + e[0][None, :]
            for x in e[1:]:
                found = _times(found, self.model.step + x[None, :])
            if len(codes) <= 16 and len(self.kept) < 50_000:
                self.kept[codes] = found
        return found


def _ends(entry: int, matrices: list[np.ndarray], leave: int | None) -> list[int]:
    """States at the end of each matrix, on the best path from entry to leave (None: any)."""
    scores = np.full(S + 1, -np.inf)
    scores[entry] = 0.0
    trail = []
    for m in matrices:
        both = scores[:, None] + m
        trail.append(both.argmax(axis=0))
        scores = both.max(axis=0)
    state = int(scores.argmax()) if leave is None else leave
    out = []
    for back in reversed(trail):
        out.append(state)
        state = int(back[state])
    return out[::-1]


def recovered(turns: DataFrame, model: ChatModel, conv: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, turn, text, seen, entry, exit): the states before and at the end of every row on the best path, and what
    was observed of its lines.

    entry is START before a conversation's first row.  Rows are ordered by turn, then by a digest of the text; rows
    that repeat are lines said again.  Null texts are one empty line.  Of equally good paths the one with the
    lower states, from the end on, is taken.  Rows with a null conversation or turn belong to no transcript and
    aren't in the result.  An empty table gives an empty result; other columns are ignored.
    """
    shared = turns.sparkSession.sparkContext.broadcast(model)
    rows = turns.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text).alias("x"))
    order = ["c", "t", "h", "u"]
    ranges = rows.withColumns({"h": F.xxhash64("x"), "u": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    kc, kt = turns.schema[conv].dataType, turns.schema[turn].dataType
    dealt = T.StructType([T.StructField("c", kc), T.StructField("t", kt), T.StructField("x", T.StringType()), T.StructField("o", T.BinaryType()), T.StructField("b", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])

    def deal(batches):
        """Every row with its block, and one more row with the product of each block."""
        mats = _Matrices(shared.value)
        b, size, m, last = TaskContext.get().partitionId() << 40, 0, None, None
        for batch in batches:
            seen, blocks, closed, convs = [], [], [], batch.column(0).to_pylist()
            for c, x in zip(convs, batch.column(2).to_pylist(), strict=True):
                if size and (c != last or size == block):
                    closed.append((last, b, m))
                    b, size, m = b + 1, 0, None
                codes = _codes(x)
                one = mats.of(codes)
                m, size, last = one if m is None else _times(m, one), size + 1, c
                seen.append(codes)
                blocks.append(b)
            none = pa.nulls(len(convs), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(seen, pa.binary()), pa.array(blocks, pa.int64()), none], dealt.names)
            yield ends_of(closed, batch.schema)
        if size:
            yield ends_of([(last, b, m)], batch.schema)

    def ends_of(closed, schema):
        n = len(closed)
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in closed], schema.field(0).type), pa.nulls(n, schema.field(1).type), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array([b for _, b, _ in closed], pa.int64()), pa.array([m.reshape(-1).tolist() for *_, m in closed], pa.list_(pa.float64()))], dealt.names)

    dealt_rows = stored(ranges.select("c", "t", "x").mapInArrow(deal, dealt), "turns")
    ends = T.StructType([T.StructField("c", kc), T.StructField("b", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType())])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        mats = [np.array(m).reshape(S + 1, S + 1) for m in table.column("m").to_pylist()]
        states = _ends(START, mats, None)
        return pa.table({"c": table.column("c"), "b": table.column("b"), "entry": pa.array([START, *states[:-1]], pa.int32()), "leave": pa.array(states, pa.int32())})

    found = dealt_rows.filter("m is not null").select("c", "b", "m").groupBy("c").applyInArrow(chain, ends).select("b", "entry", "leave")
    out = T.StructType([T.StructField("c", kc), T.StructField("t", kt), T.StructField("x", T.StringType()), T.StructField("o", T.BinaryType()), T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType())])

    def carry(table: pa.Table) -> pa.Table:
        # rows of one turn in the order in which they were dealt: that of their digests
        table = table.sort_by([("t", "ascending"), ("h", "ascending")])
        mats = _Matrices(shared.value)
        entry, leave = table.column("entry")[0].as_py(), table.column("leave")[0].as_py()
        states = _ends(entry, [mats.of(o) for o in table.column("o").to_pylist()], leave)
        return pa.table({"c": table.column("c"), "t": table.column("t"), "x": table.column("x"), "o": table.column("o"), "entry": pa.array([entry, *states[:-1]], pa.int32()), "leave": pa.array(states, pa.int32())})

    carried = dealt_rows.filter("m is null").select("c", "t", "x", "o", "b", F.xxhash64("x").alias("h")).join(found, "b").groupBy("b").applyInArrow(carry, out)
    return carried.select(F.col("c").alias(conv), F.col("t").alias(turn), F.col("x").alias(text), F.col("o").alias("seen"), "entry", F.col("leave").alias("exit"))


def formatted(turns: DataFrame, model: ChatModel, conv: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, turn, role, roles, rendered): for every row the role of its last line, the roles of the turns
    that it holds lines of, and its canonical text.

    Every turn that begins in a row opens with ``<|role|>`` on a line of its own; the turn before it is closed
    with ``<|end|>`` first.  Rows in order of turn, joined by line feeds, are the conversation (its last turn
    open).  Markers are taken off the lines that begin a turn.  Rows with a null conversation or turn keep
    their text as it is and have no role; for the rest recovered() says what nulls, repeats and ties give.
    """
    shared = turns.sparkSession.sparkContext.broadcast(model)
    found = recovered(turns, model, conv, turn, text, block)
    out = T.StructType([turns.schema[conv], turns.schema[turn], T.StructField("role", T.StringType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("rendered", T.StringType())])

    def render(batches):
        model = shared.value
        for batch in batches:
            last, roles, texts = [], [], []
            for x, codes, entry, leave in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                states = [leave] if len(codes) == 1 else _ends(entry, [model.step + e[None, :] for e in model.emission(codes)], leave)
                parts, held, before = [], [], entry
                for line, s in zip(_lines(x), states, strict=True):
                    if s % 2 == 0:
                        if before != START:
                            parts.append("<|end|>")
                        parts.append(f"<|{ROLES[s // 2]}|>")
                        held.append(ROLES[s // 2])
                        line = line[_marker(line)[1] :]
                    elif not held:
                        held.append(ROLES[s // 2])
                    parts.append(line)
                    before = s
                last.append(ROLES[states[-1] // 2])
                roles.append(held)
                texts.append("\n".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(last, pa.string()), pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.string())], out.names)

    loose = turns.filter(F.col(conv).isNull() | F.col(turn).isNull()).select(F.col(conv), F.col(turn), F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("roles"), F.coalesce(F.col(text), F.lit("")).alias("rendered"))
    return found.mapInArrow(render, out).union(loose)


def marked(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Raw transcripts of a conversation table: the role becomes a marker at the head of the text, in a style
    drawn by the keys, and is left out of every fourth row."""
    draw: Column = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(conv).cast("string"), F.col(turn).cast("string"))), 1, 4), 16, 10).cast("int")
    word = F.lit("")
    for r in ROLES:
        words = F.array(*[F.lit(w) for w in MARKERS[r]])
        word = F.when(F.col(role) == r, F.initcap(F.element_at(words, (F.floor(draw / 4) % len(MARKERS[r]) + 1).cast("int")))).otherwise(word)
    style = F.when(draw % 3 == 0, F.concat(word, F.lit(": "))).when(draw % 3 == 1, F.concat(F.lit("["), word, F.lit("] "))).otherwise(F.concat(F.lit("### "), word, F.lit(": ")))
    return turns.withColumn(text, F.when((draw % 4 == 0) | (word == "") | F.col(text).isNull(), F.col(text)).otherwise(F.concat(style, F.col(text))))
