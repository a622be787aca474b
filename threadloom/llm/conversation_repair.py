"""Conversations damaged by a fixed rule, their faults counted and repaired by the cheapest edits.

Repair is a shortest path. A state says what a conversation may continue with: nothing yet
(START), a system row (OPENED), a user row (ASKED) or an assistant row (ANSWERED); a walk
ends in START or ANSWERED. Each row is kept, given the role that the state asks for, or
deleted, and rows may be inserted before it. The state-cost vector at a row holds the least
cost to the end from each state. Vectors are made backward and stored only at checkpoints, a
square root of the rows apart; walking forward, a block's vectors are made again from its
checkpoint, and the least letter whose edit is tight is taken. Rows decide the rest of an
edit: the state fixes the role of an inserted or changed row.

Rows are dealt in the order of conversation, turn, role and text by ranges, so a conversation of any
length runs on over many tasks. Where one does, each task's stretch of it is first made a
4 x 4 matrix of least costs between states, the matrices give the vectors at the stretches'
ends, these the state that each stretch leaves from each one it enters, and with both known
all stretches are walked at once. What is put together for a conversation then is one row a
stretch and up to ``CHUNK`` characters of its text, read in order and hashed as a stream, as
SHA-256 takes its input in order. Two rows a task at most, each a matrix or a state, travel
by broadcast.

Whether a role and text were seen earlier isn't found by gathering equal rows either: the
least turn of each is an aggregate, and a mark is dealt to the place of the first such row.

Defined results: a null role or text is one space, as are null ids and turns in the damage
rule; a null id is a conversation; rows of one turn go by role and then by digest of text;
repeated rows are duplicates; a role that isn't one of system, user and assistant has its
own initial, and an empty one an empty initial; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import inf, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WORD_SPACE, cut

START, OPENED, ASKED, ANSWERED = range(4)
DELETE, INSERT, TRUNCATED, REROLE = 2, 5, 5, 1
#: Where a kept row of each initial leads from each state, if it may follow.
KEPT = {"s": {START: OPENED}, "u": {START: ASKED, OPENED: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
#: Where an inserted or changed row leads: a user's turn but after a user's.
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
INITIALS = ("s", "u", "a", "")
#: Costs to an end that needs no more rows.
END = (0, 2 * INSERT, INSERT, 0)
CHUNK = 1 << 18

Vector = tuple[float, float, float, float]


def coded(initial: int, must_go: bool, cut_off: bool) -> int:
    """A row as a small number: its initial's place in INITIALS, whether it must be deleted, whether it is truncated."""
    return initial + 4 * must_go + 8 * cut_off


def edits(code: int, state: int) -> list[tuple[str, float, int]]:
    """(letter, cost, next state) of the edits of a row, in order of letters."""
    out: list[tuple[str, float, int]] = [("D", DELETE, state)]
    if not code & 4:
        more = TRUNCATED if code & 8 else 0
        kept = KEPT.get(INITIALS[code & 3], {})
        if state in kept:
            out.append(("K", more, kept[state]))
        out.append(("R", more + REROLE, NEXT[state]))
    return out


EDITS = [[edits(code, s) for s in range(4)] for code in range(16)]


def inserted(v: Vector) -> Vector:
    """The least costs where rows may be inserted first."""
    asked = min(v[ASKED], INSERT + v[ANSWERED])
    answered = min(v[ANSWERED], INSERT + v[ASKED])
    return min(v[START], INSERT + asked), min(v[OPENED], INSERT + asked), asked, answered


def before(code: int, v: Vector) -> Vector:
    """The vector before a row, from the one after it."""
    return inserted(tuple(min(cost + v[to] for _, cost, to in EDITS[code][s]) for s in range(4)))  # type: ignore[arg-type]


STEPS = np.array([[before(code, tuple(0 if s == t else inf for s in range(4))) for t in range(4)] for code in range(16)]).transpose(0, 2, 1)  # type: ignore[arg-type]


def matrix(codes: bytes) -> np.ndarray:
    """Least costs from each state before the rows to each one after them."""
    out = np.where(np.eye(4, dtype=bool), 0.0, inf)
    for at in range(0, len(codes), 1 << 14):
        m = STEPS[np.frombuffer(codes[at : at + (1 << 14)], np.uint8)]
        while len(m) > 1:
            odd = m[-1:] if len(m) % 2 else m[:0]
            m = np.concatenate([(m[0 : len(m) - 1 : 2, :, :, None] + m[1::2, None, :, :]).min(2), odd])
        out = (out[:, :, None] + m[0][None, :, :]).min(1)
    return out


def repaired(codes: bytes, state: int, end: Vector, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits from ``state``, and the state they lead to; ``last``: no row follows, so that rows may be inserted after all.

    ``end``: least costs after the last row. Vectors are kept a square root of the rows apart.
    """
    n = len(codes)
    step = isqrt(n) + 1
    marks = {n: end}
    v = end
    for i in range(n - 1, -1, -1):
        v = before(codes[i], v)
        if i % step == 0:
            marks[i] = v
    out: list[str] = []
    for low in range(0, n, step):
        high = min(n, low + step)
        block = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(before(codes[i], block[-1]))
        block.reverse()
        for i in range(low, high):
            here, after = block[i - low], block[i - low + 1]
            while True:
                letters = EDITS[codes[i]][state]
                left = here[state]
                if letters[0][1] + after[letters[0][2]] == left:
                    take = letters[0]
                elif INSERT + here[NEXT[state]] == left:
                    out.append("I")
                    state = NEXT[state]
                    continue
                else:
                    take = next(e for e in letters if e[1] + after[e[2]] == left)
                out.append(take[0])
                state = take[2]
                break
    while last and state in (OPENED, ASKED):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


_short = lru_cache(1 << 15)(repaired)


def walked(codes: bytes, state: int, end: Vector, last: bool) -> tuple[str, int]:
    """``repaired``, remembered for short conversations."""
    return (_short if len(codes) <= 64 else repaired)(codes, state, end, last)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` after the damage: conv_id, turn, role, text and ``copies`` (0: dropped, kept as a place of its conversation)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _code(role: Column, bare: Column) -> Column:
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (place + F.when(bare == "", 4).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(8)).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    """Damaged rows and marks of first occurrences, sorted, with the task that holds them as ``stretch``."""
    key = ["conv_id", "turn", "role", "digest"]
    rows = damaged(rows).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    bare = F.trim(F.translate(F.col("text"), WORD_SPACE, " " * len(WORD_SPACE)))
    rows = rows.withColumn("code", _code(F.col("role"), bare))
    live = rows.filter("copies > 0 and (code < 4 or code >= 8)")
    first = live.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    marks = first.select("conv_id", F.col("least.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"), F.lit(-1).alias("copies"), "digest", F.lit(0).alias("code"))
    both = rows.select("conv_id", "turn", "role", "text", "copies", "digest", "code").union(marks)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order, "copies")
    return cut(dealt.select(*key, "text", "copies", "code", F.spark_partition_id().alias("stretch")))


class Stretch:
    """Rows of one conversation that follow each other in one task, as they are read."""

    def __init__(self, conv: object, entry: int, end: Vector, last: bool, runs_on: bool) -> None:
        self.conv, self.entry, self.end, self.last, self.runs_on = conv, entry, end, last, runs_on
        self.codes = bytearray()
        self.rows: list[tuple[str, str]] = []
        self.faults = [0, 0, 0]  # blank, duplicate, truncated
        self.illegal = self.turns = 0
        self.first = self.least = self.most = None
        self.before: str | None = None
        self.mark: tuple | None = None

    def read(self, turn: int | None, role: str, digest: bytes, text: str | None, copies: int, code: int) -> None:
        key = (turn, role, digest)
        if copies < 0:
            self.mark = key
            return
        for _ in range(copies):
            as_found = code
            if code & 4:
                self.faults[0] += 1
            elif self.mark == key:
                self.mark = None
                self.faults[2] += code >> 3
            else:
                self.faults[1] += 1
                as_found |= 4
            initial = role[:1]
            if self.before is None:
                self.first = initial
            else:
                self.illegal += self.before + initial not in ("su", "ua", "au")
            self.before = initial
            if turn is not None:
                if turn != self.most:
                    self.turns += 1
                    self.most = turn
                self.least = turn if self.least is None else self.least
            self.codes.append(as_found)
            self.rows.append((role, text or ""))

    def result(self) -> tuple[str, int, Iterator[str]]:
        """Audit, cost and the repaired rows, each with a line break before it."""
        audit, _ = walked(bytes(self.codes), self.entry, self.end, self.last)
        return audit, *self._texts(audit)

    def _texts(self, audit: str) -> tuple[int, Iterator[str]]:
        cost, state, i, out = 0, self.entry, 0, []
        for letter in audit:
            if letter == "I":
                cost += INSERT
                out.append("\nuser:" if NEXT[state] == ASKED else "\nassistant:")
                state = NEXT[state]
                continue
            _, price, to = next(e for e in EDITS[self.codes[i]][state] if e[0] == letter)
            cost += price
            if letter != "D":
                role = self.rows[i][0] if letter == "K" else "user" if to == ASKED else "assistant"
                out.append(f"\n{role}:{self.rows[i][1]}")
            state = to
            i += 1
        return cost, iter(out)


def _stretches(batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[tuple[Stretch, int, bool]]:
    """(stretch of a conversation, task, whether it begins the task) in order; ``known``: entry, end and last come with the rows."""
    now, at, opens = None, -1, True
    for b in batches:
        for row in b.to_pylist():
            conv = (row["conv_id"],)
            if now is None or now.conv != conv:
                if now is not None:
                    yield now, at, opens
                    opens = False
                at = row["stretch"]
                if known and row["entry"] is not None:
                    now = Stretch(conv, row["entry"], tuple(row["ends"]), row["last"], True)
                else:
                    now = Stretch(conv, START, END, True, False)
            now.read(row["turn"], row["role"], row["digest"], row["text"], row["copies"], row["code"])
    if now is not None:
        yield now, at, opens


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of the first and the last conversation of a task: only these may run on in another one."""
    ahead = None

    def row(s: Stretch, at: int) -> pa.RecordBatch:
        m = matrix(bytes(s.codes)).reshape(-1).tolist()
        return pa.RecordBatch.from_pylist([{"conv_id": s.conv[0], "stretch": at, "costs": m}], schema=pa.schema([("conv_id", pa.int64()), ("stretch", pa.int32()), ("costs", pa.list_(pa.float64()))]))

    for s, at, opens in _stretches(batches, False):
        s.rows.clear()
        if opens:
            yield row(s, at)
        ahead = None if opens else (s, at)
    if ahead is not None:
        yield row(*ahead)


def _ends(edges: pd.DataFrame) -> pd.DataFrame:
    """Least costs at the end of each stretch of a conversation: a row a task."""
    edges = edges.sort_values("stretch")
    v, ends = np.array(END, float), []
    for costs in reversed(edges["costs"].tolist()):
        ends.append(v.tolist())
        v = (np.asarray(costs).reshape(4, 4) + v[None, :]).min(1)
    ends.reverse()
    last = [False] * (len(edges) - 1) + [True]
    return pd.DataFrame({"conv_id": edges["conv_id"], "stretch": edges["stretch"], "ends": ends, "last": last})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each stretch is left from each one that it may be entered in."""
    for s, at, _ in _stretches(batches, True):
        exits = [walked(bytes(s.codes), e, s.end, s.last)[1] for e in range(4)]
        kinds = [("conv_id", pa.int64()), ("stretch", pa.int32()), ("ends", pa.list_(pa.float64())), ("last", pa.bool_()), ("exits", pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_pylist([{"conv_id": s.conv[0], "stretch": at, "ends": list(s.end), "last": s.last, "exits": exits}], schema=pa.schema(kinds))


def _entries(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.sort_values("stretch")
    state, entries = START, []
    for exits in edges["exits"].tolist():
        entries.append(state)
        state = int(exits[state])
    return pd.DataFrame({"conv_id": edges["conv_id"], "stretch": edges["stretch"], "ends": edges["ends"], "last": edges["last"], "entry": entries})


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("stretch", pa.int32()), ("chunk", pa.int32()), ("open", pa.bool_()), ("audit", pa.string()), ("text", pa.string()), ("sha", pa.string())]
    + [(c, pa.int64()) for c in [*COUNTS, "turns", "least", "most"]] + [("first", pa.string()), ("final", pa.string())]
)
_PIECE_SQL = "conv_id long, stretch int, chunk int, open boolean, audit string, text string, sha string, " + ", ".join(f"{c} long" for c in [*COUNTS, "turns", "least", "most"]) + ", first string, final string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation; one that runs on over several tasks is ``open`` and comes in chunks of text."""
    out: list[dict] = []

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pylist(out, schema=_PIECE)
        out.clear()
        return made

    for s, at, _ in _stretches(batches, True):
        audit, cost, texts = s.result()
        row = dict(zip(COUNTS, [*s.faults, s.illegal, cost]), turns=s.turns, least=s.least, most=s.most, first=s.first, final=s.before)
        row |= {"conv_id": s.conv[0], "stretch": at, "chunk": 0, "audit": audit, "open": s.runs_on}
        if not row["open"]:
            digest = hashlib.sha256("".join(texts)[1:].encode("utf-8", "surrogatepass")).hexdigest()
            out.append(row | {"sha": digest})
        else:
            kept, size, chunk = [], 0, 0
            for t in texts:
                kept.append(t)
                size += len(t)
                if size >= CHUNK:
                    out.append((row if not chunk else {k: row[k] for k in ("conv_id", "stretch", "open")}) | {"chunk": chunk, "text": "".join(kept)})
                    kept, size, chunk = [], 0, chunk + 1
                    yield flushed()
            out.append((row if not chunk else {k: row[k] for k in ("conv_id", "stretch", "open")}) | {"chunk": chunk, "text": "".join(kept)})
        if len(out) >= 1000:
            yield flushed()
    yield flushed()


_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_RESULT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its chunks in order; texts are hashed as they come and not kept."""
    schema = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in _RESULT])
    now: dict | None = None

    def done(x: dict) -> pa.RecordBatch:
        gaps = x["most"] - x["least"] + 1 - x["turns"] if x["most"] is not None else 0
        row = {c: x[c] for c in COUNTS} | {"conv_id": x["conv_id"], "gaps": gaps, "audit": "".join(x["audit"]), "repaired_sha256": x["hash"].hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for b in batches:
        for r in b.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield done(now)
                now = {c: 0 for c in [*COUNTS, "turns"]} | {"conv_id": r["conv_id"], "least": None, "most": None, "final": None, "audit": [], "hash": hashlib.sha256(), "begun": False}
            if r["chunk"] == 0:
                for c in COUNTS:
                    now[c] += r[c]
                if r["most"] is not None:
                    now["turns"] += r["turns"] - (now["most"] == r["least"])  # a turn may lie on both sides of a border
                    now["least"] = r["least"] if now["least"] is None else now["least"]
                    now["most"] = r["most"]
                if r["first"] is not None:
                    now["illegal"] += now["final"] is not None and now["final"] + r["first"] not in ("su", "ua", "au")
                    now["final"] = r["final"]
                now["audit"].append(r["audit"])
            if r["text"]:
                now["hash"].update((r["text"] if now["begun"] else r["text"][1:]).encode("utf-8", "surrogatepass"))
                now["begun"] = True
    if now is not None:
        yield done(now)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, the faults, illegal neighbours, cost and letters of the cheapest edits, and the repaired text's digest."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    table = placed(rows)
    slim = table.withColumn("text", F.lit(""))
    edge = cut(slim.mapInArrow(_edges, "conv_id long, stretch int, costs array<double>"))
    several = edge.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1")
    edge = edge.join(several, edge["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
    ends = cut(edge.groupBy("conv_id").applyInPandas(_ends, "conv_id long, stretch int, ends array<double>, last boolean"))

    def known(rows: DataFrame, info: DataFrame, how: str) -> DataFrame:
        info = info.withColumnRenamed("conv_id", "of").withColumnRenamed("stretch", "task")
        met = (F.col("stretch") == F.col("task")) & F.col("conv_id").eqNullSafe(F.col("of"))
        return rows.join(F.broadcast(info), met, how).drop("of", "task")

    exits = known(slim, ends.withColumn("entry", F.lit(START)), "inner").mapInArrow(_exits, "conv_id long, stretch int, ends array<double>, last boolean, exits array<int>")
    entries = cut(exits.groupBy("conv_id").applyInPandas(_entries, "conv_id long, stretch int, ends array<double>, last boolean, entry int"))
    made = cut(known(table, entries, "left").mapInArrow(_pieces, _PIECE_SQL))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    whole = made.filter("not open").select("conv_id", gaps, *COUNTS, "audit", F.col("sha").alias("repaired_sha256"))
    order = ["conv_id", "stretch", "chunk"]
    joined = made.filter("open").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_joined, _RESULT_SQL)
    return whole.select(*_RESULT).union(joined.select(*_RESULT))
