"""Conversation structure repair by rank-compressed dynamic programming.

A conversation's turns are the layers of a shortest-path search whose states are what the repaired turns end in: nothing,
system, user or assistant.  A move is a macro edit: a run of inserted turns and then the edit of the layer's own turn
(delete, keep, rerole).  As written letters, D, ID, IID, IIK, ..., the macro edits are a prefix-free code, so two audits of
as many layers compare as their first different macro edits do.  A layer therefore keeps no audit strings: a state has its
cost, the rank of its audit among those of its layer (dense ranks of pairs: rank of the parent, macro edit) and one byte
that points to the parent.  Audits and repaired turns are reconstructed afterwards, from the end.

Turns are sorted through all partitions by range, so that a conversation of any size is spread over tasks.  One that lies
within a task's rows is repaired there.  The first and last conversation of a task may go on in its neighbours: their parts
are solved from each possible state to each (sixteen lanes with common ranks), a second search of the same kind goes over
these small summaries, and each part is then reconstructed by itself.  Only the hash of the repaired text, which is
sequential, and the audit, which is one string, are put together in one task, part by part.

Defined results: null cells count as one space, in the damaged text and in the damage's key; a null conv_id is a
conversation, a null turn comes first and has no part in gaps.  Rows of a turn are ordered by role, the text's first 64
characters and its MD5 sum; repeated rows stay, and all but one are duplicates.  Other roles than those that begin with s,
u or a (in lower case) can't be kept.  A conversation without rows after damage has zeros, an empty audit and the hash of
an empty text; no rows give no rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
TAILS = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}  # the insertions that make a state an end
LIVE, BLANK, DUPLICATE, CUT, GONE = range(5)
WHITE = " \t\n\x0b\x0c\r"


def inserted(state: int) -> int:
    """The state after an inserted turn: there is one role that may follow."""
    return ASSISTANT if state == USER else USER


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state, next state, cost, code): the best macro edit between each two states, over a turn."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        at = state
        for n in range(3):
            edits = [("D", at, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                edits.append(("R", inserted(at), REROLE + more))
                if (at, initial) in NEXT:
                    edits.append(("K", NEXT[at, initial], more))
            for edit, to, cost in edits:
                move = (INSERT * n + cost, CODES.index("I" * n + edit))
                best[state, to] = min(best.get((state, to), move), move)
            at = inserted(at)
    return [(p, q, *move) for (p, q), move in best.items()]


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in (LIVE, BLANK, DUPLICATE, CUT)}


class Search:
    """Lanes by (entry, state), each with the cost and rank of its best audit; a byte a lane and layer points back."""

    def __init__(self, entries: list[int]) -> None:
        self.entries = entries
        self.lanes = {(e, e): (0, 0) for e in entries}
        self.back = bytearray()

    def layer(self, moves: list[tuple[int, int, int, int]]) -> None:
        new: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for e in self.entries:
            for p, q, cost, code in moves:
                lane = self.lanes.get((e, p))
                if lane is not None:
                    found = (lane[0] + cost, lane[1], code, p)
                    if (e, q) not in new or found < new[e, q]:
                        new[e, q] = found
        ranks = {x: r for r, x in enumerate(sorted({(rank, code) for _, rank, code, _ in new.values()}))}
        self.lanes = {lane: (cost, ranks[rank, code]) for lane, (cost, rank, code, _) in new.items()}
        row = bytearray(4 * len(self.entries))
        for (e, q), (_, _, code, p) in new.items():
            row[4 * self.entries.index(e) + q] = p << 4 | code
        self.back += row


def walk(back: bytes, entries: list[int], entry: int, end: int) -> list[int]:
    """The macro edits of the best audit from entry to end, by the pointers of a search."""
    width, lane = 4 * len(entries), 4 * entries.index(entry)
    codes, state = [], end
    for at in range(len(back) - width, -1, -width):
        b = back[at + lane + state]
        codes.append(b & 15)
        state = b >> 4
    return codes[::-1]


def rebuild(codes: list[int], turns: list[tuple[str, str]], state: int, tail: str = "") -> tuple[str, list[str]]:
    """(audit, repaired lines) of turns (role, text) by their macro edits, from a state."""
    lines = []
    for code, (role, text) in zip(codes, turns):
        for letter in CODES[code]:
            if letter == "I":
                state = inserted(state)
                lines.append(ROLES[state] + ":")
            elif letter == "R":
                state = inserted(state)
                lines.append(f"{ROLES[state]}:{text}")
            elif letter == "K":
                state = NEXT[state, role[:1]]
                lines.append(f"{role}:{text}")
    for _ in tail:
        state = inserted(state)
        lines.append(ROLES[state] + ":")
    return "".join(CODES[c] for c in codes) + tail, lines


def ending(lanes: dict[tuple[int, int], tuple[int, int]]) -> tuple[int, int]:
    """(cost, state) of the best end from the empty state."""
    cost, _, _, state = min((cost + INSERT * len(TAILS[q]), rank, TAILS[q], q) for (e, q), (cost, rank) in lanes.items() if e == EMPTY)
    return cost, state


@dataclass
class Counts:
    """What is counted of a run of turns, and what its neighbours need to know."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.join(Counts(1, fault == BLANK, fault == DUPLICATE, fault == CUT, 0, turn is not None, turn, turn, initial, initial))

    def join(self, then: Counts) -> None:
        """Count the turns that come next, too."""
        if not then.rows:
            return
        if self.rows:
            self.illegal += self.last + then.first not in ("su", "ua", "au")
        else:
            self.first = then.first
        self.illegal += then.illegal
        self.distinct += then.distinct - (self.high is not None and self.high == then.low)
        for name in ("rows", "blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(then, name))
        self.last = then.last
        self.low = then.low if self.low is None else self.low
        self.high = self.high if then.high is None else then.high

    def report(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


COUNTED = ["rows", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last"]
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART = "part long, costs array<long>, ranks array<long>, back binary, roles array<string>, texts array<string>, " + ", ".join(f"c_{c} {'string' if c in ('first', 'last') else 'long'}" for c in COUNTED)


# ---------------------------------------------------------------------------------------------- turns
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after the contract's damage; a dropped row stays as one that is gone."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", cell("conv_id"), cell("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), cell("role").alias("role"), cell("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def faults(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with a row id, the text's key and its first fault.

    A row is a duplicate if the first row of its conversation, role and text, found by an aggregation, is another one."""
    bare: Column = F.rtrim(F.col("text"), F.lit(WHITE))
    own = F.when(F.col("gone"), GONE).when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(LIVE)
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = C.table(spark, turns.select("*", own.alias("own"), key.alias("key")).withColumn("row", F.monotonically_increasing_id()), "turns")
    live = rows.where(F.col("own").isin(LIVE, CUT)).select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "turn", "row")
    first = live.groupBy("of", "same").agg(F.min(F.struct("turn", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").select("of", "same", F.col("first.row").alias("first_row"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same")), "left")
    later = F.col("own").isin(LIVE, CUT) & F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return joined.select("conv_id", "turn", "role", "text", "key", "row", F.when(later, DUPLICATE).otherwise(F.col("own")).alias("fault"))


# ---------------------------------------------------------------------------------------------- parts of conversations
@dataclass
class Run:
    """A conversation's turns in a task."""

    conv: int | None
    turns: list[tuple[str, str]] = field(default_factory=list)
    layers: list[tuple[str, int]] = field(default_factory=list)
    counts: Counts = field(default_factory=Counts)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if fault != GONE:
            self.turns.append((role, text))
            self.layers.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
            self.counts.add(turn, role[:1], fault)

    def search(self, entries: list[int]) -> Search:
        s = Search(entries)
        for layer in self.layers:
            s.layer(MOVES[layer])
        return s

    def whole(self) -> tuple:
        """The conversation's row of results."""
        s = self.search([EMPTY])
        cost, end = ending(s.lanes)
        audit, lines = rebuild(walk(s.back, [EMPTY], EMPTY, end), self.turns, EMPTY, TAILS[end])
        return self.conv, *self.counts.report(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()

    def part(self, number: int) -> tuple:
        """What a later search over parts needs, and what rebuilding this one does."""
        s = self.search([*range(4)])
        lanes = [s.lanes.get((e, q)) for e in range(4) for q in range(4)]
        return (
            self.conv, number, [x and x[0] for x in lanes], [x and x[1] for x in lanes], bytes(s.back),
            [r for r, _ in self.turns], [t for _, t in self.turns], *(getattr(self.counts, c) for c in COUNTED),
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


_REPORT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_PART = pa.schema([
    ("part", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("back", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    *((f"c_{c}", pa.string() if c in ("first", "last") else pa.int64()) for c in COUNTED),
])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to results of whole conversations, and parts of the first and last one of the task."""
    task, run, opened = TaskContext.get().partitionId(), None, 0
    done: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal opened
        if opened == 0 or last:
            done.append((*(None,) * 9, *run.part(2 * task + (opened > 0))))
            opened += 1
        else:
            done.append((*run.whole(), *(None,) * (len(_PART) + 1)))

    schema = pa.schema([*_REPORT, ("of", pa.int64()), *_PART])
    for b in batches:
        for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns)):
            if run is None or run.conv != conv:
                if run is not None:
                    close(False)
                run = Run(conv)
            run.add(turn, role, text, fault)
        yield _batch(done, schema)
        done.clear()
    if run is not None:
        close(True)
        yield _batch(done, schema)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted summaries of parts to the states between them: of, part, entry, leave, tail, cost and the whole counts."""
    schema = pa.schema([("of", pa.int64()), ("part", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("tail", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))])

    def solve(conv: int | None, rows: list[dict]) -> pa.RecordBatch:
        lanes, back, counts = {EMPTY: (0, 0)}, [], Counts()
        for r in rows:
            counts.join(Counts(*(r[f"c_{c}"] for c in COUNTED)))
            new: dict[int, tuple] = {}
            for p, (cost, rank) in lanes.items():
                for q in range(4):
                    if r["costs"][4 * p + q] is not None:
                        found = (cost + r["costs"][4 * p + q], rank, r["ranks"][4 * p + q], p)
                        new[q] = min(new.get(q, found), found)
            ranks = {x: k for k, x in enumerate(sorted({f[1:3] for f in new.values()}))}
            lanes = {q: (f[0], ranks[f[1:3]]) for q, f in new.items()}
            back.append({q: f[3] for q, f in new.items()})
        cost, state = ending({(EMPTY, q): x for q, x in lanes.items()})
        out, tail = [], TAILS[state]
        for r, parents in zip(reversed(rows), reversed(back)):
            out.append((conv, r["part"], parents[state], state, tail, *counts.report(), cost))
            state, tail = parents[state], ""
        return _batch(out[::-1], schema)

    conv, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if rows and r["of"] != conv:
                yield solve(conv, rows)
                rows = []
            conv = r["of"]
            rows.append(r)
    if rows:
        yield solve(conv, rows)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their states to their pieces of the audit and of the repaired text (null without a line)."""
    for b in batches:
        audits, texts = [], []
        for r in b.select(["entry", "leave", "tail", "back", "roles", "texts"]).to_pylist():
            audit, lines = rebuild(walk(r["back"], [*range(4)], r["entry"], r["leave"]), list(zip(r["roles"], r["texts"])), r["entry"], r["tail"])
            audits.append(audit)
            texts.append("\n".join(lines) if lines else None)
        kept = ["of", "part", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(audits, pa.string()), pa.array(texts, pa.string())], [*kept, "audit", "repaired"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to results: the hash goes on from piece to piece."""
    now, audit, sha, begun = None, [], None, False

    def result() -> tuple:
        return now["of"], *(now[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "".join(audit), sha.hexdigest()

    for b in batches:
        done = []
        for r in b.to_pylist():
            if now is None or now["of"] != r["of"]:
                if now is not None:
                    done.append(result())
                now, audit, sha, begun = r, [], hashlib.sha256(), False
            audit.append(r["audit"])
            if r["repaired"] is not None:
                sha.update((("\n" if begun else "") + r["repaired"]).encode())
                begun = True
        yield _batch(done, _REPORT)
    if now is not None:
        yield _batch([result()], _REPORT)


def repair(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The report of every conversation of turns (conv_id, turn, role, text, gone)."""
    rows = faults(spark, turns)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("key"), F.asc("row")]
    dealt = rows.withColumn("head", F.substring("text", 1, 64)).repartitionByRange(*order).sortWithinPartitions(*order)
    both = C.table(spark, map_arrow(dealt.select("conv_id", "turn", "role", "text", "fault"), _tables, f"{REPORT}, of long, {PART}"), "repaired")
    names = _REPORT.names
    parts = both.where("part is not null").drop(*names)
    by_conv = ["of", "part"]
    summaries = parts.select("of", "part", "costs", "ranks", *(f"c_{c}" for c in COUNTED)).repartition("of").sortWithinPartitions(*by_conv)
    states = C.table(spark, map_arrow(summaries, _chained, "of long, part long, entry long, leave long, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"), "states")
    found = parts.select("part", "back", "roles", "texts").join(states, "part")
    pieces = map_arrow(found, _rebuilt, "of long, part long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string")
    across = map_arrow(pieces.repartition("of").sortWithinPartitions(*by_conv), _joined, REPORT)
    return both.where("part is null").select(*names).union(across)


def op13_ranked_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark, damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
