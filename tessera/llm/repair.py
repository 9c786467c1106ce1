"""Conversation structure repair by a lazily determinised weighted automaton.

The roles of a repaired conversation read `(s?(ua)+)?`: four automaton states (nothing yet, after system, after user, after
assistant). Read from the last row back to the first, the costs of reaching the end from each of them are a vector; less its least
entry, it is one of a few vectors, and each of these is a state of a deterministic automaton. Its arcs are worked out when they
are first met and kept in a table, so costs come from a scan of the table. The trace goes back over the scan, which is
the order of the rows, along tight arcs, and takes the least letter where several are tight.

Rows are dealt over tasks by a range sort of conversation and turn, so a conversation of any length is dealt over many. One
that lies within a task is settled there. Those that reach a task's edge (two a task at most) are cut into units: of
each unit the arcs are composed for every state, units are chained by these few numbers, and then each is traced by itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

WHITE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what an undeleted truncated row adds.
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row, whichever may follow, and after a row that is kept, by the initial of its role.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}

FAULTS = ("", "blank", "duplicate", "truncated")
#: Symbols: 0, a row that must go; else 1 + 2 * (place of its role's initial, 3 for others) + (1 if truncated).
SYMBOLS = 9

#: Rows of a unit of a conversation that reaches a task's edge; characters of a piece of its repaired text.
UNIT_ROWS, PIECE = 1 << 16, 1 << 14


class Arc(NamedTuple):
    """From the vector after a row to the one before it: its number, the cost taken out, and by state the edits and the state after the row."""

    to: int
    cost: int
    edits: tuple[str, ...]
    after: tuple[int, ...]


class Automaton:
    """States are normalised vectors of costs to the end; arcs are worked out when asked for the first time."""

    def __init__(self) -> None:
        end = [0 if q in FINAL else 2 * INSERT_COST for q in range(4)]
        end[USER] = INSERT_COST
        self.vectors: list[tuple[int, ...]] = [tuple(end)]
        self.numbers = {self.vectors[0]: 0}
        self.table: dict[int, Arc] = {}

    def arc(self, number: int, symbol: int) -> Arc:
        found = self.table.get(number * SYMBOLS + symbol)
        return found or self._new(number, symbol)

    def _new(self, number: int, symbol: int) -> Arc:
        later = self.vectors[number]
        kept, truncated = divmod(symbol - 1, 2) if symbol else (3, 0)
        more = TRUNCATED_COST * truncated
        steps = []  # by state: (letter, cost to the end, state after the row)
        for q in range(4):
            own = [("D", DELETE_COST + later[q], q)]
            if symbol and kept < len(INITIALS) and INITIALS[kept] in KEEP[q]:
                own.append(("K", more + later[KEEP[q][INITIALS[kept]]], KEEP[q][INITIALS[kept]]))
            if symbol:
                own.append(("R", REROLE_COST + more + later[NEXT[q]], NEXT[q]))
            steps.append(own)
        costs = [min(c for _, c, _ in own) for own in steps]
        for _ in range(3):  # insertions chain at most so far
            costs = [min(costs[q], INSERT_COST + costs[NEXT[q]]) for q in range(4)]
        edits, after = [], []
        for q in range(4):
            letters = ""
            while True:
                tight = {letter: to for letter, cost, to in steps[q] if cost == costs[q]}
                if costs[q] == INSERT_COST + costs[NEXT[q]]:
                    tight["I"] = None
                least = min(tight)
                letters += least
                if least != "I":
                    break
                q = NEXT[q]
            edits.append(letters)
            after.append(tight[least])
        vector = tuple(c - min(costs) for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        self.table[number * SYMBOLS + symbol] = found = Arc(self.numbers[vector], min(costs), tuple(edits), tuple(after))
        return found

    def scan(self, symbols: bytes, number: int = 0) -> tuple[list[int], int]:
        """Vectors after each row, then that before the first, in the order of the scan (last row first); the cost taken out."""
        met, total = [number], 0
        for symbol in reversed(symbols):
            arc = self.arc(met[-1], symbol)
            total += arc.cost
            met.append(arc.to)
        return met, total

    def trace(self, symbols: bytes, met: list[int], q: int = START) -> Iterator[tuple[str, int]]:
        """Row by row, the edits up to and with it, and the state before them."""
        for i, symbol in enumerate(symbols):
            arc = self.arc(met[len(symbols) - 1 - i], symbol)
            yield arc.edits[q], q
            q = arc.after[q]
        yield {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[q], q


@functools.cache
def closed() -> tuple[Automaton, np.ndarray, np.ndarray, np.ndarray]:
    """An automaton with every arc, numbered alike in every process, and its arcs as arrays: to, cost, state after by state."""
    every, number = Automaton(), 0
    while number < len(every.vectors):
        for symbol in range(SYMBOLS):
            every.arc(number, symbol)
        number += 1
    arcs = [[every.arc(v, x) for x in range(SYMBOLS)] for v in range(number)]
    return every, np.array([[a.to for a in row] for row in arcs]), np.array([[a.cost for a in row] for row in arcs]), np.array([[a.after for a in row] for row in arcs])


LAZY = Automaton()


def edited(edits: str, q: int, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each edit of a row, from state q on."""
    for letter in edits:
        if letter == "K":
            yield letter, role, text
        elif letter == "D":
            yield letter, role, text
        else:
            q = NEXT[q]
            yield letter, NAMES[q], "" if letter == "I" else text


def fault_of(text: str, again: bool) -> int:
    body = text.rstrip(WHITE)
    return 1 if not body else 2 if again else 3 if body[-1] not in ".!?" else 0


def symbol_of(role: str, fault: int) -> int:
    if fault in (1, 2):
        return 0
    at = INITIALS.find(role[:1]) if role else -1
    return 1 + 2 * (at if at >= 0 else 3) + (fault == 3)


class Facts:
    """What a report tells of the rows of a conversation, or of a unit of them; rows come in order."""

    def __init__(self) -> None:
        self.symbols, self.counts, self.illegal, self.turns = bytearray(), [0] * 4, 0, 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        fault = fault_of(text, again)
        self.counts[fault] += 1
        self.symbols.append(symbol_of(role, fault))
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def then(self, later: Facts) -> None:
        """Take in what comes after."""
        self.counts = [a + b for a, b in zip(self.counts, later.counts)]
        self.illegal += later.illegal + (self.last is not None and self.last + later.first not in LEGAL)
        self.turns += later.turns - (self.high is not None and self.high == later.low)
        self.first, self.last = later.first if self.last is None else self.first, later.last
        self.low, self.high = later.low if self.low is None else self.low, self.high if later.high is None else later.high

    def numbers(self) -> list[int]:
        return [0 if self.low is None else self.high - self.low + 1 - self.turns, *self.counts[1:], self.illegal]


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in the first columns; each run is to be read before the next is asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    ahead = next(rows, None)

    def run(key: tuple) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[:keys] == key:
            row, ahead = ahead, None
            yield row
            ahead = next(rows, None)

    while ahead is not None:
        key = ahead[:keys]
        own = run(key)
        yield key, own
        for _ in own:
            pass


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: Callable[[tuple], int] = lambda row: 1) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= most or weight >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(conv: str, columns: str) -> tuple[str, Callable[[pa.DataType], pa.Schema]]:
    """DDL with the conversation first, and the Arrow schema once the conversation's type is known."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    fields = [tuple(x.split()) for x in columns.split(", ")]
    return f"conv {conv}, {columns}", lambda kind: pa.schema([("conv", kind), *((n, kinds[t]) for n, t in fields)])


def _first_batch(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)

    def every() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    return (None, iter(())) if first is None else (first.schema.field(0).type, every())


def _mapped(df: DataFrame, columns: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], size: Callable[[tuple], int] = lambda row: 1) -> DataFrame:
    """rows over each task of df, whose first column is the conversation; what it gives has the conversation first too."""
    ddl, schema = _schema(df.schema["conv"].dataType.simpleString(), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, every = _first_batch(batches)
        if kind is not None:
            yield from _batched(rows(every), schema(kind), size=size)

    return df.mapInArrow(run, ddl)


def _joined(messages: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in messages)


def settled(rows: list[tuple], messages: bool) -> Iterator[tuple]:
    """What a conversation that lies within a task gives; rows: (conv, turn, role, text, digest, part, seq) in order."""
    facts, seen = Facts(), set()
    for _, turn, role, text, digest, _, _ in rows:
        facts.add(turn, role, text, (role, digest) in seen)
        seen.add((role, digest))
    symbols = bytes(facts.symbols)
    met, cost = LAZY.scan(symbols)
    trace = LAZY.trace(symbols, met)
    conv = rows[0][0]
    if messages:
        for row, (edits, q) in zip([*rows, (conv, None, "", "", None, rows[-1][5], rows[-1][6] + 1)], trace):
            yield from _messages(conv, row[5], row[6], row[1], edits, q, row[2], row[3])
        return
    audit, kept = [], []
    for row, (edits, q) in zip([*rows, (conv, None, "", "")], trace):
        audit.append(edits)
        kept += [(role, text) for letter, role, text in edited(edits, q, row[2], row[3]) if letter != "D"]
    digest = hashlib.sha256(_joined(kept).encode()).hexdigest()
    yield (conv, None, None, None, None, None, None, None, None, *facts.numbers(), cost + LAZY.vectors[met[-1]][START], "".join(audit), digest)


def _messages(conv, part: int, seq: int, turn: int | None, edits: str, q: int, role: str, text: str) -> Iterator[tuple]:
    for k, (letter, new_role, new_text) in enumerate(edited(edits, q, role, text)):
        yield (conv, part, seq, k, None if letter == "I" else turn, new_role, new_text, None, letter, *(None,) * 8)


TOLD = "part int, seq bigint, k int, turn bigint, role string, text string, digest binary, edit string, " + ", ".join(f"{n} bigint" for n in NUMBERS) + ", audit string, repaired_sha256 string"


def _dealt(rows: DataFrame, messages: bool) -> DataFrame:
    """Conversations within a task settled; the rows of others as they are, without edit and audit."""
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).orderBy(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "digest", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] | None = None  # rows of a conversation that began in this task
        for (conv,), own in grouped(batches, 1):
            if held:
                yield from settled(held, messages)
            first = held is None
            held = []
            for _, turn, role, text, digest in own:
                if first:
                    yield (conv, part, seq, None, turn, role, text, digest, *(None,) * 9)
                else:
                    held.append((conv, turn, role, text, digest, part, seq))
                seq += 1
        for conv, turn, role, text, digest, part, seq in held or ():
            yield (conv, part, seq, None, turn, role, text, digest, *(None,) * 9)

    return _mapped(ordered, TOLD, run, lambda row: len(row[6] or ""))


UNIT = "part int, unit bigint, counts array<bigint>, illegal bigint, turns bigint, first string, last string, low bigint, high bigint, symbols binary, starts array<int>, costs array<bigint>, outs array<int>"


def _units(raw: DataFrame) -> DataFrame:
    """One row for each unit: its facts, its symbols, and what it makes of each vector after it and each state before it."""
    key = ["conv", "part", "unit"]
    firsts = raw.groupBy("conv", "role", "digest").agg(F.min(F.struct("part", "unit", "seq")).alias("at")).select("conv", "at.*", F.lit(0).alias("row"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("text", "string"))))
    both = firsts.unionByName(raw.select(*key, "seq", F.lit(1).alias("row"), "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        _, to, cost, after = closed()
        for (conv, part, unit), own in grouped(batches, 3):
            facts, first = Facts(), None
            for _, _, _, seq, row, turn, role, text in own:
                if row:
                    facts.add(turn, role, text, first != seq)
                else:
                    first = seq
            symbols = bytes(facts.symbols)
            met = np.zeros((len(symbols) + 1, len(to)), np.int64)
            met[-1] = np.arange(len(to))
            total = np.zeros(len(to), np.int64)
            for i in range(len(symbols) - 1, -1, -1):
                total += cost[met[i + 1], symbols[i]]
                met[i] = to[met[i + 1], symbols[i]]
            q = np.tile(np.arange(4), (len(to), 1))
            for i, symbol in enumerate(symbols):
                q = after[met[i + 1][:, None], symbol, q]
            yield conv, part, unit, facts.counts, facts.illegal, facts.turns, facts.first, facts.last, facts.low, facts.high, symbols, met[0].tolist(), total.tolist(), q.ravel().tolist()

    return _mapped(both.repartition(*key).sortWithinPartitions(*key, "seq", "row"), UNIT, run, lambda row: len(row[10]))


def _chained(units: DataFrame) -> DataFrame:
    """For each unit the vector after it and the state before it; for each conversation (part -1) the numbers of its report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        every, *_ = closed()
        for (conv,), own in grouped(batches, 1):
            chain, facts, ends, number, cost, q = list(own), Facts(), [], 0, 0, START
            for u in reversed(chain):
                ends.append(number)
                cost += u[11][number]
                number = u[10][number]
            for u, end in zip(chain, reversed(ends)):
                later = Facts()
                later.counts, later.illegal, later.turns, later.first, later.last, later.low, later.high = u[3:10]
                facts.then(later)
                yield (conv, u[1], u[2], end, q, u is chain[-1], *(None,) * 6)
                q = u[12][4 * end + q]
            yield (conv, -1, -1, None, None, None, *facts.numbers(), cost + every.vectors[number][START])

    columns = "part int, unit bigint, end int, entry int, final boolean, " + ", ".join(f"{n} bigint" for n in NUMBERS)
    return _mapped(units.drop("symbols").repartition("conv").sortWithinPartitions("conv", "part", "unit"), columns, run)


def _traced(raw: DataFrame, units: DataFrame, chained: DataFrame, messages: bool) -> DataFrame:
    """Each unit by itself: its messages, or pieces of audit and text (the number of messages, and them joined)."""
    key = ["conv", "part", "unit"]
    heads = units.select(*key, F.lit(-2).cast("bigint").alias("seq"), "symbols").unionByName(chained.where("part >= 0").select(*key, F.lit(-1).cast("bigint").alias("seq"), "end", "entry", "final"), allowMissingColumns=True)
    both = heads.unionByName(raw.select(*key, "seq", "turn", "role", "text"), allowMissingColumns=True).select(*key, "seq", "symbols", "end", "entry", "final", "turn", "role", "text")

    def traces(own: Iterator[tuple]) -> Iterator[tuple]:
        """(edits, state, seq, turn, role, text) of each row, and of what follows the last one."""
        symbols, (end, entry, final) = next(own)[4], next(own)[5:8]
        every, *_ = closed()
        trace = every.trace(symbols, every.scan(symbols, end)[0], entry)
        seq = -1
        for _, _, _, seq, _, _, _, _, turn, role, text in own:
            yield *next(trace), seq, turn, role, text
        if final:
            yield *next(trace), seq + 1, None, "", ""

    def run_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, part, _), own in grouped(batches, 3):
            for edits, q, seq, turn, role, text in traces(own):
                yield from _messages(conv, part, seq, turn, edits, q, role, text)

    def run_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv, part, unit), own in grouped(batches, 3):
            audit, kept, size, piece = [], [], 0, 0
            for edits, q, _, _, role, text in traces(own):
                audit.append(edits)
                new = [(r, t) for letter, r, t in edited(edits, q, role, text) if letter != "D"]
                kept += new
                size += sum(len(t) + 16 for _, t in new) + len(edits)
                if size >= PIECE:
                    yield conv, part, unit, piece, "".join(audit), len(kept), _joined(kept)
                    audit, kept, size, piece = [], [], 0, piece + 1
            yield conv, part, unit, piece, "".join(audit), len(kept), _joined(kept)

    dealt = both.repartition(*key).sortWithinPartitions(*key, "seq")
    if messages:
        return _mapped(dealt, TOLD, run_messages, lambda row: len(row[6] or ""))
    return _mapped(dealt, "part int, unit bigint, piece int, audit string, messages bigint, body string", run_pieces, lambda row: len(row[6]))


def _closed_reports(pieces: DataFrame, chained: DataFrame) -> DataFrame:
    """Reports of the conversations that were cut: pieces are hashed in order as they stream by, none is kept."""
    numbers = chained.where("part < 0").select("conv", "part", "unit", F.lit(-1).alias("piece"), *NUMBERS)
    both = numbers.unionByName(pieces, allowMissingColumns=True).select("conv", "part", "unit", "piece", *NUMBERS, "audit", "messages", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (conv,), own in grouped(batches, 1):
            told, audit, digest, begun = next(own)[4:10], [], hashlib.sha256(), False
            for row in own:
                audit.append(row[10])
                if row[11]:
                    digest.update((b"\n" if begun else b"") + row[12].encode())
                    begun = True
            yield conv, *told, "".join(audit), digest.hexdigest()

    columns = ", ".join(f"{n} bigint" for n in NUMBERS) + ", audit string, repaired_sha256 string"
    return _mapped(both.repartition("conv").sortWithinPartitions("conv", "part", "unit", "piece"), columns, run)


def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(text_col, F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))


def _worked(rows: DataFrame, messages: bool, unit_rows: int) -> tuple[DataFrame, DataFrame]:
    """What conversations within a task gave, and what the others did."""
    dealt = saved(_dealt(rows, messages), "dealt")
    raw = dealt.where("edit is null and audit is null").select("conv", "part", F.expr(f"seq div {unit_rows}").alias("unit"), "seq", "turn", "role", "text", "digest")
    units = saved(_units(raw), "units")
    chained = saved(_chained(units), "chained")
    traced = saved(_traced(raw, units, chained, messages), "traced")
    return dealt, traced if messages else _closed_reports(traced, chained)


def repair_reports(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first; those of one turn by role, then by MD5 of the text, and equal rows stand together. A
    null role or text counts as one space, and rows without a conversation are one conversation. A row's first fault counts:
    blank, duplicate (role and text stood earlier), truncated. audit has a letter for each edit (Keep, Rerole, Delete, Insert)
    of the cheapest repair, the least in ASCII among equal ones; the digest is that of the repaired `role:text`, joined by
    newlines. An empty table gives an empty result. Other columns are not read. Texts may be of any length that fits in a
    row, and so may the audit; the digest of a conversation that lies in several tasks is taken by one that its repaired text
    streams through.
    """
    dealt, others = _worked(_rows(conversations, conv_col, turn_col, role_col, text_col), False, unit_rows)
    names = ["conv", *NUMBERS, "audit", "repaired_sha256"]
    return dealt.where("audit is not null").select(*names).unionByName(others.select(*names)).withColumnRenamed("conv", conv_col)


def repaired_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """The edits of the repair, one row each: conversation, part, seq, k (in this order), edit, turn, role, text.

    Rows whose edit is not D are the repaired conversation. Rules as in repair_reports.
    """
    dealt, others = _worked(_rows(conversations, conv_col, turn_col, role_col, text_col), True, unit_rows)
    names = ["conv", "part", "seq", "k", "edit", "turn", "role", "text"]
    every = dealt.where("edit is not null").select(*names).unionByName(others.select(*names))
    return every.select(F.col("conv").alias(conv_col), "part", "seq", "k", "edit", F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows spoilt by crc32(`conversation:turn`) % 20: 0 drops, 1 empties, 2 removes `[.!?]`, 3 repeats, 4 makes it the user's. Nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    text = F.coalesce(text_col, space)
    kind = F.col("_kind")
    rows = conversations.select(conv_col, turn_col, role_col, text_col, (F.crc32(key.cast("binary")) % 20).alias("_kind")).where("_kind <> 0")
    spoilt = rows.select(
        conv_col, turn_col, F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(role_col, space)).alias(role_col),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return spoilt.drop("_copy")


def damage_and_repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", unit_rows: int = UNIT_ROWS) -> DataFrame:
    """repair_reports of the damaged rows, with a row of zeros for each conversation that has none left."""
    reports = repair_reports(damaged(conversations, conv_col, turn_col, role_col, text_col), conv_col, turn_col, role_col, text_col, unit_rows)
    every = conversations.select(F.col(conv_col).alias("_every")).distinct()
    both = every.join(reports.hint("merge"), F.col("_every").eqNullSafe(F.col(conv_col)), "left")
    digest = hashlib.sha256(b"").hexdigest()
    return both.select(F.col("_every").alias(conv_col), *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(digest)).alias("repaired_sha256"))
