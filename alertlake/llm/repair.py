"""Conversation structure repair: cheapest edits by run-length min-plus dynamic programming.

A conversation is read as one symbol per turn: its role (system, user, assistant, other) and its fault
(none, truncated, or must be deleted). Role initials of a repaired conversation match ``(s?(ua)+)?``, an
automaton of four states, so a turn is a 4 x 4 min-plus matrix of edit costs. Runs of equal symbols
collapse; a run of any length is its matrix to a power, put together from cached binary powers. The costs
to the end are carried backwards over runs, and the edits are then unrolled forwards, again by halves whose
results are cached.

A conversation of any number of turns is spread over range parts; the piece in each part is one matrix
(costs, backwards) and one map of states (edits, forwards), and only those small pieces meet.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import SPACES, crc32_sql, materialize

INFINITE = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs; TRUNCATED is added to a truncated turn that stays
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
FIRST, STATES = 0, range(4)
INSERTED = (2, 2, 3, 2)  # state after the turn that fits a state: a user's, but after a user an assistant's
TERMINAL = (0, 4, 2, 0)  # least cost of ending in each state
CLOSING = ("", "II", "I", "")
ROLE = {2: "user", 3: "assistant"}
GONE, SYSTEM, USER, ASSISTANT, OTHER = range(5)  # symbols; + 4 if truncated
LEGAL = {"su", "ua", "au"}


def _kept(symbol: int, state: int) -> int | None:
    """State after a turn that is kept as it is, or None where its role does not fit."""
    role = symbol if symbol < 5 else symbol - 4
    if role == SYSTEM:
        return 1 if state == FIRST else None
    if role == USER:
        return 2 if state != 2 else None
    return 3 if role == ASSISTANT and state == 2 else None


@lru_cache(None)
def _edits(symbol: int) -> list[list[tuple[int, str, int]]]:
    """For each state the (cost, initial, next state) of the edits of one turn, insertions aside."""
    out = []
    for state in STATES:
        options = [(DELETE, "D", state)]
        if symbol != GONE:
            extra = TRUNCATED if symbol > OTHER else 0
            kept = _kept(symbol, state)
            if kept is not None:
                options.append((KEEP + extra, "K", kept))
            options.append((REROLE + extra, "R", INSERTED[state]))
        out.append(options)
    return out


def product(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def times(matrix: tuple, after: tuple) -> tuple:
    return tuple(min(matrix[i][k] + after[k] for k in STATES) for i in STATES)


IDENTITY = tuple(tuple(0 if i == j else INFINITE for j in STATES) for i in STATES)


@lru_cache(None)
def power(symbol: int, k: int) -> tuple:
    """The matrix of ``2 ** k`` turns with this symbol."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    rows = []
    for state in STATES:
        row, at = [INFINITE] * 4, state
        for inserted in range(3):  # more turns put in before one turn only go round in a circle
            for cost, _, to in _edits(symbol)[at]:
                row[to] = min(row[to], inserted * INSERT + cost)
            at = INSERTED[at]
        rows.append(tuple(row))
    return tuple(rows)


def run_matrix(symbol: int, length: int) -> tuple:
    out, k = IDENTITY, 0
    while length >> k:
        if length >> k & 1:
            out = product(out, power(symbol, k))
        k += 1
    return out


@lru_cache(1 << 14)
def _backwards(symbol: int, length: int, after: tuple) -> tuple:
    k = 0
    while length >> k:
        if length >> k & 1:
            after = times(power(symbol, k), after)
        k += 1
    return after


def _level(costs: tuple) -> tuple[int, tuple]:
    """The least cost, and the costs above it: choices depend on these alone, and they take few values."""
    least = min(costs)
    return least, tuple(c - least for c in costs)


def costs_before(symbol: int, length: int, after: tuple) -> tuple:
    """Costs to the end before a run, from those after it."""
    least, above = _level(after)
    return tuple(c + least for c in _backwards(symbol, length, above))


@lru_cache(1 << 12)
def _turn(symbol: int, after: tuple) -> tuple:
    """For each state the cheapest edits of one turn with what is put in before it, least in ASCII, and the next state."""
    direct = [min(cost + after[to] for cost, _, to in _edits(symbol)[s]) for s in STATES]
    best, out = [], []
    for s in STATES:
        once = INSERTED[s]
        best.append(min(direct[s], INSERT + direct[once], 2 * INSERT + direct[INSERTED[once]]))
    for s in STATES:
        edits, at = "", s
        while True:
            options = [(c, to) for cost, c, to in _edits(symbol)[at] if cost + after[to] == best[at]]
            if INSERT + best[INSERTED[at]] == best[at]:
                options.append(("I", INSERTED[at]))
            initial, at = min(options)
            edits += initial
            if initial != "I":
                break
        out.append((edits, at))
    return tuple(out)


def _unroll_block(symbol: int, k: int, state: int, after: tuple) -> tuple[str, int]:
    """Edits of ``2 ** k`` turns and the state behind them; ``after`` is levelled."""
    if not k:
        return _turn(symbol, after)[state]
    half = _level(_backwards(symbol, 1 << (k - 1), after))[1]
    block = _small_block if k <= 10 else _unroll_block
    left, middle = block(symbol, k - 1, state, half)
    right, last = block(symbol, k - 1, middle, after)
    return left + right, last


@lru_cache(1 << 12)
def _small_block(symbol: int, k: int, state: int, after: tuple) -> tuple[str, int]:
    return _unroll_block(symbol, k, state, after)


def unroll(runs: list[tuple[int, int]], state: int, after: tuple) -> tuple[list[str], int, int]:
    """Edits of each turn that need not be deleted, the number of all edits, and the last state.

    Turns that must be deleted have the one edit D: what is put in between comes behind them, as D is
    the least initial.
    """
    behind = []
    for symbol, length in reversed(runs):
        behind.append(_level(after)[1])
        after = costs_before(symbol, length, after)
    found, number = [], 0
    for (symbol, length), costs in zip(runs, reversed(behind)):
        if symbol == GONE:
            number += length
            continue
        blocks = [k for k in range(length.bit_length()) if length >> k & 1]  # the last blocks first
        ends = []
        for k in blocks:
            ends.append((k, costs))
            costs = _level(_backwards(symbol, 1 << k, costs))[1]
        for k, levelled in reversed(ends):
            edits, state = _small_block(symbol, k, state, levelled) if k <= 10 else _unroll_block(symbol, k, state, levelled)
            found.append(edits)
    edits = "".join(found)
    return re.findall("I*[DKR]", edits), number + len(edits), state


RUN = np.dtype([("symbol", "u1"), ("length", "<i8")])


def _packed(runs: list[tuple[int, int]]) -> bytes:
    return np.array(runs, dtype=RUN).tobytes()


def _unpacked(runs: bytes) -> list[tuple[int, int]]:
    return np.frombuffer(runs, dtype=RUN).tolist()


def damage(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str = "copies") -> DataFrame:
    """Faults put into conversations on purpose, chosen by crc32 of ``conv:turn`` modulo 20.

    0 drops the turn (``copies`` 0), 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it
    (``copies`` 2), 4 makes its role user. Null ids (inside the key only), roles and texts count as one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    return rows.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn),
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias(role),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias(text),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).cast("long").alias(copies))


ORDER = ["conv", "turn", "role", "sha"]


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    n = F.coalesce(F.col(copies).cast("long"), F.lit(1)) if copies else F.lit(1).cast("long")
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), n.alias("n"))
    return rows.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _fault(body: Column) -> Column:
    """1 blank, 3 truncated, else 0; ``body`` is the text without white space at its end."""
    last = F.substring(body, -1, 1)
    return F.when(body == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def _marks(rows: DataFrame) -> DataFrame:
    """One small row per distinct (conversation, turn, role, text): how many, its fault and symbol.

    Equal rows are counted before they move. The earliest of equal roles and texts in a conversation is
    found as the least turn of an aggregation and joined back by the whole row key, which is unique.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = rows.withColumn("fault", _fault(body)).groupBy(*ORDER).agg(
        F.sum("n").alias("n"), F.max("fault").alias("fault"))
    firsts = marks.where("n > 0").groupBy("conv", "role", "sha").agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("least"))
    firsts = firsts.select(
        F.col("conv").alias("fc"), F.col("role").alias("fr"), F.col("sha").alias("fs"),
        F.when(~F.col("unnumbered"), F.col("least")).alias("ft"), F.lit(True).alias("earliest"))
    marks = marks.join(firsts, F.col("conv").eqNullSafe(F.col("fc")) & (F.col("role") == F.col("fr"))
                       & (F.col("sha") == F.col("fs")) & F.col("turn").eqNullSafe(F.col("ft")), "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("fault") == 1, 1).when(F.col("earliest").isNull(), 2).otherwise(F.col("fault"))
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    symbol = F.when(F.col("fault").isin(1, 2), GONE).when(F.col("fault") == 3, code + 4).otherwise(code)
    return marks.withColumn("fault", fault).withColumn("symbol", symbol).select(
        *ORDER, "n", "fault", "symbol", initial.alias("initial"))


PIECE = ("first_initial string, last_initial string, first_turn long, last_turn long, least_turn long, n_turns long, blank long, "
         "duplicate long, truncated long, illegal long, cost long, runs binary, matrix array<long>")


class _Piece:
    """What one stretch of a conversation's turns comes to."""

    def __init__(self, conv):
        self.conv, self.runs = conv, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = self.least_turn = None

    def add(self, turn, n: int, fault: int, symbol: int, initial: str) -> None:
        if not n:
            return
        if self.first_initial is None:
            self.first_initial, self.first_turn = initial, turn
        elif self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # two equal initials never fit
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.least_turn = turn if self.least_turn is None else self.least_turn
        self.last_initial, self.last_turn = initial, turn
        if fault == 1:
            self.blank += n
        else:
            self.duplicate += n if fault == 2 else n - 1
        self.truncated += fault == 3
        self._run(symbol, n if symbol == GONE else 1)
        if symbol != GONE and n > 1:
            self._run(GONE, n - 1)

    def _run(self, symbol: int, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += length
        else:
            self.runs.append([symbol, length])

    def row(self, edge: bool) -> tuple:
        runs, cost, matrix = [tuple(r) for r in self.runs], None, None
        if edge:  # it may go on in another part
            matrix = IDENTITY
            for symbol, length in runs:
                matrix = product(matrix, run_matrix(symbol, length))
            matrix = [c for row in matrix for c in row]
        else:
            after = TERMINAL
            for symbol, length in reversed(runs):
                after = costs_before(symbol, length, after)
            cost = after[FIRST]
        return (self.first_initial, self.last_initial, self.first_turn, self.last_turn, self.least_turn, self.n_turns, self.blank,
                self.duplicate, self.truncated, self.illegal, cost, _packed(runs), matrix)


def _arrow_schema(df: DataFrame) -> pa.Schema:
    return df.limit(0).toArrow().schema


def _pieces(marks: DataFrame) -> DataFrame:
    """Marks in order with their part, and behind the marks of each part one row per conversation piece in it.

    A piece row has no ``n``. Only the first and the last piece of a part can go on in another.
    """
    ranged = marks.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    kinds = {f.name: f.dataType.simpleString() for f in marks.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in marks.columns) + f", part int, piece long, {PIECE}"
    target = _arrow_schema(marks.sparkSession.createDataFrame([], schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, last = TaskContext.get().partitionId(), 0, None, None

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            own = list(zip(*[[p[0].conv, part, p[1], *p[0].row(p[2])] for p in pieces]))
            names = ["conv", "part", "piece", *[x.split()[0] for x in PIECE.split(", ")]]
            found = dict(zip(names, own))
            return pa.RecordBatch.from_arrays(
                [pa.array(found.get(f.name, [None] * len(pieces)), f.type) for f in target], schema=target)

        for batch in batches:
            done = []
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            lists = [columns[c].to_pylist() for c in ("conv", "turn", "n", "fault", "symbol", "initial")]
            of = []
            for conv, turn, n, fault, symbol, initial in zip(*lists):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append((now, number, number == 0))
                        number += 1
                    now = _Piece(conv)
                now.add(turn, n, fault, symbol, initial)
                of.append(number)
            here = {**columns, "part": pa.array([part] * len(of), pa.int32()), "piece": pa.array(of, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [here[f.name].cast(f.type) if f.name in here else pa.nulls(len(of), f.type) for f in target], schema=target)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([(now, number, True)])

    return ranged.mapInArrow(walk, schema)


def _placed(pieces: DataFrame) -> DataFrame:
    """(part, piece, state, after, ends, base, cost) of pieces at the edge of a part.

    ``after``: costs behind the piece; ``state``: the state before it; ``base``: edits before it; ``ends``:
    nothing follows. A conversation meets in one group with one row per part it reaches: there are at most
    two such rows for each part of the table.
    """
    edges = pieces.where("matrix is not null")

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group, after, rows = group.sort_values("part"), TERMINAL, []
        for i, (part, piece, matrix) in enumerate(zip(*[group[c][::-1] for c in ("part", "piece", "matrix")])):
            before = times(tuple(tuple(matrix[4 * s: 4 * s + 4]) for s in STATES), after)
            rows.append((part, piece, list(after), i == 0, before[FIRST] if i == len(group) - 1 else None))
            after = before
        return pd.DataFrame(rows, columns=["part", "piece", "after", "ends", "cost"]).astype({"cost": "Int64"})

    costs = edges.select("conv", "part", "piece", "matrix").groupBy("conv").applyInPandas(
        backwards, "part int, piece long, after array<long>, ends boolean, cost long")

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for runs, after in zip(batch["runs"], batch["after"]):
                each = [unroll(_unpacked(runs), s, tuple(int(c) for c in after))[1:] for s in STATES]
                found.append(([n for n, _ in each], [s for _, s in each]))
            yield batch.drop(columns="runs").assign(lengths=[f[0] for f in found], states=[f[1] for f in found])

    kind = pieces.schema["conv"].dataType.simpleString()
    walked = edges.select("conv", "part", "piece", "runs").join(costs, ["part", "piece"]).select(
        F.struct("conv").alias("key"), "part", "piece", "runs", "after", "ends", "cost").mapInPandas(
        ways, f"key struct<conv:{kind}>, part int, piece long, after array<long>, ends boolean, cost long, "
              "lengths array<long>, states array<long>")

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group, state, base, rows = group.sort_values("part"), FIRST, 0, []
        for r in group.itertuples():
            rows.append((r.part, r.piece, state, list(r.after), r.ends, base, r.cost))
            state, base = int(r.states[state]), base + int(r.lengths[state])
        return pd.DataFrame(rows, columns=["part", "piece", "state", "after", "ends", "base", "cost"]).astype({"cost": "Int64"})

    return walked.select("key.conv", "part", "piece", "after", "ends", "cost", "lengths", "states").groupBy("conv").applyInPandas(
        forwards, "part int, piece long, state int, after array<long>, ends boolean, base long, cost long")


OPS = "state int, head string, dels long, tail string, at long"


def _ops(marks: DataFrame, pieces: DataFrame) -> DataFrame:
    """For each mark the edits of its turns: ``head`` for the first, ``dels`` deletions, ``tail`` put in at the end.

    ``state`` is the state before them and ``at`` the number of edits before them in the conversation.
    """
    sort = ["part", "piece", "kind", *ORDER]
    plan = pieces.select(
        "part", "piece", F.lit(0).alias("kind"), *[F.lit(None).cast(marks.schema[c].dataType).alias(c) for c in ORDER],
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("symbol"),
        "runs", "state", "after", "ends", "base")
    rows = marks.where("n > 0").select(
        "part", "piece", F.lit(1).alias("kind"), *ORDER, "n", F.col("symbol").cast("int"),
        *[F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in ("runs", "state", "after", "ends", "base")])
    schema = ", ".join(f"{c} {marks.schema[c].dataType.simpleString()}" for c in ORDER) + f", {OPS}"
    target = _arrow_schema(marks.sparkSession.createDataFrame([], schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, state, last, left = iter(()), 0, FIRST, "", 0
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            lists = [columns[c].to_pylist() for c in ("kind", "n", "symbol", "runs", "state", "after", "ends", "base")]
            found, mask = [], []
            for kind, n, symbol, runs, before, after, ends, base in zip(*lists):
                mask.append(kind == 1)
                if kind == 0:
                    runs = _unpacked(runs)
                    edits, _, end = unroll(runs, before, tuple(after))
                    edits, at, state = iter(edits), base, before
                    last, left = CLOSING[end] if ends else "", sum(length for _, length in runs)
                    continue
                head, start = ("" if symbol == GONE else next(edits)), state
                dels = n if symbol == GONE else n - 1
                left -= n
                tail = "" if left else last
                found.append((start, head, dels, tail, at))
                at += len(head) + dels + len(tail)
                for edit in head:
                    state = _next(edit, state, symbol)
            own = dict(zip(("state", "head", "dels", "tail", "at"), zip(*found) if found else [[]] * 5))
            here = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([
                pa.array(own[f.name], f.type) if f.name in own else here.column(here.schema.get_field_index(f.name)).cast(f.type)
                for f in target], schema=target)

    return plan.unionByName(rows).repartition("part").sortWithinPartitions(*sort).mapInArrow(walk, schema)


def _next(edit: str, state: int, symbol: int) -> int:
    if edit == "D":
        return state
    return _kept(symbol, state) if edit == "K" else INSERTED[state]


class Repair:
    """The edits of every conversation of a table, worked out once and read as turns or as a report.

    ``copies``: how many times a row stands there (0: its conversation is known, the row is not). Rows are
    taken by conversation and turn (null first), rows of one turn by role and SHA-256 of the text, so that
    any input order gives the same result. Null roles and texts count as one space, which makes a text blank
    and a role unfit to keep; an empty role is unfit as well. A null conversation id is a conversation. Very
    long texts move once, conversations of any length are split; equal rows are counted, not moved. An empty
    table gives no rows. Other columns are not read.
    """

    def __init__(self, turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 copies: str | None = None):
        self.conv, self.rows = conv, _rows(turns, conv, turn, role, text, copies)
        walked = materialize(_pieces(_marks(self.rows)), "turns")
        self.marks, pieces = walked.where("n is not null"), walked.where("n is null")
        # At most two rows for each part.
        placed = F.broadcast(materialize(_placed(pieces), "placed").withColumnRenamed("cost", "whole"))
        self.pieces = pieces.join(placed, ["part", "piece"], "left").select(
            *[c for c in pieces.columns if c not in ("cost", "matrix")],
            F.when(F.col("matrix").isNull(), F.col("cost")).otherwise(F.col("whole")).alias("cost"),
            F.coalesce("state", F.lit(FIRST)).alias("state"), F.coalesce("after", F.array(*[F.lit(c).cast("long") for c in TERMINAL])).alias("after"),
            F.coalesce("ends", F.lit(True)).alias("ends"), F.coalesce("base", F.lit(0)).cast("long").alias("base"))
        self.ops = materialize(_ops(self.marks, self.pieces), "edits")

    def _stream(self, by: list[str], schema: str, use: Callable) -> DataFrame:
        """``use`` over (conv, state, head, dels, tail, at, role, text) in order, each mark once, dealt out by ``by``.

        The edits of a mark come just before its texts, of which one is needed.
        """
        kinds = [F.lit(None).cast(self.ops.schema[c].dataType).alias(c) for c in ("state", "head", "dels", "tail", "at")]
        texts = self.rows.where("n > 0").select(*ORDER, F.lit(1).alias("kind"), "text", *kinds)
        edits = self.ops.select(*ORDER, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "state", "head", "dels", "tail", "at")
        both = edits.unionByName(texts).repartition(*by).sortWithinPartitions(*ORDER, "kind")

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            edits = None
            for batch in batches:
                columns = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
                lists = [columns[c].to_pylist() for c in ("kind", "conv", "state", "head", "dels", "tail", "at", "role")]
                for i, (kind, *row) in enumerate(zip(*lists)):
                    if kind == 0:
                        edits = row
                    elif edits is not None:
                        yield *edits, columns["text"][i].as_py()
                        edits = None

        target = _arrow_schema(self.ops.sparkSession.createDataFrame([], schema))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row, bytes_of in use(marks(batches)):
                held.append(row)
                size += bytes_of
                if size > 4 << 20 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), target)], schema=target)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), target)], schema=target)

        return both.mapInArrow(walk, schema)

    def edits(self) -> DataFrame:
        """(conv, n, edit, role, text): the edits of each conversation, numbered from 1.

        ``edit``: Keep, Rerole, Delete or Insert; role and text are those of the repaired turn, null for a deletion.
        Rows are dealt by conversation, turn, role and text, so no conversation need fit in one task.
        """
        kind = self.ops.schema["conv"].dataType.simpleString()
        names = {"K": "Keep", "R": "Rerole", "D": "Delete", "I": "Insert"}

        def use(marks: Iterator[tuple]) -> Iterator[tuple]:
            for conv, state, head, dels, tail, at, role, text in marks:
                for letter, new_role, new_text in repaired(state, head, dels, tail, role, text):
                    at += 1
                    yield (conv, at, names[letter], new_role, new_text), 64 + len(new_text or "")

        return self._stream(ORDER, f"conv {kind}, n long, edit string, role string, text string", use).withColumnRenamed("conv", self.conv)

    def digests(self) -> DataFrame:
        """(conv, audit, repaired_sha256).

        The hash of a whole conversation can only be taken in order, so its rows pass through one task; they are
        streamed, sorted by Spark, and never held.
        """
        kind = self.ops.schema["conv"].dataType.simpleString()

        def use(marks: Iterator[tuple]) -> Iterator[tuple]:
            now, audit, digest, empty = None, [], None, True
            for conv, state, head, dels, tail, at, role, text in marks:
                if digest is None or conv != now:
                    if digest is not None:
                        yield (now, "".join(audit), digest.hexdigest()), 128 + len(audit)
                    now, audit, digest, empty = conv, [], hashlib.sha256(), True
                audit.append(head + "D" * dels + tail)
                for letter, new_role, new_text in repaired(state, head, 0, tail, role, text):
                    if letter != "D":
                        digest.update(("" if empty else "\n").encode() + f"{new_role}:{new_text}".encode("utf-8", "surrogatepass"))
                        empty = False
            if digest is not None:
                yield (now, "".join(audit), digest.hexdigest()), 128 + len(audit)

        return self._stream(["conv"], f"conv {kind}, audit string, repaired_sha256 string", use)

    def report(self) -> DataFrame:
        """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.last("last_initial", ignorenulls=True).over(earlier)
        ended = F.last(F.when(F.col("last_initial").isNotNull(), F.struct("last_turn")), ignorenulls=True).over(earlier)["last_turn"]
        joint = F.concat(seen, F.col("first_initial"))
        pieces = self.pieces.withColumn("apart", (~joint.isin(*LEGAL)).cast("long")).withColumn(
            "again", (ended == F.col("first_turn")).cast("long"))
        folded = pieces.groupBy("conv").agg(
            F.coalesce(F.max("last_turn") - F.min("least_turn") + 1 - F.sum("n_turns") + F.coalesce(F.sum("again"), F.lit(0)), F.lit(0)).alias("gaps"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
            (F.sum("illegal") + F.coalesce(F.sum("apart"), F.lit(0))).alias("illegal"), F.sum("cost").alias("cost"))
        digests = self.digests().withColumnRenamed("conv", "of")
        nothing = hashlib.sha256().hexdigest()
        return folded.join(digests, F.col("conv").eqNullSafe(F.col("of")), "left").select(
            F.col("conv").alias(self.conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repaired(state: int, head: str, dels: int, tail: str, role: str, text: str) -> Iterator[tuple]:
    """(initial, role, text) of each edit of a mark; the state before it settles the roles that are set."""
    for letter in head + "D" * dels + tail:
        if letter == "D":
            yield letter, None, None
            continue
        if letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield letter, role, text
            continue
        state = INSERTED[state]
        yield letter, ROLE[state], text if letter == "R" else ""


# Rows of a turn are the states before and behind what is put in (before, put in, lines of it, behind).
ORACLE = rf"""
with recursive
c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select *, {crc32_sql('key')} % 20 as code from c),
d as (
  select conv_id, turn, k, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from h, (values (1), (2)) as x(k) where k <= case code when 0 then 0 when 3 then 2 else 1 end),
r as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, role[1] as initial,
         row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), k) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, k) as seen
  from d),
f as (
  select *, case when body = '' then 1 when seen > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(initial) over (partition by conv_id order by i) as before
  from r),
n as (select distinct conv_id from conversations),
s as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
         count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id),
ins(s, put, lines, to_s) as (values
  (0, '', []::varchar[], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', []::varchar[], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', []::varchar[], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2),
  (3, '', []::varchar[], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
e(s, edit, initial, cost, to_s, role) as (values
  (0, 'D', null, 3, 0, null), (1, 'D', null, 3, 1, null), (2, 'D', null, 3, 2, null), (3, 'D', null, 3, 3, null),
  (0, 'K', 's', 0, 1, null), (0, 'K', 'u', 0, 2, null), (1, 'K', 'u', 0, 2, null), (3, 'K', 'u', 0, 2, null), (2, 'K', 'a', 0, 3, null),
  (0, 'R', null, 2, 2, 'user'), (1, 'R', null, 2, 2, 'user'), (3, 'R', null, 2, 2, 'user'), (2, 'R', null, 2, 3, 'assistant')),
p as (
  select conv_id, 0::bigint as i, 0 as s, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as best from n
  union all
  select p.conv_id, p.i + 1, e.to_s, min({{
    'cost': (p.best.cost + 2 * len(ins.put) + e.cost + case when fault = 3 and edit <> 'D' then 1 else 0 end)::bigint,
    'audit': p.best.audit || ins.put || e.edit,
    'lines': p.best.lines || ins.lines || case edit when 'D' then []::varchar[] when 'K' then [f.role || ':' || text] else [e.role || ':' || text] end}})
  from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1
  join ins on ins.s = p.s
  join e on e.s = ins.to_s and (edit = 'D' or fault in (0, 3) and (e.initial is null or e.initial = f.initial))
  group by p.conv_id, p.i, e.to_s),
m as (select conv_id, count(*) as last from f group by conv_id),
z as (
  select p.conv_id, min({{
    'cost': best.cost + case s when 1 then 4 when 2 then 2 else 0 end,
    'audit': best.audit || case s when 1 then 'II' when 2 then 'I' else '' end,
    'lines': best.lines || case s when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else []::varchar[] end}}) as best
  from p left join m on m.conv_id is not distinct from p.conv_id where p.i = coalesce(m.last, 0) group by p.conv_id)
select z.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.cost::bigint as cost, best.audit as audit,
       sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
from z left join s on s.conv_id is not distinct from z.conv_id
"""
