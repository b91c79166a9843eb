"""Repair of conversations by a run-length shortest-path search.

A conversation is well formed if its roles' initials spell ``(s?(ua)+)?``.  Its
rows become symbols of role and fault, equal neighbours one run.  A symbol is a
min-plus matrix over the four places one can stand in that pattern; a run goes
through the matrix's binary powers, which are kept.  From the costs still to
come behind every run the edits are unrolled from the front, the least letter
first where several are as cheap: D(elete), I(nsert), K(eep), R(erole).

Rows of a conversation stand by turn (a null turn first), rows of one turn by
role, then by the SHA-256 of their text; equal rows stand next to each other
and only their number travels.  Which rows repeat an earlier one is found by
an aggregation; the search reads one number per distinct row, never a text,
and texts run through in order, one batch at a time.

Results for odd input: a null role or text is one space; rows without
``conv_id`` are one conversation; a conversation that loses every row has
zeros and empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.words import slices
from coppice.session import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, GONE, CUT = 0, 1, 2  # a row's fault: none, has to be deleted, truncated
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\v\f\r"

# Places in the pattern: nothing yet, after s, after a user, after an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
READ = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = [USER, USER, ASSISTANT, USER]  # where the one role that may follow leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60

Matrix = tuple[tuple[int, ...], ...]
Costs = tuple[int, ...]


# --- the search ---------------------------------------------------------------


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[p][m] + b[m][q] for m in PLACES) for q in PLACES) for p in PLACES)


def _times(a: Matrix, costs: Costs) -> Costs:
    return tuple(min(a[p][q] + costs[q] for q in PLACES) for p in PLACES)


def _inserts() -> Matrix:
    """Costs of going from place to place by inserted rows alone."""
    rows = []
    for start in PLACES:
        row, place, cost = [FAR] * 4, start, 0
        for _ in range(4):
            row[place] = min(row[place], cost)
            place, cost = NEXT[place], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()
END: Costs = _times(INSERTS, (0, FAR, FAR, 0))


def steps(initial: str, fault: int, place: int) -> list[tuple[str, int, int]]:
    """What may be done with a row at a place: letter, cost and the next place, least letter first."""
    out = [("D", DELETE, place)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        if place in READ.get(initial, ()):
            out.append(("K", KEEP + more, READ[initial][place]))
        out.append(("R", REROLE + more, NEXT[place]))
    return out


@lru_cache(maxsize=None)
def power(initial: str, fault: int, k: int) -> Matrix:
    """The matrix of 2 ** k equal rows, inserts before each of them included."""
    if k:
        half = power(initial, fault, k - 1)
        return _product(half, half)
    rows = []
    for place in PLACES:
        row = [FAR] * 4
        for _, cost, after in steps(initial, fault, place):
            row[after] = min(row[after], cost)
        rows.append(tuple(row))
    return _product(INSERTS, tuple(rows))


def before(initial: str, fault: int, n: int, costs: Costs) -> Costs:
    """Costs to come before a run of ``n`` rows, from those behind it."""
    k = 0
    while n:
        if n & 1:
            costs = _times(power(initial, fault, k), costs)
        n >>= 1
        k += 1
    return costs


def _inside(initial: str, fault: int, n: int, behind: Costs) -> Iterator[Costs]:
    """Costs behind each row of a run, from its first row to its last, holding one per halving only."""
    todo = [(n, behind)]
    while todo:
        n, behind = todo.pop()
        if n == 1:
            yield behind
            continue
        half = n // 2
        todo.append((n - half, behind))
        todo.append((half, before(initial, fault, n - half, behind)))


def edits(runs: list[tuple[str, int, int]]) -> tuple[int, str]:
    """Least cost and the edits' letters for runs of (initial, fault, rows)."""
    behind = [END]
    for initial, fault, n in reversed(runs):
        behind.append(before(initial, fault, n, behind[-1]))
    behind.reverse()
    letters, place, now = [], NONE, behind[0]
    for (initial, fault, n), end in zip(runs, behind[1:], strict=True):
        for after in _inside(initial, fault, n, end):
            while True:
                letter, place_after = _least(steps(initial, fault, place), place, now, after)
                letters.append(letter)
                place = place_after
                if letter != "I":
                    break
            now = after
    while place not in (NONE, ASSISTANT):
        letters.append("I")
        place = NEXT[place]
    return behind[0][NONE], "".join(letters)


def _least(options: list[tuple[str, int, int]], place: int, now: Costs, after: Costs) -> tuple[str, int]:
    """The least letter that is on a cheapest way."""
    delete, *others = options
    if delete[1] + after[delete[2]] == now[place]:
        return "D", delete[2]
    if INSERT + now[NEXT[place]] == now[place]:
        return "I", NEXT[place]
    return next((letter, q) for letter, cost, q in others if cost + after[q] == now[place])


# --- tables -------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The turns after the contract's damage, by the checksum of conversation and turn."""
    number = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(number) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (
        turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"), kind.alias("kind"))
        .where("kind <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _filled(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))


def symbols(turns: DataFrame) -> DataFrame:
    """Distinct rows without their texts: how often each occurs, its fault, and whether an earlier row is like it."""
    ink = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(ink == "", GONE).when(F.right(ink, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    rows = (
        _filled(turns)
        .select("conv_id", "turn", "role", "digest", fault.alias("fault"), (ink == "").alias("blank"))
        .groupBy("conv_id", "turn", "role", "digest", "fault", "blank")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    likes = rows.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = likes.where("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = rows["conv_id"].eqNullSafe(again["c"]) & (rows["role"] == again["r"]) & (rows["digest"] == again["d"])
    first = F.col("first").isNull() | (F.col("first.known") == F.col("turn").isNotNull()) & F.col("first.turn").eqNullSafe(F.col("turn"))
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "digest", "fault", "blank", "n", (~first).alias("repeated"))


PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_PLAN = [pa.int64()] * 7 + [pa.string()]


class _Conversation:
    """What one conversation's rows add up to, fed in order."""

    def __init__(self, conv):
        self.conv = conv
        self.runs: list[tuple[str, int, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high, self.initial = 0, None, None, None

    def add(self, turn, role: str, fault: int, blank: bool, n: int, repeated: bool) -> None:
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.illegal += (n - 1) * (initial + initial not in LEGAL)
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if blank:
            self.blank += n
            self.run("", GONE, n)
            return
        if repeated:
            self.duplicate += n
            self.run("", GONE, n)
            return
        self.truncated += fault == CUT
        self.run(initial if initial in READ else "", fault, 1)
        if n > 1:
            self.duplicate += n - 1
            self.run("", GONE, n - 1)

    def run(self, initial: str, fault: int, n: int) -> None:
        if self.runs and self.runs[-1][:2] == (initial, fault):
            n += self.runs.pop()[2]
        self.runs.append((initial, fault, n))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *edits(self.runs)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PLAN.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_PLAN)], names=names)

    current = None
    for batch in batches:
        done = []
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or current.conv != conv:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv)
            current.add(*row)
        if done:
            yield out(done)
    if current is not None:
        yield out([current.row()])


def plans(turns: DataFrame) -> DataFrame:
    """Per conversation its faults, the least cost of mending it, and the edits' letters in order."""
    order = ["conv_id", "turn", "role", "digest"]
    rows = symbols(turns).repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "turn", "role", "fault", "blank", "n", "repeated").mapInArrow(_searched, PLAN)


EDITED = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits with their rows; every conversation's letters come before its rows."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in EDITED.split(", ")]
    current, audit, at, place = None, "", 0, NONE
    started = False

    def inserted(rows: list) -> None:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            place = NEXT[place]
            rows.append((current, at, "I", None, ROLE[place], ""))
            at += 1

    for batch in slices(batches):
        rows: list[tuple] = []
        for conv, letters, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if letters is not None:
                if started:
                    inserted(rows)
                current, audit, at, place, started = conv, letters, 0, NONE, True
                continue
            inserted(rows)
            letter = audit[at]
            if letter == "K":
                place = READ[role[0]][place]
            elif letter == "R":
                place = NEXT[place]
                role = ROLE[place]
            rows.append((current, at, letter, turn, role, text))
            at += 1
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
    rows = []
    if started:
        inserted(rows)
    yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def edited(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per edit in order: the row it keeps, changes, deletes or inserts, as it is afterwards.

    All edits of a conversation lie in one task, behind one another.
    """
    none = F.lit(None)
    letters = planned.select(
        "conv_id", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("digest"), none.cast("string").alias("text"), F.col("audit").alias("letters"),
    )
    rows = _filled(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", none.cast("string").alias("letters"))
    return (
        letters.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
        .select("conv_id", "letters", "turn", "role", "text")
        .mapInArrow(_edited, EDITED)
    )


def repaired(turns: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """The conversations as they are after mending: ``place`` orders the rows of one."""
    planned = cut(plans(turns), "plans") if planned is None else planned
    return edited(turns, planned).where("edit <> 'D'")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

    current, digest = None, None
    for batch in batches:
        done = []
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or conv != current:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield out(done)
    if digest is not None:
        yield out([(current, digest.hexdigest())])


def audited(turns: DataFrame) -> DataFrame:
    """The contract's row for every conversation that ``turns`` had before the damage."""
    after = damaged(turns)
    planned = cut(plans(after), "plans")
    texts = repaired(after, planned).select("conv_id", "role", "text").mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    every = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    planned = planned.withColumnRenamed("conv_id", "p")
    texts = texts.withColumnRenamed("conv_id", "t")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        every.join(planned, F.col("conv_id").eqNullSafe(F.col("p")), "left")
        .join(texts, F.col("conv_id").eqNullSafe(F.col("t")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
