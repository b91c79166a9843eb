"""Repair of conversations against a plain search over all edits."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm import structure

WELL = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"
TURNS = "conv_id bigint, turn bigint, role string, text string, audit string, n string"


def _cheapest(rows):
    """Cost and letters by a search over (rows left, initials so far as s, u, a or nothing)."""

    @lru_cache(maxsize=None)
    def search(at, last, inserts):
        ways = []
        if at == len(rows) and last in ("", "a"):
            ways.append((0, ""))
        if inserts < 4:
            for role in "ua":
                if WELL.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[last] + role + ("a" if role == "u" else "")):
                    cost, rest = search(at, role, inserts + 1)
                    ways.append((cost + 5, "I" + rest))
        if at < len(rows):
            role, fault = rows[at]
            cost, rest = search(at + 1, last, 0)
            ways.append((cost + 2, "D" + rest))
            if fault != "gone":
                more = 5 if fault == "cut" else 0
                for new, price, letter in [(role, 0, "K"), ("u", 1, "R"), ("a", 1, "R")]:
                    follows = (new == "s" and last == "") or (new == "u" and last in ("", "s", "a")) or (new == "a" and last == "u")
                    if follows:
                        cost, rest = search(at + 1, new, 0)
                        ways.append((cost + price + more, letter + rest))
        return min(ways, default=(10**9, ""))

    return search(0, "", 0)


FAULTS = {structure.FINE: "fine", structure.GONE: "gone", structure.CUT: "cut"}
symbols = st.tuples(st.sampled_from(["s", "u", "a", ""]), st.sampled_from(list(FAULTS)), st.integers(1, 4))


@given(st.lists(symbols, max_size=7))
@settings(max_examples=500, deadline=None)
def test_edits_are_the_cheapest_and_least(runs):
    rows = [(initial or "x", FAULTS[fault]) for initial, fault, n in runs for _ in range(n)]
    assert structure.edits(runs) == _cheapest(tuple(rows))


@pytest.mark.parametrize("run", [("u", 0), ("", 1), ("a", 2), ("s", 0)])
def test_powers_are_repeated_steps(run):
    costs = structure.END
    for n in range(1, 70):
        costs = structure.before(*run, 1, costs)
        assert structure.before(*run, n, structure.END) == costs
    assert list(structure._inside(*run, 37, structure.END)) == [structure.before(*run, k, structure.END) for k in range(36, -1, -1)]


def test_a_long_run_takes_few_products(monkeypatch):
    structure.power.cache_clear()
    cost, letters = structure.edits([("u", structure.FINE, 100_000)])
    assert len(letters) == 100_000 and letters.count("R") == 50_000 and cost == 50_000
    assert structure.power.cache_info().currsize <= 17


def _plain(rows):
    """The contract's row for one conversation, from its rows (conv, turn, role, text)."""
    after = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    counts = {"gone": 0, "duplicate": 0, "cut": 0}
    seen, marked = set(), []
    for _, role, text in after:
        fault = "fine"
        if not text.strip(BLANK):
            fault = "gone"
            counts["gone"] += 1
        elif (role, text) in seen:
            fault = "gone"
            counts["duplicate"] += 1
        elif text.rstrip(BLANK)[-1] not in ".!?":
            fault = "cut"
            counts["cut"] += 1
        seen.add((role, text))
        marked.append((role[:1], fault))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    turns = {t for t, _, _ in after if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, letters = _cheapest(tuple(marked)) if after else (0, "")
    out, at, last = [], 0, ""
    for letter in letters:
        if letter == "I":
            last = "a" if last == "u" else "u"
            out.append({"u": "user:", "a": "assistant:"}[last])
            continue
        _, role, text = after[at]
        at += 1
        if letter == "D":
            continue
        if letter == "R":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        out.append(f"{role}:{text}")
    assert WELL.fullmatch("".join(x[0] for x in out))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (rows[0][0], gaps, counts["gone"], counts["duplicate"], counts["cut"], illegal, cost, letters, digest)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _table():
    rows = []
    roles = ["system", "user", "assistant", "tool", "user", "assistant", "", None, "sys", "ub"]
    for conv in range(120):
        for turn in range(conv % 9):
            kind = (conv * 7 + turn * 3) % 11
            text = ["Yes.", "No!  ", "and so", None, "", "Why?\n", "Yes.", "é…", ".", "\t \x0b", "a\x85"][kind]
            rows.append((conv, turn * (1 + conv % 3), roles[(conv + turn * (1 + conv % 4)) % len(roles)], text))
    rows += [(None, t, r, x) for t, r, x in [(0, "user", "Hi."), (None, "assistant", "Oh."), (None, "user", "Hi."), (3, "user", "Hi.")]]
    rows += [(500, None, "user", "A."), (500, None, "assistant", "B."), (501, 4, "user", "A."), (501, 4, "user", "A."), (501, 4, "user", "B.")]
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "Gone.")]


def test_against_plain_python(spark):
    rows = _table()
    df = spark.createDataFrame([(*r, "x", None) for r in rows], TURNS).repartition(5)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in structure.audited(df).collect()}
    convs = dict.fromkeys(r[0] for r in rows)
    assert set(got) == set(convs)
    for conv in convs:
        assert got[conv] == _plain([r for r in rows if r[0] == conv])
    assert any(r[7] == "" and r[6] == 0 for r in got.values())  # a conversation that lost every row


def test_many_equal_rows_travel_as_one(spark):
    df = spark.range(20_000).selectExpr("7L as conv_id", "1L as turn", "'user' as role", "'Same.' as text")
    rows = structure.symbols(df).collect()
    assert [(r.n, r.repeated) for r in rows] == [(20_000, False)]
    planned = structure.plans(df).collect()[0]
    assert planned.duplicate == 19_999 and planned.cost == 2 * 20_000 and planned.audit == "D" * 20_000


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "user", "R."), (1, 2, "assistant", " "), (1, 3, "assistant", "S."), (2, 0, "user", "T.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in structure.repaired(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 1, "K", "user", "R."), (1, 3, "K", "assistant", "S.")]
    whole = structure.edited(df, structure.plans(df)).orderBy("conv_id", "place").collect()
    assert ["".join(r.edit for r in whole if r.conv_id == c) for c in (1, 2)] == ["DKDK", "D"]


def test_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "x" * 300_000 + "?"), (1, 1, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = structure.audited(df).collect()[0]
    assert tuple(got[c] for c in COLUMNS) == _plain(rows)
    assert structure.audited(df.limit(0)).collect() == []
