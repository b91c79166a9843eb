"""Regular expressions over bytes as one minimal deterministic automaton.

``compiled`` takes several patterns and labels (bit sets), and gives transition
arrays: subset construction over classes of bytes that no pattern tells apart,
then refinement of the labels until no state splits.

Patterns have literals, ``[...]``, ``(...)``, ``(?i:...)`` for letters in either
case, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``.`` and ``\\xHH``; they match UTF-8 bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

EVERY = frozenset(range(256))


# --- patterns -----------------------------------------------------------------
# A tree is ("set", bytes), ("cat", trees), ("alt", trees) or ("rep", tree, least, endless).


class _Reader:
    def __init__(self, pattern: str):
        self.tokens = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|\(\?i:|\{\d+,?\}|.", pattern, re.S)
        self.at = 0
        self.fold = False

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self):
        branches = [self.row()]
        while self.peek() == "|":
            self.take()
            branches.append(self.row())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.one()
            token = self.peek()
            if token in ("?", "*", "+") or re.fullmatch(r"\{\d+,?\}", token):
                self.take()
                if token == "?":
                    part = ("alt", [part, ("cat", [])])
                else:
                    least = {"*": 0, "+": 1}.get(token) if token in "*+" else int(token.strip("{,}"))
                    part = ("rep", part, least, token in "*+" or "," in token)
            parts.append(part)
        return ("cat", parts)

    def one(self):
        token = self.take()
        if token in ("(", "(?i:"):
            before, self.fold = self.fold, self.fold or token == "(?i:"
            tree = self.either()
            self.fold = before
            if self.take() != ")":
                raise ValueError("group is not closed")
            return tree
        if token == ".":
            return ("set", EVERY - {10})
        if token == "[":
            return ("set", self.folded(self.members()))
        if len(token := self.plain(token)) == 1 and ord(token) < 128:
            return ("set", self.folded({ord(token)}))
        return ("cat", [("set", frozenset([b])) for b in token.encode()])

    def plain(self, token: str) -> str:
        if token.startswith("\\x"):
            return chr(int(token[2:], 16))
        return {"\\n": "\n", "\\r": "\r", "\\t": "\t"}.get(token, token[1:]) if token[0] == "\\" else token

    def members(self) -> set[int]:
        found: set[int] = set()
        negated = self.peek() == "^"
        if negated:
            self.take()
        while self.peek() != "]":
            low = ord(self.plain(self.take()))
            high = low
            if self.peek() == "-" and self.tokens[self.at + 1] != "]":
                self.take()
                high = ord(self.plain(self.take()))
            found |= set(range(low, high + 1))
        self.take()
        return set(EVERY) - found if negated else found

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)


def parsed(pattern: str):
    reader = _Reader(pattern)
    tree = reader.either()
    if reader.peek():
        raise ValueError(f"{pattern!r} has a group too many closed")
    return tree


def backwards(tree):
    """The tree of the same words spelled from their ends."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [backwards(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [backwards(t) for t in tree[1]])
    return ("rep", backwards(tree[1]), *tree[2:]) if kind == "rep" else tree


# --- automata -----------------------------------------------------------------


class _Steps:
    """Nondeterministic steps: per state those on bytes and those on nothing."""

    def __init__(self) -> None:
        self.on: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def lay(self, tree, start: int) -> int:
        """Steps for a tree from a state on; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.on[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.lay(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for branch in tree[1]:
                self.free[self.lay(branch, start)].append(end)
            return end
        _, part, least, endless = tree
        for _ in range(least):
            start = self.lay(part, start)
        if endless:
            again = self.state()
            self.free[start].append(again)
            self.free[self.lay(part, again)].append(again)
            start = again
        return start

    def closed(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``step[state, class_of[byte]]`` is the next state, ``label[state]`` a bit set; state 0 is the first."""

    step: np.ndarray
    class_of: np.ndarray
    label: np.ndarray


def compiled(trees: list, labels: list[int], anywhere: bool = False) -> Automaton:
    """One minimal automaton of several patterns; a state's label holds those of the patterns that end there.

    With ``anywhere`` a word may begin at every byte, else at the first only.
    """
    steps = _Steps()
    first = steps.state()
    ends = {steps.lay(tree, _branch(steps, first)): label for tree, label in zip(trees, labels, strict=True)}
    if anywhere:
        steps.on[first].append((EVERY, first))

    sets = list({s for on in steps.on for s, _ in on})
    alike: dict[tuple, int] = {}
    class_of = np.array([alike.setdefault(tuple(b in s for s in sets), len(alike)) for b in range(256)], np.uint8)
    example = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(alike))]

    start = steps.closed([first])
    number, rows, todo = {start: 0}, [], [start]
    for here in todo:
        row = []
        for byte in example:
            there = steps.closed({t for s in here for bytes_, t in steps.on[s] if byte in bytes_})
            if there not in number:
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        rows.append(row)
    step = np.array(rows, np.int64)
    label = np.array([sum({ends[s] for s in here if s in ends}) for here in todo], np.int64)
    return Automaton(*_smallest(step, label, class_of))


def _branch(steps: _Steps, start: int) -> int:
    state = steps.state()
    steps.free[start].append(state)
    return state


def _smallest(step: np.ndarray, label: np.ndarray, class_of: np.ndarray):
    """States that no continuation tells apart become one; the first state stays state 0."""
    _, part = np.unique(label, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        if finer.max() == part.max():
            break
        part = finer.ravel()
    part = part.ravel()
    _, example = np.unique(part, return_index=True)
    order = np.argsort(example)  # parts by their first state: that of state 0 leads
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    example = example[order]
    return rank[part[step[example]]].astype(np.int32), class_of, label[example]
