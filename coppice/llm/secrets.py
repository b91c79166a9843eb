"""Secret scan: one deterministic automaton of all rules reads each byte once.

A rule is a regular expression over bytes.  The automaton of all rules spelled
backwards reads a text from its end and says, at every byte, which rules have
a match that begins there.  Each rule's own automaton then reads forward from
its leftmost such byte to the end of the longest match, and goes on behind it,
so the spans of a rule do not overlap; spans of different rules may.

Bytes after which the automaton is in the same state whatever came before (a
line's end, a comma) cut the texts of a batch into stretches that are read side
by side, a byte of each at a time.

Results for odd input: a null or empty text has no spans; texts of any length
are read whole; rows that repeat, or have no ``doc_id``, are each scanned by
themselves; other columns are not looked at.  Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm import automaton
from coppice.llm.words import slices, texts


@dataclass(frozen=True)
class Rule:
    """``match`` is what counts as a match, ``kept`` the matches that are reported.

    ``begins`` is the shortest pattern that has a match wherever ``match`` has
    one; matches that are not kept still use up their bytes.
    """

    kind: str
    begins: str
    match: str
    kept: str


_NAMES = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_VALUE = r"[A-Za-z0-9+/_.=-]"
_WORD = r"[A-Za-z0-9_-]"
_PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"

# The first three kinds are the contract's, the others public formats of credentials.
BASE = ["assign", "access", "hex"]
RULES = [
    Rule("assign", _NAMES + _VALUE, _NAMES + _VALUE + "+", _NAMES + _VALUE + "{6,}"),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]{24,}", r"[0-9a-f]{24,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abeoprs]-[A-Za-z0-9-]", r"xox[abeoprs]-[A-Za-z0-9-]+", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_api", rf"AIza{_WORD}", rf"AIza{_WORD}+", rf"AIza{_WORD}{{35,}}"),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", rf"eyJ{_WORD}+\.eyJ{_WORD}+\.{_WORD}", rf"eyJ{_WORD}+\.eyJ{_WORD}+\.{_WORD}+", rf"eyJ{_WORD}+\.eyJ{_WORD}+\.{_WORD}+"),
    Rule("login_url", *[r"://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$*-]+@"] * 3),
    Rule("private_key", _PEM, *[_PEM + r"([A-Za-z0-9+/=:, \n\r]*-----END [A-Z0-9 ]*PRIVATE KEY-----)?"] * 2),
]

LANES = 48  # with fewer stretches left, each is read by itself


class Scanner:
    """All rules' automata, ready to be sent to the tasks."""

    def __init__(self, rules: list[Rule]):
        self.kinds = [r.kind for r in rules]
        trees = [automaton.backwards(automaton.parsed(r.begins)) for r in rules]
        whole = automaton.compiled(trees, [1 << k for k in range(len(rules))], anywhere=True)
        # States with a label come last, so that one comparison finds them.
        order = np.argsort(whole.label != 0, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        step = rank[whole.step[order]]
        self.classes = step.shape[1]
        self.class_of = whole.class_of
        self.first = int(rank[0]) * self.classes
        self.label = whole.label[order]
        self.labelled = int((self.label == 0).sum()) * self.classes
        self.after = np.where((step == step[0]).all(axis=0), step[0] * self.classes, -1)[whole.class_of]
        self.step = (step * self.classes).astype(np.int32).ravel()
        self.steps: list[int] | None = None
        if self.after[ord("\n")] != self.first:
            raise ValueError("what shows that a match begins has to lie in one line")
        self.ends = []
        for rule in rules:
            own = automaton.compiled([automaton.parsed(rule.match), automaton.parsed(rule.kept)], [1, 2])
            dead = (own.step == np.arange(len(own.step))[:, None]).all(axis=1) & (own.label == 0)
            rows = [[-1 if dead[s] else s for s in row[own.class_of].tolist()] for row in own.step]
            self.ends.append((rows, own.label.tolist()))

    def begins(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes at which a match of some rule begins, and which rules, in order."""
        symbols = self.class_of[data]
        after = self.after[data]
        stops = np.flatnonzero(after >= 0)
        known = after[stops] >= self.labelled
        found, which = [stops[known]], [after[stops][known]]
        # The stretch left of each stop, and the one left of the end.
        right = np.append(stops, len(data))
        length = np.diff(right, prepend=-1) - 1
        state = np.append(after[stops], self.first).astype(np.int32)
        order = np.argsort(-length, kind="stable")
        order = order[: int(np.count_nonzero(length))]
        at, state, length = right[order] - 1, state[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), side="right")
        for k, n in enumerate(active.tolist()):
            if n < LANES:
                self._singly(symbols, at[:n] - k, state[:n], length[:n] - k, found, which)
                break
            here = state[:n]
            here += symbols[at[:n] - k]
            np.take(self.step, here, out=here)
            hit = here >= self.labelled
            if hit.any():
                found.append(at[:n][hit] - k)
                which.append(here[hit].copy())
        found, which = np.concatenate(found), np.concatenate(which)
        order = np.argsort(found, kind="stable")
        return found[order], self.label[which[order] // self.classes]

    def _singly(self, symbols, at, state, length, found: list, which: list) -> None:
        if self.steps is None:
            self.steps = self.step.tolist()
        step, labelled = self.steps, self.labelled
        for right, now, n in zip(at.tolist(), state.tolist(), length.tolist(), strict=True):
            place = right
            for symbol in symbols[right - n + 1 : right + 1][::-1].tolist():
                now = step[now + symbol]
                if now >= labelled:
                    found.append(np.array([place]))
                    which.append(np.array([now]))
                place -= 1

    def _end(self, rule: int, data: bytes, start: int) -> tuple[int, bool]:
        """Where the longest match of a rule from ``start`` on ends, and whether it is reported."""
        rows, label = self.ends[rule]
        state, end, kept = 0, -1, False
        for at in range(start, len(data)):
            state = rows[state][data[at]]
            if state < 0:
                break
            if label[state]:
                end, kept = at + 1, label[state] & 2 != 0
        return end, kept

    def spans(self, bodies: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans as (start, rule, end), in order, in code points."""
        joined = b"\n".join(bodies)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        starts = np.cumsum(sizes + 1) - sizes - 1
        found, which = self.begins(data)
        owner = np.searchsorted(starts, found, side="right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
        for text in np.unique(owner).tolist():
            mine = owner == text
            body, own = bodies[text], []
            free = [0] * len(self.kinds)
            for at, rules in zip((found[mine] - starts[text]).tolist(), which[mine].tolist(), strict=True):
                for rule in range(len(self.kinds)):
                    if rules >> rule & 1 and at >= free[rule]:
                        end, kept = self._end(rule, body, at)
                        free[rule] = max(end, at)
                        if kept:
                            own.append((at, rule, end))
            if own:
                lead = (np.frombuffer(body, np.uint8) & 0xC0) != 0x80
                points = np.concatenate([[0], np.cumsum(lead)])
                out[text] = [(int(points[s]), rule, int(points[e])) for s, rule, e in own]
        return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def found(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``doc_id`` and the spans of every document, by start, then in the rules' order."""
    scanner = Scanner(RULES if rules is None else rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [
                [{"kind": scanner.kinds[rule], "start": s, "end": e} for s, rule, e in own]
                for own in scanner.spans(texts(batch))
            ]
            yield pa.record_batch([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id bigint, spans {SPANS}")


def hidden(text: str, spans: list[tuple[int, int, str]]) -> str:
    """A text whose spans are replaced by their kind; spans that touch or overlap are one, named after the first."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The same rows and columns with the secrets in ``text`` replaced by their kinds."""
    scanner = Scanner(RULES if rules is None else rules)
    place = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said = batch.column(place).to_pylist()
            every = scanner.spans([(t or "").encode() for t in said])
            said = [t and hidden(t, [(s, e, scanner.kinds[r]) for s, r, e in own]) for t, own in zip(said, every, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(said, batch.schema.field(place).type))

    return docs.mapInArrow(scan, docs.schema)


def scanned(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans, and all spans as text."""
    spans = F.col("spans")

    def text(array):
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kinds):
        return F.filter(spans, lambda x: x["kind"].isin(kinds))

    return found(docs).select(
        "doc_id",
        *[F.size(of([kind])).cast("bigint").alias(f"n_{kind}") for kind in BASE],
        F.sha2(text(of(BASE)), 256).alias("base_sha256"),
        text(spans).alias("spans"),
    )
