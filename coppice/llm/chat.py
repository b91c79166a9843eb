"""Chat formatting whose output parses back to the turns it was made from.

A turn is written as an opening mark, the text and a closing mark:

    user        [INST] text [/INST]
    assistant   <s>text</s>
    any other   [ROLE]name[/ROLE]text[/TURN]

The parser is deterministic: it reads an opening mark, then everything up to
the first closing mark that belongs to it, and takes one backslash out of
every escaped mark inside.  A text that does not come back unchanged in this
way is escaped (a backslash after the first character of every mark in it,
one more where there are some already) and read back again, until identical.

Results for odd input: a null text or role is an empty one; turns are in order
of turn, role, text, a null turn first; rows that repeat are turns of their
own; rows without ``conv_id`` are one conversation without a number.  Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT = "user", "assistant"
MARKS = {USER: ("[INST] ", " [/INST]"), ASSISTANT: ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?ROLE\]|/TURN\]|/?s>)")
ESCAPED = re.compile(r"([\[<])(\\+)(/?INST\]|/?ROLE\]|/TURN\]|/?s>)")


class Malformed(ValueError):
    """Text that the grammar does not derive."""


def escaped(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def plain(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def written(role: str, text: str) -> str:
    """A turn between its marks, nothing escaped."""
    if role in MARKS:
        opening, closing = MARKS[role]
        return f"{opening}{text}{closing}"
    return f"{OTHER[0]}{role}{OTHER[1]}{text}{OTHER[2]}"


def _turns(output: str) -> Iterator[tuple[str, int, int]]:
    """Roles of formatted turns, and where their texts, still escaped, lie."""
    at = 0

    def until(mark: str) -> tuple[int, int]:
        nonlocal at
        start, end = at, output.find(mark, at)
        if end < 0:
            raise Malformed(f"no {mark!r} after {start}")
        at = end + len(mark)
        return start, end

    while at < len(output):
        role = next((r for r, (opening, _) in MARKS.items() if output.startswith(opening, at)), None)
        if role is not None:
            at += len(MARKS[role][0])
            yield role, *until(MARKS[role][1])
        elif output.startswith(OTHER[0], at):
            at += len(OTHER[0])
            start, end = until(OTHER[1])
            yield plain(output[start:end]), *until(OTHER[2])
        else:
            raise Malformed(f"no turn starts at {at}")


def parsed(output: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns, marks taken off and escapes undone."""
    for role, start, end in _turns(output):
        yield role, plain(output[start:end])


def formatted(role: str, text: str) -> str:
    """A turn that parses back to exactly this role and text."""
    name, body = role, text
    for _ in range(3):  # as it is, with the text escaped, with the name escaped too
        output = written(name, body)
        try:
            if list(parsed(output)) == [(role, text)]:
                return output
        except Malformed:
            pass
        name, body = (name, escaped(text)) if body == text and escaped(text) != text else (escaped(role), body)
    raise Malformed(f"turn does not come back: {output[:80]!r}")


def loss_spans(output: str) -> Iterator[tuple[int, int]]:
    """Where the assistant's texts, still escaped, lie in formatted turns."""
    return ((start, end) for role, start, end in _turns(output) if role == ASSISTANT)


class _Digest:
    """Running digests of one conversation, fed turn by turn from its output."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, output: str) -> None:
        self.chars += len(output)
        for role, text in parsed(output):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for start, end in loss_spans(output):
            text = plain(output[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation behind one another, each conversation in one task.

    Only the order needs that; a task then holds one batch, however long a
    conversation is.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _formatted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, said = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        outputs = [formatted(r, t) for r, t in zip(roles, said, strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(outputs, pa.string())], names=["conv_id", "turn", "output"])


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Conversation, turn and the formatted turn, in order within each conversation.

    Put together in this order, the outputs of a conversation are its
    formatted text.
    """
    return in_order(turns).mapInArrow(_formatted_rows, "conv_id bigint, turn bigint, output string")


def digests(outputs: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back.

    ``outputs`` are those of ``formatted_turns``, in its order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, digest = None, None
        for batch in batches:
            done = []
            for conv, output in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, *digest.row()))
                    current, digest = conv, _Digest()
                digest.add(output)
            if done:
                yield pa.record_batch([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=names)
        if digest is not None:
            last = (current, *digest.row())
            yield pa.record_batch([pa.array([last[k]], kind) for k, kind in enumerate(kinds)], names=names)

    return outputs.select("conv_id", "output").mapInArrow(
        read,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def with_marks_conversation(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts are nothing but marks."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame(
        [(-7, 0, USER, said), (-7, 1, ASSISTANT, said)], "conv_id bigint, turn bigint, role string, text string"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
