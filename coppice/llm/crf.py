"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line with a word is good or bad.  Its features are shares of character
classes, word lengths and repetitions, its own and those of its neighbours;
the field adds transitions between lines.  It is fitted to documents whose
lines all carry the document's label, by the gradient of the conditional
likelihood (forward-backward).  A document's quality is the mean of its lines'
marginals, weighted by their lengths, calibrated on the same documents.

The field is fitted on a bounded sample of labelled rows, ``SAMPLE`` at most,
the first in an order of hashes; only their line features come to the driver.
Scoring reads whole texts, in tasks.

Results for odd input: a null text or one without words scores the share of
good documents in the sample; no usable labels give 0.5 everywhere; of
repeated labels of a document the lowest counts; repeated documents are scored
each.  Only the text is an input of a score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.divergence import CLASSES, TABLE
from coppice.llm.words import slices, texts

SAMPLE = 4000
STEPS = 200
GOOD = 0.7
OWN = 2 + (len(CLASSES) - 1) + 4  # features of a line by itself
WIDTH = 1 + 3 * OWN + 2  # with those of both neighbours, a constant, and whether it is first or last


def _own_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every line with a word: its features, and its length in characters."""
    lines = [(line, words) for line in text.split(b"\n") if (words := line.split())]
    if not lines:
        return np.zeros((0, OWN), np.float32), np.zeros(0, np.float32)
    octets = np.frombuffer(b"".join(line for line, _ in lines), np.uint8)
    sizes = np.fromiter((len(line) for line, _ in lines), np.int64, len(lines))
    codes = np.repeat(np.arange(len(lines)) * len(CLASSES), sizes) + TABLE[octets]
    counts = np.bincount(codes, minlength=len(lines) * len(CLASSES)).reshape(len(lines), -1)[:, :-1]
    chars = counts.sum(axis=1)
    n_words = np.fromiter((len(words) for _, words in lines), np.float64, len(lines))
    again = np.fromiter((sum(map(operator.eq, words, words[1:])) for _, words in lines), np.float64, len(lines))
    distinct = np.fromiter((len(set(words)) for _, words in lines), np.float64, len(lines))
    seen: set[bytes] = set()
    earlier = np.fromiter((line in seen or bool(seen.add(line)) for line, _ in lines), np.float64, len(lines))
    solid = chars - counts[:, CLASSES.index("space")]
    features = np.column_stack(
        [
            np.log1p(chars) / 5,
            solid / n_words / 10,
            3 * np.sqrt(counts / chars[:, None]),
            3 * again / n_words,
            distinct / n_words,
            earlier,
            np.minimum(n_words, 5) / 5,
        ]
    )
    return features.astype(np.float32), chars.astype(np.float32)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line with a word, neighbours' included, and the lines' lengths."""
    own, chars = _own_features(text)
    n = len(own)
    features = np.zeros((n, WIDTH), np.float32)
    features[:, 0] = 1
    features[:, 1 : 1 + OWN] = own
    features[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    features[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    features[:1, -2] = 1
    features[n - 1 :, -1] = 1
    return features, chars


@dataclass
class Field:
    """Weights of the good state against the bad one, transitions, first state, calibration."""

    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.5


class _Chains:
    """Documents as chains of lines, laid out so that line t of all long enough ones is a slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.order]
        longest = int(ordered[0]) if len(ordered) else 0
        self.active = [int(np.searchsorted(-ordered, -t, "left")) for t in range(longest)]
        self.rows = [starts[:n] + t for t, n in enumerate(self.active)]


def _marginals(field: Field, e: np.ndarray, chains: _Chains, pairs: bool = False):
    """Probability that each line is good; the logarithm of the partition function; expected transitions."""
    good = 1 / (1 + np.exp(-np.clip(e, -40, 40)))
    local = np.column_stack([1 - good, good])
    jump = np.exp(field.transitions)
    forward = np.zeros((len(e), 2))
    scale = np.ones(len(e))
    for t, rows in enumerate(chains.rows):
        before = np.exp(field.first) if t == 0 else forward[chains.rows[t - 1][: len(rows)]] @ jump
        here = before * local[rows]
        scale[rows] = here.sum(axis=1)
        forward[rows] = here / scale[rows, None]
    backward = np.ones((len(e), 2))
    expected = np.zeros((2, 2))
    for t in range(len(chains.rows) - 1, 0, -1):
        rows = chains.rows[t]
        earlier = chains.rows[t - 1][: len(rows)]
        ahead = local[rows] * backward[rows] / scale[rows, None]
        if pairs:
            expected += forward[earlier].T @ ahead * jump
        backward[earlier] = ahead @ jump.T
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), np.log(scale).sum() + np.logaddexp(0, e).sum(), expected


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS) -> Field:
    """A field from line features, line lengths and label of each document."""
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2))
    documents = [d for d in documents if d[2] in (0, 1)]
    if documents:
        field.prior = (1 + sum(y for _, _, y in documents)) / (2 + len(documents))
    worded = [d for d in documents if len(d[0])]
    if not worded:
        return field
    x = np.concatenate([f for f, _, _ in worded]).astype(np.float64)
    lengths = np.array([len(f) for f, _, _ in worded])
    y = np.repeat([label for _, _, label in worded], lengths).astype(np.float64)
    chains = _Chains(lengths)
    firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    same = np.zeros((2, 2))
    np.add.at(same, (y[firsts].astype(int), y[firsts].astype(int)), lengths - 1)
    starts = np.bincount(y[firsts].astype(int), minlength=2)
    # A document is one observation, however many lines it has.
    flat = np.concatenate([field.weights, field.transitions.ravel(), field.first])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, steps + 1):
        field.weights, field.transitions, field.first = flat[:WIDTH], flat[WIDTH : WIDTH + 4].reshape(2, 2), flat[WIDTH + 4 :]
        e = x @ field.weights
        marginal, _, expected = _marginals(field, e, chains, pairs=True)
        slope = np.concatenate(
            [
                x.T @ (y - marginal),
                (same - expected).ravel(),
                starts - np.array([(1 - marginal[firsts]).sum(), marginal[firsts].sum()]),
            ]
        ) / len(y) - 1e-4 * flat
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        flat = flat + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    field.weights, field.transitions, field.first = flat[:WIDTH], flat[WIDTH : WIDTH + 4].reshape(2, 2), flat[WIDTH + 4 :]
    raw = _logit(raw_scores(field, [(f, c) for f, c, _ in worded]))
    labels = np.array([label for _, _, label in worded], float)
    a, b = 0.5, 0.0
    for _ in range(500):  # two numbers: plain gradient steps
        error = labels - 1 / (1 + np.exp(-(a * raw + b)))
        a, b = a + 0.05 * ((error * raw).mean() - 1e-3 * a), b + 0.5 * error.mean()
    field.scale = (float(max(a, 1e-3)), float(b))
    return field


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def raw_scores(field: Field, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Length-weighted mean marginal of each document; NaN without a line."""
    lengths = np.array([len(f) for f, _ in documents])
    if not lengths.sum():
        return np.full(len(documents), np.nan)
    x = np.concatenate([f for f, _ in documents])
    weight = np.concatenate([c for _, c in documents]).astype(np.float64)
    marginal, _, _ = _marginals(field, x @ field.weights, _Chains(lengths))
    owner = np.repeat(np.arange(len(documents)), lengths)
    with np.errstate(invalid="ignore"):
        return np.bincount(owner, marginal * weight, len(documents)) / np.bincount(owner, weight, len(documents))


def scores(field: Field, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    raw = raw_scores(field, documents)
    a, b = field.scale
    return np.where(np.isnan(raw), field.prior, 1 / (1 + np.exp(-(a * _logit(np.nan_to_num(raw, nan=0.5)) + b))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = [line_features(t) for t in texts(batch)]
        yield pa.record_batch(
            [
                batch.column(batch.schema.get_field_index("label")),
                pa.array([f.tobytes() for f, _ in made], pa.binary()),
                pa.array([c.tobytes() for _, c in made], pa.binary()),
            ],
            names=["label", "features", "chars"],
        )


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(chosen), "id")
    rows = rows.mapInArrow(_features, "label int, features binary, chars binary").collect()
    documents = [
        (np.frombuffer(r.features, np.float32).reshape(-1, WIDTH), np.frombuffer(r.chars, np.float32), r.label) for r in rows
    ]
    return fit(sorted(documents, key=lambda d: (d[2], len(d[0]), d[1].sum())))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: ``held_out``, ``score`` and ``predicted``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scores(field, [line_features(t) for t in texts(batch)])
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array((found >= GOOD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(
        score, "doc_id bigint, held_out boolean, score double, predicted int"
    )
