"""LM scoring: a gated recurrent model with a class-factored softmax, in numpy.

Tokens are lower-cased words and one end for each document.  Counts of all
tokens are taken over all training documents.  The most frequent ``WORDS``
have an input row and an output row of their own and belong to classes of
neighbouring frequency; every other token belongs to a tail class by its last
two bytes, where its probability is its share of the class's counts (a token
never seen has 0.1 there, so each class adds up to 1).  The probability of a
token is that of its class, from the state, times that within its class, for
the frequent ones from the state too.

Training reads all training documents, each in one of the rounds: every task
trains from the round's weights on its documents, and the tasks' weights are
averaged by the tokens they saw.  The state is carried through whole
documents, gradients stop at windows of ``WINDOW`` tokens, and every window's
gradient counts.  Windows of few lanes, as the rest of a long document, add up
to ``STEP`` tokens before the weights move, so that each token counts alike.

Scoring carries the state from the first to the last token of a document.
Counts of the ``KNOWN`` most frequent tokens travel with the tasks; those of
all others are joined, so no document sends a frequent token through a shuffle.

Results for odd input: a null text is an empty one, with the end as its only
token; repeated rows are scored each, and count each in training; rows without
``doc_id`` are training rows.  Only text and ``doc_id`` are looked at.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.words import slices, texts
from coppice.session import cut

END = b""  # no word is empty
KNOWN = 150_000  # tokens, at most, whose counts travel with the tasks
WORDS = 1936  # of them, with rows of their own
PER_CLASS = 44
TAILS = 32
STATE = 16
WINDOW = 32
STEP = 2048
SHARES = [1, 5, 32]  # training documents up to which of 32 parts a round takes them
RATE = 0.02
SMOOTH = 0.1
CHUNK = 12 << 20  # bytes of text that go through the model together
LANES = 384
TOGETHER = 1 << 15  # tokens whose odds a call works out, when the weights stand still
ROWS = 1024  # tokens whose odds are worked out at once, few enough for the processor's cache


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % TAILS


def _as_text(words: pa.Array) -> pa.Array:
    """Bytes as Arrow's text, unchecked: only its ASCII functions see them."""
    return pa.Array.from_buffers(pa.large_string(), len(words), words.buffers())


def words_of(read: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """``tokens_of`` without the ends, of all texts one after another, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(_as_text(pa.array(read, pa.large_binary()))))
    # Blanks at either end of a text leave an empty word there.
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), np.diff(before[parts.offsets.to_numpy()])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


# --- counts -----------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def told() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        for start in range(0, len(items), 50_000):
            part = items[start : start + 50_000]
            yield pa.record_batch(
                [pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["token", "n"]
            )
        counts.clear()

    for batch in slices(batches):
        for text in texts(batch):
            counts.update(tokens_of(text))
        if len(counts) > 250_000:
            yield from told()
    yield from told()


def counted(docs: DataFrame) -> DataFrame:
    """Tokens of the training documents with their numbers."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("text")
    return rows.mapInArrow(_counted, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Tokens by rank and what belongs to them; bounded by ``KNOWN``."""

    ranks: dict[bytes, int]
    counts: np.ndarray
    inputs: np.ndarray  # row in the input table, and for tails WORDS + class
    n_words: int
    total: int
    distinct: int
    tails: np.ndarray  # logarithm of what a tail class adds up to

    @property
    def n_classes(self) -> int:
        """Classes of frequent words; the tail classes follow them."""
        return -(-self.n_words // PER_CLASS)


def vocabulary(counts: DataFrame, known: int = KNOWN, words: int = WORDS) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Numbers of tokens by steps of frequency say from where on they are few enough to come to the driver.
    step = F.floor(16 * F.log2("n"))
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("tokens")).orderBy(F.desc("step")).collect()
    lowest, held = None, 0
    for r in steps:
        held += r.tokens
        if held > known:
            break
        lowest = r.step
    top = [] if lowest is None else counts.where(step >= lowest).collect()
    top.sort(key=lambda r: (-r.n, bytes(r.token)))
    n_words = min(words, len(top))
    of_top = np.array([r.n for r in top], np.float64)
    tail = [tail_class(bytes(r.token)) for r in top]
    inputs = np.array([k if k < n_words else n_words + c for k, c in enumerate(tail)], np.int32)
    ending = F.crc32(F.expr("substring(token, -2, 2)")) % TAILS
    mass = np.full(TAILS, SMOOTH)
    for r in counts.groupBy(ending.alias("c")).agg(F.sum(F.col("n") + F.lit(SMOOTH)).alias("mass")).collect():
        mass[r.c] += r.mass
    for c, n in zip(tail[:n_words], of_top[:n_words], strict=True):
        mass[c] -= n + SMOOTH
    return Vocabulary(
        {bytes(r.token): k for k, r in enumerate(top)},
        of_top,
        inputs,
        n_words,
        int(total),
        int(distinct),
        np.log(np.maximum(mass, SMOOTH)),
    )


# --- the model --------------------------------------------------------------


@dataclass
class Model:
    """Weights.  Input rows already hold the three gates' parts."""

    table: np.ndarray  # input rows: words, tails, start; (rows, 3 * STATE)
    recur: np.ndarray  # (STATE, 3 * STATE)
    classes: np.ndarray  # (STATE, classes)
    class_bias: np.ndarray
    words: np.ndarray  # (words, STATE)
    word_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def views(self, flat: np.ndarray) -> Model:
        """Weights of the same shapes that lie in ``flat``."""
        made, at = [], 0
        for a in self.arrays():
            made.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        return Model(*made)

    def like(self, flat: np.ndarray) -> Model:
        return self.views(flat.astype(np.float32))


def first_model(vocab: Vocabulary, seed: int = 7) -> Model:
    """Small random weights; with the biases alone the model is the unigram one."""
    rng = np.random.default_rng(seed)
    n, k = vocab.n_words, vocab.n_classes
    head = np.add.reduceat(vocab.counts[:n], np.arange(0, n, PER_CLASS)) if n else np.zeros(0)
    mass = np.concatenate([head, np.exp(vocab.tails)])
    logs = np.log(np.maximum(vocab.counts[:n], 1))
    logs -= np.repeat(np.maximum.reduceat(logs, np.arange(0, n, PER_CLASS)), PER_CLASS)[:n] if n else 0
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Model(
        small(n + TAILS + 1, 3 * STATE),
        (rng.normal(0, 1, (STATE, 3 * STATE)) / np.sqrt(STATE)).astype(np.float32),
        small(STATE, k + TAILS),
        np.log(mass / mass.sum()).astype(np.float32),
        small(n, STATE),
        logs.astype(np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _order(numbers: np.ndarray) -> np.ndarray:
    """A stable order; short numbers are sorted by digits."""
    return np.argsort(numbers.astype(np.uint16) if numbers.size and numbers.max() < 1 << 16 else numbers, kind="stable")


class Lanes:
    """Documents of a chunk laid end to end in lanes of about equal length, the longest lane first.

    ``ids`` are input rows of all tokens, document after document.  Step t of
    the lanes that are that long is a slice of the lanes.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, start: int):
        before = np.concatenate([[start], ids[:-1]]).astype(np.int32)
        firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        before[firsts] = start
        count = int(max(1, min(LANES, len(lengths), ids.size // max(1, lengths.max()) + 8)))
        heap = [(0, k) for k in range(count)]
        owned: list[list[int]] = [[] for _ in range(count)]
        for d in np.argsort(-lengths, kind="stable"):
            load, k = heapq.heappop(heap)
            owned[k].append(int(d))
            heapq.heappush(heap, (load + int(lengths[d]), k))
        owned.sort(key=lambda ds: -int(lengths[ds].sum()))
        self.places = [np.concatenate([np.arange(firsts[d], firsts[d] + lengths[d]) for d in ds]) for ds in owned]
        self.long = np.array([len(p) for p in self.places])
        self.inputs, self.targets, self.start = before, ids, start

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token places of the next steps, (steps, lanes), and how many lanes each step has."""
        for at in range(0, int(self.long[0]), size):
            steps = min(size, int(self.long[0]) - at)
            active = np.array([int(np.searchsorted(-self.long, -(at + t), "left")) for t in range(steps)])
            places = np.zeros((steps, active[0]), np.int64)
            for k in range(active[0]):
                own = self.places[k][at : at + steps]
                places[: len(own), k] = own
            yield places, active


def _forward(model: Model, inputs: np.ndarray, active: np.ndarray, start: int, state: np.ndarray, keep: bool) -> tuple:
    """States after every step; with ``keep`` also what the gradients need."""
    shape = (len(active), active[0], STATE)
    states = np.zeros(shape, np.float32)
    kept = [np.zeros(shape, np.float32) for _ in range(5)] if keep else []
    gates = model.table.take(inputs, axis=0)
    going = inputs != start
    any_fresh = ~going.all(axis=1)
    with np.errstate(over="ignore"):  # of a gate that is shut
        for t, n in enumerate(active):
            h = state[:n]
            if any_fresh[t]:
                h = h * going[t, :n, None]
            a = h @ model.recur
            x = gates[t, :n]
            zr = _sigmoid(x[:, : 2 * STATE] + a[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            u = a[:, 2 * STATE :]
            c = r * u
            c += x[:, 2 * STATE :]
            np.tanh(c, out=c)
            state = states[t, :n]
            np.subtract(h, c, out=state)
            state *= z
            state += c
            for held, value in zip(kept, (h, z, r, u, c), strict=False):
                held[t, :n] = value
    return states, state, kept


def _class_of(targets: np.ndarray, n_words: int, n_classes: int) -> np.ndarray:
    return np.where(targets < n_words, targets // PER_CLASS, targets - n_words + n_classes)


def _odds(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray, wild: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of all outputs, their sums, and the log-probability of the chosen ones."""
    logits = states @ weights
    logits += bias
    if wild:
        np.minimum(logits, np.float32(60), out=logits)
    found = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], np.float32)
    found -= np.log(sums)
    return logits, sums, found


def _wild(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether an output can come to 60 at all, as states are within 1."""
    return bool(weights.size) and not float((np.abs(weights).sum(axis=0) + bias).max()) < 59


def _output(model: Model, states: np.ndarray, targets: np.ndarray, slopes: Model | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probability of each target (of tails: of their class), and the gradient of its sum by the states."""
    n_words = len(model.words)
    n_classes = model.classes.shape[1] - TAILS
    order = _order(targets)  # by target is by class, too
    states, targets = states[order], targets[order]
    classes = _class_of(targets, n_words, n_classes)
    found = np.empty(len(targets), np.float32)
    down = None if slopes is None else np.empty_like(states)
    wild = _wild(model.classes, model.class_bias)
    for at in range(0, len(targets), ROWS):
        own = slice(at, at + ROWS)
        odds, sums, found[own] = _odds(states[own], model.classes, model.class_bias, classes[own], wild)
        if slopes is not None:
            share = np.float32(-1) / sums
            down[own] = (odds @ model.classes.T) * share[:, None]
            slopes.classes += (states[own] * share[:, None]).T @ odds
            slopes.class_bias += share @ odds
    if slopes is not None:
        down += model.classes.T.take(classes, axis=0)
        firsts = np.flatnonzero(np.diff(classes, prepend=-1))
        slopes.classes[:, classes[firsts]] += np.add.reduceat(states, firsts, axis=0).T
        slopes.class_bias += np.bincount(classes, minlength=len(model.class_bias)).astype(np.float32)
    ends = np.searchsorted(classes, np.arange(n_classes + 1))
    wild = _wild(model.words.T, model.word_bias)
    for k in np.flatnonzero(ends[1:] > ends[:-1]):
        lo, hi = k * PER_CLASS, min((k + 1) * PER_CLASS, n_words)
        weights = model.words[lo:hi]
        own = slice(ends[k], ends[k + 1])
        if slopes is None:
            for at in range(own.start, own.stop, ROWS):
                part = slice(at, min(at + ROWS, own.stop))
                found[part] += _odds(states[part], weights.T, model.word_bias[lo:hi], targets[part] - lo, wild)[2]
        else:
            odds, sums, here = _odds(states[own], weights.T, model.word_bias[lo:hi], targets[own] - lo, wild)
            found[own] += here
            share = np.float32(-1) / sums
            down[own] += (odds @ weights) * share[:, None]
            slopes.words[lo:hi] += odds.T @ (states[own] * share[:, None])
            slopes.word_bias[lo:hi] += share @ odds
    if slopes is not None and ends[-1]:
        known = targets[: ends[-1]]
        down[: ends[-1]] += model.words.take(known, axis=0)
        firsts = np.flatnonzero(np.diff(known, prepend=-1))
        slopes.words[known[firsts]] += np.add.reduceat(states[: ends[-1]], firsts, axis=0)
        slopes.word_bias += np.bincount(known, minlength=n_words).astype(np.float32)
    back = np.empty_like(found)
    back[order] = found
    if down is not None:
        spread = np.empty_like(down)
        spread[order] = down
        down = spread
    return back, down


def _backward(model: Model, slopes: Model, inputs: np.ndarray, active: np.ndarray, start: int, kept: list, down: np.ndarray) -> None:
    """Adds the gradients of a window, truncated at its start, to ``slopes``."""
    steps, lanes = inputs.shape
    h, z, r, u, c = kept
    of_z = (h - c) * z * (1 - z)
    of_r = u * r * (1 - r)
    of_c = (1 - z) * (1 - c * c)
    into = np.zeros((steps, lanes, 3 * STATE), np.float32)
    recurrent = np.zeros_like(into)
    back = np.ascontiguousarray(model.recur.T)
    going = inputs != start
    any_fresh = ~going.all(axis=1)
    carried = np.zeros((0, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        dh = down[t, :n].copy()
        dh[: len(carried)] += carried
        here, da = into[t, :n], recurrent[t, :n]
        np.multiply(dh, of_z[t, :n], out=here[:, :STATE])
        dc = dh * of_c[t, :n]
        np.multiply(dc, of_r[t, :n], out=here[:, STATE : 2 * STATE])
        here[:, 2 * STATE :] = dc
        da[:, : 2 * STATE] = here[:, : 2 * STATE]
        np.multiply(dc, r[t, :n], out=da[:, 2 * STATE :])
        carried = da @ back
        dh *= z[t, :n]
        carried += dh
        if any_fresh[t]:
            carried *= going[t, :n, None]
    slopes.recur += h.reshape(-1, STATE).T @ recurrent.reshape(-1, 3 * STATE)
    flat = inputs.ravel()
    order = _order(flat)
    ordered = flat[order]
    firsts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    slopes.table[ordered[firsts]] += np.add.reduceat(into.reshape(-1, 3 * STATE).take(order, axis=0), firsts)


class Trainer:
    """Adam steps on a model of its own."""

    def __init__(self, model: Model, rate: float = RATE):
        self.weights = model.flat()
        self.model = model.views(self.weights)
        self.rate, self.steps, self.seen = rate, 0, 0
        self.mean, self.square, self.slope, self._a, self._b = (np.zeros_like(self.weights) for _ in range(5))
        self.slopes, self.waiting = model.views(self.slope), 0  # of tokens that have not moved the weights yet

    def read(self, lanes: Lanes) -> None:
        state = np.zeros((len(lanes.places), STATE), np.float32)
        for places, active in lanes.windows(WINDOW):
            inputs = lanes.inputs[places]
            mask = np.arange(places.shape[1]) < active[:, None]
            states, state, kept = _forward(self.model, inputs, active, lanes.start, state, True)
            self._learn(lanes, places, inputs, active, mask, states, kept)
            self.seen += int(active.sum())

    def _learn(self, lanes: Lanes, places, inputs, active, mask, states, kept) -> None:
        _, down = _output(self.model, states[mask], lanes.targets[places[mask]], self.slopes)
        spread = np.zeros_like(states)
        spread[mask] = down
        # Steps that a lane does not have add nothing to the tables.
        _backward(self.model, self.slopes, inputs, active, lanes.start, kept, spread)
        self.waiting += int(mask.sum())
        if self.waiting >= STEP:
            self.step()

    def step(self) -> None:
        """Moves the weights by all gradients that wait."""
        if not self.waiting:
            return
        self.steps += 1
        slope, mean, square, a, b = self.slope, self.mean, self.square, self._a, self._b
        slope /= np.float32(self.waiting)
        np.subtract(slope, mean, out=a)
        a *= np.float32(0.1)
        mean += a
        np.multiply(slope, slope, out=a)
        a -= square
        a *= np.float32(0.01)
        square += a
        np.divide(square, np.float32(1 - 0.99**self.steps), out=a)
        np.sqrt(a, out=a)
        a += np.float32(1e-6)
        np.divide(mean, np.float32(1 - 0.9**self.steps), out=b)
        b *= np.float32(self.rate)
        b /= a
        self.weights += b
        slope.fill(0)
        self.waiting = 0


def log_probabilities(model: Model, lanes: Lanes) -> np.ndarray:
    """Natural logarithm for each token, tails by their class only, the state carried through each document."""
    found = np.zeros(len(lanes.targets), np.float32)
    state = np.zeros((len(lanes.places), STATE), np.float32)
    held, waiting = [], 0  # states of windows whose outputs are worked out together

    def told() -> None:
        at = np.concatenate([p for p, _ in held])
        found[at], _ = _output(model, np.concatenate([h for _, h in held]), lanes.targets[at], None)

    for places, active in lanes.windows(WINDOW):
        mask = np.arange(places.shape[1]) < active[:, None]
        states, state, _ = _forward(model, lanes.inputs[places], active, lanes.start, state, False)
        held.append((places[mask], states[mask]))
        waiting += len(held[-1][0])
        if waiting >= TOGETHER:
            told()
            held, waiting = [], 0
    if held:
        told()
    return found


# --- in tasks ---------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Rows whose texts are about ``CHUNK`` bytes together, or one longer one."""
    held, read, size = [], [], 0
    for batch in slices(batches, 64):
        found = texts(batch)
        held.append(batch)
        read += found
        size += sum(map(len, found))
        if size >= CHUNK:
            yield held, read
            held, read, size = [], [], 0
    if read:
        yield held, read


def _numbered(vocab: Vocabulary, read: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Input rows and ranks (-1: not known) of all tokens, the documents' lengths, and the unknown words."""
    words, lengths = words_of(read)
    found = pc.index_in(words, _as_text(pa.array(vocab.ranks, pa.large_binary())))
    lengths = lengths + 1
    ends = np.cumsum(lengths) - 1
    rank = np.empty(int(lengths.sum()), np.int32)
    worded = np.ones(len(rank), bool)
    worded[ends] = False
    rank[worded] = found.fill_null(-1).to_numpy()
    rank[ends] = vocab.ranks.get(END, -1)
    ids = vocab.inputs[rank] if len(vocab.inputs) else np.zeros(len(rank), np.int32)
    unknown = rank < 0
    rare = words.filter(found.is_null()).cast(pa.large_binary())
    endings = pc.binary_slice(rare, -2).dictionary_encode()
    by_ending = np.array([tail_class(e) for e in endings.dictionary.to_pylist()], np.int32)
    ids[unknown & worded] = vocab.n_words + by_ending[endings.indices.to_numpy()]
    ids[unknown & ~worded] = vocab.n_words + tail_class(END)
    return ids, rank, lengths, rare


def _rest(rank: np.ndarray, lengths: np.ndarray, rare: pa.Array) -> list[list[bytes]]:
    """Each document's unknown tokens, from what ``_numbered`` found."""
    unknown = np.add.reduceat(rank < 0, np.cumsum(lengths) - lengths, dtype=np.int64)
    ended = rank[np.cumsum(lengths) - 1] < 0  # an end that is not known is no word
    left = iter(rare.to_pylist())
    return [[*islice(left, n - e), *([END] if e else [])] for n, e in zip(unknown.tolist(), ended.tolist(), strict=True)]


def _vector_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights times tokens, one vector in memory at a time."""
    tokens, total = 0, None
    for batch in batches:
        for n, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            here = np.frombuffer(vector, np.float64)
            tokens, total = tokens + n, here.copy() if total is None else total + here
    if total is not None:
        yield pa.record_batch([pa.array([tokens], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


def _tasks(scanned: int, share: int, of: int, cores: int) -> int:
    """Tasks for a share of the documents: the same share of those that scan all, but one for each core.

    A step costs little more for many lanes than for few, so a task should have
    enough documents to fill them.
    """
    return max(1, min(scanned, max(cores, -(-scanned * share // of))))


def trained(docs: DataFrame, vocab: Vocabulary, shares: list[int] = SHARES) -> Model:
    """A model that has read every training document once."""
    context = docs.sparkSession.sparkContext
    model = first_model(vocab)
    shared = context.broadcast(vocab)
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(shares[-1]))
    tasks = docs.select("text").rdd.getNumPartitions()
    for low, high in zip([0, *shares], shares, strict=False):
        sent = context.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(sent.value)
            start = shared.value.n_words + TAILS
            for _, read in _chunks(batches):
                ids, _, lengths, _ = _numbered(shared.value, read)
                trainer.read(Lanes(ids, lengths, start))
            trainer.step()
            if trainer.seen:
                weights = trainer.model.flat().astype(np.float64) * trainer.seen
                yield pa.record_batch(
                    [pa.array([trainer.seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["n", "weights"]
                )

        rows = docs.where(~held_out(F.col("doc_id"))).where((part >= low) & (part < high)).select("text")
        rows = rows.coalesce(_tasks(tasks, high - low, shares[-1], context.defaultParallelism))
        kind = "n bigint, weights binary"
        # A few tasks add up what all the others learned: the driver gets as many vectors, whatever the input.
        found = rows.mapInArrow(train, kind).repartition(4).mapInArrow(_vector_sums, kind).collect()
        tokens = sum(r.n for r in found)
        if tokens:
            model = model.like(sum(np.frombuffer(r.weights, np.float64) for r in found) / tokens)
        sent.unpersist()
    return model


def scored(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """One row per document: tokens, known tokens, unigram score and the model's, as log10."""
    context = docs.sparkSession.sparkContext
    shared, sent = context.broadcast(vocab), context.broadcast(model)
    whole = float(np.log10(vocab.total + SMOOTH * (vocab.distinct + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value, sent.value
        start = vocab.n_words + TAILS
        within = np.append(np.log10(vocab.counts + SMOOTH), 0.0)  # the last one for ranks of -1
        for held, read in _chunks(batches):
            ids, rank, lengths, rare = _numbered(vocab, read)
            found = log_probabilities(model, Lanes(ids, lengths, start)).astype(np.float64)
            tail = ids >= vocab.n_words
            found[tail] -= vocab.tails[ids[tail] - vocab.n_words]
            found /= np.log(10)
            found[tail] += within[rank[tail]]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            bags = [Counter(ws) for ws in _rest(rank, lengths, rare)]
            rows = pa.Table.from_batches(held)
            yield from pa.table(
                [
                    rows.column(0),
                    rows.column(1),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.bincount(owner, rank >= 0, len(lengths)).astype(np.int64)),
                    pa.array(np.bincount(owner, within[rank], len(lengths)) - lengths * whole),
                    pa.array(np.bincount(owner, found, len(lengths))),
                    pa.array([list(b) for b in bags], pa.list_(pa.binary())),
                    pa.array([list(b.values()) for b in bags], pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rest", "times"],
            ).to_batches()

    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(
        score,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, "
        "rest array<binary>, times array<bigint>",
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("t")).select("row", "t.rest", "t.times")
    met = rest.join(counts.select(F.col("token").alias("rest"), "n"), "rest", "left")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"),
    )
    both = rows.drop("rest", "times").join(more, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def read_and_scored(docs: DataFrame) -> DataFrame:
    """Counts, training and scores, all from ``docs``."""
    counts = cut(counted(docs), "token-counts")
    vocab = vocabulary(counts)
    return scored(docs, counts, vocab, trained(docs, vocab))
