"""Quality rules: distance of a text's histograms from those of its language.

Every language of at least ``ENOUGH`` words in the corpus, whatever its share,
gets two reference histograms, taken from all its documents: the median share of each character class (so that junk,
or one very long text, does not move it), and its common words (all words that
hold at least ``COMMON`` of its words, so at most ``1 / COMMON`` of them) with
one bin for the rest.  A document is compared with the references by
Jensen-Shannon distance (base 2, so 0 to 1); the nearest language counts, so a
wrong language label does no harm.  The ``MANY`` languages with the most words
travel with the tasks; the references of others are written as a table and
joined to their own documents.  Short texts have ragged histograms, so
each comparison has a minimum length below which it passes.

Results for odd input: a null text has no words; with no or few words
``base_failed`` is true; a document without a language, or in one without
references, has nothing to be compared with: its distances are 0 and it passes
the divergence rules, as short texts do.  Every input row gives one row,
repeated rows repeated ones.  Other columns than ``lang`` and ``text`` are not
looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.llm.words import slices, texts
from coppice.session import cut

COMMON = 0.004  # share of its language's words that makes a word a common one
ENOUGH = 2_000  # words from which on a language's histograms are stable
MANY = 200  # languages whose references travel with the tasks
MIN_WORDS = 50  # fewer words fail the base rule
MAX_REPEATED = 50  # percent of words in repeated 3-word windows
CHARS_FROM, CHARS_LIMIT = 200, 0.3  # characters needed, and largest distance, for the class histogram
WORDS_FROM, WORDS_LIMIT = 50, 0.4  # words needed, and largest distance, for the common-word histogram

BINS = 200  # of the square root of a share, for the medians
CLASSES = ["lower", "upper", "digit", "space", "stop", "symbol", "mark", "other", "inner"]


def _class_table() -> np.ndarray:
    """Class of each byte; ``inner`` are the later bytes of a character beyond ASCII."""
    table = np.full(256, CLASSES.index("mark"), np.uint8)
    table[0x80:0xC0] = CLASSES.index("inner")
    table[0xC0:] = CLASSES.index("other")
    for name, chars in {
        "lower": range(ord("a"), ord("z") + 1),
        "upper": range(ord("A"), ord("Z") + 1),
        "digit": range(ord("0"), ord("9") + 1),
        "space": b" \t\n\x0b\x0c\r",
        "stop": b".,;:'\"()-?",
        "symbol": b"#*$%&|<>",
    }.items():
        table[list(chars)] = CLASSES.index(name)
    return table


TABLE = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    """Characters by class, of a UTF-8 text."""
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES))[:-1]


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a 3-word window which the text has twice or more.

    ``ids`` number the distinct words of the text.
    """
    if len(ids) < 4:
        return 0
    if n_distinct < 1 << 21:  # three numbers fit into 64 bits
        windows = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:
        _, pairs = np.unique(ids[:-2] * n_distinct + ids[1:-1], return_inverse=True)
        windows = pairs * n_distinct + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= again
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of histograms along the last axis, each adding up to 1: roots of the divergence in bits."""
    m = (p + q) / 2
    m[m == 0] = 1
    both = p * np.log2(np.where(p > 0, p / m, 1)) + q * np.log2(np.where(q > 0, q / m, 1))
    return np.sqrt(np.maximum(0.0, both.sum(axis=-1) / 2))


class References:
    """Class and common-word histograms of the languages, one row each.

    ``histograms`` has by language its class counts and the shares of its
    common words.  ``rare`` is the table of further languages, if there are any.
    """

    def __init__(self, histograms: dict[str, tuple[np.ndarray, dict[bytes, float]]], rare: DataFrame | None = None):
        self.rare = rare
        self.languages = sorted(histograms)
        self.words = sorted({w for _, shares in histograms.values() for w in shares})
        places = {w: k for k, w in enumerate(self.words)}
        longest = max((len(shares) for _, shares in histograms.values()), default=0)
        self.classes = np.zeros((len(self.languages), len(CLASSES) - 1))
        # Places in ``words``; a language with fewer common words points behind their end.
        self.places = np.full((len(self.languages), longest), len(self.words))
        self.shares = np.zeros((len(self.languages), longest + 1))
        for row, lang in enumerate(self.languages):
            chars, shares = histograms[lang]
            self.classes[row] = chars / max(chars.sum(), 1e-9)
            self.places[row, : len(shares)] = [places[w] for w in shares]
            self.shares[row, : len(shares)] = list(shares.values())
            self.shares[row, -1] = max(0.0, 1 - sum(shares.values()))

    def __getstate__(self) -> dict:
        """What tasks need."""
        return self.__dict__ | {"rare": None}

    def distances(self, chars: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[float, float]:
        """Of class counts and of the counts of ``words``, from the language nearest by words."""
        if not self.languages or not n_words:
            return 0.0, 0.0
        mine = np.empty_like(self.shares)
        mine[:, :-1] = np.append(counts, 0)[self.places]
        mine[:, -1] = n_words - mine[:, :-1].sum(axis=1)
        by_word = jensen_shannon(mine / n_words, self.shares)
        nearest = int(by_word.argmin())
        return float(jensen_shannon(chars / chars.sum(), self.classes[nearest])), float(by_word[nearest])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language, added up within the task: words, and documents by their share of each character class.

    The latter go by names with a blank, which no word has: class and bin.
    """
    found: dict[str, Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counter in found.items():
            items = list(counter.items())
            for start in range(0, len(items), 50_000):
                part = items[start : start + 50_000]
                words, numbers = zip(*part, strict=True)
                yield pa.record_batch(
                    [pa.array([lang] * len(part)), pa.array(words, pa.binary()), pa.array(numbers, pa.int64())],
                    names=["lang", "word", "n"],
                )
        found.clear()

    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            counter = found.setdefault(lang, Counter())
            counter.update(text.split())
            if text:
                classes = class_counts(text)
                bins = np.rint(BINS * np.sqrt(classes / classes.sum())).astype(int)
                counter.update(b" %d %d" % pair for pair in enumerate(bins))
        if sum(map(len, found.values())) > 250_000:
            yield from told()
    yield from told()


def references(docs: DataFrame) -> References:
    """From all documents with a language.

    At most ``MANY`` languages with ``1 / COMMON`` words each, and the bins of the
    classes, come to the driver.
    """
    counts = cut(
        docs.where("lang IS NOT NULL")
        .select("lang", "text")
        .mapInArrow(_counted, "lang string, word binary, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "language-counts",
    )
    is_class = F.expr("substring(word, 1, 1) = X'20'")
    by_word = counts.where(~is_class)
    totals = by_word.groupBy("lang").agg(F.sum("n").alias("total"))
    enough = cut(totals.where(F.col("total") >= ENOUGH), "languages")
    most = enough.orderBy(F.desc("total"), "lang").limit(MANY + 1).collect()
    if not most:
        return References({})
    held = [r.lang for r in most[:MANY]]
    known = F.broadcast(enough.where(F.col("lang").isin(held)))
    bins: dict[str, np.ndarray] = {}
    for row in counts.where(is_class).join(known, "lang").collect():
        code, at = map(int, row.word.split())
        bins.setdefault(row.lang, np.zeros((len(CLASSES) - 1, BINS + 1)))[code, at] = row.n
    histograms = {lang: (_medians(b), {}) for lang, b in bins.items()}
    for row in by_word.join(known, "lang").where(F.col("n") >= COMMON * F.col("total")).collect():
        histograms[row.lang][1][bytes(row.word)] = row.n / row.total
    rare = None
    if len(most) > MANY:
        others = enough.where(~F.col("lang").isin(held))
        rare = cut(_rare(counts.where(is_class).join(others, "lang"), by_word.join(others, "lang")), "rare-languages")
    return References(histograms, rare)


def _rare(bins: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each language: its class counts (by code) and its common words, as ``References`` takes them."""
    pair = F.split(F.trim(F.col("word").cast("string")), " ")
    bins = bins.select("lang", pair[0].cast("int").alias("code"), pair[1].cast("int").alias("at"), "n")
    by_class = W.partitionBy("lang", "code")
    summed = bins.select(
        "lang", "code", "at", F.sum("n").over(by_class.orderBy("at")).alias("sum"), F.sum("n").over(by_class).alias("all")
    )
    median = summed.where(2 * F.col("sum") >= F.col("all")).groupBy("lang", "code").agg(F.min("at").alias("at"))
    share = F.struct("code", F.pow(F.col("at") / BINS, F.lit(2)).alias("share"))
    classes = median.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(share)), lambda c: c["share"]).alias("classes"))
    common = words.where(F.col("n") >= COMMON * F.col("total")).groupBy("lang").agg(
        F.collect_list(F.struct("word", (F.col("n") / F.col("total")).alias("share"))).alias("common")
    )
    common = common.select("lang", F.col("common.word").alias("common"), F.col("common.share").alias("shares"))
    return classes.join(common, "lang", "left")


def _medians(bins: np.ndarray) -> np.ndarray:
    """Median share of each class, from the numbers of documents by bin."""
    sums = np.cumsum(bins, axis=1)
    return ((sums < sums[:, -1:] / 2).sum(axis=1) / BINS) ** 2


def measured(text: bytes, lang: str | None, known: References, own: References | None = None) -> tuple:
    """All columns of ``judged`` for one text; ``own`` has its language's references if ``known`` has not."""
    words = text.split()
    n_words = len(words)
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n_words)
    times = np.append(np.bincount(ids, minlength=len(numbers)), 0)
    classes = class_counts(text)
    n_chars = int(classes.sum())
    n_repeated = repeated_words(ids, len(numbers))
    failed = n_words < MIN_WORDS or 100 * n_repeated > MAX_REPEATED * n_words
    by_class = by_word = 0.0
    if own is not None or lang in known.languages:
        by_class, by_word = min(
            (r.distances(classes, times[[numbers.get(w, -1) for w in r.words]], n_words) for r in (known, own) if r is not None),
            key=lambda d: d[1],
        )
    strange = (n_chars >= CHARS_FROM and by_class > CHARS_LIMIT) or (n_words >= WORDS_FROM and by_word > WORDS_LIMIT)
    return (
        n_words,
        n_chars - int(classes[CLASSES.index("space")]),
        int(classes[CLASSES.index("symbol")]),
        repeated_lines(text),
        n_repeated,
        failed,
        not failed and not strange,
        by_class,
        by_word,
    )


FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("class_distance", pa.float64()),
    ("word_distance", pa.float64()),
]


def _with_references(docs: DataFrame, known: References) -> list[DataFrame]:
    """``docs`` as a column ``doc``, in two parts if some languages have their references in the table: those come along as ``own``."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    if known.rare is None:
        return [rows]
    here = F.col("doc.lang").isNull() | F.col("doc.lang").isin(known.languages)
    rare = known.rare.select(F.col("lang").alias("own_lang"), F.struct("classes", "common", "shares").alias("own"))
    return [rows.where(here), rows.where(~here).join(rare, F.col("doc.lang") == F.col("own_lang"), "left").select("doc", "own")]


def _measured(batch: pa.RecordBatch, known: References) -> list[tuple]:
    docs = pa.RecordBatch.from_struct_array(batch.column(0))
    langs = docs.column(docs.schema.get_field_index("lang")).to_pylist()
    own: list[References | None] = [None] * batch.num_rows
    if batch.num_columns > 1:
        own = [
            row and References({lang: (np.array(row["classes"]), dict(zip(row["common"] or [], row["shares"] or [], strict=True)))})
            for lang, row in zip(langs, batch.column(1).to_pylist(), strict=True)
        ]
    return [measured(text, lang, known, o) for text, lang, o in zip(texts(docs), langs, own, strict=True)]


def judged(docs: DataFrame, known: References | None = None) -> DataFrame:
    """One row per document: the measures, ``base_failed`` and the verdict ``kept``."""
    known = references(docs) if known is None else known

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = _measured(batch, known)
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(FIELDS)]
            yield pa.record_batch([batch.column(0).field("doc_id"), *columns], names=["doc_id", *(n for n, _ in FIELDS)])

    kind = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"
    )
    parts = _with_references(docs.select(F.col("doc_id").cast("bigint"), "lang", "text"), known)
    return reduce(DataFrame.unionByName, [part.mapInArrow(judge, kind) for part in parts])


def passing(docs: DataFrame, known: References | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    known = references(docs) if known is None else known

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [n for n, _ in FIELDS].index("kept")
        for batch in slices(batches):
            yield batch.filter(pa.array([row[kept] for row in _measured(batch, known)], pa.bool_()))

    parts = _with_references(docs, known)
    return reduce(DataFrame.unionByName, [part.mapInArrow(keep, part.schema).select("doc.*") for part in parts])
