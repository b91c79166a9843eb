"""Words, shingles and Arrow batches as several of the operators need them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word breaks: the six ASCII blanks, which are also those of ``bytes.split``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5


# --- inside tasks -----------------------------------------------------------


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, a null as an empty one."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that what is made of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words count as one run."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    runs = np.full(len(hashes) - width + 1, len(hashes) if width < size else size, np.uint64)
    for k in range(width):
        runs = mixed(runs * _MIX[2] + hashes[k : len(hashes) - width + 1 + k])
    return np.unique(runs)


# --- as columns -------------------------------------------------------------


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def each(array: Column) -> Column:
    """The elements of an array, and one null row for an empty one.

    A plain ``explode`` lets Spark infer a filter on the array's size, which it
    then evaluates a second time beneath the projections that made the array,
    with their expressions repeated inside the lambdas.
    """
    return F.explode_outer(array)


def shingle_hashes(hashes: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of runs of ``size`` words from the array of word hashes.

    Fewer words count as one run; no words give an empty array.
    """
    runs = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]),
    )
    return (
        F.when(F.size(hashes) >= size, F.array_distinct(runs))
        .when(F.size(hashes) > 0, F.array(F.xxhash64(hashes)))
        .otherwise(F.array().cast("array<bigint>"))
    )
