"""Alignment of two tokenizers by inverted pair bitmaps.

Every text is read by two tokenizers.  Where the bytes of both readings spell
the text, each pair of tokens whose byte ranges overlap is a link.  Links are
indexed the other way round: per id pair and block of documents a compressed
bitmap of the documents that hold it (plane 0), and bitmaps of the binary
digits of how many more links than one they have (planes 1, 2, ...).  A pair's
documents are counted by the set bits of its bitmaps, and a second walk along
the same postings brings every pair's count back to the documents.

A block is at most ``BLOCK`` consecutive documents of one task.  A bitmap is a
sorted list of two-byte ordinals while that is shorter than ``BLOCK`` bits.

Results for odd input: a null or empty text, and one that either tokenizer
does not spell byte for byte, has no tokens; rows that repeat are documents of
their own, without ``doc_id`` too; long texts are read whole, one at a time if
need be; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.words import slices
from coppice.session import cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"

BLOCK = 4096  # documents of a block: ordinals are 12 bits
DENSE = BLOCK // 16  # from so many ordinals on the bits themselves are shorter
HELD = 4_000_000  # (pair, document) entries held by a task before a block is closed early

# The pieces that byte-level tokenizers of this family cut texts into before they merge: a fixed value.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- the two readings ---------------------------------------------------------


def _byte_of_character() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE from its JSON file.

    Where ids follow the order of merges, as in this family, the vocabulary is
    also the list of merge ranks, which is what the faster reader needs.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        special = {t["content"] for t in whole.get("added_tokens", ())}
        to_byte = _byte_of_character()
        tokens = {t: bytes(to_byte[c] for c in t) for t in model["vocab"] if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, spelled in tokens.items():
            self.bytes[model["vocab"][token]] = spelled
        ranks = {spelled: model["vocab"][token] for token, spelled in tokens.items()}
        self._encoding = tiktoken.Encoding("byte level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def read(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + text) for text in texts]


class Pieces:
    """A sentence-piece model; it puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self._model.vocab_size()):
            piece = self._model.id_to_piece(k)
            spelled = bytes([int(piece[3:5], 16)]) if self._model.is_byte(k) else piece.replace("▁", " ").encode()
            self.bytes.append(spelled)

    def read(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _readers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces, Links]:
    a, b = ByteLevel(a_path), Pieces(b_path)
    return a, b, Links(a.bytes, b.bytes)


class Links:
    """Finds links and groups of many texts at once, their bytes laid end to end."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.size = [np.array([len(x) for x in spelled], np.int64) for spelled in (a_bytes, b_bytes)]
        # An id as it is written when a token of its own side, or the last of its side, follows.
        self.mark = [np.array([f"{k}," for k in range(len(x))] + [f"{k}{end}" for k in range(len(x))], object) for x, end in ((a_bytes, "|"), (b_bytes, ";"))]

    def of(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[np.ndarray, ...]:
        """Per link its A id, B id and text; per text its number of groups and their digest."""
        n = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b)]
        flat = [np.fromiter(chain.from_iterable(ids), np.int64, int(k.sum())) for ids, k in zip((ids_a, ids_b), n, strict=True)]
        ends = [np.cumsum(size[x]) for size, x in zip(self.size, flat, strict=True)]
        flags = np.zeros(int(ends[0][-1]) + 1, np.uint8)
        flags[ends[0]] = 1
        flags[ends[1]] |= 2
        cuts = np.flatnonzero(flags)  # one stretch between neighbouring cuts is one link
        flags = flags[cuts]
        last = [flags & 1 == 1, flags & 2 == 2]
        both = flags == 3
        at = [np.cumsum(x) - x for x in last]
        group = np.cumsum(both) - both
        text = np.searchsorted(ends[0][np.cumsum(n[0]) - 1], cuts)
        n_groups = np.bincount(text[both], minlength=len(ids_a))

        own = [group[x] for x in last]  # the group of each token
        per = [np.bincount(g, minlength=int(both.sum())) for g in own]
        before_b, upto_a = np.cumsum(per[1]) - per[1], np.cumsum(per[0])
        written = np.empty(len(flat[0]) + len(flat[1]), object)
        for k, place in enumerate((before_b[own[0]] + np.arange(len(flat[0])), upto_a[own[1]] + np.arange(len(flat[1])))):
            written[place] = self.mark[k][flat[k] + both[last[k]] * len(self.size[k])]
        stops = np.cumsum(n[0] + n[1]).tolist()
        words = written.tolist()
        digests = [
            hashlib.sha256("".join(words[start:stop])[:-1].encode()).hexdigest()
            for start, stop in zip([0, *stops], stops, strict=False)
        ]
        return flat[0][at[0]], flat[1][at[1]], text, n_groups, digests


# --- bitmaps ------------------------------------------------------------------


def bitmaps(ordinals: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Compressed bitmaps from runs of ``counts`` sorted ordinals each."""
    dense = counts >= DENSE
    size = np.where(dense, BLOCK // 16, counts)  # in two-byte units
    stops = np.cumsum(size)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint16)
    starts = np.cumsum(counts) - counts
    shift = np.repeat((stops - size) - starts, counts)
    sparse = np.repeat(~dense, counts)
    out[(np.arange(len(ordinals)) + shift)[sparse]] = ordinals[sparse]
    for k in np.flatnonzero(dense):
        bits = np.zeros(BLOCK, np.uint8)
        bits[ordinals[starts[k] : starts[k] + counts[k]]] = 1
        out[stops[k] - size[k] : stops[k]] = np.packbits(bits, bitorder="little").view(np.uint16)
    offsets = np.concatenate([[0], 2 * stops]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def opened(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals of all of the bitmaps, and which bitmap each belongs to."""
    offsets = np.frombuffer(bits.buffers()[1], np.int32, len(bits) + 1, 4 * bits.offset).astype(np.int64) // 2
    data = np.frombuffer(bits.buffers()[2] or b"", np.uint16)
    size = np.diff(offsets)
    dense = size == BLOCK // 16
    owner = np.repeat(np.arange(len(size)), size)
    values = data[offsets[0] : offsets[-1]]
    keep = ~dense[owner]
    found, of = [values[keep].astype(np.int64)], [owner[keep]]
    for k in np.flatnonzero(dense):
        ones = np.flatnonzero(np.unpackbits(data[offsets[k] : offsets[k + 1]].view(np.uint8), bitorder="little"))
        found.append(ones)
        of.append(np.full(len(ones), k))
    return np.concatenate(found), np.concatenate(of)


class _Block:
    """Entries of one block's documents, merged into one bitmap per pair and plane."""

    def __init__(self, number: int):
        self.number, self.docs, self.held = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, pairs: np.ndarray, ordinals: np.ndarray) -> None:
        keys, times = np.unique(pairs * BLOCK + ordinals, return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.held += len(keys)

    def postings(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times) - 1
        order = np.argsort(keys, kind="stable")  # a document's entries come from one slice: no key twice
        keys, times = keys[order], times[order]
        for plane in range(int(times.max()).bit_length() + 1):
            entries = keys if plane == 0 else keys[times >> (plane - 1) & 1 == 1]
            pairs, counts = np.unique(entries // BLOCK, return_counts=True)
            stops = np.cumsum(counts)
            ordinals = (entries % BLOCK).astype(np.uint16)
            for k in range(0, len(pairs), 50_000):
                here = slice(k, k + 50_000)
                inside = slice(int(stops[k] - counts[k]), int(stops[here][-1]))
                n = len(pairs[here])
                yield _rows(
                    block=pa.array(np.full(n, self.number)),
                    pair=pa.array(pairs[here]),
                    plane=pa.array(np.full(n, plane, np.int32)),
                    ones=pa.array(counts[here].astype(np.int64)),
                    bits=bitmaps(ordinals[inside], counts[here]),
                )


INDEX = (
    "block bigint, ordinal int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pair bigint, plane int, ones bigint, bits binary"
)
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [(name, _KINDS[kind]) for name, kind in (x.split() for x in INDEX.split(", "))]


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of the index; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    arrays = [columns[name] if name in columns else pa.nulls(n, kind) for name, kind in _FIELDS]
    return pa.record_batch(arrays, names=[name for name, _ in _FIELDS])


def index(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """Rows of documents (``pair`` null) and of postings, of one pass over the texts, written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b, links = _readers(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in slices(batches, 64):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if block.docs + len(texts) > BLOCK or block.held > HELD:
                yield from block.postings()
                number += 1
                block = _Block(number)
            ids_a, ids_b = a.read(texts), b.read(texts)
            good = [
                k
                for k, text in enumerate(texts)
                if text
                and (spelled := b" " + text.encode()) == b"".join(map(b.bytes.__getitem__, ids_b[k]))
                and spelled == b"".join(map(a.bytes.__getitem__, ids_a[k]))
            ]
            counts = np.zeros((4, len(texts)), np.int64)
            digests = [""] * len(texts)
            if good:
                ids_a, ids_b = [ids_a[k] for k in good], [ids_b[k] for k in good]
                of_a, of_b, text, n_groups, written = links.of(ids_a, ids_b)
                counts[0, good], counts[1, good] = [len(x) for x in ids_a], [len(x) for x in ids_b]
                counts[2, good], counts[3, good] = n_groups, np.bincount(text, minlength=len(good))
                for k, digest in zip(good, written, strict=True):
                    digests[k] = digest
                block.add(of_a * len(b.bytes) + of_b, block.docs + np.array(good)[text])
            yield _rows(
                block=pa.array(np.full(len(texts), number)),
                ordinal=pa.array(np.arange(block.docs, block.docs + len(texts), dtype=np.int32)),
                doc_id=batch.column(0),
                **{name: pa.array(counts[k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                groups_sha256=pa.array(digests, pa.string()),
            )
            block.docs += len(texts)
        yield from block.postings()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(read, INDEX), "token-pairs")


def pair_counts(rows: DataFrame) -> DataFrame:
    """Per id pair the documents and links that hold it, from the set bits of its bitmaps.

    ``pair`` is A id times the size of B's vocabulary plus B id.
    """
    return (
        rows.where("pair is not null")
        .groupBy("pair")
        .agg(
            F.sum(F.when(F.col("plane") == 0, F.col("ones")).otherwise(0)).alias("documents"),
            F.sum(F.when(F.col("plane") == 0, F.col("ones")).otherwise(F.col("ones") * F.expr("shiftleft(1L, plane - 1)"))).alias("links"),
        )
    )


def with_best(counts: DataFrame, vocabulary: int) -> DataFrame:
    """Pair counts with their two ids and whether the A id has no pair in more documents."""
    counts = counts.select(
        "pair",
        F.floor(F.col("pair") / vocabulary).cast("bigint").alias("a_id"),
        (F.col("pair") % vocabulary).alias("b_id"),
        "documents",
        "links",
    )
    most = counts.groupBy("a_id").agg(F.max("documents").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counts per document, from postings in order of their block."""
    current, sums, best = None, None, None

    def done() -> pa.RecordBatch:
        held = np.flatnonzero(sums)
        return pa.record_batch(
            [pa.array(np.full(len(held), current)), pa.array(held.astype(np.int32)), pa.array(best[held]), pa.array(sums[held])],
            names=["block", "ordinal", "n_best", "count_sum"],
        )

    for batch in batches:
        blocks, weights, score, bests = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3))
        ordinals, owner = opened(batch.column(4).cast(pa.binary()))
        for block in np.unique(blocks):
            if block != current:
                if current is not None:
                    yield done()
                current, sums, best = int(block), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            here = blocks[owner] == block
            of, at = owner[here], ordinals[here]
            np.add.at(sums, at, (weights * score)[of])
            np.add.at(best, at, (weights * bests)[of])
    if current is not None:
        yield done()


def scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document of the index the links that are best, and the counts of its links added up."""
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("bigint")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    postings = rows.where("pair is not null").select("block", "pair", weight.alias("weight"), "bits")
    joined = postings.join(counts.select("pair", "documents", "best"), "pair")
    return (
        joined.select("block", "weight", "documents", F.col("best").cast("bigint").alias("best"), "bits")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_returned, "block bigint, ordinal int, n_best bigint, count_sum bigint")
    )


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """One row per document: its tokens, groups and links, and what its links' pairs count in the whole corpus."""
    rows = index(docs, a_path, b_path)
    counts = cut(with_best(pair_counts(rows), vocabulary(b_path)), "pair-counts")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return (
        rows.where("pair is null")
        .join(scores(rows, counts), ["block", "ordinal"], "left")
        .select(*kept, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")])
    )


def vocabulary(b_path: str = PIECE_BPE) -> int:
    """The number of ids of the second tokenizer."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
