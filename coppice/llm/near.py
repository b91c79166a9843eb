"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters the
shingles over ``UNIVERSE`` places, the second gives every place a rank, and
coordinate ``k`` is the smallest rank of the document's places after shifting
the second permutation by ``k`` around its circle.

1. Documents with equal shingle sets are one node, named by the smallest doc_id.
2. Nodes that share a band meet in a bucket.  Every node is first compared with
   one node of its bucket only, another one in each bucket; the links found are
   joined into components, and that is done once more for buckets that still
   hold several components.  A group of copies of any size thus costs one
   comparison per node and band.
3. Nodes of a bucket that are still in different components are compared with
   each other, up to ``CROWD`` in a bucket.  Larger ones come from a passage
   that many texts share.  Their nodes are compared if they share one of their
   rarest shingles: of two sets within the bound, the smaller has one of its
   rarest seventh among the rarest quarter of the other, so none is missed.

Bands of 4 among 128 coordinates miss a pair of similarity 0.75 with a
probability of 5e-6, one of 0.8 with 4e-8; no pair of equal sets is missed.
Links are confirmed on the full sets.

Words are lower-cased (A-Z); shingles have five words, shorter texts are one
shingle.  Results for odd input: null and empty texts have no shingles and no
links; repeated rows of a document give repeated rows of the result; a row
without ``doc_id`` is linked with nothing, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.components import components
from coppice.llm.words import WordHashes, mixed, shingle_set, slices, texts
from coppice.session import cut, short_batches

SIMILAR = 75  # percent
COORDINATES = 128
BAND = 4
BANDS = COORDINATES // BAND
UNIVERSE = 1 << 20
CROWD = 24
ROUNDS = 2
SEED = 20240229
BATCH = 256  # texts that travel to Python at once


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and windows of the second: row ``x`` has its values at x, x+1, ... around the circle."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(UNIVERSE).astype(np.int32)
    second = rng.permutation(UNIVERSE).astype(np.int32)
    circle = np.concatenate([second, second[: COORDINATES - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash of a set that is not empty."""
    first, windows = _permutations()
    places = first[(mixed(shingles) % np.uint64(UNIVERSE)).astype(np.int64)]
    lowest = np.full(COORDINATES, UNIVERSE, np.int32)
    for start in range(0, len(places), 4096):
        np.minimum(lowest, windows[places[start : start + 4096]].min(axis=0), out=lowest)
    return lowest


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different from band to band."""
    rows = coordinates.reshape(BANDS, BAND).astype(np.uint64)
    keys = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(BAND):
        keys = mixed(keys * np.uint64(0x165667B19E3779F9) + rows[:, k])
    return keys.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hashes = WordHashes()
    for batch in slices(batches):
        yield batch, [shingle_set(hashes.of(t.lower().split())) for t in texts(batch)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        digests = [mixed(s ^ np.uint64(0x5BF03635)) for s in sets]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                # The sum and the exclusive or of two hashes of every shingle stand for the set.
                pa.array([d.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mixed(d)).tobytes() if len(d) else None for d in digests], pa.binary()),
                pa.array([band_keys(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "digest", "bands"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """Document, size and digest of its shingle set, and its band keys."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _signed, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
    )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        yield pa.record_batch(
            [batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"]
        )


def _open(rows: DataFrame, turn: int) -> DataFrame:
    """Rows (``key``, ``node``, ``n``, ``part``) of buckets with more than one part.

    Adds the number of ``members`` and a ``center`` with its part, a node that
    differs from bucket to bucket and from turn to turn.
    """
    lot = F.xxhash64("node", "key", F.lit(turn))
    several = rows.groupBy("key").agg(
        F.min("part").alias("low"),
        F.max("part").alias("high"),
        F.min_by("node", lot).alias("center"),
        F.min_by("part", lot).alias("center_part"),
        F.count("*").alias("members"),
    )
    return rows.join(several.where("low < high").select("key", "center", "center_part", "members"), "key")


def _linked(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    # Sets are sorted and distinct: the union's size follows from that of the intersection.
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.where(100 * F.col("shared") >= similar * union).select("a", "b")


def _close(a: Column, b: Column, similar: int) -> Column:
    """Sizes that allow the similarity at all."""
    return 100 * F.least(a, b) >= similar * F.greatest(a, b)


def _rare(nodes: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The rarest shingles of every node (``node``, ``part``), as many as a pair within the bound cannot all lack.

    ``at`` is their place; ``first`` marks those that suffice for the smaller set of a pair.
    """
    held = sets.join(nodes, "node").select("node", "part", F.explode("shingles").alias("shingle"))
    held = cut(held, "crowd")
    counts = held.groupBy("shingle").agg(F.count("*").alias("count"))
    ordered = held.join(counts, "shingle").groupBy("node", "part").agg(
        F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("shingles")
    )
    n = F.size("shingles")
    # ceil(t n) of the larger set's shingles and ceil(2t / (1 + t) n) of the smaller one's are shared.
    longer = (n - F.ceil(similar * n / 100) + 1).cast("int")
    shorter = (n - F.ceil(2 * similar * n / (100 + similar)) + 1).cast("int")
    kept = ordered.select("node", "part", n.alias("n"), shorter.alias("shorter"), F.slice("shingles", F.lit(1), longer).alias("rare"))
    rows = kept.select("node", "part", "n", "shorter", F.posexplode("rare").alias("at", "s"))
    return rows.where("s.count > 1").select("node", "part", "n", "at", (F.col("at") < F.col("shorter")).alias("first"), "s.shingle")


def _across(rows: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs of nodes of different parts that may be similar, from the rows of open buckets."""
    few = rows.where(F.col("members") <= CROWD).select("key", "node", "n", "part")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("part_b"))
    small = few.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("part") != F.col("part_b")))
    small = small.where(_close(F.col("n"), F.col("n_b"), similar)).select(F.col("node").alias("a"), "b")
    rare = cut(_rare(rows.where(F.col("members") > CROWD).select("node", "part").distinct(), sets, similar), "rare")
    larger = rare.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("part_b"), F.col("at").alias("at_b"))
    large = rare.where("first").join(larger, "shingle").where((F.col("n") <= F.col("n_b")) & (F.col("part") != F.col("part_b")))
    # Before the first shingle that they share, neither can have more of its own than the bound allows.
    shared = F.ceil(similar * (F.col("n") + F.col("n_b")) / (100 + similar))
    large = large.where((F.col("n") - F.col("at") >= shared) & (F.col("n_b") - F.col("at_b") >= shared))
    return small.union(large.select(F.least("node", "b"), F.greatest("node", "b"))).distinct()


def links(documents: DataFrame, docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Component of every node that has a smaller one in its component, as ``node`` and ``component``.

    ``documents`` is what ``signed`` made of ``docs``, written.
    """
    named = documents.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nodes = named.join(nodes, ["digest", "doc_id"]).dropDuplicates(["digest"])
    banded = nodes.select(
        F.col("doc_id").alias("node"), F.col("doc_id").alias("part"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key")
    )
    rows = cut(_open(banded, 0), "buckets")
    sizes = rows.select(F.col("node").alias("center"), F.col("n").alias("n_center")).distinct()
    asked = rows.select("node").distinct()
    sets = docs.select(F.col("doc_id").cast("bigint"), "text").join(asked, F.col("doc_id") == F.col("node"), "left_semi")
    with short_batches(docs.sparkSession, BATCH):
        sets = cut(sets.mapInArrow(_shingled, "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "sets")

    parts = None
    for turn in range(1, ROUNDS + 1):
        pairs = rows.where("part <> center_part").select("center", "node", "n").distinct().join(sizes, "center")
        pairs = pairs.where(_close(F.col("n"), F.col("n_center"), similar))
        pairs = pairs.select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
        parts = _joined(_linked(pairs, sets, similar), parts)
        rows = rows.select("key", "node", "n").join(parts, "node", "left")
        rows = cut(_open(rows.select("key", "node", "n", F.coalesce("component", "node").alias("part")), turn), "open-buckets")
    return _joined(_linked(_across(rows, sets, similar), sets, similar), parts)


def _joined(found: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Components of the links found, on top of those there are."""
    if parts is not None:
        found = found.union(parts.select(F.col("component").alias("a"), F.col("node").alias("b")))
    return components(found)


def grouped(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row per document: ``n_shingles``, ``component_id`` and whether it is ``kept``."""
    with short_batches(docs.sparkSession, BATCH):
        documents = cut(signed(docs), "signed")
    named = documents.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    parts = links(documents, docs, similar)
    nodes = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    known = nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    rows = documents.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The documents that are the smallest of their group, with all their columns.

    Rows that repeat a ``doc_id`` are one document and stay or go together.
    """
    gone = cut(grouped(docs, similar).where("NOT kept").select("doc_id").distinct(), "copies")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
