"""Benchmark decontamination: short test items found inside documents of any length.

Items are partitioned by size.  The sketch of an item is its ``s`` smallest
shingle hashes (a bottom-s MinHash), where ``s`` belongs to its partition: a
document that holds ``CONTAINED`` of an item's shingles lacks fewer than ``s``
of them, so it holds one of the sketch.  Candidates are therefore one equi-join
of the documents' shingle hashes with the sketches; hashes above the largest of
all sketches are dropped before it.  Every candidate is then checked on the
whole shingle sets.  How long a document is plays no part, and no item that
reaches the bound is missed.

Words are lower-cased; shingles have five words.  Results for odd input: an
item of fewer words is one shingle, found only in a document of the same
words; null and empty items and documents match nothing; repeated rows of a
document or item count once; rows without ``doc_id`` or ``item_id`` are not
looked at (and not removed by ``clean``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.words import SHINGLE, each, shingle_hashes, word_list
from coppice.session import cut

CONTAINED = 75  # percent of an item's shingles


def _shingled(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and the distinct shingle hashes of ``text``."""
    words = rows.where(F.col(key).isNotNull()).select(key, word_list(F.col("text")).alias("words"))
    hashed = words.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    return hashed.select(key, shingle_hashes(F.col("words")).alias("shingles"))


def _size_class() -> Column:
    """Partition of an item: the power of two at or below its number of shingles."""
    return F.floor(F.log2(F.col("n"))).cast("int")


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id``, its ``shingles`` and their number ``n``; the rows of an item together."""
    rows = _shingled(benchmark, "item_id").select("item_id", each(F.col("shingles")).alias("shingle"))
    gathered = rows.where("shingle IS NOT NULL").distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("shingle")).alias("shingles"))
    return gathered.withColumn("n", F.size("shingles"))


def sketches(items: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """``item_id`` and each hash of its sketch."""
    largest = F.least(F.lit(2) * F.pow(F.lit(2), _size_class()) - 1, F.lit(2**31 - 1)).cast("bigint")
    # Lacking at most floor((100 - contained) * n / 100) shingles, a document holds one of one more.
    depth = F.floor(F.lit(100 - contained) * largest / 100).cast("int") + 1
    smallest = F.slice("shingles", F.lit(1), F.least(depth, F.col("n")))
    return items.select("item_id", F.explode(smallest).alias("shingle"))


def found(docs: DataFrame, benchmark: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """One row per document and item that it contains: ``n_item`` shingles, ``n_shared`` of them found."""
    items = cut(items_of(benchmark), "items")
    sketch = sketches(items, contained)
    top = sketch.agg(F.max("shingle")).first()[0]
    if top is None:
        top = -(2**63)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    low = _shingled(rows, "doc_id").select(
        "doc_id", each(F.filter("shingles", lambda h: h <= F.lit(top))).alias("shingle")
    )
    candidates = cut(low.join(sketch, "shingle").select("doc_id", "item_id").distinct(), "candidates")

    asked = rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    held = _shingled(asked, "doc_id").select("doc_id", each(F.col("shingles")).alias("shingle"))
    wanted = items.select("item_id", "n", F.explode("shingles").alias("shingle"))
    pairs = held.join(wanted, "shingle").join(candidates, ["doc_id", "item_id"], "left_semi")
    counted = pairs.groupBy("doc_id", "item_id").agg(
        F.countDistinct("shingle").alias("n_shared"), F.first("n").cast("bigint").alias("n_item")
    )
    return counted.where(100 * F.col("n_shared") >= contained * F.col("n_item")).select(
        "doc_id", "item_id", "n_item", "n_shared"
    )


def clean(docs: DataFrame, benchmark: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    dirty = cut(found(docs, benchmark, contained).select("doc_id").distinct(), "contaminated")
    return docs.join(dirty, docs["doc_id"] == dirty["doc_id"], "left_anti")


SQL = f"""
WITH both_ AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w
  FROM both_ WHERE id IS NOT NULL
), shingles AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= {SHINGLE}
    THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
    WHEN len(w) > 0 THEN ['|' || array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n) AS n_item, count(*) AS n_shared
FROM shingles d JOIN shingles b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= {CONTAINED} * any_value(n)
"""
