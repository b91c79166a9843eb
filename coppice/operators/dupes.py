"""Groups of files with the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.skew import skew_join
from coppice.schema import ENTRY, TREE


def digests(contents: DataFrame, limit: int | None = None) -> DataFrame:
    """Size and SHA-256 of each non-empty body, up to ``limit`` bytes if that is given.

    Computed where the body is read: only the digest is ever shuffled.
    """
    body = "content" if "content" in contents.columns else "text"
    size = F.octet_length(body).cast("long")
    return contents.where(size > 0 if limit is None else size.between(1, limit)).select(
        *ENTRY, size.alias("size"), F.sha2(F.col(body).cast("binary"), 256).alias("digest")
    )


SLOTS = 1 << 20


def of_repeated_size(contents: DataFrame, files: DataFrame, across: bool = False) -> DataFrame:
    """Bodies that may have an equal one, by the sizes in the inventory.

    Sizes that occur twice (in a tree, or ``across`` all) set a bit each in a map
    of ``SLOTS`` bits.  The map has a fixed length, so it can be broadcast into the
    scan, before a body is digested; a body of another size may pass by chance.
    """
    body = "content" if "content" in contents.columns else "text"
    by = ["size"] if across else [*TREE, "size"]
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS))
    twice = files.where((F.col("kind") == "file") & (F.col("size") > 0)).groupBy(*by).count().where("count >= 2")
    bits = twice.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("_bits")
    )
    own = contents.select(*contents.columns, F.octet_length(body).cast("long").alias("size")) if "size" not in contents.columns else contents
    placed = own.withColumn("_slot", slot).withColumn("_word", F.expr("_slot div 64"))
    met = placed.join(F.broadcast(bits), "_word").where(F.expr("shiftright(_bits, cast(_slot % 64 AS int)) & 1 = 1"))
    return met.select(*contents.columns)


def groups(digested: DataFrame, across: bool = False) -> DataFrame:
    """One row per set of equal files: copies, bytes wasted, first path.

    ``across`` compares all trees with each other.
    """
    by = ["size", "digest"] if across else [*TREE, "size", "digest"]
    first = F.min(F.struct(*ENTRY)) if across else F.min("path")
    out = (
        digested.groupBy(*by)
        .agg(F.count("*").alias("copies"), first.alias("first"))
        .where(F.col("copies") >= 2)
        .withColumn("wasted", F.col("size") * (F.col("copies") - 1))
    )
    if across:
        return out.select(
            "size", "digest", "copies", "wasted", "first.repo", "first.snapshot", "first.path"
        )
    return out.withColumnRenamed("first", "path")


def members(digested: DataFrame, grouped: DataFrame, across: bool = False) -> DataFrame:
    """Every file of every group, one row each, so a group of any size is fine.

    A digest shared by a large part of all files is split over many tasks.
    Pass a written ``digested`` (``session.cut``): it is read for both steps.
    """
    by = ["size", "digest"] if across else [*TREE, "size", "digest"]
    counted = grouped.select(*by, F.col("copies").alias("count"))
    return skew_join(
        digested, grouped.select(*by, "copies", "wasted"), by, ENTRY, counted=counted
    )
