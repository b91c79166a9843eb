"""Totals up the directory tree and by file type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import labels, paths
from coppice.operators.skew import skew_join
from coppice.schema import ENTRY, TREE


def directory_sizes(files: DataFrame) -> DataFrame:
    """Bytes of all regular files below each directory, links left out.

    ``partial`` is set when something below could not be read.  Only key, size
    and flag are exploded, and Spark adds them up per directory before the
    shuffle, so the root of a huge tree costs one row per task.  Directories
    with a row of their own and nothing below show 0.
    """
    narrow = files.select(
        *TREE,
        F.explode(
            F.when(F.col("kind") == "dir", paths.self_and_ancestors(F.col("path"))).otherwise(
                paths.ancestors(F.col("path"))
            )
        ).alias("dir"),
        F.when(F.col("kind") == "file", F.coalesce("size", F.lit(0))).otherwise(F.lit(0)).alias("size"),
        F.coalesce("denied", F.lit(False)).alias("denied"),
        (F.col("kind") == "file").cast("long").alias("is_file"),
    )
    return narrow.groupBy(*TREE, "dir").agg(
        F.sum("size").alias("size"),
        F.sum("is_file").alias("files_below"),
        F.bool_or("denied").alias("partial"),
    )


def child_counts(listed: DataFrame) -> DataFrame:
    """Directories and files listed directly in each directory."""
    return (
        listed.where(F.col("path") != "")
        .groupBy(*TREE, F.col("parent").alias("dir"))
        .agg(
            F.count_if(F.col("kind") == "dir").alias("dirs"),
            F.count_if(F.col("kind") != "dir").alias("files"),
        )
    )


def _type(ext: str = "ext"):
    return F.when(F.col(ext) == "", "(no ext)").otherwise(F.col(ext))


def extension_counts(files: DataFrame) -> DataFrame:
    """Files per extension of each tree."""
    return (
        files.where(F.col("kind") != "dir")
        .groupBy(*TREE, _type().alias("type"))
        .agg(F.count("*").alias("files"))
    )


def type_totals(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Files, lines and tokens by type, by tree and over everything, in one pass.

    Binary files have no counts and do not take part.  ``level`` says which
    total a row is: ``type``, ``tree`` or ``all``.
    """
    measured = files.select(*ENTRY, _type().alias("type")).join(
        counts.where(F.col("tokens").isNotNull()).select(*ENTRY, "lines", "tokens"), ENTRY
    )
    return (
        measured.groupingSets(
            [[F.col("repo"), F.col("snapshot"), F.col("type")], [F.col("repo"), F.col("snapshot")], []],
            F.col("repo"),
            F.col("snapshot"),
            F.col("type"),
        )
        .agg(
            F.count("*").alias("files"),
            F.sum("lines").alias("lines"),
            F.sum("tokens").alias("tokens"),
            F.grouping("type").alias("_no_type"),
            F.grouping("repo").alias("_no_repo"),
        )
        .select(
            F.when(F.col("_no_repo") == 1, "all")
            .when(F.col("_no_type") == 1, "tree")
            .otherwise("type")
            .alias("level"),
            *TREE,
            "type",
            "files",
            "lines",
            "tokens",
        )
    )


def shares(files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Each entry's share of the directory it is in, with its bar."""
    sizes = directory_sizes(files) if sizes is None else sizes
    own = sizes.select(*TREE, F.col("dir").alias("path"), F.col("size").alias("_below"))
    entries = (
        files.where(F.col("path") != "")
        .select(*ENTRY, "parent", "kind", "size")
        .join(own, ENTRY, "left")
        .withColumn("size", F.when(F.col("kind") == "dir", F.coalesce("_below", F.lit(0))).otherwise(F.col("size")))
        .drop("_below")
    )
    totals = sizes.select(*TREE, F.col("dir").alias("parent"), F.col("size").alias("parent_size"))
    in_each = files.groupBy(*TREE, "parent").count()
    joined = skew_join(
        entries, totals, [*TREE, "parent"], ["path"], "left", counted=in_each
    )
    return joined.select(
        *ENTRY,
        "parent",
        "kind",
        "size",
        "parent_size",
        labels.share_percent(F.col("size"), F.col("parent_size")).alias("percent"),
        labels.share_bar(F.col("size"), F.col("parent_size")).alias("bar"),
    )


def denied_entries(files: DataFrame) -> DataFrame:
    """Directories that could not be read: their totals carry a ``+``."""
    return files.where(F.coalesce("denied", F.lit(False))).select(*ENTRY)
