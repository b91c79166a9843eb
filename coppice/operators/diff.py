"""Differences between two snapshots: files, totals and public symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import labels, paths
from coppice.operators.symbols import qualified
from coppice.schema import ENTRY


def sized_digests(contents: DataFrame, limit: int | None = None) -> DataFrame:
    """Size of each body, and its digest.

    With a ``limit``, larger bodies get none: of equal size, they count as unchanged.
    """
    body = "content" if "content" in contents.columns else "text"
    size = F.octet_length(body).cast("long")
    digest = F.when(size > 0 if limit is None else size.between(1, limit), F.sha2(F.col(body).cast("binary"), 256))
    return contents.select(*ENTRY, size.alias("size"), digest.alias("digest"))


def join_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both sides of every path, with ``status`` (null where nothing changed)."""
    left, right = (
        df.select("repo", "path", F.col("size").alias(f"size_{n}"), F.col("digest").alias(f"digest_{n}"))
        for df, n in ((before, "a"), (after, "b"))
    )
    both = left.join(right, ["repo", "path"], "full_outer")
    status = (
        F.when(F.col("size_b").isNull(), "only_a")
        .when(F.col("size_a").isNull(), "only_b")
        .when(F.col("size_a") != F.col("size_b"), "changed")
        .when(F.col("digest_a") != F.col("digest_b"), "changed")
    )
    return both.withColumn("status", status)


def joined(before: DataFrame, after: DataFrame) -> DataFrame:
    """Bodies are hashed where they are read; the join moves sizes and digests."""
    return join_digests(sized_digests(before), sized_digests(after))


def compare_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files only in one tree, and files that changed."""
    return (
        join_digests(before, after)
        .where(F.col("status").isNotNull())
        .select("repo", "path", "status", "size_a", "size_b")
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``compare_digests`` from bodies."""
    return compare_digests(sized_digests(before), sized_digests(after))


def compare_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per repo: counts by status, sizes of both trees and their difference."""
    totals = (
        joined(before, after)
        .groupBy("repo")
        .agg(
            F.count_if(F.col("status") == "only_a").alias("only_a"),
            F.count_if(F.col("status") == "only_b").alias("only_b"),
            F.count_if(F.col("status") == "changed").alias("changed"),
            F.coalesce(F.sum("size_a"), F.lit(0)).alias("total_a"),
            F.coalesce(F.sum("size_b"), F.lit(0)).alias("total_b"),
        )
        .withColumn("delta", F.col("total_b") - F.col("total_a"))
    )
    sign = F.when(F.col("delta") >= 0, "+").otherwise("-")
    return totals.withColumn(
        "delta_label", F.concat(sign, labels.size_label(F.abs("delta")))
    )


# Extensions whose public symbols are compared.
API_EXTS = [".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".rs", ".go", ".c"]


def _names(symbols: DataFrame) -> DataFrame:
    ext = paths.ext(paths.basename(F.col("path")))
    return (
        qualified(symbols.where(F.col("public") & ext.isin(API_EXTS)))
        .select("repo", "path", F.col("label").alias("symbol"))
        .distinct()
    )


def api_diff(
    before: DataFrame, after: DataFrame, changes: DataFrame, status: DataFrame | None = None
) -> DataFrame:
    """Public symbols added and removed in the files changed since a reference.

    ``before`` and ``after`` are symbol tables of the two snapshots.  A renamed
    file is read at its new path only.  Untracked files, and files below
    untracked directories, count as all added and are marked.
    """
    old, new = _names(before), _names(after)
    touched = changes.select("repo", "path").distinct()
    key = ["repo", "path", "symbol"]
    old = old.join(touched, ["repo", "path"], "left_semi")
    new_tracked = new.join(touched, ["repo", "path"], "left_semi")
    added = new_tracked.join(old, key, "left_anti").withColumns(
        {"change": F.lit("added"), "untracked": F.lit(False)}
    )
    removed = old.join(new_tracked, key, "left_anti").withColumns(
        {"change": F.lit("removed"), "untracked": F.lit(False)}
    )
    out = added.unionByName(removed)
    if status is None:
        return out
    fresh = status.where(F.col("xy") == "??").select(
        "repo", F.regexp_replace("path", r"/\z", "").alias("_at")
    )
    under = new.select("repo", "path").distinct().select(
        "repo", "path", F.explode(paths.self_and_ancestors(F.col("path"))).alias("_at")
    )
    untracked_files = under.join(fresh, ["repo", "_at"], "left_semi").select("repo", "path").distinct()
    untracked = new.join(untracked_files, ["repo", "path"], "left_semi").withColumns(
        {"change": F.lit("added"), "untracked": F.lit(True)}
    )
    return out.unionByName(untracked)


def api_totals(diffed: DataFrame) -> DataFrame:
    return diffed.groupBy("repo").agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
    )


def symbol_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Set difference of two symbol tables of any kind: ``added`` and ``removed`` rows."""
    key = [*ENTRY, "label"]
    old = before.select(*key).distinct()
    new = after.select(*key).distinct()
    return new.join(old, key, "left_anti").withColumn("change", F.lit("added")).unionByName(
        old.join(new, key, "left_anti").withColumn("change", F.lit("removed"))
    )
