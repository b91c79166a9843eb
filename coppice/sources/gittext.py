"""Commit logs, status and diff listings, from the text the tools print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions import paths
from coppice.operators.skew import numbered, salted_join


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One text per repo: file ``NAME.txt`` holds the output for repo ``NAME``."""
    return spark.read.text(path, wholetext=True).select(
        paths.stem(paths.basename(F.input_file_name())).alias("repo"), F.col("value").alias("text")
    )


def read_log(spark: SparkSession, path: str, repo: Column | None = None) -> DataFrame:
    """``(repo, seq, body)``: the records of log files, numbered from 0 in each repository's order.

    A record starts behind ``\\x01`` at the start of a line.  The reader cuts there
    itself, so one log is read by as many tasks as it has blocks, and no more
    than a record is held at a time.  Numbers come from the blocks' offsets and
    the order within them.  ``repo`` names the repository of a file, by default
    the file's name without its ending; it may use ``_metadata``.  A log may be
    cut into several files between records: they go on in the order of their paths.
    """
    repo = paths.stem(F.col("_metadata.file_name")) if repo is None else repo
    pieces = spark.read.text(path, lineSep="\n\x01").select(
        repo.alias("repo"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )
    # Carriage returns before a mark, and the mark that opens a file, are left over.
    cuts = pieces.select("repo", "_file", "_block", "_row", F.posexplode(F.split("value", "\n\r+\x01")).alias("_part", "body"))
    placed = numbered(cuts, ["repo"], [F.col(c) for c in ("_file", "_block", "_row", "_part")], "_n")
    # What stands before a file's first mark is no record.
    opening = F.col("body").rlike("\\A\r*\x01")
    files = placed.groupBy("repo", "_file").agg(F.min("_n").alias("_start"), F.min_by(opening, "_n").alias("_opening"))
    lost = F.count_if(~F.col("_opening")).over(W.partitionBy("repo").orderBy("_start"))
    begins = files.withColumn("_lost", lost)
    first = F.col("_n") == F.col("_start")
    body = F.when(first, F.regexp_replace("body", "\\A\r*\x01", "")).otherwise(F.col("body"))
    return (
        salted_join(placed, begins, ["repo", "_file"], ["_n"])
        .where(~first | F.col("_opening"))
        .select("repo", (F.col("_n") - 1 - F.col("_lost")).alias("seq"), body.alias("body"))
    )


def parse_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(commits, commit_files)`` from log texts, newest commit first; ``read_log`` is for logs of any length."""
    split = logs.select("repo", F.posexplode(F.split("text", "(?:\\A|\n)\\r*\x01")).alias("seq", "body"))
    return parse_records(split.where(F.col("seq") > 0).withColumn("seq", (F.col("seq") - 1).cast("long")))


def parse_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(commits, commit_files)`` from records ``(repo, seq, body)`` of a log.

    A record is ``\\x01hash\\x02date\\x02author\\x02subject\\x03`` and then one
    touched path per line.  Records whose header has fewer than four fields
    are dropped with their paths.
    """
    header = F.regexp_replace(F.substring_index("body", "\n", 1), "\\A\r+|\r+\\z", "")
    fields = F.split(F.regexp_replace(header, "\x03\\z", ""), "\x02", 4)
    parsed = records.select("repo", "seq", fields.alias("_f"), "body").where(F.size("_f") == 4)
    commits = parsed.select(
        "repo",
        "seq",
        F.left(F.col("_f")[0], F.lit(7)).alias("hash"),
        F.col("_f")[1].alias("date"),
        F.col("_f")[2].alias("author"),
        F.col("_f")[3].alias("subject"),
    )
    lines = F.split("body", "\n")
    touched = F.slice(lines, F.lit(2), F.size(lines))
    commit_files = (
        parsed.select("repo", "seq", F.explode(touched).alias("_line"))
        .select("repo", "seq", F.replace(paths.strip("_line"), F.lit("\\"), F.lit("/")).alias("path"))
        .where(F.col("path") != "")
    )
    return commits, commit_files


def parse_status(texts: DataFrame) -> DataFrame:
    """``(repo, path, xy)`` from NUL-separated status output.

    A rename or copy is followed by its old path, taken together with it here
    and then dropped.
    """
    entry = "([RC][^\x00]{2}[^\x00]+\x00+[^\x00]*|[^\x00]+)"
    first = F.substring_index("_entry", "\x00", 1)
    return (
        texts.select("repo", F.posexplode(F.regexp_extract_all("text", F.lit(entry), 1)).alias("_n", "_entry"))
        .select("repo", "_n", first.alias("_entry"))
        .where(F.octet_length("_entry") >= 4)
        .select(
            "repo",
            "_n",
            F.replace(F.substring("_entry", F.lit(4), F.length("_entry")), F.lit("\\"), F.lit("/")).alias("path"),
            F.left("_entry", F.lit(2)).alias("xy"),
        )
        .groupBy("repo", "path")
        .agg(F.max_by("xy", "_n").alias("xy"))
    )


def parse_diff(texts: DataFrame) -> DataFrame:
    """``(repo, path, status)`` from NUL-separated status/path pairs.

    Renames and copies become ``R`` on the new path; ``D`` rows are the
    deleted files.
    """
    record = "([RC][^\x00]*\x00+[^\x00]+\x00+[^\x00]+|[^\x00]+\x00+[^\x00]+)"
    parts = F.split("_record", "\x00+")
    moved = F.col("_p")[0].rlike("\\A[RC]")
    return (
        texts.select(
            "repo", F.posexplode(F.regexp_extract_all("text", F.lit(record), 1)).alias("_n", "_record")
        )
        .select("repo", "_n", parts.alias("_p"))
        .where(~moved | (F.size("_p") == 3))
        .select(
            "repo",
            "_n",
            F.replace(F.try_element_at("_p", F.lit(-1)), F.lit("\\"), F.lit("/")).alias("path"),
            F.when(moved, "R").otherwise(F.left(F.col("_p")[0], F.lit(1))).alias("status"),
        )
        .groupBy("repo", "path")
        .agg(F.max_by("status", "_n").alias("status"))
    )


def below_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Repository paths as seen from a scanned sub-directory; others are dropped."""
    return df.withColumn("path", paths.strip_prefix(F.col("path"), F.lit(prefix))).where(
        F.col("path").isNotNull()
    )
