"""File inventories and bodies from directories, manifests and tables."""

from __future__ import annotations

import contextlib
import os
import stat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions import measure, names, paths
from coppice.operators.skew import by_merge
from coppice.schema import ENTRY, FILES, MANIFEST, TREE
from coppice.session import Rounds, cut, is_empty


def inventory(df: DataFrame) -> DataFrame:
    """Fill a frame of ``repo, path`` (and whatever else is known) to ``FILES``.

    Unknown columns become null; ``kind`` defaults to ``file`` and ``snapshot``
    to ``head``.
    """
    have = set(df.columns)
    derived = {
        "snapshot": F.lit("head"),
        "parent": paths.dirname(F.col("path")),
        "name": paths.basename(F.col("path")),
        "ext": paths.ext(paths.basename(F.col("path"))),
        "depth": paths.depth(F.col("path")),
        "kind": F.lit("file"),
        "denied": F.lit(False),
        "target_is_dir": F.lit(False),
    }
    columns = []
    for field in FILES.fields:
        if field.name in have:
            value = F.col(field.name)
        else:
            value = derived.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def with_directories(files: DataFrame) -> DataFrame:
    """Add a row for each directory that only shows up inside a path.

    The root ``''`` of each tree is one of them.  Directories that already
    have a row of their own (empty or unreadable ones) keep it.
    """
    implied = (
        files.select(*TREE, F.explode(paths.ancestors(F.col("path"))).alias("path"))
        .distinct()
        .join(by_merge(files.where(F.col("kind") == "dir").select(*ENTRY)), ENTRY, "left_anti")
        .withColumn("kind", F.lit("dir"))
    )
    return files.unionByName(inventory(implied))


LISTED = (
    "path string, kind string, size bigint, mtime double, ctime double, mode int, uid int, gid int, "
    "link_target string, target_is_dir boolean, denied boolean"
)


def _list_folders(base: str):
    """Lists folders, given relative to ``base``, one after another."""

    def entry(at: str, found) -> tuple:
        info = found.stat(follow_symlinks=False)
        path = f"{at}/{found.name}" if at else found.name
        known = (info.st_mtime, info.st_ctime, info.st_mode, info.st_uid, info.st_gid)
        if found.is_symlink():
            real = os.path.realpath(found.path)
            inside = real == base or real.startswith(base + "/")
            target = real[len(base) + 1 :] if inside else os.readlink(found.path)
            there = os.path.exists(found.path)
            size = os.stat(found.path).st_size if there else None
            return (path, "symlink", size, *known, target, os.path.isdir(found.path), False)
        if found.is_dir(follow_symlinks=False):
            return (path, "dir", None, *known, None, False, not os.access(found.path, os.R_OK | os.X_OK))
        kind = "file" if stat.S_ISREG(info.st_mode) else "special"
        return (path, kind, info.st_size, *known, None, False, kind == "file" and not os.access(found.path, os.R_OK))

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in LISTED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for at in batch.column(0).to_pylist():
                rows = []
                with contextlib.suppress(FileNotFoundError, PermissionError), os.scandir(os.path.join(base, at)) as folder:
                    for found in folder:
                        with contextlib.suppress(FileNotFoundError):
                            rows.append(entry(at, found))
                for start in range(0, len(rows), 10_000):
                    columns = zip(*rows[start : start + 10_000], strict=True)
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _read_files(base: str):
    """Bodies of files, given relative to ``base``, one at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                with contextlib.suppress(FileNotFoundError, PermissionError), open(os.path.join(base, batch.column(2)[row].as_py()), "rb") as file:
                    content = pa.array([file.read()], pa.binary())
                    yield pa.record_batch([*batch.slice(row, 1).columns, content], names=[*ENTRY, "content"])

    return run


def from_directory(
    spark: SparkSession, root: str, repo: str, snapshot: str = "head"
) -> tuple[DataFrame, DataFrame]:
    """Inventory and bodies of one directory tree that every executor has mounted.

    Spark's file readers pass over names that begin with a dot or an
    underscore, and over empty folders, so tasks list the folders themselves,
    one level a round.  Only regular files are opened, and only when bodies
    are read.  What may not be read is ``denied`` in the inventory and has no body.  Trees in other stores come in as manifests or tables.
    """
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"{root} is no mounted folder: use from_manifests or from_table")
    base = os.path.normpath(root.removeprefix("file://"))
    rounds = Rounds(spark, "listing")
    level = spark.createDataFrame([("",)], "path string")
    while True:
        found = rounds.add(level.mapInArrow(_list_folders(base), LISTED))
        level = found.where((F.col("kind") == "dir") & ~F.col("denied")).select("path").repartition("path")
        if is_empty(level):
            break
    tree = [F.lit(repo).alias("repo"), F.lit(snapshot).alias("snapshot")]
    files = inventory(rounds.all(found).select(*tree, "*"))
    regular = files.where(F.col("kind") == "file").select(*ENTRY)
    return files, regular.mapInArrow(_read_files(base), "repo string, snapshot string, path string, content binary")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files: one JSON object each."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def from_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inventory (with implied directories) and text bodies of manifests."""
    tree = [F.col("repo"), F.coalesce("snapshot", F.lit("head")).alias("snapshot")]
    listed = manifests.select(*tree, F.inline("files"))
    files = inventory(
        listed.select(*ENTRY, F.octet_length("content").cast("long").alias("size"), "mtime")
    )
    return with_directories(files), listed.select(*ENTRY, F.col("content").alias("text"))


def from_table(
    df: DataFrame,
    repo: Column | str,
    path: Column | str,
    text: Column | str,
    snapshot: str = "head",
    mtime: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Inventory and text bodies of any table of ``(repo, path, text)`` rows."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    named = df.select(
        col(repo).alias("repo"),
        F.lit(snapshot).alias("snapshot"),
        col(path).alias("path"),
        col(text).alias("text"),
        (F.lit(None).cast("double") if mtime is None else mtime).alias("mtime"),
    )
    files = named.select(*ENTRY, F.octet_length("text").cast("long").alias("size"), "mtime")
    return inventory(files), named.select(*ENTRY, "text")


def at_snapshot(contents: DataFrame, ref: str) -> DataFrame:
    """Bodies as of ``ref``: a baseline is one more snapshot value."""
    return contents.where(F.col("snapshot") == ref)


# ---------------------------------------------------------------- bodies


def has_nul(content: Column) -> Column:
    """A NUL byte anywhere."""
    return F.contains(content, F.lit(bytearray(b"\x00")))


def capped(contents: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` bytes of each ``content``, with what was cut on record.

    Adds ``size`` (bytes there), ``byte_len`` (bytes kept) and ``truncated``.
    """
    size = F.octet_length("content").cast("long")
    return contents.withColumns(
        {
            "size": size,
            "truncated": size > limit,
            "byte_len": F.least(size, F.lit(limit).cast("long")),
        }
    ).withColumn("content", F.substring("content", 1, limit))


# The byte sequences that are well-formed UTF-8, one byte per character.
WELL_FORMED = (
    r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that do not decode are dropped, not replaced.

    Bad bodies are viewed as Latin-1, where a character is a byte, and only
    well-formed sequences are kept.  Good ones, nearly all, skip that.
    """
    as_bytes = F.decode(content, "ISO-8859-1")
    kept = F.regexp_replace(as_bytes, rf"(?s)({WELL_FORMED})|.", "$1")
    plain = content.cast("string")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(
        F.encode(kept, "ISO-8859-1").cast("string")
    )


def bodies(contents: DataFrame, limit: int | None = None) -> DataFrame:
    """Text bodies with ``size, byte_len, truncated, is_binary``.

    Takes a ``content`` (binary) or a ``text`` (string) column.  Binary files
    keep their row with a null text, so counts stay "not applicable" for them.
    """
    by_name = names.is_binary_name(paths.basename(F.col("path")))
    if "content" not in contents.columns and limit is None:
        binary = by_name | F.contains("text", F.lit("\x00"))
        size = F.octet_length("text").cast("long")
        return contents.select(
            *ENTRY,
            F.when(~binary, F.col("text")).alias("text"),
            size.alias("size"),
            size.alias("byte_len"),
            F.lit(False).alias("truncated"),
            binary.alias("is_binary"),
        )
    if "content" not in contents.columns:
        contents = contents.select(*ENTRY, F.encode("text", "UTF-8").alias("content"))
    if limit is None:
        size = F.octet_length("content").cast("long")
        held = contents.withColumns(
            {"size": size, "byte_len": size, "truncated": F.lit(False)}
        )
    else:
        held = capped(contents, limit)
    binary = by_name | has_nul(F.col("content"))
    return held.select(
        *ENTRY,
        F.when(~binary, decoded(F.col("content"))).alias("text"),
        "size",
        "byte_len",
        "truncated",
        binary.alias("is_binary"),
    )


def text_counts(
    contents: DataFrame, limit: int | None = None, tokenizer=None
) -> DataFrame:
    """Tokens and lines per file; null for binary ones.

    ``tokenizer`` is an optional Arrow UDF from text to a token count; files
    it returns null for fall back to the character estimate.
    ``ascii_chars``/``other_chars`` are kept because they add up exactly.
    """
    held = bodies(contents, limit)
    scale = measure.cut_scale(F.col("size"), F.col("byte_len"), F.col("truncated"))
    other = measure.other_chars(F.col("text"))
    out = held.select(
        *ENTRY,
        "size",
        "truncated",
        "is_binary",
        scale.alias("_scale"),
        (F.length("text") - other).cast("long").alias("ascii_chars"),
        other.cast("long").alias("other_chars"),
        measure.lines(F.col("text"), scale).alias("lines"),
        *([tokenizer(F.col("text")).alias("_counted")] if tokenizer else []),
    )
    estimate = measure.tokens_of(F.col("ascii_chars"), F.col("other_chars"), F.col("_scale"))
    if tokenizer:
        counted = F.greatest(
            F.lit(1).cast("long"), F.rint(F.col("_counted") * F.col("_scale")).cast("long")
        )
        empty = F.col("ascii_chars") + F.col("other_chars") == 0
        method = F.when(F.col("_counted").isNull(), "chars").otherwise("tokenizer")
        estimate = F.when(empty, F.lit(0).cast("long")).otherwise(F.coalesce(counted, estimate))
    else:
        method = F.lit("chars")
    return out.select(
        *ENTRY,
        "size",
        estimate.alias("tokens"),
        "lines",
        "ascii_chars",
        "other_chars",
        "truncated",
        F.when(F.col("is_binary"), F.lit(None)).otherwise(method).alias("token_method"),
        "is_binary",
    )


BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64("repo", "path"), F.lit(BUCKETS)).cast("int")


def write_bucketed(contents: DataFrame, folder: str) -> DataFrame:
    """Bodies written in ``BUCKETS`` folders by hash of their path, and read back with the column ``bucket``."""
    contents.withColumn("bucket", _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    return contents.sparkSession.read.parquet(folder)


COUNT_KEY = [*ENTRY, "size", "mtime", "method", "read_limit"]


def recount(
    files: DataFrame,
    contents: DataFrame,
    prior: DataFrame,
    limit: int | None = None,
    tokenizer=None,
) -> DataFrame:
    """Counts for every file, counting only bodies whose key is new.

    ``prior`` is an earlier result.  A file is counted again when its size,
    its time, the method (with ``tokenizer`` or without) or the read limit
    changed.  The body table is scanned for those files by a semi join; of one
    in buckets (``write_bucketed``) only the buckets of such files are read.
    """
    method = "chars" if tokenizer is None else "tokenizer"
    keyed = files.where(F.col("kind") == "file").select(
        *ENTRY,
        "size",
        "mtime",
        F.lit(method).alias("method"),
        F.lit(-1 if limit is None else limit).cast("long").alias("read_limit"),
    )
    columns = [*COUNT_KEY, "tokens", "lines"]
    same = [keyed[c].eqNullSafe(prior[c]) if c == "mtime" else keyed[c] == prior[c] for c in COUNT_KEY]
    reused = keyed.join(prior, same, "inner").select(
        *[keyed[c] for c in COUNT_KEY], prior["tokens"], prior["lines"]
    )
    fresh_keys = keyed.join(prior, same, "left_anti")
    if "bucket" in contents.columns:
        fresh_keys = cut(fresh_keys, "fresh")
        found = fresh_keys.select(_bucket().alias("bucket")).distinct().collect()  # BUCKETS numbers at most
        contents = contents.where(F.col("bucket").isin([r.bucket for r in found])).drop("bucket")
    fresh_bodies = contents.join(fresh_keys.select(*ENTRY), ENTRY, "left_semi")
    counts = text_counts(fresh_bodies, limit, tokenizer).select(*ENTRY, "tokens", "lines")
    fresh = fresh_keys.join(counts, ENTRY, "left").select(*columns)
    return reused.unionByName(fresh)


# ---------------------------------------------------------------- requests, rules


def requested(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One row per requested path, none dropped: unresolved ones carry ``error``."""
    asked = (
        requests.select(*TREE, paths.strip(F.col("path")).alias("given"))
        .where(F.col("given") != "")
        .withColumn("path", paths.normpath(F.col("given")))
        .withColumn("path", F.when(F.col("path") == ".", "").otherwise(F.col("path")))
        .groupBy(*ENTRY)
        .agg(F.min("given").alias("given"))
    )
    return asked.join(files.select(*ENTRY, "kind", "size"), ENTRY, "left").select(
        *ENTRY,
        "given",
        F.when(F.col("kind") != "dir", F.col("size")).alias("size"),
        F.when(F.col("kind").isNull(), "not found")
        .when(F.col("kind") == "dir", "is a directory")
        .alias("error"),
    )


def ignore_rules(contents: DataFrame) -> DataFrame:
    """Rules of every ``.gitignore``: stripped lines without blanks and comments."""
    line = paths.strip(F.col("_line"))
    return (
        contents.where(paths.basename(F.col("path")) == ".gitignore")
        .select(
            *TREE,
            paths.dirname(F.col("path")).alias("dir"),
            F.posexplode(F.split("text", "\n")).alias("line_no", "_line"),
        )
        .select(*TREE, "dir", F.col("line_no") + 1, line.alias("pattern"))
        .toDF(*TREE, "dir", "line_no", "pattern")
        .where((F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))
    )


# ---------------------------------------------------------------- manifest facts


# Files that say something about their tree.
MANIFESTS = ["go.mod", "tsconfig.json", "jsconfig.json", "package.json", ".gitignore"]


def manifest_bodies(contents: DataFrame) -> DataFrame:
    """Bodies of manifests and ignore files: one pass over the bodies.

    Few and small; written out, they serve every function below.
    """
    return contents.where(paths.basename(F.col("path")).isin(MANIFESTS)).select(*ENTRY, "text")


def go_modules(contents: DataFrame) -> DataFrame:
    """Module name of each tree; of several ``go.mod`` the smallest path wins."""
    # A line "module NAME": blanks around it are trimmed first.
    found = F.regexp_extract("text", r"(?m)^[^\S\n]*module (.*)$", 1)
    return (
        contents.where(paths.basename(F.col("path")) == "go.mod")
        .select(*ENTRY, paths.strip(found).alias("module"))
        .where(F.col("module") != "")
        .groupBy(*TREE)
        .agg(F.min_by("module", "path").alias("module"))
    )


def without_comments(text: Column) -> Column:
    """JSON text from JSON with comments and trailing commas; strings are kept."""
    bare = F.regexp_replace(
        text, r'("(?:[^"\\]++|\\.)*+")|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)', "$1"
    )
    return F.regexp_replace(bare, r",\s*([}\]])", "$1")


COMPILER = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"


def ts_options(contents: DataFrame) -> DataFrame:
    """``base_url`` and ``paths`` of the root ``tsconfig.json``, else ``jsconfig.json``.

    ``paths`` is an array so that the written order of aliases is kept.
    """
    parsed = contents.where(F.col("path").isin("tsconfig.json", "jsconfig.json")).select(
        *TREE,
        (F.col("path") == "jsconfig.json").cast("int").alias("_rank"),
        F.from_json(without_comments(F.col("text")), COMPILER).alias("_o"),
    )
    base = F.coalesce(F.col("_o.compilerOptions.baseUrl"), F.lit(""))
    base = F.regexp_replace(base, r"\A(\./)+", "")
    options = parsed.select(
        *TREE,
        "_rank",
        F.when(base == ".", "").otherwise(base).alias("base_url"),
        F.coalesce(
            F.map_entries("_o.compilerOptions.paths"),
            F.array().cast("array<struct<key:string,value:array<string>>>"),
        ).alias("paths"),
    )
    said = (F.col("base_url") != "") | (F.size("paths") > 0)
    return (
        options.groupBy(*TREE)
        .agg(F.min_by(F.struct("base_url", "paths"), F.struct((~said).alias("e"), "_rank")).alias("_o"))
        .select(*TREE, "_o.base_url", "_o.paths")
    )


def package_aliases(contents: DataFrame) -> DataFrame:
    """``#`` aliases of the root ``package.json``, in written order, a row per tree."""
    parsed = contents.where(F.col("path") == "package.json").select(
        *TREE, F.from_json("text", "struct<imports:map<string,string>>").alias("_p")
    )
    # A target that is an object of conditions arrives as its JSON text.
    return parsed.select(
        *TREE,
        F.filter(
            F.map_entries("_p.imports"),
            lambda e: e["value"].isNotNull() & ~F.startswith(e["value"], F.lit("{")),
        ).alias("aliases"),
    ).where(F.col("aliases").isNotNull())


def package_entries(contents: DataFrame, files: DataFrame) -> DataFrame:
    """``main`` and ``bin`` of every ``package.json``, where that very file exists."""
    packages = contents.where(paths.basename(F.col("path")) == "package.json").select(
        *TREE,
        paths.dirname(F.col("path")).alias("_dir"),
        F.try_parse_json("text").alias("_v"),
    )
    kind_of = lambda p: F.schema_of_variant(F.try_variant_get("_v", p, "variant"))
    text_at = lambda p: F.when(
        kind_of(p) == "STRING", F.try_variant_get("_v", p, "string")
    )
    named = F.map_values(F.try_variant_get("_v", "$.bin", "map<string,variant>"))
    texts = F.transform(
        F.filter(named, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: v.cast("string"),
    )
    specs = F.concat(
        F.array(text_at("$.main"), text_at("$.bin")),
        F.coalesce(texts, F.array().cast("array<string>")),
    )
    return (
        packages.select(*TREE, "_dir", F.explode(specs).alias("_spec"))
        .where(F.col("_spec").isNotNull())
        .select(*TREE, paths.normpath(paths.join(F.col("_dir"), F.col("_spec"))).alias("path"))
        .distinct()
        .join(by_merge(files.where(F.col("kind") != "dir").select(*ENTRY)), ENTRY, "left_semi")
    )


def cargo_dirs(files: DataFrame) -> DataFrame:
    """Directories with a ``Cargo.toml``: the crate roots."""
    return (
        files.where((F.lower("name") == "cargo.toml") & (F.col("kind") != "dir"))
        .select(*TREE, F.col("parent").alias("dir"))
        .distinct()
    )
