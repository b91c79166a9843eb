"""Order of a tree listing: siblings, depth-first positions, tops and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import labels, paths
from coppice.operators.rollup import directory_sizes
from coppice.operators.skew import by_merge, first_n, numbered, skew_join
from coppice.schema import ENTRY, TREE


def _group(kind: Column, files_first: bool) -> Column:
    return F.when(kind == "dir", 1 if files_first else 0).otherwise(0 if files_first else 1)


def sibling_order(sort: str = "name", reverse: bool = False, files_first: bool = False) -> list[Column]:
    """Sort columns among the entries of one directory.

    Names go up ignoring case; times and sizes go down; ``reverse`` turns that
    round.  Directories and files are sorted apart.  Ties go by name, then path.
    """
    keys = {
        "name": paths.casefold(F.col("name")),
        "mtime": F.coalesce("mtime", F.lit(0.0)),
        "ctime": F.coalesce("ctime", F.lit(0.0)),
        "size": F.coalesce("total_size", F.lit(0)),
    }
    down = (sort != "name") != reverse
    key = keys[sort].desc() if down else keys[sort].asc()
    return [_group(F.col("kind"), files_first).asc(), key, F.col("name").asc()]


def with_total_size(files: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``total_size``: a file's own size, a directory's bytes below.

    For a filtered listing ``sizes`` are the ``directory_sizes`` of all files:
    bytes that are not listed count too.
    """
    sizes = directory_sizes(files) if sizes is None else sizes
    below = sizes.select(*TREE, F.col("dir").alias("path"), F.col("size").alias("_below"))
    return files.join(below, ENTRY, "left").select(
        *files.columns,
        F.when(F.col("kind") == "dir", F.coalesce("_below", F.lit(0)))
        .otherwise(F.coalesce("size", F.lit(0)))
        .alias("total_size"),
    )


def sibling_ranks(
    files: DataFrame, sort: str = "name", reverse: bool = False, files_first: bool = False, sizes: DataFrame | None = None
) -> DataFrame:
    """Place of each entry in its directory, 1 first."""
    entries = files.where(F.col("path") != "")
    if sort == "size":
        entries = with_total_size(files, sizes).where(F.col("path") != "")
    order = sibling_order(sort, reverse, files_first)
    keep = [*ENTRY, "parent", "name", "kind", "mtime", "ctime"]
    keep += ["total_size"] if sort == "size" else []
    return numbered(entries.select(*keep), [*TREE, "parent"], order, "rank").select(
        *ENTRY, "parent", "kind", "rank"
    )


def name_key(path: Column, kind: Column, files_first: bool = False) -> Column:
    """Depth-first sort key for name order, from the path alone.

    One ``(group, folded name, name)`` per level; arrays compare from the left
    and a prefix comes first, which is depth-first order.
    """
    parts = paths.components(path)
    inner = 1 if files_first else 0
    return F.transform(
        parts,
        lambda c, i: F.struct(
            F.when(i == F.size(parts) - 1, _group(kind, files_first))
            .otherwise(inner)
            .alias("group"),
            paths.casefold(c).alias("fold"),
            c.alias("name"),
        ),
    )


def tree_keys(
    files: DataFrame, sort: str = "name", reverse: bool = False, files_first: bool = False, sizes: DataFrame | None = None
) -> DataFrame:
    """``files`` with ``tree_key``; ordering by it lists each tree depth-first.

    Name order needs no join.  Any other order ranks siblings and collects the
    ranks on the way down, at most one per level.
    """
    if sort == "name" and not reverse:
        return files.withColumn("tree_key", name_key(F.col("path"), F.col("kind"), files_first))
    ranks = sibling_ranks(files, sort, reverse, files_first, sizes).select(
        *TREE, F.col("path").alias("_at"), "rank"
    )
    steps = files.select(*ENTRY, F.explode(paths.self_and_ancestors(F.col("path"))).alias("_at"))
    joined = skew_join(steps, ranks, [*TREE, "_at"], ["path"])
    keyed = joined.groupBy(*ENTRY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(paths.depth(F.col("_at")).alias("d"), "rank"))),
            lambda s: s["rank"],
        ).alias("tree_key")
    )
    return files.join(by_merge(keyed), ENTRY, "left").withColumn(
        "tree_key", F.coalesce("tree_key", F.array().cast("array<bigint>"))
    )


def positions(keyed: DataFrame) -> DataFrame:
    """``pos``: place in the depth-first listing of the tree, from 1."""
    return numbered(keyed, TREE, [F.col("tree_key"), F.col("path")], "pos")


def largest(files: DataFrame, n: int, per_tree: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """The ``n`` largest files and the ``n`` largest directories, ties by path."""
    sized = with_total_size(files, sizes).where(F.col("path") != "").select(
        *ENTRY,
        F.when(F.col("kind") == "dir", "dir").otherwise("file").alias("kind"),
        F.col("total_size").alias("size"),
    )
    order = [F.col("size").desc(), *([] if per_tree else [F.col("repo"), F.col("snapshot")]), F.col("path")]
    return first_n(sized, [*TREE, "kind"] if per_tree else ["kind"], order, n)


def top_extensions(files: DataFrame, n: int = 8) -> DataFrame:
    """Most frequent types; equal ones by where they first show up in the listing."""
    first = name_key(F.col("path"), F.col("kind"))
    counted = (
        files.where(F.col("kind") != "dir")
        .groupBy(*TREE, F.when(F.col("ext") == "", "(no ext)").otherwise(F.col("ext")).alias("type"))
        .agg(F.count("*").alias("files"), F.min(first).alias("_first"))
    )
    return first_n(counted, TREE, [F.col("files").desc(), F.col("_first")], n).drop("_first")


def top_types_by_tokens(files: DataFrame, counts: DataFrame, n: int = 6) -> DataFrame:
    """Types holding most tokens; equal ones by first appearance in the listing."""
    measured = files.select(
        *ENTRY,
        F.when(F.col("ext") == "", "(no ext)").otherwise(F.col("ext")).alias("type"),
        name_key(F.col("path"), F.col("kind")).alias("_key"),
    ).join(counts.where(F.col("tokens").isNotNull()).select(*ENTRY, "tokens", "lines"), ENTRY)
    totals = measured.groupBy(*TREE, "type").agg(
        F.count("*").alias("files"),
        F.sum("tokens").alias("tokens"),
        F.sum("lines").alias("lines"),
        F.min("_key").alias("_first"),
    )
    return first_n(totals, TREE, [F.col("tokens").desc(), F.col("_first")], n).drop("_first")


def limited(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First ``n`` rows, each with ``total`` and whether rows were ``truncated``."""
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order).limit(n)
    # The total is one row: attaching it is a lookup, not a product of two tables.
    return (
        top.withColumn("_one", F.lit(1))
        .join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
        .drop("_one")
        .withColumn("truncated", F.col("total") > n)
    )


def last_children(keyed: DataFrame) -> DataFrame:
    """The entry listed last in each directory."""
    tail = F.element_at("tree_key", -1)
    return (
        keyed.where(F.col("path") != "")
        .groupBy(*TREE, "parent")
        .agg(F.max_by("path", F.struct(tail.alias("k"), F.col("name").alias("n"))).alias("_at"))
        .select(*TREE, "_at", F.lit(True).alias("_last"))
    )


def tree_lines(
    files: DataFrame,
    notes: DataFrame | None = None,
    sort: str = "name",
    reverse: bool = False,
    files_first: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One text line per entry, with branches, and ``tree_key`` to order by.

    ``notes`` may bring ``(repo, snapshot, path, note)`` to show in brackets, and
    ``lead`` and ``bar`` to show before the name and at the end; ``sizes`` are for
    size order, as in ``with_total_size``.
    The root line has an empty key and comes first.
    """
    keyed = tree_keys(files, sort, reverse, files_first, sizes)
    entries = keyed.where(F.col("path") != "")
    steps = entries.select(
        *ENTRY, F.explode(F.slice(paths.self_and_ancestors(F.col("path")), F.lit(2), F.lit(2**30))).alias("_at")
    )
    flags = skew_join(steps, last_children(keyed), [*TREE, "_at"], ["path"], "left")
    is_last = F.coalesce("_last", F.lit(False))
    piece = F.when(
        F.col("_at") == F.col("path"), F.when(is_last, "└── ").otherwise("├── ")
    ).otherwise(F.when(is_last, "    ").otherwise("│   "))
    prefixes = flags.groupBy(*ENTRY).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(paths.depth(F.col("_at")).alias("d"), piece.alias("p"))
                    )
                ),
                lambda s: s["p"],
            ),
            "",
        ).alias("prefix")
    )
    out = keyed.join(by_merge(prefixes), ENTRY, "left")
    shows = ["note", "lead", "bar"]
    given = [] if notes is None else [c for c in shows if c in notes.columns]
    if given:
        out = out.join(by_merge(notes.select(*ENTRY, *given)), ENTRY, "left")
    out = out.withColumns({c: F.lit(None).cast("string") for c in shows if c not in given})
    shown = labels.printable(
        F.when(F.col("path") == "", F.concat("repo", F.lit("/")))
        .when(F.col("kind") == "dir", F.concat("name", F.lit("/")))
        .when(F.col("kind") == "symlink", F.concat_ws(" → ", "name", "link_target"))
        .otherwise(F.col("name"))
    )
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise("")
    return out.select(
        *ENTRY,
        "depth",
        "tree_key",
        F.concat(*[F.coalesce(c, F.lit("")) for c in ("prefix", "lead")], shown, note, F.coalesce("bar", F.lit(""))).alias("line"),
    )


def entry_notes(
    files: DataFrame,
    annotated: DataFrame | None = None,
    sizes: DataFrame | None = None,
    now: float | None = None,
    bars: bool = False,
    modes: bool = False,
    owners: bool = False,
) -> DataFrame:
    """What stands around a name in a listing.

    ``note``, in brackets behind it: counts and size, with ``now`` the age, then
    the annotations.  ``lead``, before it: with ``modes`` and ``owners`` those,
    then the status, then the mark of an entry point or else of a configuration
    file.  ``bar``: with ``bars``, the share of the directory it is in.
    """
    sizes = directory_sizes(files) if sizes is None else sizes
    from coppice.operators.rollup import child_counts, shares

    # A size says whether a directory's total is in part, so it can be missing here and there.
    times = ["mtime", "mode", "uid", "gid"]
    kept = [F.col(c) if c in files.columns else F.lit(None).cast("double" if c == "mtime" else "int").alias(c) for c in times]
    out = (
        files.select(*ENTRY, "kind", "size", "denied", *kept)
        .join(
            by_merge(sizes.select(*TREE, F.col("dir").alias("path"), F.col("size").alias("_below"), "partial")),
            ENTRY,
            "left",
        )
        .join(by_merge(child_counts(files).withColumnRenamed("dir", "path")), ENTRY, "left")
    )
    if bars:
        share = shares(files, sizes).where(F.col("parent_size") > 0)
        out = out.join(by_merge(share.select(*ENTRY, F.concat(F.lit(" "), "bar").alias("_bar"))), ENTRY, "left")
    zero = F.lit(0).cast("long")
    is_dir = F.col("kind") == "dir"
    age = F.lit(None).cast("string")
    if now is not None:
        age = F.when(F.col("mtime").isNotNull() & (is_dir | (F.col("mtime") != 0)), labels.age_label(F.lit(now), F.col("mtime")))
    directory = [
        labels.count_label(F.coalesce("dirs", zero), F.coalesce("files", zero), F.col("denied")),
        labels.size_label(F.coalesce("_below", zero), F.col("partial")),
        age,
    ]
    file = [labels.size_label(F.coalesce("size", zero)), age]
    status, mark = F.lit(None).cast("string"), F.lit(None).cast("string")
    if annotated is not None:
        number = lambda name, sign: F.when(F.col(name) > 0, F.concat(F.lit(sign), F.col(name).cast("string")))
        added = annotated.select(
            *ENTRY,
            F.concat_ws(
                ", ",
                labels.token_label(F.col("tokens")),
                F.when(F.col("lines").isNotNull(), F.concat(F.col("lines").cast("string"), F.lit(" lines"))),
                F.col("last_commit"),
                number("todo_count", "TODO×"),
                F.when(~F.col("has_test"), F.lit("no test")),
                F.when(F.col("is_config"), F.lit("config")),
                F.col("outline"),
                number("imports", "imports×"),
                number("imported_by", "used-by×"),
            ).alias("_extra"),
            F.concat(F.lit("["), F.nullif(F.trim("git_status"), F.lit("")), F.lit("] ")).alias("_status"),
            F.when(F.col("is_entry"), "* ").when(F.col("is_config"), "⚙ ").alias("_mark"),
        )
        out = out.join(by_merge(added), ENTRY, "left")
        file.append(F.nullif("_extra", F.lit("")))
        status, mark = F.col("_status"), F.col("_mark")
    shown = [labels.mode_label(F.col("mode"))] if modes else []
    shown += [F.col(c).cast("string") for c in ("uid", "gid")] if owners else []
    access = F.when(F.col("mode").isNotNull(), F.concat(F.lit("["), F.concat_ws(" ", *shown), F.lit("] "))) if shown else F.lit(None).cast("string")
    none = F.lit("")
    return out.select(
        *ENTRY,
        F.when(is_dir, F.concat_ws(", ", *directory)).otherwise(F.concat_ws(", ", *file)).alias("note"),
        F.concat(F.coalesce(access, none), F.when(is_dir, none).otherwise(F.concat(F.coalesce(status, none), F.coalesce(mark, none)))).alias("lead"),
        (F.coalesce("_bar", none) if bars else none).alias("bar"),
    )
