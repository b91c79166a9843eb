"""Which entries of a tree are listed: hidden, ignored, excluded, sized, changed, pruned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import names, paths
from coppice.operators.skew import salted_join
from coppice.schema import ENTRY, TREE
from coppice.session import Rounds, cut, is_empty, loop_settings


def not_hidden(files: DataFrame) -> DataFrame:
    """Drop names starting with a dot, and all below them."""
    return files.where(~F.col("path").rlike(r"(\A|/)\."))


def _any_glob(name: Column, globs: list[str]) -> Column:
    hits = [name.rlike(paths.regex_of_glob(g)) for g in globs]
    return reduce(lambda a, b: a | b, hits)


def exclude(files: DataFrame, globs: list[str]) -> DataFrame:
    """Drop entries whose name matches; a matching directory takes its subtree along."""
    if not globs:
        return files
    return files.where(~F.exists(paths.components(F.col("path")), lambda c: _any_glob(c, globs)))


def include(files: DataFrame, globs: list[str]) -> DataFrame:
    """Keep files whose name matches any glob; directories stay."""
    if not globs:
        return files
    return files.where((F.col("kind") == "dir") | _any_glob(F.col("name"), globs))


def of_type(files: DataFrame, ext: str) -> DataFrame:
    """Keep files of one extension, given with or without its dot; directories stay."""
    wanted = "." + ext.lower().lstrip(".")
    return files.where((F.col("kind") == "dir") | (F.col("ext") == wanted))


def sized(files: DataFrame, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """Keep files in a size range, both ends included; unknown sizes pass."""
    low = F.lit(True) if min_size is None else F.col("size") >= min_size
    high = F.lit(True) if max_size is None else F.col("size") <= max_size
    return files.where((F.col("kind") == "dir") | F.col("size").isNull() | (low & high))


def dirs_only(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind") == "dir")


def changed_only(files: DataFrame, since: DataFrame) -> DataFrame:
    """Keep files named in a since set (``operators.history.since_marks``)."""
    kept = files.where(F.col("kind") != "dir").join(since.select("repo", "path"), ["repo", "path"], "left_semi")
    return files.where(F.col("kind") == "dir").unionByName(kept)


def to_depth(files: DataFrame, max_depth: int) -> DataFrame:
    """Entries at most ``max_depth`` names deep.  Totals belong to the uncut frame."""
    return files.where(F.col("depth") <= max_depth)


def prune(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Drop directories with no listed file below.

    With a depth limit, files deeper than that do not count.
    """
    held = files.where(F.col("kind") != "dir")
    if max_depth is not None:
        held = to_depth(held, max_depth)
    holders = held.select(*TREE, F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    dirs = files.where(F.col("kind") == "dir").join(holders, ENTRY, "left_semi")
    return files.where(F.col("kind") != "dir").unionByName(dirs)


def sensitive(files: DataFrame) -> DataFrame:
    """Files whose names suggest credentials."""
    return files.where((F.col("kind") != "dir") & names.is_sensitive_name(F.col("name"))).select(
        *ENTRY
    )


# ---------------------------------------------------------------- ignore rules


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Rules with what they ask of a root-relative path.

    A leading ``/`` anchors at the rule's own directory; any other pattern may
    also start below any directory.  ``*`` crosses ``/``.  By ``form``, a rule
    names a ``path``, the last ``name`` (or names) of one, or its ending behind a
    ``*`` (``ext``): then ``key`` is what to look it up by and ``needle`` the
    whole literal.  The others (``glob``) have a ``regex``.
    """
    pattern = F.regexp_replace("pattern", r"\A!+", "")
    bare = F.regexp_replace(pattern, r"/+\z", "")
    anchored = F.startswith(bare, F.lit("/"))
    below = F.when(F.col("dir") == "", F.regexp_replace(bare, r"\A/+", "")).otherwise(
        F.concat("dir", bare)
    )
    # Spark folds what a projection works out into every use of it, but not what a generator returns.
    parts = F.struct(
        F.when(anchored, below).otherwise(bare).alias("glob"),
        anchored.alias("anchored"),
        F.startswith("pattern", F.lit("!")).alias("negated"),
        F.endswith(pattern, F.lit("/")).alias("dir_only"),
    )
    read = rules.select(*TREE, "dir", "line_no", F.explode(F.array(parts)).alias("_p")).select(*TREE, "dir", "line_no", "_p.*")
    form = (
        F.when(~F.col("glob").rlike(r"[*?\[]"), F.when(F.col("anchored"), "path").otherwise("name"))
        .when(~F.col("anchored") & F.col("glob").rlike(r"(?s)\A\*[^*?\[]*\.[^*?\[]*\z"), "ext")
        .otherwise("glob")
    )
    formed = read.select("*", F.explode(F.array(form)).alias("form"))
    regex = paths.glob_to_regex(F.col("glob"))
    inner = F.substring(regex, F.lit(len(r"(?s)\A") + 1), F.length(regex))
    needle = F.when(F.col("form") == "ext", F.substring("glob", F.lit(2), F.length("glob"))).otherwise(F.col("glob"))
    return formed.select(
        *TREE,
        "dir",
        "line_no",
        "negated",
        "dir_only",
        "form",
        F.when(F.col("form") == "path", F.col("glob"))
        .when(F.col("form") == "name", paths.basename(F.col("glob")))
        .when(F.col("form") == "ext", F.substring_index("glob", ".", -1))
        .alias("key"),
        needle.alias("needle"),
        F.when(F.col("form") == "glob", F.concat(F.when(F.col("anchored"), r"(?s)\A").otherwise(r"(?s)\A(?:.*/)?"), inner)).alias("regex"),
    )


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries whose last matching rule, nearest directory last, is not a negation.

    Rules that name something are looked up by equality, whatever their number;
    only globs are tried one by one, on the entries below them.
    """
    entries = files.where(F.col("path") != "").select(
        *ENTRY,
        (F.col("kind") == "dir").alias("is_dir"),
        F.explode(paths.ancestors(F.col("path"))).alias("dir"),
    )
    compiled = cut(compiled_rules(rules), "rules")
    held = entries.join(rules.select(*TREE, "dir").distinct(), [*TREE, "dir"], "left_semi")
    keys = F.array(
        F.struct(F.lit("path").alias("form"), F.col("path").alias("key")),
        F.struct(F.lit("name").alias("form"), paths.basename(F.col("path")).alias("key")),
        F.struct(F.lit("ext").alias("form"), F.substring_index("path", ".", -1).alias("key")),
    )
    keyed = held.select("*", F.explode(keys).alias("_k")).select(*ENTRY, "is_dir", "dir", "_k.*")
    fits = ~F.col("r.dir_only") | F.col("l.is_dir")
    whole = (F.col("l.path") == F.col("r.needle")) | F.endswith("l.path", F.concat(F.lit("/"), F.col("r.needle")))
    looked_up = salted_join(
        keyed,
        compiled.where(F.col("form") != "glob").drop("regex"),
        [*TREE, "dir", "form", "key"],
        ["path"],
        condition=fits
        & F.when(F.col("r.form") == "name", whole).when(F.col("r.form") == "ext", F.endswith("l.path", F.col("r.needle"))).otherwise(True),
    )
    tried = salted_join(
        held,
        compiled.where(F.col("form") == "glob").drop("form", "key", "needle"),
        [*TREE, "dir"],
        ["path"],
        condition=fits & F.expr("l.path rlike r.regex"),
    )
    columns = [*ENTRY, "is_dir", "dir", "line_no", "negated"]
    place = F.struct(paths.depth(F.col("dir")).alias("d"), F.col("line_no").alias("n"))
    return (
        looked_up.select(*columns)
        .unionByName(tried.select(*columns))
        .groupBy(*ENTRY, "is_dir")
        .agg(F.max_by("negated", place).alias("negated"))
        .where(~F.col("negated"))
        .select(*ENTRY, "is_dir")
    )


def drop_subtrees(files: DataFrame, dropped: DataFrame) -> DataFrame:
    """Remove ``dropped`` entries and everything below those of them that are directories."""
    holes = dropped.select(*TREE, F.col("path").alias("_hole"))
    under = files.select(*ENTRY, F.explode(paths.self_and_ancestors(F.col("path"))).alias("_hole"))
    gone = (
        salted_join(under, holes, [*TREE, "_hole"], ["path"], "left_semi").select(*ENTRY).distinct()
    )
    return files.join(gone, ENTRY, "left_anti")


def apply_ignore(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Entries left after the ignore files of every directory level."""
    return drop_subtrees(files, ignored(files, rules))


def apply_ignored_set(files: DataFrame, ignored_paths: DataFrame) -> DataFrame:
    """Entries left after an exact set of ignored ``(repo, snapshot, path)``."""
    return drop_subtrees(files, ignored_paths)


def root_ignored(roots: DataFrame, rules: DataFrame) -> DataFrame:
    """Scan roots (directory rows of an outer tree) that are ignored themselves."""
    return ignored(roots, rules).where("is_dir").select(*ENTRY)


# ---------------------------------------------------------------- links


def follow_links(files: DataFrame) -> DataFrame:
    """Entries reached by descending into links to directories.

    ``link_target`` has to hold the root-relative real path.  A link whose real
    directory is already on the way down to it is listed (``cyclic``) but not
    entered, which ends every way down.  Adds ``real_path``: where the entry's
    data is.
    """
    columns = [c for c in files.columns if c not in ("path", "parent", "depth")]
    real = files.select(*ENTRY, *[c for c in columns if c not in TREE])

    def chain_of(path: Column) -> Column:
        return paths.ancestors(path)

    start = real.select(
        "*",
        F.col("path").alias("real_path"),
        chain_of(F.col("path")).alias("chain"),
    )

    def links_in(df: DataFrame) -> DataFrame:
        return df.where((F.col("kind") == "symlink") & F.col("target_is_dir"))

    spark = files.sparkSession
    body = [c for c in real.columns if c not in ENTRY]
    with loop_settings(spark):
        rounds = Rounds(spark, "links")
        level = rounds.add(_marked(start))
        while True:
            entered = links_in(level).where(~F.col("cyclic"))
            if is_empty(entered):
                break
            doors = entered.select(
                *TREE,
                F.col("path").alias("_at"),
                F.col("chain").alias("_chain"),
                F.col("link_target").alias("_top"),
            )
            under = real.select(
                *ENTRY, *body, F.explode(paths.ancestors(F.col("path"))).alias("_top")
            )
            found = salted_join(under, doors, [*TREE, "_top"], ["path"])
            below = paths.strip_prefix(
                F.col("path"),
                F.when(F.col("_top") == "", F.lit("")).otherwise(F.concat("_top", F.lit("/"))),
            )
            inner = F.filter(
                paths.ancestors(F.col("path")),
                lambda d: (d == F.col("_top"))
                | (F.col("_top") == "")
                | F.startswith(d, F.concat(F.col("_top"), F.lit("/"))),
            )
            nxt = found.where(~F.arrays_overlap("_chain", inner)).select(
                *TREE,
                F.concat("_at", F.lit("/"), below).alias("path"),
                *body,
                F.col("path").alias("real_path"),
                F.concat("_chain", inner).alias("chain"),
            )
            level = rounds.add(_marked(nxt))
        return rounds.all(level).drop("chain")


def _marked(level: DataFrame) -> DataFrame:
    looped = F.array_contains("chain", F.col("link_target"))
    return level.withColumn(
        "cyclic",
        F.coalesce(
            (F.col("kind") == "symlink") & F.col("target_is_dir") & looped, F.lit(False)
        ),
    )


def visible(
    files: DataFrame,
    rules: DataFrame | None = None,
    ignored_paths: DataFrame | None = None,
    show_all: bool = False,
    include_ignored: bool = False,
    excludes: list[str] = (),
    includes: list[str] = (),
    ext: str | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    since: DataFrame | None = None,
    only_dirs: bool = False,
    pruned: bool = False,
    max_depth: int | None = None,
) -> DataFrame:
    """All the filters, in the order in which they depend on each other.

    Ignore matching and pruning read the inventory several times, so it is
    written out around them.
    """
    out = files if show_all else not_hidden(files)
    if not include_ignored and (ignored_paths is not None or rules is not None):
        out = cut(out, "entries")
        if ignored_paths is not None:
            out = apply_ignored_set(out, ignored_paths)
        else:
            out = apply_ignore(out, rules)
        out = cut(out, "entries")
    if only_dirs:
        out = dirs_only(out)
    out = include(exclude(out, list(excludes)), list(includes))
    if ext is not None:
        out = of_type(out, ext)
    if min_size is not None or max_size is not None:
        out = sized(out, min_size, max_size)
    if since is not None:
        out = changed_only(out, since)
    if (pruned or since is not None) and not only_dirs:
        out = prune(out, max_depth)
    return out if max_depth is None else to_depth(out, max_depth)
