"""Imports resolved to files of the same tree.

Every import becomes a few candidates ``(space, key)`` in order of preference:
a path, a module name, a package directory or a path ending.  Every file of a
tree is listed under the keys it answers to.  One join of the two settles the
imports of all languages.

The result has rows ``repo, snapshot, src, ord, form, shown, dst``: one per
resolved target, or one with a null ``dst`` for an import that stays external,
with ``shown`` as its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions import paths
from coppice.operators.skew import by_merge, by_size, first_n, salted_join, skew_join, spread_join
from coppice.schema import TREE
from coppice.session import cut, short_tasks

IMPORT = [*TREE, "src", "ord", "form", "shown"]
#: Tried in this order after the bare path.
JS_SUFFIXES = [
    "", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs",
    "/index.js", "/index.ts", "/index.jsx", "/index.tsx",
]


def _empty() -> Column:
    return F.array().cast("array<string>")


def _sources(files: DataFrame) -> DataFrame:
    return files.where(F.col("kind") != "dir").select(*TREE, "path", "name", "ext")


def _candidates(imports: DataFrame, space: str, keys: Column, first: int = 0) -> DataFrame:
    """One row per key; an import without any keeps one row with a null key."""
    return imports.select(
        *IMPORT, F.lit(space).alias("space"), F.posexplode_outer(keys).alias("prio", "key")
    ).withColumn("prio", F.col("prio") + first)


# ---------------------------------------------------------------- candidates


def python_candidates(raw: DataFrame) -> DataFrame:
    """Absolute imports by exact module name; relative ones from the package up.

    A relative import tries each imported name as a module of the package, in
    order, then the package itself.
    """
    base = F.when(paths.dirname(F.col("src")) == "", _empty()).otherwise(
        F.split(paths.dirname(F.col("src")), "/")
    )
    kept = F.slice(base, F.lit(1), F.greatest(F.lit(0), F.size(base) - (F.col("level") - 1)))
    module = F.when(F.col("spec") == "", _empty()).otherwise(F.array("spec"))
    inside = F.transform(
        F.coalesce("names", _empty()),
        lambda n: F.when(F.col("_package") == "", n).otherwise(
            F.concat("_package", F.lit("."), n)
        ),
    )
    keys = F.when(F.col("level") > 0, F.concat(inside, F.array("_package"))).otherwise(
        F.array("spec")
    )
    imports = (
        raw.where(F.col("lang") == "py")
        .withColumn("_package", F.array_join(F.concat(kept, module), "."))
        .withColumn("shown", F.concat(F.repeat(F.lit("."), F.col("level")), "spec"))
    )
    return _candidates(imports, "py", keys)


def javascript_candidates(raw: DataFrame, options: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relative paths, then ``#`` aliases, then configured path aliases and base.

    ``options`` is ``sources.trees.ts_options``, ``aliases`` is
    ``sources.trees.package_aliases``: a row per tree each.
    """
    specs = raw.where(F.col("lang") == "js").withColumn("shown", F.col("spec"))
    imports = salted_join(
        salted_join(specs, options, TREE, ["src"], "left", grows=True), aliases, TREE, ["src"], "left", grows=True
    )
    spec = F.col("spec")
    relative = F.array(paths.normpath(paths.join(paths.dirname(F.col("src")), spec)))

    def from_alias(entry: Column) -> Column:
        middle = paths.star_match(entry["key"], spec)
        return F.when(
            middle.isNotNull(), paths.normpath(F.replace(entry["value"], F.lit("*"), middle))
        )

    def from_paths(entry: Column) -> Column:
        middle = paths.star_match(entry["key"], spec)
        return F.transform(
            entry["value"],
            lambda t: F.when(
                middle.isNotNull(),
                paths.normpath(paths.join(F.col("base_url"), F.replace(t, F.lit("*"), middle))),
            ),
        )

    on_base = F.when(
        F.coalesce("base_url", F.lit("")) != "",
        F.array(paths.normpath(paths.join(F.col("base_url"), spec))),
    ).otherwise(_empty())
    hashed = F.coalesce(F.transform("aliases", from_alias), _empty())
    configured = F.concat(
        F.coalesce(F.flatten(F.transform("paths", from_paths)), _empty()), on_base
    )
    bases = (
        F.when(spec.rlike(r"\A[./]"), relative)
        .when(F.startswith(spec, F.lit("#")), hashed)
        .otherwise(configured)
    )
    tried = F.flatten(
        F.transform(
            F.filter(bases, lambda b: b.isNotNull()),
            lambda b: F.transform(
                F.array(*[F.lit(s) for s in JS_SUFFIXES]), lambda s: F.concat(b, s)
            ),
        )
    )
    return _candidates(imports, "path", tried)


def go_candidates(raw: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports under the tree's module name: the package directory."""
    specs = raw.where(F.col("lang") == "go").withColumn("shown", F.col("spec"))
    imports = salted_join(specs, modules, TREE, ["src"], "left", grows=True)
    below = F.substring("spec", F.length("module") + 1, F.length("spec"))
    package = F.when(
        F.startswith("spec", F.col("module")), F.array(F.regexp_replace(below, r"\A/+", ""))
    )
    return _candidates(imports, "go", package)


def _crate_key(crate: Column, module: Column) -> Column:
    return F.concat(crate, F.lit(" "), module)


def rust_candidates(raw: DataFrame, modules: DataFrame) -> DataFrame:
    """``mod x;`` by path; ``use`` by module path, then by a guess below ``src/``.

    ``modules`` is ``rust_modules``.  A ``use`` is tried in full and without
    its last name, which may be an item and not a module.
    """
    imports = raw.where(F.col("lang") == "rs").withColumn("shown", F.col("spec"))
    beside = paths.join(paths.dirname(F.col("src")), F.col("spec"))
    mods = _candidates(
        imports.where(F.col("form") == "mod"),
        "path",
        F.array(F.concat(beside, F.lit(".rs")), F.concat(beside, F.lit("/mod.rs"))),
    )
    uses = imports.where(F.col("form") == "use").join(
        by_merge(modules.select(*TREE, F.col("path").alias("src"), "crate", "module")), [*TREE, "src"], "left"
    )
    here = F.when(F.col("module") == "", _empty()).otherwise(F.split("module", "::"))
    head = F.try_element_at("_seg", F.lit(1))
    leading = F.regexp_extract("spec", r"\A((?:super(?:::|\z))*)", 1)
    ups = F.size(F.filter(F.split(leading, "::"), lambda s: s == "super"))
    start = (
        F.when(head == "crate", _empty())
        .when(head == "self", F.col("_here"))
        .when(
            (head == "super") & (F.col("_ups") <= F.size("_here")),
            F.slice("_here", F.lit(1), F.size("_here") - F.col("_ups")),
        )
    )
    named = lambda c: F.filter(c, lambda s: ~s.isin("*", "self"))
    shorter = lambda c: F.slice(c, F.lit(1), F.greatest(F.lit(0), F.size(c) - 1))
    rest = named(F.slice("_seg", F.greatest(F.lit(1), F.col("_ups")) + 1, F.size("_seg")))
    full = (
        uses.withColumns(
            {"_seg": F.filter(F.split("spec", "::"), lambda s: s != ""), "_here": here, "_ups": ups}
        )
        .withColumn("_full", F.concat(start, rest))
    )
    modules_tried = F.transform(
        F.when(
            F.size("_full") > 0, F.array(F.col("_full"), shorter(F.col("_full")))
        ).when(F.size("_full") == 0, F.array(F.col("_full"))),
        lambda m: _crate_key(F.col("crate"), F.array_join(m, "::")),
    )
    in_tree = _candidates(full, "rs", modules_tried)
    plain = named(F.slice("_seg", F.lit(2), F.size("_seg")))
    guesses = F.flatten(
        F.transform(
            F.filter(F.array(plain, shorter(plain)), lambda p: F.size(p) > 0),
            lambda p: F.array(
                F.concat(F.lit("src/"), F.array_join(p, "/"), F.lit(".rs")),
                F.concat(F.lit("src/"), F.array_join(p, "/"), F.lit("/mod.rs")),
            ),
        )
    )
    below_src = _candidates(full.where(F.startswith("spec", F.lit("crate::"))), "path", guesses, 10)
    return mods.unionByName(in_tree).unionByName(below_src)


def ending_candidates(raw: DataFrame) -> DataFrame:
    """Java and Kotlin imports and PHP names: the first file whose path ends so."""
    imports = raw.where(
        (F.col("lang") == "jvm") | ((F.col("lang") == "php") & (F.col("form") == "use"))
    ).withColumn("shown", F.col("spec"))
    dotted = F.replace("spec", F.lit("."), F.lit("/"))
    keys = F.when(
        F.col("lang") == "jvm",
        F.array(F.concat(dotted, F.lit(".java")), F.concat(dotted, F.lit(".kt"))),
    ).otherwise(F.array(F.concat(F.replace("spec", F.lit("\\"), F.lit("/")), F.lit(".php"))))
    return _candidates(imports, "end", keys)


def beside_candidates(raw: DataFrame) -> DataFrame:
    """PHP and Ruby requires by relative path; a plain Ruby ``require`` has none."""
    imports = raw.where(
        (F.col("lang") == "rb") | ((F.col("lang") == "php") & (F.col("form") == "require"))
    ).withColumn("shown", F.col("spec"))
    target = paths.normpath(paths.join(paths.dirname(F.col("src")), F.col("spec")))
    ruby = F.when(F.endswith(target, F.lit(".rb")), target).otherwise(F.concat(target, F.lit(".rb")))
    keys = F.when(F.col("lang") == "php", F.array(target)).when(
        F.col("form") == "require_relative", F.array(ruby)
    )
    return _candidates(imports, "path", keys)


# ---------------------------------------------------------------- targets


def python_modules(files: DataFrame) -> DataFrame:
    """Module name to file; of two files with one name the smaller path wins."""
    return (
        _sources(files)
        .where(F.col("ext") == ".py")
        .groupBy(*TREE, paths.python_module(F.col("path")).alias("key"))
        .agg(F.min("path").alias("path"))
    )


def go_packages(files: DataFrame) -> DataFrame:
    """Every ``.go`` file under its directory and the directories above that."""
    here = paths.dirname(F.col("path"))
    above = F.filter(paths.ancestors(here), lambda d: d != "")
    return (
        _sources(files)
        .where(F.endswith("path", F.lit(".go")))
        .select(*TREE, "path", F.explode(F.concat(above, F.array(here))).alias("key"))
    )


def rust_modules(files: DataFrame, crates: DataFrame) -> DataFrame:
    """Each ``.rs`` file with its crate root and its module path in the crate."""
    sources = _sources(files).where(F.endswith("path", F.lit(".rs")))
    above = sources.select(*TREE, "path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    roots = salted_join(above, crates, [*TREE, "dir"], ["path"], "left", grows=True).groupBy(*TREE, "path")
    # "crate" is null for directories that are no crate root.
    found = roots.agg(F.max_by("dir", F.when(F.col("is_crate"), F.length("dir"))).alias("crate"))
    return found.withColumn("crate", F.coalesce("crate", F.lit(""))).withColumn(
        "module", paths.rust_module(F.col("path"), F.col("crate"))
    )


def rust_tree(modules: DataFrame) -> DataFrame:
    """Module to file: ``mod.rs`` wins over ``x.rs``; at the root ``lib.rs`` over ``main.rs``."""
    late_main = (F.col("module") == "") & F.endswith("path", F.lit("main.rs"))
    order = F.struct((~late_main).alias("a"), F.col("path").alias("b"))
    return (
        modules.where(F.col("module").isNotNull())
        .groupBy(*TREE, _crate_key(F.col("crate"), F.col("module")).alias("key"))
        .agg(F.max_by("path", order).alias("path"))
    )


def by_suffix(wanted: DataFrame, files: DataFrame, exts: list[str]) -> DataFrame:
    """The two smallest paths that end with each wanted ``suffix``.

    The text may begin inside a directory name, so the equi-join is on all its
    names but the first, and the first is compared at the end of the name
    before them.  A suffix of a single name is joined on name endings.
    """
    specs = wanted.select(*TREE, "suffix").distinct()
    parts = F.split("suffix", "/")
    tails = specs.where(F.contains("suffix", F.lit("/"))).select(
        *TREE,
        "suffix",
        parts[0].alias("_head"),
        F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("_tail"),
    )
    names = F.split("path", "/")
    n = F.size(names)
    listed = _sources(files).where(F.col("ext").isin(exts))
    ends = listed.where(F.contains("path", F.lit("/"))).select(
        *TREE,
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), n - 1),
                lambda i: F.struct(
                    F.array_join(F.slice(names, i + 1, n), "/").alias("tail"),
                    F.element_at(names, i).alias("before"),
                ),
            )
        ).alias("_e"),
    ).select(*TREE, "path", F.col("_e.tail").alias("_tail"), F.col("_e.before").alias("_before"))
    long = (
        skew_join(ends, tails, [*TREE, "_tail"], ["path"])
        .where(F.endswith("_before", F.col("_head")))
        .select(*TREE, "suffix", "path")
    )
    single = specs.where(~F.contains("suffix", F.lit("/")))
    endings = listed.select(
        *TREE,
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("name")),
                lambda i: F.substring(F.col("name"), i, F.length("name")),
            )
        ).alias("suffix"),
    )
    short = skew_join(endings, single, [*TREE, "suffix"], ["path"]).select(*TREE, "suffix", "path")
    two = first_n(long.unionByName(short), [*TREE, "suffix"], [F.col("path")], 2)
    return two.select(*TREE, F.col("suffix").alias("key"), "path")


# ---------------------------------------------------------------- all together


def resolve(
    raw: DataFrame,
    files: DataFrame,
    go_modules: DataFrame | None = None,
    ts_options: DataFrame | None = None,
    package_aliases: DataFrame | None = None,
    cargo_dirs: DataFrame | None = None,
    langs: tuple[str, ...] = ("py", "js", "go", "rs", "jvm", "php", "rb"),
) -> DataFrame:
    """Every import, resolved or external.

    Pass written frames for ``raw`` and ``files``: each is read for several
    kinds of candidates and keys.  Both lists are written out before the joins,
    whose rows are counted first: a Go package of n files that m files import
    makes n times m of them.
    """
    candidates, targets = [], {}
    by_path = _sources(files).select(*TREE, F.col("path").alias("key"), "path")
    if "py" in langs:
        candidates.append(python_candidates(raw))
        targets["py"] = python_modules(files)
    if "js" in langs:
        candidates.append(javascript_candidates(raw, ts_options, package_aliases))
        targets["path"] = by_path
    if "go" in langs:
        candidates.append(go_candidates(raw, go_modules))
        targets["go"] = go_packages(files)
    if "rs" in langs:
        modules = rust_modules(files, cargo_dirs.withColumn("is_crate", F.lit(True)))
        candidates.append(rust_candidates(raw, modules))
        targets["rs"], targets["path"] = rust_tree(modules), by_path
    if "jvm" in langs or "php" in langs:
        ending = ending_candidates(raw)
        candidates.append(ending)
        wanted = ending.select(*TREE, F.col("key").alias("suffix"))
        targets["end"] = by_suffix(wanted, files, [".java", ".kt", ".php"])
    if "php" in langs or "rb" in langs:
        candidates.append(beside_candidates(raw))
        targets["path"] = by_path
    wanted, known = None, None
    for part in candidates:
        wanted = part if wanted is None else wanted.unionByName(part)
    for space, part in targets.items():
        part = part.select(*TREE, F.lit(space).alias("space"), "key", "path")
        known = part if known is None else known.unionByName(part)
    # Written in small parts: what is read back packs well and is sorted in memory.
    with short_tasks(raw.sparkSession):
        wanted, known = cut(wanted, "wanted"), cut(known, "known")
    # These may name every file they match; the others take the best one.
    several = (F.col("space") == "go") | (F.col("form") == "mod")
    on = [*TREE, "space", "key"]
    many, _ = spread_join(wanted.where(several), known, on, ["src", "ord"], "left")
    many = many.select(*IMPORT, F.col("path").alias("dst"))
    single, tasks = spread_join(wanted.where(~several), known, on, ["src", "ord"], "left")
    # By module or ending, the importing file itself is passed over ...
    passed = F.col("space").isin("rs", "end") & (F.col("path") == F.col("src"))
    rank = F.when(F.col("path").isNotNull() & ~passed, F.struct("prio", "path"))
    ranked = single.select(*IMPORT, "prio", "path", rank.alias("_rank")).repartition(tasks, "repo", "src")
    best = ranked.groupBy(*IMPORT).agg(F.min_by("path", "_rank").alias("dst"))
    # ... elsewhere an import that finds its own file counts as not resolved.
    best = best.withColumn("dst", F.when(F.col("dst") != F.col("src"), F.col("dst")))
    return many.unionByName(best)


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``src -> dst``; ``decl_only`` if nothing but ``mod`` lines make it.

    Pass a written frame: its rows are counted first.
    """
    found = resolved.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return (
        by_size(found, ["repo", "src"], found, F.lit(1), 1 << 20)
        .groupBy(*TREE, "src", "dst")
        .agg(F.bool_and(F.col("form") == "mod").alias("decl_only"))
    )


def externals(resolved: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct unresolved names of each file, in order; the first ``n`` of them if that is given.

    Counts have to come from all of them.  Pass a written frame: its rows are
    counted first.
    """
    unknown = resolved.where(F.col("dst").isNull() & (F.col("form") != "mod") & (F.col("shown") != ""))
    outside = (
        by_size(unknown, ["repo", "src"], unknown, F.lit(1), 1 << 18)
        .groupBy(*TREE, "src", F.col("shown").alias("spec"))
        .agg(F.min("ord").alias("ord"))
    )
    if n is None:
        return outside.withColumn("rank", F.row_number().over(W.partitionBy(*TREE, "src").orderBy("ord")))
    return first_n(outside, [*TREE, "src"], [F.col("ord")], n)
