"""Unresolved imports of each file: one wide table for all languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions import lexis
from coppice.operators import pysource
from coppice.operators.symbols import JS_EXTS, with_ext
from coppice.schema import ENTRY, TREE

# Import statements and calls, per language.  Group 1 is the target.
JS_STATEMENT = (
    r"""(?m)(?:^|;)\s*(?:import\s+(?:[\w*\s{},$]+\s+from\s+)?|export\s+[\w*\s{},$]+\s+from\s+)['"]([^'"]+)['"]"""
)
JS_REQUIRE = r"""require\(\s*['"]([^'"]+)['"]\s*\)"""
JS_DYNAMIC = r"""import\(\s*['"]([^'"]+)['"]\s*\)"""
GO_BLOCK = r"(?s)import\s*\(([^)]*)\)"
GO_LINE = r'import\s+"([^"]+)"'
GO_ITEM = r'"([^"]+)"'
RUST_USE = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"
RUST_MOD = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"
JVM_IMPORT = r"(?m)^\s*import\s+([\w.]+)"
PHP_USE = r"(?m)^\s*use\s+([\w\\]+)"
PHP_REQUIRE = r"""(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]"""
RUBY_REQUIRE = r"""(?m)^\s*(require(?:_relative)?\s+['"][^'"]+)['"]"""

COLUMNS = [*TREE, "src", "lang", "form", "spec", "level", "names", "ord"]


def _all(pattern: str) -> Column:
    return F.regexp_extract_all("_code", F.lit("(?U)" + pattern), 1)


def _as(form: str, specs: Column) -> Column:
    return F.transform(specs, lambda s: F.struct(F.lit(form).alias("form"), s.alias("spec")))


def _javascript() -> Column:
    """import / export-from in order, then ``require``, then dynamic import."""
    return _as("import", F.concat(_all(JS_STATEMENT), _all(JS_REQUIRE), _all(JS_DYNAMIC)))


def _go() -> Column:
    """The first import block, then single-line imports."""
    block = F.regexp_extract("_code", "(?U)" + GO_BLOCK, 1)
    return _as("import", F.concat(F.regexp_extract_all(block, F.lit(GO_ITEM), 1), _all(GO_LINE)))


def _no_alias(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(?s)\s+as\s+.*", ""), r"\s+", "")


def _rust() -> Column:
    """``mod x;`` declarations, then ``use`` paths with groups, also nested ones, written out."""
    state = "struct<heads:array<string>,word:string,paths:array<string>>"

    def made(heads: Column, word: Column, paths: Column) -> Column:
        return F.struct(heads.alias("heads"), word.alias("word"), paths.alias("paths")).cast(state)

    def step(s: Column, mark: Column) -> Column:
        """``heads`` are what stands before the open groups, ``word`` what stands before the next mark."""
        head = F.element_at(s["heads"], -1)
        written = F.concat(s["paths"], F.array(F.concat(head, _no_alias(s["word"]))))
        paths = F.when(s["word"] != "", written).otherwise(s["paths"])
        opened = F.concat(s["heads"], F.array(F.concat(head, F.regexp_replace(s["word"], r"\s+", ""))))
        closed = F.slice(s["heads"], F.lit(1), F.greatest(F.size(s["heads"]) - 1, F.lit(1)))
        return (
            F.when(mark == "{", made(opened, F.lit(""), s["paths"]))
            .when(mark == "}", made(closed, F.lit(""), paths))
            .when(mark == ",", made(s["heads"], F.lit(""), paths))
            .otherwise(made(s["heads"], F.regexp_replace(mark, r"^\s+|\s+$", ""), s["paths"]))
        )

    def spread(use: Column) -> Column:
        marks = F.regexp_extract_all(F.concat(use, F.lit(",")), F.lit("[{},]|[^{},]+"), 0)
        start = made(F.array(F.lit("")), F.lit(""), F.array())
        return F.aggregate(marks, start, step)["paths"]

    uses = F.flatten(F.transform(_all(RUST_USE), spread))
    return F.concat(_as("mod", _all(RUST_MOD)), _as("use", uses))


def _jvm() -> Column:
    return _as("import", _all(JVM_IMPORT))


def _php() -> Column:
    """``use`` names, then ``require``/``include`` files."""
    return F.concat(_as("use", _all(PHP_USE)), _as("require", _all(PHP_REQUIRE)))


def _ruby() -> Column:
    """``require_relative`` and ``require``."""
    return F.transform(
        _all(RUBY_REQUIRE),
        lambda s: F.struct(
            F.regexp_extract(s, r"\A(\w+)", 1).alias("form"),
            F.regexp_extract(s, r"""['"](.*)\z""", 1).alias("spec"),
        ),
    )


LANGUAGES = {
    "js": (JS_EXTS, _javascript),
    "go": ([".go"], _go),
    "rs": ([".rs"], _rust),
    "jvm": ([".java", ".kt", ".kts"], _jvm),
    "php": ([".php"], _php),
    "rb": ([".rb"], _ruby),
}


def by_pattern(contents: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """Imports found by pattern, for all languages in one reading of the bodies.

    Comments and strings of several lines hold none.
    """
    langs = list(LANGUAGES) if langs is None else langs
    wanted = [e for name in langs for e in LANGUAGES[name][0]]
    code = lexis.statements(F.col("ext"), F.col("text"), wanted)
    kept = with_ext(contents, wanted).select(*ENTRY, "ext", code.alias("_code"))
    found, lang = None, None
    for name in langs:
        exts, expression = LANGUAGES[name]
        here = F.col("ext").isin(exts)
        found = F.when(here, expression()) if found is None else found.when(here, expression())
        lang = F.when(here, name) if lang is None else lang.when(here, name)
    return kept.select(*ENTRY, lang.alias("lang"), F.posexplode(found).alias("ord", "_i")).select(
        *TREE,
        F.col("path").alias("src"),
        "lang",
        "_i.form",
        "_i.spec",
        F.lit(0).alias("level"),
        F.lit(None).cast("array<string>").alias("names"),
        "ord",
    )


def python(contents: DataFrame) -> DataFrame:
    """Python imports by logical line."""
    return (
        pysource.line_imports(contents)
        .withColumn("lang", F.lit("py"))
        .withColumnRenamed("path", "src")
        .select(*COLUMNS)
    )


def raw_imports(contents: DataFrame) -> DataFrame:
    """Unresolved imports of every supported file: one pass for Python, one for the rest."""
    return python(contents).unionByName(by_pattern(contents).select(*COLUMNS))


def inline_tested(contents: DataFrame) -> DataFrame:
    """Rust files that carry tests of their own."""
    return contents.where(
        F.endswith("path", F.lit(".rs"))
        & (F.contains("text", F.lit("#[cfg(test)]")) | F.contains("text", F.lit("#[test]")))
    ).select(*ENTRY)
