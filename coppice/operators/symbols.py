"""Symbol outlines: classes, functions and types found in source bodies.

Python is read by indentation (``operators.pysource``).  The other
languages are read line by line with the patterns below, after comments and
the insides of strings were masked (``functions.lexis``); the ``method`` column
says which way a row was found (``indent``, ``regex`` for the four languages the
line patterns were made for, ``pattern`` where they stand in for a parser).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions import labels, lexis, paths
from coppice.operators import pysource
from coppice.operators.skew import first_n
from coppice.schema import ENTRY, TREE

JS_EXTS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
HTML_EXTS = [".html", ".htm"]


class Line(NamedTuple):
    """A line pattern: its group 1 is the name; lines matching ``but_not`` are skipped."""

    exts: list[str]
    kind: str
    regex: str
    method: str = "regex"
    but_not: str | None = None


_JAVA_MODS = r"(?:(?:public|protected|private|static|final|abstract|sealed|default|synchronized|native|strictfp)\s+)*"
_CS_MODS = r"(?:(?:public|protected|private|internal|static|sealed|abstract|virtual|override|async|partial|readonly|unsafe|new)\s+)*"
_KT_MODS = r"(?:(?:public|private|internal|protected|open|abstract|sealed|data|inline|override|suspend|operator|infix|enum|annotation|inner|value|tailrec)\s+)*"
_SWIFT_MODS = r"(?:(?:public|private|fileprivate|internal|open|final|static|class|override|mutating|indirect|required)\s+)*"
_PHP_MODS = r"(?:(?:public|protected|private|static|final|abstract|readonly)\s+)*"
_NOT_A_CALL = r"^\s*(?:return|new|else|throw|if|for|while|switch|catch|case|do|await|yield|using|lock)\b"

# The line patterns, in the order in which they are tried.
LINES = [
    Line([".py"], "class", r"^\s*class\s+(\w+)"),
    Line([".py"], "def", r"^\s*(?:async\s+)?def\s+(\w+)\s*\("),
    Line(JS_EXTS, "class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"),
    Line(
        JS_EXTS,
        "func",
        r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)\s*\(",
    ),
    Line(
        JS_EXTS,
        "func",
        r"^\s*export\s+(?:default\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(\s*\S",
    ),
    Line(JS_EXTS, "func", r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(.*\)\s*=>"),
    Line(
        JS_EXTS,
        "func",
        r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\b|\w+\s*=>)",
    ),
    Line([".go"], "func", r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\("),
    Line([".go"], "struct", r"^type\s+(\w+)\s+struct"),
    Line([".go"], "interface", r"^type\s+(\w+)\s+interface"),
    Line([".rs"], "fn", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    Line([".rs"], "struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
    Line([".rs"], "enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
    Line([".rs"], "trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"),
    Line(
        [".c", ".h"],
        "func",
        r"^[A-Za-z_][\w\s*]*[\s*](\w+)\s*\([^;]*$",
        "pattern",
        r"^\s*(?:return|else|typedef|if|for|while|switch|do)\b",
    ),
    Line([".c", ".h"], "struct", r"^struct\s+(\w+)\s*\{?\s*$", "pattern"),
    Line([".java"], "class", rf"^\s*{_JAVA_MODS}class\s+(\w+)", "pattern"),
    Line([".java"], "interface", rf"^\s*{_JAVA_MODS}interface\s+(\w+)", "pattern"),
    Line([".java"], "enum", rf"^\s*{_JAVA_MODS}enum\s+(\w+)", "pattern"),
    Line([".java"], "record", rf"^\s*{_JAVA_MODS}record\s+(\w+)\s*\(", "pattern"),
    Line(
        [".java"],
        "method",
        rf"^\s+{_JAVA_MODS}(?:<[^>]+>\s+)?(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\([^;=]*\)[^;=]*\{{\s*",
        "pattern",
        _NOT_A_CALL,
    ),
    Line([".rb"], "class", r"^\s*class\s+(?:\w+::)*([A-Z]\w*)", "pattern"),
    Line([".rb"], "module", r"^\s*module\s+(?:\w+::)*([A-Z]\w*)", "pattern"),
    Line([".rb"], "def", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)", "pattern"),
    Line([".php"], "class", rf"^\s*{_PHP_MODS}class\s+(\w+)", "pattern"),
    Line([".php"], "interface", r"^\s*interface\s+(\w+)", "pattern"),
    Line([".php"], "trait", r"^\s*trait\s+(\w+)", "pattern"),
    Line([".php"], "enum", r"^\s*enum\s+(\w+)", "pattern"),
    Line([".php"], "func", r"^function\s+&?\s*(\w+)\s*\(", "pattern"),
    Line([".php"], "method", rf"^\s+{_PHP_MODS}function\s+&?\s*(\w+)\s*\(", "pattern"),
    Line([".cs"], "class", rf"^\s*{_CS_MODS}class\s+(\w+)", "pattern"),
    Line([".cs"], "interface", rf"^\s*{_CS_MODS}interface\s+(\w+)", "pattern"),
    Line([".cs"], "struct", rf"^\s*{_CS_MODS}struct\s+(\w+)", "pattern"),
    Line([".cs"], "enum", rf"^\s*{_CS_MODS}enum\s+(\w+)", "pattern"),
    Line([".cs"], "record", rf"^\s*{_CS_MODS}record\s+(\w+)", "pattern"),
    Line(
        [".cs"],
        "method",
        rf"^\s+{_CS_MODS}[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>]+>)?\([^;]*\)\s*(?:\{{.*|=>.*)?$",
        "pattern",
        _NOT_A_CALL,
    ),
    Line([".kt", ".kts"], "class", rf"^\s*{_KT_MODS}(?:class|interface)\s+(\w+)", "pattern"),
    Line([".kt", ".kts"], "object", rf"^\s*{_KT_MODS}object\s+(\w+)", "pattern"),
    Line([".kt", ".kts"], "fun", rf"^\s*{_KT_MODS}fun\s+(?:<[^>]+>\s+)?(?:[\w.<>?]+\.)?(\w+)\s*\(", "pattern"),
    Line([".swift"], "type", rf"^\s*{_SWIFT_MODS}(?:class|struct|enum|actor|extension)\s+([A-Z]\w*)", "pattern"),
    Line([".swift"], "protocol", rf"^\s*{_SWIFT_MODS}protocol\s+(\w+)", "pattern"),
    Line([".swift"], "func", rf"^\s*{_SWIFT_MODS}func\s+(\w+)", "pattern"),
]

LINE_EXTS = sorted({e for line in LINES for e in line.exts})
#: Languages read in the pass that also finds spans by braces; Ruby has none.
BRACE_EXTS = sorted(set(LINE_EXTS) - {".py"})


def line_symbol(ext: Column, line: Column) -> Column:
    """Struct ``kind, name, method`` of the first pattern that hits, or null."""
    found = None
    for p in LINES:
        regex = "(?U)" + p.regex
        hit = ext.isin(p.exts) & line.rlike(regex)
        if p.but_not:
            hit = hit & ~line.rlike(p.but_not)
        value = F.struct(
            F.lit(p.kind).alias("kind"),
            F.regexp_extract(line, regex, 1).alias("name"),
            F.lit(p.method).alias("method"),
        )
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found


def is_public(ext: Column, line: Column, name: Column) -> Column:
    """Visibility from the declaring line; open where the language has no sign for it."""
    word = lambda w: line.rlike(rf"(?U)\b{w}\b")
    return (
        F.when(ext.isin(".py", ".rb"), ~F.startswith(name, F.lit("_")))
        .when(ext.isin(JS_EXTS), word("export"))
        .when(ext == ".go", name.rlike(r"(?U)^\p{Lu}"))
        .when(ext == ".rs", word("pub"))
        .when(ext.isin(".java", ".cs"), word("public"))
        .when(ext == ".php", ~F.contains(line, F.lit("private")) & ~F.contains(line, F.lit("protected")))
        .when(ext.isin(".kt", ".kts"), ~F.contains(line, F.lit("private")) & ~F.contains(line, F.lit("internal")))
        .when(ext == ".swift", ~F.contains(line, F.lit("private")))
        .otherwise(True)
    )


def with_ext(contents: DataFrame, exts: list[str]) -> DataFrame:
    """Bodies of some extensions.

    A body table partitioned by a column ``ext`` is read only in part.
    """
    kept = contents if "ext" in contents.columns else contents.withColumn(
        "ext", paths.ext(paths.basename(F.col("path")))
    )
    return kept.where(F.col("ext").isin(exts))


def _lines(contents: DataFrame, exts: list[str], max_lines: int | None = None) -> DataFrame:
    """Lines of bodies with comments and strings masked; a multi-line string hides what it reaches into."""
    code = lexis.code(F.col("ext"), F.col("text"), exts)
    if ".py" in exts:
        code = F.when(F.col("ext") == ".py", pysource.masked(F.col("text"))).otherwise(code)
    lines = F.split(code, "\n")
    if max_lines is not None:
        lines = F.slice(lines, 1, max_lines)
    found = with_ext(contents, exts).select(*ENTRY, "ext", F.posexplode(lines).alias("_n", "_line"))
    # Comments leave many empty lines, which hold neither symbols nor braces: no pattern is tried on them.
    return found.where(F.col("_line") != "")


def _once(*columns: Column) -> Column:
    """The columns as fields of ``_r``, worked out once.

    Spark moves filters on computed columns below their projection and works
    them out there again; it does not do so with what a generator returns.
    """
    return F.explode_outer(F.array(F.struct(*columns))).alias("_r")


def line_symbols(
    contents: DataFrame, exts: list[str] | None = None, max_lines: int | None = None
) -> DataFrame:
    """Symbols by line pattern, for any supported extension.

    Whole bodies are read; ``max_lines`` stops after that many lines of each.
    """
    exts = LINE_EXTS if exts is None else exts
    lines = _lines(contents, exts, max_lines)
    found = lines.select(
        *ENTRY, "ext", (F.col("_n") + 1).alias("line_start"), "_line",
        _once(line_symbol(F.col("ext"), F.col("_line")).alias("_s")),
    ).where(F.col("_r._s").isNotNull()).withColumn("_s", F.col("_r._s"))
    return found.select(
        *ENTRY,
        "line_start",
        "_s.kind",
        "_s.name",
        is_public(F.col("ext"), F.col("_line"), F.col("_s.name")).alias("public"),
        "_s.method",
    )


# The type attributes of a script that is JavaScript.
SCRIPT_TYPES = [
    "",
    "text/javascript",
    "application/javascript",
    "text/ecmascript",
    "application/ecmascript",
    "module",
]


def _running(between: str, inside: str) -> Column:
    """Lines before each block, from the lines between and inside them, in one pass."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, i: Column) -> Column:
        here = s["n"] + F.get(between, i)
        return F.struct((here + F.get(inside, i)).alias("n"), F.concat(s["at"], F.array(here)).alias("at"))

    places = F.filter(F.sequence(F.lit(0), F.size(inside)), lambda i: i < F.size(inside))
    return F.aggregate(places, start, step)["at"]


def inline_scripts(contents: DataFrame) -> DataFrame:
    """Inline JavaScript blocks of HTML bodies with the lines before each.

    Blocks with a ``src``, of another type, or closing themselves are left out.
    """
    block = r"(?is)<script[^>]*>.*?</script"
    found = F.regexp_extract_all("text", F.lit(f"({block})"), 1)
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = (
        with_ext(contents, HTML_EXTS)
        .where(F.col("text").rlike("(?i)<script"))
        .select(*ENTRY, found.alias("_m"), F.split("text", block).alias("_p"))
        .select(*ENTRY, "_m", F.transform("_m", breaks).alias("_in"), F.transform("_p", breaks).alias("_between"))
        .select(*ENTRY, "_m", _running("_between", "_in").alias("_before"))
        .select(*ENTRY, F.posexplode_outer(F.arrays_zip("_m", "_before")).alias("block", "_z"))
        .where(F.col("block").isNotNull())
        .select(*ENTRY, "block", F.col("_z._m").alias("_b"), F.col("_z._before").alias("_before"))
    )
    tag = F.regexp_extract("_b", r"(?is)\A<script([^>]*)>", 1)
    attrs = F.lower("_attrs")
    kind = F.regexp_extract(attrs, r"""\btype\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    opening = F.regexp_extract("_b", r"(?is)\A(<script[^>]*>)", 1)
    return (
        rows.withColumn("_attrs", tag)
        .where(
            ~F.endswith(F.rtrim("_attrs"), F.lit("/"))
            & ~attrs.rlike(r"\bsrc\s*=")
            & kind.isin(SCRIPT_TYPES)
        )
        .select(
            *ENTRY,
            "block",
            (F.col("_before") + breaks(opening)).alias("lines_before"),
            F.regexp_extract("_b", r"(?is)\A<script[^>]*>(.*)</script\z", 1).alias("text"),
        )
    )


def html_symbols(contents: DataFrame) -> DataFrame:
    """JavaScript symbols of inline scripts, with line numbers and spans of the HTML file.

    Each block is read as a file of its own; its number and the lines before it
    travel behind the path.
    """
    mark = F.lit("\x00")
    blocks = inline_scripts(contents).select(
        *TREE,
        F.concat("path", mark, F.col("block").cast("string"), mark, F.col("lines_before").cast("string")).alias("path"),
        "text",
        F.lit(".js").alias("ext"),
    )
    before = F.substring_index("path", "\x00", -1).cast("int")
    found = brace_symbols(blocks, [".js"])
    return found.select(
        *TREE,
        F.substring_index("path", "\x00", 1).alias("path"),
        (F.col("line_start") + before).alias("line_start"),
        (F.col("line_end") + before).alias("line_end"),
        "kind",
        "name",
        "public",
        "method",
        "span_method",
    )


def brace_symbols(contents: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Symbols of brace languages with line spans and, for Rust, parents.

    A span ends on the first line that is back at the depth the declaration
    started from.  Only lines with a brace or a symbol leave the scan.  Braces
    in strings, comments and other literals do not count; ``span_method`` is
    ``brace``.
    """
    exts = BRACE_EXTS if exts is None else exts
    lines = _lines(contents, exts)
    count = lambda c: F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(c), F.lit("")))
    owner = F.coalesce(
        F.nullif(
            F.regexp_extract(
                "_line", r"(?U)^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[^{]*\s+for\s+)?(?:\w+::)*(\w+)", 1
            ),
            F.lit(""),
        ),
        F.nullif(F.regexp_extract("_line", r"(?U)^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", 1), F.lit("")),
    )
    indent = F.length("_line") - F.length(F.ltrim("_line"))
    read = _once(
        line_symbol(F.col("ext"), F.col("_line")).alias("_s"),
        is_public(F.col("ext"), F.col("_line"), F.lit("")).alias("_public"),
        count("{").alias("_open"),
        count("}").alias("_close"),
        F.when(F.col("ext") == ".rs", owner).alias("_owner"),
        F.when(F.col("ext") == ".rs", indent).alias("_indent"),
        F.col("_line").rlike(r";\s*$").alias("_ends"),
    )
    rows = lines.select(*ENTRY, "ext", (F.col("_n") + 1).alias("line"), read).select(*ENTRY, "ext", "line", "_r.*").where(
        F.col("_s").isNotNull()
        | (F.col("_open") + F.col("_close") > 0)
        | F.col("_owner").isNotNull()
    )
    down = W.partitionBy(*ENTRY).orderBy("line")
    up = W.partitionBy(*ENTRY).orderBy(F.col("line").desc())
    after = F.sum(F.col("_open") - F.col("_close")).over(down)
    nearest_owner = F.last(
        F.when(F.col("_owner").isNotNull(), F.struct("_owner", "_indent")), ignorenulls=True
    ).over(down.rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumns(
        {
            "_after": after,
            "_impl": nearest_owner,
            "_body": F.last(F.when(F.col("_open") > 0, F.col("line")), ignorenulls=True).over(
                up.rowsBetween(W.unboundedPreceding, 0)
            ),
        }
    ).withColumn("_before", F.col("_after") - F.col("_open") + F.col("_close"))
    symbols = placed.where(F.col("_s").isNotNull())
    bare = F.col("_ends") & (F.col("_open") == 0)
    wanted = symbols.select(
        *ENTRY,
        F.col("_before").alias("_level"),
        F.coalesce("_body", "line").alias("_at"),
        F.lit(1).alias("_is_symbol"),
        F.struct("line", "ext", "_s", "_public", "_impl", "_indent", bare.alias("_bare")).alias("_d"),
    )
    closings = placed.where(F.col("_close") > 0).select(
        *ENTRY,
        F.explode(
            F.sequence("_after", F.greatest(F.col("_after"), F.col("_before") - 1))
        ).alias("_level"),
        F.col("line").alias("_at"),
        F.lit(0).alias("_is_symbol"),
        F.lit(None).cast(wanted.schema["_d"].dataType).alias("_d"),
    )
    back = (
        W.partitionBy(*ENTRY, "_level")
        .orderBy(F.col("_at").desc(), "_is_symbol")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    ended = (
        wanted.unionByName(closings)
        .withColumn("_end", F.last(F.when(F.col("_is_symbol") == 0, F.col("_at")), ignorenulls=True).over(back))
        .where(F.col("_is_symbol") == 1)
    )
    start = F.col("_d.line")
    end = F.when(F.col("_d._bare"), start).when(F.col("_d.ext") != ".rb", F.col("_end"))
    parent = F.when(
        (F.col("_d._s.kind") == "fn") & (F.col("_d._indent") > F.col("_d._impl._indent")),
        F.col("_d._impl._owner"),
    )
    name = F.col("_d._s.name")
    public = (
        F.when(F.col("_d.ext") == ".go", name.rlike(r"(?U)^\p{Lu}"))
        .when(F.col("_d.ext") == ".rb", ~F.startswith(name, F.lit("_")))
        .otherwise(F.col("_d._public"))
    )
    return ended.select(
        *ENTRY,
        start.alias("line_start"),
        end.alias("line_end"),
        F.col("_d._s.kind").alias("kind"),
        F.col("_d._s.name").alias("name"),
        public.alias("public"),
        parent.alias("parent"),
        F.col("_d._s.method").alias("method"),
        F.when(end.isNotNull(), "brace").alias("span_method"),
    )


SYMBOL_COLUMNS = [
    *ENTRY,
    "line_start",
    "line_end",
    "kind",
    "name",
    "public",
    "doc",
    "parent",
    "method",
    "span_method",
]


def _full(df: DataFrame) -> DataFrame:
    types = {"line_end": "int", "doc": "string", "parent": "string", "span_method": "string"}
    have = set(df.columns)
    return df.select(
        *[
            F.col(c) if c in have else F.lit(None).cast(types[c]).alias(c)
            for c in SYMBOL_COLUMNS
        ]
    )


def symbols(
    contents: DataFrame, public_only: bool = False
) -> DataFrame:
    """Symbols of every supported file, each row with the method that found it."""
    out = (
        _full(pysource.symbols(contents))
        .unionByName(_full(brace_symbols(contents)))
        .unionByName(_full(html_symbols(contents)))
    )
    return public(out) if public_only else out


def public(symbols_: DataFrame) -> DataFrame:
    """Public symbols only."""
    return symbols_.where(F.col("public"))


def qualified(symbols_: DataFrame) -> DataFrame:
    """Adds ``label``: kind and qualified name."""
    return symbols_.withColumn(
        "label",
        F.concat_ws(" ", "kind", labels.qualified_name(F.col("kind"), F.col("name"), F.col("parent"))),
    )


def outlines(symbols_: DataFrame, limit: int = 5) -> DataFrame:
    """One line per file: its first symbols and how many more there are.

    Only the first ``limit`` rows of a file are gathered; the rest is a count.
    """
    labelled = qualified(symbols_)
    order = [F.col("line_start"), F.col("label")]
    total = labelled.groupBy(*ENTRY).agg(F.count("*").alias("symbols"))
    first = first_n(labelled, ENTRY, order, limit, "_rank")
    text = first.groupBy(*ENTRY).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rank", "label"))), lambda s: s["label"]
            ),
            ", ",
        ).alias("_text")
    )
    more = F.col("symbols") - limit
    return total.join(text, ENTRY).select(
        *ENTRY,
        "symbols",
        F.when(more > 0, F.concat("_text", F.lit(", +"), more.cast("string")))
        .otherwise(F.col("_text"))
        .alias("outline"),
    )


def long_functions(
    symbols_: DataFrame, n: int | None = 5, at_least: int = 50
) -> DataFrame:
    """Longest functions of each tree: lines, then ``path:name`` for ties."""
    named = symbols_.where(
        ~F.col("kind").isin("class", "struct") & (F.col("line_end") > F.col("line_start"))
    ).select(
        *TREE,
        (F.col("line_end") - F.col("line_start") + 1).alias("lines"),
        F.concat(
            "path",
            F.lit(":"),
            labels.qualified_name(F.col("kind"), F.col("name"), F.col("parent")),
        ).alias("symbol"),
        "line_start",
    )
    long = named.where(F.col("lines") >= at_least)
    if n is None:
        return long
    return first_n(
        long, TREE, [F.col("lines").desc(), F.col("symbol"), F.col("line_start")], n
    ).drop("line_start")
