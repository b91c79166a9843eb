"""Symbols and imports of Python files, by lines and their indentation.

Strings of all kinds and comments are masked first, together and from left to
right, as each may hold marks of the others.  A line that goes on from the one
before (inside brackets or a string, or behind a backslash) neither declares
nor ends anything.  A body ends before the next line that is indented no deeper
than its header.

Files that Python itself would not accept are read in the same way.  A string
that is not closed ends with its line.  A bracket that is not closed counts up
to the next line that no expression can hold: one that starts with ``def``,
``class``, an import, or, at the margin, a decorator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from coppice.functions import lexis, paths
from coppice.functions.lexis import INSIDE
from coppice.operators.skew import by_size
from coppice.schema import ENTRY

# Possessive loops, as Java's regular expressions recurse in others.
#: What an f-string puts in, with strings and one more pair of braces in it.
_FIELD = r"\{(?:[^{}'\"\n]++|\"[^\"\n]*+\"|'[^'\n]*+'|\{[^{}\n]*+\})*+\}"
_PUT_IN = rf"(?<!\w)(?:[fF][rR]?|[rR][fF])%s(?!%s%s)(?:[^%s\\\n{{]++|\\.|\{{\{{|{_FIELD}|\{{)*+(?:%s|(?=\n)|\z)"
STRING = (
    r"(?s)(?=[\"'#fFrR])(?:\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''"
    rf"|{_PUT_IN.replace('%s', chr(34))}|{_PUT_IN.replace('%s', chr(39))}"
    r"|\"(?:[^\"\\\n]++|\\.)*+(?:\"|(?=\n)|\z)|'(?:[^'\\\n]++|\\.)*+(?:'|(?=\n)|\z)|#[^\n]*+)"
)
HEADER = r"^\s*(?:async\s+)?(def|class)\s+(\w+)"
#: Lines without anything, but for the one behind a backslash.
EMPTY_LINES = r"(?<!\\\r{0,2})\n(?:[ \t\r]*+\n)++"
#: Starts a line that cannot lie in brackets.
RESUMES = r"^\s*(?:(?:async\s+)?(?:def|class)\s+\w|import\s+\w|from\b[\s.\w]*\bimport\b)|^@\w+(?:\.\w+)*\s*(?:\(.*)?$"


def masked(text: Column) -> Column:
    """The text with comments and the insides of strings taken out, line for line."""
    return lexis.masked(text, STRING, lambda token: lexis.emptied(token, F.startswith(token, F.lit("#"))))


def _python(contents: DataFrame) -> DataFrame:
    return contents.where(paths.ext(paths.basename(F.col("path"))) == ".py")


def _lines(contents: DataFrame, wanted: str, code: Column | None = None) -> DataFrame:
    """Lines of Python files in which ``wanted`` is found: number, masked ``code``, and as written."""
    kept = _python(contents).where(F.col("text").rlike(wanted))
    code = masked(F.col("text")) if code is None else code
    lines = kept.select(*ENTRY, F.split(code, "\n").alias("_masked"), F.split("text", "\n").alias("_written")).select(
        *ENTRY, F.posexplode_outer(F.arrays_zip("_masked", "_written")).alias("line", "_l")
    )
    return lines.select(*ENTRY, "line", F.col("_l._masked").alias("code"), F.col("_l._written").alias("written"))


def _with_starts(lines: DataFrame) -> DataFrame:
    """Adds ``starts``: a statement begins with the line.

    The open depth is a running sum that never falls below zero, so it is the
    sum less its own running minimum.  It is counted anew from every line that
    cannot lie in brackets.  Windows are per file.
    """
    count = lambda marks: F.length("code") - F.length(F.translate("code", marks, ""))
    by_line = W.partitionBy(*ENTRY).orderBy("line")
    in_part = W.partitionBy(*ENTRY, "_part").orderBy("line")
    resumes = F.col("code").rlike(RESUMES)
    goes_on = F.coalesce(F.lag(F.col("code").rlike(r"\\\r?$")).over(by_line), F.lit(False))
    parts = lines.withColumns({"_part": F.sum(resumes.cast("int")).over(by_line), "_goes_on": goes_on})
    summed = parts.withColumn("_sum", F.sum(count("([{") - count(")]}")).over(in_part))
    deep = summed.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(in_part)))
    before = F.coalesce(F.lag("_depth").over(in_part), F.lit(0))
    starts = resumes | ((before == 0) & ~F.col("_goes_on"))
    return deep.withColumn("starts", starts).drop("_sum", "_depth", "_part", "_goes_on")


def _doc(line: Column) -> Column:
    """First line of the string that a line starts with."""
    inside = F.regexp_extract(line, r"^\s*[rRuU]{0,2}(?:\"\"\"|'''|\"|')(.*)$", 1)
    return F.nullif(paths.strip(F.regexp_replace(inside, r"(\"\"\"|'''|\"|')\s*$", "")), F.lit(""))


def symbols(contents: DataFrame) -> DataFrame:
    """Classes and functions with their span, first line of the docstring, parent and whether they are public.

    A symbol is public if its name has no leading underscore and it stands in
    the module or in a public class.
    """
    lines = _lines(contents, r"(?m)^\s*(async\s+)?(def|class)\s")
    lines = lines.where(F.trim(F.translate("code", "\t\r", "  ")) != "")
    lines = _with_starts(by_size(lines, ["repo", "path"], _python(contents), F.octet_length("text")))
    goes_on = F.startswith("code", F.lit(INSIDE)) | ~F.col("starts")
    indent = F.length("code") - F.length(F.regexp_replace("code", r"^[ \t]+", ""))
    by_line = W.partitionBy(*ENTRY).orderBy("line")
    placed = lines.withColumns(
        {
            "indent": F.when(~goes_on, indent),
            "before": F.lag("line").over(by_line),
            "last": F.max("line").over(W.partitionBy(*ENTRY)),
        }
    )
    statements = placed.where(F.col("indent").isNotNull()).withColumns(
        {
            "outer": F.lag("indent").over(by_line),
            "next_indent": F.lead("indent").over(by_line),
            "next_line": F.lead("written").over(by_line),
        }
    )
    name = F.regexp_extract("code", HEADER, 2)
    doc = F.when(F.col("next_indent") > F.col("indent"), _doc(F.col("next_line")))
    headers = statements.where(F.col("code").rlike(HEADER)).select(
        *ENTRY,
        F.col("indent").alias("level"),
        F.col("line").alias("at"),
        F.lit(None).cast("int").alias("end"),
        F.struct("line", "last", "indent", F.regexp_extract("code", HEADER, 1).alias("kind"), name.alias("name"), doc.alias("doc")).alias("s"),
    )
    # A line ends the bodies of its own depth and of all depths down to that of the line before it.
    closings = statements.where("indent <= outer").select(
        *ENTRY,
        F.explode(F.sequence("indent", "outer")).alias("level"),
        F.col("line").alias("at"),
        F.col("before").alias("end"),
        F.lit(None).cast(headers.schema["s"].dataType).alias("s"),
    )
    # Of a header that ends an earlier body, the ending comes first.
    later = W.partitionBy(*ENTRY, "level").orderBy("at", F.col("s").isNotNull()).rowsBetween(1, W.unboundedFollowing)
    ended = headers.unionByName(closings).withColumn("_end", F.first("end", ignorenulls=True).over(later)).where(F.col("s").isNotNull())
    spans = F.sort_array(
        F.collect_list(
            F.struct("s.line", F.coalesce("_end", "s.last").alias("end"), "s.indent", "s.kind", "s.name", "s.doc")
        )
    )
    files = ended.groupBy(*ENTRY).agg(spans.alias("found"))
    open_ = "array<struct<end:int,indent:int,name:string,inner:string>>"
    state = f"struct<open:{open_},rows:array<struct<parent:string,public:boolean>>>"

    def step(held: Column, s: Column) -> Column:
        """``open`` are the symbols around the line, outermost first."""
        around = F.filter(held["open"], lambda o: (o["end"] >= s["line"]) & (o["indent"] < s["indent"]))
        top = F.get(around, F.size(around) - 1)
        public = (top["inner"].isNull() | (top["inner"] == "open")) & ~F.startswith(s["name"], F.lit("_"))
        inner = F.when((top["inner"] == "local") | (s["kind"] != "class"), "local").otherwise(F.when(public, "open").otherwise("closed"))
        own = F.struct(s["end"].alias("end"), s["indent"].alias("indent"), s["name"].alias("name"), inner.alias("inner"))
        row = F.struct(top["name"].alias("parent"), public.alias("public"))
        return F.struct(F.concat(around, F.array(own)).alias("open"), F.concat(held["rows"], F.array(row)).alias("rows")).cast(state)

    start = F.struct(F.array().alias("open"), F.array().alias("rows")).cast(state)
    nested = files.select(*ENTRY, "found", F.aggregate("found", start, step)["rows"].alias("rows"))
    each = nested.select(*ENTRY, F.explode_outer(F.arrays_zip("found", "rows")).alias("f"))
    return each.select(
        *ENTRY,
        F.col("f.found.kind").alias("kind"),
        F.col("f.found.name").alias("name"),
        F.col("f.rows.public").alias("public"),
        F.col("f.found.doc").alias("doc"),
        (F.col("f.found.line") + 1).alias("line_start"),
        (F.col("f.found.end") + 1).alias("line_end"),
        F.col("f.rows.parent").alias("parent"),
        F.lit("indent").alias("method"),
        F.lit("indent").alias("span_method"),
    )


#: A header whose body follows on its line.
_ONE_LINE = r"\A(?:try|else|finally|(?:if|elif|while|for|with|except|async|def|class)\b.*)\s*:\s*"


def line_imports(contents: DataFrame) -> DataFrame:
    """Imports by statement: lines are joined over brackets and backslashes and cut at semicolons."""
    by_line = W.partitionBy(*ENTRY).orderBy("line")
    statements = F.translate(F.regexp_replace(masked(F.col("text")), r"\\\r?\n", " "), ";", "\n")
    # Only the order of lines counts here, and comments leave many empty ones: they are not moved.
    statements = F.regexp_replace(statements, EMPTY_LINES, "\n")
    text = paths.strip(F.col("code"))
    lines = _lines(contents, r"(?m)^[^\n#]*\b(import|from)\b", statements).where(F.col("code").isNotNull())
    lines = _with_starts(by_size(lines.drop("written"), ["repo", "path"], _python(contents), F.octet_length("text")))
    begun = lines.withColumn(
        "_from",
        F.last(
            F.when(F.col("starts"), F.struct("line", text.rlike(rf"(?:{_ONE_LINE})?\b(?:import\s|from[\s.])").alias("is"))),
            ignorenulls=True,
        ).over(by_line),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda s: s["code"]), " ")
    logical = (
        begun.where(F.col("_from.is"))
        .groupBy(*ENTRY, F.col("_from.line").alias("line"))
        .agg(joined.alias("_code"))
        .select(*ENTRY, "line", F.regexp_replace(paths.strip(F.col("_code")), rf"(?s){_ONE_LINE}(?=(?:import|from)\b)", "").alias("_code"))
    )
    first_word = lambda c: F.regexp_extract(paths.strip(c), r"(?U)\A(\S*)", 1)
    split_names = lambda c: F.filter(
        F.transform(F.split(c, ","), first_word), lambda n: n != ""
    )
    plain = logical.where(F.col("_code").rlike(r"\Aimport\s")).select(
        *ENTRY,
        "line",
        F.posexplode(split_names(F.substring("_code", F.lit(8), F.length("_code")))).alias("_i", "spec"),
        F.lit("import").alias("form"),
        F.lit(0).alias("level"),
        F.lit(None).cast("array<string>").alias("names"),
    )
    part = lambda n: F.regexp_extract("_code", r"(?sU)\Afrom\b\s*([.\s]*)([\w.\s]*?)\s*\bimport\b(.*)\z", n)
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    listed = F.regexp_replace(part(3), r"(?U)\A[\s()]+|[\s()]+\z", "")
    from_ = logical.where(F.startswith("_code", F.lit("from")) & (listed != "")).select(
        *ENTRY,
        "line",
        F.lit(0).alias("_i"),
        bare(part(2)).alias("spec"),
        F.lit("from").alias("form"),
        F.length(bare(part(1))).alias("level"),
        split_names(listed).alias("names"),
    )
    both = plain.select(*from_.columns).unionByName(from_)
    numbered = F.row_number().over(W.partitionBy(*ENTRY).orderBy("line", "_i")) - 1
    return both.select(*ENTRY, "form", "spec", "level", "names", numbered.alias("ord"))
