"""Checked queries on source code: symbols, imports, resolution, tests, summaries.

The source files are those of the CODE view, one per document, of twelve kinds
by ``k % 12``.  Where a kind's text decides the result, the SQL says what each
kind holds; ``c`` is the number of comment lines the document makes up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import (
    diff,
    graph,
    imports,
    markers,
    pysource,
    resolve,
    summary,
    symbols,
    testsgap,
    tree,
)
from coppice.plans import registry as R
from coppice.plans.registry import checked, view
from coppice.schema import ENTRY, TREE
from coppice.session import cut
from coppice.sinks import report
from coppice.sources import trees

_SRC = """
src AS (SELECT source AS repo, cast(floor(doc_id / 20) AS bigint) AS k, cast(floor(doc_id / 240) AS bigint) AS j, cast(floor(doc_id / 20) AS bigint) % 12 AS kind,
  len(string_split(text, chr(10))) AS c FROM documents),
paths AS (SELECT repo, path FROM @CODE p)
"""
# SQL: path of each kind.
_PATH = (
    "CASE kind WHEN 0 THEN 'pkg/m' || k || '.py' WHEN 1 THEN 'pkg/sub' || (k % 3) || '/m' || k || '.py' WHEN 2 THEN 'web/m' || k || '.js' "
    "WHEN 3 THEN 'web/ui/m' || k || '.ts' WHEN 4 THEN 'svc/p' || (j % 4) || '/m' || k || '.go' WHEN 5 THEN 'src/m' || k || '.rs' "
    "WHEN 6 THEN 'java/org/acme/C' || k || '.java' WHEN 7 THEN 'php/Lib/P' || k || '.php' WHEN 8 THEN 'rb/m' || k || '.rb' "
    "WHEN 9 THEN 'kt/org/acme/K' || k || '.kt' WHEN 10 THEN 'tests/test_m' || (k - 10) || '.py' ELSE 'native/m' || k || '.c' END"
)


def _contents(spark, sf_dir):
    return view(spark, sf_dir, "CODE").select(*ENTRY, "text")


def _files(spark, sf_dir):
    return cut(trees.inventory(view(spark, sf_dir, "CODE").drop("text")), "inventory")


def _rows(rows: list[tuple], columns: list[str]) -> str:
    """SELECT per ``(kinds, where, *expressions)`` row from ``src``."""
    parts = []
    for kind, where, *values in rows:
        listed = ", ".join(f"{v} AS {c}" for v, c in zip(values, columns, strict=True))
        parts.append(f"SELECT repo, {_PATH} AS path, {listed} FROM src WHERE kind = {kind} AND {where}")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- symbols

_PY_SYMBOLS = _rows(
    [
        (0, "true", "'class'", "'Box' || k", "true", "'Holds one thing.'", "4 + c + 1", "4 + c + 8", "NULL", "'indent'"),
        (0, "true", "'def'", "'get'", "true", "NULL", "4 + c + 5", "4 + c + 6", "'Box' || k", "'indent'"),
        (0, "true", "'def'", "'_set'", "false", "NULL", "4 + c + 7", "4 + c + 8", "'Box' || k", "'indent'"),
        (0, "true", "'def'", "'load_' || k", "true", "NULL", "4 + c + 9", "4 + c + 13", "NULL", "'indent'"),
        (0, "true", "'def'", "'local'", "false", "NULL", "4 + c + 11", "4 + c + 12", "'load_' || k", "'indent'"),
        (1, "true", "'def'", "'_hidden' || k", "false", "NULL", "5 + c + 1", "5 + c + 2", "NULL", "'indent'"),
        (1, "k % 24 = 1", "'def'", "'broken'", "true", "NULL", "5 + c + 3", "5 + c + 3", "NULL", "'indent'"),
        (10, "true", "'def'", "'test_it'", "true", "NULL", "1 + c + 1", "1 + c + 2", "NULL", "'indent'"),
    ],
    ["kind", "name", "public", "doc", "line_start", "line_end", "parent", "method"],
)


@checked(f"WITH {_SRC} {_PY_SYMBOLS}")
def python_symbols(spark, sf_dir):
    """Python by indentation, also of files that Python would not accept."""
    found = symbols._full(pysource.symbols(_contents(spark, sf_dir)))
    return found.drop("snapshot", "span_method")


# Kind: lines before the comments; then (first, last, kind, name, public, parent).
_SPANS = {
    2: (7, [(1, 3, "class", "'View' || k", True, None), (4, 6, "func", "'make' || k", True, None), (7, 11, "func", "'hidden' || k", False, None)]),
    3: (3, [(1, 3, "func", "'helper' || k", True, None), (4, 4, "func", "'local' || k", False, None)]),
    4: (7, [(1, 3, "struct", "'Shape' || k", True, None), (4, 6, "interface", "'doer' || k", False, None), (7, 9, "func", "'Area'", True, None),
            (10, 10, "func", "'inner' || k", False, None)]),
    5: (5, [(1, 3, "struct", "'Thing' || k", True, None), (5, 7, "fn", "'new'", True, "'Thing' || k"), (9, 11, "trait", "'Run' || k", True, None),
            (10, 10, "fn", "'go'", False, "'Run' || k"), (12, 12, "fn", "'alone' || k", False, None)]),
    6: (5, [(1, 8, "class", "'C' || k", True, None), (2, 4, "method", "'size'", False, None), (5, 7, "method", "'name'", True, None)]),
    7: (5, [(1, 6, "class", "'P' || k", True, None), (2, 3, "method", "'hide'", False, None), (4, 5, "method", "'show'", True, None)]),
    9: (2, [(1, 7, "class", "'K' || k", True, None), (2, 3, "fun", "'hide'", False, None), (4, 6, "fun", "'show'", True, None)]),
    11: (1, [(1, 5, "func", "'add' || k", True, None), (6, 8, "struct", "'point'", True, None)]),
}
# Ruby has no braces, so its symbols have no span.
_SPANS[8] = (2, [(1, None, "module", "'Mod' || k", True, None), (2, None, "class", "'Thing'", True, None), (3, None, "def", "'run!'", True, None),
                 (5, None, "def", "'_skip'", False, None)])
_SPAN_ROWS = [
    (
        kind, "true", f"{head} + c + {first}", f"{head} + c + {last}" if last else "cast(NULL AS bigint)", f"'{what}'", name,
        str(public).lower(), parent or "cast(NULL AS varchar)",
    )
    for kind, (head, listed) in _SPANS.items()
    for first, last, what, name, public, parent in listed
]
_SPAN_SQL = _rows(_SPAN_ROWS, ["line_start", "line_end", "kind", "name", "public", "parent"])


# By line, Python knows no scopes: only the underscore counts.
_PY_LINES = _rows(
    [
        (0, "true", "4 + c + 1", "'class'", "'Box' || k", "true"),
        (0, "true", "4 + c + 5", "'def'", "'get'", "true"),
        (0, "true", "4 + c + 7", "'def'", "'_set'", "false"),
        (0, "true", "4 + c + 9", "'def'", "'load_' || k", "true"),
        (0, "true", "4 + c + 11", "'def'", "'local'", "true"),
        (1, "true", "5 + c + 1", "'def'", "'_hidden' || k", "false"),
        (1, "k % 24 = 1", "5 + c + 3", "'def'", "'broken'", "true"),
        (10, "true", "1 + c + 1", "'def'", "'test_it'", "true"),
    ],
    ["line_start", "kind", "name", "public"],
)
_BY_REGEX = ", ".join(f"'{e}'" for e in (".py", ".js", ".ts", ".go", ".rs"))


@checked(
    f"""
WITH {_SRC}, s AS ({_SPAN_SQL}), p AS ({_PY_LINES}), both_ AS (SELECT repo, path, line_start, kind, name, public FROM s UNION ALL SELECT repo, path, line_start, kind, name, public FROM p)
SELECT *, CASE WHEN {R.ext_of()} IN ({_BY_REGEX}) THEN 'regex' ELSE 'pattern' END AS method FROM both_
"""
)
def symbols_by_line(spark, sf_dir):
    """Line patterns of every language, with the visibility rule, against rows written by hand."""
    return symbols.line_symbols(_contents(spark, sf_dir)).drop("snapshot")


@checked(f"WITH {_SRC} {_SPAN_SQL}")
def brace_spans(spark, sf_dir):
    """Line spans of brace languages; methods of Rust types know their type."""
    found = symbols.brace_symbols(_contents(spark, sf_dir))
    return found.drop("snapshot", "method", "span_method")


# Symbols of all languages.
_ALL = f"""
s AS (SELECT repo, path, line_start, line_end, kind, name, public, parent FROM ({_PY_SYMBOLS}) p
  UNION ALL SELECT repo, path, line_start, line_end, kind, name, public, parent FROM ({_SPAN_SQL}) b)
"""


@checked(f"WITH {_SRC}, {_ALL} SELECT repo, path, kind, name FROM s WHERE public")
def public_symbols(spark, sf_dir):
    found = symbols.symbols(_contents(spark, sf_dir), public_only=True)
    return found.select("repo", "path", "kind", "name")


_LABEL = "kind || ' ' || CASE WHEN parent IS NULL THEN name WHEN kind = 'fn' THEN parent || '::' || name ELSE parent || '.' || name END"


@checked(
    f"""
WITH {_SRC}, {_ALL}, l AS (SELECT repo, path, {_LABEL} AS label, row_number() OVER (PARTITION BY repo, path ORDER BY line_start, {_LABEL}) AS n, count(*) OVER (PARTITION BY repo, path) AS total FROM s)
SELECT repo, path, total AS symbols, string_agg(label, ', ' ORDER BY n) FILTER (n <= 2) || CASE WHEN total > 2 THEN ', +' || (total - 2) ELSE '' END AS outline FROM l GROUP BY 1, 2, 3
"""
)
def outlines(spark, sf_dir):
    """First symbols of each file and how many more there are."""
    return symbols.outlines(symbols.symbols(_contents(spark, sf_dir)), 2).drop("snapshot")


_LONG = """f AS (SELECT repo, line_end - line_start + 1 AS lines, path || ':' || CASE WHEN parent IS NULL THEN name WHEN kind = 'fn' THEN parent || '::' || name ELSE parent || '.' || name END AS symbol, line_start
  FROM s WHERE kind NOT IN ('class', 'struct') AND line_end > line_start AND line_end - line_start + 1 >= 3)"""


@checked(
    f"""
WITH {_SRC}, {_ALL}, {_LONG}
SELECT repo, lines, symbol, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, symbol, line_start) AS rank FROM f) x WHERE rank <= 5
"""
)
def longest_functions(spark, sf_dir):
    found = symbols.long_functions(symbols.symbols(_contents(spark, sf_dir)), 5, at_least=3)
    return found.drop("snapshot")


_PAGE = """replace(replace(html, '<nav>', '<script type="application/json">function no() {}</script><script src="a.js">function not() {}</script>' || chr(10) || '<nav>'),
  '<script>', '<SCRIPT' || chr(10) || ' type="module">' || chr(10) || 'export function f' || page_id || '(a) {' || chr(10) || '}' || chr(10) || 'const g = x => x;')"""


def _pages(spark, sf_dir):
    """Pages whose inline scripts declare functions, next to scripts that do not count."""
    pages = view(spark, sf_dir, "PAGES")
    json_block = '<script type="application/json">function no() {}</script><script src="a.js">function not() {}</script>\n<nav>'
    number = F.regexp_extract("path", r"^p(\d+)\.", 1)
    module = F.concat(F.lit('<SCRIPT\n type="module">\nexport function f'), number, F.lit("(a) {\n}\nconst g = x => x;"))
    text = F.replace(F.replace("text", F.lit("<nav>"), F.lit(json_block)), F.lit("<script>"), module)
    return pages.select(*ENTRY, text.alias("text"))


@checked(
    f"""
WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, 'p' || page_id || '.html' AS path, page_id, {_PAGE} AS text FROM pages),
b AS (SELECT *, unnest(regexp_extract_all(text, '(?s)<SCRIPT\\n type="module">\\nexport.*?</script')) AS body, generate_subscripts(regexp_extract_all(text, '(?s)<SCRIPT\\n type="module">\\nexport.*?</script'), 1) AS n FROM p),
o AS (SELECT *, len(string_split(array_to_string(string_split(text, '<SCRIPT' || chr(10))[1:n], 'x'), chr(10))) - 1 + (n - 1) AS before FROM b)
SELECT repo, path, before + 3 AS line_start, before + 4 AS line_end, 'func' AS kind, 'f' || page_id AS name, true AS public, 'regex' AS method FROM o
UNION ALL SELECT repo, path, before + 5, before + 5, 'func', 'g', false, 'regex' FROM o
"""
)
def html_symbols(spark, sf_dir):
    """Functions of inline scripts, numbered by the lines of the page."""
    return symbols.html_symbols(_pages(spark, sf_dir)).drop("snapshot", "span_method")


@checked(
    """
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repo, 'p' || page_id || '.html' AS path, count(*) AS blocks, cast(sum(length(body)) AS bigint) AS chars FROM (
  SELECT url, page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script', 1)) AS body FROM pages) b GROUP BY 1, 2
"""
)
def inline_scripts(spark, sf_dir):
    found = symbols.inline_scripts(view(spark, sf_dir, "PAGES"))
    return found.groupBy("repo", "path").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@checked(
    f"""
WITH {_SRC}, py AS ({_PY_SYMBOLS}), spans AS ({_SPAN_SQL})
SELECT repo, path, line_start, line_end, kind, name, public, parent FROM py
UNION ALL SELECT repo, path, line_start, line_end, kind, name, public, parent FROM spans
"""
)
def all_symbols(spark, sf_dir):
    """Symbols of all languages together, Python among them."""
    found = symbols.symbols(_contents(spark, sf_dir))
    return found.select("repo", "path", "line_start", "line_end", "kind", "name", "public", "parent")


# ---------------------------------------------------------------- Python that does not parse

# What stands before the same lines of every file, and its imports as (form, spec, level, names).
_HEADS = [
    ("x = 1", []),
    ("x = foo(1", []),
    ("print 'it''s (", []),
    ('x = f"{d["k("]}" + f\'{", (".join(d)!r:>{n}}\'', []),
    (
        'import json; import sys as s, re; x = "; import no"; y = \'\\\'; import no\'',
        [("import", "json", 0, None), ("import", "sys", 0, None), ("import", "re", 0, None)],
    ),
    (
        "from a.b import c, \\\n    d as e\nimport os.path, \\\n  late",
        [("from", "a.b", 0, "c,d"), ("import", "os.path", 0, None), ("import", "late", 0, None)],
    ),
    ("y = {'a': [(1, 2]", []),
    ('s = """never closed ( [', []),
    (
        "if x: import early\ntry: from . import sib\nfrom ..up import(one, two)\nfrom.x import *",
        [("import", "early", 0, None), ("from", "", 1, "sib"), ("from", "up", 2, "one,two"), ("from", "x", 1, "*")],
    ),
    ('def cut(a=(1, "(":\n    return [', []),
    ("x = 1 + \\", []),
]
_TAIL = """import os
from pkg.m%k% import (
    Box,
    other)

class Box%k%(object):
    '''Holds ( one thing.'''
    def get(self):
        return {"a": [1, 2]}

    def put(self, x=(1,
                    2)):
        return x; pass

def load_%k%(a,
             b="#("):
    def local(): return a
    return local
def _last(): pass"""
# First and last line, kind, name, public, docstring, parent.
_TAIL_SYMBOLS = [
    (6, 13, "class", "'Box' || k", True, "'Holds ( one thing.'", "NULL"),
    (8, 9, "def", "'get'", True, "NULL", "'Box' || k"),
    (11, 13, "def", "'put'", True, "NULL", "'Box' || k"),
    (15, 18, "def", "'load_' || k", True, "NULL", "NULL"),
    (17, 17, "def", "'local'", False, "NULL", "'load_' || k"),
    (19, 19, "def", "'_last'", False, "NULL", "NULL"),
]


def _damaged(spark, sf_dir):
    """A Python file per document: a head, the text as comments, the same tail."""
    docs = R.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    head = F.element_at(F.array(*[F.lit(text) for text, _ in _HEADS]), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    said = F.concat(F.lit("# "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")))
    tail = F.replace(F.lit(_TAIL), F.lit("%k%"), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py"))
    return docs.select(
        F.col("source").alias("repo"), F.lit("head").alias("snapshot"), path.alias("path"), F.concat_ws("\n", head, said, tail).alias("text")
    )


_DAMAGED = f"""
d AS (SELECT source AS repo, doc_id AS k, 'pkg/m' || doc_id || '.py' AS path, doc_id % {len(_HEADS)} AS head,
  coalesce(len(string_split(text, chr(10))), 0) AS c FROM documents WHERE doc_id IS NOT NULL),
heads(head, before, imports) AS (VALUES {', '.join(f"({n}, {len(text.split(chr(10)))}, {len(own)})" for n, (text, own) in enumerate(_HEADS))}),
o AS (SELECT *, c + before AS b FROM d JOIN heads USING (head))
"""


@checked(
    f"WITH {_DAMAGED} "
    + " UNION ALL ".join(
        f"SELECT repo, path, '{kind}' AS kind, {name} AS name, {str(public).lower()} AS public, {doc} AS doc, "
        f"b + {first} AS line_start, b + {last} AS line_end, {parent} AS parent FROM o"
        for first, last, kind, name, public, doc, parent in _TAIL_SYMBOLS
    )
    + " UNION ALL SELECT repo, path, 'def', 'cut', true, NULL, 1, 2, NULL FROM o WHERE head = 9"
)
def python_damaged_symbols(spark, sf_dir):
    """Symbols of files with open brackets, odd quotes and nested f-strings: no head costs a symbol of the tail."""
    return pysource.symbols(_damaged(spark, sf_dir)).drop("snapshot", "method", "span_method")


def _import_row(where: str, at: str, form: str, spec: str, level: int, names: str | None) -> str:
    listed = "NULL" if names is None else f"'{names}'"
    return f"SELECT repo, path, {at} AS ord, '{form}' AS form, {spec} AS spec, {level} AS level, {listed} AS names FROM o WHERE {where}"


@checked(
    f"WITH {_DAMAGED} "
    + " UNION ALL ".join(
        [
            *[
                _import_row(f"head = {n}", str(at), form, f"'{spec}'", level, names)
                for n, (_, own) in enumerate(_HEADS)
                for at, (form, spec, level, names) in enumerate(own)
            ],
            _import_row("true", "imports", "import", "'os'", 0, None),
            _import_row("true", "imports + 1", "from", "'pkg.m' || k", 0, "Box,other"),
        ]
    )
)
def python_damaged_imports(spark, sf_dir):
    """Imports of the same files, behind semicolons, colons and backslashes too."""
    found = pysource.line_imports(_damaged(spark, sf_dir))
    return found.select("repo", "path", "ord", "form", "spec", "level", F.array_join("names", ",").alias("names"))


# ---------------------------------------------------------------- raw imports

_PY_RAW = [
    (0, "true", 0, "'import'", "'os'", 0, "NULL"),
    (0, "true", 1, "'import'", "'sys'", 0, "NULL"),
    (0, "true", 2, "'from'", "''", 1, "'m' || (k + 12) || ',nothing'"),
    (0, "true", 3, "'from'", "'sub1'", 1, "'m' || (k + 1)"),
    (0, "true", 4, "'import'", "'pkg.m' || (k - 12)", 0, "NULL"),
    (1, "true", 0, "'from'", "'m' || (k - 1)", 2, "'Box'"),
    (1, "true", 1, "'from'", "'pkg.m' || (k + 11)", 0, "'Box,other'"),
    (10, "true", 0, "'from'", "'pkg.m' || (k - 10)", 0, "'Box'"),
]
_PY_RAW_SQL = _rows(_PY_RAW, ["ord", "form", "spec", "level", "names"])


@checked(f"WITH {_SRC} {_PY_RAW_SQL}")
def python_imports_by_line(spark, sf_dir):
    """Imports by logical line, for every Python file."""
    found = pysource.line_imports(_contents(spark, sf_dir))
    return found.select("repo", "path", "ord", "form", "spec", "level", F.array_join("names", ",").alias("names"))


@checked(f"WITH {_SRC} {_PY_RAW_SQL}")
def python_imports(spark, sf_dir):
    """Python imports as the resolution takes them."""
    found = imports.python(_contents(spark, sf_dir))
    return found.select("repo", F.col("src").alias("path"), "ord", "form", "spec", "level", F.array_join("names", ",").alias("names"))


# Per kind: (form, spec), in order.
_RAW = {
    2: [("import", "'./ui/m' || (k + 1)"), ("import", "'./m' || (k + 12) || '.js'"), ("import", "'react'"), ("import", "'@lib/m' || (k + 1)"),
        ("import", "'fs'"), ("import", "'#ui/m' || (k + 1)"), ("import", "'../web/ui/m' || (k + 1)")],
    3: [("import", "'../m' || (k - 1)"), ("import", "'.'"), ("import", "'web/ui/m' || (k + 12)")],
    4: [("import", "'fmt'"), ("import", "'example.org/' || repo || '/svc/p' || ((j + 1) % 4)"), ("import", "'strings'")],
    5: [("mod", "'m' || (k + 12)"), ("mod", "'n' || k"), ("use", "'crate::m' || (k + 12) || '::Thing'"), ("use", "'std::fmt'"), ("use", "'std::io::Read'"),
        ("use", "'super::m' || (k - 12) || '::Thing'"), ("use", "'super::m' || (k - 12) || '::helper'")],
    6: [("import", "'org.acme.C' || (k + 12)"), ("import", "'org.acme.K' || (k + 3)"), ("import", "'java.util.List'"), ("import", "'C' || k")],
    7: [("use", "'Lib' || chr(92) || 'P' || (k + 12)"), ("use", "'Vendor' || chr(92) || 'Thing'"), ("require", "'P' || (k - 12) || '.php'"), ("require", "'../shared.php'")],
    8: [("require", "'json'"), ("require_relative", "'m' || (k + 12)")],
    9: [("import", "'org.acme.C' || (k - 3)"), ("import", "'kotlin.math.abs'")],
}
_RAW_SQL = _rows(
    [(kind, "true", i, f"'{form}'", spec) for kind, listed in _RAW.items() for i, (form, spec) in enumerate(listed)],
    ["ord", "form", "spec"],
)


@checked(f"WITH {_SRC} {_RAW_SQL}")
def imports_by_pattern(spark, sf_dir):
    """Imports of JavaScript, Go, Rust, Java, Kotlin, PHP and Ruby."""
    out = imports.by_pattern(_contents(spark, sf_dir))
    return out.select("repo", F.col("src").alias("path"), "ord", "form", "spec")


# ---------------------------------------------------------------- resolution

# Per kind: (position of the import, its file).  Those files have to exist.
_PY_TARGETS = {
    0: [(2, "'pkg/m' || (k + 12) || '.py'"), (3, "'pkg/sub1/m' || (k + 1) || '.py'"), (4, "'pkg/m' || (k - 12) || '.py'")],
    1: [(0, "'pkg/m' || (k - 1) || '.py'"), (1, "'pkg/m' || (k + 11) || '.py'")],
    10: [(0, "'pkg/m' || (k - 10) || '.py'")],
}
_UI = "'web/ui/m' || (k + 1) || '.ts'"
_TARGETS = {
    2: [(0, _UI), (1, "'web/m' || (k + 12) || '.js'"), (3, _UI), (5, _UI), (6, _UI)],
    3: [(0, "'web/m' || (k - 1) || '.js'")],
    5: [(0, "'src/m' || (k + 12) || '.rs'"), (2, "'src/m' || (k + 12) || '.rs'"), (5, "'src/m' || (k - 12) || '.rs'"), (6, "'src/m' || (k - 12) || '.rs'")],
    6: [(0, "'java/org/acme/C' || (k + 12) || '.java'"), (1, "'kt/org/acme/K' || (k + 3) || '.kt'")],
    7: [(0, "'php/Lib/P' || (k + 12) || '.php'"), (2, "'php/Lib/P' || (k - 12) || '.php'")],
    8: [(1, "'rb/m' || (k + 12) || '.rb'")],
    9: [(0, "'java/org/acme/C' || (k - 3) || '.java'")],
}


def _hits(targets: dict) -> str:
    rows = _rows([(kind, "true", o, t) for kind, listed in targets.items() for o, t in listed], ["ord", "dst"])
    return f"SELECT h.repo, h.path, h.ord, h.dst FROM ({rows}) h JOIN paths p ON p.repo = h.repo AND p.path = h.dst WHERE h.dst <> h.path"


_GO_HITS = """
SELECT s.repo, 'svc/p' || (s.j % 4) || '/m' || s.k || '.go' AS path, 1 AS ord, p.path AS dst FROM src s
JOIN paths p ON p.repo = s.repo AND p.path LIKE 'svc/p' || ((s.j + 1) % 4) || '/%.go' WHERE s.kind = 4
"""
_ALL_HITS = f"hits AS ({_hits({**_PY_TARGETS, **_TARGETS})} UNION ALL {_GO_HITS})"
_EDGES = f"edges AS (SELECT DISTINCT repo, path AS src, dst FROM hits)"  # noqa: F541
_SPECS = f"""
specs AS (SELECT repo, path, ord, form, repeat('.', level) || spec AS spec FROM ({_PY_RAW_SQL}) a UNION ALL SELECT repo, path, ord, form, spec FROM ({_RAW_SQL}) b),
outside AS (SELECT s.repo, s.path AS src, s.spec, min(s.ord) AS ord FROM specs s WHERE s.form <> 'mod' AND s.spec <> ''
  AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.repo = s.repo AND h.path = s.path AND h.ord = s.ord) GROUP BY 1, 2, 3),
externals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, src ORDER BY ord) AS rank FROM outside) x)
"""


def _resolved(spark, sf_dir):
    contents = _contents(spark, sf_dir)
    files = _files(spark, sf_dir)
    raw = cut(imports.raw_imports(contents), "imports")
    manifests = cut(trees.manifest_bodies(contents), "manifests")
    return files, cut(
        resolve.resolve(
            raw,
            files,
            trees.go_modules(manifests),
            trees.ts_options(manifests),
            trees.package_aliases(manifests),
            trees.cargo_dirs(files),
        ),
        "resolved",
    )


@checked(f"WITH {_SRC}, {_ALL_HITS}, {_EDGES} SELECT * FROM edges")
def import_edges(spark, sf_dir):
    """Imports of all languages resolved to files of the tree."""
    return resolve.edges(_resolved(spark, sf_dir)[1]).select("repo", "src", "dst")


@checked(f"WITH {_SRC}, {_ALL_HITS}, {_SPECS} SELECT repo, src, spec, ord, rank FROM externals")
def external_imports(spark, sf_dir):
    """Names that resolve to no file, in order."""
    return resolve.externals(_resolved(spark, sf_dir)[1]).drop("snapshot")


@checked(f"WITH {_SRC}, {_ALL_HITS}, {_SPECS} SELECT repo, src, spec, ord, rank FROM externals WHERE rank <= 3")
def first_external_imports(spark, sf_dir):
    """The first three such names of each file: here the limit is the feature."""
    return resolve.externals(_resolved(spark, sf_dir)[1], 3).drop("snapshot")


def _resolved_only(function: str, targets: dict | None):
    sql = f"WITH {_SRC}, h AS ({_hits(targets) if targets else _GO_HITS}) SELECT repo, path AS src, ord, dst FROM h"
    return checked(sql)


def _found(df):
    return df.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select("repo", "src", "ord", "dst")


def _pattern_imports(contents, *langs):
    return cut(imports.by_pattern(contents, list(langs)), "imports")


@_resolved_only("python", _PY_TARGETS)
def resolved_python(spark, sf_dir):
    raw = cut(imports.python(_contents(spark, sf_dir)), "imports")
    return _found(resolve.resolve(raw, _files(spark, sf_dir), langs=("py",)))


@_resolved_only("javascript", {k: _TARGETS[k] for k in (2, 3)})
def resolved_javascript(spark, sf_dir):
    """Relative paths, path aliases of the configuration, package aliases."""
    contents = _contents(spark, sf_dir)
    return _found(
        resolve.resolve(
            _pattern_imports(contents, "js"),
            _files(spark, sf_dir),
            ts_options=trees.ts_options(contents),
            package_aliases=trees.package_aliases(contents),
            langs=("js",),
        )
    )


@_resolved_only("go", None)
def resolved_go(spark, sf_dir):
    contents = _contents(spark, sf_dir)
    modules = trees.go_modules(contents)
    raw = _pattern_imports(contents, "go")
    return _found(resolve.resolve(raw, _files(spark, sf_dir), go_modules=modules, langs=("go",)))


@_resolved_only("rust", {5: _TARGETS[5]})
def resolved_rust(spark, sf_dir):
    files = _files(spark, sf_dir)
    raw = _pattern_imports(_contents(spark, sf_dir), "rs")
    return _found(resolve.resolve(raw, files, cargo_dirs=trees.cargo_dirs(files), langs=("rs",)))


@_resolved_only("jvm", {k: _TARGETS[k] for k in (6, 9)})
def resolved_jvm(spark, sf_dir):
    raw = _pattern_imports(_contents(spark, sf_dir), "jvm")
    return _found(resolve.resolve(raw, _files(spark, sf_dir), langs=("jvm",)))


@_resolved_only("php and ruby", {k: _TARGETS[k] for k in (7, 8)})
def resolved_php_and_ruby(spark, sf_dir):
    raw = _pattern_imports(_contents(spark, sf_dir), "php", "rb")
    return _found(resolve.resolve(raw, _files(spark, sf_dir), langs=("php", "rb")))


@checked(
    f"""
WITH {_SRC}, {_ALL_HITS}, {_EDGES}, {_SPECS}, d AS (SELECT repo, path, cast(sum(o) AS bigint) AS imports, cast(sum(i) AS bigint) AS imported_by FROM (
  SELECT repo, src AS path, 1 AS o, 0 AS i FROM edges UNION ALL SELECT repo, dst, 0, 1 FROM edges) x GROUP BY 1, 2),
x AS (SELECT repo, src AS path, count(*) AS n FROM externals GROUP BY 1, 2)
SELECT coalesce(d.repo, x.repo) AS repo, coalesce(d.path, x.path) AS path, coalesce(imports, 0) AS imports, coalesce(imported_by, 0) AS imported_by, coalesce(n, 0) AS external_imports
FROM d FULL JOIN x ON x.repo = d.repo AND x.path = d.path
"""
)
def flat_imports(spark, sf_dir):
    """Files with any import, importer or external name."""
    resolved = _resolved(spark, sf_dir)[1]
    return report.flat_imports(resolve.edges(resolved), resolve.externals(resolved)).drop("snapshot")


@checked(
    f"""
WITH {_SRC}, {_ALL_HITS}, {_EDGES}, {_SPECS}
SELECT repo, src AS path, 'imports' AS relation, dst AS other FROM edges UNION ALL
SELECT repo, dst, 'imported_by', src FROM edges UNION ALL SELECT repo, src, 'external', spec FROM externals
"""
)
def import_rows(spark, sf_dir):
    """Each file's imports, importers and external names, one row each."""
    resolved = _resolved(spark, sf_dir)[1]
    return report.import_rows(resolve.edges(resolved), resolve.externals(resolved)).drop("snapshot")


_TESTED = f"""
{_ALL_HITS}, {_EDGES},
start AS (SELECT DISTINCT repo, src AS node FROM edges WHERE src LIKE 'tests/%'),
covered AS (SELECT e.repo, e.dst AS node FROM edges e JOIN start s ON s.repo = e.repo AND s.node = e.src UNION SELECT e.repo, e.dst FROM covered c JOIN edges e ON e.repo = c.repo AND e.src = c.node)
"""


@checked(f"WITH RECURSIVE {_SRC}, {_TESTED} SELECT repo, node AS path FROM covered")
def covered_by_tests(spark, sf_dir):
    """Files reached from tests through imports."""
    edges = cut(resolve.edges(_resolved(spark, sf_dir)[1]), "edges")
    return testsgap.covered_by_tests(edges).drop("snapshot")


_UNTESTED = f"""
{_TESTED}, untested AS (SELECT repo, path FROM (SELECT repo, k, kind, {_PATH} AS path FROM src) s
  WHERE (kind IN (1, 2, 3, 4) OR (kind = 0 AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.repo = s.repo AND p.path = 'tests/test_m' || k || '.py')) OR (kind = 5 AND k % 24 <> 5)
    OR (kind = 1 AND false))
  AND (repo, path) NOT IN (SELECT (repo, node) FROM covered))
"""


@checked(f"WITH RECURSIVE {_SRC}, {_UNTESTED} SELECT * FROM untested")
def untested_files(spark, sf_dir):
    """Sources without a test by name, by import from a test, or inside."""
    files, resolved = _resolved(spark, sf_dir)
    tested = imports.inline_tested(_contents(spark, sf_dir))
    return testsgap.untested(files, cut(resolve.edges(resolved), "edges"), tested).drop("snapshot")


@checked(f"WITH {_SRC} SELECT repo, {_PATH} AS path FROM src WHERE kind = 5 AND k % 24 = 5")
def inline_tested(spark, sf_dir):
    return imports.inline_tested(_contents(spark, sf_dir)).drop("snapshot")


@checked(
    f"""
SELECT repo, path, CASE WHEN path LIKE '%.py' THEN replace(regexp_replace(path, '\\.py$', ''), '/', '.') END AS python_module,
  CASE WHEN path LIKE 'src/%.rs' THEN regexp_replace(regexp_replace(path, '^src/', ''), '\\.rs$', '') END AS rust_module FROM @CODE c WHERE {R.ext_of()} IN ('.py', '.rs')
"""
)
def module_names(spark, sf_dir):
    files = _files(spark, sf_dir)
    crates = trees.cargo_dirs(files).withColumn("is_crate", F.lit(True))
    rust = resolve.rust_modules(files, crates).select(
        "repo", "path", F.lit(None).cast("string").alias("python_module"), F.col("module").alias("rust_module")
    )
    python = resolve.python_modules(files).select(
        "repo", "path", F.col("key").alias("python_module"), F.lit(None).cast("string").alias("rust_module")
    )
    return python.unionByName(rust)


@checked(
    """
SELECT DISTINCT source AS repo, 'example.org/' || source AS module, '' AS base_url, '@lib/*=nope/*,web/ui/*' AS paths, '#ui/*=./web/ui/*.ts' AS aliases FROM documents
"""
)
def manifest_facts(spark, sf_dir):
    """Module name, path aliases and package aliases of every tree."""
    contents = _contents(spark, sf_dir)
    pair = lambda e, v: F.concat(e["key"], F.lit("="), v)
    options = trees.ts_options(contents).withColumn(
        "paths", F.array_join(F.transform("paths", lambda e: pair(e, F.array_join(e["value"], ","))), ";")
    )
    aliases = trees.package_aliases(contents).withColumn(
        "aliases", F.array_join(F.transform("aliases", lambda e: pair(e, e["value"])), ";")
    )
    return trees.go_modules(contents).join(options, TREE).join(aliases, TREE).drop("snapshot")


@checked("WITH p AS (SELECT repo, path FROM @CODE c) SELECT repo, path FROM p WHERE path IN ('web/m2.js', 'web/ui/m3.ts')")
def package_entries(spark, sf_dir):
    """Files a package names as its start, where they exist."""
    return trees.package_entries(_contents(spark, sf_dir), _files(spark, sf_dir)).drop("snapshot")


@checked(
    """
SELECT repo, 'mono/' || path AS path, 'mono' AS dir, CASE WHEN path LIKE '%.go' THEN 'go.mod' ELSE 'tsconfig.json' END AS manifest
FROM @CODE c WHERE path LIKE '%.go' OR path LIKE '%.js' OR path LIKE '%.ts'
"""
)
def nested_projects(spark, sf_dir):
    """Closest directory above a file that has its own manifest."""
    moved = trees.inventory(
        view(spark, sf_dir, "CODE").select(*TREE, F.concat(F.lit("mono/"), "path").alias("path"), "size")
    )
    moved = cut(moved, "moved")
    return graph.manifest_hints(moved.select(*ENTRY), moved).drop("snapshot")


# ---------------------------------------------------------------- API differences


@checked(
    f"""
WITH {_SRC}, {_ALL}, api AS (SELECT repo, path, {_LABEL} AS symbol FROM s WHERE public)
SELECT repo, path, replace(symbol, 'make', 'build') AS symbol, 'added' AS change, false AS untracked FROM api WHERE path LIKE '%.js' AND symbol LIKE 'func make%'
UNION ALL SELECT repo, path, symbol, 'removed', false FROM api WHERE path LIKE '%.js' AND symbol LIKE 'func make%'
UNION ALL SELECT repo, path, symbol, 'added', true FROM api WHERE path LIKE 'src/%'
"""
)
def api_changes(spark, sf_dir):
    """Public symbols added and removed; untracked directories count as all added."""
    old = _contents(spark, sf_dir)
    new = old.withColumn("text", F.replace("text", F.lit("const make"), F.lit("const build")))
    before = cut(symbols.symbols(old), "before")
    after = cut(symbols.symbols(new), "after")
    changes = old.where(F.col("path").rlike(r"\.(js|go)$")).select("repo", "path", F.lit("M").alias("status"))
    status = old.select("repo").distinct().select("repo", F.lit("src/").alias("path"), F.lit("??").alias("xy"))
    return diff.api_diff(before, after, changes, status)


@checked(
    f"""
WITH {_SRC}, {_ALL}, l AS (SELECT DISTINCT repo, path, {_LABEL} AS label FROM s WHERE public AND path LIKE '%.js' AND {_LABEL} LIKE 'func make%')
SELECT repo, path, replace(label, 'make', 'build') AS label, 'added' AS change FROM l UNION ALL SELECT repo, path, label, 'removed' FROM l
"""
)
def symbol_set_difference(spark, sf_dir):
    old = _contents(spark, sf_dir)
    new = old.withColumn("text", F.replace("text", F.lit("const make"), F.lit("const build")))
    listed = [cut(symbols.qualified(symbols.symbols(c)), "symbols") for c in (old, new)]
    return diff.symbol_sets(*listed).drop("snapshot")


# ---------------------------------------------------------------- everything joined

_WORDS = ["license", "copyright", "secret", "password"]
_ENTRY = "path IN ('web/m2.js', 'web/ui/m3.ts')"
_CONFIG = "path IN ('go.mod', 'tsconfig.json', 'Cargo.toml', '.gitignore')"
_ANNOTATED = f"""
{_UNTESTED}, annotated AS (
SELECT c.repo, c.path, {R.tokens_of('c.text')} AS tokens, {R.lines_of('c.text')} AS lines, coalesce(o.n, 0) AS imports, coalesce(i.n, 0) AS imported_by, y.n AS symbols, {_ENTRY.replace('path', 'c.path')} AS is_entry, {_CONFIG.replace('path', 'c.path')} AS is_config,
  CASE WHEN {R.ext_of('c.path')} IN ('.py', '.js', '.ts', '.go', '.rs') THEN (c.repo, c.path) NOT IN (SELECT (repo, path) FROM untested) END AS has_test
FROM @CODE c LEFT JOIN (SELECT repo, src AS path, count(*) AS n FROM edges GROUP BY 1, 2) o ON o.repo = c.repo AND o.path = c.path
LEFT JOIN (SELECT repo, dst AS path, count(*) AS n FROM edges GROUP BY 1, 2) i ON i.repo = c.repo AND i.path = c.path
LEFT JOIN (SELECT repo, path, count(*) AS n FROM (SELECT repo, path FROM ({_PY_SYMBOLS}) p UNION ALL SELECT repo, path FROM ({_SPAN_SQL}) s) b GROUP BY 1, 2) y ON y.repo = c.repo AND y.path = c.path)
"""


def _annotated(spark, sf_dir):
    contents = _contents(spark, sf_dir)
    files, resolved = _resolved(spark, sf_dir)
    edges = cut(resolve.edges(resolved), "edges")
    entries = cut(testsgap.entry_points(files, trees.package_entries(contents, files)), "entries")
    annotated = summary.annotate(
        files,
        counts=trees.text_counts(contents),
        todos=markers.scan(contents, _WORDS),
        symbols=symbols.symbols(contents),
        edges=edges,
        externals=resolve.externals(resolved),
        entries=entries,
        configs=testsgap.config_files(files),
        untested=testsgap.untested(files, edges, imports.inline_tested(contents)),
    )
    return annotated, edges, entries


@checked(f"WITH RECURSIVE {_SRC}, {_ANNOTATED} SELECT * FROM annotated")
def annotated_files(spark, sf_dir):
    """Every file with its counts, degrees and flags."""
    return _annotated(spark, sf_dir)[0].select(
        "repo", "path", "tokens", "lines", "imports", "imported_by", "symbols", "is_entry", "is_config", "has_test"
    )


@checked(
    f"""
WITH RECURSIVE {_SRC}, {_ANNOTATED} SELECT a.repo, a.path, {R.parent_of('a.path')} AS parent, {R.name_of('a.path')} AS name, tokens, lines, imports, imported_by, symbols, is_entry, is_config, has_test FROM annotated a
"""
)
def annotated_nodes(spark, sf_dir):
    """Nodes of files with their annotations."""
    files = _files(spark, sf_dir)
    rows = report.nodes(files, annotated=_annotated(spark, sf_dir)[0]).where("type = 'file'")
    return rows.select(
        "repo", "path", "parent", "name", "tokens", "lines", "imports", "imported_by", "symbols", "is_entry", "is_config", "has_test"
    )


_TOPS = """
used AS (SELECT repo, dst AS path, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, min(src), dst) AS rank FROM edges GROUP BY 1, 2)
"""


@checked(
    f"""
WITH RECURSIVE {_SRC}, {_ANNOTATED}, {_TOPS}, {_ALL}, {_LONG},
long_ AS (SELECT repo, string_agg(lines || ' ' || symbol, ';' ORDER BY rank) AS long_functions FROM (
  SELECT repo, lines, symbol, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, symbol, line_start) AS rank FROM f) x WHERE rank <= 5 GROUP BY 1),
t AS (SELECT repo, count(*) AS files, cast(sum(tokens) AS bigint) AS estimated_tokens, cast(sum(CASE WHEN NOT has_test THEN 1 WHEN has_test THEN 0 END) AS bigint) AS missing_tests,
  cast(sum(is_entry::int) AS bigint) AS entry_points, cast(sum(is_config::int) AS bigint) AS config_files FROM annotated GROUP BY 1)
SELECT t.*, g.long_functions, u.top AS most_depended_on FROM t LEFT JOIN long_ g ON g.repo = t.repo LEFT JOIN (SELECT repo, string_agg(path || ' ' || n, ';' ORDER BY rank) AS top FROM used WHERE rank <= 10 GROUP BY 1) u ON u.repo = t.repo
"""
)
def project_summaries(spark, sf_dir):
    """One row per tree: totals, the longest functions, and what most files depend on."""
    annotated, edges, entries = _annotated(spark, sf_dir)
    out = summary.project_summary(annotated, edges, entries=entries, symbols=symbols.symbols(_contents(spark, sf_dir)), long_from=3)
    long = F.array_join(F.transform("long_functions", lambda s: F.concat_ws(" ", s["lines"].cast("string"), s["symbol"])), ";")
    top = F.array_join(
        F.transform("most_depended_on", lambda s: F.concat_ws(" ", s["path"], s["used_by_count"].cast("string"))), ";"
    )
    return out.select(
        "repo", "files", "estimated_tokens", "missing_tests", "entry_points", "config_files", long.alias("long_functions"), top.alias("most_depended_on")
    )


@checked()
def annotated_listing(spark, sf_dir):
    """Listing lines with everything known about each file in brackets."""
    annotated, _, _ = _annotated(spark, sf_dir)
    files = cut(trees.with_directories(_files(spark, sf_dir)), "files")
    notes = tree.entry_notes(files, cut(annotated, "annotated"))
    return tree.tree_lines(files, notes).select("repo", "path", "line")
