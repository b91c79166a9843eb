"""Checked queries on sources whose comments and strings look like code.

Every document is a file of one of the languages below, its text as comment
lines before the same hand-written body; the expected rows are written by hand
too, and only their line numbers are shifted by the length of the text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import functions as F

from coppice.operators import imports, symbols
from coppice.plans import registry as R
from coppice.plans.registry import checked


class Sample(NamedTuple):
    """A body, its symbols as (first, last, kind, name, public, parent) and imports as (lang, form, spec)."""

    ext: str
    comment: str
    body: str
    symbols: list[tuple]
    imports: list[tuple] = []


SAMPLES = [
    Sample(
        ".js", "//",
        r'''const s = "{ function no() {";
/* export function old() {
} */
export function real(a) { // }
  const t = `function nope() { ${a ? `}${"}"}` : '{'}
class Inner {
}`;
  const r = /[/"{]+\/}/g, u = '}';
  return "}";
}
class After {
  m() { return a / b / c; }
}
import real from './real'; // import gone from './gone'
/*
import old from './old';
*/
const text = `
import never from './never';
`;
''',
        [(4, 10, "func", "real", True, None), (11, 13, "class", "After", False, None)],
        [("js", "import", "./real")],
    ),
    Sample(
        ".tsx", "//",
        r'''// class Gone {
export default class View {
  render() { return <p title="{">Don't {x}</p>; }
}
export const twice = (x) => `${x}}`;
''',
        [(2, 4, "class", "View", True, None), (5, 5, "func", "twice", True, None)],
    ),
    Sample(
        ".go", "//",
        r'''import "fmt" // import "gone"
var q = `
func no() {
`
type Box struct {
	A string /* } */
}
func (b *Box) Get(x rune) string {
	if x == '{' || x == '\'' { return "}" }
	return `}`
}
''',
        [(5, 7, "struct", "Box", True, None), (8, 11, "func", "Get", True, None)],
        [("go", "import", "fmt")],
    ),
    Sample(
        ".rs", "//",
        r'''/* outer /* fn x() {} */ struct Gone {
*/
pub struct Cell<'a> {
    a: &'a str, // }
}
impl<'a> Cell<'a> {
    pub fn open(&self) -> &'static str {
        let c = '{'; let q = '\''; let s = r#"fn no() { "}" "#;
        "}"
    }
    fn close() -> char { '\u{7d}' }
}
use std::fmt; /* use gone::x;
use gone::y; */
''',
        [(3, 5, "struct", "Cell", True, None), (7, 10, "fn", "open", True, "Cell"), (11, 11, "fn", "close", False, "Cell")],
        [("rs", "use", "std::fmt")],
    ),
    Sample(
        ".c", "//",
        r'''#define OPEN "{"
static const char *s = "} /* ";
/* int old(int a)
{ */
int add(int a,
        int b)
{
    char c = '}'; // {
    return a + b;
}
struct point {
    int x; /* } */
};
''',
        [(5, 10, "func", "add", True, None), (11, 13, "struct", "point", True, None)],
    ),
    Sample(
        ".h", "//",
        r'''struct node {
    int (*f)(int);
};
static inline int one(void)
{
    return '"'; /* " { */
}
''',
        [(1, 3, "struct", "node", True, None), (4, 7, "func", "one", True, None)],
    ),
    Sample(
        ".java", "//",
        r'''import a.b.C; /*
import gone.D;
*/
public class Box {
    String t = """
        class No {
        """;
    public String get(char c) { // {
        return c == '{' ? "}" : "\"}";
    }
}
''',
        [(4, 11, "class", "Box", True, None), (8, 10, "method", "get", True, None)],
        [("jvm", "import", "a.b.C")],
    ),
    Sample(
        ".cs", "//",
        r'''namespace Acme
{
    public class Box
    {
        string p = @"c:\{";
        public string Get(string x)
        {
            return $"{(x == "}" ? "{" : x)} }}" + "}";
        }
        /* public void Old() { */
        internal int Two() => 2;
        private enum Kind { A, B }
    }
    public interface IBox
    {
        string Get(string x);
    }
}
''',
        [
            (3, 13, "class", "Box", True, None), (6, 9, "method", "Get", True, None), (11, 11, "method", "Two", False, None),
            (12, 12, "enum", "Kind", False, None), (14, 17, "interface", "IBox", True, None),
        ],
    ),
    Sample(
        ".kt", "//",
        r'''/* class Gone { /* nested } */ */
import a.b.C // import gone.D
class Box(val a: String = "{") {
    fun get(c: Char): String {
        return "${if (c == '}') "}" else """{"""} }"
    }
    private object Hidden { val c = '{' }
}
''',
        [(3, 8, "class", "Box", True, None), (4, 6, "fun", "get", True, None), (7, 7, "object", "Hidden", False, None)],
        [("jvm", "import", "a.b.C")],
    ),
    Sample(
        ".swift", "//",
        r'''/* class Gone { /* } */ */
public struct Box {
    let s = """
    func no() {
    """
    func get(_ x: String) -> String {
        return "\(x == "}" ? "{" : x)" + #"}"{"#
    }
}
public protocol Doer {
    func go() {}
}
private extension Box { }
''',
        [
            (2, 9, "type", "Box", True, None), (6, 8, "func", "get", True, None), (10, 12, "protocol", "Doer", True, None),
            (11, 11, "func", "go", True, None), (13, 13, "type", "Box", False, None),
        ],
    ),
    Sample(
        ".php", "#",
        r'''# class Gone {
class Box {
    public function get($x) {
        $t = <<<SQL
        } function no() {
        SQL;
        return "{$x['a']}}" . '}
        {';
    }
    private function hide() { // }
    }
}
require 'x.php'; # require 'gone.php';
?> <p>Don't { class Html {</p>
<?php
function free() {
    return '{';
}
''',
        [
            (2, 12, "class", "Box", True, None), (3, 9, "method", "get", True, None), (10, 11, "method", "hide", False, None),
            (16, 18, "func", "free", True, None),
        ],
        [("php", "require", "x.php")],
    ),
    Sample(
        ".rb", "#",
        r'''=begin
class Gone
=end
require 'json' # require 'gone'
class Box # { def no
  def get
    x = "def no #{h["}"]}
  def nope"
    sql = <<~SQL
      def never
    SQL
  end
end
''',
        [(5, None, "class", "Box", True, None), (6, None, "def", "get", True, None)],
        [("rb", "require", "json")],
    ),
]


def _sources(spark, sf_dir):
    docs = R.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    pick = (F.col("doc_id") % len(SAMPLES) + 1).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), pick)
    mark = F.concat(of([s.comment for s in SAMPLES]), F.lit(" "))
    said = F.concat(mark, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    path = F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), of([s.ext for s in SAMPLES]))
    return docs.select(
        F.col("source").alias("repo"), F.lit("head").alias("snapshot"), path.alias("path"),
        F.concat_ws("\n", said, of([s.body for s in SAMPLES])).alias("text"),
    )


_FILES = (
    f"d AS (SELECT source AS repo, doc_id % {len(SAMPLES)} AS sample, 'src/m' || doc_id || CASE doc_id % {len(SAMPLES)} "
    + " ".join(f"WHEN {n} THEN '{s.ext}'" for n, s in enumerate(SAMPLES))
    + " END AS path, coalesce(len(string_split(text, chr(10))), 0) AS c FROM documents WHERE doc_id IS NOT NULL)"
)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else str(value).lower()


_SYMBOLS = ", ".join(f"({n}, {', '.join(map(_sql, row))})" for n, s in enumerate(SAMPLES) for row in s.symbols)
_IMPORTS = ", ".join(f"({n}, {k}, {', '.join(map(_sql, row))})" for n, s in enumerate(SAMPLES) for k, row in enumerate(s.imports))


@checked(
    f"""
WITH {_FILES}, s(sample, line_start, line_end, kind, name, public, parent) AS (VALUES {_SYMBOLS})
SELECT repo, path, c + s.line_start AS line_start, c + s.line_end AS line_end, kind, name, public, parent FROM d JOIN s USING (sample)
"""
)
def masked_symbols(spark, sf_dir):
    """Symbols and spans of twelve kinds of files: nothing in a comment, string or template counts."""
    found = symbols.symbols(_sources(spark, sf_dir))
    return found.select("repo", "path", "line_start", "line_end", "kind", "name", "public", "parent")


@checked(f"WITH {_FILES}, i(sample, ord, lang, form, spec) AS (VALUES {_IMPORTS}) SELECT repo, path AS src, lang, form, spec, ord FROM d JOIN i USING (sample)")
def masked_imports(spark, sf_dir):
    """Imports of the same files, none of them from a comment or a text of several lines."""
    found = imports.by_pattern(_sources(spark, sf_dir))
    return found.select("repo", "src", "lang", "form", "spec", "ord")
