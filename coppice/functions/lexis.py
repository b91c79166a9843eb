"""Comments and strings of source texts, told from code by one scanner per language.

A scanner is a regular expression for the next comment, string or other
literal.  Read from left to right it decides what each mark belongs to: a
comment's sign in a string is text, a quote in a comment as well.  Nesting
(comments in comments, strings in what a string puts in) is written out to a
fixed depth, beyond which a token ends where its outermost part seems to.

All loops are possessive, since Java's regular expressions recurse in others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands around the tokens while a text is read.
MARK = "\x02"
#: Starts a line that lies in a string, in masked text.
INSIDE = "\x01"

DOUBLE = r'"(?:[^"\\\n]++|\\.)*+"'
SINGLE = r"'(?:[^'\\\n]++|\\.)*+'"
DOUBLE_LONG = r'"(?:[^"\\]++|\\.)*+"'
SINGLE_LONG = r"'(?:[^'\\]++|\\.)*+'"
TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+"""'
TRIPLE_RAW = r'"""(?:[^"]++|"(?!""))*+"""'
TO_END = r"//[^\n]*+"
BLOCK = r"/\*(?:[^*]++|\*(?!/))*+\*/"
# A sign between single quotes, which also open lifetimes and labels.
SIGN = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9})'"


def _nested_comment(depth: int) -> str:
    inner = "" if depth == 0 else "|" + _nested_comment(depth - 1)
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+\*/"


def _put_in(opening: str, closing: str, strings: str, depth: int = 2) -> str:
    """What stands between a pair of brackets, with strings and pairs of the same brackets in it."""
    inner = "" if depth == 0 else "|" + _put_in(opening, closing, strings, depth - 1)
    return rf"\{opening}(?:[^\{opening}\{closing}\"'`]++|{strings}{inner})*+\{closing}"


def _template(depth: int) -> str:
    """A template literal of JavaScript; its fields may hold strings and templates."""
    strings = f"{DOUBLE}|{SINGLE}" + ("" if depth == 0 else "|" + _template(depth - 1))
    return rf"`(?:[^`\\$]++|\\.|\$(?!\{{)|\${_put_in('{', '}', strings)})*+`"


BLOCK_NESTED = _nested_comment(3)
# A slash opens a regular expression where a value may stand.
PATTERN = (
    r"(?<=(?:\A|[(,=:\[!&|?{;+*%~^\n-]|\breturn|\btypeof|\bcase)[ \t]{0,8})"
    r"/(?![/*])(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/"
)
_FIELD = _put_in("{", "}", f"{DOUBLE}|{SINGLE}")

#: Scanner per extension.
TOKENS: dict[str, str] = {}


def _language(exts: list[str], first: str, *tokens: str) -> None:
    """``first`` lists the signs a token may start with: elsewhere the others are not tried."""
    for ext in exts:
        TOKENS[ext] = rf"(?s)(?=[{first}])(?:{'|'.join(tokens)})"


_language(
    [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"],
    r"/\"'`", TO_END, BLOCK, DOUBLE, SINGLE, _template(2), r"`(?:[^`\\]++|\\.)*+`", PATTERN,
)
_language([".go"], r"/\"'`", TO_END, BLOCK, DOUBLE, r"`[^`]*+`", SIGN)
_language([".rs"], r"/\"'bcr", TO_END, BLOCK_NESTED, r'\b[bc]?r(?<hashes>#*)".*?"\k<hashes>', DOUBLE_LONG, SIGN)
_language([".c", ".h"], r"/\"'", TO_END, BLOCK, DOUBLE, SINGLE)
_language([".java"], r"/\"'", TO_END, BLOCK, TRIPLE, DOUBLE, SINGLE)
_language(
    [".cs"],
    r"/\"'@$", TO_END, BLOCK, r'(?:@\$?|\$@)"(?:[^"]++|"")*+"', TRIPLE_RAW, rf'\$"(?:[^"\\{{\n]++|\\.|\{{\{{|{_FIELD}|\{{)*+"', DOUBLE, SINGLE,
)
_language([".kt", ".kts"], r"/\"'", TO_END, BLOCK_NESTED, TRIPLE_RAW, rf'"(?:[^"\\$\n]++|\\.|\${_FIELD}|\$)*+"', SIGN)
_language(
    [".swift"],
    r"/\"#", TO_END, BLOCK_NESTED, r'(?<hashes>#+)".*?"\k<hashes>', TRIPLE, rf'"(?:[^"\\\n]++|\\{_put_in("(", ")", DOUBLE)}|\\.)*+"',
)
_language(
    [".php"],
    r"#/<\"'?", r"#(?!\[)[^\n]*+", TO_END, BLOCK, r"<<<[ \t]*(?<quote>[\"']?)(?<word>\w+)\k<quote>\r?\n.*?\n?[ \t]*\k<word>\b", DOUBLE_LONG, SINGLE_LONG,
    r"\?>(?:[^<]++|<(?!\?))*+(?:<\?(?:php|=)?|\z)",
)
_language(
    [".rb"],
    r"=_#<\"'%", r"(?m:^=begin\b.*?^=end\b[^\n]*+)", r"(?m:^__END__$.*+)", r"#[^\n]*+",
    r"<<[~-]?(?<quote>[\"'`]?)(?<word>[A-Z_]\w*)\k<quote>[^\n]*+\n.*?\n?[ \t]*\k<word>\b",
    rf'"(?:[^"\\#]++|\\.|#{_FIELD}|#)*+"', SINGLE_LONG,
    r"(?<![\w)])%[qQwWiI]?(?:\([^()]*+\)|\[[^\[\]]*+\]|\{[^{}]*+\})",
)

COMMENTS = ["//", "/*", "#", "=begin", "__END__"]


def masked(text: Column, scanner: str, left: Callable[[Column], Column]) -> Column:
    """The text with what is ``left`` of each token that the scanner finds."""
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), f"({scanner})", f"{MARK}$1{MARK}")
    pieces = F.transform(F.split(marked, MARK), lambda piece, n: F.when(n % 2 == 1, left(piece)).otherwise(piece))
    return F.array_join(pieces, "")


def breaks(token: Column, mark: str = "") -> Column:
    """The line breaks of a token, with a mark at the start of the lines it reaches into."""
    return F.regexp_replace(F.regexp_replace(token, r"\A[^\n]*+", ""), r"\n[^\n]*+", "\n" + mark)


def _is_comment(token: Column) -> Column:
    # A string of hashes before a quote is a raw string; a regular expression never starts like a comment.
    starts = F.lit(False)
    for sign in COMMENTS:
        starts = starts | F.startswith(token, F.lit(sign))
    return starts & ~token.rlike(r'\A#+"')


def emptied(token: Column, comment: Column) -> Column:
    """Nothing of a comment and the quotes of anything else, line breaks apart."""
    one_line = ~F.contains(token, F.lit("\n"))
    return (
        F.when(comment, F.when(one_line, "").otherwise(breaks(token)))
        .when(one_line, '""')
        .otherwise(F.concat(F.lit('""'), breaks(token, INSIDE)))
    )


def _emptied(token: Column) -> Column:
    return emptied(token, _is_comment(token))


def _named(token: Column) -> Column:
    plain = (F.startswith(token, F.lit('"')) | F.startswith(token, F.lit("'"))) & ~F.contains(token, F.lit("\n"))
    return F.when(plain, token).otherwise(_emptied(token))


def _by_language(ext: Column, text: Column, left: Column, exts: list[str]) -> Column:
    out = None
    for scanner in dict.fromkeys(TOKENS[e] for e in exts if e in TOKENS):
        here = ext.isin([e for e in exts if TOKENS.get(e) == scanner])
        value = masked(text, scanner, left)
        out = F.when(here, value) if out is None else out.when(here, value)
    return text if out is None else out.otherwise(text)


def code(ext: Column, text: Column, exts: list[str] | None = None) -> Column:
    """The text line for line without comments and without the insides of strings and other literals."""
    return _by_language(ext, text, _emptied, list(TOKENS) if exts is None else exts)


def statements(ext: Column, text: Column, exts: list[str] | None = None) -> Column:
    """The text line for line without comments, and with strings of one line only, which may name a file."""
    return _by_language(ext, text, _named, list(TOKENS) if exts is None else exts)
