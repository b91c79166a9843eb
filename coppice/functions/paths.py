"""Path, glob and module-name expressions over ``/``-separated relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_parts(path: Column, count: Column) -> Column:
    return F.call_function("substring_index", path, F.lit("/"), count)


def components(path: Column) -> Column:
    """Names along the path; the root ``''`` has none."""
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def depth(path: Column) -> Column:
    """Number of names in the path: 0 for the root, 1 for its children."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "", F.lit(0)).otherwise(slashes + 1)


def ancestors(path: Column) -> Column:
    """Every directory above ``path``, the root ``''`` first."""
    n = depth(path)
    above = F.transform(F.sequence(F.lit(1), n - 1), lambda i: _first_parts(path, i.cast("int")))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n == 1, F.array(F.lit("")))
        .otherwise(F.concat(F.array(F.lit("")), above))
    )


def self_and_ancestors(path: Column) -> Column:
    return F.concat(ancestors(path), F.array(path))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Text before the last ``/``, or ``''``."""
    return F.when(
        F.contains(path, F.lit("/")),
        F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1),
    ).otherwise("")


def suffix(name: Column) -> Column:
    """Extension with its dot, as written.  Leading dots do not start one."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def ext(name: Column) -> Column:
    return F.lower(suffix(name))


def normpath(path: Column) -> Column:
    """Resolve ``.``, ``..`` and doubled slashes without touching a disk."""
    rooted = F.startswith(path, F.lit("/"))

    def step(acc: Column, name: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return (
            F.when(name.isin("", "."), acc)
            .when(name != "..", F.concat(acc, F.array(name)))
            .when(can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(rooted, acc)
            .otherwise(F.concat(acc, F.array(name)))
        )

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(kept, "/")
    return (
        F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)
    )


def join(base: Column, target: Column) -> Column:
    return F.when(F.startswith(target, F.lit("/")) | (base == ""), target).otherwise(
        F.concat(base, F.lit("/"), target)
    )


def relative_to(path: Column, start: Column) -> Column:
    """``path`` seen from directory ``start``, by their common leading names."""
    there, here = components(path), components(start)
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(there), F.size(here)))),
        F.lit(0),
        lambda n, i: F.when(
            (n == i - 1) & F.equal_null(F.try_element_at(there, i), F.try_element_at(here, i))
            & F.try_element_at(there, i).isNotNull(),
            i,
        ).otherwise(n),
    )
    up = F.array_repeat(F.lit(".."), F.size(here) - shared)
    down = F.slice(there, shared + 1, F.size(there))
    joined = F.array_join(F.concat(up, down), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def strip_prefix(path: Column, prefix: Column) -> Column:
    """Path below ``prefix`` (which ends in ``/``); null when it lies outside."""
    return F.when(prefix == "", path).when(
        F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    )


def strip(text: Column) -> Column:
    """Trim Unicode blanks and the four separator control codes at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def truncate(text: Column, n: int) -> Column:
    """First ``n`` code points, with an ellipsis when something was cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


# Letters whose full case folding differs from lower-casing.
CASE_FOLDS = {
    "ß": "ss",
    "ẞ": "ss",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬀ": "ff",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "µ": "μ",
}


def casefold(text: Column) -> Column:
    """Key for name order that ignores case."""
    folded = text
    for letter, full in CASE_FOLDS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(full))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(folded))


def _quoted(char: Column) -> Column:
    return F.when(char.rlike(r"^[A-Za-z0-9_]$") | (F.octet_length(char) > 1), char).otherwise(
        F.concat(F.lit("\\"), char)
    )


def _char_class(token: Column) -> Column:
    negated = F.startswith(token, F.lit("[!"))
    body = F.substring(token, F.when(negated, 3).otherwise(2), F.length(token))
    body = F.substring(body, F.lit(1), F.length(body) - 1)

    def member(m: Column) -> Column:
        low, high = F.left(m, F.lit(1)), F.right(m, F.lit(1))
        return (
            F.when(F.length(m) == 1, _quoted(m))
            .when(low <= high, F.concat(_quoted(low), F.lit("-"), _quoted(high)))
            .otherwise("")
        )

    members = F.array_join(
        F.transform(F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), 1), member), ""
    )
    return (
        F.when(members == "", F.when(negated, F.lit(".")).otherwise(F.lit("(?!)")))
        .when(negated, F.concat(F.lit("[^"), members, F.lit("]")))
        .otherwise(F.concat(F.lit("["), members, F.lit("]")))
    )


def glob_to_regex(glob: Column) -> Column:
    """Whole-string regex for a glob whose ``*`` also crosses ``/``.

    ``?`` is one character, ``[a-z]``/``[!x]`` are classes, a ``]`` right after
    the opening is a member, and a ``[`` that is never closed stands for itself.
    """
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)(\[!?+\]?+[^\]]*\]|.)"), 1)
    translated = F.transform(
        tokens,
        lambda t: F.when(t == "*", F.lit(".*"))
        .when(t == "?", F.lit("."))
        .when(F.length(t) > 1, _char_class(t))
        .otherwise(_quoted(t)),
    )
    return F.concat(F.lit(r"(?s)\A"), F.array_join(translated, ""), F.lit(r"\z"))


def regex_of_glob(glob: str) -> str:
    """``glob_to_regex`` for a glob known when the plan is made: a literal pattern."""

    def char_class(token: str) -> str:
        negated = token.startswith("[!")
        body = token[2 if negated else 1 : -1]
        members = [
            f"{re.escape(m[0])}-{re.escape(m[-1])}" if len(m) > 1 else re.escape(m)
            for m in re.findall(r"(?s).-.|.", body)
            if len(m) == 1 or m[0] <= m[-1]
        ]
        if not members:
            return "." if negated else "(?!)"
        return f"[{'^' if negated else ''}{''.join(members)}]"

    out = []
    for token in re.findall(r"(?s)\[!?+\]?+[^\]]*\]|.", glob):
        if len(token) > 1:
            out.append(char_class(token))
        else:
            out.append({"*": ".*", "?": "."}.get(token, re.escape(token)))
    return r"(?s)\A" + "".join(out) + r"\z"


def star_match(pattern: Column, spec: Column) -> Column:
    """What the one ``*`` of ``pattern`` stands for in ``spec``; null if no match."""
    at = F.locate("*", pattern)
    head = F.substring(pattern, F.lit(1), at - 1)
    tail = F.substring(pattern, at + 1, F.length(pattern))
    fits = (
        (F.length(spec) >= F.length(head) + F.length(tail))
        & F.startswith(spec, head)
        & F.endswith(spec, tail)
    )
    middle = F.substring(spec, F.length(head) + 1, F.length(spec) - F.length(head) - F.length(tail))
    return F.when(at > 0, F.when(fits, middle)).when(pattern == spec, F.lit(""))


def python_module(path: Column) -> Column:
    """``a/b/__init__.py`` -> ``a.b``; ``a/b.py`` -> ``a.b``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"(\A|/)__init__\.py\z", ""), r"\.py\z", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def rust_module(path: Column, crate_root: Column) -> Column:
    """Module path inside the crate, ``::``-joined; ``''`` is the crate root.

    Null for files outside the crate's ``src/``.
    """
    local = strip_prefix(
        path, F.when(crate_root == "", F.lit("")).otherwise(F.concat(crate_root, F.lit("/")))
    )
    inner = F.regexp_extract(local, r"(?s)\Asrc/(.*)\.rs\z", 1)
    module = F.regexp_replace(inner, r"(\A|/)mod\z", "")
    return F.when(
        F.startswith(local, F.lit("src/")) & F.endswith(local, F.lit(".rs")),
        F.when(inner.isin("main", "lib"), F.lit("")).otherwise(
            F.replace(module, F.lit("/"), F.lit("::"))
        ),
    )
