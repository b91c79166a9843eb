"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from coppice.plans import views
from coppice.session import cut


@dataclass(frozen=True)
class Checked:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Checked] = {}


def checked(sql: str | None = None):
    """Register a query under its function's name.

    ``sql`` may use ``@FILES`` and the other views of ``coppice.plans.views``.
    """

    def add(function):
        text = None if sql is None else expanded(sql)
        QUERIES[function.__name__] = Checked(function, text)
        return function

    return add


def expanded(sql: str) -> str:
    names = ["FILES_B", "FILES", "TREE", "RULES", "COMMIT_FILES", "COMMITS", "EDGES", "PAGES", "TURNS", "CODE"]
    for name in names:
        sql = sql.replace(f"@{name}", f"({views.for_duckdb(getattr(views, name))})")
    return sql


_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, whole, written once per session as any input table would be.

    Without that, Spark would fold a view's long expressions into every use of
    its columns.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut(views.for_spark(spark, sf_dir, getattr(views, name)), name.lower())
    return _WRITTEN[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces for the checking engine.
def above(path: str = "path") -> str:
    """List of directories above a path, root first."""
    return (
        f"list_concat([''], list_transform(range(1, len(string_split({path}, '/'))), "
        f"lambda i: array_to_string(string_split({path}, '/')[1:i], '/')))"
    )


def name_of(path: str = "path") -> str:
    return f"list_extract(string_split({path}, '/'), -1)"


def parent_of(path: str = "path") -> str:
    return f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '' END"


def ext_of(path: str = "path") -> str:
    return f"lower(regexp_extract({name_of(path)}, '^\\.*[^.].*?(\\.[^.]*)$', 1))"


def others(text: str = "text") -> str:
    return f"length(regexp_replace({text}, '[\\x00-\\x7F]+', '', 'g'))"


def estimate(ascii_chars: str, other: str) -> str:
    return (
        f"CASE WHEN ({ascii_chars}) + ({other}) = 0 THEN 0 ELSE greatest(1, "
        f"cast(round_even(({ascii_chars}) / 4.0::DOUBLE + ({other}) / 1.5::DOUBLE, 0) AS bigint)) END"
    )


def tokens_of(text: str = "text") -> str:
    return estimate(f"length({text}) - {others(text)}", others(text))


def lines_of(text: str = "text") -> str:
    breaks = f"length({text}) - length(replace({text}, chr(10), ''))"
    return f"CASE WHEN {text} = '' THEN 0 WHEN {text} LIKE '%' || chr(10) THEN {breaks} ELSE {breaks} + 1 END"


def size_label(n: str, partial: str = "false") -> str:
    plus = f"CASE WHEN {partial} THEN '+' ELSE '' END"

    def unit(factor: int, name: str) -> str:
        number = f"regexp_replace(printf('%.2f', ({n}) / {factor}.0::DOUBLE), '\\.?0+$', '')"
        return f"WHEN ({n}) >= {factor} THEN {number} || {plus} || ' {name}'"

    return (
        f"CASE WHEN ({n}) = 0 THEN '0' || {plus} || ' bytes' "
        f"{unit(1 << 40, 'TB')} {unit(1 << 30, 'GB')} {unit(1 << 20, 'MB')} {unit(1 << 10, 'KB')} "
        f"ELSE cast(({n}) AS varchar) || {plus} || CASE WHEN ({n}) = 1 AND NOT ({partial}) THEN ' byte' ELSE ' bytes' END END"
    )


def token_label(n: str) -> str:
    number = f"regexp_replace(printf('%.1f', ({n}) / 1000.0::DOUBLE), '\\.?0+$', '')"
    return f"CASE WHEN ({n}) >= 1000 THEN '~' || {number} || 'K tok' ELSE '~' || cast(({n}) AS varchar) || ' tok' END"


def fold(text: str) -> str:
    return f"lower(replace(replace({text}, 'ß', 'ss'), 'ẞ', 'ss'))"
