"""What a listing costs in tokens, and cutting it to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.functions import measure
from coppice.operators.skew import running, salted_join
from coppice.schema import ENTRY, TREE
from coppice.session import cut

#: Details of a line, most first: all, without symbols, without annotations.
DETAILS = ["full", "plain", "bare"]
#: Depths tried in turn.
DEPTHS = [6, 5, 4, 3, 2, 1]


def line_costs(lines: DataFrame, text: str = "line") -> DataFrame:
    """ASCII and other characters of a line with its line feed."""
    other = measure.other_chars(F.col(text))
    return lines.withColumns(
        {
            "ascii_chars": (F.length(text) - other + 1).cast("long"),
            "other_chars": other.cast("long"),
        }
    )


def within_budget(
    rows: DataFrame, budget: int | Column, by: list[str], order: list[Column], text: str = "text"
) -> DataFrame:
    """Rows in order while their running token cost stays within the budget.

    Adds ``cost_so_far``.  Costs are character counts summed before they are
    turned into tokens, so the running cost is that of the joined text.
    """
    costed = line_costs(rows, text)
    summed = running(
        costed, by, order, {"_a": F.col("ascii_chars"), "_o": F.col("other_chars")}
    )
    cost = measure.tokens_of(F.col("_a"), F.col("_o"))
    return (
        summed.withColumn("cost_so_far", cost)
        .where(F.col("cost_so_far") <= budget)
        .drop("_a", "_o", "ascii_chars", "other_chars")
    )


def depth_costs(lines: DataFrame) -> DataFrame:
    """Tokens of the listing of each tree down to each depth.

    Lines are added up per depth first; what is left is a row per depth.
    """
    per_depth = (
        line_costs(lines)
        .groupBy(*TREE, "depth")
        .agg(F.sum("ascii_chars").alias("a"), F.sum("other_chars").alias("o"), F.count("*").alias("n"))
    )
    down = W.partitionBy(*TREE).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    return per_depth.select(
        *TREE,
        "depth",
        F.sum("n").over(down).alias("lines"),
        F.sum("a").over(down).alias("ascii_chars"),
        F.sum("o").over(down).alias("other_chars"),
    ).withColumn("tokens", measure.tokens_of(F.col("ascii_chars"), F.col("other_chars")))


def _at_depth(costs: DataFrame, depth: int | None) -> DataFrame:
    kept = costs if depth is None else costs.where(F.col("depth") <= depth)
    return kept.groupBy(*TREE).agg(F.max("tokens").alias("tokens"))


def estimate(full: DataFrame, bare: DataFrame, cap: int | None = None) -> DataFrame:
    """Tokens of a tree listing by level: bare at depth 1, then full at 1, 2, 3 and all.

    With a ``cap``, levels above it are marked and a budget is suggested.
    """
    levels = [("1 bare", 0, _at_depth(depth_costs(bare), 1))]
    costs = cut(depth_costs(full), "costs")
    levels += [(str(d), d, _at_depth(costs, d)) for d in (1, 2, 3)]
    levels.append(("all", 4, _at_depth(costs, None)))
    out = None
    for name, place, frame in levels:
        part = frame.select(*TREE, F.lit(place).alias("place"), F.lit(name).alias("level"), "tokens")
        out = part if out is None else out.unionByName(part)
    if cap is None:
        return out
    return out.withColumns(
        {
            "over_cap": F.col("tokens") > cap,
            "suggested": F.lit(max(cap - 5000, cap * 4 // 5)).cast("long"),
        }
    )


def choose_level(full: DataFrame, plain: DataFrame, bare: DataFrame, budget: int) -> DataFrame:
    """Per tree: the depth and detail that fit, and whether rows still have to go.

    All of it if that fits; else the largest depth of 6..1 that does; else depth
    1 without symbols; else depth 1 without annotations, cut if need be.
    """
    listings = zip(DETAILS, (full, plain, bare), strict=True)
    # A row per tree and depth: written, since every step below looks at it.
    costs = {detail: cut(depth_costs(frame), "costs") for detail, frame in listings}
    steps = [("full", None)] + [("full", d) for d in DEPTHS] + [("plain", 1), ("bare", 1)]
    out = None
    for rank, (detail, depth) in enumerate(steps):
        part = _at_depth(costs[detail], depth).select(
            *TREE,
            F.lit(rank).alias("rank"),
            F.lit(detail).alias("detail"),
            F.lit(depth).cast("int").alias("max_depth"),
            "tokens",
        )
        out = part if out is None else out.unionByName(part)
    last = len(steps) - 1
    fits = F.col("tokens") <= budget
    # The first that fits; without one, the last.
    order = F.when(fits, F.col("rank")).otherwise(F.lit(last + 1) + last - F.col("rank"))
    return (
        out.groupBy(*TREE)
        .agg(F.min_by(F.struct("detail", "max_depth", "tokens"), order).alias("_l"))
        .select(*TREE, "_l.detail", "_l.max_depth", "_l.tokens", (F.col("_l.tokens") > budget).alias("cut"))
    )


def fit(full: DataFrame, plain: DataFrame, bare: DataFrame, budget: int) -> DataFrame:
    """The listing of each tree cut to the budget, root line first and always kept.

    ``full``, ``plain`` and ``bare`` are ``tree_lines`` of the same entries at
    the three details.  ``left_out`` counts the lines of the chosen level that
    did not fit and ``level_cost`` what showing them all would take.
    """
    frames = [
        cut(frame.select(*ENTRY, "depth", "tree_key", "line"), "lines") for frame in (full, plain, bare)
    ]
    chosen = choose_level(*frames, budget)
    lines = None
    for detail, frame in zip(DETAILS, frames, strict=True):
        part = frame.withColumn("detail", F.lit(detail))
        lines = part if lines is None else lines.unionByName(part)
    level = chosen.withColumnRenamed("tokens", "level_cost")
    picked = salted_join(lines, level, [*TREE, "detail"], ["path"]).where(
        F.col("max_depth").isNull() | (F.col("depth") <= F.col("max_depth"))
    )
    costed = line_costs(picked)
    summed = running(
        costed,
        TREE,
        [F.col("tree_key"), F.col("path")],
        {"_a": F.col("ascii_chars"), "_o": F.col("other_chars"), "pos": F.lit(1).cast("long")},
    )
    kept = summed.where(
        (measure.tokens_of(F.col("_a"), F.col("_o")) <= budget) | (F.col("path") == "")
    )
    total = picked.groupBy(*TREE).agg(F.count("*").alias("_all"))
    shown = kept.groupBy(*TREE).agg(F.count("*").alias("_shown"))
    missing = total.join(shown, TREE).select(*TREE, (F.col("_all") - F.col("_shown")).alias("left_out"))
    return salted_join(kept, missing, TREE, ["path"]).select(
        *ENTRY, "detail", "max_depth", "pos", "line", "left_out", "level_cost"
    )
