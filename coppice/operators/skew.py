"""Joins and rankings that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coppice.session import cut, short_tasks


def _salt(spread: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is done by merge and never sends a side whole to the driver.

    Spark broadcasts by the bytes of written files.  Names that repeat pack thirty
    times smaller and an explode counts for nothing there, so what passes as 10 MB
    can be more than a driver holds.  For sides that grow with the input.
    """
    return df.hint("merge")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    salts: int = 16,
    condition: Column | None = None,
    grows: bool = False,
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    For a ``small`` side that is cheap to repeat (a row per repository, per
    rule, per directory with rules).  Whether it is small enough to broadcast
    is left to Spark's size check, which does not see the salts: a side that
    ``grows`` with the input is merged.
    """
    left = big.withColumn("_salt", _salt(spread, salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = by_merge(right) if grows else right
    keys = [*on, "_salt"]
    if condition is None:
        return left.join(right, keys, how).drop("_salt")
    left, right = left.alias("l"), right.alias("r")
    same = condition
    for key in keys:
        same = same & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    rest = [F.col(f"r.{c}") for c in small.columns if c not in on]
    rest = rest if how in ("inner", "left") else []
    return left.join(right, same, how).select(*[F.col(f"l.{c}") for c in big.columns], *rest)


def skew_join(
    big: DataFrame,
    other: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
    salts: int = 32,
    hot_keys: int = 64,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that repeats ``other`` for the hottest keys of ``big`` only.

    The ``hot_keys`` most frequent keys are found with a map-side combined
    count; that list has a fixed length, so it can be broadcast.  Which keys
    are on it has no bearing on the result.  The count reads ``big`` once more;
    ``counted`` (the keys and a ``count``) saves that where it is known.
    """
    counts = big.groupBy(*on).count() if counted is None else counted
    hot = (
        counts
        .orderBy(F.col("count").desc(), *on)
        .limit(hot_keys)
        .select(*on, F.lit(True).alias("_hot"))
    )
    left = big.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), _salt(spread, salts)).otherwise(0)
    )
    last = F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(0)
    right = other.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), last))
    )
    return left.drop("_hot").join(by_merge(right.drop("_hot")), [*on, "_salt"], how).drop("_salt")


def tasks_for(measured: DataFrame, size: Column, per_task: int = 8 << 20) -> int:
    """As many tasks as the sum of ``size`` over ``measured`` asks for."""
    total = measured.agg(F.sum(size.cast("long"))).first()[0] or 0
    return max(measured.sparkSession.sparkContext.defaultParallelism, -(-total // per_task))


def by_size(df: DataFrame, by: list[str], measured: DataFrame, size: Column, per_task: int = 8 << 20) -> DataFrame:
    """``df`` by the keys ``by`` in as many partitions as the input's ``size`` asks for.

    Partitions that Spark puts together by their written bytes can hold much
    more than that once they are read: lines of one file repeat its key, which
    packs well.  Here their number follows the sum of ``size`` over ``measured``,
    so what a window has to sort in one task stays the same as the input grows.
    ``by`` may be a part of the windows' keys; a constant among them would make
    Spark shuffle once more.
    """
    return df.repartition(tasks_for(measured, size, per_task), *by)


def spread_join(
    big: DataFrame, other: DataFrame, on: list[str], spread: list[str], how: str = "inner", per_task: int = 1 << 18
) -> tuple[DataFrame, int]:
    """Equi-join in as many tasks as its result has rows for, and their number.

    Each key counts with the rows it makes (those of ``big`` times those of
    ``other``); one that makes more than ``per_task`` is dealt over as many
    salts as that asks for.  There are at most so many of these keys as there are
    tasks, so they can be broadcast.  Both sides are read once more for the
    counts: pass written frames.
    """
    others = other.groupBy(*on).agg(F.count("*").alias("_m"))
    made = big.groupBy(*on).agg(F.count("*").alias("_n")).join(by_merge(others), on, "left")
    made = made.select(*on, (F.col("_n") * F.coalesce("_m", F.lit(1))).alias("_rows"))
    hot = F.when(F.col("_rows") > per_task, F.struct(*on))
    with short_tasks(big.sparkSession):
        sums = cut(made.groupBy(hot.alias("_key")).agg(F.sum("_rows").alias("_rows")), "made")
    total = sums.agg(F.sum("_rows")).first()[0] or 0
    tasks = max(big.sparkSession.sparkContext.defaultParallelism, -(-total // per_task))
    salts = F.broadcast(
        sums.where(F.col("_key").isNotNull()).select("_key.*", F.ceil(F.col("_rows") / per_task).cast("int").alias("_salts"))
    )
    # What has no key finds nothing and can lie anywhere.
    loose = F.lit(False)
    for key in on:
        loose = loose | F.col(key).isNull()
    salted = F.when(loose, F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = big.join(salts, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salted.cast("long")).cast("int")).drop("_salts")
    last = F.coalesce("_salts", F.lit(1)) - 1
    right = other.join(salts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
    keys = [*on, "_salt"]
    joined = left.repartition(tasks, *keys).join(by_merge(right.repartition(tasks, *keys)), keys, how).drop("_salt")
    return joined, tasks


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group.

    Spark cuts each map task's rows to ``n`` per group before the shuffle, so a
    hot group sends at most ``n`` rows per task.  That holds up to a limit of
    1000; past it the groups are numbered by ``numbered`` instead.
    """
    if n > 1000:
        return numbered(df, by, order, name).where(F.col(name) <= n)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(
        F.col(name) <= n
    )


def _slices(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` in ranges of ``by, order`` of about equal size, the range in ``_slice``.

    Written out, because both the totals and the rows have to see the same
    ranges even when a task runs twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in by], *order)
    return cut(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def running(
    df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]
) -> DataFrame:
    """Running totals over ordered groups of any size.

    A window over one group runs in one task.  Here every group is cut into
    ranges; totals of the ranges before are added to a window inside the range.
    ``order`` has to be total within a group.
    """
    sliced = _slices(df, by, order)
    here = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(value).alias(f"_t_{name}") for name, value in sums.items()]
    )
    offsets = totals.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    local = sliced.withColumns({f"_l_{n}": F.sum(v).over(here) for n, v in sums.items()})
    joined = local.join(by_merge(offsets), [*by, "_slice"])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` over ordered groups of any size."""
    return running(df, by, order, {name: F.lit(1).cast("long")})
