"""Ranks, quantile labels and exact quantiles that never put a whole group into one task.

A window over ``sector`` or ``quarter`` would sort a third of the table in one task when one sector
holds a third of the rows.  Ranks and labels are built from ``prefix_sums`` instead: rows are
range-partitioned on (group, value), each range is summed on its own, and only the per-range totals
(one row per group and range) are scanned in order.  Quantiles need a few places of the order only and are
narrowed down by counting into bins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane import runtime


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right key columns are dropped."""
    renamed = right.selectExpr(*[f"`{k}` AS `_r_{k}`" for k in keys], *[f"`{c}`" for c in right.columns if c not in keys])
    condition = F.expr(" AND ".join(f"`{k}` <=> `_r_{k}`" for k in keys))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def prefix_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    weight: str | None = None,
    before: str = "before",
    total: str = "total",
) -> DataFrame:
    """Add, per ``by`` group, the weight on rows ordered strictly earlier and the group's total weight.

    ``order`` must identify a row within its group.  Without ``weight`` every row counts one.  Adaptive
    execution may merge neighbouring ranges when they are small; equal keys always share a range.
    """
    by = list(by)
    weight_col = F.lit(1).cast("long") if weight is None else F.col(weight)
    ranged = runtime.materialize(
        df.withColumn("_w", weight_col)
        .repartitionByRange(*by, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    ranges = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_in_range"))
    # One row per group and range it reaches into.
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *by,
        "_range",
        F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_in_range").over(group).alias(total),
    )
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    joined = null_safe_join(local, ranges, [*by, "_range"])
    return joined.withColumn(before, F.col("_offset") + F.col("_local")).drop("_w", "_range", "_offset", "_local")


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): its ``count``, the rows ``before`` it and the group ``total``.

    Nulls have no rank and are left out.  Copies of a value collapse map-side before the shuffle.  The table
    is written once, since every join with it reads it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("count"))
    return runtime.materialize(prefix_sums(counts, by, [value], weight="count"))


def attach_by_key(df: DataFrame, table: DataFrame, keys: Sequence[str], unmatched: Sequence[str] = ()) -> DataFrame:
    """Left-join a unique-key ``table``; adaptive execution splits the rows of a hot key.

    Null keys match null entries, except in the ``unmatched`` columns, where the table has no null: such
    rows are spread over the shuffle.
    """
    keys = list(keys)
    payload = [c for c in table.columns if c not in keys]
    if not unmatched:
        return null_safe_join(df, table, keys, "left").select(*df.columns, *payload)
    everything = ", ".join(f"`{c}`" for c in df.columns)
    alone = " OR ".join(f"`{k}` IS NULL" for k in unmatched)
    marked = df.selectExpr("*", f"CASE WHEN {alone} THEN 1 + CAST(pmod(xxhash64({everything}), 4096) AS INT) ELSE 0 END AS _spread")
    return null_safe_join(marked, table.selectExpr("*", "0 AS _spread"), [*keys, "_spread"], "left").select(*df.columns, *payload)


def average_rank_expr(before: str = "before", count: str = "count") -> Column:
    return F.col(before) + (F.col(count) + 1) / F.lit(2.0)


def add_percentile_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank divided by the non-null count: 1/n to 1, null stays null."""
    table = value_ranks(df, by, value)
    table = table.select(*by, value, "count", (average_rank_expr() / F.col("total")).alias(out))
    return attach_by_key(df, table, [*by, value], unmatched=[value]).drop("count")


def add_percentile_ranks(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), suffix: str = "_rk") -> DataFrame:
    """Percentile ranks of several columns with one ordering job.

    The columns are unpivoted to (column, value) so one range-partitioned pass ranks all of them.
    """
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("_column"), F.col(v).cast("double").alias("_value")) for v in values])
        ).alias("_cell"),
    ).select(*by, "_cell._column", "_cell._value")
    table = value_ranks(long, [*by, "_column"], "_value")
    table = table.withColumn("_rank", average_rank_expr() / F.col("total"))
    out = df
    for v in values:
        part = table.where(F.col("_column") == v)
        part = part.select(*by, F.col("_value").alias("_key"), "count", F.col("_rank").alias(f"{v}{suffix}"))
        out = attach_by_key(out.withColumn("_key", F.col(v).cast("double")), part, [*by, "_key"], unmatched=["_key"])
        out = out.drop("count", "_key")
    return out


def quantile_label_expr(bins: Column, position: Column, size: Column) -> Column:
    """Equal-frequency bin of the 0-based ``position`` among ``size`` rows, in integer arithmetic."""
    span = F.greatest(size - 1, F.lit(1))
    ceiling = F.floor((position * bins + span - 1) / span)
    return F.greatest(F.lit(1), ceiling).cast("int")


def add_quantile_label(
    df: DataFrame,
    value: str,
    ties: Sequence[str],
    by: Sequence[str] = (),
    bins: int = 5,
    out: str = "signal_quantile",
    min_rows: int | None = None,
) -> DataFrame:
    """Label rows 1..bins by first-tie rank of ``value``; groups with fewer than ``min_rows`` get null.

    Rows with a null ``value`` or a null group are kept with a null label.
    """
    usable = F.col(value).isNotNull()
    for column in by:
        usable = usable & F.col(column).isNotNull()
    flagged = df.withColumn("_usable", usable)
    ordered = prefix_sums(flagged, [*by, "_usable"], [value, *ties], before="_position", total="_size")
    enough = F.col("_usable") & (F.col("_size") >= F.lit(min_rows or bins))
    label = quantile_label_expr(F.lit(bins), F.col("_position"), F.col("_size"))
    return ordered.withColumn(out, F.when(enough, label)).drop("_usable", "_position", "_size")


SELECTION_BINS = 4096
SELECTION_ROWS = 65_536


def _magnitude_bin(value: Column) -> Column:
    """A whole number that grows with ``value``: sixteen bins to an octave on both sides of zero, NaN last."""
    sign, end = F.signum(value).cast("int"), 1 << 20
    size = (F.floor((F.log2(F.abs(value)) + 1100) * 16) + 1).cast("int")
    return F.when(F.isnan(value), end + 1).when(F.abs(value) == float("inf"), sign * end).when(value == 0, 0).otherwise(sign * size)


def selected_values(
    df: DataFrame, by: Sequence[str], value: str, places: Callable[[Column], Sequence[Column]], stored: bool = False
) -> DataFrame:
    """The values at some places of each group's order, found without sorting the rows.

    ``places`` turns a group's number of non-null values into 0-based places.  Rows come back as (group, value as
    double, rows ``before`` it, its ``count``, the group's ``total``), one per distinct value at a wanted place; groups
    without values are left out.

    Rows are counted into bins by magnitude (at most 70 000 a group, summed map-side) and only those in a bin with
    a wanted place are read on; the input is never shuffled as a whole.  A bin of more than ``SELECTION_ROWS`` rows
    is cut into ``SELECTION_BINS`` between its least and its greatest value, which a double's 53 bits allow a few times.
    The (group, value) pairs are written once, so that all passes see the same numbers; ``stored`` says that
    ``df`` is a plain table and needs no copy.
    """
    by = list(by)

    def wanted(last: Column) -> Column:
        return reduce(Column.__or__, [(p >= F.col("before")) & (p <= last) for p in places(F.col("total"))])

    def placed(counts: DataFrame, order: str) -> DataFrame:
        inside = Window.partitionBy(*by, "_parent").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_parent") + F.coalesce(F.sum("count").over(inside), F.lit(0))
        return counts.withColumn("before", start).where(wanted(F.col("before") + F.col("count") - 1))

    numbers = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = (numbers if stored else runtime.written(numbers, "numbers")).select(
        "*", F.lit(0).cast("long").alias("_parent"), _magnitude_bin(F.col("_v")).alias("_bin"), F.lit(None).cast("long").alias("total")
    )
    whole = F.sum("count").over(Window.partitionBy(*(by or [F.lit(0)])))
    found, largest = [], SELECTION_ROWS + 1
    while largest > SELECTION_ROWS:
        bins = rows.groupBy(*by, "_parent", "_bin").agg(
            F.count(F.lit(1)).alias("count"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.max("total").alias("total")
        )
        bins = runtime.written(placed(bins.withColumn("total", F.coalesce("total", whole)), "_bin"), "bins")
        found.append(bins.where("_least = _most").select(*by, F.col("_least").alias(value), "before", "count", "total"))
        several = bins.where("_least < _most")
        largest = several.agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
        if largest:
            inside = null_safe_join(rows.drop("total"), several.drop("count"), [*by, "_parent", "_bin"])
            share = (F.col("_v") - F.col("_least")) / (F.col("_most") - F.col("_least"))
            finer = F.least(F.floor(share * SELECTION_BINS), F.lit(SELECTION_BINS - 1)).cast("int")
            rows = runtime.written(inside.select(*by, "_v", F.col("before").alias("_parent"), finer.alias("_bin"), "total"), "narrowed")
    if largest:
        counts = rows.groupBy(*by, "_parent", "_v", "total").agg(F.count(F.lit(1)).alias("count"))
        found.append(placed(counts, "_v").select(*by, F.col("_v").alias(value), "before", "count", "total"))
    return reduce(DataFrame.unionByName, found)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float], stored: bool = False) -> DataFrame:
    """Linearly interpolated exact quantiles, one row per group, one column per named probability.

    See ``selected_values`` for ``stored``.
    """

    def sides(p: float, total: Column) -> list[Column]:
        position = F.lit(p) * (total - 1)
        return [F.floor(position), F.ceil(position)]

    table = selected_values(df, by, value, lambda total: [x for p in probabilities.values() for x in sides(p, total)], stored)
    last = F.col("before") + F.col("count") - 1
    picks = []
    for name, p in probabilities.items():
        for side, index in zip(("lo", "hi"), sides(p, F.col("total")), strict=True):
            here = (index >= F.col("before")) & (index <= last)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
    grouped = table.groupBy(*by).agg(F.max("total").alias("_n"), *picks)
    columns = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return grouped.select(*by, *columns)
