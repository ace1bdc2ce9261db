"""Quantile portfolios and their performance.

After the labelled rows are averaged there is one row per (keys, period, quantile); the running
products and maxima below therefore walk at most one row per period.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigvane.operators.ic import period_column
from sigvane.operators.ordering import add_quantile_label


def assign_quantiles(
    df: DataFrame,
    signal: str,
    ties: Sequence[str],
    period_col: str = "quarter",
    quantiles: int = 5,
    label_col: str = "signal_quantile",
    min_rows: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Equal-frequency label per period, ties broken by ``ties``; thin or null periods get null."""
    period = period_column(df, period_col)
    return add_quantile_label(df, signal, ties, [*keys, period], quantiles, label_col, min_rows)


def quantile_returns(
    panel: DataFrame,
    signal: str,
    ties: Sequence[str],
    return_col: str = "fwd_return_1q",
    period_col: str = "quarter",
    quantiles: int = 5,
    keys: Sequence[str] = (),
) -> DataFrame:
    period = period_column(panel, period_col)
    labelled = assign_quantiles(panel, signal, ties, period, quantiles, keys=keys)
    valid = labelled.where(F.col("signal_quantile").isNotNull() & F.col(return_col).isNotNull())
    return valid.groupBy(*keys, F.col(period).alias("quarter"), "signal_quantile").agg(
        F.avg(return_col).alias("mean_return"), F.count(return_col).alias("n")
    )


def long_short_returns(
    returns: DataFrame, low_quantile: int = 1, high_quantile: int = 5, keys: Sequence[str] = ()
) -> DataFrame:
    """High minus low mean per period and its compounded path; no rows when an edge quantile never occurs."""

    def at(q: int):
        return F.max(F.when(F.col("signal_quantile") == q, F.col("mean_return")))

    wide = returns.groupBy(*keys, "quarter").agg(at(high_quantile).alias("long_return"), at(low_quantile).alias("short_return"))
    everything = Window.partitionBy(*(keys or [F.lit(0)]))
    wide = (
        wide.withColumn("_long", F.count("long_return").over(everything))
        .withColumn("_short", F.count("short_return").over(everything))
        .where((F.col("_long") > 0) & (F.col("_short") > 0))
        .drop("_long", "_short")
    )
    wide = wide.withColumn("long_short_return", F.col("long_return") - F.col("short_return"))
    path = everything.orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.product(1 + F.coalesce(F.col("long_short_return"), F.lit(0.0))).over(path)
    return wide.withColumn("cumulative_return", growth - 1)


def backtest_metrics(
    returns: DataFrame,
    return_col: str = "long_short_return",
    order_col: str = "quarter",
    periods_per_year: int = 4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Compounded, mean and annualized return, volatility, Sharpe, drawdown and hit rate, one row per key."""
    r = F.col(return_col).cast("double")
    walk = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.where(r.isNotNull()).select(*keys, order_col, r.alias("_r"), F.product(1 + r).over(walk).alias("_curve"))
    curve = curve.withColumn("_fall", F.col("_curve") / F.max("_curve").over(walk) - 1)
    agg = curve.groupBy(*keys).agg(
        (F.max_by("_curve", order_col) - 1).alias("cumulative_return"),
        F.avg("_r").alias("average_quarterly_return"),
        (F.pow(1 + F.avg("_r"), F.lit(periods_per_year)) - 1).alias("annualized_return"),
        (F.coalesce(F.stddev_samp("_r"), F.lit(0.0)) * math.sqrt(periods_per_year)).alias("_vol"),
        F.min("_fall").alias("max_drawdown"),
        F.avg((F.col("_r") > 0).cast("double")).alias("hit_rate"),
        F.count("_r").alias("number_of_rebalances"),
    )
    volatility = F.when(F.col("number_of_rebalances") > 0, F.col("_vol"))
    return agg.select(
        *keys,
        "cumulative_return",
        "average_quarterly_return",
        "annualized_return",
        volatility.alias("volatility"),
        F.when(volatility > 0, F.col("annualized_return") / volatility).alias("sharpe_ratio"),
        "max_drawdown",
        "hit_rate",
        "number_of_rebalances",
    )


def small_periods(panel: DataFrame, signal: str, return_col: str, period_col: str = "quarter", quantiles: int = 5) -> DataFrame:
    """Periods with too few complete rows for the quantiles, with the warning text."""
    period = period_column(panel, period_col)
    valid = panel.where(F.col(signal).isNotNull() & F.col(return_col).isNotNull() & F.col(period).isNotNull())
    counts = valid.groupBy(F.col(period).alias("quarter")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < quantiles)
    return counts.withColumn("warning", F.lit(f"not enough observations for {quantiles} quantiles"))


@dataclass(frozen=True)
class QuantileBacktest:
    assigned: DataFrame
    quantile_returns: DataFrame
    long_short: DataFrame
    metrics: DataFrame
    warnings: DataFrame


def run_quantile_backtest(
    panel: DataFrame,
    signal: str,
    ties: Sequence[str],
    return_col: str = "fwd_return_1q",
    period_col: str = "quarter",
    quantiles: int = 5,
) -> QuantileBacktest:
    """Labels, quantile returns, long-short path and metrics on the rows complete in signal and return."""
    period = period_column(panel, period_col)
    valid = panel.where(F.col(signal).isNotNull() & F.col(return_col).isNotNull())
    assigned = assign_quantiles(valid, signal, ties, period, quantiles)
    labelled = assigned.where(F.col("signal_quantile").isNotNull())
    returns = labelled.groupBy(F.col(period).alias("quarter"), "signal_quantile").agg(
        F.avg(return_col).alias("mean_return"), F.count(return_col).alias("n")
    )
    long_short = long_short_returns(returns)
    return QuantileBacktest(
        assigned, returns, long_short, backtest_metrics(long_short), small_periods(panel, signal, return_col, period, quantiles)
    )
