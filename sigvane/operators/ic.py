"""Rank information coefficients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions.tails import correlation_pvalue
from sigvane.operators.ordering import add_percentile_ranks, attach_by_key, null_safe_join, prefix_sums
from sigvane.runtime import materialize, written

PAIRS_A_TASK = 1_000_000


def period_column(df: DataFrame, wanted: str) -> str:
    return "score_quarter" if wanted not in df.columns and "score_quarter" in df.columns else wanted


def available(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def unpivot_pairs(df: DataFrame, by: Sequence[str], signals: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Rows (by, signal, outcome, x, y), one per signal, outcome and input row."""
    return _name_pairs(_number_pairs(df, by, signals, outcomes), signals, outcomes)


def _number_pairs(df: DataFrame, by: Sequence[str], signals: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Rows (by, pair, x, y): the pair is a small number, so keys stay short in every shuffle."""
    cells = ", ".join(
        f"named_struct('pair', {i * len(outcomes) + j}, 'x', CAST(`{s}` AS DOUBLE), 'y', CAST(`{o}` AS DOUBLE))"
        for i, s in enumerate(signals)
        for j, o in enumerate(outcomes)
    )
    return df.select(*by, F.expr(f"explode(array({cells})) AS _cell")).select(*by, "_cell.*")


def _dealt(df: DataFrame, by: Sequence[str], signals: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """The columns wanted, in so many partitions that none of them makes many more than ``PAIRS_A_TASK`` pairs.

    A row makes a pair per signal and outcome, which are counted in memory before they are shuffled.
    """
    wanted = df.select(*dict.fromkeys([*by, *signals, *outcomes]))
    tasks = math.ceil(df.count() * len(signals) * len(outcomes) / PAIRS_A_TASK)
    return wanted.repartition(tasks) if tasks > df.sparkSession.sparkContext.defaultParallelism else wanted


def _name_pairs(df: DataFrame, signals: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    def names(values: Sequence[str]) -> str:
        return "array(" + ", ".join(f"'{v}'" for v in values) + ")"

    signal, outcome = f"{names(signals)}[pair DIV {len(outcomes)}] AS signal", f"{names(outcomes)}[pair % {len(outcomes)}] AS outcome"
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c != "pair"], signal, outcome)


def spearman(df: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", min_obs: int = 3) -> DataFrame:
    """Rank correlation per group: ``n_obs``, ``ic`` and ``status``; every group of ``df`` keeps its row.

    Ranks are taken on pair-complete rows.  Equal pairs collapse before anything is ranked, and the
    correlation is a weighted sum over distinct pairs, so no step holds a whole group.  The distinct pairs are
    written once, with one row for a group's incomplete ones, and ``df`` is read once.
    """
    by = list(by)
    if not by:
        return spearman(df.withColumn("_all", F.lit(0)), ["_all"], x, y, min_obs).drop("_all")
    complete = F.col(x).isNotNull() & F.col(y).isNotNull()
    masked = df.select(*by, F.when(complete, F.col(x)).alias("_x"), F.when(complete, F.col(y)).alias("_y"))
    everything = written(masked.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")), "pairs")
    known = F.col("_x").isNotNull()
    groups = everything.groupBy(*by).agg(F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("n_obs"))
    pairs = everything.where(known)
    sides = F.array(F.struct(F.lit("x").alias("side"), F.col("_x").alias("value")), F.struct(F.lit("y").alias("side"), F.col("_y").alias("value")))
    values = pairs.select(*by, "_n", F.explode(sides).alias("_v")).select(*by, "_n", "_v.*")
    counts = values.groupBy(*by, "side", "value").agg(F.sum("_n").alias("count"))
    ranks = materialize(prefix_sums(counts, [*by, "side"], ["value"], weight="count"))
    centred = F.col("before") + F.col("count") / F.lit(2.0) - F.col("total") / F.lit(2.0)
    for side, name in (("x", "_x"), ("y", "_y")):
        table = ranks.where(F.col("side") == side).select(
            *by, F.col("value").alias(name), "count", centred.alias(f"{name}_rank")
        )
        pairs = attach_by_key(pairs, table, [*by, name]).drop("count")
    rx, ry, n = F.col("_x_rank"), F.col("_y_rank"), F.col("_n")
    moments = pairs.groupBy(*by).agg(
        F.sum(n * rx * ry).alias("_xy"), F.sum(n * rx * rx).alias("_xx"), F.sum(n * ry * ry).alias("_yy")
    )
    joined = null_safe_join(groups, moments, by, "left")
    too_few = F.col("n_obs") < min_obs
    constant = (F.col("_xx") <= 0) | (F.col("_yy") <= 0)
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return joined.select(
        *by,
        "n_obs",
        F.when(~too_few & ~constant, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("ic"),
        F.when(too_few, "too_few_obs").when(constant, "constant_input").otherwise("ok").alias("status"),
    )


def ic_by_quarter(
    panel: DataFrame,
    signals: Sequence[str] = K.DEFAULT_SIGNALS,
    outcomes: Sequence[str] = K.IC_OUTCOMES,
    quarter_col: str = "quarter",
    min_obs: int = 3,
) -> DataFrame:
    """IC, p-value and status for every (signal, outcome, quarter); a null quarter is a group."""
    quarter = period_column(panel, quarter_col)
    signals, outcomes = available(panel, signals), available(panel, outcomes)
    dealt = _dealt(panel.withColumn("quarter", F.col(quarter)), ["quarter"], signals, outcomes)
    long = _number_pairs(dealt, ["quarter"], signals, outcomes)
    result = _name_pairs(spearman(long, ["pair", "quarter"], min_obs=min_obs), signals, outcomes)
    return result.withColumn("p_value", correlation_pvalue("ic", "n_obs"))


def ic_by_period(panel: DataFrame, signal: str, outcome: str, period_col: str = "score_quarter") -> DataFrame:
    result = ic_by_quarter(panel, [signal], [outcome], period_col)
    return result.withColumnsRenamed({"quarter": "period", "n_obs": "n"})


def summarize_ic(results: DataFrame) -> DataFrame:
    """Mean, median, spread, t and hit rate of the usable ICs per (signal, outcome), one row per quarter in."""
    ic = F.when(F.col("status") == "ok", F.col("ic"))
    summary = results.groupBy("signal", "outcome").agg(
        F.avg(ic).alias("mean_ic"),
        F.median(ic).alias("median_ic"),
        F.stddev_samp(ic).alias("_std"),
        F.avg((ic > 0).cast("double")).alias("positive_ic_hit_rate"),
        F.count(ic).alias("number_of_quarters"),
        F.sum("n_obs").alias("total_observations"),
    )
    spread = F.when(F.col("number_of_quarters") > 1, F.col("_std"))
    t = F.when(spread != 0, F.col("mean_ic") / (spread / F.sqrt("number_of_quarters")))
    return summary.select(
        "signal", "outcome", "mean_ic", "median_ic", spread.alias("ic_std"), t.alias("ic_t_stat"),
        "positive_ic_hit_rate", "number_of_quarters", "total_observations",
    )


def ic_matrix(df: DataFrame, signals: Sequence[str], outcomes: Sequence[str], min_obs: int = 10) -> DataFrame:
    """Pooled IC and p-value per (signal, outcome), with significance stars."""
    signals, outcomes = available(df, signals), available(df, outcomes)
    ranked = spearman(_number_pairs(_dealt(df, [], signals, outcomes), [], signals, outcomes), ["pair"], min_obs=min_obs)
    result = _name_pairs(ranked, signals, outcomes).withColumn("p_value", correlation_pvalue("ic", "n_obs"))
    p = F.col("p_value")
    stars = F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
    return result.withColumn("stars", stars)


def pivot_ic(results: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    return results.groupBy("signal").pivot("outcome", list(outcomes)).agg(F.first("ic"))


def pooled_sector_neutral_ic(df: DataFrame, signals: Sequence[str], outcome: str, sector: str = "sector", min_obs: int = 10) -> DataFrame:
    """One pooled IC of within-sector percentile ranks per signal (rows complete in signal, outcome, sector)."""
    long = unpivot_pairs(df.where(F.col(sector).isNotNull()), [sector], signals, [outcome])
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = add_percentile_ranks(long, ["x", "y"], by=["signal", sector])
    result = spearman(ranked.select("signal", F.col("x_rk").alias("x"), F.col("y_rk").alias("y")), ["signal"], min_obs=min_obs)
    return result.withColumn("p_value", correlation_pvalue("ic", "n_obs"))


def trend_line(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of ``y`` on ``x``."""
    x_col, y_col = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(y_col, x_col).alias("slope"),
        F.regr_intercept(y_col, x_col).alias("intercept"),
        F.regr_count(y_col, x_col).alias("n"),
    )


