"""Dataset summaries, sorts and coverage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane.functions.text import is_missing
from sigvane.operators.ordering import add_quantile_label, exact_quantiles, null_safe_join


def _distinct(df: DataFrame, name: str) -> Column:
    return F.countDistinct(name) if name in df.columns else F.lit(0).cast("long")


def _flags(df: DataFrame, name: str) -> Column:
    return F.count_if(F.col(name)) if name in df.columns else F.lit(0).cast("long")


def summarize_scores(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("ticker").alias("tickers"),
        F.countDistinct("company_id").alias("companies"),
        F.when(F.count("ticker") > 0, "ticker").otherwise("company_id").alias("identifier"),
        _flags(df, "available_at_assumption").alias("available_at_assumptions"),
    )


def summarize_financials(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("company_id").alias("companies"),
        F.countDistinct("fiscal_quarter").alias("quarters"),
    )


def summarize_prices(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("company_id").alias("companies"),
        F.countDistinct("price_quarter").alias("quarters"),
    )


def summarize_postings(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), _distinct(df, "company_id").alias("companies"), _distinct(df, "ticker").alias("tickers"),
        _flags(df, "is_ai_keyword_matched").alias("ai_keyword_count"), _flags(df, "is_likely_duplicate").alias("likely_duplicate_count"),
    )


def summarize_master(df: DataFrame) -> DataFrame:
    missing = F.count_if(is_missing(F.col("sector"))) if "sector" in df.columns else F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("companies"), F.countDistinct("ticker").alias("tickers"), _distinct(df, "cik").alias("ciks"),
        _distinct(df, "sector").alias("sectors"), missing.alias("missing_sector"),
    )


def summarize_panel(df: DataFrame, fields: Sequence[str] = ("fwd_return_1q", "fwd_return_2q", "future_revenue_growth_qoq", "prior_return_1q")) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), _distinct(df, "company_id").alias("companies"), _distinct(df, "score_quarter").alias("quarters"),
        _flags(df, "timing_violation").alias("timing_violations"),
        *[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields if f in df.columns],
    )


def sector_coverage(panel: DataFrame) -> DataFrame:
    """Entities per sector, a null sector included, largest first."""
    company = "company_id" if "company_id" in panel.columns else "ticker"
    counts = panel.groupBy("sector").agg(F.countDistinct(company).alias("company_count"))
    return counts.orderBy(F.desc("company_count"), "sector")


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count per variable, and the total."""
    present = [c for c in columns if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in present])
    return wide.unpivot([], ["total", *present], "variable", "rows")


def mean_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and count of the known values per key; rows without a key or value are left out."""
    rows = df.where(F.col(value).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def high_minus_low(
    df: DataFrame, score: str, value: str, high: Sequence[float] = (4, 5), low: Sequence[float] = (1, 2), by: Sequence[str] = ()
) -> DataFrame:
    """Difference of means of two score groups with Welch's t, for each value of ``by``."""

    def pick(values: Sequence[float]) -> Column:
        return F.when(F.col(score).isin(list(values)), F.col(value))

    stats = df.groupBy(*by).agg(
        *[
            agg(pick(v)).alias(f"_{name}_{side}")
            for side, v in (("hi", high), ("lo", low))
            for name, agg in (("m", F.avg), ("v", F.var_samp), ("n", F.count))
        ]
    )
    diff = F.col("_m_hi") - F.col("_m_lo")
    error = F.sqrt(F.try_divide("_v_hi", "_n_hi") + F.try_divide("_v_lo", "_n_lo"))
    return stats.select(*by, diff.alias("diff"), F.try_divide(diff, error).alias("t"), F.col("_n_hi").alias("n_hi"), F.col("_n_lo").alias("n_lo"))


def quantile_sort(df: DataFrame, score: str, value: str, ties: Sequence[str], bins: int = 5) -> DataFrame:
    """Mean and count of ``value`` per quantile of ``score`` on the complete rows, and top minus bottom."""
    rows = df.where(F.col(score).isNotNull() & F.col(value).isNotNull()).select(*dict.fromkeys([score, value, *ties]))
    labelled = add_quantile_label(rows, score, ties, [], bins, "quantile")
    means = labelled.where(F.col("quantile").isNotNull()).groupBy("quantile").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    # one row per quantile
    spread = means.agg(F.max(F.when(F.col("quantile") == bins, F.col("mean"))) - F.max(F.when(F.col("quantile") == 1, F.col("mean")))).scalar()
    return means.withColumn("top_minus_bottom", spread)


def medians_by(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Exact medians per key, from distributed ranks."""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in values])
    long = df.select(key, F.explode(cells).alias("_c")).select(key, "_c.*")
    return exact_quantiles(long, [key, "variable"], "value", {"median": 0.5})


def describe(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Count, mean, spread, extremes and exact quartiles per key."""
    rows = df.where(F.col(value).isNotNull())
    basics = rows.groupBy(*key).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    quartiles = exact_quantiles(rows, key, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return null_safe_join(basics, quartiles, list(key))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; 0 and bins + 1 hold the values outside."""
    return df.where(F.col(value).isNotNull()).groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )
