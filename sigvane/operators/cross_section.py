"""One row per entity: the universe joined with scores, returns, fundamentals, filings and hiring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_row_per_key(df: DataFrame, keys: Sequence[str], preference: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """The row with the highest preferences per key, nulls last, then the lowest ties.

    The rank filter lets Spark keep one row per key and task before the shuffle.
    """
    order = ", ".join([f"{p} DESC NULLS LAST" for p in preference] + [f"{t} ASC" for t in ties])
    ranked = df.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"))
    return ranked.where(F.col("_k") == 1).drop("_k")


def study_universe(universe: DataFrame) -> DataFrame:
    """Covered entities with a ticker that are no further share class of a kept one."""
    return universe.where(F.col("in_coverage") & F.col("ticker").isNotNull() & ~F.col("share_class_dup"))


def cross_section(universe: DataFrame, scores: DataFrame, returns: DataFrame) -> DataFrame:
    """Universe with scores and returns, one row per ticker: scored first, then the higher page version."""
    joined = study_universe(universe).join(scores, "company_id", "left").join(returns, "ticker", "left")
    return best_row_per_key(joined, ["ticker"], ["maturity_index", "page_version"], ["company_id"])


def analysis_table(base: DataFrame, *others: DataFrame, key: str = "ticker") -> DataFrame:
    """Left joins on the ticker; every joined table has one row per ticker (see ``quality.duplicate_keys``)."""
    out = base
    for other in others:
        out = out.join(other, key, "left")
    return out
