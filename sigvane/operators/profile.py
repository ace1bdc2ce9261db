"""Per-entity reporting for all entities at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions.text import normalize_ticker
from sigvane.operators.ordering import attach_by_key, null_safe_join, value_ranks

_PERIODS = ["score_quarter", "quarter", "snapshot_date"]


def period_of(df: DataFrame) -> str:
    return next(c for c in _PERIODS if c in df.columns)


def normalize_panel(panel: DataFrame) -> DataFrame:
    """Upper-case tickers and make the two spellings of name and composite available."""
    out = panel
    if "ticker" in out.columns:
        out = out.withColumn("ticker", normalize_ticker(F.col("ticker")))
    for a, b in (("company_name", "name"), (K.COMPOSITE, "ai_composite_score")):
        for present, absent in ((a, b), (b, a)):
            if present in out.columns and absent not in out.columns:
                out = out.withColumn(absent, F.col(present))
    return out


def signal_rank(panel: DataFrame, signal: str, peers: Sequence[str] = ("sector",)) -> DataFrame:
    """Descending minimum rank of every row among its peers of the same period, and the peer count."""
    keys = [*peers, period_of(panel)]
    table = value_ranks(panel, keys, signal)
    place = F.col("total") - F.col("before") - F.col("count") + 1
    table = table.select(*keys, signal, "count", place.alias("signal_rank"), F.col("total").alias("num_peers"))
    return attach_by_key(panel.where(F.col(signal).isNotNull()), table, [*keys, signal]).drop("count")


def share_below(df: DataFrame, signal: str, peers: Sequence[str]) -> DataFrame:
    """Share of peers strictly below; peers without a value count in the denominator."""
    sizes = df.groupBy(*peers).agg(F.count(F.lit(1)).alias("_peers"))
    table = null_safe_join(value_ranks(df, peers, signal), sizes, peers)
    table = table.select(*peers, signal, "count", (F.col("before") / F.col("_peers")).alias("share_below"))
    return attach_by_key(df.where(F.col(signal).isNotNull()), table, [*peers, signal]).drop("count")


def latest_snapshot(panel: DataFrame, key: str = "ticker", order: str | None = None) -> DataFrame:
    """The last row of every entity, reduced map-side."""
    last = F.max_by(F.struct(*panel.columns), order or period_of(panel))
    return panel.groupBy(key).agg(last.alias("_row")).select("_row.*")


def history(panel: DataFrame, ticker: str) -> DataFrame:
    """All rows of one entity in period order."""
    return panel.where(F.upper("ticker") == ticker.strip().upper()).orderBy(period_of(panel))


def peer_comparison(panel: DataFrame, peer_group: str = "sector", key: str = "ticker") -> DataFrame:
    """Every entity's latest row with size, mean and range of its peers' signals in the same period."""
    period = period_of(panel)
    signals = [s for s in (*K.SCORE_COLUMNS, K.COMPOSITE) if s in panel.columns]
    aggs = [F.count(F.lit(1)).alias("num_peers")]
    for s in signals:
        aggs += [F.avg(s).alias(f"peer_mean_{s}"), F.min(s).alias(f"peer_min_{s}"), F.max(s).alias(f"peer_max_{s}")]
    groups = panel.groupBy(peer_group, period).agg(*aggs)
    own = latest_snapshot(panel, key).select(key, peer_group, period, *signals)
    return null_safe_join(own, groups, [peer_group, period])


def peer_rows(panel: DataFrame, ticker: str, peer_group: str = "sector") -> DataFrame:
    """The peers of one entity in its latest period, by ticker."""
    period = period_of(panel)
    own = latest_snapshot(panel.where(F.upper("ticker") == ticker.strip().upper()))
    keys = own.select(peer_group, period)
    signals = [s for s in (*K.SCORE_COLUMNS, K.COMPOSITE) if s in panel.columns]
    names = [c for c in ("ticker", "company_name", peer_group, period) if c in panel.columns]
    return null_safe_join(panel.select(*names, *signals), keys, [peer_group, period], "left_semi").orderBy("ticker")


def latest_outcomes(panel: DataFrame, key: str = "ticker") -> DataFrame:
    outcomes = [c for c in K.REPORT_OUTCOMES if c in panel.columns]
    return latest_snapshot(panel.select(key, period_of(panel), *outcomes), key)


def backtest_summary(metrics: DataFrame, signal: str) -> DataFrame:
    """The metrics row of ``signal``, else the first row by signal name."""
    preferred = F.when(F.col("signal") == signal, 0).otherwise(1)
    return metrics.orderBy(preferred, "signal").limit(1)


def source_evidence(extractions: DataFrame, ticker: str | None = None) -> DataFrame:
    """One row per evidence span, for one entity or for all."""
    rows = extractions.withColumn("ticker", normalize_ticker(F.col("ticker")))
    if ticker is not None:
        rows = rows.where(F.col("ticker") == ticker.strip().upper())
    return rows.select(
        "ticker", "source_document_id", "source_type", "source_date", F.explode("evidence").alias("_span")
    ).select("ticker", "source_document_id", "source_type", "source_date", "_span.text", "_span.evidence_id")


def entity_profiles(panel: DataFrame, evidence: DataFrame, signal: str = K.COMPOSITE, spans: int = 5) -> DataFrame:
    """Snapshot, peer rank, history span and first evidence spans of every entity in one wide row.

    ``evidence`` has (ticker, source_document_id, text); the first ``spans`` by document id are kept.
    """
    period = period_of(panel)
    snapshot = latest_snapshot(signal_rank(panel, signal))
    spread = panel.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("history_rows"), F.min(period).alias("first_period"), F.max(period).alias("last_period")
    )
    order = F.expr("row_number() OVER (PARTITION BY ticker ORDER BY source_document_id, text)")
    first = evidence.withColumn("_k", order).where(F.col("_k") <= spans)
    excerpts = first.groupBy("ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "source_document_id", "text"))), lambda s: s["text"]).alias("evidence")
    )
    return snapshot.join(spread, "ticker").join(excerpts, "ticker", "left")
