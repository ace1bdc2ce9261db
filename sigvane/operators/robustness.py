"""Robustness diagnostics of one signal and outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.operators.ic import available, spearman, unpivot_pairs
from sigvane.operators.ordering import null_safe_join, prefix_sums, quantile_label_expr
from sigvane.runtime import materialize


def _first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def _one_row(df: DataFrame, **values: object) -> DataFrame:
    """A single diagnostic row; ``None`` becomes a null string."""
    columns = [(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in values.items()]
    return df.sparkSession.range(1).select(*columns)


def missing_rates(df: DataFrame, fields: Sequence[str], group: str | None = None) -> DataFrame:
    """Share of nulls per field, overall or per group (a null group counts as a group)."""
    keys = [group] if group else []
    rates = df.groupBy(*keys).agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in fields])
    return rates.unpivot(keys, list(fields), "field", "missing_rate")


def missingness_diagnostics(
    panel: DataFrame,
    signals: Sequence[str] = K.DEFAULT_SIGNALS,
    outcomes: Sequence[str] = K.MISSINGNESS_OUTCOMES,
    threshold: float = 0.5,
) -> DataFrame:
    """Missing rates by sector, by quarter and overall from one grouping-sets pass."""
    signals, outcomes = available(panel, signals), available(panel, outcomes)
    fields = [*signals, *outcomes]
    groups = {"sector": "missingness_by_sector", "score_quarter": "missingness_by_quarter"}
    present = available(panel, list(groups))
    rates = panel.groupingSets([[g] for g in present] + [[]], *present).agg(
        F.grouping_id().alias("_level"), *[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in fields]
    )
    # grouping_id has a bit set for every column that is rolled up in the row
    whole = 2 ** len(present) - 1
    level, group = F.lit("overall"), F.lit("overall")
    for i, name in enumerate(present):
        here = F.col("_level") == whole - 2 ** (len(present) - 1 - i)
        level = F.when(here, groups[name]).otherwise(level)
        group = F.when(here, F.col(name)).otherwise(group)
    long = rates.select(level.alias("_type"), group.alias("group"), *fields).unpivot(
        ["_type", "group"], fields, "field", "missing_rate"
    )
    kind = F.when(F.col("field").isin(signals), "missingness_by_signal").otherwise("missingness_by_outcome")
    result = long.select(
        F.when(F.col("_type") == "overall", kind).otherwise(F.col("_type")).alias("diagnostic_type"),
        "group",
        "field",
        "missing_rate",
        (F.col("missing_rate") >= threshold).alias("highly_concentrated"),
        F.lit("ok").alias("status"),
    )
    for name in groups:
        if name not in panel.columns:
            absent = _one_row(panel, diagnostic_type=groups[name], group=None, field=None, status=f"{name}_unavailable")
            result = result.unionByName(absent, allowMissingColumns=True)
    return result


def sector_neutral_ic(
    panel: DataFrame,
    signal: str = K.COMPOSITE,
    outcome: str = "fwd_return_1q",
    sector: str = "sector",
    min_obs: int = 3,
) -> DataFrame:
    """IC inside every sector, their plain mean, and the raw IC alongside."""
    head = {"diagnostic": "sector_neutral_ic", "signal": signal, "outcome": outcome}
    if sector not in panel.columns:
        raw = spearman(unpivot_pairs(panel, [], [signal], [outcome]), [], min_obs=min_obs)
        return raw.select(
            *[F.lit(v).alias(k) for k, v in head.items()], F.lit(None).cast("string").alias("sector"),
            F.col("ic").alias("raw_ic"), F.lit(None).cast("double").alias("sector_ic"),
            F.lit(None).cast("double").alias("sector_neutral_ic"), "n_obs", F.lit("sector_unavailable").alias("status"),
        )
    levels = F.explode(F.array(F.lit("all"), F.lit("sector"))).alias("_level")
    long = panel.select(levels, F.col(sector).alias("_sector"), F.col(signal).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    long = long.withColumn("_sector", F.when(F.col("_level") == "sector", F.col("_sector")))
    both = materialize(spearman(long, ["_level", "_sector"], min_obs=min_obs))
    raw = both.where(F.col("_level") == "all").select("ic").scalar()
    sectors = both.where(F.col("_level") == "sector")
    neutral = sectors.agg(F.avg("ic")).scalar()
    status = F.when(F.col("status") == "too_few_obs", "insufficient_observations").otherwise(F.col("status"))
    return sectors.select(
        *[F.lit(v).alias(k) for k, v in head.items()],
        F.col("_sector").alias("sector"),
        raw.alias("raw_ic"),
        F.col("ic").alias("sector_ic"),
        neutral.alias("sector_neutral_ic"),
        "n_obs",
        status.alias("status"),
    )


def size_bucket_analysis(
    panel: DataFrame,
    ties: Sequence[str],
    signal: str = K.COMPOSITE,
    outcome: str = "fwd_return_1q",
    market_cap_col: str | None = None,
    min_obs: int = 3,
) -> DataFrame:
    """IC and mean signal in size terciles."""
    cap = market_cap_col or _first_existing(panel, ["market_cap", "log_market_cap"])
    head = {"diagnostic": "size_bucket_analysis", "signal": signal, "outcome": outcome}
    if cap is None:
        return _one_row(panel, **head, size_bucket=None, n_obs=0, status="market_cap_unavailable")
    ordered = prefix_sums(
        panel.where(F.col(cap).isNotNull()).select(*dict.fromkeys([cap, *ties, signal, outcome])),
        [], [cap, *ties], before="_position", total="_size",
    )
    label = quantile_label_expr(F.least(F.lit(3), F.col("_size")), F.col("_position"), F.col("_size"))
    named = F.element_at(F.array(F.lit("small"), F.lit("mid"), F.lit("large")), label)
    long = ordered.select(named.alias("size_bucket"), F.col(signal).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    means = long.groupBy("size_bucket").agg(F.avg("x").alias("mean_signal"))
    return null_safe_join(spearman(long, ["size_bucket"], min_obs=min_obs), means, ["size_bucket"]).select(
        *[F.lit(v).alias(k) for k, v in head.items()], "size_bucket", "mean_signal", "ic", "n_obs", "status"
    )


def horizon_label(outcome: str) -> str:
    return next((h.upper() for h in ("1q", "2q", "4q") if h in outcome.lower()), "other")


def lag_sensitivity(
    panel: DataFrame, signal: str = K.COMPOSITE, outcomes: Sequence[str] = K.LAG_OUTCOMES, min_obs: int = 3
) -> DataFrame:
    """IC per horizon, which horizon is strongest by magnitude, and how to read it."""
    present = available(panel, outcomes)
    horizon = F.create_map(*[F.lit(x) for o in outcomes for x in (o, horizon_label(o))])[F.col("outcome")]
    position = F.create_map(*[F.lit(x) for i, o in enumerate(outcomes) for x in (o, -i)])[F.col("outcome")]
    result = None
    if present:
        ics = materialize(spearman(unpivot_pairs(panel, [], [signal], present), ["outcome"], min_obs=min_obs))
        best = ics.where(F.col("status") == "ok").agg(F.max_by("outcome", F.struct(F.abs("ic"), position))).scalar()
        leader = F.col("outcome") == best
        reading = (
            F.when(F.col("status") != "ok", "pending")
            .when(leader & horizon.isin("2Q", "4Q"), "leading_candidate")
            .when(leader, "near_term_candidate")
            .otherwise("noisy_or_weaker")
        )
        result = ics.select("outcome", horizon.alias("horizon"), "ic", "n_obs", reading.alias("interpretation"), "status")
    for outcome in outcomes:
        if outcome not in present:
            row = _one_row(panel, outcome=outcome, horizon=horizon_label(outcome), n_obs=0, interpretation="unavailable", status="unavailable")
            result = row if result is None else result.unionByName(row, allowMissingColumns=True)
    return result.select(F.lit("lag_sensitivity").alias("diagnostic"), F.lit(signal).alias("signal"), "*")


def disclosure_bias_proxy(
    panel: DataFrame, score: str = K.COMPOSITE, proxies: Sequence[str] = K.DISCLOSURE_PROXIES, min_obs: int = 3
) -> DataFrame:
    """Rank correlation of the score with measures of how much an entity discloses."""
    present = available(panel, proxies)
    if not present:
        return _one_row(panel, diagnostic="disclosure_bias_proxy", score=score, proxy=None, n_obs=0, status="disclosure_proxy_unavailable")
    ics = spearman(unpivot_pairs(panel, [], present, [score]), ["signal"], min_obs=min_obs)
    return ics.select(
        F.lit("disclosure_bias_proxy").alias("diagnostic"), F.lit(score).alias("score"), F.col("signal").alias("proxy"),
        F.col("ic").alias("correlation"), "n_obs", "status",
    )


def robustness_suite(
    panel: DataFrame,
    ties: Sequence[str],
    signal: str = K.COMPOSITE,
    outcome: str = "fwd_return_1q",
    extraction_rows: DataFrame | None = None,
) -> DataFrame:
    """All diagnostics in one table; columns a diagnostic lacks are null."""
    if extraction_rows is None:
        extraction_rows = _one_row(
            panel, diagnostic="llm_extraction_reliability", metric="availability", sector=None, status="llm_extractions_unavailable"
        )
    frames = [
        sector_neutral_ic(panel, signal, outcome),
        size_bucket_analysis(panel, ties, signal, outcome),
        missingness_diagnostics(panel).withColumn("diagnostic", F.lit("missingness_diagnostics")),
        lag_sensitivity(panel, signal),
        disclosure_bias_proxy(panel, signal),
        extraction_rows,
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def diagnostic_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("diagnostic").agg(F.count(F.lit(1)).alias("rows"))
