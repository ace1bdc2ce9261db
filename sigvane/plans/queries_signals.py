"""Rank, IC, backtest and robustness queries on the staged panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.operators import backtest, ic, ordering, robustness
from sigvane.plans import bindings as B
from sigvane.plans import sql_text as S
from sigvane.plans.queries_panel import rounded, rounded_sql
from sigvane.plans.registry import QUERIES, query

SIGNALS = K.DEFAULT_SIGNALS
OUTCOMES = K.IC_OUTCOMES


def count(name: str):
    return F.col(name).cast("long").alias(name)


# --- ranks ---------------------------------------------------------------------------------------


@query(
    "line_percentile_rank",
    "G2 G3",
    f"""SELECT l_returnflag, l_linenumber, count(*) AS n, round(avg(rk), 6) AS mean_rank, round(max(rk), 8) AS top_rank
        FROM (SELECT l_returnflag, l_linenumber,
                     {S.average_rank("l_extendedprice", "l_returnflag")} / count(*) OVER (PARTITION BY l_returnflag) AS rk
              FROM lineitem) GROUP BY 1, 2""",
)
def line_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice")
    ranked = ordering.add_percentile_rank(lines, "l_extendedprice", "rk", by=["l_returnflag"])
    return ranked.groupBy("l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(
        F.count("rk").alias("n"), F.round(F.avg("rk"), 6).alias("mean_rank"), F.round(F.max("rk"), 8).alias("top_rank")
    )


@query(
    "line_price_quantiles",
    "F15 G3",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(median(l_extendedprice), 6) AS p50,
              round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
)
def line_price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    found = ordering.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, stored=True)
    return found.select("l_returnflag", *rounded("p01", "p50", "p99"))


@query(
    "peer_rank",
    "G5 L3",
    f"""WITH {B.PANEL_SQL}
    SELECT company_id, sector, score_quarter, rank() OVER (PARTITION BY sector, score_quarter ORDER BY {K.COMPOSITE} DESC) AS signal_rank,
           count(*) OVER (PARTITION BY sector, score_quarter) AS num_peers
    FROM panel WHERE {K.COMPOSITE} IS NOT NULL""",
)
def peer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigvane.operators.profile import signal_rank

    return signal_rank(B.panel(spark, sf_dir), K.COMPOSITE).select(
        "company_id", "sector", "score_quarter", count("signal_rank"), count("num_peers")
    )


@query(
    "peer_share_below",
    "G6",
    """WITH m AS (SELECT CAST(s_suppkey AS VARCHAR) AS company_id, r_name AS sector,
                         CASE WHEN s_acctbal > 0 THEN s_acctbal END AS signal
                  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
       SELECT company_id, sector, round((rank() OVER (PARTITION BY sector ORDER BY signal NULLS LAST) - 1) * 1.0
              / count(*) OVER (PARTITION BY sector), 6) AS share_below
       FROM m QUALIFY signal IS NOT NULL""",
)
def peer_share_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigvane.operators.profile import share_below

    master = B.companies(spark, sf_dir).withColumn("signal", F.when(F.col("market_cap") > 0, F.col("market_cap")))
    return share_below(master, "signal", ["sector"]).select("company_id", "sector", *rounded("share_below"))


@query(
    "quantile_labels_by_quarter",
    "G4",
    f"""WITH {B.PANEL_SQL}
    SELECT company_id, score_quarter, CASE WHEN count(*) OVER (PARTITION BY score_quarter) >= 5
           THEN {S.quantile_label(K.COMPOSITE, "company_id", "score_quarter")} END AS signal_quantile
    FROM panel WHERE {K.COMPOSITE} IS NOT NULL""",
)
def quantile_labels_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = B.panel(spark, sf_dir).select("company_id", "score_quarter", K.COMPOSITE)
    return backtest.assign_quantiles(panel, K.COMPOSITE, ["company_id"]).drop(K.COMPOSITE)


# --- information coefficients --------------------------------------------------------------------

_IC_BY_QUARTER = f"""{B.PANEL_SQL}, long AS ({S.pairs("panel", ["quarter"], SIGNALS, OUTCOMES)}),
{S.spearman_groups("long", "signal, outcome, quarter", 3)}"""


@query(
    "ic_by_quarter",
    "F1 F2 M3 B37",
    f"""WITH {_IC_BY_QUARTER}
    SELECT signal, outcome, quarter, n_obs, round(ic, 6) AS ic, status, round({S.correlation_pvalue("ic", "n_obs")}, 6) AS p_value
    FROM ics""",
)
def ic_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.ic_by_quarter(B.panel(spark, sf_dir))
    return result.select("signal", "outcome", "quarter", count("n_obs"), *rounded("ic", "p_value"), "status")


@query(
    "ic_by_period_single",
    "F3",
    f"""WITH {B.PANEL_SQL}, long AS ({S.pairs("panel", ["quarter"], [K.COMPOSITE], ["fwd_return_1q"])}),
    {S.spearman_groups("long", "signal, outcome, quarter", 3)}
    SELECT signal, outcome, quarter AS period, n_obs AS n, round(ic, 6) AS ic, status,
           round({S.correlation_pvalue("ic", "n_obs")}, 6) AS p_value FROM ics""",
)
def ic_by_period_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.ic_by_period(B.panel(spark, sf_dir), K.COMPOSITE, "fwd_return_1q")
    return result.select("signal", "outcome", "period", count("n"), *rounded("ic", "p_value"), "status")


@query(
    "ic_summary",
    "E10",
    f"""WITH {_IC_BY_QUARTER}
    SELECT signal, outcome, round(avg(ic), 6) AS mean_ic, round(median(ic), 6) AS median_ic, round(stddev_samp(ic), 6) AS ic_std,
           round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 4) AS ic_t_stat,
           round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) AS positive_ic_hit_rate,
           count(ic) AS number_of_quarters, CAST(sum(n_obs) AS BIGINT) AS total_observations
    FROM ics GROUP BY 1, 2""",
)
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.summarize_ic(ic.ic_by_quarter(B.panel(spark, sf_dir)))
    return result.select(
        "signal", "outcome", *rounded("mean_ic", "median_ic", "ic_std", "positive_ic_hit_rate"),
        *rounded("ic_t_stat", places=4), count("number_of_quarters"), count("total_observations"),
    )


_POOLED = f"""{B.PANEL_SQL}, long AS ({S.pairs("panel", [], SIGNALS, OUTCOMES)}), {S.spearman_groups("long", "signal, outcome", 10)}"""


@query(
    "ic_matrix_pooled",
    "F4 F7",
    f"""WITH {_POOLED}, tested AS (SELECT *, {S.correlation_pvalue("ic", "n_obs")} AS p FROM ics)
    SELECT signal, outcome, n_obs, round(ic, 6) AS ic, status, round(p, 6) AS p_value,
           CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM tested""",
)
def ic_matrix_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.ic_matrix(B.panel(spark, sf_dir), SIGNALS, OUTCOMES)
    return result.select("signal", "outcome", count("n_obs"), *rounded("ic", "p_value"), "status", "stars")


@query(
    "ic_matrix_pivot",
    "M2 F7",
    f"""WITH {_POOLED}
    SELECT signal, {", ".join(f"round(max(CASE WHEN outcome = '{o}' THEN ic END), 6) AS {o}" for o in OUTCOMES)}
    FROM ics GROUP BY 1""",
)
def ic_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ic.pivot_ic(ic.ic_matrix(B.panel(spark, sf_dir), SIGNALS, OUTCOMES), OUTCOMES)
    return wide.select("signal", *rounded(*OUTCOMES))


@query(
    "ic_lines_by_flag",
    "F1 F4",
    f"""WITH long AS (SELECT l_returnflag AS flag, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    {S.spearman_groups("long", "flag", 3)}
    SELECT flag, n_obs, round(ic, 6) AS ic, status FROM ics""",
)
def ic_lines_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")
    )
    return ic.spearman(lines, ["flag"]).select("flag", count("n_obs"), *rounded("ic"), "status")


@query(
    "sector_neutral_ic_mean",
    "F5",
    f"""WITH {B.PANEL_SQL}, long AS (SELECT sector, {K.COMPOSITE} AS x, fwd_return_1q AS y FROM panel),
    whole AS (SELECT 'all' AS k, x, y FROM long),
    {S.spearman_groups("long", "sector", 3)}, {S.spearman_groups("whole", "k", 3, "raw")}
    SELECT 'sector_neutral_ic' AS diagnostic, '{K.COMPOSITE}' AS signal, 'fwd_return_1q' AS outcome, sector,
           round((SELECT ic FROM raw), 6) AS raw_ic, round(ic, 6) AS sector_ic, round(avg(ic) OVER (), 6) AS sector_neutral_ic,
           n_obs, CASE WHEN status = 'too_few_obs' THEN 'insufficient_observations' ELSE status END AS status FROM ics""",
)
def sector_neutral_ic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = robustness.sector_neutral_ic(B.panel(spark, sf_dir))
    return result.select(
        "diagnostic", "signal", "outcome", "sector", *rounded("raw_ic", "sector_ic", "sector_neutral_ic"), count("n_obs"), "status"
    )


@query(
    "sector_neutral_ic_pooled",
    "F6",
    f"""WITH {B.PANEL_SQL}, long AS ({S.pairs("panel", ["sector"], SIGNALS, ["future_revenue_growth_qoq"])}),
    inside AS (SELECT signal, {S.average_rank("x", "signal, sector")} / count(*) OVER (PARTITION BY signal, sector) AS x,
                      {S.average_rank("y", "signal, sector")} / count(*) OVER (PARTITION BY signal, sector) AS y
               FROM long WHERE x IS NOT NULL AND y IS NOT NULL AND sector IS NOT NULL),
    {S.spearman_groups("inside", "signal", 10)}
    SELECT signal, n_obs, round(ic, 6) AS ic, status, round({S.correlation_pvalue("ic", "n_obs")}, 6) AS p_value FROM ics""",
)
def sector_neutral_ic_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.pooled_sector_neutral_ic(B.panel(spark, sf_dir), SIGNALS, "future_revenue_growth_qoq")
    return result.select("signal", count("n_obs"), *rounded("ic", "p_value"), "status")


@query(
    "trend_line",
    "F33",
    f"""WITH {B.PANEL_SQL}
    SELECT sector, round(regr_slope(fwd_return_1q, {K.COMPOSITE}), 8) AS slope,
           round(regr_intercept(fwd_return_1q, {K.COMPOSITE}), 8) AS intercept, CAST(regr_count(fwd_return_1q, {K.COMPOSITE}) AS BIGINT) AS n
    FROM panel GROUP BY 1""",
)
def trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.trend_line(B.panel(spark, sf_dir), ["sector"], K.COMPOSITE, "fwd_return_1q")
    return result.select("sector", *rounded("slope", "intercept", places=8), count("n"))


# --- backtest ------------------------------------------------------------------------------------

_RETURNS = f"""{B.PANEL_SQL}, labelled AS (
  SELECT score_quarter AS quarter, fwd_return_1q,
         CASE WHEN count(*) OVER (PARTITION BY score_quarter) >= 5
              THEN {S.quantile_label(K.COMPOSITE, "company_id", "score_quarter")} END AS signal_quantile
  FROM panel WHERE {K.COMPOSITE} IS NOT NULL AND fwd_return_1q IS NOT NULL),
returns AS (
  SELECT quarter, signal_quantile, avg(fwd_return_1q) AS mean_return, count(fwd_return_1q) AS n
  FROM labelled WHERE signal_quantile IS NOT NULL GROUP BY 1, 2),
wide AS (
  SELECT quarter, max(CASE WHEN signal_quantile = 5 THEN mean_return END) AS long_return,
         max(CASE WHEN signal_quantile = 1 THEN mean_return END) AS short_return FROM returns GROUP BY 1),
spread AS (
  SELECT *, long_return - short_return AS r, product(1 + coalesce(long_return - short_return, 0))
         OVER (ORDER BY quarter ROWS UNBOUNDED PRECEDING) AS curve FROM wide)"""


def _backtest(spark: SparkSession, sf_dir: str) -> backtest.QuantileBacktest:
    panel = B.panel(spark, sf_dir).select("company_id", "quarter", K.COMPOSITE, "fwd_return_1q")
    return backtest.run_quantile_backtest(panel, K.COMPOSITE, ["company_id"])


@query(
    "backtest_quantile_returns",
    "E9 F28",
    f"WITH {_RETURNS} SELECT quarter, CAST(signal_quantile AS BIGINT) AS signal_quantile, round(mean_return, 6) AS mean_return, n FROM returns",
)
def backtest_quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir).quantile_returns.select("quarter", count("signal_quantile"), *rounded("mean_return"), count("n"))


@query(
    "backtest_long_short",
    "M1 G7",
    f"""WITH {_RETURNS} SELECT quarter, round(long_return, 6) AS long_return, round(short_return, 6) AS short_return,
        round(r, 6) AS long_short_return, round(curve - 1, 6) AS cumulative_return FROM spread""",
)
def backtest_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _backtest(spark, sf_dir).long_short
    return result.select("quarter", *rounded("long_return", "short_return", "long_short_return", "cumulative_return"))


@query(
    "backtest_metrics",
    "E11 G7 G8",
    f"""WITH {_RETURNS}, peaks AS (SELECT *, curve / max(curve) OVER (ORDER BY quarter ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM spread)
    SELECT round(arg_max(curve, quarter) - 1, 6) AS cumulative_return, round(avg(r), 6) AS average_quarterly_return,
           round(pow(1 + avg(r), 4) - 1, 6) AS annualized_return, round(stddev_samp(r) * 2, 6) AS volatility,
           round((pow(1 + avg(r), 4) - 1) / (stddev_samp(r) * 2), 6) AS sharpe_ratio, round(min(fall), 6) AS max_drawdown,
           round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(r) AS number_of_rebalances FROM peaks""",
)
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _backtest(spark, sf_dir).metrics
    return result.select(
        *rounded(
            "cumulative_return", "average_quarterly_return", "annualized_return", "volatility", "sharpe_ratio",
            "max_drawdown", "hit_rate",
        ),
        count("number_of_rebalances"),
    )


@query(
    "backtest_small_periods",
    "F28",
    f"""WITH {B.PANEL_SQL} SELECT quarter, count(*) AS n, 'not enough observations for 100 quantiles' AS warning FROM panel
        WHERE log_market_cap IS NOT NULL AND future_revenue_growth_qoq IS NOT NULL GROUP BY 1 HAVING count(*) < 100""",
)
def backtest_small_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.small_periods(B.panel(spark, sf_dir), "log_market_cap", "future_revenue_growth_qoq", quantiles=100).select(
        "quarter", count("n"), "warning"
    )


# --- robustness ----------------------------------------------------------------------------------

_SIZES = f"""{B.PANEL_SQL}, long AS (
  SELECT CASE {S.quantile_label("log_market_cap", "company_id, score_quarter", "", "3")}
              WHEN 1 THEN 'small' WHEN 2 THEN 'mid' ELSE 'large' END AS size_bucket, {K.COMPOSITE} AS x, fwd_return_1q AS y
  FROM panel WHERE log_market_cap IS NOT NULL),
{S.spearman_groups("long", "size_bucket", 3)}"""


@query(
    "size_bucket_ic",
    "F8 G4",
    f"""WITH {_SIZES}, means AS (SELECT size_bucket, avg(x) AS mean_signal FROM long GROUP BY 1)
    SELECT 'size_bucket_analysis' AS diagnostic, '{K.COMPOSITE}' AS signal, 'fwd_return_1q' AS outcome, size_bucket,
           round(mean_signal, 6) AS mean_signal, round(ic, 6) AS ic, n_obs, status FROM ics JOIN means USING (size_bucket)""",
)
def size_bucket_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = robustness.size_bucket_analysis(B.panel(spark, sf_dir), ["company_id", "score_quarter"])
    return result.select("diagnostic", "signal", "outcome", "size_bucket", *rounded("mean_signal", "ic"), count("n_obs"), "status")


_FIELDS = ["log_market_cap", "prior_return_1q", "fwd_return_1q", "future_revenue_growth_qoq"]


@query(
    "missing_rates_by_quarter",
    "E5",
    f"WITH {B.PANEL_SQL} "
    + " UNION ALL ".join(
        f"SELECT score_quarter, '{f}' AS field, round(avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM panel GROUP BY 1"
        for f in _FIELDS
    ),
)
def missing_rates_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.missing_rates(B.panel(spark, sf_dir), _FIELDS, "score_quarter").select(
        "score_quarter", "field", *rounded("missing_rate")
    )


@query(
    "missing_rates_overall",
    "E5",
    f"WITH {B.PANEL_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, round(avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM panel" for f in _FIELDS
    ),
)
def missing_rates_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.missing_rates(B.panel(spark, sf_dir), _FIELDS).select("field", *rounded("missing_rate"))


_PRESENT = [o for o in K.MISSINGNESS_OUTCOMES if o != "fwd_return_4q"]


def _missing_sql(kind: str, group: str, fields: list[str], by: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS diagnostic_type, {group} AS \"group\", '{f}' AS field, avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END) AS rate "
        f"FROM panel {by}"
        for f in fields
    )


@query(
    "missingness_diagnostics",
    "E6 B37",
    f"""WITH {B.PANEL_SQL}, rates AS (
      {_missing_sql("missingness_by_sector", "sector", [*SIGNALS, *_PRESENT], "GROUP BY sector")} UNION ALL
      {_missing_sql("missingness_by_quarter", "score_quarter", [*SIGNALS, *_PRESENT], "GROUP BY score_quarter")} UNION ALL
      {_missing_sql("missingness_by_signal", "'overall'", SIGNALS, "")} UNION ALL
      {_missing_sql("missingness_by_outcome", "'overall'", _PRESENT, "")})
    SELECT diagnostic_type, "group", field, round(rate, 6) AS missing_rate, CAST(rate >= 0.5 AS INTEGER) AS highly_concentrated, 'ok' AS status
    FROM rates""",
)
def missingness_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = robustness.missingness_diagnostics(B.panel(spark, sf_dir))
    flag = F.col("highly_concentrated").cast("int").alias("highly_concentrated")
    return result.select("diagnostic_type", "group", "field", *rounded("missing_rate"), flag, "status")


@query(
    "lag_sensitivity",
    "F9 B36",
    f"""WITH {B.PANEL_SQL}, long AS ({S.pairs("panel", [], [K.COMPOSITE], ["fwd_return_1q", "fwd_return_2q"])}),
    {S.spearman_groups("long", "outcome", 3)},
    lead AS (SELECT outcome FROM ics WHERE status = 'ok' ORDER BY abs(ic) DESC, outcome LIMIT 1)
    SELECT 'lag_sensitivity' AS diagnostic, '{K.COMPOSITE}' AS signal, outcome, CASE WHEN outcome LIKE '%1q' THEN '1Q' ELSE '2Q' END AS horizon,
           round(ic, 6) AS ic, n_obs, CASE WHEN status <> 'ok' THEN 'pending' WHEN outcome <> (SELECT outcome FROM lead) THEN 'noisy_or_weaker'
           WHEN outcome LIKE '%2q' THEN 'leading_candidate' ELSE 'near_term_candidate' END AS interpretation, status FROM ics
    UNION ALL SELECT 'lag_sensitivity', '{K.COMPOSITE}', 'fwd_return_4q', '4Q', NULL, 0, 'unavailable', 'unavailable'""",
)
def lag_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = robustness.lag_sensitivity(B.panel(spark, sf_dir))
    return result.select("diagnostic", "signal", "outcome", "horizon", *rounded("ic"), count("n_obs"), "interpretation", "status")


_PROXIES = ["filing_length", "source_document_count"]


def _disclosing_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with two measures of how much an entity discloses."""
    lengths = B.entity_quarters(spark, sf_dir).select(
        "company_id", F.col("period_end").alias("snapshot_date"), F.col("lines").alias("filing_length"),
        F.col("parts").alias("source_document_count"),
    )
    return B.panel(spark, sf_dir).join(lengths, ["company_id", "snapshot_date"])


@query(
    "disclosure_bias_proxy",
    "F10",
    f"""WITH {B.PANEL_SQL}, proxied AS (
      SELECT panel.*, e.lines AS filing_length, e.parts AS source_document_count FROM panel
      JOIN entity_quarters e ON e.company_id = panel.company_id AND e.period_end = panel.snapshot_date),
    long AS ({S.pairs("proxied", [], _PROXIES, [K.COMPOSITE])}), {S.spearman_groups("long", "signal", 3)}
    SELECT 'disclosure_bias_proxy' AS diagnostic, '{K.COMPOSITE}' AS score, signal AS proxy, round(ic, 6) AS correlation, n_obs, status FROM ics""",
)
def disclosure_bias_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = robustness.disclosure_bias_proxy(_disclosing_panel(spark, sf_dir))
    return result.select("diagnostic", "score", "proxy", *rounded("correlation"), count("n_obs"), "status")


@query(
    "robustness_row_counts",
    "F11 I2 E26",
    f"""WITH {B.PANEL_SQL} SELECT 'sector_neutral_ic' AS diagnostic, count(DISTINCT sector) AS rows FROM panel
    UNION ALL SELECT 'size_bucket_analysis', 3
    UNION ALL SELECT 'missingness_diagnostics', {len(SIGNALS) + len(_PRESENT)} * (count(DISTINCT sector) + count(DISTINCT score_quarter) + 1) FROM panel
    UNION ALL SELECT 'lag_sensitivity', 3 UNION ALL SELECT 'disclosure_bias_proxy', 1 UNION ALL SELECT 'llm_extraction_reliability', 1""",
)
def robustness_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = robustness.robustness_suite(B.panel(spark, sf_dir), ["company_id", "score_quarter"])
    return robustness.diagnostic_counts(suite).select("diagnostic", count("rows"))


def _part(name: str, extra: str = "") -> str:
    return f"SELECT {extra}* FROM ({QUERIES[name].sql})"


_NOTHING_EXTRACTED = "SELECT 'llm_extraction_reliability' AS diagnostic, 'availability' AS metric, 'llm_extractions_unavailable' AS status"


@query(
    "robustness_suite",
    "F11 I2",
    " UNION ALL BY NAME ".join(
        [_part("sector_neutral_ic_mean"), _part("size_bucket_ic"), _part("missingness_diagnostics", "'missingness_diagnostics' AS diagnostic, "), _part("lag_sensitivity"), _part("disclosure_bias_proxy"), _NOTHING_EXTRACTED]
    ),
)
def robustness_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the six diagnostics, in one table."""
    suite = robustness.robustness_suite(_disclosing_panel(spark, sf_dir), ["company_id", "score_quarter"])
    columns = []
    for name, kind in suite.dtypes:
        if kind == "double":
            columns += rounded(name)
        else:
            columns.append(F.col(name).cast({"boolean": "int", "int": "long"}.get(kind, kind)).alias(name))
    return suite.select(*columns)
