"""Point-in-time panel queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane import runtime
from sigvane.operators import bootstrap, pit
from sigvane.plans import bindings as B
from sigvane.plans.registry import query
from sigvane.sources import readers, sinks, versions


def rounded(*names: str, places: int = 6) -> list[Column]:
    return [F.round(F.col(n), places).alias(n) for n in names]


def rounded_sql(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names)


_DATES = ["snapshot_date", "prediction_date", "outcome_start_date", "outcome_end_date"]
_NUMBERS = [
    "log_market_cap",
    "prior_return_1q",
    "revenue_growth_qoq",
    "operating_margin_t",
    "revenue_per_employee_t",
    "fwd_return_1q",
    "fwd_return_2q",
    "fwd_excess_return_1q",
    "future_revenue_growth_qoq",
    "future_operating_margin_delta_qoq",
    "future_revenue_per_employee_growth_qoq",
]


def dates(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def dates_sql(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


PANEL_QUERY_SQL = f"""WITH {B.PANEL_SQL}
SELECT company_id, ticker, company_name, sector, industry, score_quarter, {", ".join(K.SCORE_COLUMNS)},
       {rounded_sql(K.COMPOSITE)}, {dates_sql(*_DATES)}, {rounded_sql(*_NUMBERS)}
FROM panel"""


@query("panel_point_in_time", "B13 B15 B23 B24 B25 B26 D4 D5 D6 D7 D8 E12 G9 G11 C14", PANEL_QUERY_SQL)
def panel_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = B.build_panel(
        B.companies(spark, sf_dir), B.scores(spark, sf_dir), B.prices(spark, sf_dir), B.reports(spark, sf_dir)
    )
    return panel.select(
        "company_id", "ticker", "company_name", "sector", "industry", "score_quarter", *K.SCORE_COLUMNS,
        *rounded(K.COMPOSITE), *dates(*_DATES), *rounded(*_NUMBERS),
    )


@query(
    "panel_duplicate_keys",
    "C9",
    f"WITH {B.PANEL_SQL} SELECT company_id || '|' || score_quarter AS key, '2 rows' AS detail FROM panel WHERE CAST(company_id AS INTEGER) % 7 = 0",
)
def panel_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh company's scores come twice; the panel is built all the same and its repeated keys are listed."""
    scores = B.scores(spark, sf_dir)
    twice = scores.unionByName(scores.where(F.col("company_id").cast("int") % 7 == 0))
    panel = B.build_panel(B.companies(spark, sf_dir), twice, B.prices(spark, sf_dir), B.reports(spark, sf_dir), unique=False)
    return pit.panel_key_violations(panel).select("key", "detail")


def _raw_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four inputs as exports write them: text, tickers in lower case and blanks, scores and financials without ids."""
    ticker = F.concat(F.lit(" s"), "company_id", F.lit(" ")).alias("ticker")
    master = B.companies(spark, sf_dir)
    scores = B.scores(spark, sf_dir).select(ticker, "snapshot_date", *K.SCORE_COLUMNS, "available_at", F.lit("export").alias("source_name"), F.lit("batch 1").alias("batch"))
    prices = B.prices(spark, sf_dir).select("company_id", F.col("price_date").alias("date"), "adjusted_close")
    financials = B.reports(spark, sf_dir).drop("company_id")
    financials = B.reports(spark, sf_dir).select(ticker, *financials.columns)
    return {"companies": master, "scores": scores, "prices": prices, "financials": financials}


@query("panel_from_raw_sources", "A1 A2 A3 A5 A6 A15 A16 A18 B18 B19 B20 B22 D3 D8", PANEL_QUERY_SQL)
def panel_from_raw_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four CSV exports are written, read, normalized, linked and published with their panel, which is read back through the manifest."""
    folder = runtime.scratch_path(spark, "exports")
    paths = {name: sinks.write_table(df, f"{folder}/{name}.csv") for name, df in _raw_exports(spark, sf_dir).items()}
    bootstrap.publish_panel(spark, {name: readers.read_table(spark, path) for name, path in paths.items()}, f"{folder}/published")
    panel = versions.read_current(spark, f"{folder}/published", bootstrap.PANEL)
    return panel.select(
        "company_id", "ticker", "company_name", "sector", "industry", "score_quarter", *K.SCORE_COLUMNS,
        *rounded(K.COMPOSITE), *dates(*_DATES), *rounded(*_NUMBERS),
    )
