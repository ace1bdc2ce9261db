"""The benchmark tables seen as the canonical inputs: entities, prices, reports, scores, postings.

Sums run on integer cents, so results do not depend on the order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane import runtime
from sigvane.functions.calendar import quarter_end, quarter_label
from sigvane.operators.ordering import null_safe_join, prefix_sums, quantile_label_expr
from sigvane.operators.pit import build_panel

LINES_A_DEAL = 1 << 20
_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A stage table, written once per application to the checkpoint folder and shared by later queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = runtime.written(build(spark, sf_dir), name)
    return _STAGED[key]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("company_id"),
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
            F.col("s_name").alias("company_name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.col("s_acctbal").alias("market_cap"),
        )
    )


COMPANIES_SQL = """companies AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS company_id, 'S' || s_suppkey AS ticker, s_name AS company_name,
         r_name AS sector, n_name AS industry, s_acctbal AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def entity_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged line-item totals per (company, quarter); prices, reports and scores all read it."""
    return staged(spark, sf_dir, "entity_quarters", _build_entity_quarters)


def _deals(lineitem: DataFrame) -> DataFrame:
    """The suppliers of ``LINES_A_DEAL`` lines or more and over how many deals theirs are spread; written, so that Spark knows how few they are."""
    deals = F.floor(F.count(F.lit(1)) / LINES_A_DEAL) + 1
    return runtime.written(lineitem.groupBy("l_suppkey").agg(deals.alias("deals")).where("deals > 1"), "deals")


def _dealt_totals(lineitem: DataFrame) -> DataFrame:
    """Totals per (supplier, quarter, deal).  All lines of a part go to one deal, so partial counts of parts can be added.

    Lines are shuffled once, narrow.  Only a large supplier has several deals: the totals of all others are whole and are not shuffled in parts.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    percent_off = F.round(F.col("l_discount") * 100).cast("long")
    spread = F.pmod(F.xxhash64("l_partkey"), F.coalesce("deals", F.lit(1)))
    lines = null_safe_join(lineitem, _deals(lineitem), ["l_suppkey"], "left").select(
        "l_suppkey",
        quarter_end(F.col("l_shipdate")).alias("period_end"),
        spread.cast("int").alias("deal"),
        "l_partkey",
        F.col("l_quantity").cast("long").alias("quantity"),
        cents.alias("cents"),
        percent_off.alias("percent_off"),
        (F.col("l_returnflag") == "N").alias("kept"),
    )
    net = F.col("cents") * (100 - F.col("percent_off"))
    return lines.repartition("l_suppkey", "period_end", "deal").groupBy("l_suppkey", "period_end", "deal").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("cents").alias("cents"),
        F.sum(net).alias("net"),
        F.sum(F.when(F.col("kept"), net).otherwise(0)).alias("net_n"),
        F.sum("percent_off").alias("percent_off"),
        F.count(F.lit(1)).alias("lines"),
        F.countDistinct("l_partkey").alias("parts"),
    )


def _build_entity_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("quantity", "cents", "net", "net_n", "percent_off", "lines", "parts")]
    # By supplier, not by quarter: what readers collect per company then meets in one task before it is shuffled.
    totals = _dealt_totals(table(spark, sf_dir, "lineitem")).repartition("l_suppkey").groupBy("l_suppkey", "period_end").agg(*sums)
    return totals.select(F.col("l_suppkey").cast("string").alias("company_id"), *[c for c in totals.columns if c != "l_suppkey"])


ENTITY_QUARTERS_SQL = """lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS company_id,
         CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         l_partkey, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(round(l_discount * 100) AS BIGINT) AS percent_off, l_returnflag
  FROM lineitem),
entity_quarters AS (
  SELECT company_id, period_end, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(cents) AS BIGINT) AS cents,
         CAST(sum(cents * (100 - percent_off)) AS BIGINT) AS net,
         CAST(sum(CASE WHEN l_returnflag = 'N' THEN cents * (100 - percent_off) ELSE 0 END) AS BIGINT) AS net_n,
         CAST(sum(percent_off) AS BIGINT) AS percent_off, count(*) AS lines, count(DISTINCT l_partkey) AS parts
  FROM lines GROUP BY 1, 2)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_quarters(spark, sf_dir).select(
        "company_id",
        F.col("period_end").alias("price_date"),
        ((F.col("cents") / F.lit(100.0)) / F.col("quantity").cast("double")).alias("adjusted_close"),
    )


PRICES_SQL = """prices AS (
  SELECT company_id, period_end AS price_date,
         (CAST(cents AS DOUBLE) / CAST(100 AS DOUBLE)) / CAST(quantity AS DOUBLE) AS adjusted_close
  FROM entity_quarters)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_quarters(spark, sf_dir).select(
        "company_id",
        quarter_label(F.col("period_end")).alias("fiscal_quarter"),
        F.col("period_end").alias("fiscal_period_end"),
        F.date_add("period_end", 25).cast("timestamp").alias("available_at"),
        (F.col("net") / F.lit(10000.0)).alias("revenue"),
        (F.col("net_n").cast("double") / F.col("net").cast("double")).alias("operating_margin"),
        F.col("parts").cast("double").alias("employee_count"),
    )


REPORTS_SQL = """reports AS (
  SELECT company_id, year(period_end) || 'Q' || quarter(period_end) AS fiscal_quarter, period_end AS fiscal_period_end,
         period_end + 25 AS available_on, CAST(net AS DOUBLE) / CAST(10000 AS DOUBLE) AS revenue,
         CAST(net_n AS DOUBLE) / CAST(net AS DOUBLE) AS operating_margin, CAST(parts AS DOUBLE) AS employee_count
  FROM entity_quarters)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four 1-5 scores per (company, quarter): quintiles of volume, revenue, breadth and discount."""
    measures = [
        F.col("quantity").cast("double"),
        F.col("net").cast("double"),
        F.col("parts").cast("double"),
        F.col("percent_off").cast("double") / F.col("lines").cast("double"),
    ]
    cells = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("measure"), m.alias("value")) for i, m in enumerate(measures)])
    long = entity_quarters(spark, sf_dir).select("company_id", "period_end", F.explode(cells).alias("cell"))
    long = long.select("company_id", "period_end", "cell.measure", "cell.value")
    ordered = prefix_sums(long, ["measure", "period_end"], ["value", "company_id"], before="position", total="size")
    label = F.when(F.col("size") >= 5, quantile_label_expr(F.lit(5), F.col("position"), F.col("size")))
    labelled = ordered.withColumn("label", label)
    wide = labelled.groupBy("company_id", "period_end").agg(
        *[F.max(F.when(F.col("measure") == i, F.col("label"))).alias(n) for i, n in enumerate(K.SCORE_COLUMNS)]
    )
    return wide.select(
        "company_id",
        F.col("period_end").alias("snapshot_date"),
        quarter_label(F.col("period_end")).alias("score_quarter"),
        *K.SCORE_COLUMNS,
        F.date_add("period_end", 2).cast("timestamp").alias("available_at"),
    )


def _label_sql(measure: str, name: str) -> str:
    r = f"(row_number() OVER (PARTITION BY period_end ORDER BY {measure}, company_id) - 1)"
    n = "count(*) OVER (PARTITION BY period_end)"
    return (
        f"CASE WHEN {n} >= 5 THEN CAST(greatest(1, ({r} * 5 + {n} - 2) // ({n} - 1)) AS INTEGER) END AS {name}"
    )


SCORES_SQL = f"""scores AS (
  SELECT company_id, period_end AS snapshot_date, year(period_end) || 'Q' || quarter(period_end) AS score_quarter,
         {_label_sql("quantity", K.SCORE_COLUMNS[0])},
         {_label_sql("net", K.SCORE_COLUMNS[1])},
         {_label_sql("parts", K.SCORE_COLUMNS[2])},
         {_label_sql("CAST(percent_off AS DOUBLE) / CAST(lines AS DOUBLE)", K.SCORE_COLUMNS[3])},
         period_end + 2 AS available_on
  FROM entity_quarters)"""


def _build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(
        companies(spark, sf_dir), scores(spark, sf_dir), prices(spark, sf_dir), reports(spark, sf_dir), strict=False
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged point-in-time panel."""
    return staged(spark, sf_dir, "panel", _build_panel)


# Lookups by plain range conditions, unlike the running windows on the Spark side.
PANEL_SQL = f"""{COMPANIES_SQL}, {ENTITY_QUARTERS_SQL}, {PRICES_SQL}, {REPORTS_SQL}, {SCORES_SQL},
past_prices AS (
  SELECT s.company_id, s.score_quarter, p.adjusted_close,
         row_number() OVER (PARTITION BY s.company_id, s.score_quarter ORDER BY p.price_date DESC) AS k
  FROM scores s JOIN prices p ON s.company_id = p.company_id AND p.price_date <= s.available_on),
next_prices AS (
  SELECT s.company_id, s.score_quarter, p.adjusted_close, p.price_date,
         row_number() OVER (PARTITION BY s.company_id, s.score_quarter ORDER BY p.price_date) AS k
  FROM scores s JOIN prices p ON s.company_id = p.company_id AND p.price_date > s.available_on),
past_reports AS (
  SELECT s.company_id, s.score_quarter, r.revenue, r.operating_margin, r.employee_count,
         row_number() OVER (PARTITION BY s.company_id, s.score_quarter ORDER BY r.fiscal_period_end DESC) AS k
  FROM scores s JOIN reports r ON s.company_id = r.company_id AND r.available_on <= s.available_on),
next_reports AS (
  SELECT s.company_id, s.score_quarter, r.revenue, r.operating_margin, r.employee_count,
         row_number() OVER (PARTITION BY s.company_id, s.score_quarter ORDER BY r.fiscal_period_end) AS k
  FROM scores s JOIN reports r ON s.company_id = r.company_id AND r.fiscal_period_end > s.available_on),
raw_panel AS (
  SELECT s.company_id, c.ticker, c.company_name, c.sector, c.industry, s.snapshot_date, s.score_quarter,
         s.available_on AS prediction_date, s.score_quarter AS quarter, {", ".join("s." + c for c in K.SCORE_COLUMNS)},
         (CAST(s.{K.SCORE_COLUMNS[0]} AS DOUBLE) + s.{K.SCORE_COLUMNS[1]} + s.{K.SCORE_COLUMNS[2]} + s.{K.SCORE_COLUMNS[3]}) / 4 AS {K.COMPOSITE},
         CASE WHEN c.market_cap > 0 THEN ln(c.market_cap) END AS log_market_cap, c.market_cap,
         p1.adjusted_close / p2.adjusted_close - 1 AS prior_return_1q,
         r1.revenue / r2.revenue - 1 AS revenue_growth_qoq, r1.operating_margin AS operating_margin_t,
         r1.revenue / r1.employee_count AS revenue_per_employee_t,
         CASE WHEN n2.price_date IS NOT NULL THEN n1.price_date END AS outcome_start_date, n2.price_date AS outcome_end_date,
         n2.adjusted_close / n1.adjusted_close - 1 AS fwd_return_1q,
         n3.adjusted_close / n1.adjusted_close - 1 AS fwd_return_2q,
         f2.revenue / f1.revenue - 1 AS future_revenue_growth_qoq,
         f2.operating_margin - f1.operating_margin AS future_operating_margin_delta_qoq,
         (f2.revenue / f2.employee_count) / (f1.revenue / f1.employee_count) - 1 AS future_revenue_per_employee_growth_qoq
  FROM scores s JOIN companies c USING (company_id)
  LEFT JOIN past_prices p1 ON p1.company_id = s.company_id AND p1.score_quarter = s.score_quarter AND p1.k = 1
  LEFT JOIN past_prices p2 ON p2.company_id = s.company_id AND p2.score_quarter = s.score_quarter AND p2.k = 2
  LEFT JOIN next_prices n1 ON n1.company_id = s.company_id AND n1.score_quarter = s.score_quarter AND n1.k = 1
  LEFT JOIN next_prices n2 ON n2.company_id = s.company_id AND n2.score_quarter = s.score_quarter AND n2.k = 2
  LEFT JOIN next_prices n3 ON n3.company_id = s.company_id AND n3.score_quarter = s.score_quarter AND n3.k = 3
  LEFT JOIN past_reports r1 ON r1.company_id = s.company_id AND r1.score_quarter = s.score_quarter AND r1.k = 1
  LEFT JOIN past_reports r2 ON r2.company_id = s.company_id AND r2.score_quarter = s.score_quarter AND r2.k = 2
  LEFT JOIN next_reports f1 ON f1.company_id = s.company_id AND f1.score_quarter = s.score_quarter AND f1.k = 1
  LEFT JOIN next_reports f2 ON f2.company_id = s.company_id AND f2.score_quarter = s.score_quarter AND f2.k = 2),
panel AS (
  SELECT *, CASE WHEN sector IS NOT NULL THEN fwd_return_1q - avg(fwd_return_1q) OVER (PARTITION BY sector, score_quarter) END
            AS fwd_excess_return_1q
  FROM raw_panel)"""


# --- one vintage, one row per entity ---------------------------------------------------------------

T0 = "2000-01-19"
EXCLUDED = ["S1", "S2", "S3", "S5", "S8"]


def vintage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the last quarter before t0, plus the impact score one quarter earlier as ``inv``."""
    rows = scores(spark, sf_dir).where(F.col("score_quarter").isin("1999Q3", "1999Q4"))
    now, before = F.col("score_quarter") == "1999Q4", F.col("score_quarter") == "1999Q3"
    a, b, c, d = (F.max(F.when(now, F.col(x))) for x in K.SCORE_COLUMNS)
    return rows.groupBy("company_id").agg(
        ((a.cast("double") + b + c + d) / 4).alias("maturity_index"),
        a.alias("adoption_score"), b.alias("proficiency_score"), c.alias("impact_score"), d.alias("conc"),
        F.max(F.when(before, F.col("ai_impact_score"))).alias("inv"),
    )


def vintage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the first quarter after t0 and controls of the quarters before it."""
    q = entity_quarters(spark, sf_dir).withColumn("d", F.col("period_end").cast("string"))

    def at(day: str, column: str):
        return F.max(F.when(F.col("d") == day, F.col(column).cast("double")))

    def price(day: str):
        return (at(day, "cents") / F.lit(100.0)) / at(day, "quantity")

    net = {d: at(d, "net") for d in ("1998-12-31", "1999-03-31", "1999-12-31", "2000-03-31")}
    margin = {d: at(d, "net_n") / net[d] for d in ("1999-03-31", "2000-03-31")}
    return q.groupBy("company_id").agg(
        (net["2000-03-31"] / net["1999-03-31"] - 1).alias("rev_growth_yoy"),
        (margin["2000-03-31"] - margin["1999-03-31"]).alias("op_margin_delta_yoy"),
        (price("2000-06-30") / price("2000-03-31") - 1).alias("fwd_ret_4m"),
        (net["1999-12-31"] / net["1998-12-31"] - 1).alias("prior_rev_growth_yoy"),
        (at("1999-12-31", "net_n") / net["1999-12-31"]).alias("builder_rate"),
        at("1999-12-31", "lines").cast("long").alias("n_matched"),
    )


def _build_cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigvane.operators.cross_section import analysis_table

    master = companies(spark, sf_dir).withColumnRenamed("market_cap", "mktcap_t0")
    group = F.pmod(F.regexp_replace("industry", "NATION_", "").cast("int"), F.lit(4)) + 1
    category = F.element_at(F.array(*[F.lit(c) for c in K.CATEGORIES]), group)
    return analysis_table(
        master.withColumn("category", category), vintage_scores(spark, sf_dir), vintage_outcomes(spark, sf_dir), key="company_id"
    )


def vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged wide analysis table."""
    return staged(spark, sf_dir, "vintage", _build_cross_section)


def _at(day: str, column: str) -> str:
    return f"max(CASE WHEN CAST(period_end AS VARCHAR) = '{day}' THEN CAST({column} AS DOUBLE) END)"


def _price_at(day: str) -> str:
    return f"({_at(day, 'cents')} / CAST(100 AS DOUBLE)) / {_at(day, 'quantity')}"


_NOW = "CASE WHEN score_quarter = '1999Q4' THEN {} END"
VINTAGE_SQL = f"""{COMPANIES_SQL}, {ENTITY_QUARTERS_SQL}, {SCORES_SQL},
vintage_scores AS (
  SELECT company_id, (CAST(max({_NOW.format(K.SCORE_COLUMNS[0])}) AS DOUBLE) + max({_NOW.format(K.SCORE_COLUMNS[1])})
           + max({_NOW.format(K.SCORE_COLUMNS[2])}) + max({_NOW.format(K.SCORE_COLUMNS[3])})) / 4 AS maturity_index,
         max({_NOW.format(K.SCORE_COLUMNS[0])}) AS adoption_score, max({_NOW.format(K.SCORE_COLUMNS[1])}) AS proficiency_score,
         max({_NOW.format(K.SCORE_COLUMNS[2])}) AS impact_score, max({_NOW.format(K.SCORE_COLUMNS[3])}) AS conc,
         max(CASE WHEN score_quarter = '1999Q3' THEN ai_impact_score END) AS inv
  FROM scores WHERE score_quarter IN ('1999Q3', '1999Q4') GROUP BY 1),
vintage_outcomes AS (
  SELECT company_id, {_at("2000-03-31", "net")} / {_at("1999-03-31", "net")} - 1 AS rev_growth_yoy,
         {_at("2000-03-31", "net_n")} / {_at("2000-03-31", "net")} - {_at("1999-03-31", "net_n")} / {_at("1999-03-31", "net")} AS op_margin_delta_yoy,
         ({_price_at("2000-06-30")}) / ({_price_at("2000-03-31")}) - 1 AS fwd_ret_4m,
         {_at("1999-12-31", "net")} / {_at("1998-12-31", "net")} - 1 AS prior_rev_growth_yoy,
         {_at("1999-12-31", "net_n")} / {_at("1999-12-31", "net")} AS builder_rate,
         CAST({_at("1999-12-31", "lines")} AS BIGINT) AS n_matched
  FROM entity_quarters GROUP BY 1),
vintage AS (
  SELECT c.company_id, c.ticker, c.company_name, c.sector, c.industry, c.market_cap AS mktcap_t0,
         CASE CAST(replace(c.industry, 'NATION_', '') AS INTEGER) % 4 WHEN 0 THEN '{K.CATEGORIES[0]}' WHEN 1 THEN '{K.CATEGORIES[1]}'
              WHEN 2 THEN '{K.CATEGORIES[2]}' ELSE '{K.CATEGORIES[3]}' END AS category,
         s.* EXCLUDE (company_id), o.* EXCLUDE (company_id)
  FROM companies c LEFT JOIN vintage_scores s USING (company_id) LEFT JOIN vintage_outcomes o USING (company_id))"""

_EXCLUDED_LIST = ", ".join(f"'{t}'" for t in EXCLUDED)


def _clip(c: str) -> str:
    over = "OVER (PARTITION BY sample)"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN greatest(quantile_cont({c}, 0.01) {over}, least(quantile_cont({c}, 0.99) {over}, {c})) END AS {c}"
    )


# The prepared table per sample, as the regressions read it.
BASE_SQL = f"""{VINTAGE_SQL},
tagged AS (SELECT 'full' AS sample, * FROM vintage
           UNION ALL SELECT 'excluded', * FROM vintage WHERE ticker NOT IN ({_EXCLUDED_LIST})),
base AS (
  SELECT sample, company_id, ticker, company_name, sector, category, maturity_index, adoption_score, proficiency_score, impact_score, conc, inv,
         CASE WHEN n_matched < 5 THEN NULL ELSE builder_rate END AS builder_rate, fwd_ret_4m, mktcap_t0,
         CASE WHEN mktcap_t0 > 0 THEN ln(mktcap_t0) END AS log_mktcap,
         {_clip("rev_growth_yoy")}, {_clip("op_margin_delta_yoy")}, {_clip("prior_rev_growth_yoy")}
  FROM tagged)"""
