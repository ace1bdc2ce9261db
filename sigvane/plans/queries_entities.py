"""Facts, universe, hiring and per-entity profiles."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane import runtime
from sigvane.operators import backtest, cross_section, facts, hiring, identity, pit, profile, universe
from sigvane.operators.ic import unpivot_pairs
from sigvane.operators.ordering import prefix_sums
from sigvane.plans import bindings as B
from sigvane.plans import sql_text as S
from sigvane.plans.queries_panel import dates, rounded, rounded_sql
from sigvane.plans.queries_signals import count
from sigvane.plans.registry import query
from sigvane.sources import readers, sinks

# --- quarterly facts ---------------------------------------------------------------------------------


def nested_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity quarters as nested filings facts: each quarter filed once, some restated later, plus annual items.

    Every third entity reports under the second revenue concept, with a stub of three periods under the first.
    """
    q = B.entity_quarters(spark, sf_dir)
    k = F.col("company_id").cast("int")
    start = F.add_months(F.date_add("period_end", 1), -3)

    def item(begin: Column, value: Column, lag: int) -> Column:
        return F.struct(
            begin.cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), value.cast("double").alias("val"),
            F.date_add("period_end", lag).cast("string").alias("filed"),
        )

    def items(condition: Column, value: Column) -> Column:
        return F.collect_list(F.when(condition, item(start, value, 30)))

    net, year = F.col("net"), F.year("period_end")
    second = k % 3 == 0
    restated = F.collect_list(F.when(year == 1999, item(start, net * 2, 400)))
    annual = F.collect_list(F.when(F.quarter("period_end") == 4, item(F.add_months(F.date_add("period_end", 1), -12), net * 4, 60)))
    every = F.lit(True)

    def usd(values: Column) -> Column:
        return F.struct(F.create_map(F.lit("USD"), values).alias("units"))

    staff = F.collect_list(item(F.col("period_end"), F.col("parts"), 10))
    rows = q.groupBy("company_id").agg(
        F.concat(items(~second | (year == 1995) & (F.quarter("period_end") < 4), net), annual).alias("first"),
        F.concat(restated, items(second, net)).alias("other"),
        items(every, F.col("net_n")).alias("income"),
        staff.alias("staff"),
    )
    revenue = F.create_map(
        F.lit(K.REVENUE_CONCEPTS[0]), usd(F.col("first")), F.lit(K.REVENUE_CONCEPTS[1]), usd(F.col("other")), F.lit(K.OPERATING_INCOME), usd(F.col("income"))
    )
    counts = F.struct(F.create_map(F.lit("pure"), F.col("staff")).alias("units"))
    entity = F.create_map(F.lit(K.EMPLOYEE_CONCEPT), counts, F.lit(K.SHARES_CONCEPT), counts)
    return rows.select(
        F.concat(F.lit("S"), "company_id").alias("ticker"), F.lpad("company_id", 10, "0").alias("cik"),
        F.create_map(F.lit("us-gaap"), revenue, F.lit("dei"), entity).alias("facts"),
    )


# Every third entity's usable series has the restated value only where it is filed first, i.e. never.
_SERIES = f"""{B.ENTITY_QUARTERS_SQL},
q AS (SELECT 'S' || company_id AS ticker, lpad(company_id, 10, '0') AS cik, period_end, CAST(net AS DOUBLE) AS net, CAST(net_n AS DOUBLE) AS net_n,
             CAST(parts AS DOUBLE) AS parts, CAST(company_id AS INTEGER) % 3 = 0 AS second FROM entity_quarters)"""
_T0 = B.T0


@query(
    "facts_quarterly_series",
    "K1 H7",
    f"""WITH {_SERIES}
    SELECT ticker, '{K.REVENUE_CONCEPTS[0]}' AS concept, count(*) AS periods, round(sum(net), 2) AS total, CAST(min(period_end + 30) AS VARCHAR) AS first_filed FROM q
    WHERE NOT second OR (year(period_end) = 1995 AND quarter(period_end) < 4) GROUP BY 1
    UNION ALL SELECT ticker, '{K.REVENUE_CONCEPTS[1]}', count(*), round(sum(CASE WHEN second THEN net ELSE net * 2 END), 2),
           CAST(min(CASE WHEN second THEN period_end + 30 ELSE period_end + 400 END) AS VARCHAR) FROM q WHERE second OR year(period_end) = 1999 GROUP BY 1""",
)
def facts_quarterly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = facts.quarterly_series(nested_facts(spark, sf_dir), K.REVENUE_CONCEPTS)
    return series.groupBy("ticker", "concept").agg(
        F.count(F.lit(1)).alias("periods"), F.round(F.sum("val"), 2).alias("total"), F.min("filed").cast("string").alias("first_filed")
    )


@query(
    "facts_concept_fallback",
    "K2",
    f"WITH {_SERIES} SELECT ticker, count(*) AS periods, round(sum(net), 2) AS total FROM q GROUP BY 1",
)
def facts_concept_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = facts.quarterly_series(nested_facts(spark, sf_dir), K.REVENUE_CONCEPTS)
    return facts.preferred_series(series, K.REVENUE_CONCEPTS).groupBy("ticker").agg(F.count(F.lit(1)).alias("periods"), F.round(F.sum("val"), 2).alias("total"))


def _near(alias: str, shift: int, tolerance: int, column: str) -> str:
    return f"""{alias} AS (SELECT t.ticker, arg_min(q.{column}, struct_pack(d := abs(q.period_end - (t.q_end - {shift})), e := q.period_end)) AS v
      FROM target t JOIN q ON q.ticker = t.ticker AND abs(q.period_end - (t.q_end - {shift})) <= {tolerance} GROUP BY 1)"""


@query(
    "facts_quarter_outcomes",
    "K3 K4 D15 H12",
    f"""WITH {_SERIES}, target AS (SELECT ticker, min(period_end) AS q_end, arg_min(net, period_end) AS rev_q FROM q WHERE period_end > DATE '{_T0}' GROUP BY 1),
    {_near("prev", 91, 21, "net")}, {_near("yoy", 365, 21, "net")}, {_near("oq", 0, 5, "net_n")}, {_near("oprev", 91, 21, "net_n")}, {_near("oyoy", 365, 21, "net_n")},
    staff AS (SELECT ticker, cik, arg_max(parts, period_end) AS employees, CAST(max(period_end) AS VARCHAR) AS employees_asof FROM q GROUP BY 1, 2)
    SELECT s.ticker, s.cik, CAST(t.q_end AS VARCHAR) AS q_end, t.rev_q, CAST(t.q_end + 30 AS VARCHAR) AS rev_filed, prev.v AS rev_prev, yoy.v AS rev_yoy,
           round(oq.v / t.rev_q, 6) AS op_margin_q, round(oq.v / t.rev_q - oprev.v / prev.v, 6) AS op_margin_delta_qoq,
           round(oq.v / t.rev_q - oyoy.v / yoy.v, 6) AS op_margin_delta_yoy, round(t.rev_q / prev.v - 1, 6) AS rev_growth_qoq,
           round(t.rev_q / yoy.v - 1, 6) AS rev_growth_yoy, employees, employees_asof
    FROM staff s LEFT JOIN target t ON s.ticker = t.ticker LEFT JOIN prev ON prev.ticker = s.ticker LEFT JOIN yoy ON yoy.ticker = s.ticker
    LEFT JOIN oq ON oq.ticker = s.ticker LEFT JOIN oprev ON oprev.ticker = s.ticker LEFT JOIN oyoy ON oyoy.ticker = s.ticker""",
)
def facts_quarter_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.quarter_outcomes(nested_facts(spark, sf_dir), _T0)
    return rows.select(
        "ticker", "cik", *dates("q_end", "rev_filed"), "rev_q", "rev_prev", "rev_yoy",
        *rounded("op_margin_q", "op_margin_delta_qoq", "op_margin_delta_yoy", "rev_growth_qoq", "rev_growth_yoy"), "employees", "employees_asof",
    )


@query(
    "facts_prior_growth",
    "K3 K5",
    f"""WITH {_SERIES}, target AS (SELECT ticker, max(period_end) AS q_end, arg_max(net, period_end) AS rev_q FROM q WHERE period_end < DATE '{_T0}' GROUP BY 1),
    {_near("yoy", 365, 21, "net")}
    SELECT t.ticker, round(t.rev_q / yoy.v - 1, 6) AS prior_rev_growth_yoy, CASE WHEN yoy.v IS NOT NULL THEN CAST(t.q_end AS VARCHAR) END AS prior_q_end
    FROM target t LEFT JOIN yoy ON yoy.ticker = t.ticker""",
)
def facts_prior_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.prior_growth(nested_facts(spark, sf_dir), _T0).select("ticker", *rounded("prior_rev_growth_yoy"), *dates("prior_q_end"))


def ticker_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices per part brand: mean unit price of the lines shipped that day, some days missing."""
    lines = B.table(spark, sf_dir, "lineitem").join(B.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    daily = lines.groupBy(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("price_date")).agg(
        F.sum(cents).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("n")
    )
    return daily.select("ticker", "price_date", (F.col("c") / F.lit(100.0) / F.col("n").cast("double")).alias("adjusted_close"))


_DAILY = """daily AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS price_date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_HORIZONS = [1, 2, 3, 4]


def _exit(day: str) -> str:
    return f"max(CASE WHEN price_date = {day} THEN close END)"


@query(
    "horizon_returns",
    "K7",
    f"""WITH {_DAILY}, cal AS (SELECT min(price_date) FILTER (price_date > DATE '{_T0}') AS d0, max(price_date) AS dl,
      {", ".join(f"max(price_date) FILTER (price_date <= DATE '{_T0}' + INTERVAL {h} MONTH) AS d{h}" for h in _HORIZONS)} FROM daily),
    p AS (SELECT ticker, max(price_date) AS last_price_date, {_exit("(SELECT d0 FROM cal)")} AS e,
      {", ".join(f"{_exit(f'(SELECT d{h} FROM cal)')} AS x{h}" for h in _HORIZONS)}, {_exit("(SELECT dl FROM cal)")} AS xl FROM daily GROUP BY 1)
    SELECT ticker, CAST((SELECT d0 FROM cal) AS VARCHAR) AS entry_date, round(e, 6) AS entry_price,
      {", ".join(f"round(x{h} / e - 1, 6) AS fwd_ret_{h}m" for h in _HORIZONS)}, round(xl / e - 1, 6) AS fwd_ret_latest,
      CAST(last_price_date AS VARCHAR) AS last_price_date FROM p""",
)
def horizon_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pit.horizon_returns(ticker_prices(spark, sf_dir), _T0, _HORIZONS)
    return rows.select("ticker", *dates("entry_date", "last_price_date"), *rounded("entry_price", *[f"fwd_ret_{h}m" for h in _HORIZONS], "fwd_ret_latest"))


@query(
    "horizon_returns_own_close",
    "K7",
    f"""WITH {_DAILY}, p AS (SELECT ticker, max(CASE WHEN price_date = (SELECT min(price_date) FROM daily WHERE price_date > DATE '{_T0}') THEN close END) AS e,
      {", ".join(f"arg_max(close, price_date) FILTER (price_date <= DATE '{_T0}' + INTERVAL {h} MONTH) AS x{h}" for h in _HORIZONS)} FROM daily GROUP BY 1)
    SELECT ticker, {", ".join(f"round(x{h} / e - 1, 6) AS fwd_ret_{h}m" for h in _HORIZONS)} FROM p""",
)
def horizon_returns_own_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pit.horizon_returns(ticker_prices(spark, sf_dir), _T0, _HORIZONS, per_ticker=True)
    return rows.select("ticker", *rounded(*[f"fwd_ret_{h}m" for h in _HORIZONS]))


@query(
    "stalled_series",
    "C22 I3",
    """WITH d AS (SELECT 'S' || l_suppkey AS ticker, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY 1)
    SELECT 'stops_' || last AS issue, ticker FROM d WHERE last < (SELECT max(last) FROM d) - 10
    UNION ALL SELECT 'no_data', 'S' || s_suppkey || '-X' FROM supplier WHERE s_suppkey % 10 = 0""",
)
def stalled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = B.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("price_date"), F.col("l_extendedprice").alias("adjusted_close")
    )
    k = F.col("s_suppkey")
    asked = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), k.cast("string"), F.when(k % 10 == 0, "-X").otherwise("")).alias("ticker"))
    return pit.stalled_series(prices, asked)


@query(
    "market_caps",
    "K6 H12 B29",
    f"""WITH {_SERIES}, shares AS (SELECT ticker, arg_max(parts, period_end) AS n FROM q WHERE period_end <= DATE '{_T0}' + 45 GROUP BY 1),
    first_day AS (SELECT min(period_end) AS d FROM q WHERE period_end > DATE '{_T0}'),
    price AS (SELECT ticker, CASE WHEN parts % 7 <> 0 THEN net / 10000 END AS p FROM q WHERE period_end = (SELECT d FROM first_day)),
    m AS (SELECT s.ticker, s.n * p.p AS own, c.s_acctbal AS spare FROM shares s LEFT JOIN price p ON p.ticker = s.ticker JOIN supplier c ON 'S' || c.s_suppkey = s.ticker)
    SELECT ticker, round(coalesce(own, nullif(spare, 0)), 4) AS mktcap_t0, CASE WHEN own IS NOT NULL THEN 'sec_shares_x_jan_price' WHEN spare <> 0 THEN 'fallback_current' END AS mktcap_source FROM m""",
)
def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = B.entity_quarters(spark, sf_dir)
    # Some closes are missing, which leaves the fallback.
    close = F.when(F.col("parts") % 7 != 0, F.col("net") / F.lit(10000.0))
    prices = q.select(F.concat(F.lit("S"), "company_id").alias("ticker"), F.col("period_end").alias("price_date"), close.alias("adjusted_close"))
    # A table-wide entry date needs every ticker's dates.
    fallback = B.companies(spark, sf_dir).select("ticker", "market_cap")
    return facts.market_caps(nested_facts(spark, sf_dir), prices, fallback, _T0).select("ticker", *rounded("mktcap_t0", places=4), "mktcap_source")


# --- score pages and the universe --------------------------------------------------------------------


def raw_score_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score history as page versions with JSON content, which has a dimension that no schema lists.

    Pages before 1998, the newest ones of every fourth entity and all of every fifth are pages whose content has no scores.
    """
    s = B.scores(spark, sf_dir).withColumn("year", F.year("snapshot_date"))

    def dimension(column: str) -> Column:
        v = F.col(column)
        evidence = F.transform(F.sequence(F.lit(1), v), lambda i: F.struct(F.when(i % 3 == 0, "sec").when(i % 3 == 1, "news").otherwise("podcast").alias("sourceType")))
        subs = F.array(
            F.struct(F.lit("leadershipDepth").alias("name"), F.when(v == 3, "n/a").otherwise(v.cast("string")).alias("score")),
            F.struct(F.lit("notListed").alias("name"), F.lit("1").alias("score")),
        )
        return F.struct(
            v.cast("string").alias("score"), F.when(v >= 4, "high").otherwise("low").alias("label"), F.lit("medium").alias("confidence"),
            evidence.alias("evidence"), F.array(F.lit("gap")).alias("missingEvidence"), subs.alias("subDimensions"),
        )

    key = F.col("company_id").cast("int")
    scored = (F.col("year") >= 1998) & ~((F.col("year") >= 2001) & (key % 4 == 0)) & (key % 5 != 1)
    scores = F.struct(
        (F.col("ai_adoption_score") + 0.5).cast("string").alias("maturityIndex"), F.lit("stage").alias("maturityStage"), F.col("snapshot_date").cast("string").alias("assessedAt"),
        dimension("ai_adoption_score").alias("adoption"), dimension("ai_fluency_score").alias("proficiency"), dimension("ai_impact_score").alias("impact"),
        dimension("ai_hiring_score").alias("ambition"),
    )
    content = F.to_json(F.struct(F.when(scored, scores).alias("aiScores"), F.array(F.lit("app"), F.lit("tool")).alias("aiAppsUsed")))
    version = (F.col("year") * 4 + F.quarter("snapshot_date")).cast("int")
    return s.select("company_id", version.alias("version"), F.col("snapshot_date").cast("string").alias("created_at"), content.alias("json"))


def score_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_score_pages(spark, sf_dir)
    return raw.select("company_id", "version", "created_at", F.from_json("json", universe.CONTENT_SCHEMA).alias("content"))


_PAGES = f"""{B.ENTITY_QUARTERS_SQL}, {B.SCORES_SQL},
last_scores AS (SELECT company_id, arg_max(ai_adoption_score, snapshot_date) AS a, arg_max(ai_fluency_score, snapshot_date) AS f, arg_max(ai_impact_score, snapshot_date) AS i,
                       max(snapshot_date) AS d, count(*) AS scored FROM scores WHERE year(snapshot_date) >= 1998
                       AND NOT (year(snapshot_date) >= 2001 AND CAST(company_id AS INTEGER) % 4 = 0) AND CAST(company_id AS INTEGER) % 5 <> 1 GROUP BY 1),
page_counts AS (SELECT company_id, count(*) AS n_pages, max(year(snapshot_date) * 4 + quarter(snapshot_date)) AS max_version FROM scores GROUP BY 1)"""


_FLATTENED_SQL = f"""WITH {_PAGES}
    SELECT company_id, year(d) * 4 + quarter(d) AS page_version, n_pages, CAST(a + 0.5 AS DOUBLE) AS maturity_index, CAST(a AS DOUBLE) AS adoption_score, CAST(f AS DOUBLE) AS proficiency_score,
           CASE WHEN a >= 4 THEN 'high' WHEN a IS NOT NULL THEN 'low' END AS adoption_label, a AS adoption_n_evidence, CASE WHEN a IS NOT NULL THEN 1 END AS impact_n_missing_evidence,
           CASE WHEN i <> 3 THEN CAST(i AS DOUBLE) END AS "sub_leadershipDepth", CAST(NULL AS DOUBLE) AS "sub_repeatability",
           a // 3 + f // 3 + i // 3 AS evidence_sec, (a + 2) // 3 + (f + 2) // 3 + (i + 2) // 3 AS evidence_news,
           (a + 1) // 3 + (f + 1) // 3 + (i + 1) // 3 AS evidence_other, CASE WHEN a IS NOT NULL THEN 2 END AS n_ai_apps_used,
           CASE WHEN a IS NOT NULL THEN 0 END AS n_initiatives, max_version
    FROM page_counts LEFT JOIN last_scores USING (company_id)"""


@query(
    "score_pages_flattened",
    "B33 E8 H4 D9",
    _FLATTENED_SQL,
)
def score_pages_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flattened(spark, sf_dir, score_pages(spark, sf_dir))


def _flattened(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    entities = B.companies(spark, sf_dir).select("company_id").join(pages.select("company_id").distinct(), "company_id", "left_semi")
    rows = universe.scored_entities(entities, pages)
    return rows.select(
        "company_id", "page_version", "n_pages", "maturity_index", "adoption_score", "proficiency_score", "adoption_label", "adoption_n_evidence",
        "impact_n_missing_evidence", "sub_leadershipDepth", "sub_repeatability", "evidence_sec", "evidence_news", "evidence_other", "n_ai_apps_used", "n_initiatives", "max_version",
    )


def _snapshot(spark: SparkSession, sf_dir: str) -> str:
    """The pages as JSON arrays, their content nested in the array's objects."""
    raw = raw_score_pages(spark, sf_dir)
    nested = raw.select("company_id", "version", "created_at", F.parse_json("json").alias("content"))
    return sinks.write_json_snapshot(nested, runtime.scratch_path(spark, "pages"), ["company_id", "version"], rows_per_file=500)


_PAGE_COLUMNS = "company_id string, version int, created_at string"


@query("score_pages_from_snapshot", "A8 B33 E8 H4 D9", _FLATTENED_SQL)
def score_pages_from_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened scores of pages that were stored as JSON arrays."""
    pages = readers.read_json_snapshot(spark, _snapshot(spark, sf_dir), f"{_PAGE_COLUMNS}, content {universe.CONTENT_SCHEMA}")
    return _flattened(spark, sf_dir, pages)


@query(
    "score_dimensions",
    "A8 B33",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.SCORES_SQL},
    scored AS (SELECT * FROM scores WHERE year(snapshot_date) >= 1998
               AND NOT (year(snapshot_date) >= 2001 AND CAST(company_id AS INTEGER) % 4 = 0) AND CAST(company_id AS INTEGER) % 5 <> 1),
    d AS ({" UNION ALL ".join(f"SELECT company_id, snapshot_date, '{n}' AS dimension, {c} AS v FROM scored" for n, c in (("adoption", "ai_adoption_score"), ("proficiency", "ai_fluency_score"), ("impact", "ai_impact_score"), ("ambition", "ai_hiring_score")))})
    SELECT company_id, year(snapshot_date) * 4 + quarter(snapshot_date) AS version, dimension, CAST(v AS DOUBLE) AS score, CASE WHEN v >= 4 THEN 'high' ELSE 'low' END AS label,
           'medium' AS confidence, coalesce(v, 0) AS n_evidence, 1 AS n_missing_evidence, 2 AS n_sub_dimensions FROM d""",
)
def score_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension of every page of the snapshot, listed in a schema or not."""
    pages = readers.read_json_snapshot(spark, _snapshot(spark, sf_dir), f"{_PAGE_COLUMNS}, content variant")
    return universe.score_dimensions(pages).drop("created_at")


def _duplicate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under the name of their nation, so names repeat; one nation is the test entity."""
    s = B.table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_nationkey") == 3, K.TEST_ENTITY_NAME).otherwise(F.concat(F.lit(" N"), F.col("s_nationkey").cast("string"), F.lit(" ")))
    return s.select(
        F.col("s_suppkey").cast("string").alias("company_id"), name.alias("name"), F.col("s_suppkey").alias("ord"),
        F.concat(F.lit("19"), F.lpad((F.col("s_suppkey") % 90 + 10).cast("string"), 2, "0")).alias("created_at"),
    )


_DEDUPE = f"""WITH {_PAGES}, e AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey AS ord, CASE WHEN s_nationkey = 3 THEN '{K.TEST_ENTITY_NAME}' ELSE 'N' || s_nationkey END AS name,
         coalesce(CAST(l.d AS VARCHAR), '19' || (s_suppkey % 90 + 10)) AS recent
  FROM supplier LEFT JOIN last_scores l ON l.company_id = CAST(s_suppkey AS VARCHAR)),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY recent DESC, ord) AS k, first_value(id) OVER (PARTITION BY name ORDER BY recent DESC, ord) AS kept_id FROM e)"""


@query("entity_dedup_kept", "H5 C18", f"{_DEDUPE} SELECT id AS company_id, name FROM r WHERE k = 1 AND name <> '{K.TEST_ENTITY_NAME}'")
def entity_dedup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = universe.dedupe_entities(_duplicate_entities(spark, sf_dir), score_pages(spark, sf_dir))
    return kept.select("company_id", "name")


@query(
    "entity_dedup_log",
    "H5 C18",
    f"""{_DEDUPE} SELECT 'drop_duplicate_name' AS action, name, id, kept_id FROM r WHERE k > 1 AND name <> '{K.TEST_ENTITY_NAME}'
    UNION ALL SELECT 'drop_test_row', name, id, NULL FROM r WHERE name = '{K.TEST_ENTITY_NAME}'""",
)
def entity_dedup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, log = universe.dedupe_entities(_duplicate_entities(spark, sf_dir), score_pages(spark, sf_dir))
    return log


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with even keys as the member list: names with a legal suffix, several share classes per brand."""
    p = B.table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    return p.select(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(", Inc.")).alias("member_name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.lpad(F.regexp_replace("p_brand", r"\D", ""), 10, "0").alias("cik"), F.col("p_type").alias("gics_sector"), F.col("p_partkey").alias("ord"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part").where("p_partkey % 2 = 1")
    return p.select(
        F.concat(F.upper("p_name"), F.lit(" "), F.upper("p_brand"), F.lit(" CORP")).alias("title"), F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.lpad(F.regexp_replace("p_brand", r"\D", ""), 10, "0").alias("cik"), F.col("p_partkey").alias("ord"),
    )


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as covered entities: names with a suffix, misspelt (a letter doubled), or not to be found."""
    p = B.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 12
    name = F.concat("p_name", F.lit(" "), "p_brand")
    shown = F.when(k == 3, F.concat(F.substring(name, 1, 4), F.substring(name, 4, 60))).when(k == 9, F.concat(F.lit("Unlisted "), name)).otherwise(F.concat(name, F.lit(" Group")))
    return p.select(F.col("p_partkey").cast("string").alias("company_id"), shown.alias("name"), F.col("p_type").alias("sector"))


_EXACT = r"""shown AS (
  SELECT CAST(p_partkey AS VARCHAR) AS company_id, p_name || ' ' || p_brand AS name, p_partkey % 12 AS k FROM part),
n AS (
  SELECT company_id, regexp_replace(lower(replace(CASE k WHEN 3 THEN substr(name, 1, 4) || substr(name, 4) WHEN 9 THEN 'Unlisted ' || name ELSE name END, '-', ' ')), ' +', ' ', 'g') AS norm FROM shown),
a AS (SELECT lower(p_name || ' ' || p_brand) AS norm, min(p_partkey) AS pk FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
b AS (SELECT lower(p_name || ' ' || p_brand) AS norm, min(p_partkey) AS pk FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)"""


@query(
    "entity_resolution_exact",
    "D10 H6",
    f"""WITH {_EXACT} SELECT n.company_id, CASE WHEN a.pk IS NOT NULL THEN 'P' || a.pk WHEN b.pk IS NOT NULL THEN 'R' || b.pk END AS ticker,
        CASE WHEN a.pk IS NOT NULL THEN 'member_exact' WHEN b.pk IS NOT NULL THEN 'registry_exact' ELSE 'other' END AS match_method
    FROM n LEFT JOIN a USING (norm) LEFT JOIN b USING (norm)""",
)
def entity_resolution_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part; which similar name a misspelt one is given is not said here, since SQL has no such ratio."""
    rows = identity.resolve_entities(_covered(spark, sf_dir), _members(spark, sf_dir), _registry(spark, sf_dir), {}, {})
    exact = F.col("match_method").endswith("_exact")
    return rows.select("company_id", F.when(exact, F.col("ticker")).alias("ticker"), F.when(exact, F.col("match_method")).otherwise("other").alias("match_method"))


def _known_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Covered entities, members and registry whose matches are known by construction.

    Six parts in a row share a name of 32 hexadecimal digits of a hash, so two names are never alike.  A name is held by
    members, registry or both (twice each); entities show it with a suffix, with a digit doubled or left out, or show a name of nobody's.
    """
    part = B.table(spark, sf_dir, "part").select("p_partkey", "p_type", (F.floor(F.col("p_partkey") / 6)).alias("j"), (F.col("p_partkey") % 6).alias("k"))
    key, j, k = F.col("p_partkey").cast("string"), F.col("j"), F.col("k")
    name = F.md5(j.cast("string").cast("binary"))
    members = part.where(k.isin(0, 1) & (j % 3 != 1)).select(
        F.concat(name, F.lit(", Inc.")).alias("member_name"), F.concat(F.lit("P"), key).alias("ticker"), F.lpad(key, 10, "0").alias("cik"), F.col("p_type").alias("gics_sector"), F.col("p_partkey").alias("ord")
    )
    registry = part.where(k.isin(2, 3) & (j % 3 != 2)).select(
        F.concat(F.upper(name), F.lit(" CORP")).alias("title"), F.concat(F.lit("R"), key).alias("ticker"), F.lpad(key, 10, "0").alias("cik"), F.col("p_partkey").alias("ord")
    )
    shown = (
        F.when(k == 2, F.concat(F.substring(name, 1, 4), F.substring(name, 4, 32)))
        .when(k == 3, F.substring(name, 1, 31))
        .when(k == 4, F.concat(F.lit("Unlisted "), F.md5(F.concat(F.lit("u"), key).cast("binary"))))
        .when(k == 1, F.concat(F.upper(name), F.lit(" Group")))
        .otherwise(name)
    )
    return part.select(key.alias("company_id"), shown.alias("name"), F.col("p_type").alias("sector")), members, registry


_HELD_PRIVATELY, _MAPPED = [hashlib.md5(x).hexdigest() for x in (b"3", b"u10")]
_PRIVATE, _MANUAL = {_HELD_PRIVATELY: "subsidiary"}, {f"Unlisted {_MAPPED}": "P12"}
_KNOWN = f"""parts AS (SELECT p_partkey, p_type, p_partkey // 6 AS j, p_partkey % 6 AS k, md5(CAST(p_partkey // 6 AS VARCHAR)) AS name FROM part),
member_of AS (SELECT j, min(p_partkey) AS pk FROM parts WHERE k IN (0, 1) AND j % 3 <> 1 GROUP BY 1),
registry_of AS (SELECT j, min(p_partkey) AS pk FROM parts WHERE k IN (2, 3) AND j % 3 <> 2 GROUP BY 1),
shown AS (SELECT *, CASE k WHEN 2 THEN substr(name, 1, 4) || substr(name, 4) WHEN 3 THEN substr(name, 1, 31) WHEN 4 THEN 'Unlisted ' || md5('u' || p_partkey)
                    WHEN 1 THEN upper(name) || ' Group' ELSE name END AS said FROM parts),
resolved AS (
  SELECT CAST(p_partkey AS VARCHAR) AS company_id, said AS name, true AS in_coverage,
         CASE WHEN said = '{_HELD_PRIVATELY}' THEN 'private:subsidiary' WHEN said = 'Unlisted {_MAPPED}' THEN 'manual' WHEN k = 4 OR m.pk IS NULL AND r.pk IS NULL THEN 'unmatched'
              ELSE CASE WHEN m.pk IS NOT NULL THEN 'member' ELSE 'registry' END || CASE WHEN k IN (2, 3) THEN '_fuzzy:' || shown.name ELSE '_exact' END END AS match_method,
         CASE WHEN said = '{_HELD_PRIVATELY}' THEN NULL WHEN said = 'Unlisted {_MAPPED}' THEN 'P12' WHEN k <> 4 THEN coalesce('P' || m.pk, 'R' || r.pk) END AS ticker
  FROM shown LEFT JOIN member_of m USING (j) LEFT JOIN registry_of r USING (j)),
universe AS (
  SELECT * FROM resolved UNION ALL
  SELECT NULL, name || ', Inc.', false, 'member_fill_in', 'P' || p_partkey FROM parts WHERE k IN (0, 1) AND j % 3 <> 1 AND 'P' || p_partkey NOT IN (SELECT ticker FROM resolved WHERE ticker IS NOT NULL))"""


@query(
    "entity_resolution_full",
    "D10 D11 D12 G10 H6 I5",
    f"""WITH {_KNOWN} SELECT company_id, name, CAST(in_coverage AS INTEGER) AS in_coverage, match_method, ticker, CAST(coalesce(starts_with(ticker, 'P'), false) AS INTEGER) AS in_members,
        CAST(ticker IS NOT NULL AND count(*) OVER (PARTITION BY ticker) > 1 AS INTEGER) AS ticker_dup FROM universe""",
)
def entity_resolution_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered, members, registry = _known_lists(spark, sf_dir)
    rows = identity.resolve_entities(covered, members, registry, _PRIVATE, _MANUAL)
    flagged = identity.flag_universe_duplicates(identity.add_uncovered_members(rows, members))
    flags = [F.col(c).cast("int").alias(c) for c in ("in_coverage", "in_members", "ticker_dup")]
    return flagged.select("company_id", "name", "match_method", "ticker", *flags)


@query(
    "universe_match_counts",
    "E27 D11",
    f"""WITH {_KNOWN} SELECT split_part(match_method, ':', 1) AS match_method, count(*) AS entities,
        count(*) FILTER (starts_with(ticker, 'P')) AS covered_members FROM resolved GROUP BY 1""",
)
def universe_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered, members, registry = _known_lists(spark, sf_dir)
    return identity.match_method_counts(identity.resolve_entities(covered, members, registry, _PRIVATE, _MANUAL))


@query(
    "fuzzy_part_names",
    "D11",
    """SELECT substr(name, 1, 4) || substr(name, 4) AS word, name, round(CAST(2 * length(name) AS DOUBLE) / (2 * length(name) + 1), 6) AS score
       FROM (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part)""",
)
def fuzzy_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with the fourth letter doubled against the distinct real ones: each finds its origin."""
    p = B.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("name")).distinct()
    words = p.select(F.concat(F.substring("name", 1, 4), F.substring("name", 4, 60)).alias("word")).distinct()
    return identity.fuzzy_match(words, p).select("word", "name", *rounded("score"))


@query(
    "universe_fill_in",
    "D12 I5",
    """SELECT 'P' || p_partkey AS ticker, 'member_fill_in' AS match_method FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0""",
)
def universe_fill_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    taken = members.where("ord % 3 = 0").select(
        F.lit("x").alias("company_id"), F.col("member_name").alias("name"), F.lit("s").alias("sector"), F.lit(True).alias("in_coverage"), "ticker", "cik",
        "gics_sector", F.lit(True).alias("in_members"), F.lit("member_exact").alias("match_method"),
    )
    both = identity.add_uncovered_members(taken, members)
    return both.where(F.col("match_method") == "member_fill_in").select("ticker", "match_method")


@query(
    "universe_duplicate_flags",
    "G10",
    """WITH u AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN 'T' || (s_suppkey % 40) END AS ticker, CASE WHEN s_suppkey % 9 <> 0 THEN lpad(CAST(s_nationkey AS VARCHAR), 10, '0') END AS cik,
                         s_suppkey % 2 = 0 AS cov, s_name FROM supplier)
    SELECT s_suppkey, CAST(ticker IS NOT NULL AND count(*) OVER (PARTITION BY ticker) > 1 AS INTEGER) AS ticker_dup,
           CAST(cik IS NOT NULL AND row_number() OVER (PARTITION BY cik ORDER BY cov DESC, s_name) > 1 AS INTEGER) AS share_class_dup FROM u""",
)
def universe_duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = B.table(spark, sf_dir, "supplier").select(
        "s_suppkey", k.cast("string").alias("company_id"), F.when(k % 7 != 0, F.concat(F.lit("T"), (k % 40).cast("string"))).alias("ticker"),
        F.when(k % 9 != 0, F.lpad(F.col("s_nationkey").cast("string"), 10, "0")).alias("cik"), (k % 2 == 0).alias("in_coverage"), F.col("s_name").alias("name"),
    )
    flagged = identity.flag_universe_duplicates(rows)
    return flagged.select("s_suppkey", F.col("ticker_dup").cast("int").alias("ticker_dup"), F.col("share_class_dup").cast("int").alias("share_class_dup"))


@query(
    "cross_section_best_rows",
    "C17 D13 H3",
    f"""WITH {B.VINTAGE_SQL}, u AS (SELECT company_id, 'T' || (CAST(company_id AS INTEGER) % 60) AS ticker, industry, sector FROM companies WHERE CAST(company_id AS INTEGER) % 11 <> 0),
    j AS (SELECT u.*, v.maturity_index, CAST(u.company_id AS INTEGER) % 5 AS page_version, o.fwd_ret_4m FROM u LEFT JOIN vintage_scores v USING (company_id)
          LEFT JOIN (SELECT ticker AS st, fwd_ret_4m FROM vintage) o ON o.st = replace(u.ticker, 'T', 'S'))
    SELECT company_id, ticker, round(maturity_index, 6) AS maturity_index, page_version, round(fwd_ret_4m, 6) AS fwd_ret_4m FROM j
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY maturity_index DESC NULLS LAST, page_version DESC NULLS LAST, company_id) = 1""",
)
def cross_section_best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("company_id").cast("int")
    members = B.companies(spark, sf_dir).select(
        "company_id", F.concat(F.lit("T"), (k % 60).cast("string")).alias("ticker"), (k % 11 != 0).alias("in_coverage"), F.lit(False).alias("share_class_dup")
    )
    scored = B.vintage_scores(spark, sf_dir).select("company_id", "maturity_index", (k % 5).alias("page_version"))
    returns = B.vintage(spark, sf_dir).select(F.replace("ticker", F.lit("S"), F.lit("T")).alias("ticker"), "fwd_ret_4m")
    rows = cross_section.cross_section(members, scored, returns)
    return rows.select("company_id", "ticker", *rounded("maturity_index"), count("page_version"), *rounded("fwd_ret_4m"))


@query(
    "pilot_selection",
    "H10",
    f"""WITH {B.VINTAGE_SQL}, b AS (SELECT ticker, company_id, sector, category, CASE WHEN maturity_index >= 3.5 THEN 'high' WHEN maturity_index >= 2.5 THEN 'mid' WHEN maturity_index IS NOT NULL THEN 'low' END AS band FROM vintage),
    s AS (SELECT * FROM b WHERE band IS NOT NULL QUALIFY row_number() OVER (PARTITION BY band, sector ORDER BY ticker) = 1)
    SELECT band, sector, ticker FROM s QUALIFY row_number() OVER (PARTITION BY band ORDER BY ticker) <= 4""",
)
def pilot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("maturity_index")
    bands = [("high", m >= 3.5), ("mid", m >= 2.5), ("low", m.isNotNull())]
    return hiring.stratified_pilot(B.vintage(spark, sf_dir), "maturity_index", "sector", "ticker", bands).select("band", "sector", "ticker")


@query(
    "first_entities",
    "H9",
    "SELECT 'S' || s_suppkey AS ticker FROM supplier ORDER BY ticker LIMIT 25",
)
def first_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.companies(spark, sf_dir).select("ticker").orderBy("ticker").limit(25)


@query(
    "filing_scores_flattened",
    "B34",
    f"""WITH {B.VINTAGE_SQL} SELECT ticker, CASE WHEN CAST(company_id AS INTEGER) % 4 <> 1 THEN CAST(inv AS DOUBLE) END AS inv, CASE WHEN CAST(company_id AS INTEGER) % 4 <> 1 THEN CAST(conc AS DOUBLE) END AS conc,
        CASE WHEN CAST(company_id AS INTEGER) % 4 = 1 THEN 0 ELSE 1 END AS mentions FROM vintage""",
)
def filing_scores_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.vintage(spark, sf_dir)

    def score(name: str) -> Column:
        return F.struct(F.col(name).cast("double").alias("score"))

    scored = F.struct(
        "ticker", F.struct(score("inv").alias("ai_investment_intensity"), score("conc").alias("ai_narrative_concreteness")).alias("dimensions"),
        F.array(F.struct(F.lit("spend").alias("quote"), F.lit("plan").alias("context"))).alias("capex_mentions"),
    )
    empty = F.struct("ticker", F.lit(True).alias("no_excerpts"))
    payload = F.when(F.col("company_id").cast("int") % 4 == 1, F.to_json(empty)).otherwise(F.to_json(scored))
    flat = universe.flatten_filings(v.select(payload.alias("payload")))
    return flat.select("ticker", "inv", "conc", F.size("capex_mentions").alias("mentions"))


# --- hiring ------------------------------------------------------------------------------------------


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classified postings: the user is the employer, five days are a snapshot, the type is the role."""
    role = F.create_map(*[F.lit(x) for pair in (("purchase", "ai-builder"), ("click", "ai-user"), ("signup", "ai-leader"), ("view", "non-ai")) for x in pair])
    first = F.lit("2024-01-01").cast("date")
    return B.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("ticker"), F.floor(F.datediff(F.to_date("ts"), first) / 5).cast("string").alias("snapshot"),
        (F.col("event_type") != "error").alias("is_company_match"), F.try_element_at(role, F.col("event_type")).alias("ai_role_type"), "value",
    )


_SIGNAL = """classified AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, CAST((CAST(ts AS DATE) - DATE '2024-01-01') // 5 AS VARCHAR) AS snapshot, event_type FROM events),
signal AS (
  SELECT ticker, snapshot, count(*) AS n_results, count(*) FILTER (event_type <> 'error') AS n_matched, count(*) FILTER (event_type = 'purchase') AS n_ai_builder,
         count(*) FILTER (event_type = 'click') AS n_ai_user, count(*) FILTER (event_type = 'signup') AS n_ai_leader FROM classified GROUP BY 1, 2),
rated AS (SELECT *, n_ai_builder / nullif(n_matched, 0) AS builder_rate, (n_ai_builder + n_ai_user + n_ai_leader) / nullif(n_matched, 0) AS ai_rate FROM signal)"""


@query("hiring_signal", "E7", f"WITH {_SIGNAL} SELECT * EXCLUDE (builder_rate, ai_rate), {rounded_sql('builder_rate', 'ai_rate')} FROM rated")
def hiring_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hiring.hiring_signal(classified(spark, sf_dir))
    return rows.select("ticker", "snapshot", "n_results", "n_matched", "n_ai_builder", "n_ai_user", "n_ai_leader", *rounded("builder_rate", "ai_rate"))


@query(
    "hiring_thin_rates",
    "C16",
    f"WITH {_SIGNAL} SELECT ticker, snapshot, CASE WHEN n_matched >= 5 THEN round(builder_rate, 6) END AS builder_rate FROM rated",
)
def hiring_thin_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hiring.null_thin_rates(hiring.hiring_signal(classified(spark, sf_dir))).select("ticker", "snapshot", *rounded("builder_rate"))


@query("hiring_top_builders", "H8", f"WITH {_SIGNAL} SELECT ticker, snapshot, n_ai_builder FROM rated ORDER BY n_ai_builder DESC, ticker, snapshot LIMIT 10")
def hiring_top_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hiring.top_by_builders(hiring.hiring_signal(classified(spark, sf_dir))).select("ticker", "snapshot", "n_ai_builder")


_TWO = f"""{_SIGNAL}, a AS (SELECT ticker, builder_rate FROM rated WHERE n_matched >= 5 AND snapshot = '0'), b AS (SELECT ticker, builder_rate FROM rated WHERE n_matched >= 5 AND snapshot = '5'),
both_sides AS (SELECT 0 AS k, a.builder_rate AS x, b.builder_rate AS y FROM a JOIN b USING (ticker))"""


@query("hiring_test_retest", "F29", f"WITH {_TWO}, {S.spearman_groups('both_sides', 'k', 3)} SELECT n_obs, round(ic, 6) AS ic, status FROM ics")
def hiring_test_retest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hiring.test_retest(hiring.hiring_signal(classified(spark, sf_dir)), "0", "5").select(count("n_obs"), *rounded("ic"), "status")


@query(
    "hiring_movers",
    "F30 G3",
    f"""WITH {_TWO}, ra AS (SELECT ticker, {S.average_rank("builder_rate")} / count(*) OVER () AS rk FROM a), rb AS (SELECT ticker, {S.average_rank("builder_rate")} / count(*) OVER () AS rk FROM b)
    SELECT ticker, round(ra.rk, 6) AS rank_before, round(rb.rk, 6) AS rank_after, round(rb.rk - ra.rk, 6) AS shift FROM ra JOIN rb USING (ticker)""",
)
def hiring_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hiring.movers(hiring.hiring_signal(classified(spark, sf_dir)), "0", "5").select("ticker", *rounded("rank_before", "rank_after", "shift"))


@query(
    "rerun_stability",
    "F31",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.SCORES_SQL}, long AS (SELECT 0 AS k, CAST(a.ai_adoption_score AS DOUBLE) AS x, CAST(b.ai_adoption_score AS DOUBLE) AS y
      FROM scores a JOIN scores b ON a.company_id = b.company_id WHERE a.score_quarter = '1999Q4' AND b.score_quarter = '1999Q3'), {S.spearman_groups("long", "k", 3)}
    SELECT count(*) AS n, round(avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN abs(x - y) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one,
           round((SELECT ic FROM ics), 6) AS rank_correlation FROM long""",
)
def rerun_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.scores(spark, sf_dir)
    runs = [s.where(F.col("score_quarter") == q) for q in ("1999Q4", "1999Q3")]
    return hiring.rerun_stability(*runs, "company_id", "ai_adoption_score").select("n", *rounded("exact", "within_one", "rank_correlation"))


def _label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity labels as the truth, a length rule as the prediction."""
    docs, labels = B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels")
    size = F.col("n_chars")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "ai-leader").when(F.col("quality") == 1, "ai-builder").otherwise("non-ai").alias("truth"),
        F.when(size > 4000, "ai-builder").when(size > 1000, "ai-user").when(size > 20, "non-ai").alias("prediction"),
        (F.col("lang") != "de").alias("company_match"),
    )


_PAIRS = """pairs AS (SELECT CASE WHEN toxic = 1 THEN 'ai-leader' WHEN quality = 1 THEN 'ai-builder' ELSE 'non-ai' END AS truth,
  CASE WHEN n_chars > 4000 THEN 'ai-builder' WHEN n_chars > 1000 THEN 'ai-user' WHEN n_chars > 20 THEN 'non-ai' END AS prediction, lang <> 'de' AS company_match
  FROM documents JOIN labels USING (doc_id))"""


@query(
    "classifier_agreement",
    "E18 D16",
    f"""WITH {_PAIRS}, m AS (SELECT *, truth IS DISTINCT FROM 'non-ai' AS t, prediction IS DISTINCT FROM 'non-ai' AS p FROM pairs WHERE company_match)
    SELECT (SELECT count(*) FROM pairs) AS predictions, round((SELECT avg(CASE WHEN company_match THEN 1.0 ELSE 0.0 END) FROM pairs), 6) AS match_rate, count(*) AS n,
           round(avg(CASE WHEN truth = prediction THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS binary_agreement,
           count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn,
           round(count(*) FILTER (t AND p) / greatest(count(*) FILTER (p), 1), 6) AS precision, round(count(*) FILTER (t AND p) / greatest(count(*) FILTER (t), 1), 6) AS recall FROM m""",
)
def classifier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = hiring.classifier_agreement(_label_pairs(spark, sf_dir))
    return result.select("predictions", *rounded("match_rate", "agreement", "binary_agreement", "precision", "recall"), "n", "tp", "fp", "fn")


@query(
    "confusion_matrix",
    "E18 M2",
    f"""WITH {_PAIRS} SELECT truth, {", ".join(f"count(*) FILTER (prediction = '{c}') AS {c.replace('-', '_')}" for c in K.ROLE_TYPES)} FROM pairs WHERE company_match GROUP BY 1""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = hiring.confusion_matrix(_label_pairs(spark, sf_dir), K.ROLE_TYPES)
    return wide.select("truth", *[F.col(f"`{c}`").cast("long").alias(c.replace("-", "_")) for c in K.ROLE_TYPES])


# --- profiles ----------------------------------------------------------------------------------------


@query(
    "latest_snapshots",
    "H11 L1 L4 L7",
    f"""WITH {B.PANEL_SQL} SELECT ticker, score_quarter, {K.COMPOSITE} AS ai_composite_score, {rounded_sql("revenue_growth_qoq", "operating_margin_t")} FROM panel
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score_quarter DESC) = 1""",
)
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.latest_snapshot(profile.normalize_panel(B.panel(spark, sf_dir)))
    return rows.select("ticker", "score_quarter", "ai_composite_score", *rounded("revenue_growth_qoq", "operating_margin_t"))


@query(
    "latest_outcomes",
    "L4",
    f"""WITH {B.PANEL_SQL} SELECT ticker, score_quarter, {rounded_sql(*K.REPORT_OUTCOMES)} FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score_quarter DESC) = 1""",
)
def latest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.latest_outcomes(B.panel(spark, sf_dir)).select("ticker", "score_quarter", *rounded(*K.REPORT_OUTCOMES))


@query("entity_history", "H11 L1", f"WITH {B.PANEL_SQL} SELECT ticker, score_quarter, {K.COMPOSITE} FROM panel WHERE ticker = 'S7'")
def entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.history(B.panel(spark, sf_dir), " s7").select("ticker", "score_quarter", K.COMPOSITE)


_LATEST = f"""{B.PANEL_SQL}, latest AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY score_quarter DESC) = 1)"""


@query(
    "peer_comparison",
    "L2",
    f"""WITH {_LATEST}, g AS (SELECT sector, score_quarter, count(*) AS num_peers, avg({K.COMPOSITE}) AS m, min({K.COMPOSITE}) AS lo, max({K.COMPOSITE}) AS hi FROM panel GROUP BY 1, 2)
    SELECT l.ticker, l.sector, l.score_quarter, num_peers, round(m, 6) AS peer_mean, lo AS peer_min, hi AS peer_max FROM latest l JOIN g USING (sector, score_quarter)""",
)
def peer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.peer_comparison(B.panel(spark, sf_dir))
    return rows.select(
        "ticker", "sector", "score_quarter", "num_peers", F.round(f"peer_mean_{K.COMPOSITE}", 6).alias("peer_mean"), F.col(f"peer_min_{K.COMPOSITE}").alias("peer_min"),
        F.col(f"peer_max_{K.COMPOSITE}").alias("peer_max"),
    )


@query(
    "peer_rows",
    "L2",
    f"""WITH {_LATEST} SELECT p.ticker, p.company_name, p.sector, p.score_quarter, p.{K.COMPOSITE} FROM panel p JOIN latest l ON l.ticker = 'S7' AND p.sector = l.sector AND p.score_quarter = l.score_quarter""",
)
def peer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.peer_rows(B.panel(spark, sf_dir), "S7").select("ticker", "company_name", "sector", "score_quarter", K.COMPOSITE)


@query(
    "backtest_summary_lookup",
    "L5",
    f"""WITH {B.PANEL_SQL}, longs AS ({S.pairs("panel", ["quarter", "company_id"], [K.COMPOSITE, "ai_hiring_score"], ["fwd_return_1q"])}),
    l AS (SELECT signal, quarter, y, {S.quantile_label("x", "company_id", "signal, quarter")} AS b FROM longs WHERE x IS NOT NULL AND y IS NOT NULL),
    w AS (SELECT signal, quarter, avg(y) FILTER (b = 5) - avg(y) FILTER (b = 1) AS r FROM l GROUP BY 1, 2)
    SELECT signal, round(avg(r), 6) AS average_quarterly_return, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(r) AS number_of_rebalances
    FROM w WHERE signal = 'ai_hiring_score' GROUP BY 1""",
)
def backtest_summary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = unpivot_pairs(B.panel(spark, sf_dir), ["quarter", "company_id"], [K.COMPOSITE, "ai_hiring_score"], ["fwd_return_1q"]).where(F.col("y").isNotNull())
    returns = backtest.quantile_returns(long, "x", ["company_id"], "y", keys=["signal"])
    metrics = backtest.backtest_metrics(backtest.long_short_returns(returns, keys=["signal"]), keys=["signal"])
    return profile.backtest_summary(metrics, "ai_hiring_score").select("signal", *rounded("average_quarterly_return", "hit_rate"), "number_of_rebalances")


def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence of the entity their id points to."""
    k = F.col("doc_id")
    return B.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), (k % 97).cast("string")).alias("ticker"), k.cast("string").alias("source_document_id"), "text"
    )


@query(
    "entity_profiles",
    "L6 L3 H11",
    f"""WITH {_LATEST}, ranked AS (SELECT ticker, score_quarter, rank() OVER (PARTITION BY sector, score_quarter ORDER BY {K.COMPOSITE} DESC) AS signal_rank,
          count(*) OVER (PARTITION BY sector, score_quarter) AS num_peers FROM panel WHERE {K.COMPOSITE} IS NOT NULL),
    spans AS (SELECT ticker, count(*) AS history_rows, min(score_quarter) AS first_period, max(score_quarter) AS last_period FROM panel GROUP BY 1),
    ev AS (SELECT 'S' || (doc_id % 97) AS ticker, CAST(doc_id AS VARCHAR) AS d, text AS t FROM documents),
    top AS (SELECT ticker, d, t FROM ev QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY d, t) <= 5),
    e AS (SELECT ticker, string_agg(t, ' ## ' ORDER BY d, t) AS evidence FROM top GROUP BY 1)
    SELECT l.ticker, l.score_quarter, signal_rank, num_peers, history_rows, first_period, last_period, evidence
    FROM latest l JOIN ranked r ON r.ticker = l.ticker AND r.score_quarter = l.score_quarter JOIN spans s ON s.ticker = l.ticker LEFT JOIN e ON e.ticker = l.ticker""",
)
def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.entity_profiles(B.panel(spark, sf_dir), document_evidence(spark, sf_dir))
    return rows.select(
        "ticker", "score_quarter", count("signal_rank"), count("num_peers"), "history_rows", "first_period", "last_period",
        F.array_join("evidence", " ## ").alias("evidence"),
    )


@query(
    "latest_turns",
    "H11",
    "SELECT conv_id, turn, role, length(text) AS characters FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
def latest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.latest_snapshot(B.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("characters"))


@query(
    "identifier_history_join",
    "A5 D3",
    """WITH h AS (SELECT 'C' || s_nationkey AS identifier, CAST(s_suppkey AS VARCHAR) AS company_id, DATE '1995-01-01' + CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) * 200 AS valid_from,
                       DATE '1995-01-01' + CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) * 200 AS valid_to FROM supplier)
    SELECT h.company_id AS held_by, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN h ON h.identifier = 'C' || c_nationkey
         AND CAST(o_orderdate AS DATE) >= valid_from AND CAST(o_orderdate AS DATE) < valid_to GROUP BY 1""",
)
def identifier_history_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation hold its code one after the other for 200 days each; orders find the holder of their day."""
    start = F.lit("1995-01-01").cast("date")
    suppliers = prefix_sums(B.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"])
    history = suppliers.select(
        F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("identifier"), F.col("s_suppkey").cast("string").alias("company_id"), (F.col("before") + 1).cast("int").alias("k")
    )
    history = history.select("identifier", "company_id", F.date_add(start, (F.col("k") - 1) * 200).alias("valid_from"), F.date_add(start, F.col("k") * 200).alias("valid_to"))
    orders = B.table(spark, sf_dir, "orders").join(B.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("identifier"))
    return readers.valid_identifiers(orders, history, "day").groupBy("held_by").agg(F.count(F.lit(1)).alias("orders"))


