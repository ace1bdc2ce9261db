"""Normalizers, quality checks, identifier joins, sources, sinks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane import runtime, schemas
from sigvane.functions import calendar as cal
from sigvane.functions import numeric as num
from sigvane.functions import text as tx
from sigvane.operators import cross_section, identity, normalize, quality, summaries
from sigvane.operators.ic import available
from sigvane.plans import bindings as B
from sigvane.plans.queries_panel import dates, rounded
from sigvane.plans.queries_signals import count
from sigvane.plans.registry import query
from sigvane.sources import ledger, readers, sinks, versions


def flag(name: str):
    return F.col(name).cast("int").alias(name)


# --- raw exports made from the tables: untidy text, as an export would have it ------------------------


def raw_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.companies(spark, sf_dir).select(
        F.concat(F.lit(" "), "company_id").alias("company_id"),
        F.concat(F.lower("ticker"), F.lit(" ")).alias("ticker"),
        F.col("company_name").alias("name"),
        F.concat("company_id", F.lit(".0")).alias("cik"),
        F.when(F.col("sector") == "ASIA", "nan").otherwise(F.col("sector")).alias("sector"),
        "industry",
        F.lit("us").alias("country"),
        F.col("market_cap").cast("string").alias("market_cap"),
    )


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticker = F.concat(F.lit(" s"), "company_id", F.lit(" "))
    return B.prices(spark, sf_dir).select(ticker.alias("ticker"), F.col("price_date").cast("string").alias("date"), F.col("adjusted_close").cast("string").alias("adjusted_close"))


def raw_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins alternate between ratio and percent; some availability dates are too early."""
    even = F.col("company_id").cast("int") % 2 == 0
    early = F.col("company_id").cast("int") % 10 == 3
    return B.reports(spark, sf_dir).select(
        "company_id",
        F.lower("fiscal_quarter").alias("fiscal_quarter"),
        F.col("fiscal_period_end").cast("string").alias("fiscal_period_end"),
        F.when(early, F.date_sub("fiscal_period_end", 1)).otherwise(F.date_add("fiscal_period_end", 25)).cast("string").alias("available_at"),
        F.col("revenue").cast("string").alias("revenue"),
        F.when(even & (F.col("operating_margin") * 100 > 1), F.col("operating_margin") * 100).otherwise(F.col("operating_margin")).cast("string").alias("operating_margin"),
        (F.col("employee_count") - 1).cast("string").alias("employee_count"),
    )


def raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with an unlisted column and, for some entities, values out of range or not whole."""
    k = F.col("company_id").cast("int") % 25
    first = F.col(K.SCORE_COLUMNS[0]).cast("string")
    spoilt = F.when(k == 7, "6").when(k == 8, "3.5").when(k == 9, "n/a").otherwise(first)
    return B.scores(spark, sf_dir).select(
        F.concat(F.lit(" s"), "company_id").alias("ticker"),
        F.col("snapshot_date").cast("string").alias("snapshot_date"),
        spoilt.alias(K.SCORE_COLUMNS[0]),
        *[F.col(c).cast("string").alias(c) for c in K.SCORE_COLUMNS[1:]],
        F.lit("export").alias("source_name"),
        F.when(k < 12, F.lit("x")).alias("unused_note"),
        k.cast("string").alias("batch_no"),
    )


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the source is the employer, the first line the title."""
    d = B.table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("job_posting_id"),
        F.concat(F.col("source"), F.lit(" ")).alias("ticker"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("department"),
        F.col("text").alias("description"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("collected_at"),
        F.when(F.col("doc_id") % 3 == 0, "Yes").when(F.col("doc_id") % 3 == 1, "0").alias("is_active"),
        F.lit("crawl").alias("source_name"),
    )


POSTING_WORDS = ["the", "und der", "que", "stupid"]
_TEXT = r"nullif(trim(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), '')"
_COLLAPSED = {c: _TEXT.format(c) for c in ("title", "department", "description")}
POSTINGS_SQL = rf"""raw_postings AS (
  SELECT CAST(doc_id AS VARCHAR) AS job_posting_id, upper(source) AS ticker, split_part(text, chr(10), 1) AS title, lang AS department, text AS description,
         CAST('2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS TIMESTAMP) AS collected_at,
         CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS is_active FROM documents),
hashed AS (
  SELECT job_posting_id, ticker, {_COLLAPSED["title"]} AS title, {_COLLAPSED["department"]} AS department, {_COLLAPSED["description"]} AS description,
         collected_at, is_active FROM raw_postings),
keyed AS (
  SELECT *, sha256(coalesce(lower(title), '') || ' | ' || coalesce(lower(department), '') || ' |  | ' || coalesce(lower(description), '') || ' | ') AS raw_hash
  FROM hashed),
postings AS (
  SELECT *, CAST(regexp_matches(lower(coalesce(title, '') || CASE WHEN title IS NULL THEN '' ELSE ' ' END || coalesce(description, '')),
                                '(^|[^a-z0-9])({"|".join(POSTING_WORDS)})([^a-z0-9]|$)') AS INTEGER) AS is_ai_keyword_matched,
         CAST(row_number() OVER (PARTITION BY ticker, raw_hash ORDER BY collected_at, job_posting_id) > 1 AS INTEGER) AS is_likely_duplicate
  FROM keyed)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_postings(raw_postings(spark, sf_dir), POSTING_WORDS).rows


@query(
    "normalize_postings",
    "B4 B10 B21 B30 B31 H2 J1 B1 B7",
    f"""WITH {POSTINGS_SQL} SELECT job_posting_id, ticker, title, department, CAST(length(description) AS BIGINT) AS description_length, raw_hash,
        CAST(collected_at AS VARCHAR) AS collected_at, is_active, is_ai_keyword_matched, is_likely_duplicate FROM postings""",
)
def normalize_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select(
        "job_posting_id", "ticker", "title", "department", F.length("description").cast("long").alias("description_length"), "raw_hash",
        F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected_at"), flag("is_active"), flag("is_ai_keyword_matched"), flag("is_likely_duplicate"),
    )


@query(
    "likely_duplicate_postings",
    "H2",
    f"WITH {POSTINGS_SQL} SELECT job_posting_id, ticker, raw_hash FROM postings WHERE is_likely_duplicate = 1",
)
def likely_duplicate_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.detect_likely_duplicates(postings(spark, sf_dir)).select("job_posting_id", "ticker", "raw_hash")


@query(
    "summarize_postings",
    "E1",
    f"""WITH {POSTINGS_SQL} SELECT count(*) AS rows, 0 AS companies, count(DISTINCT ticker) AS tickers, CAST(sum(is_ai_keyword_matched) AS BIGINT) AS ai_keyword_count,
        CAST(sum(is_likely_duplicate) AS BIGINT) AS likely_duplicate_count FROM postings""",
)
def summarize_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summarize_postings(postings(spark, sf_dir))


@query(
    "normalize_companies",
    "B1 B2 B3 B5 B17 B22",
    f"""WITH {B.COMPANIES_SQL} SELECT company_id, company_name, ticker, lpad(company_id, 10, '0') AS cik, CASE WHEN sector <> 'ASIA' THEN sector END AS sector,
        industry, 'US' AS country, CAST(NULL AS VARCHAR) AS active_from FROM companies""",
)
def normalize_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize_companies(raw_companies(spark, sf_dir)).rows
    return rows.select("company_id", "company_name", "ticker", "cik", "sector", "industry", "country", F.col("active_from").cast("string").alias("active_from"))


@query(
    "normalize_prices",
    "B6 B8 B13 B15 B17 B20 G1 H1",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.PRICES_SQL}
    SELECT 'S' || company_id AS ticker, CAST(price_date AS VARCHAR) AS price_date, year(price_date) || 'Q' || quarter(price_date) AS price_quarter,
           round(adjusted_close, 6) AS adjusted_close, round(adjusted_close / lag(adjusted_close) OVER (PARTITION BY company_id ORDER BY price_date) - 1, 6) AS daily_return,
           'market_data_export' AS source_name, CAST(price_date AS VARCHAR) AS available_on FROM prices""",
)
def normalize_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize_prices(raw_prices(spark, sf_dir)).rows
    return rows.select(
        "ticker", *dates("price_date"), "price_quarter", *rounded("adjusted_close", "daily_return"), "source_name",
        F.col("available_at").cast("date").cast("string").alias("available_on"),
    )


@query(
    "normalize_financials",
    "B8 B11 B19",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.REPORTS_SQL}
    SELECT company_id, fiscal_quarter, CAST(fiscal_period_end AS VARCHAR) AS fiscal_period_end, round(revenue, 4) AS revenue,
           round(operating_margin, 6) AS operating_margin, employee_count - 1 AS employee_count, 'financial_export' AS source_name FROM reports""",
)
def normalize_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize_financials(raw_financials(spark, sf_dir)).rows
    return rows.select(
        "company_id", "fiscal_quarter", *dates("fiscal_period_end"), *rounded("revenue", places=4), *rounded("operating_margin"), "employee_count", "source_name"
    )


@query(
    "financial_violations",
    "C5 C6",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.REPORTS_SQL}
    SELECT 'available_before_period_end' AS "check", 'warning' AS severity, company_id || '|' || lower(fiscal_quarter) AS key FROM reports
    WHERE CAST(company_id AS INTEGER) % 10 = 3
    UNION ALL SELECT 'employee_count_not_positive', 'error', company_id || '|' || lower(fiscal_quarter) FROM reports WHERE employee_count <= 1""",
)
def financial_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_financials(raw_financials(spark, sf_dir), allow_early=True).violations.select("check", "severity", "key")




@query(
    "normalize_scores",
    "B9 B12 B16 B18 E1",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.SCORES_SQL}, t AS (SELECT *, CAST(company_id AS INTEGER) % 25 AS k FROM scores)
    SELECT 'S' || company_id AS ticker, CAST(snapshot_date AS VARCHAR) AS snapshot_date, score_quarter,
           CASE WHEN k NOT IN (7, 8, 9) THEN ai_adoption_score END AS ai_adoption_score, ai_hiring_score, 1 AS available_at_assumption,
           CASE WHEN k < 12 THEN '{{"batch_no":"' || k || '","unused_note":"x"}}' ELSE '{{"batch_no":"' || k || '"}}' END AS metadata_json FROM t""",
)
def normalize_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize_scores(raw_scores(spark, sf_dir), "2002-01-01").rows
    return rows.select("ticker", *dates("snapshot_date"), "score_quarter", "ai_adoption_score", "ai_hiring_score", flag("available_at_assumption"), "metadata_json")


@query(
    "score_violations",
    "C3 B12",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, t AS (SELECT company_id, CAST(company_id AS INTEGER) % 25 AS k FROM entity_quarters)
    SELECT CASE k WHEN 7 THEN 'ai_adoption_score_out_of_range' WHEN 8 THEN 'ai_adoption_score_not_whole' ELSE 'ai_adoption_score_not_numeric' END AS "check",
           'error' AS severity, CASE k WHEN 7 THEN '6' WHEN 8 THEN '3.5' ELSE 'n/a' END AS detail, count(*) AS rows FROM t WHERE k IN (7, 8, 9) GROUP BY 1, 2, 3""",
)
def score_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.normalize_scores(raw_scores(spark, sf_dir), "2002-01-01").violations
    return found.groupBy("check", "severity", "detail").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "price_violations",
    "C4 C7",
    """SELECT 'adjusted_close_not_positive' AS "check", count(*) AS rows FROM supplier WHERE s_acctbal <= 0 HAVING count(*) > 0
    UNION ALL SELECT 'duplicate_price_record', count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)""",
)
def price_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as prices of a nation on one day: some are not positive, most nations repeat."""
    raw = B.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("ticker"), F.lit("2024-01-02").alias("price_date"), F.col("s_acctbal").cast("string").alias("adjusted_close")
    )
    return normalize.normalize_prices(raw).violations.groupBy("check").agg(F.count(F.lit(1)).alias("rows"))


# --- scalar functions ------------------------------------------------------------------------------


@query(
    "scalar_functions",
    "B9 B13 B14 B24 B25 B26 B27 B29 B5",
    """SELECT s_suppkey AS id, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 6) AS safe_log,
       round(CASE WHEN s_nationkey <> 0 THEN s_acctbal / s_nationkey - 1 END, 6) AS safe_return,
       round(CASE WHEN s_nationkey <> 0 THEN s_acctbal / s_nationkey END, 6) AS safe_ratio, round(s_acctbal - s_nationkey, 6) AS difference,
       replace(s_name, '#', '') AS name, year(DATE '2024-01-31' + s_nationkey * 40) || 'Q' || quarter(DATE '2024-01-31' + s_nationkey * 40) AS label,
       year(DATE '2024-01-31' + s_nationkey * 40 + INTERVAL 0 DAY) * 4 + quarter(DATE '2024-01-31' + s_nationkey * 40) + 2 AS shifted,
       CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_acctbal AS DOUBLE) END AS number FROM supplier""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance, k = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    day = F.date_add(F.lit("2024-01-31").cast("date"), F.col("s_nationkey") * 40)
    moved = cal.shift_quarter(cal.quarter_label(day), 3)
    index = F.substring(moved, 1, 4).cast("long") * 4 + F.substring(moved, 6, 1).cast("long") - 1
    text = F.when(F.col("s_nationkey") % 2 == 0, balance.cast("string")).otherwise("bad")
    dotted = tx.from_price_ticker(tx.to_price_ticker(F.replace("s_name", F.lit("#"), F.lit("."))))
    return B.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.round(num.safe_log(balance), 6).alias("safe_log"),
        F.round(num.safe_return(k, balance), 6).alias("safe_return"),
        F.round(num.safe_ratio(balance, k), 6).alias("safe_ratio"),
        F.round(num.safe_difference(balance, k), 6).alias("difference"),
        F.replace(dotted, F.lit("."), F.lit("")).alias("name"),
        cal.quarter_label(day).alias("label"),
        index.alias("shifted"),
        num.to_number(text).alias("number"),
    )


@query(
    "company_name_keys",
    "B28",
    r"""WITH n AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings Group' WHEN 2 THEN ' & Co.' ELSE ' the Incorporated-Labs' END AS name FROM customer)
    SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim(name)), '&', ' and '), '[.,''’\-()]', ' ', 'g'),
           '\b(incorporated|inc|corporation|corp|company|co|plc|ltd|llc|lp|sa|nv|se|ag|group|holdings|holding|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name_key FROM n""",
)
def company_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    tail = F.when(k == 0, ", Inc.").when(k == 1, " Holdings Group").when(k == 2, " & Co.").otherwise(" the Incorporated-Labs")
    return B.table(spark, sf_dir, "customer").select("c_custkey", tx.name_key(F.concat("c_name", tail)).alias("name_key"))


@query(
    "source_type_aliases",
    "B32",
    """SELECT role, CASE role WHEN 'user' THEN 'sec_filing' WHEN 'assistant' THEN 'news_article' ELSE 'Unknown Kind' END AS source_type, count(*) AS rows
       FROM conversations GROUP BY 1, 2""",
)
def source_type_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("role") == "user", " SEC filing").when(F.col("role") == "assistant", "News").otherwise("Unknown Kind ")
    rows = B.table(spark, sf_dir, "conversations").select("role", tx.normalize_source_type(raw).alias("source_type"))
    return rows.groupBy("role", "source_type").agg(F.count(F.lit(1)).alias("rows"))


# --- quality ---------------------------------------------------------------------------------------


@query(
    "duplicate_documents",
    "C7",
    "SELECT sha256(text) AS content, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), "lang")
    return quality.duplicate_keys(rows, ["content", "lang"])


@query(
    "master_duplicates",
    "C8",
    """SELECT s_nationkey, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 7 <> 0 THEN s_nationkey END AS s_nationkey FROM supplier)
       WHERE s_nationkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def master_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return quality.duplicate_keys(rows, ["s_nationkey"], ignore_nulls=True)


@query(
    "required_columns",
    "C1 C2",
    """SELECT 'lineitem' AS "table", 'l_missing' AS column_name, count(*) AS rows FROM lineitem
       UNION ALL SELECT 'orders', 'o_clerk', count(*) FROM orders""",
)
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"lineitem": ["l_orderkey", "l_missing"], "orders": ["o_orderkey", "o_clerk"]}
    out = None
    for name, columns in wanted.items():
        df = B.table(spark, sf_dir, name)
        for missing in quality.missing_columns(df, columns):
            row = df.agg(F.lit(name).alias("table"), F.lit(missing).alias("column_name"), F.count(F.lit(1)).alias("rows"))
            out = row if out is None else out.unionByName(row)
    return out


@query(
    "row_checks_events",
    "C2 C3 C13",
    """SELECT event_id, 'value_not_positive' AS "check" FROM events WHERE value <= 0.1 UNION ALL
       SELECT event_id, 'error_event' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'late' FROM events WHERE ts >= TIMESTAMP '2024-01-29'""",
)
def row_checks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        quality.Check("value_not_positive", F.col("value") <= 0.1, F.col("value")),
        quality.Check("error_event", F.col("event_type") == "error", F.col("event_type")),
        quality.Check("late", F.col("ts") >= F.lit("2024-01-29").cast("timestamp"), F.col("ts")),
    ]
    found = quality.row_violations(B.table(spark, sf_dir, "events"), checks, F.col("event_id"))
    return found.select(F.col("key").cast("long").alias("event_id"), "check")


_MARKERS = [r"@[a-z0-9.]+\.(com|org|net)", r"(api|secret|password|token)[_ -]?(key)?\s*[:=]"]


@query(
    "secret_markers",
    "C21",
    "SELECT doc_id, array_to_string(m, ' ; ') AS markers FROM (SELECT doc_id, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){m}') THEN '{m}' END" for m in _MARKERS)
    + "], lambda x: x IS NOT NULL) AS m FROM documents) WHERE len(m) > 0",
)
def secret_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.secret_scan(B.table(spark, sf_dir, "documents"), "text", "doc_id", _MARKERS)
    return found.select("doc_id", F.array_join("markers", " ; ").alias("markers"))


# --- identifiers -----------------------------------------------------------------------------------


@query(
    "join_on_company_id",
    "D1",
    f"""WITH {B.COMPANIES_SQL}, {B.ENTITY_QUARTERS_SQL}
    SELECT e.company_id, c.sector, count(*) AS rows, CAST(sum(e.net) AS BIGINT) AS net FROM entity_quarters e LEFT JOIN companies c USING (company_id) GROUP BY 1, 2""",
)
def join_on_company_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = identity.join_on_company_id(B.entity_quarters(spark, sf_dir), B.companies(spark, sf_dir))
    return joined.groupBy("company_id", "sector").agg(F.count(F.lit(1)).alias("rows"), F.sum("net").alias("net"))


@query(
    "join_on_ticker",
    "D2",
    f"""WITH {B.COMPANIES_SQL} SELECT 'S' || c_nationkey AS ticker, c.company_name, count(*) AS rows, 'joined on ticker; prefer company_id and audit unmatched rows' AS join_warning
    FROM customer LEFT JOIN companies c ON c.ticker = 'S' || c_nationkey GROUP BY 1, 2""",
)
def join_on_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = B.table(spark, sf_dir, "customer").select(F.concat(F.lit(" s"), F.col("c_nationkey").cast("string")).alias("ticker"))
    joined = identity.join_on_ticker(left, B.companies(spark, sf_dir))
    return joined.groupBy("ticker", "company_name", "join_warning").agg(F.count(F.lit(1)).alias("rows"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows that know some ids, some tickers, and some of neither kind."""
    k = F.col("company_id").cast("int")
    return B.prices(spark, sf_dir).select(
        F.when(k % 3 != 0, F.when(k % 11 == 1, F.concat(F.lit("x"), "company_id")).otherwise(F.col("company_id"))).alias("company_id"),
        F.when(k % 13 == 5, F.concat(F.lit("MISS"), "company_id")).otherwise(F.concat(F.lit("S"), "company_id")).alias("ticker"),
        "price_date", "adjusted_close",
    )


_ORPHANS = """orphans AS (SELECT CASE WHEN CAST(company_id AS INTEGER) % 3 <> 0 THEN CASE WHEN CAST(company_id AS INTEGER) % 11 = 1 THEN 'x' || company_id ELSE company_id END END AS company_id,
  CASE WHEN CAST(company_id AS INTEGER) % 13 = 5 THEN 'MISS' || company_id ELSE 'S' || company_id END AS ticker FROM prices)"""


@query(
    "unmatched_identifier_report",
    "C11 C12",
    f"""WITH {B.COMPANIES_SQL}, {B.ENTITY_QUARTERS_SQL}, {B.PRICES_SQL}, {_ORPHANS},
    bad AS (SELECT * FROM orphans WHERE (company_id IS NOT NULL AND company_id NOT IN (SELECT company_id FROM companies)) OR ticker NOT IN (SELECT ticker FROM companies))
    SELECT 'prices' AS dataset, ticker, count(*) AS unmatched_rows FROM bad GROUP BY 2""",
)
def unmatched_identifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unmatched_rows(B.companies(spark, sf_dir), {"prices": _orphans(spark, sf_dir)})


@query(
    "mapping_violations",
    "C10 C11",
    f"""WITH {B.COMPANIES_SQL}, {B.ENTITY_QUARTERS_SQL}, {B.PRICES_SQL}, {_ORPHANS}
    SELECT 'unknown_company_id' AS "check", company_id AS key FROM (SELECT DISTINCT company_id FROM orphans) WHERE company_id LIKE 'x%'
    UNION ALL SELECT 'conflicting_mapping', o.company_id FROM (SELECT DISTINCT company_id, ticker FROM orphans) o JOIN companies c ON o.company_id = c.company_id WHERE o.ticker <> c.ticker
    UNION ALL SELECT 'unmapped_ticker', ticker FROM (SELECT DISTINCT ticker FROM orphans WHERE company_id IS NULL) WHERE ticker NOT IN (SELECT ticker FROM companies)""",
)
def mapping_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.mapping_violations(_orphans(spark, sf_dir), B.companies(spark, sf_dir)).select("check", "key")


@query(
    "attach_company_id",
    "D3",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.PRICES_SQL} SELECT company_id, count(*) AS rows, round(avg(adjusted_close), 6) AS mean_price FROM prices GROUP BY 1""",
)
def attach_company_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("company_id").cast("int")
    rows = B.prices(spark, sf_dir).select(
        F.when(k % 3 != 0, F.col("company_id")).alias("company_id"), F.concat(F.lit(" s"), "company_id").alias("ticker"), "adjusted_close"
    )
    mapped = identity.attach_company_id(rows, B.companies(spark, sf_dir))
    return mapped.groupBy("company_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("adjusted_close"), 6).alias("mean_price"))


@query(
    "master_report",
    "C8 E2 C12",
    """SELECT 0 AS missing_company_id, 0 AS missing_ticker, CAST(sum(CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END) AS BIGINT) AS missing_sector, 0 AS duplicate_company_ids,
       (SELECT count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)) AS duplicate_tickers,
       (SELECT count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)) AS duplicate_mapping
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def master_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.master_report(raw_companies(spark, sf_dir).withColumn("ticker", F.col("industry")))


# --- summaries -------------------------------------------------------------------------------------


@query(
    "summarize_inputs",
    "E1 E2",
    f"""WITH {B.COMPANIES_SQL}, {B.ENTITY_QUARTERS_SQL}, {B.PRICES_SQL}, {B.REPORTS_SQL}
    SELECT 'prices' AS dataset, count(*) AS rows, count(DISTINCT company_id) AS tickers, 0 AS companies, count(DISTINCT price_date) AS quarters FROM prices
    UNION ALL SELECT 'financials', count(*), 0, count(DISTINCT company_id), count(DISTINCT fiscal_quarter) FROM reports""",
)
def summarize_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = summaries.summarize_prices(normalize.normalize_prices(raw_prices(spark, sf_dir)).rows)
    f = summaries.summarize_financials(normalize.normalize_financials(raw_financials(spark, sf_dir)).rows)
    return p.withColumn("dataset", F.lit("prices")).unionByName(f.withColumn("dataset", F.lit("financials")))


@query(
    "summarize_scores",
    "E1",
    f"""WITH {B.ENTITY_QUARTERS_SQL} SELECT count(*) AS rows, count(DISTINCT company_id) AS tickers, 0 AS companies, 'ticker' AS identifier, count(*) AS available_at_assumptions FROM entity_quarters""",
)
def summarize_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summarize_scores(normalize.normalize_scores(raw_scores(spark, sf_dir), "2002-01-01").rows)


@query(
    "summarize_master",
    "E2",
    f"""WITH {B.COMPANIES_SQL} SELECT count(*) AS companies, count(DISTINCT ticker) AS tickers, count(DISTINCT company_id) AS ciks,
        count(DISTINCT CASE WHEN sector <> 'ASIA' THEN sector END) AS sectors, count(CASE WHEN sector = 'ASIA' THEN 1 END) AS missing_sector FROM companies""",
)
def summarize_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summarize_master(normalize.normalize_companies(raw_companies(spark, sf_dir)).rows)


_GAPS = ["fwd_return_1q", "fwd_return_2q", "future_revenue_growth_qoq", "prior_return_1q"]


@query(
    "summarize_panel",
    "E3",
    f"""WITH {B.PANEL_SQL} SELECT count(*) AS rows, count(DISTINCT company_id) AS companies, count(DISTINCT score_quarter) AS quarters, 0 AS timing_violations,
        {", ".join(f"count(*) - count({g}) AS missing_{g}" for g in _GAPS)} FROM panel""",
)
def summarize_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.summarize_panel(B.panel(spark, sf_dir))


@query(
    "timing_audit",
    "C13 C14",
    f"""WITH {B.PANEL_SQL} SELECT score_quarter, count(*) AS rows, count(*) AS violations, 0 AS strict_rows FROM panel GROUP BY 1""",
)
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions dated a day before the scores exist: all flagged, none left when strict."""
    early = B.scores(spark, sf_dir).withColumn("prediction_date", F.date_add("snapshot_date", 1))
    inputs = (B.companies(spark, sf_dir), early, B.prices(spark, sf_dir), B.reports(spark, sf_dir))
    loose = B.build_panel(*inputs, strict=False).groupBy("score_quarter").agg(F.count(F.lit(1)).alias("rows"), F.count_if("timing_violation").alias("violations"))
    strict = B.build_panel(*inputs, strict=True).groupBy("score_quarter").agg(F.count(F.lit(1)).alias("strict_rows"))
    return loose.join(strict, "score_quarter", "left").na.fill(0, ["strict_rows"])


@query(
    "sector_coverage",
    "E4",
    f"WITH {B.PANEL_SQL} SELECT sector, count(DISTINCT company_id) AS company_count FROM panel GROUP BY 1",
)
def sector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.sector_coverage(B.panel(spark, sf_dir))


_VARIABLES = ["maturity_index", "conc", "inv", "builder_rate", "rev_growth_yoy", "op_margin_delta_yoy", "fwd_ret_4m", "prior_rev_growth_yoy"]


@query(
    "variable_coverage",
    "E17 D18",
    f"WITH {B.VINTAGE_SQL} SELECT 'total' AS variable, count(*) AS rows FROM vintage"
    + "".join(f" UNION ALL SELECT '{v}', count({v}) FROM vintage" for v in _VARIABLES),
)
def variable_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = cross_section.analysis_table(B.vintage(spark, sf_dir).drop("company_name"), B.companies(spark, sf_dir).select("ticker", "company_name"))
    return summaries.coverage(named, available(named, _VARIABLES))


@query(
    "outcome_by_score",
    "E13",
    f"WITH {B.VINTAGE_SQL} SELECT conc, round(avg(rev_growth_yoy), 6) AS mean, count(rev_growth_yoy) AS n FROM vintage WHERE conc IS NOT NULL AND rev_growth_yoy IS NOT NULL GROUP BY 1",
)
def outcome_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.mean_by(B.vintage(spark, sf_dir), ["conc"], "rev_growth_yoy").select(count("conc"), *rounded("mean"), "n")


@query(
    "high_minus_low",
    "E14",
    f"""WITH {B.VINTAGE_SQL}, s AS (SELECT avg(rev_growth_yoy) FILTER (conc IN (4, 5)) AS mh, avg(rev_growth_yoy) FILTER (conc IN (1, 2)) AS ml,
      var_samp(rev_growth_yoy) FILTER (conc IN (4, 5)) AS vh, var_samp(rev_growth_yoy) FILTER (conc IN (1, 2)) AS vl,
      count(rev_growth_yoy) FILTER (conc IN (4, 5)) AS n_hi, count(rev_growth_yoy) FILTER (conc IN (1, 2)) AS n_lo FROM vintage)
    SELECT round(mh - ml, 6) AS diff, round((mh - ml) / sqrt(vh / n_hi + vl / n_lo), 6) AS t, n_hi, n_lo FROM s""",
)
def high_minus_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.high_minus_low(B.vintage(spark, sf_dir), "conc", "rev_growth_yoy").select(*rounded("diff", "t"), "n_hi", "n_lo")


@query(
    "quantile_sort",
    "E15 G4",
    f"""WITH {B.VINTAGE_SQL}, r AS (SELECT maturity_index AS s, rev_growth_yoy AS y, company_id FROM vintage WHERE maturity_index IS NOT NULL AND rev_growth_yoy IS NOT NULL),
    q AS (SELECT y, greatest(1, ((row_number() OVER (ORDER BY s, company_id) - 1) * 5 + count(*) OVER () - 2) // (count(*) OVER () - 1)) AS quantile FROM r),
    m AS (SELECT quantile, avg(y) AS mean, count(*) AS n FROM q GROUP BY 1)
    SELECT quantile, round(mean, 6) AS mean, n, round((SELECT mean FROM m WHERE quantile = 5) - (SELECT mean FROM m WHERE quantile = 1), 6) AS top_minus_bottom FROM m""",
)
def quantile_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = summaries.quantile_sort(B.vintage(spark, sf_dir), "maturity_index", "rev_growth_yoy", ["company_id"])
    return result.select(count("quantile"), *rounded("mean", "top_minus_bottom"), "n")


@query(
    "category_means",
    "E16",
    f"WITH {B.VINTAGE_SQL} SELECT category, round(avg(fwd_ret_4m), 6) AS mean, count(fwd_ret_4m) AS n FROM vintage WHERE category IS NOT NULL AND fwd_ret_4m IS NOT NULL GROUP BY 1",
)
def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.mean_by(B.vintage(spark, sf_dir), ["category"], "fwd_ret_4m").select("category", *rounded("mean"), "n")


@query(
    "sector_medians",
    "E24",
    f"WITH {B.VINTAGE_SQL} "
    + " UNION ALL ".join(f"SELECT sector, '{v}' AS variable, round(median({v}), 6) AS median FROM vintage WHERE {v} IS NOT NULL GROUP BY 1" for v in ("rev_growth_yoy", "maturity_index", "fwd_ret_4m")),
)
def sector_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.medians_by(B.vintage(spark, sf_dir), "sector", ["rev_growth_yoy", "maturity_index", "fwd_ret_4m"]).select("sector", "variable", *rounded("median"))


@query(
    "describe_prices",
    "E25",
    """SELECT l_returnflag, count(*) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
       max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem GROUP BY 1""",
)
def describe_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    result = summaries.describe(lines, ["l_returnflag"], "l_extendedprice")
    return result.select("l_returnflag", "count", *rounded("mean", "std", places=4), "min", "max", *rounded("p25", "p50", "p75"))


@query(
    "price_histogram",
    "E25",
    "SELECT CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 50000 THEN 11 ELSE CAST(floor(l_extendedprice / 5000) AS BIGINT) + 1 END AS bin, count(*) AS rows FROM lineitem GROUP BY 1",
)
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.histogram(B.table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 50000.0, 10)


@query("event_type_counts", "E25 E26", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.value_counts(B.table(spark, sf_dir, "events"), "event_type")


# --- sources and sinks: written to the shared folder, read back --------------------------------------


@query(
    "csv_round_trip",
    "A2 A3 A5 A6 A7",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.PRICES_SQL}, {B.REPORTS_SQL} SELECT 'prices' AS dataset, count(*) AS rows, round(sum(adjusted_close), 2) AS total FROM prices
    UNION ALL SELECT 'financials', count(*), round(sum(revenue), 2) FROM reports""",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = sinks.write_table(raw_prices(spark, sf_dir), runtime.scratch_path(spark, "prices.csv"))
    reports = raw_financials(spark, sf_dir).withColumn("employee_count", F.lit(None).cast("string"))
    financials = sinks.write_table(reports, runtime.scratch_path(spark, "financials.csv"))
    a = readers.load_prices(spark, prices).agg(F.lit("prices").alias("dataset"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("adjusted_close"), 2).alias("total"))
    b = readers.load_financials(spark, financials, allow_early=True).agg(
        F.lit("financials").alias("dataset"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("revenue"), 2).alias("total")
    )
    return a.unionByName(b)


@query(
    "postings_csv_round_trip",
    "A4 A6 B21 B30 H2 J1",
    f"""WITH {POSTINGS_SQL} SELECT job_posting_id, ticker, title, department, CAST(length(description) AS BIGINT) AS description_length, raw_hash,
        CAST(collected_at AS VARCHAR) AS collected_at, is_active, is_ai_keyword_matched, is_likely_duplicate FROM postings""",
)
def postings_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written as CSV, their descriptions with line breaks inside quotes, and loaded again."""
    path = sinks.write_table(raw_postings(spark, sf_dir), runtime.scratch_path(spark, "postings.csv"))
    checked = normalize.normalize_postings(readers.read_table(spark, path, multi_line=True), POSTING_WORDS)
    return checked.rows.select(
        "job_posting_id", "ticker", "title", "department", F.length("description").cast("long").alias("description_length"), "raw_hash",
        F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected_at"), flag("is_active"), flag("is_ai_keyword_matched"), flag("is_likely_duplicate"),
    )


def _search_files(spark: SparkSession, sf_dir: str, delivery: int) -> DataFrame:
    """(ticker, value): one JSON document a company, with a result per scored quarter.

    The second delivery has companies that the first had not, lacks some that it had and has other titles for a third.
    """
    key = F.col("company_id").cast("int")
    here = key % 5 != 0 if delivery == 1 else key % 7 != 6
    title = F.concat("score_quarter", F.when((key % 3 == 0) & F.lit(delivery == 2), " again").otherwise(""))
    day = F.col("snapshot_date").cast("string")
    result = F.struct(title.alias("title"), F.concat(F.lit("https://jobs.example/"), "company_id", F.lit("/"), day).alias("url"), day.alias("published_date"))
    ticker = F.concat(F.lit("S"), "company_id").alias("ticker")
    results = B.staged(spark, sf_dir, "scores", B.scores).where(here).select(ticker, day.alias("day"), result.alias("result"))
    packed = results.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "result"))), lambda x: x["result"]).alias("results"))
    return packed.select("ticker", F.to_json(F.struct("ticker", F.concat(F.lit("Company "), "ticker").alias("company"), F.lit("2002").alias("snapshot"), "results")).alias("value"))


@query(
    "search_results_by_key",
    "A9 A17",
    f"""WITH {B.ENTITY_QUARTERS_SQL}, {B.SCORES_SQL}, t AS (SELECT *, CAST(company_id AS INTEGER) AS k FROM scores),
    a AS (SELECT *, CASE WHEN k % 7 = 6 THEN 'deleted' WHEN k % 5 = 0 THEN 'added' WHEN k % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM t WHERE k % 5 <> 0 OR k % 7 <> 6)
    SELECT 'S' || company_id AS key, action, CAST(row_number() OVER (PARTITION BY company_id ORDER BY snapshot_date) - 1 AS INTEGER) AS result_index,
           score_quarter || CASE WHEN action <> 'unchanged' AND k % 3 = 0 THEN ' again' ELSE '' END AS title, CAST(snapshot_date AS VARCHAR) AS published_date FROM a WHERE action <> 'deleted'
    UNION ALL SELECT DISTINCT 'S' || company_id, action, NULL, NULL, NULL FROM a WHERE action = 'deleted'""",
)
def search_results_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries of per-key files: the second run parses what is new or changed and keeps the rows of the rest."""
    root = runtime.scratch_path(spark, "search")
    companies = B.table(spark, sf_dir, "supplier").count()
    for delivery in (1, 2):
        folder = f"{root}/in/{delivery}"
        sinks.write_by_key(_search_files(spark, sf_dir, delivery), folder, "ticker", companies)
        log = ledger.refresh(spark, folder, f"{root}/tables", schemas.SEARCH_RESULTS, r"/ticker=([^/]+)/", "*.txt")
    results = versions.read_current(spark, f"{root}/tables", "rows").select("key", F.posexplode("results").alias("result_index", "_r"))
    return log.join(results, "key", "left").select("key", "action", "result_index", "_r.title", "_r.published_date")


@query(
    "snapshot_latest",
    "A13 A14 A6",
    """SELECT event_type, count(*) AS rows, 1 AS missing_tables FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1""",
)
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by day; only the newest day's folder is read back."""
    path = runtime.scratch_path(spark, "events.parquet")
    B.table(spark, sf_dir, "events").withColumn("snapshot", F.to_date("ts")).repartition("snapshot").write.partitionBy("snapshot").parquet(path)
    missing: list[str] = []
    absent = readers.read_optional(spark, runtime.scratch_path(spark, "absent.parquet"), "event_type string", "absent", missing)
    newest = readers.latest_snapshot(readers.read_table(spark, path)).select("event_type").unionByName(absent)
    return newest.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows")).withColumn("missing_tables", F.lit(len(missing)))


@query(
    "ordered_output",
    "H1 A6",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS position FROM lineitem",
)
def ordered_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stored by date: where every one stands in the files."""
    path = runtime.scratch_path(spark, "ordered.parquet")
    index = sinks.write_ordered(B.table(spark, sf_dir, "lineitem"), path, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return sinks.read_ordered(spark, path, index).select("l_orderkey", "l_linenumber", "position")


@query(
    "row_count_manifest",
    "A16",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("supplier", "orders", "lineitem", "documents", "pages")),
)
def row_count_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest({t: B.table(spark, sf_dir, t) for t in ("supplier", "orders", "lineitem", "documents", "pages")})


@query(
    "unprocessed_rows",
    "A17 I3",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unprocessed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.new_rows(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query(
    "incremental_landing",
    "A9 A17",
    "SELECT role, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY 1",
)
def incremental_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations land in two deliveries; the second run takes only the files of the second."""
    from sigvane.streaming.landing import land_new_files

    root = runtime.scratch_path(spark, "landing")
    talk = B.table(spark, sf_dir, "conversations")
    schema = "conv_id long, turn long, role string, text string"
    for part in (0, 1):
        talk.where(F.col("conv_id") % 2 == part).write.mode("append").json(f"{root}/in")
        land_new_files(spark, f"{root}/in", schema, f"{root}/out", f"{root}/progress")
    landed = spark.read.schema(schema).parquet(f"{root}/out")
    return landed.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))


@query(
    "stage_outputs",
    "A15",
    f"""WITH {B.VINTAGE_SQL} SELECT 'vintage' AS "table", count(*) AS rows, '{",".join(K.CROSS_SECTION_SIGNALS)}' AS signals, 'descriptive only' AS caveat FROM vintage
    UNION ALL SELECT 'coverage', {len(_VARIABLES) + 1}, '{",".join(K.CROSS_SECTION_SIGNALS)}', 'descriptive only'""",
)
def stage_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.scratch_path(spark, "analysis")
    table = B.vintage(spark, sf_dir)
    tables = {"vintage": table, "coverage": summaries.coverage(table, _VARIABLES)}
    metadata = sinks.write_outputs(tables, folder, K.CROSS_SECTION_SIGNALS, [K.PRIMARY_OUTCOME], "descriptive only")
    return metadata.select(F.inline("tables"), F.array_join("signals", ",").alias("signals"), "caveat").select("table", "rows", "signals", "caveat")


