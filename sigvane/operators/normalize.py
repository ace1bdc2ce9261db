"""Raw exports to canonical tables.  Raw columns may be text; every parse failure becomes a violation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions import calendar as cal
from sigvane.functions import numeric as num
from sigvane.functions import text as tx
from sigvane.operators import quality as q
from sigvane.operators.ordering import attach_by_key

_IDS = ("company_id", "ticker")


def _column(df: DataFrame, name: str, default: Column | None = None) -> Column:
    if name in df.columns:
        return F.col(name)
    return default if default is not None else F.lit(None).cast("string")


def _bad_parse(df: DataFrame, name: str, parsed: Column, kind: str) -> q.Check:
    return q.Check(f"{name}_{kind}", parsed.isNull() & ~tx.is_missing(F.col(name)), F.col(name))


def _missing(name: str, column: Column) -> q.Check:
    return q.Check(f"{name}_missing", tx.is_missing(column), column)


_SCORE_COLUMNS_OUT = [
    "company_id", "ticker", "company_name", "snapshot_date", "score_quarter", *K.SCORE_COLUMNS,
    "source_name", "source_url", "available_at", "available_at_assumption", "metadata_json",
]


def normalize_scores(df: DataFrame, available_at: str | None = None) -> q.Checked:
    """Score export to canonical scores.  Unlisted columns are folded to JSON with sorted keys."""
    q.require_columns(df, ["snapshot_date", "source_name", *K.SCORE_COLUMNS], "score file")
    q.require_any_column(df, _IDS, "score file")
    if "available_at" not in df.columns and not available_at:
        raise ValueError("score file is missing available_at; pass the assumed date only when it is documented")
    known = set(_SCORE_COLUMNS_OUT)
    extra = sorted(c for c in df.columns if c not in known)
    given = "available_at" in df.columns
    stamp = cal.parse_timestamp(F.col("available_at")) if given else F.lit(available_at).cast("timestamp")
    snapshot = cal.parse_date(F.col("snapshot_date"))
    metadata = F.to_json(F.struct(*[F.col(c) for c in extra])) if extra else F.lit("{}")
    rows = df.select(
        tx.clean_text(_column(df, "company_id")).alias("company_id"),
        tx.normalize_ticker(_column(df, "ticker")).alias("ticker"),
        _column(df, "company_name").alias("company_name"),
        snapshot.alias("snapshot_date"),
        cal.quarter_label(snapshot).alias("score_quarter"),
        *[F.when(num.is_whole_score(F.col(c)), num.to_number(F.col(c)).cast("int")).alias(c) for c in K.SCORE_COLUMNS],
        F.col("source_name"),
        F.coalesce(_column(df, "source_url"), _column(df, "source_reference")).alias("source_url"),
        stamp.alias("available_at"),
        F.lit(not given).alias("available_at_assumption"),
        metadata.alias("metadata_json"),
    )
    checks = [_missing("snapshot_date", F.col("snapshot_date")), _bad_parse(df, "snapshot_date", snapshot, "unparsable")]
    if given:
        checks.append(_bad_parse(df, "available_at", stamp, "unparsable"))
    for c in K.SCORE_COLUMNS:
        value = num.to_number(F.col(c))
        checks += [
            q.Check(f"{c}_not_numeric", value.isNull(), F.col(c)),
            q.Check(f"{c}_not_whole", value % 1 != 0, F.col(c)),
            q.Check(f"{c}_out_of_range", (value % 1 == 0) & ~value.between(1, 5), F.col(c)),
        ]
    key = F.coalesce(_column(df, "company_id"), _column(df, "ticker"))
    return q.Checked(rows, q.row_violations(df, checks, key))


def normalize_financials(df: DataFrame, allow_early: bool = False) -> q.Checked:
    """Quarterly fundamentals; margins above one are percentages, early availability is an error or a warning."""
    q.require_columns(df, ["fiscal_quarter", "fiscal_period_end", "available_at", "revenue"], "financial file")
    q.require_any_column(df, _IDS, "financial file")
    end, stamp = cal.parse_date(F.col("fiscal_period_end")), cal.parse_timestamp(F.col("available_at"))
    numbers = [c for c in ("revenue", "net_income", "employee_count") if c in df.columns]
    margins = [c for c in ("gross_margin", "operating_margin") if c in df.columns]

    def number(name: str) -> Column:
        return num.to_number(F.col(name)) if name in df.columns else F.lit(None).cast("double")

    def margin(name: str) -> Column:
        return num.normalize_margin(F.col(name)) if name in df.columns else F.lit(None).cast("double")

    rows = df.select(
        tx.strip(_column(df, "company_id")).alias("company_id"),
        F.upper(tx.strip(_column(df, "ticker"))).alias("ticker"),
        F.upper(tx.strip(F.col("fiscal_quarter"))).alias("fiscal_quarter"),
        end.alias("fiscal_period_end"),
        stamp.alias("available_at"),
        number("revenue").alias("revenue"),
        margin("gross_margin").alias("gross_margin"),
        margin("operating_margin").alias("operating_margin"),
        number("net_income").alias("net_income"),
        number("employee_count").alias("employee_count"),
        _column(df, "source_name", F.lit("financial_export")).alias("source_name"),
        _column(df, "source_document_id").alias("source_document_id"),
    )
    checks = [
        _bad_parse(df, "fiscal_period_end", end, "unparsable"),
        _bad_parse(df, "available_at", stamp, "unparsable"),
        q.Check("available_before_period_end", stamp < end.cast("timestamp"), F.col("available_at"), "warning" if allow_early else "error"),
        *[_bad_parse(df, c, num.to_number(F.col(c)), "not_numeric") for c in [*numbers, *margins]],
        *[q.Check(f"{c}_out_of_range", num.margin_is_invalid(F.col(c)), F.col(c)) for c in margins],
    ]
    if "employee_count" in df.columns:
        checks.append(q.Check("employee_count_not_positive", number("employee_count") <= 0, F.col("employee_count")))
    key = F.concat_ws("|", _column(df, "company_id"), _column(df, "ticker"), F.col("fiscal_quarter"))
    duplicates = q.duplicate_violations(rows, "duplicate_financial_record", ["company_id", "ticker", "fiscal_quarter", "source_name"])
    return q.Checked(rows, q.union_violations([q.row_violations(df, checks, key), duplicates]))


def add_daily_return(prices: DataFrame) -> DataFrame:
    """Price change per entity in date order; a missing price carries the last known one forward.

    An entity has one price per date and source, so its window is bounded by the calendar.
    """
    order = Window.partitionBy("_entity").orderBy("price_date", "source_name")
    padded = F.last("adjusted_close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = prices.withColumn("_entity", F.coalesce("company_id", "ticker")).withColumn("_padded", padded)
    change = F.try_divide(F.col("_padded"), F.lag("_padded").over(order)) - 1
    return rows.withColumn("daily_return", change).drop("_entity", "_padded")


def normalize_prices(df: DataFrame) -> q.Checked:
    """Price export to canonical prices with the daily return."""
    if "price_date" not in df.columns and "date" in df.columns:
        df = df.withColumnRenamed("date", "price_date")
    q.require_columns(df, ["price_date", "adjusted_close"], "price file")
    q.require_any_column(df, _IDS, "price file")
    day, close = cal.parse_date(F.col("price_date")), num.to_number(F.col("adjusted_close"))
    given = "available_at" in df.columns
    rows = df.select(
        tx.strip(_column(df, "company_id")).alias("company_id"),
        F.upper(tx.strip(_column(df, "ticker"))).alias("ticker"),
        day.alias("price_date"),
        cal.quarter_label(day).alias("price_quarter"),
        close.alias("adjusted_close"),
        num.to_number(_column(df, "volume")).alias("volume"),
        _column(df, "source_name", F.lit("market_data_export")).alias("source_name"),
        (cal.parse_timestamp(F.col("available_at")) if given else day.cast("timestamp")).alias("available_at"),
    )
    checks = [
        _bad_parse(df, "price_date", day, "unparsable"),
        _bad_parse(df, "adjusted_close", close, "not_numeric"),
        q.Check("adjusted_close_not_positive", close <= 0, F.col("adjusted_close")),
    ]
    key = F.concat_ws("|", _column(df, "company_id"), _column(df, "ticker"), F.col("price_date"))
    duplicates = q.duplicate_violations(rows, "duplicate_price_record", ["company_id", "ticker", "price_date", "source_name"])
    return q.Checked(add_daily_return(rows), q.union_violations([q.row_violations(df, checks, key), duplicates]))


def flag_duplicates(df: DataFrame, entity: Column, content: str, order: list[str], out: str = "is_likely_duplicate") -> DataFrame:
    """Mark all rows but the first of each (entity, content) group, the first by ``order``.

    The first row is found by a map-side minimum, so many copies of one content cost one row per task.
    """
    keyed = df.withColumn("_entity", entity)
    first = F.min(F.struct(*order)).alias("_first")
    groups = keyed.groupBy("_entity", content).agg(first, F.count(F.lit(1)).alias("_copies"))
    marked = attach_by_key(keyed, groups, ["_entity", content])
    return marked.withColumn(out, F.struct(*order) != F.col("_first")).drop("_entity", "_first", "_copies")


def normalize_postings(df: DataFrame, keywords: Iterable[str] = K.POSTING_KEYWORDS) -> q.Checked:
    """Job postings with content hash, keyword flag and duplicate flag."""
    required = ["job_posting_id", "title", "collected_at", "source_name"]
    q.require_columns(df, required, "posting file")
    q.require_any_column(df, _IDS, "posting file")
    stamp, day = cal.parse_timestamp(F.col("collected_at")), cal.parse_optional_date(_column(df, "posting_date"))
    parts = ("title", "department", "location", "description", "source_url")
    # The cleaned texts are a step of their own: hash, keywords and output read them once each.
    tidy = df.withColumns({c: tx.collapse_text(_column(df, c)) for c in parts})
    texts = {c: F.col(c) for c in parts}
    rows = tidy.select(
        tx.collapse_text(F.col("job_posting_id")).alias("job_posting_id"),
        tx.collapse_text(_column(df, "company_id")).alias("company_id"),
        tx.normalize_ticker(_column(df, "ticker")).alias("ticker"),
        *[c.alias(n) for n, c in texts.items() if n != "source_url"],
        day.alias("posting_date"),
        stamp.alias("collected_at"),
        texts["source_url"].alias("source_url"),
        tx.collapse_text(F.col("source_name")).alias("source_name"),
        tx.content_hash(*texts.values()).alias("raw_hash"),
        tx.parse_bool(_column(df, "is_active")).alias("is_active"),
        tx.matches_keyword(texts["title"], texts["description"], keywords).alias("is_ai_keyword_matched"),
    )
    rows = flag_duplicates(rows, F.coalesce("company_id", "ticker"), "raw_hash", ["collected_at", "job_posting_id"])
    checks = [_missing(c, F.col(c)) for c in required]
    checks.append(_bad_parse(df, "collected_at", stamp, "unparsable"))
    if "posting_date" in df.columns:
        checks.append(_bad_parse(df, "posting_date", day, "unparsable"))
    checks.append(
        q.Check("identifier_missing", tx.is_missing(_column(df, "company_id")) & tx.is_missing(_column(df, "ticker")), F.lit(""))
    )
    return q.Checked(rows, q.row_violations(df, checks, F.col("job_posting_id")))


def detect_likely_duplicates(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("is_likely_duplicate"))


_MASTER_COLUMNS = ["company_id", "company_name", "ticker", "cik", "exchange", "sector", "industry", "country", "active_from", "active_to", "name"]


def normalize_companies(df: DataFrame) -> q.Checked:
    """Entity master: cleaned identifiers, missing optional columns added, extra columns passed through."""
    q.require_columns(df, ["company_id", "ticker"], "company master")
    q.require_any_column(df, ["company_name", "name"], "company master")
    name = tx.clean_text(_column(df, "company_name", _column(df, "name")))
    dates = {c: cal.parse_optional_date(_column(df, c)) for c in ("active_from", "active_to")}
    rows = df.select(
        tx.clean_text(F.col("company_id")).alias("company_id"),
        name.alias("company_name"),
        tx.normalize_ticker(F.col("ticker")).alias("ticker"),
        tx.normalize_cik(_column(df, "cik")).alias("cik"),
        tx.normalize_ticker(_column(df, "exchange")).alias("exchange"),
        tx.clean_text(_column(df, "sector")).alias("sector"),
        tx.clean_text(_column(df, "industry")).alias("industry"),
        tx.normalize_ticker(_column(df, "country")).alias("country"),
        *[c.alias(n) for n, c in dates.items()],
        name.alias("name"),
        *[F.col(c) for c in df.columns if c not in _MASTER_COLUMNS],
    )
    checks = [
        _missing("company_id", F.col("company_id")),
        _missing("company_name", _column(df, "company_name", _column(df, "name"))),
        _missing("ticker", F.col("ticker")),
        q.Check("cik_not_digits", tx.cik_is_invalid(_column(df, "cik")), _column(df, "cik")),
        *[_bad_parse(df, c, p, "unparsable") for c, p in dates.items() if c in df.columns],
    ]
    frames = [q.row_violations(df, checks, F.col("company_id"))]
    frames += [q.duplicate_violations(rows, f"duplicate_{c}", [c], ignore_nulls=True) for c in ("company_id", "ticker", "cik")]
    return q.Checked(rows, q.union_violations(frames))
