"""Point-in-time joins: what was known on a prediction date, and what happened after it.

Prices, fundamentals and scores of an entity are laid on one time axis and read with running windows,
so one shuffle and one sort serve every backward and forward lookup; no score x price pairs are made.
The contract is one price per (entity, date, source) and one report per (entity, quarter, source), so
an entity's axis is bounded by the calendar however many raw rows it had before aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions.calendar import quarter_label
from sigvane.functions.numeric import mean_of, safe_difference, safe_log, safe_ratio, safe_return
from sigvane.operators.ordering import attach_by_key
from sigvane.operators.quality import duplicate_violations
from sigvane.runtime import written

# Order on equal dates: facts dated on the prediction date are known to the score.
_PRICE, _REPORT_SEEN, _REPORT_END, _SCORE = 0, 1, 2, 3

_PRICE_TYPE = "struct<price_date:date,source_name:string,adjusted_close:double>"
_REPORT_TYPE = (
    "struct<fiscal_period_end:date,fiscal_quarter:string,source_name:string,"
    "revenue:double,operating_margin:double,employee_count:double>"
)

PANEL_COLUMNS = [
    "company_id",
    "ticker",
    "company_name",
    "sector",
    "industry",
    "snapshot_date",
    "score_quarter",
    "score_available_at",
    "prediction_date",
    "outcome_start_date",
    "outcome_end_date",
    "quarter",
    *K.SCORE_COLUMNS,
    K.COMPOSITE,
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
    "timing_warning",
    "timing_violation",
]


def _source(df: DataFrame) -> Column:
    return F.col("source_name") if "source_name" in df.columns else F.lit("")


def _price_struct(df: DataFrame) -> Column:
    return F.struct("price_date", _source(df).alias("source_name"), F.col("adjusted_close").cast("double")).cast(
        _PRICE_TYPE
    )


def _report_struct(df: DataFrame) -> Column:
    def number(name: str) -> Column:
        return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")

    return F.struct(
        "fiscal_period_end",
        "fiscal_quarter",
        _source(df).alias("source_name"),
        number("revenue"),
        number("operating_margin"),
        number("employee_count"),
    ).cast(_REPORT_TYPE)


def _timeline(scores: DataFrame, prices: DataFrame | None, reports: DataFrame | None) -> DataFrame:
    """Scores, prices and reports on one (company_id, date) axis."""
    score = F.struct(*[F.col(c) for c in scores.columns if c != "company_id"])
    axis = scores.select("company_id", F.col("prediction_date").alias("_date"), F.lit(_SCORE).alias("_kind"), score.alias("_score"))
    if prices is not None:
        axis = axis.unionByName(
            prices.select(
                "company_id", F.col("price_date").alias("_date"), F.lit(_PRICE).alias("_kind"),
                _price_struct(prices).alias("_price"),
            ),
            allowMissingColumns=True,
        )
    if reports is not None:
        report = _report_struct(reports)
        axis = axis.unionByName(
            reports.select(
                "company_id", F.col("available_at").cast("date").alias("_date"), F.lit(_REPORT_SEEN).alias("_kind"),
                report.alias("_seen"),
            ),
            allowMissingColumns=True,
        ).unionByName(
            reports.select(
                "company_id", F.col("fiscal_period_end").alias("_date"), F.lit(_REPORT_END).alias("_kind"),
                report.alias("_ended"),
            ),
            allowMissingColumns=True,
        )
    return axis


# Reads of the axis: the n-th non-null value behind or ahead of the score row.
def _behind(column: str, n: int) -> Column:
    return F.expr(f"lag({column}, {n}) IGNORE NULLS OVER (PARTITION BY company_id ORDER BY _date, _kind, _tie)")


def _ahead(column: str, n: int) -> Column:
    return F.expr(f"lead({column}, {n}) IGNORE NULLS OVER (PARTITION BY company_id ORDER BY _date, _kind, _tie)")


def point_in_time(scores: DataFrame, prices: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """Score rows with features known on ``prediction_date`` and outcomes strictly after it.

    Prices give ``prior_return_1q``, ``outcome_start_date``, ``outcome_end_date``, ``fwd_return_1q``
    and ``fwd_return_2q``.  Reports are ordered by period end but gated by the date they became
    available; they give growth, margin and revenue per employee, and the same as later outcomes.
    """
    axis = _timeline(scores, prices, reports)
    tie = [F.coalesce(F.col("_price.source_name"), F.lit(""))] if prices is not None else []
    if reports is not None:
        tie.append(F.coalesce(F.col("_ended.source_name"), F.col("_seen.source_name"), F.lit("")))
    axis = axis.withColumn("_tie", F.concat_ws("|", *tie) if tie else F.lit(""))
    columns: dict[str, Column] = {}
    if prices is not None:
        columns |= {"_p1": _behind("_price", 1), "_p2": _behind("_price", 2)}
        columns |= {f"_n{i}": _ahead("_price", i) for i in (1, 2, 3)}
    if reports is not None:
        columns |= {f"_r{i}": _ahead("_ended", i) for i in (1, 2)}
        order = Window.partitionBy("company_id").orderBy("_date", "_kind", "_tie")
        # The latest period seen so far, and the latest of all periods it has displaced or outranked.
        best_before = F.max("_seen").over(order.rowsBetween(Window.unboundedPreceding, -1))
        columns |= {"_best": F.max("_seen").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_was_best": best_before}
    axis = axis.withColumns(columns)
    if reports is not None:
        loser = F.when(F.col("_seen").isNotNull() & F.col("_was_best").isNotNull(), F.least("_seen", "_was_best"))
        running = Window.partitionBy("company_id").orderBy("_date", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
        axis = axis.withColumn("_loser", loser).withColumn("_second", F.max("_loser").over(running))
    rows = axis.where(F.col("_kind") == _SCORE)
    out: list[Column] = [F.col("company_id"), F.col("_score.*")]
    if prices is not None:
        complete = F.col("_n2").isNotNull()
        first = F.when(complete, F.col("_n1.adjusted_close"))
        out += [
            F.when(complete, F.col("_n1.price_date")).alias("outcome_start_date"),
            F.col("_n2.price_date").alias("outcome_end_date"),
            safe_return(F.col("_p2.adjusted_close"), F.col("_p1.adjusted_close")).alias("prior_return_1q"),
            safe_return(first, F.col("_n2.adjusted_close")).alias("fwd_return_1q"),
            safe_return(first, F.col("_n3.adjusted_close")).alias("fwd_return_2q"),
        ]
    if reports is not None:
        complete = F.col("_r2").isNotNull()
        revenue_per_head = {
            side: safe_ratio(F.col(f"{side}.revenue"), F.col(f"{side}.employee_count")) for side in ("_best", "_r1", "_r2")
        }
        out += [
            safe_return(F.col("_second.revenue"), F.col("_best.revenue")).alias("revenue_growth_qoq"),
            F.col("_best.operating_margin").alias("operating_margin_t"),
            revenue_per_head["_best"].alias("revenue_per_employee_t"),
            safe_return(F.col("_r1.revenue"), F.col("_r2.revenue")).alias("future_revenue_growth_qoq"),
            F.when(
                complete, safe_difference(F.col("_r2.operating_margin"), F.col("_r1.operating_margin"))
            ).alias("future_operating_margin_delta_qoq"),
            F.when(complete, safe_return(revenue_per_head["_r1"], revenue_per_head["_r2"])).alias(
                "future_revenue_per_employee_growth_qoq"
            ),
        ]
    return rows.select(*out)


def add_group_excess(df: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    """``value`` minus its group mean; rows with a null group or value get null.  ``df`` is read twice."""
    known = F.col(value).isNotNull()
    for g in groups:
        known = known & F.col(g).isNotNull()
    # Written, so that Spark knows how small it is and does not shuffle the rows to meet it.
    means = written(df.where(known).groupBy(*groups).agg(F.avg(value).alias("_mean")), "means")
    joined = attach_by_key(df, means, groups, unmatched=groups)
    return joined.withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def build_panel(
    companies: DataFrame,
    scores: DataFrame,
    prices: DataFrame,
    reports: DataFrame,
    strict: bool = True,
    unique: bool = True,
) -> DataFrame:
    """One row per (company, score quarter) with features, outcomes and the timing audit.

    Inputs are normalized tables with ``company_id``.  Group excess is taken before the strict filter.
    Companies with several rows in a quarter after it are refused; without ``unique`` they stay, for
    ``panel_key_violations`` to list.
    """
    prepared = scores.withColumn("score_available_at", F.col("available_at").cast("timestamp"))
    if "prediction_date" in scores.columns:
        prepared = prepared.withColumn("prediction_date", F.col("prediction_date").cast("date"))
    else:
        prepared = prepared.withColumn("prediction_date", F.col("score_available_at").cast("date"))
    if "score_quarter" not in prepared.columns:
        prepared = prepared.withColumn("score_quarter", quarter_label(F.col("snapshot_date")))
    kept = ["company_id", "snapshot_date", "score_quarter", "score_available_at", "prediction_date", *K.SCORE_COLUMNS]
    kept += [c for c in ("ticker", "company_name") if c in prepared.columns]
    timed = point_in_time(prepared.select(*kept), prices, reports)

    def master(name: str, kind: str) -> Column:
        return (F.col(name) if name in companies.columns else F.lit(None)).cast(kind).alias(f"_m_{name}")

    dimension = companies.select(
        "company_id",
        *[master(c, "string") for c in ("ticker", "company_name", "sector", "industry")],
        master("market_cap", "double"),
    )
    rows = timed.join(dimension, "company_id", "left")
    for name in ("ticker", "company_name"):
        own = F.col(name) if name in timed.columns else F.lit(None).cast("string")
        rows = rows.withColumn(name, F.coalesce(own, F.col(f"_m_{name}")))
    late = F.to_date("score_available_at") > F.col("prediction_date")
    rows = rows.withColumns(
        {
            "sector": F.col("_m_sector"),
            "industry": F.col("_m_industry"),
            "quarter": F.col("score_quarter"),
            K.COMPOSITE: mean_of(K.SCORE_COLUMNS),
            "log_market_cap": safe_log(F.col("_m_market_cap")),
            "timing_violation": F.coalesce(late, F.lit(False)),
            "timing_warning": F.when(late, "score_available_at after prediction_date").otherwise(""),
        }
    )
    # Written once, so neither the key test nor the group means walk the timelines again.
    rows = written(rows, "panel_rows")
    if unique:
        judged = rows.where(~F.col("timing_violation")) if strict else rows
        repeated = [r["key"] for r in panel_key_violations(judged).limit(5).collect()]
        if repeated:
            raise ValueError(f"the panel has more than one row for some companies and quarters, such as {sorted(repeated)}")
    rows = add_group_excess(rows, "fwd_return_1q", ["sector", "score_quarter"], "fwd_excess_return_1q")
    if strict:
        rows = rows.where(~F.col("timing_violation"))
    return rows.select(*PANEL_COLUMNS)


def panel_key_violations(panel: DataFrame) -> DataFrame:
    """Companies with more than one row in a score quarter, as rows of a check."""
    return duplicate_violations(panel, "duplicate_panel_key", ["company_id", "score_quarter"])


def nearest_within(
    targets: DataFrame,
    series: DataFrame,
    keys: list[str],
    target: str,
    date: str,
    tolerance: int,
    values: list[str],
    prefix: str,
) -> DataFrame:
    """For every target row the series row nearest in time within ``tolerance`` days, the earlier on ties.

    Dates are cut into cells of ``2 * tolerance + 1`` days; a target meets only its own and the two
    neighbouring cells, so the join is an equi-join and pairs stay bounded by the tolerance.
    """
    width = 2 * tolerance + 1
    epoch = F.lit("1970-01-01").cast("date")
    cell = F.floor(F.datediff(F.col(date), epoch) / width)
    home = F.floor(F.datediff(F.col(target), epoch) / width)
    right = series.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        cell.alias("_cell"),
        F.col(date).alias("_date"),
        F.struct(F.col(date), *[F.col(v) for v in values]).alias("_row"),
    )
    left = targets.withColumn("_home", F.explode(F.array(home - 1, home, home + 1)))
    distance = F.abs(F.datediff(F.col("_date"), F.col(target)))
    condition = (F.col("_home") == F.col("_cell")) & (distance <= tolerance)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_k_{k}"))
    pairs = left.join(right, condition)
    best = pairs.groupBy(*keys, target).agg(F.min(F.struct(distance.alias("d"), F.col("_row").alias("r"))).alias("_best"))
    best = best.select(
        *keys,
        target,
        F.col(f"_best.r.{date}").alias(f"{prefix}_date"),
        *[F.col(f"_best.r.{v}").alias(f"{prefix}_{v}") for v in values],
    )
    return targets.join(best, [*keys, target], "left")


def horizon_returns(prices: DataFrame, t0: str, horizons: list[int], per_ticker: bool = False) -> DataFrame:
    """Forward returns from ``t0``: entry on the first date after it, one exit per horizon in months.

    Entry and exits are dates of the whole table (a ticker without a price on exactly that date gets
    null); with ``per_ticker`` an exit is the ticker's own last close on or before the horizon.
    Tickers without any price are left out.
    """
    known = prices.where(F.col("adjusted_close").isNotNull())
    start = F.lit(t0).cast("date")
    ends = {f"fwd_ret_{h}m": F.add_months(start, h) for h in horizons}
    after, date = F.col("price_date") > start, F.col("price_date")
    calendar = prices.agg(
        F.struct(
            F.min(F.when(after, date)).alias("entry"),
            F.max(date).alias("latest"),
            *[F.max(F.when(date <= end, date)).alias(name) for name, end in ends.items()],
        )
    )
    rows = known.withColumn("_calendar", calendar.scalar())

    def close_on(column: str) -> Column:
        return F.max(F.when(date == F.col(column), F.col("adjusted_close")))

    def own_last(end: Column) -> Column:
        return F.max_by("adjusted_close", F.when(date <= end, date))

    exits = {n: own_last(e) if per_ticker else close_on(f"_calendar.{n}") for n, e in ends.items()}
    latest = own_last(F.col("_calendar.latest")) if per_ticker else close_on("_calendar.latest")
    grouped = rows.groupBy("ticker").agg(
        F.max("_calendar.entry").alias("entry_date"),
        close_on("_calendar.entry").alias("entry_price"),
        F.max(date).alias("last_price_date"),
        latest.alias("_x_latest"),
        *[x.alias(f"_x_{n}") for n, x in exits.items()],
    )
    return grouped.select(
        "ticker",
        "entry_date",
        "entry_price",
        *[safe_return(F.col("entry_price"), F.col(f"_x_{n}")).alias(n) for n in ends],
        safe_return(F.col("entry_price"), F.col("_x_latest")).alias("fwd_ret_latest"),
        "last_price_date",
    )


def stalled_series(prices: DataFrame, requested: DataFrame, days: int = 10) -> DataFrame:
    """Requested tickers without data, and tickers whose last price is older than the table's by ``days``."""
    known = prices.where(F.col("adjusted_close").isNotNull())
    last = known.groupBy("ticker").agg(F.max("price_date").alias("last_price_date"))
    latest = prices.agg(F.max("price_date")).scalar()
    missing = requested.select("ticker").distinct().join(last, "ticker", "left_anti")
    stalled = last.where(F.col("last_price_date") < F.date_sub(latest, days))
    return missing.select(F.lit("no_data").alias("issue"), "ticker").unionByName(
        stalled.select(F.concat(F.lit("stops_"), F.col("last_price_date").cast("string")).alias("issue"), "ticker")
    )


def nearest_looks(
    series: DataFrame, keys: list[str], kind: str, date: str, values: list[str], start: Column, looks: dict[str, tuple[str, int, int]]
) -> DataFrame:
    """What lay nearest to several days before a start row: one row per key, from one partitioning by the keys.

    ``start`` marks at most one row per key.  A look (kind, days back, tolerance) asks for the row of that kind nearest to
    the start date less the days, within the tolerance, the earlier on ties; its values come back as
    ``{name}_{value}``, those of the start row as ``start_{date}`` and ``start_{value}``.  Keys without a start row have no row.

    The looks are put on the time axis beside the rows and read the last row before and the first after them, so rows
    and looks are never paired.  ``series`` holds one row per key, kind and date.
    """
    known = F.struct(F.col(date), *values)

    def event(look: str | None, of_kind: Column, at: Column, row: Column) -> Column:
        return F.struct(F.lit(look).cast("string").alias("_look"), of_kind.alias("_kind"), at.alias("_at"), row.alias("_row"), (start & F.lit(look is None)).alias("_start"))

    nothing = F.when(F.lit(False), known)
    asked = F.array(*[event(name, F.lit(k), F.date_sub(date, days), nothing) for name, (k, days, _) in looks.items()])
    itself = F.array(event(None, F.col(kind), F.col(date), known))
    events = series.select(*keys, F.explode(F.when(start, F.concat(itself, asked)).otherwise(itself)).alias("_e")).select(*keys, "_e.*")

    axis = Window.partitionBy(*keys, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows_first = F.col("_look").asc_nulls_first()
    events = events.withColumn("_before", F.last("_row", ignorenulls=True).over(axis.orderBy("_at", rows_first)))
    events = events.withColumn("_after", F.last("_row", ignorenulls=True).over(axis.orderBy(F.col("_at").desc(), rows_first)))
    back, ahead = F.datediff("_at", f"_before.{date}"), F.datediff(f"_after.{date}", "_at")
    limit = F.create_map(*[F.lit(x) for name, (_, _, days) in looks.items() for x in (name, days)])[F.col("_look")]
    nearest = F.when((back <= limit) & F.coalesce(back <= ahead, F.lit(True)), F.col("_before")).when(ahead <= limit, F.col("_after"))
    events = events.where("_look IS NOT NULL OR _start").select(*keys, "_look", F.when(F.col("_start"), F.col("_row")).otherwise(nearest).alias("_row"))
    picks = [F.max(F.when(F.col("_look").isNull(), F.col("_row"))).alias("_start")]
    picks += [F.max(F.when(F.col("_look") == name, F.col("_row"))).alias(f"_{name}") for name in looks]
    found = events.groupBy(*keys).agg(*picks)
    return found.select(
        *keys, *[F.col(f"_start.{c}").alias(f"start_{c}") for c in (date, *values)], *[F.col(f"_{name}.{v}").alias(f"{name}_{v}") for name in looks for v in values]
    )
