"""Quarterly facts: nested filings data to outcomes, momentum, size and headcount per ticker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions.numeric import safe_ratio, safe_return
from sigvane.operators.pit import nearest_looks


def _items(taxonomy: str, concept: str, unit: str | None = None) -> Column:
    units = f"try_element_at(try_element_at(facts, '{taxonomy}'), '{concept}').units"
    if unit is None:
        return F.expr(f"flatten(map_values({units}))")
    return F.expr(f"try_element_at({units}, '{unit}')")


def quarterly_series(facts: DataFrame, concepts: Sequence[str], taxonomy: str = "us-gaap") -> DataFrame:
    """Rows (ticker, concept, end, val, filed): periods of 70 to 100 days, as first filed."""
    per_concept = F.array(*[F.struct(F.lit(c).alias("concept"), _items(taxonomy, c, "USD").alias("items")) for c in concepts])
    flat = facts.select("ticker", F.explode(per_concept).alias("_c")).select("ticker", "_c.concept", F.posexplode("_c.items").alias("pos", "item"))
    dated = flat.select(
        "ticker", "concept", "pos", F.col("item.val").alias("val"),
        *[F.col(f"item.{d}").try_cast("date").alias(d) for d in ("start", "end", "filed")],
    )
    # All that follows goes by ticker, so the rows are dealt once; a ticker has a few hundred.
    quarterly = dated.where(F.datediff("end", "start").between(70, 100)).repartition("ticker")
    first = F.min_by(F.struct("val", "filed"), F.struct("filed", "pos")).alias("_f")
    return quarterly.groupBy("ticker", "concept", "end").agg(first).select("ticker", "concept", "end", "_f.val", "_f.filed")


def _with_preferred(series: DataFrame, concepts: Sequence[str], min_periods: int = 4) -> DataFrame:
    """Add ``_preferred``: per ticker the first of the concepts with enough periods, else the last one of the list."""
    listed = F.array(*[F.lit(c) for c in concepts])
    place = F.nullif(F.array_position(listed, F.col("concept")), F.lit(0))
    counted = series.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ticker", "concept")))
    enough = F.min(F.when(F.col("_n") >= min_periods, place)).over(Window.partitionBy("ticker"))
    return counted.withColumn("_place", F.coalesce(enough, F.lit(len(concepts))).cast("int")).withColumn("_preferred", F.element_at(listed, F.col("_place"))).drop("_n", "_place")


def preferred_series(series: DataFrame, concepts: Sequence[str], min_periods: int = 4) -> DataFrame:
    """Per ticker the first concept with enough periods, else the last one of the list."""
    return _with_preferred(series, concepts, min_periods).where("concept = _preferred").drop("concept", "_preferred")


def latest_value(facts: DataFrame, concept: str, taxonomy: str = "dei") -> DataFrame:
    """The value with the latest end date over all units, the first listed on ties."""
    flat = facts.select("ticker", F.posexplode(_items(taxonomy, concept)).alias("pos", "item"))
    order = F.struct(F.coalesce("item.end", F.lit("")).alias("e"), (-F.col("pos")).alias("p"))
    return flat.groupBy("ticker").agg(F.max_by("item.val", order).alias("value"), F.max_by("item.end", order).alias("asof"))


def shares_near(facts: DataFrame, t0: str, days: int = 45) -> DataFrame:
    """The latest share count dated on or before ``t0`` plus ``days``."""
    flat = facts.select("ticker", F.explode(_items("dei", K.SHARES_CONCEPT)).alias("item"))
    end = F.col("item.end").try_cast("date")
    return flat.where(end <= F.date_add(F.lit(t0).cast("date"), days)).groupBy("ticker").agg(
        F.max(F.struct(end.alias("e"), F.col("item.val").alias("v"))).alias("_s")
    ).select("ticker", F.col("_s.v").alias("shares"))


def quarter_outcomes(facts: DataFrame, t0: str, concepts: Sequence[str] = K.REVENUE_CONCEPTS) -> DataFrame:
    """The first quarter ending after ``t0`` with its growth, margin and margin changes, and headcount."""
    series = _with_preferred(quarterly_series(facts, [*concepts, K.OPERATING_INCOME]), concepts)
    income = F.col("concept") == K.OPERATING_INCOME
    series = series.where(income | (F.col("concept") == F.col("_preferred"))).withColumn("_what", F.when(income, "income").otherwise("revenue"))
    later = (F.col("_what") == "revenue") & (F.col("end") > F.lit(t0).cast("date"))
    series = series.withColumn("_first", F.min(F.when(later, F.col("end"))).over(Window.partitionBy("ticker")))
    looks = {
        "prev": ("revenue", 91, 21), "yoy": ("revenue", 365, 21),
        "oq": ("income", 0, 5), "oprev": ("income", 91, 21), "oyoy": ("income", 365, 21),
    }
    start = F.coalesce((F.col("_what") == "revenue") & (F.col("end") == F.col("_first")), F.lit(False))
    rows = nearest_looks(series, ["ticker"], "_what", "end", ["val", "filed"], start, looks)
    rows = rows.withColumnsRenamed({"start_end": "q_end", "start_val": "rev_q", "start_filed": "rev_filed"})
    margin = safe_ratio(F.col("oq_val"), F.col("rev_q"))
    rows = rows.select(
        "ticker", "q_end", "rev_q", "rev_filed", F.col("prev_val").alias("rev_prev"), F.col("yoy_val").alias("rev_yoy"),
        margin.alias("op_margin_q"),
        (margin - safe_ratio(F.col("oprev_val"), F.col("prev_val"))).alias("op_margin_delta_qoq"),
        (margin - safe_ratio(F.col("oyoy_val"), F.col("yoy_val"))).alias("op_margin_delta_yoy"),
        safe_return(F.col("prev_val"), F.col("rev_q")).alias("rev_growth_qoq"),
        safe_return(F.col("yoy_val"), F.col("rev_q")).alias("rev_growth_yoy"),
    )
    staff = latest_value(facts, K.EMPLOYEE_CONCEPT).withColumnsRenamed({"value": "employees", "asof": "employees_asof"})
    return facts.select("ticker", "cik").join(rows, "ticker", "left").join(staff, "ticker", "left")


def prior_growth(facts: DataFrame, t0: str, concepts: Sequence[str] = K.REVENUE_CONCEPTS) -> DataFrame:
    """Year-over-year growth of the last quarter ending before ``t0``."""
    revenue = preferred_series(quarterly_series(facts, concepts), concepts)
    earlier = F.when(F.col("end") < F.lit(t0).cast("date"), F.col("end"))
    revenue = revenue.withColumns({"_last": F.max(earlier).over(Window.partitionBy("ticker")), "_what": F.lit("revenue")})
    start = F.coalesce(F.col("end") == F.col("_last"), F.lit(False))
    rows = nearest_looks(revenue, ["ticker"], "_what", "end", ["val"], start, {"yoy": ("revenue", 365, 21)})
    growth = safe_return(F.col("yoy_val"), F.col("start_val"))
    return rows.select("ticker", growth.alias("prior_rev_growth_yoy"), F.when(growth.isNotNull(), F.col("start_end")).alias("prior_q_end"))


def market_caps(facts: DataFrame, prices: DataFrame, fallback: DataFrame, t0: str, fallback_source: str = "fallback_current") -> DataFrame:
    """Shares near ``t0`` times the price on the first date after it, else the fallback, with its source."""
    first_day = prices.where(F.col("price_date") > F.lit(t0).cast("date")).agg(F.min("price_date")).scalar()
    entry = prices.where(F.col("price_date") == first_day).select("ticker", F.col("adjusted_close").alias("_price"))
    rows = facts.select("ticker").join(shares_near(facts, t0), "ticker", "left").join(entry, "ticker", "left").join(fallback, "ticker", "left")
    own = F.when((F.col("shares") != 0) & (F.col("_price") != 0), F.col("shares") * F.col("_price"))
    spare = F.when(F.col("market_cap") != 0, F.col("market_cap"))
    return rows.select(
        "ticker",
        F.coalesce(own, spare).alias("mktcap_t0"),
        F.when(own.isNotNull(), "sec_shares_x_jan_price").when(spare.isNotNull(), fallback_source).alias("mktcap_source"),
    )
