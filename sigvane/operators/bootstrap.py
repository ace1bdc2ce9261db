"""From four raw exports to normalized tables and the panel, published as one version."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.operators import identity, normalize, pit
from sigvane.operators import quality as q
from sigvane.sources import versions

PANEL = "analytic_panel"
RAW_COLUMNS = {
    "companies": ["company_id", "ticker", "company_name", "sector"],
    "scores": ["snapshot_date", "source_name", *K.SCORE_COLUMNS],
    "prices": ["adjusted_close"],
    "financials": ["fiscal_quarter", "fiscal_period_end", "available_at", "revenue"],
}


def normalized(raw: Mapping[str, DataFrame], available_at: str | None = None, allow_early: bool = False) -> dict[str, DataFrame]:
    """The four tables, checked; the first violations are raised."""
    for name, columns in RAW_COLUMNS.items():
        q.require_columns(raw[name], columns, f"{name} export")
    return {
        "companies": normalize.normalize_companies(raw["companies"]).strict("company master"),
        "scores": normalize.normalize_scores(raw["scores"], available_at).strict("score export"),
        "prices": normalize.normalize_prices(raw["prices"]).strict("price export"),
        "financials": normalize.normalize_financials(raw["financials"], allow_early).strict("financial export"),
    }


def panel_of(tables: Mapping[str, DataFrame], strict: bool = True) -> DataFrame:
    """The panel of normalized tables whose rows name their company by id or by ticker.

    A prediction date that the score export carried has been folded into the metadata and is taken from there.
    """
    companies = tables["companies"]
    scores = tables["scores"]
    given = F.get_json_object("metadata_json", "$.prediction_date")
    scores = scores.withColumn("prediction_date", F.coalesce(given.cast("date"), F.col("available_at").cast("date")))
    attached = [identity.attach_company_id(df, companies) for df in (scores, tables["prices"], tables["financials"])]
    return pit.build_panel(companies, *attached, strict=strict)


def publish_panel(spark: SparkSession, raw: Mapping[str, DataFrame], root: str, strict: bool = True, available_at: str | None = None, allow_early: bool = False) -> DataFrame:
    """Normalize, stage, build the panel from what was staged, and publish all five tables; returns the manifest rows.

    Every raw export is normalized once: the panel reads the staged tables, not the exports again.
    """
    version = versions.Publication(spark, root)
    staged = {name: version.stage(name, df) for name, df in normalized(raw, available_at, allow_early).items()}
    version.stage(PANEL, panel_of(staged, strict))
    return version.commit()
