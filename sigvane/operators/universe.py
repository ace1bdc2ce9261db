"""Score pages: best page per entity, nested scores to columns, name dedup with a drop log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions.text import strip
from sigvane.operators.cross_section import best_row_per_key
from sigvane.operators.ordering import attach_by_key

_DIMENSION = (
    "struct<score:string,label:string,confidence:string,evidence:array<struct<sourceType:string>>,missingEvidence:array<string>,"
    "subDimensions:array<struct<name:string,score:string>>>"
)
CONTENT_SCHEMA = (
    f"struct<aiScores:struct<maturityIndex:string,maturityStage:string,assessedAt:string,adoption:{_DIMENSION},proficiency:{_DIMENSION},"
    f"impact:{_DIMENSION}>,aiAppsUsed:array<string>,impactMetrics:array<string>,initiatives:array<string>>"
)
FILING_SCHEMA = (
    "struct<ticker:string,no_excerpts:boolean,dimensions:struct<ai_investment_intensity:struct<score:double>,ai_narrative_concreteness:struct<score:double>,"
    "ai_risk_disclosure_depth:struct<score:double>>,capex_mentions:array<struct<quote:string,context:string>>>"
)


def _count(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def flatten_scores(pages: DataFrame, content: str = "content") -> DataFrame:
    """One column per score, label, confidence, evidence count and named sub-dimension."""
    root = f"{content}.aiScores"
    columns = [
        F.col(f"{root}.maturityIndex").try_cast("double").alias("maturity_index"),
        F.col(f"{root}.maturityStage").alias("maturity_stage"),
        F.col(f"{root}.assessedAt").alias("assessed_at"),
    ]
    sources, subs = [], []
    for dim in ("adoption", "proficiency", "impact"):
        at = f"{root}.{dim}"
        columns += [
            F.col(f"{at}.score").try_cast("double").alias(f"{dim}_score"),
            F.col(f"{at}.label").alias(f"{dim}_label"),
            F.col(f"{at}.confidence").alias(f"{dim}_confidence"),
            _count(F.col(f"{at}.evidence")).alias(f"{dim}_n_evidence"),
            _count(F.col(f"{at}.missingEvidence")).alias(f"{dim}_n_missing_evidence"),
        ]
        sources.append(F.coalesce(F.col(f"{at}.evidence.sourceType"), F.array().cast("array<string>")))
        subs.append(F.coalesce(F.col(f"{at}.subDimensions"), F.array().cast("array<struct<name:string,score:string>>")))
    all_sources, all_subs = F.concat(*sources), F.concat(*subs)

    def last_score(name: str) -> Column:
        hits = F.filter(all_subs, lambda s: s["name"] == name)
        return F.try_element_at(hits, F.lit(-1))["score"].try_cast("double").alias(f"sub_{name}")

    def mentions(name: str) -> Column:
        return F.size(F.filter(all_sources, lambda s: F.coalesce(s == name, F.lit(False)))).alias(f"evidence_{name}")

    named = [s for s in K.EVIDENCE_SOURCES if s != "other"]
    columns += [last_score(n) for n in K.SUB_DIMENSIONS] + [mentions(n) for n in named]
    columns.append(F.size(F.filter(all_sources, lambda s: ~F.coalesce(s.isin(named), F.lit(False)))).alias("evidence_other"))
    for name, field in (("n_ai_apps_used", "aiAppsUsed"), ("n_impact_metrics", "impactMetrics"), ("n_initiatives", "initiatives")):
        columns.append(_count(F.col(f"{content}.{field}")).alias(name))
    return pages.select(*[c for c in pages.columns if c != content], *columns)


def score_dimensions(pages: DataFrame, content: str = "content") -> DataFrame:
    """One row per page and score dimension, whatever dimensions the page has; ``content`` is a variant.

    A dimension is an object below ``aiScores``; pages without scores have no rows.  Scores that are no numbers are null.
    """
    kept = [c for c in pages.columns if c != content]
    scores = pages.withColumn("_scores", F.try_variant_get(content, "$.aiScores", "variant")).drop(content)
    parts = scores.lateralJoin(pages.sparkSession.tvf.variant_explode(F.col("_scores").outer()))
    dimensions = parts.where(F.schema_of_variant("value").startswith("OBJECT"))

    def entries(name: str) -> Column:
        return F.coalesce(F.size(F.try_variant_get("value", f"$.{name}", "array<variant>")), F.lit(0))

    return dimensions.select(
        *kept, F.col("key").alias("dimension"), F.try_variant_get("value", "$.score", "string").try_cast("double").alias("score"),
        F.try_variant_get("value", "$.label", "string").alias("label"), F.try_variant_get("value", "$.confidence", "string").alias("confidence"),
        entries("evidence").alias("n_evidence"), entries("missingEvidence").alias("n_missing_evidence"), entries("subDimensions").alias("n_sub_dimensions"),
    )


def best_pages(pages: DataFrame) -> DataFrame:
    """Per entity the highest-version page that has scores."""
    scored = pages.where(F.col("content.aiScores").isNotNull()).withColumn("_v", F.coalesce("version", F.lit(0)))
    return best_row_per_key(scored, ["company_id"], ["_v"], ["created_at"]).drop("_v")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_pages"), F.greatest(F.lit(0), F.max("version")).alias("max_version"))


def dedupe_entities(entities: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities kept, one per trimmed name, and the log of dropped rows.

    Kept is the entity whose best page (else its own row) is most recent, the earlier by ``ord`` on ties.
    """
    best = best_pages(pages).select("company_id", F.col("created_at").alias("_page_at"))
    rows = entities.withColumn("name", strip(F.col("name"))).join(best, "company_id", "left")
    rows = rows.withColumn("_recent", F.coalesce("_page_at", "created_at", F.lit("")))
    test = F.coalesce(F.col("name") == K.TEST_ENTITY_NAME, F.lit(False))
    real = rows.where(~test)
    winner = F.max_by("company_id", F.struct("_recent", (-F.col("ord")).alias("o"))).alias("kept_id")
    groups = real.groupBy("name").agg(winner, F.count(F.lit(1)).alias("_copies"))
    judged = attach_by_key(real, groups, ["name"])
    kept = judged.where(F.col("company_id") == F.col("kept_id")).drop("_page_at", "_recent", "kept_id", "_copies")
    dropped = judged.where(F.col("company_id") != F.col("kept_id")).select(
        F.lit("drop_duplicate_name").alias("action"), "name", F.col("company_id").alias("id"), "kept_id"
    )
    tests = rows.where(test).select(
        F.lit("drop_test_row").alias("action"), "name", F.col("company_id").alias("id"), F.lit(None).cast("string").alias("kept_id")
    )
    return kept, tests.unionByName(dropped)


def scored_entities(kept: DataFrame, pages: DataFrame) -> DataFrame:
    """Kept entities with page counts and the flattened scores of their best page."""
    best = best_pages(pages).select(
        "company_id", F.col("version").alias("page_version"), F.col("created_at").alias("page_created_at"), "content"
    )
    counted = kept.join(page_counts(pages), "company_id", "left").na.fill(0, ["n_pages"])
    return counted.join(flatten_scores(best), "company_id", "left")


def flatten_filings(filings: DataFrame, payload: str = "payload") -> DataFrame:
    """Scored-filing JSON to (ticker, inv, conc, risk) and the capital-spending mentions; no excerpts means null scores."""
    parsed = filings.withColumn("_f", F.from_json(F.col(payload), FILING_SCHEMA))
    usable = ~F.coalesce(F.col("_f.no_excerpts"), F.lit(False))

    def score(name: str) -> Column:
        return F.when(usable, F.col(f"_f.dimensions.{name}.score"))

    return parsed.select(
        F.col("_f.ticker").alias("ticker"), score("ai_investment_intensity").alias("inv"), score("ai_narrative_concreteness").alias("conc"),
        score("ai_risk_disclosure_depth").alias("risk"), F.coalesce(F.col("_f.capex_mentions"), F.array().cast("array<struct<quote:string,context:string>>")).alias("capex_mentions"),
    )
