"""Rule-based evidence extraction, its record checks and its quality measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions import text as tx
from sigvane.operators.ordering import prefix_sums
from sigvane.runtime import materialize

EVIDENCE_TYPE = "array<struct<evidence_id:string,text:string,start_char:int,end_char:int,source_section:string>>"
SCORES_TYPE = "map<string,struct<score:int,confidence:double,evidence_ids:array<string>,rationale:string>>"
EXTRACTION_SCHEMA = (
    "source_document_id string, source_type string, source_date string, extraction_created_at timestamp, model_name string, "
    f"prompt_version string, schema_version string, evidence {EVIDENCE_TYPE}, signal_scores {SCORES_TYPE}, "
    "limitations array<string>, company_id string, ticker string, company_name string"
)


def _holds_any(c: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(c, F.lit(t))
    return found


def evidence_quote(text: Column, low: Column, terms: Sequence[str], limit: int | None = None) -> Column:
    """The first sentence holding a term, else the whole text; null when no term occurs.

    ``low`` is the lower-cased text.  A ``limit`` cuts the quote to so many characters.
    """
    sentences = F.filter(F.transform(F.split(tx.strip(text), r"\."), tx.strip), lambda s: s != "")
    pairs = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.concat(F.lit(" "), F.lower(s), F.lit(" ")).alias("low")))
    hits = F.filter(pairs, lambda p: _holds_any(p["low"], terms))
    quote = F.coalesce(F.get(hits, F.lit(0))["s"], tx.strip(text))
    if limit is not None:
        quote = F.substring(quote, 1, limit)
    return F.when(_holds_any(F.concat(F.lit(" "), low, F.lit(" ")), terms), quote)


def _score(low: Column, base: int, keywords: Sequence[str], has_evidence: Column) -> Column:
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords]), lambda k: k.isNotNull())
    # one-element array: the matches are found once and named
    return F.transform(F.array(found), lambda matched: _signal(matched, base, has_evidence))[0]


def _signal(matched: Column, base: int, has_evidence: Column) -> Column:
    n = F.size(matched)
    return F.when(
        ~has_evidence,
        F.struct(F.lit(None).cast("int").alias("score"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("evidence_ids"), F.lit(None).cast("string").alias("rationale")),
    ).otherwise(
        F.struct(
            F.when(n > 0, F.least(F.lit(5), n + base)).alias("score"),
            F.when(n > 0, 0.65 + F.least(F.lit(0.25), n * 0.05)).otherwise(0.15).alias("confidence"),
            F.when(n > 0, F.array(F.lit("ev1"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
            F.when(n > 0, F.concat(F.lit("the text has the words "), F.array_join(F.slice(matched, 1, 3), ", "))).alias("rationale"),
        )
    )


def extract_documents(
    documents: DataFrame,
    terms: Sequence[str] = K.EVIDENCE_TERMS,
    rules: Mapping[str, tuple[int, Sequence[str]]] = K.SIGNAL_RULES,
    quote_limit: int | None = None,
) -> DataFrame:
    """Evidence span, signal scores and limitations per document, in one projection."""
    rows = documents.withColumn("_low", F.lower("text"))
    rows = rows.withColumn("_quote", evidence_quote(F.col("text"), F.col("_low"), terms, quote_limit))
    place = F.instr(F.col("text"), F.col("_quote")) - 1
    has = F.col("_quote").isNotNull()
    span = F.struct(
        F.lit("ev1").alias("evidence_id"),
        F.col("_quote").alias("text"),
        F.when(place >= 0, place).alias("start_char"),
        F.when(place >= 0, place + F.length("_quote")).alias("end_char"),
        F.lit(None).cast("string").alias("source_section"),
    )
    scores = F.create_map(*[x for name, (base, words) in rules.items() for x in (F.lit(name), _score(F.col("_low"), base, words, has))])
    rows = rows.withColumns(
        {"evidence": F.when(has, F.array(span)).otherwise(F.array().cast(EVIDENCE_TYPE)).cast(EVIDENCE_TYPE), "signal_scores": scores.cast(SCORES_TYPE)}
    )
    some_null = F.exists(F.map_values("signal_scores"), lambda s: s["score"].isNull())
    notes = F.filter(F.array(F.when(~has, K.NO_EVIDENCE_NOTE), F.when(some_null, K.NULL_SIGNAL_NOTE)), lambda n: n.isNotNull())

    def given(name: str) -> Column:
        return (F.col(name) if name in documents.columns else F.lit(None)).cast("string").alias(name)

    ticker = tx.normalize_ticker(F.col("ticker")) if "ticker" in documents.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("source_document_id").cast("string").alias("source_document_id"),
        tx.normalize_source_type(F.col("source_type")).alias("source_type"),
        F.col("source_date").cast("string").alias("source_date"),
        F.current_timestamp().alias("extraction_created_at"),
        F.lit(K.EXTRACTOR_NAME).alias("model_name"),
        F.lit(K.EXTRACTION_PROMPT_VERSION).alias("prompt_version"),
        F.lit(K.EXTRACTION_SCHEMA_VERSION).alias("schema_version"),
        "evidence",
        "signal_scores",
        notes.alias("limitations"),
        given("company_id"),
        ticker.alias("ticker"),
        given("company_name"),
    )


def extract_with(documents: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run a pluggable extractor on Arrow batches of the documents; it returns extraction columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield extractor(batch)

    return documents.mapInPandas(run, EXTRACTION_SCHEMA)


def single_text_document(df: DataFrame, text: str, company: str, period: str) -> DataFrame:
    """Documents from bare (text, company, period): ticker from the name, year-end date from the period."""
    year = F.substring(F.col(period), 1, 4)
    dated = F.when(year.rlike(r"^\d{4}$"), F.concat(year, F.lit("-12-31"))).otherwise("2025-01-01")
    name = F.upper(F.replace(F.col(company), F.lit(" "), F.lit("")))
    return df.withColumns({"text": F.col(text), "ticker": F.substring(name, 1, 5), "company_name": F.col(company), "source_date": dated})


def parse_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payloads to extraction columns; text that is no JSON object gets a null ``source_document_id``."""
    return payloads.withColumn("_e", F.from_json(F.col(column), EXTRACTION_SCHEMA)).select(*payloads.columns, "_e.*")


def document_errors(documents: DataFrame) -> Column:
    """Broken rules of a source document: type, date, empty text and missing id."""
    rules = {
        "source_type": ~tx.normalize_source_type(F.col("source_type")).isin(*K.SOURCE_TYPES),
        "source_date": F.col("source_date").cast("string").try_cast("date").isNull(),
        "text_length": F.length(tx.strip(F.col("text"))) < 1,
        "source_document_id": F.col("source_document_id").isNull(),
    }
    return _broken(rules)


def document_warnings(long_text: int) -> Column:
    """What is unusual about a valid document: a text of more than ``long_text`` characters."""
    return _broken({"long_text": F.length(tx.strip(F.col("text"))) > long_text})


def _broken(rules: Mapping[str, Column]) -> Column:
    named = F.array(*[F.when(F.coalesce(failed, F.lit(True)), F.lit(name)) for name, failed in rules.items()])
    return F.filter(named, lambda n: n.isNotNull())


def extraction_errors(names: Sequence[str] = K.SIGNAL_NAMES) -> Column:
    """Broken rules of an extraction record, as an array of rule names; empty when valid."""
    scores, evidence = F.map_values("signal_scores"), F.col("evidence")
    ids = F.transform(evidence, lambda e: e["evidence_id"])
    wanted = F.array(*[F.lit(n) for n in names])

    def bad_span(e: Column) -> Column:
        size = F.length(tx.strip(e["text"]))
        outside = (e["start_char"] < 0) | (e["end_char"] < 0) | (e["end_char"] < e["start_char"])
        return ~F.coalesce(size.between(5, 500), F.lit(False)) | e["evidence_id"].isNull() | F.coalesce(outside, F.lit(False))

    def no_support(s: Column) -> Column:
        return s["score"].isNotNull() & (F.coalesce(F.size(s["evidence_ids"]), F.lit(0)) <= 0)

    rules = {
        "missing_signals": F.size(F.array_except(wanted, F.map_keys("signal_scores"))) > 0,
        "unknown_signals": F.size(F.array_except(F.map_keys("signal_scores"), wanted)) > 0,
        "score_range": F.exists(scores, lambda s: F.coalesce(~s["score"].between(1, 5), F.lit(False))),
        "confidence_range": F.exists(scores, lambda s: ~F.coalesce(s["confidence"].between(0.0, 1.0), F.lit(False))),
        "rationale_length": F.exists(scores, lambda s: F.coalesce(F.length(s["rationale"]) > 500, F.lit(False))),
        "score_without_evidence": F.exists(scores, no_support),
        "unknown_evidence": F.exists(scores, lambda s: F.size(F.array_except(F.coalesce(s["evidence_ids"], F.array().cast("array<string>")), ids)) > 0),
        "evidence_span": F.exists(evidence, bad_span),
        "source_type": ~tx.normalize_source_type(F.col("source_type")).isin(*K.SOURCE_TYPES),
        "source_date": F.col("source_date").try_cast("date").isNull(),
        "no_identifier": F.col("company_id").isNull() & F.col("ticker").isNull(),
        "source_document_id": F.col("source_document_id").isNull(),
        "model_name": F.col("model_name").isNull(),
    }
    return _broken(rules)


def check_extractions(extractions: DataFrame, names: Sequence[str] = K.SIGNAL_NAMES) -> DataFrame:
    checked = extractions.withColumn("errors", extraction_errors(names))
    return checked.withColumn("is_valid", F.size("errors") == 0)


def unlinked(extractions: DataFrame, documents: DataFrame) -> DataFrame:
    """Extractions whose source document does not exist."""
    return extractions.join(documents.select("source_document_id"), "source_document_id", "left_anti")


def extraction_quality(extractions: DataFrame, names: Sequence[str] = K.SIGNAL_NAMES) -> DataFrame:
    """Validity, evidence coverage, missing scores and confidence spread, one row."""
    checked = check_extractions(extractions, names)
    per_row = checked.agg(
        F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)).alias("schema_validity_rate"),
        F.coalesce(F.avg((F.size("evidence") > 0).cast("double")), F.lit(0.0)).alias("evidence_coverage_rate"),
    )
    each = extractions.select(F.explode(F.map_values("signal_scores")).alias("s"))
    counted = each.groupBy(F.col("s.confidence").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s.score").isNull()).alias("missing"))
    scores = materialize(counted)
    spread = _confidence_spread(scores)
    return per_row.withColumn("_s", spread.select(F.struct("*")).scalar()).select(
        "*", "_s.*", duplicate_evidence(extractions).agg(F.count(F.lit(1))).scalar().alias("duplicate_evidence_count")
    ).drop("_s")


def _confidence_spread(scores: DataFrame) -> DataFrame:
    """Missing-score rate and confidence measures from (confidence, rows, missing scores) counts."""
    ranks = prefix_sums(scores.where(F.col("c").isNotNull()), [], ["c"], weight="n", before="before", total="total")
    middle = [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)]
    picks = [F.max(F.when((m >= F.col("before")) & (m < F.col("before") + F.col("n")), F.col("c"))) for m in middle]
    known = ranks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("confidence_count"),
        F.try_divide(F.sum(F.col("c") * F.col("n")), F.sum("n")).alias("confidence_mean"),
        ((picks[0] + picks[1]) / 2).alias("confidence_median"),
        F.min("c").alias("confidence_min"),
        F.max("c").alias("confidence_max"),
    )
    rate = scores.agg(F.coalesce(F.try_divide(F.sum("missing"), F.sum("n")), F.lit(0.0))).scalar()
    return known.withColumn("missing_score_rate", rate)


def duplicate_evidence(extractions: DataFrame) -> DataFrame:
    """Evidence texts, trimmed and lower-cased, that occur more than once."""
    spans = extractions.select(F.explode("evidence").alias("e")).select(F.lower(tx.strip(F.col("e.text"))).alias("evidence_text"))
    counts = spans.where(F.col("evidence_text") != "").groupBy("evidence_text").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") > 1)


def flatten_extractions(extractions: DataFrame) -> DataFrame:
    """(ticker, evidence_count, mean_score, mean_confidence) per extraction."""

    def mean(field: str) -> Column:
        values = F.filter(F.transform(F.map_values("signal_scores"), lambda s: s[field].cast("double")), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))

    return extractions.select(
        F.upper(F.coalesce("ticker", F.lit(""))).alias("ticker"),
        F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"),
        mean("score").alias("mean_score"),
        mean("confidence").alias("mean_confidence"),
    )


def extraction_reliability(extractions: DataFrame, panel: DataFrame | None = None, names: Sequence[str] = K.SIGNAL_NAMES) -> DataFrame:
    """Validity rate, mean confidence, missing-evidence rate and mean score per sector."""
    flat = flatten_extractions(extractions)
    valid = check_extractions(extractions, names).agg(F.avg(F.col("is_valid").cast("double"))).scalar()
    totals = flat.agg(
        F.avg("mean_confidence").alias("average_confidence"), F.avg((F.col("evidence_count") == 0).cast("double")).alias("missing_evidence_rate")
    ).withColumn("schema_validity_rate", valid)
    metrics = ["schema_validity_rate", "average_confidence", "missing_evidence_rate"]
    result = totals.unpivot([], metrics, "metric", "value").withColumn("sector", F.lit(None).cast("string"))
    if panel is not None:
        sectors = panel.select("ticker", "sector").distinct()
        by_sector = flat.join(sectors, "ticker", "left").groupBy("sector").agg(F.avg("mean_score").alias("value"))
        result = result.unionByName(by_sector.withColumn("metric", F.lit("score_distribution_mean")))
    return result.select(F.lit("llm_extraction_reliability").alias("diagnostic"), "metric", "value", "sector", F.lit("ok").alias("status"))
