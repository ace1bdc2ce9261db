import json

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions import text as tx
from sigvane.operators import excerpts, extraction, profile, universe


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def brute_force_spans(text, terms):
    import re

    return [(m.start(), m.end()) for m in re.finditer(rf"\b(?:{'|'.join(terms)})\b", text, re.I)]


@pytest.mark.parametrize("text", ["ai AI, xai ai", "é ai\nüai aié Machine learning.", "no hit", "ai" * 3, "ai ai ai", "ß ai_ 漢 ai 漢ai 😀 ai"])
def test_hit_offsets(spark, text):
    got = rows(excerpts.hit_spans(docs(spark, text), "text", ["machine learning", "ai"]))[0]["spans"]
    assert [(s["start"], s["end"]) for s in got or []] == brute_force_spans(text, ["machine learning", "ai"])


def test_excerpts_merge_cap_and_label(spark):
    filler = "x" * 50
    text = f"Item 1A. {filler} ai one ai two {filler} ITEM 7 {filler} ai {filler} tail"
    got = rows(excerpts.excerpts(docs(spark, text), terms=["ai"], radius=10, budget=1000), "excerpt_index")
    assert [r["section"] for r in got] == ["risk_factors", "mdna"]
    assert "ai one ai two" in got[0]["excerpt"] and got[0]["excerpt"] == text[got[0]["start"]:].strip()[: len(got[0]["excerpt"])]
    capped = rows(excerpts.excerpts(docs(spark, text), terms=["ai"], radius=10, budget=len(got[0]["excerpt"])))
    assert len(capped) == 1
    assert rows(excerpts.excerpts(docs(spark, text), terms=["ai"], radius=10, budget=5)) == []
    assert rows(excerpts.excerpts(docs(spark, "ai"), terms=["ai"]))[0]["section"] == "other"


def test_cap_stops_at_the_first_overflow(spark):
    """A later, shorter excerpt does not slip in after one that was too long."""
    text = "aaaa hit " + "b" * 15 + " " * 60 + "hit" + " " * 60
    both = rows(excerpts.excerpts(docs(spark, text), terms=["hit"], radius=20, budget=100))
    assert [(len(r["excerpt"]), r["n_dropped"]) for r in both] == [(24, 0), (3, 0)]
    assert [(len(r["excerpt"]), r["n_dropped"]) for r in rows(excerpts.excerpts(docs(spark, text), terms=["hit"], radius=20, budget=24))] == [(24, 1)]
    assert len(rows(excerpts.excerpts(docs(spark, ("hit" + " " * 60) * 2000), terms=["hit"], radius=20))) == 2000
    short_first = rows(excerpts.excerpts(docs(spark, text), terms=["hit"], radius=20, budget=4))
    assert [r["excerpt_index"] for r in short_first] == []


def test_sections(spark):
    for heading, label in (("item 1.", "business"), ("Item 1A ", "risk_factors"), ("ITEM 7a.", "mdna"), ("item 9b.", "item_9b")):
        text = f"{heading} {'y' * 40} ai"
        assert rows(excerpts.excerpts(docs(spark, text), terms=["ai"], radius=3))[0]["section"] == label


def test_html_and_snippets(spark):
    html = "<style>p{}</style><SCRIPT x='1'>var a='<b>';\n</SCRIPT><p>A&nbsp;B</p>\n  C"
    raw = "Cookie notice\n\nMenu\nData Scientist wanted\nPrivacy\nApply now"
    got = rows(spark.range(1).select(
        tx.html_to_text(F.lit(html)).alias("t"), tx.snippet(F.lit(raw), F.lit("data scientist"), 30).alias("s"), tx.strip_code_fence(F.lit("```json\n[1]\n```")).alias("f")
    ))[0]
    assert got["t"].split() == ["A", "B", "C"]
    assert got["s"] == "Data Scientist wanted Apply no"
    assert got["f"] == "[1]"


def test_latest_of_form(spark):
    filings = spark.createDataFrame(
        [("A", ["8-K", "10-K", "10-K"], ["1", "2", "3"], ["a", "b", "c"], ["d1", "d2", "d3"]), ("B", ["8-K"], ["9"], ["z"], ["d9"])],
        "ticker string, form array<string>, accessionNumber array<string>, primaryDocument array<string>, filingDate array<string>",
    )
    assert rows(excerpts.latest_of_form(filings)) == [{"ticker": "A", "accession": "2", "document": "b", "filing_date": "d2"}]


def source(spark, *texts, ticker="aaa"):
    return spark.createDataFrame([(f"d{i}", "News", "2024-01-31", t, ticker) for i, t in enumerate(texts)], "source_document_id string, source_type string, source_date string, text string, ticker string")


def test_extraction(spark):
    text = "We sell shoes. Our artificial intelligence roadmap was deployed in production. Cloud gpu spend rose."
    got = rows(extraction.extract_documents(source(spark, text, "Nothing here.")), "source_document_id")
    first, second = got
    span = first["evidence"][0]
    assert span["text"] == "Our artificial intelligence roadmap was deployed in production"
    assert text[span["start_char"]:span["end_char"]] == span["text"]
    scores = first["signal_scores"]
    assert scores["ai_strategy_specificity"]["score"] == 4 and scores["ai_strategy_specificity"]["confidence"] == pytest.approx(0.75)
    assert scores["ai_strategy_specificity"]["rationale"] == "the text has the words roadmap, deployed"
    assert scores["ai_workforce_training"]["score"] is None and scores["ai_workforce_training"]["confidence"] == 0.15
    assert first["source_type"] == "news_article" and first["ticker"] == "AAA"
    assert second["evidence"] == [] and second["limitations"] == [K.NO_EVIDENCE_NOTE, K.NULL_SIGNAL_NOTE]
    assert {s["confidence"] for s in second["signal_scores"].values()} == {0.0}
    assert {r["is_valid"] for r in rows(extraction.check_extractions(extraction.extract_documents(source(spark, text))))} == {True}


def record(**changes):
    scores = {n: {"score": None, "confidence": 0.2, "evidence_ids": [], "rationale": None} for n in K.SIGNAL_NAMES}
    scores[K.SIGNAL_NAMES[0]] = {"score": 4, "confidence": 0.8, "evidence_ids": ["ev1"], "rationale": "r"}
    base = {
        "source_document_id": "d", "source_type": "sec_filing", "source_date": "2024-01-31", "model_name": "m", "ticker": "A",
        "evidence": [{"evidence_id": "ev1", "text": "long enough", "start_char": 0, "end_char": 11}], "signal_scores": scores,
    }
    return base | changes


def broken_score(**changes):
    scores = record()["signal_scores"]
    scores[K.SIGNAL_NAMES[0]] = scores[K.SIGNAL_NAMES[0]] | changes
    return {"signal_scores": scores}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({}, None),
        (broken_score(score=6), "score_range"),
        (broken_score(evidence_ids=[]), "score_without_evidence"),
        (broken_score(evidence_ids=["ev9"]), "unknown_evidence"),
        (broken_score(confidence=1.5), "confidence_range"),
        (broken_score(rationale="x" * 501), "rationale_length"),
        ({"signal_scores": {}}, "missing_signals"),
        ({"signal_scores": record()["signal_scores"] | {"other": {"score": None, "confidence": 0.1, "evidence_ids": []}}}, "unknown_signals"),
        ({"evidence": [{"evidence_id": "ev1", "text": "tiny", "start_char": 0, "end_char": 4}]}, "evidence_span"),
        ({"evidence": [{"evidence_id": "ev1", "text": "long enough", "start_char": 9, "end_char": 4}]}, "evidence_span"),
        ({"ticker": None}, "no_identifier"),
        ({"source_type": "rumour"}, "source_type"),
        ({"source_date": "soon"}, "source_date"),
    ],
)
def test_record_rules(spark, change, rule):
    payloads = spark.createDataFrame([(json.dumps(record(**change)),)], "payload string")
    got = rows(extraction.check_extractions(extraction.parse_payloads(payloads)))[0]
    assert got["errors"] == ([] if rule is None else [rule])


def test_bad_json_is_invalid(spark):
    payloads = spark.createDataFrame([("{nope",), (json.dumps(record()),)], "payload string")
    quality = rows(extraction.extraction_quality(extraction.parse_payloads(payloads)))[0]
    assert quality["schema_validity_rate"] == 0.5 and quality["confidence_count"] == 6
    assert quality["confidence_median"] == pytest.approx(0.2) and quality["missing_score_rate"] == pytest.approx(5 / 6)


def test_duplicate_evidence_and_profiles(spark):
    found = extraction.extract_documents(source(spark, "Machine learning pilot.", " machine learning pilot. More."))
    assert [r["count"] for r in rows(extraction.duplicate_evidence(found))] == [2]
    assert profile.source_evidence(found, "AAA").count() == 2 and profile.source_evidence(found, "ZZZ").isEmpty()


def test_pluggable_extractor(spark):
    columns = [f.split()[0] for f in ("source_document_id", "source_type", "source_date")]

    def echo(batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[columns].copy()
        for name, value in {
            "extraction_created_at": pd.Timestamp("2024-01-01"), "model_name": "echo", "prompt_version": "p", "schema_version": "s", "company_id": None, "company_name": None,
        }.items():
            out[name] = value
        out["evidence"] = [[] for _ in range(len(out))]
        out["signal_scores"] = [{} for _ in range(len(out))]
        out["limitations"] = [[] for _ in range(len(out))]
        out["ticker"] = batch["ticker"]
        return out

    assert [r["model_name"] for r in rows(extraction.extract_with(source(spark, "x"), echo))] == ["echo"]


def test_single_text(spark):
    df = spark.createDataFrame([("words", "Acme Corp", "2023Q4"), ("w", "Bo", "soon")], "t string, c string, p string")
    got = rows(extraction.single_text_document(df, "t", "c", "p"), "t")
    assert [(r["ticker"], r["source_date"]) for r in got] == [("BO", "2025-01-01"), ("ACMEC", "2023-12-31")]


def test_flatten_scores(spark):
    content = {
        "aiScores": {
            "maturityIndex": "4.5",
            "adoption": {"score": 4, "label": "high", "evidence": [{"sourceType": "sec"}, {"sourceType": "radio"}, {}], "subDimensions": [{"name": "leadershipDepth", "score": "2"}, {"name": "nope", "score": "1"}]},
            "impact": {"score": "bad", "missingEvidence": ["a", "b"]},
        },
        "aiAppsUsed": ["x"],
    }
    df = spark.createDataFrame([(json.dumps(content),)], "j string").select(F.from_json("j", universe.CONTENT_SCHEMA).alias("content"))
    got = rows(universe.flatten_scores(df))[0]
    assert (got["maturity_index"], got["adoption_score"], got["impact_score"], got["proficiency_score"]) == (4.5, 4.0, None, None)
    assert (got["adoption_n_evidence"], got["impact_n_missing_evidence"], got["n_ai_apps_used"], got["n_initiatives"]) == (3, 2, 1, 0)
    assert (got["evidence_sec"], got["evidence_other"], got["sub_leadershipDepth"]) == (1, 2, 2.0)


def panel(spark):
    data = [("aaa", "Tech", "2025Q1", 3.0), ("aaa", "Tech", "2025Q2", 5.0), ("BBB", "Tech", "2025Q2", 4.0), ("CCC", "Retail", "2025Q2", 9.0)]
    return profile.normalize_panel(spark.createDataFrame(data, f"ticker string, sector string, score_quarter string, {K.COMPOSITE} double"))


def test_entity_tools(spark):
    p = panel(spark)
    latest = {r["ticker"]: r for r in rows(profile.latest_snapshot(p))}
    assert latest["AAA"]["score_quarter"] == "2025Q2" and latest["AAA"]["ai_composite_score"] == 5.0
    ranks = {(r["ticker"], r["score_quarter"]): (r["signal_rank"], r["num_peers"]) for r in rows(profile.signal_rank(p, K.COMPOSITE))}
    assert ranks[("AAA", "2025Q2")] == (1, 2) and ranks[("BBB", "2025Q2")] == (2, 2)
    assert [r["ticker"] for r in rows(profile.peer_rows(p, "aaa"))] == ["AAA", "BBB"]
    assert [r["score_quarter"] for r in profile.history(p, " aaa ").collect()] == ["2025Q1", "2025Q2"]
    metrics = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "signal string, v double")
    assert rows(profile.backtest_summary(metrics, "b"))[0]["v"] == 2.0
    assert rows(profile.backtest_summary(metrics, "zzz"))[0]["v"] == 1.0
    evidence = spark.createDataFrame([("AAA", f"d{i}", f"t{i}") for i in range(7)], "ticker string, source_document_id string, text string")
    wide = {r["ticker"]: r for r in rows(profile.entity_profiles(p, evidence))}
    assert wide["AAA"]["evidence"] == [f"t{i}" for i in range(5)] and wide["AAA"]["history_rows"] == 2 and wide["BBB"]["evidence"] is None
