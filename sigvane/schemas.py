"""Canonical input and output schemas as DDL text."""

from sigvane.constants import SCORE_COLUMNS
from sigvane.operators.extraction import EXTRACTION_SCHEMA

COMPANIES = (
    "company_id string, company_name string, ticker string, cik string, exchange string, sector string, industry string, "
    "country string, active_from date, active_to date, name string, market_cap double, source_name string"
)
SCORES = (
    "company_id string, ticker string, company_name string, snapshot_date date, score_quarter string, "
    + ", ".join(f"{c} int" for c in SCORE_COLUMNS)
    + ", source_name string, source_url string, available_at timestamp, available_at_assumption boolean, metadata_json string"
)
PRICES = (
    "company_id string, ticker string, price_date date, price_quarter string, adjusted_close double, volume double, "
    "source_name string, available_at timestamp, daily_return double"
)
FINANCIALS = (
    "company_id string, ticker string, fiscal_quarter string, fiscal_period_end date, available_at timestamp, revenue double, "
    "gross_margin double, operating_margin double, net_income double, employee_count double, source_name string, source_document_id string"
)
POSTINGS = (
    "job_posting_id string, company_id string, ticker string, title string, department string, location string, description string, "
    "posting_date date, collected_at timestamp, source_url string, source_name string, raw_hash string, is_active boolean, "
    "is_ai_keyword_matched boolean, is_likely_duplicate boolean"
)
IDENTIFIER_HISTORY = "company_id string, identifier_type string, identifier string, valid_from date, valid_to date"
DOCUMENTS = (
    "source_document_id string, source_type string, source_date date, text string, company_id string, ticker string, "
    "company_name string, source_url string"
)
EXTRACTIONS = EXTRACTION_SCHEMA
FACTS = (
    "ticker string, cik string, facts map<string,map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,filed:string>>>>>>"
)
SEARCH_RESULTS = (
    "ticker string, company string, snapshot string, results array<struct<title:string,url:string,published_date:string,highlights:array<string>>>"
)
CLASSIFIED_POSTINGS = (
    "url string, title string, published_date string, is_company_match boolean, ai_role_type string, seniority string, "
    "ai_requirement_strength string, confidence double, evidence string"
)

# Every feature table carries an observation date and the time it became available.
FEATURE_TABLES = {
    "scores": ("snapshot_date", SCORES),
    "prices": ("price_date", PRICES),
    "financials": ("fiscal_period_end", FINANCIALS),
}
