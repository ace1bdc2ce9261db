"""Column names, word lists and thresholds the results depend on."""

SCORE_COLUMNS = ["ai_adoption_score", "ai_fluency_score", "ai_impact_score", "ai_hiring_score"]
COMPOSITE = "composite_ai_score"

MISSING_TOKENS = ["", "nan", "None", "<NA>"]

TRUE_WORDS = ["true", "1", "yes", "y"]
FALSE_WORDS = ["false", "0", "no", "n"]

DEFAULT_SIGNALS = [*SCORE_COLUMNS, COMPOSITE]
IC_OUTCOMES = [
    "fwd_return_1q",
    "fwd_return_2q",
    "future_revenue_growth_qoq",
    "future_operating_margin_delta_qoq",
    "future_revenue_per_employee_growth_qoq",
]
MISSINGNESS_OUTCOMES = [
    "fwd_return_1q",
    "fwd_return_2q",
    "fwd_return_4q",
    "future_revenue_growth_qoq",
    "future_operating_margin_delta_qoq",
    "future_revenue_per_employee_growth_qoq",
]
LAG_OUTCOMES = ["fwd_return_1q", "fwd_return_2q", "fwd_return_4q"]
DISCLOSURE_PROXIES = [
    "source_document_count",
    "filing_length",
    "filing_word_count",
    "source_document_word_count",
]
DEFAULT_CONTROLS = ["prior_return_1q", "revenue_growth_qoq", "operating_margin_t", "log_market_cap"]
REPORT_OUTCOMES = [
    "fwd_return_1q",
    "fwd_return_2q",
    "fwd_excess_return_1q",
    "future_revenue_growth_qoq",
    "future_operating_margin_delta_qoq",
    "future_revenue_per_employee_growth_qoq",
    "revenue_growth_qoq",
    "operating_margin_t",
    "revenue_per_employee_t",
]

CROSS_SECTION_SIGNALS = [
    "maturity_index",
    "adoption_score",
    "proficiency_score",
    "impact_score",
    "conc",
    "inv",
    "builder_rate",
]
PRIMARY_OUTCOME = "rev_growth_yoy"
SECONDARY_OUTCOMES = ["op_margin_delta_yoy", "fwd_ret_4m"]
CATEGORIES = ["AI-Infra", "AI-Software", "Data-Rich", "Physical/Late"]

POSTING_KEYWORDS = [
    "artificial intelligence",
    "machine learning",
    "generative AI",
    "LLM",
    "NLP",
    "computer vision",
    "data scientist",
    "ML engineer",
    "prompt engineer",
    "AI product",
    "AI platform",
    "automation engineer",
]
SAMPLING_BUCKETS = ["ai_keyword_matched", "technical_non_ai", "non_technical", "leadership_strategy"]
TECHNICAL_WORDS = [
    "software",
    "engineer",
    "developer",
    "data engineer",
    "cloud",
    "platform",
    "backend",
    "frontend",
    "devops",
    "security",
    "analytics",
    "database",
]
LEADERSHIP_WORDS = [
    "director",
    "vp",
    "vice president",
    "chief",
    "head of",
    "strategy",
    "strategic",
    "transformation",
]
ROLE_TYPES = ["ai-builder", "ai-user", "ai-leader", "non-ai"]
BOILERPLATE_PATTERN = "cookie|privacy|browser|sign in|navigation|advertis"

FILING_TERMS = [
    "artificial intelligence",
    "machine learning",
    "generative ai",
    "ai",
    "large language",
    "llm",
    "gpu",
    "data center",
    "datacenter",
    "neural",
    "deep learning",
    "automation",
    "chatbot",
    "copilot",
]
EXCERPT_RADIUS = 600
SECTION_NAMES = {"1a": "risk_factors", "7": "mdna", "7a": "mdna", "1": "business"}

EVIDENCE_TERMS = [" ai ", "artificial intelligence", "machine learning", "generative ai", "copilot"]
# signal -> (base score, keywords)
SIGNAL_RULES = {
    "ai_strategy_specificity": (2, ["strategy", "roadmap", "initiative", "deployed"]),
    "ai_operational_maturity": (2, ["deployed", "production", "workflow", "pilot"]),
    "ai_workforce_training": (2, ["training", "trained", "upskilling", "responsible use"]),
    "ai_hiring_intensity": (1, ["hiring", "job", "recruiting", "engineer"]),
    "ai_capex_or_infrastructure_signal": (1, ["infrastructure", "gpu", "data center", "capex", "cloud"]),
    "ai_productivity_claim": (1, ["productivity", "efficiency", "cost savings", "reduced", "automated"]),
}
SIGNAL_NAMES = list(SIGNAL_RULES)
EXTRACTOR_NAME = "keyword-rules"
EXTRACTION_SCHEMA_VERSION = "evidence-record-1"
EXTRACTION_PROMPT_VERSION = "keyword-rules-1"
NO_EVIDENCE_NOTE = "The text has none of the evidence terms."
NULL_SIGNAL_NOTE = "Signals without evidence have no score."
SOURCE_TYPES = ["sec_filing", "earnings_transcript", "job_posting", "news_article", "company_web_page"]
SOURCE_TYPE_ALIASES = {
    "sec filing": "sec_filing",
    "sec_filing": "sec_filing",
    "earnings transcript": "earnings_transcript",
    "earnings_transcript": "earnings_transcript",
    "job posting": "job_posting",
    "job_posting": "job_posting",
    "news": "news_article",
    "news article": "news_article",
    "news_article": "news_article",
    "company page": "company_web_page",
    "company web page": "company_web_page",
    "company_page": "company_web_page",
    "company_web_page": "company_web_page",
}

SUB_DIMENSIONS = [
    "deploymentBreadth",
    "hiringIntensity",
    "vendorFootprint",
    "governanceSignals",
    "workforceFluency",
    "enablementInfra",
    "leadershipDepth",
    "useSophistication",
    "quantifiedOutcomes",
    "financialLinkage",
    "repeatability",
]
EVIDENCE_SOURCES = ["sec", "news", "corporate", "blog", "other"]
TEST_ENTITY_NAME = "Test Company"

LEGAL_SUFFIXES = [
    "incorporated",
    "inc",
    "corporation",
    "corp",
    "company",
    "co",
    "plc",
    "ltd",
    "llc",
    "lp",
    "sa",
    "nv",
    "se",
    "ag",
    "group",
    "holdings",
    "holding",
    "the",
]
FUZZY_CUTOFF = 0.92

REVENUE_CONCEPTS = [
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "Revenues",
    "RevenueFromContractWithCustomerIncludingAssessedTax",
    "RevenuesNetOfInterestExpense",
]
OPERATING_INCOME = "OperatingIncomeLoss"
EMPLOYEE_CONCEPT = "EntityNumberOfEmployees"
SHARES_CONCEPT = "EntityCommonStockSharesOutstanding"
