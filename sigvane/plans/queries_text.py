"""Document, extraction and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane import runtime
from sigvane.functions import text as tx
from sigvane.operators import excerpts, extraction, hiring, profile
from sigvane.plans import bindings as B
from sigvane.plans.queries_panel import rounded
from sigvane.plans.queries_signals import count
from sigvane.plans.queries_tables import POSTING_WORDS, POSTINGS_SQL, raw_postings
from sigvane.plans.registry import query
from sigvane.sources import readers, sinks

# The documents are invented prose, so the word lists are taken from it.
LEADERS, ENGINEERS = ["stupid", "vp", "and th"], ["ing", "heit", "tion"]


# --- sampling ----------------------------------------------------------------------------------------

_BUCKETS = f"""{POSTINGS_SQL}, bucketed AS (
  SELECT job_posting_id, is_ai_keyword_matched, CASE WHEN is_ai_keyword_matched = 1 THEN 'ai_keyword_matched'
    WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '{"|".join(LEADERS)}') THEN 'leadership_strategy'
    WHEN regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '{"|".join(ENGINEERS)}') THEN 'technical_non_ai' ELSE 'non_technical' END AS sampling_bucket FROM postings)"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged (id, keyword flag, bucket) of every posting; sampling reads it several times."""
    return B.staged(spark, sf_dir, "bucketed", _build_bucketed)


def _build_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_postings(spark, sf_dir)
    tidy = raw.select("job_posting_id", *[tx.collapse_text(F.col(c)).alias(c) for c in ("title", "description")])
    flagged = tidy.withColumn("is_ai_keyword_matched", tx.matches_keyword(F.col("title"), F.col("description"), POSTING_WORDS))
    bucket = tx.sampling_bucket(F.col("is_ai_keyword_matched"), F.col("title"), F.col("description"), LEADERS, ENGINEERS)
    return flagged.select("job_posting_id", "is_ai_keyword_matched", bucket.alias("sampling_bucket"))


@query("sampling_buckets", "J2", f"WITH {_BUCKETS} SELECT job_posting_id, sampling_bucket FROM bucketed")
def sampling_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).select("job_posting_id", "sampling_bucket")


_SAMPLE = f"""{_BUCKETS}, sampled AS (
  SELECT job_posting_id, is_ai_keyword_matched, sampling_bucket, count(*) OVER (PARTITION BY sampling_bucket) AS available FROM bucketed
  QUALIFY row_number() OVER (PARTITION BY sampling_bucket ORDER BY md5('7:' || job_posting_id), job_posting_id) <= 25),
weighted AS (SELECT *, available / least(available, 25) AS sample_weight FROM sampled)"""


@query(
    "stratified_sample",
    "N1",
    f"WITH {_SAMPLE} SELECT job_posting_id, sampling_bucket, round(sample_weight, 6) AS sample_weight, 7 AS random_seed FROM weighted",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hiring.stratified_sample(bucketed(spark, sf_dir), "job_posting_id", per_bucket=25, seed=7)
    return rows.select("job_posting_id", "sampling_bucket", *rounded("sample_weight"), "random_seed")


@query(
    "sample_summary",
    "E22 E23",
    f"""WITH {_SAMPLE} SELECT sampling_bucket, count(*) AS sampled, round(count(*) / (SELECT count(*) FROM weighted), 6) AS sample_share, (SELECT count(*) FROM weighted) AS sample_size,
        (SELECT count(*) FROM bucketed) AS total_postings, (SELECT CAST(sum(is_ai_keyword_matched) AS BIGINT) FROM bucketed) AS ai_keyword_count,
        round((SELECT sum(sample_weight * is_ai_keyword_matched) / sum(sample_weight) FROM weighted), 6) AS weighted_ai_share FROM weighted GROUP BY 1""",
)
def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = bucketed(spark, sf_dir)
    rows = hiring.sample_summary(full, hiring.stratified_sample(full, "job_posting_id", per_bucket=25, seed=7))
    return rows.select("sampling_bucket", "sampled", *rounded("sample_share", "weighted_ai_share"), "sample_size", "total_postings", "ai_keyword_count")


# --- documents -----------------------------------------------------------------------------------------


@query(
    "html_to_text",
    "J3",
    r"""SELECT page_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS characters FROM (
      SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
             '<[^>]+>', ' ', 'g'), '&[a-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g') AS t FROM pages)""",
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = tx.html_to_text(F.col("html"))
    return B.table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("digest"), F.length(text).cast("long").alias("characters"))


@query(
    "filings_latest_form",
    "J4",
    f"""WITH {B.ENTITY_QUARTERS_SQL} SELECT company_id, 'A' || net AS accession, 'doc' || net AS document, CAST(period_end AS VARCHAR) AS filing_date FROM entity_quarters
    WHERE quarter(period_end) = 4 QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY period_end DESC) = 1""",
)
def filings_latest_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's quarters as its filings, newest first, in columnar arrays: one filing per quarter."""
    q = B.entity_quarters(spark, sf_dir)
    filing = F.struct(
        F.col("period_end").cast("string").alias("d"), F.col("net").cast("string").alias("n"), F.when(F.quarter("period_end") == 4, "10-K").otherwise("10-Q").alias("form")
    )
    rows = q.groupBy("company_id").agg(F.sort_array(F.collect_list(filing), False).alias("r"))
    columnar = rows.select(
        "company_id", F.col("r.form").alias("form"), F.transform("r.n", lambda k: F.concat(F.lit("A"), k)).alias("accessionNumber"),
        F.transform("r.n", lambda k: F.concat(F.lit("doc"), k)).alias("primaryDocument"), F.col("r.d").alias("filingDate"),
    )
    return excerpts.latest_of_form(columnar)


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three section headings: before them, after a third and after two thirds of the text."""
    third = "CAST(length(text) DIV 3 AS INT)"
    text = f"'Item 1. ' || substring(text, 1, {third}) || ' ITEM 1A ' || substring(text, {third} + 1, {third}) || ' item 7. ' || substring(text, 2 * {third} + 1)"
    return B.table(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("text"))


# The documents hold few of the real terms, so two of their own words are looked for as well.
EXCERPT_TERMS = [*K.FILING_TERMS, "stupid", "mit"]
_LONGEST = max(map(len, EXCERPT_TERMS))
_WORD = r"[\p{L}\p{N}_]"
# Term positions from the character rows themselves; a term inside a longer one is no hit of its own.
_HITS = f"""filings AS (SELECT doc_id, length(text) // 3 AS third, 'Item 1. ' || substr(text, 1, length(text) // 3) || ' ITEM 1A ' || substr(text, length(text) // 3 + 1, length(text) // 3)
      || ' item 7. ' || substr(text, 2 * (length(text) // 3) + 1) AS text FROM documents),
chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM filings
    WHERE regexp_matches(text, '(?i)\\b({"|".join(EXCERPT_TERMS)})\\b')),
near AS (SELECT doc_id, i, lower(string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {_LONGEST} FOLLOWING)) AS ahead,
              coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i), ' ') AS before FROM chars),
found AS (SELECT doc_id, i AS s, i + length(term) AS e FROM near, (SELECT unnest({EXCERPT_TERMS}) AS term)
          WHERE starts_with(ahead, term) AND NOT regexp_matches(before, '{_WORD}') AND NOT regexp_matches(substr(ahead, length(term) + 1, 1), '{_WORD}')),
hits AS (SELECT doc_id, s, e FROM found QUALIFY s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"""


@query(
    "term_hits",
    "J5",
    f"WITH {_HITS} SELECT doc_id, count(*) AS hits, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM hits GROUP BY 1",
)
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = excerpts.hit_spans(filings(spark, sf_dir), "text", EXCERPT_TERMS).where("spans IS NOT NULL")
    return rows.selectExpr(
        "doc_id", "CAST(size(spans) AS BIGINT) AS hits", "aggregate(spans, 0L, (a, s) -> a + s.start) AS starts", "aggregate(spans, 0L, (a, s) -> a + s.end) AS ends"
    )


_EXCERPTS = rf"""{_HITS}, wide AS (SELECT h.doc_id, greatest(0, s - {K.EXCERPT_RADIUS}) AS s, least(length(text), e + {K.EXCERPT_RADIUS}) AS e, h.s AS hit_at FROM hits h JOIN filings d USING (doc_id)),
    marked AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY doc_id ORDER BY hit_at) THEN 0 ELSE 1 END AS fresh FROM wide),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY hit_at ROWS UNBOUNDED PRECEDING) AS g FROM marked),
    merged AS (SELECT doc_id, g, min(s) AS s, max(e) AS e FROM islands GROUP BY 1, 2),
    excerpts AS (SELECT doc_id, CAST(g - 1 AS BIGINT) AS excerpt_index, s AS start,
           CASE WHEN s >= 25 + 2 * third THEN 'mdna' WHEN s >= 17 + third THEN 'risk_factors' WHEN s >= 7 THEN 'business' ELSE 'other' END AS section,
           regexp_replace(substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)), '^\s+|\s+$', '', 'g') AS excerpt FROM merged JOIN filings USING (doc_id))"""


@query("document_excerpts", "J5 J7", f"WITH {_EXCERPTS} SELECT * FROM excerpts")
def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = excerpts.excerpts(filings(spark, sf_dir), "text", EXCERPT_TERMS)
    return rows.select("doc_id", count("excerpt_index"), "start", "section", "excerpt")


_BUDGET = 3000  # characters; several documents have more in their excerpts


@query(
    "document_excerpts_budget",
    "J5 J6 J7",
    f"""WITH {_EXCERPTS}, running AS (SELECT *, sum(length(excerpt)) OVER (PARTITION BY doc_id ORDER BY excerpt_index) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM excerpts),
    kept AS (SELECT * FROM running WHERE total <= {_BUDGET})
    SELECT doc_id, excerpt_index, start, section, CAST(length(excerpt) AS BIGINT) AS characters, CAST(n - count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS n_dropped FROM kept""",
)
def document_excerpts_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts in order up to a budget of characters; a document whose first one exceeds it has none."""
    rows = excerpts.excerpts(filings(spark, sf_dir), "text", EXCERPT_TERMS, budget=_BUDGET)
    return rows.select("doc_id", count("excerpt_index"), "start", "section", F.length("excerpt").cast("long").alias("characters"), count("n_dropped"))


@query(
    "verified_quotes",
    "F32",
    """WITH c AS (SELECT lang, text, substr(text, length(text) // 2 + 1) || CASE WHEN doc_id % 3 = 0 THEN '?!' ELSE '' END AS quote FROM documents)
    SELECT lang, count(*) AS quotes, count(*) FILTER (contains(text, quote)) AS verified FROM c GROUP BY 1""",
)
def verified_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of every document as its quote, every third one changed."""
    docs = B.table(spark, sf_dir, "documents")
    part = F.expr("substring(text, CAST(length(text) DIV 2 + 1 AS INT))")
    quotes = docs.select("doc_id", "lang", F.concat(part, F.when(F.col("doc_id") % 3 == 0, "?!").otherwise("")).alias("quote"))
    checked = excerpts.verify_quotes(quotes, docs, "doc_id")
    return checked.groupBy("lang").agg(F.count(F.lit(1)).alias("quotes"), F.count_if("found").alias("verified"))


_LINES = r"list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda l: trim(l) <> '' AND NOT regexp_matches(l, '(?i)stupid|privacy'))"


@query(
    "conversation_snippets",
    "J11",
    f"""WITH t AS (SELECT conv_id, turn, array_to_string({_LINES}, ' ') AS body, split_part(text, '. ', 2) AS title FROM conversations),
    p AS (SELECT *, CASE WHEN length(title) > 0 THEN instr(lower(body), lower(title)) ELSE 0 END AS pos FROM t)
    SELECT conv_id, turn, substr(body, CASE WHEN pos > 1 THEN pos ELSE 1 END) AS snippet FROM p""",
)
def conversation_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn from its second sentence on, where it has one."""
    rows = B.table(spark, sf_dir, "conversations")
    title = F.split_part("text", F.lit(". "), F.lit(2))
    return rows.select("conv_id", "turn", tx.snippet(F.col("text"), title, boilerplate="stupid|privacy").alias("snippet"))


# --- requests and replies --------------------------------------------------------------------------------


@query(
    "request_batches",
    "J8",
    """WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, doc_id, text AS t FROM documents),
    l AS (SELECT source, p // 25 AS batch, p % 25 AS i, '[' || (p % 25) || '] title: ' || t AS body FROM r)
    SELECT source, batch, count(*) AS results, md5('TARGET COMPANY: ' || source || chr(10) || chr(10) || 'RESULTS:' || chr(10) || string_agg(body, chr(10) ORDER BY i)) AS request FROM l GROUP BY 1, 2""",
)
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").alias("t"))
    header = F.concat(F.lit("TARGET COMPANY: "), F.col("source"))
    body = F.concat(F.lit("["), F.col("result_index").cast("string"), F.lit("] title: "), F.col("t"))
    rows = hiring.request_batches(docs, "source", "doc_id", header, body)
    return rows.select("source", count("batch"), count("results"), F.md5("request").alias("request"))


@query(
    "request_batches_of_pages",
    "J8",
    r"""WITH t AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS title,
             trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS snippet FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS p FROM t),
    l AS (SELECT host, p // 20 AS batch, p % 20 AS i, '[' || (p % 20) || '] ' || title || ' <' || url || '>' || CASE WHEN length(snippet) > 0 THEN chr(10) || '    ' || snippet ELSE '' END AS body FROM r)
    SELECT host, batch, count(*) AS results, md5('PAGES OF ' || host || chr(10) || chr(10) || 'RESULTS:' || chr(10) || string_agg(body, chr(10) ORDER BY i)) AS request FROM l GROUP BY 1, 2""",
)
def request_batches_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a host as results with title, address and text, twenty to a request."""
    pages = B.table(spark, sf_dir, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    results = pages.select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), "page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), text.alias("snippet")
    )
    body = hiring.result_line(F.col("title"), F.col("url"), F.col("snippet"))
    rows = hiring.request_batches(results, "host", "page_id", F.concat(F.lit("PAGES OF "), F.col("host")), body, size=20)
    return rows.select("host", count("batch"), count("results"), F.md5("request").alias("request"))


@query(
    "model_replies",
    "J9 J10",
    """SELECT conv_id, turn // 25 AS batch, turn % 25 AS result_index, CASE WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS is_company_match,
       CASE WHEN role = 'assistant' THEN 'ai-builder' WHEN role = 'user' THEN 'non-ai' END AS ai_role_type, round(turn / 10.0, 6) AS confidence FROM conversations
       WHERE conv_id % 10 <> 7""",
)
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a broken reply have no results at all."""
    replies, results = _replies(spark, sf_dir)
    rows = hiring.parse_replies(replies, results, ["conv_id", "batch"], entity=["conv_id"])
    return rows.select("conv_id", count("batch"), count("result_index"), F.col("is_company_match").cast("int").alias("is_company_match"), "ai_role_type", *rounded("confidence"))


@query("failed_replies", "J9", "SELECT DISTINCT conv_id, turn // 25 AS batch, 'invalid_json' AS error FROM conversations WHERE conv_id % 10 = 7 AND turn // 25 = 0")
def failed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = hiring.failed_replies(_replies(spark, sf_dir)[0], ["conv_id", "batch"])
    return failed.select("conv_id", count("batch"), "error")


def _replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of a conversation as results in batches of 25; a reply is a fenced JSON array with one index too many.

    The first reply to every tenth conversation breaks off.
    """
    talk = B.table(spark, sf_dir, "conversations").withColumns({"batch": F.floor(F.col("turn") / 25), "place": (F.col("turn") % 25).cast("int")})
    label = F.when(F.col("role") == "assistant", "ai-builder").when(F.col("role") == "user", "something-else").otherwise("")
    answer = F.struct(
        F.col("place").alias("result_index"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 3 == 1).alias("is_company_match"), label.alias("ai_role_type"),
        (F.col("turn") / F.lit(10.0)).alias("confidence"),
    )
    stray = F.array(F.struct(F.lit(999).alias("result_index"), F.lit(True).alias("is_company_match"), F.lit("ai-user").alias("ai_role_type"), F.lit(1.0).alias("confidence")))
    whole = F.concat(F.lit("```json\n"), F.to_json(F.concat(F.collect_list(answer), stray)), F.lit("\n```"))
    cut = (F.col("conv_id") % 10 == 7) & (F.col("batch") == 0)
    replies = talk.groupBy("conv_id", "batch").agg(whole.alias("reply"))
    replies = replies.withColumn("reply", F.when(cut, F.expr("substring(reply, 1, length(reply) - 9)")).otherwise(F.col("reply")))
    return replies, talk.select("conv_id", "batch", F.col("place").alias("result_index"))


# --- extraction --------------------------------------------------------------------------------------------

EVIDENCE_TERMS = [" stupid ", "mit der", "que des"]
RULES = {
    name: (base, words)
    for (name, (base, _)), words in zip(
        K.SIGNAL_RULES.items(),
        [["the", "und", "que", "ción"], ["stupid", "heit"], ["zzzz"], ["tion", "ing", "er", "und", "des"], ["a", "b", "c", "d", "e"], ["qu", "sch", "tion", "ß", "ñ"]],
        strict=True,
    )
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.cast("string").alias("source_document_id"), F.when(k % 2 == 0, "News").otherwise("SEC filing").alias("source_type"), F.lit("2024-01-31").alias("source_date"),
        "text", F.when(k % 10 != 0, F.concat(F.lit("s"), (k % 97).cast("string"))).alias("ticker"),
    )


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_documents(documents(spark, sf_dir), EVIDENCE_TERMS, RULES)


def _any(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in EVIDENCE_TERMS) + ")"


def _rule_sql(name: str) -> str:
    base, words = RULES[name]
    n = "(" + " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"
    return (
        f"CASE WHEN quote IS NOT NULL AND {n} > 0 THEN least(5, {base} + {n}) END AS score_{name}, "
        f"CAST(CASE WHEN quote IS NULL THEN 0.0 WHEN {n} = 0 THEN 0.15 ELSE round(0.65 + least(0.25, {n} * 0.05), 6) END AS DOUBLE) AS confidence_{name}"
    )


_EXTRACTED = rf"""quoted AS (
  SELECT CAST(doc_id AS VARCHAR) AS source_document_id, doc_id, lower(text) AS low, text,
         CASE WHEN {_any("' ' || lower(text) || ' '")} THEN coalesce(list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), '.'),
           lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '' AND {_any("' ' || lower(s) || ' '")})[1], regexp_replace(text, '^\s+|\s+$', '', 'g')) END AS quote FROM documents),
extracted AS (
  SELECT source_document_id, doc_id, quote, CASE WHEN doc_id % 10 <> 0 THEN 'S' || (doc_id % 97) END AS ticker, instr(text, quote) - 1 AS start_char, instr(text, quote) - 1 + length(quote) AS end_char,
         {", ".join(_rule_sql(n) for n in K.SIGNAL_NAMES)} FROM quoted)"""
_SCORES = [f"score_{n}" for n in K.SIGNAL_NAMES]
_CONFIDENCES = [f"confidence_{n}" for n in K.SIGNAL_NAMES]


@query(
    "evidence_extraction",
    "J12 J13 J14",
    f"""WITH {_EXTRACTED} SELECT source_document_id, CASE WHEN doc_id % 2 = 0 THEN 'news_article' ELSE 'sec_filing' END AS source_type, ticker, quote, start_char, end_char,
        {", ".join(_SCORES + _CONFIDENCES)}, CASE WHEN quote IS NULL THEN 2 WHEN {" OR ".join(f"{s} IS NULL" for s in _SCORES)} THEN 1 ELSE 0 END AS limitations FROM extracted""",
)
def evidence_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.get("evidence", F.lit(0))
    signal = F.col("signal_scores")
    return extractions(spark, sf_dir).select(
        "source_document_id", "source_type", "ticker", span["text"].alias("quote"), span["start_char"].alias("start_char"), span["end_char"].alias("end_char"),
        *[signal[n]["score"].alias(f"score_{n}") for n in K.SIGNAL_NAMES], *[F.round(signal[n]["confidence"], 6).alias(f"confidence_{n}") for n in K.SIGNAL_NAMES],
        F.size("limitations").alias("limitations"),
    )


_SHORT = "(length(quote) < 5 OR length(quote) > 500)"  # the record rule on spans, which reports and cuts nothing


@query(
    "extraction_record_checks",
    "C19 J15",
    f"""WITH {_EXTRACTED} SELECT source_document_id, CAST(quote IS NULL OR ticker IS NOT NULL AND NOT {_SHORT} AS INTEGER) AS is_valid FROM extracted WHERE ticker IS NOT NULL OR quote IS NOT NULL AND {_SHORT}
    UNION ALL SELECT source_document_id, 0 FROM extracted WHERE ticker IS NULL AND NOT (quote IS NOT NULL AND {_SHORT})""",
)
def extraction_record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records go out as JSON text and come back before they are checked."""
    payload = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    parsed = extraction.parse_payloads(extractions(spark, sf_dir).select(payload.alias("payload"))).drop("payload")
    return extraction.check_extractions(parsed).select("source_document_id", F.col("is_valid").cast("int").alias("is_valid"))


@query(
    "unlinked_extractions",
    "C20",
    "SELECT CAST(doc_id AS VARCHAR) AS source_document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def unlinked_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = B.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("source_document_id"))
    return extraction.unlinked(extractions(spark, sf_dir), known).select("source_document_id")


_CONF_ROWS = " UNION ALL ".join(f"SELECT {c} AS c, {s} AS s FROM extracted" for c, s in zip(_CONFIDENCES, _SCORES, strict=True))


@query(
    "extraction_quality",
    "E19 E20",
    f"""WITH {_EXTRACTED}, conf AS ({_CONF_ROWS}), dup AS (SELECT lower(trim(quote)) AS t FROM extracted WHERE quote IS NOT NULL AND quote <> '' GROUP BY 1 HAVING count(*) > 1)
    SELECT round(avg(CASE WHEN ticker IS NOT NULL AND (quote IS NULL OR NOT {_SHORT}) THEN 1.0 ELSE 0.0 END), 6) AS schema_validity_rate,
           round(avg(CASE WHEN quote IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS evidence_coverage_rate, round((SELECT avg(CASE WHEN s IS NULL THEN 1.0 ELSE 0.0 END) FROM conf), 6) AS missing_score_rate,
           (SELECT count(*) FROM conf) AS confidence_count, round((SELECT avg(c) FROM conf), 6) AS confidence_mean, round((SELECT median(c) FROM conf), 6) AS confidence_median,
           round((SELECT min(c) FROM conf), 6) AS confidence_min, round((SELECT max(c) FROM conf), 6) AS confidence_max, (SELECT count(*) FROM dup) AS duplicate_evidence_count FROM extracted""",
)
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.extraction_quality(extractions(spark, sf_dir))
    return rows.select(
        *rounded("schema_validity_rate", "evidence_coverage_rate", "missing_score_rate", "confidence_mean", "confidence_median", "confidence_min", "confidence_max"),
        "confidence_count", "duplicate_evidence_count",
    )


@query(
    "duplicate_evidence",
    "E20",
    f"WITH {_EXTRACTED} SELECT lower(trim(quote)) AS evidence_text, count(*) AS count FROM extracted WHERE quote IS NOT NULL AND quote <> '' GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.duplicate_evidence(extractions(spark, sf_dir))


def _mean_sql(columns: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    known = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in columns)
    return f"({total}) / nullif(({known}), 0)"


@query(
    "extraction_reliability",
    "E21 D17",
    f"""WITH {_EXTRACTED}, {B.COMPANIES_SQL}, m AS (SELECT *, {_mean_sql(_SCORES)} AS mean_score, {_mean_sql(_CONFIDENCES)} AS mean_confidence FROM extracted)
    SELECT 'schema_validity_rate' AS metric, round(avg(CASE WHEN ticker IS NOT NULL AND (quote IS NULL OR NOT {_SHORT}) THEN 1.0 ELSE 0.0 END), 6) AS value, CAST(NULL AS VARCHAR) AS sector FROM m
    UNION ALL SELECT 'average_confidence', round(avg(mean_confidence), 6), NULL FROM m
    UNION ALL SELECT 'missing_evidence_rate', round(avg(CASE WHEN quote IS NULL THEN 1.0 ELSE 0.0 END), 6), NULL FROM m
    UNION ALL SELECT 'score_distribution_mean', round(avg(mean_score), 6), c.sector FROM m LEFT JOIN companies c ON m.ticker = c.ticker GROUP BY c.sector""",
)
def extraction_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.extraction_reliability(extractions(spark, sf_dir), B.companies(spark, sf_dir))
    return rows.select("metric", *rounded("value"), "sector")


@query(
    "extractions_jsonl_round_trip",
    "A11 A12",
    f"""WITH {_EXTRACTED} SELECT coalesce(ticker, '') AS ticker, CASE WHEN quote IS NULL THEN 0 ELSE 1 END AS evidence_count, round({_mean_sql(_SCORES)}, 6) AS mean_score,
        round({_mean_sql(_CONFIDENCES)}, 6) AS mean_confidence FROM extracted""",
)
def extractions_jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.write_extractions(extractions(spark, sf_dir), runtime.scratch_path(spark, "extractions"))
    rows = extraction.flatten_extractions(readers.read_extractions(spark, path))
    return rows.select("ticker", "evidence_count", *rounded("mean_score", "mean_confidence"))


@query(
    "source_evidence",
    "J16",
    f"WITH {_EXTRACTED} SELECT ticker, source_document_id, CASE WHEN doc_id % 2 = 0 THEN 'news_article' ELSE 'sec_filing' END AS source_type, quote AS text, 'ev1' AS evidence_id FROM extracted WHERE quote IS NOT NULL AND ticker = 'S5'",
)
def source_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.source_evidence(extractions(spark, sf_dir), " s5").drop("source_date")


@query(
    "documents_jsonl",
    "A10",
    """SELECT count(*) AS valid, count(*) FILTER (doc_id % 50 = 1) AS bad_json, CAST(sum(length(text)) AS BIGINT) AS characters, max(n) AS longest
              , count(*) FILTER (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 12000) AS long_texts
       FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(trim(text)) > 0)""",
)
def documents_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines with some broken lines added; the reader keeps the good and counts the bad."""
    d = documents(spark, sf_dir)
    path = runtime.scratch_path(spark, "documents")
    d.select(F.to_json(F.struct(*d.columns)).alias("value")).write.text(path)
    broken = F.col("source_document_id").cast("int") % 50 == 1
    d.where(broken & (F.length(F.trim("text")) > 0)).select(F.lit('{"source_document_id": ').alias("value")).write.mode("append").text(path)
    good, bad = readers.read_documents(spark, path)
    wrong = bad.where(F.array_contains("errors", "invalid_json")).agg(F.count(F.lit(1))).scalar()
    return good.agg(
        F.count(F.lit(1)).alias("valid"), wrong.alias("bad_json"), F.sum(F.length("text")).alias("characters"), F.max(F.length("text")).cast("long").alias("longest"),
        F.count_if(F.array_contains("warnings", "long_text")).alias("long_texts"),
    )
