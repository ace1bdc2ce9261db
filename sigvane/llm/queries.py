"""The registered queries of this subpackage and their SQL: op1 to op13 and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane.llm import (
    chat, divergence, filter_audit, fingerprints, lattice_lm, line_dedup, near_dedup, packing, pieces, pii, quality_classifier, quality_rules, substring_dedup,
)
from sigvane.llm.common import id_remainder, table, text_of

QueryFunction = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id", (id_remainder(quality_classifier.HELD_OUT_MODULUS) == 0).alias("held_out"), quality_classifier.score_column(docs, model).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text").cast("binary"), 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), held AS (
    SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
    SELECT keyed.*, held.owner IS NOT NULL AND held.owner <> doc_id AS dropped FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


PSEUDONYM_KEY = "sf-tables"  # these tables are invented; a real key belongs in the caller's configuration


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return changed.select("doc_id", "text", "n_replaced")


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.perspectives(table(spark, sf_dir, "conversations")).drop("starts_at")
    return rendered.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ","))


PERSPECTIVES_SQL = f"""
WITH said AS (
    SELECT DISTINCT conv_id, coalesce(turn, 0) AS turn, replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS role,
        replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS said
    FROM conversations
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, said) - 1 AS pos FROM said
), speakers AS (
    SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'
), blocks AS (
    SELECT turns.conv_id, pos, speaker, role = speaker AS ours, said || '<|im_end|>' AS body,
        '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
    FROM speakers JOIN turns ON speakers.conv_id IS NOT DISTINCT FROM turns.conv_id
), placed AS (
    SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (
        PARTITION BY conv_id, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opens
    FROM blocks
)
SELECT conv_id, CAST(pos // {chat.PART_TURNS} AS BIGINT) AS part, speaker, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
    coalesce(string_agg(CAST(CAST(opens AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(opens + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (ours), '') AS mask
FROM placed GROUP BY conv_id, pos // {chat.PART_TURNS}, speaker
"""


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.code_documents(docs)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == text_of()).alias("exact"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "quality_rules.*")


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", F.sha2(F.col("substring_dedup.text").cast("binary"), 256).alias("kept_sha256"))


SUBSTRING_DEDUP_SQL = rf"""
WITH words AS (
    SELECT doc_id, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents
), windows AS (
    SELECT doc_id, s, ws[s:s + {substring_dedup.WINDOW - 1}] AS win
    FROM (SELECT doc_id, ws, UNNEST(range(1, len(ws) - {substring_dedup.WINDOW - 2})) AS s FROM words WHERE len(ws) >= {substring_dedup.WINDOW})
), later AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT DISTINCT doc_id, UNNEST(range(s, s + {substring_dedup.WINDOW})) AS pos FROM later
), listed AS (
    SELECT doc_id, UNNEST(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words
), judged AS (
    SELECT listed.*, covered.pos IS NOT NULL AS gone FROM listed LEFT JOIN covered USING (doc_id, pos)
), sums AS (
    SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN sums USING (doc_id)
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SOURCE_DIVERGENCE_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
), words AS (
    SELECT r, lang, source, UNNEST(ts) AS term FROM docs
), often AS (
    SELECT lang, term, count(*) AS m FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCUMENTS}
), totals AS (
    SELECT lang, count(*) AS v, sum(m) AS n FROM often GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS c FROM words JOIN often USING (lang, term) GROUP BY lang, source, term
), sizes AS (
    SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), grid AS (
    SELECT sizes.lang, sizes.source, often.term, coalesce(c, 0) AS c,
        1 + ({divergence.SCALE}::HUGEINT * (coalesce(c, 0) + {divergence.PRIOR}))::HUGEINT // (sizes.n + {divergence.PRIOR} * v)::HUGEINT AS p,
        1 + ({divergence.SCALE}::HUGEINT * (m + {divergence.PRIOR}))::HUGEINT // (totals.n + {divergence.PRIOR} * v)::HUGEINT AS q
    FROM sizes JOIN often USING (lang) JOIN totals USING (lang) LEFT JOIN counts ON counts.lang = sizes.lang AND counts.source = sizes.source AND counts.term = often.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM grid WHERE c > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= {divergence.TOP_TERMS}
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


FILTER_AUDIT_SQL = r"""
WITH letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), said AS (
    SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id
), texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents
), failures AS (
    SELECT part, doc_id, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
    FROM texts
), masks AS (
    SELECT part, mask, count(*) AS n, sum(CASE WHEN good = 1 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM failures LEFT JOIN said USING (doc_id) GROUP BY part, mask
), met AS (
    SELECT part, filter_order, step, n, good, toxic, mask,
        contains(mask, filter_order[step]) AS fails, regexp_matches(mask, '[' || filter_order[1:step - 1] || '-]') AS gone
    FROM masks, orders, range(1, 6) steps(step)
), cells AS (
    SELECT part, filter_order, step, filter_order[step] AS letter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
    FROM met GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM cells
"""


QUERIES: dict[str, QueryFunction] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_fingerprints, op3_line_dedup, op4_near_dedup, op5_pseudonyms,
        op6_perspectives, op7_packing, op8_pieces, op9_quality_rules, op10_lattice_lm,
        op11_substring_dedup, op12_source_divergence, op13_filter_audit,
    )
}

SQL: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP_SQL, "op6_perspectives": PERSPECTIVES_SQL, "op11_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op12_source_divergence": SOURCE_DIVERGENCE_SQL, "op13_filter_audit": FILTER_AUDIT_SQL,
}
