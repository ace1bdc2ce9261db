"""Classified postings to hiring signals, their reliability, sampling and request batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane.functions import text as tx
from sigvane.operators.ic import spearman
from sigvane.operators.ordering import add_percentile_rank, prefix_sums
from sigvane.runtime import materialize


def hiring_signal(postings: DataFrame, keys: Sequence[str] = ("ticker", "snapshot")) -> DataFrame:
    """Posting counts and rates per entity and snapshot; unmatched postings count only in ``n_results``."""
    matched = F.col("is_company_match")

    def role(name: str) -> Column:
        return F.count_if(matched & (F.col("ai_role_type") == name))

    counts = postings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_results"),
        F.count_if(matched).alias("n_matched"),
        role("ai-builder").alias("n_ai_builder"),
        role("ai-user").alias("n_ai_user"),
        role("ai-leader").alias("n_ai_leader"),
    )
    users = F.col("n_ai_builder") + F.col("n_ai_user") + F.col("n_ai_leader")
    return counts.withColumns(
        {"builder_rate": F.try_divide("n_ai_builder", "n_matched"), "ai_rate": F.try_divide(users, F.col("n_matched"))}
    )


def null_thin_rates(signal: DataFrame, min_matched: int = 5) -> DataFrame:
    """Rates on fewer than ``min_matched`` postings become null; an unknown count leaves the rate."""
    thin = F.coalesce(F.col("n_matched") < min_matched, F.lit(False))
    return signal.withColumn("builder_rate", F.when(~thin, F.col("builder_rate")))


def top_by_builders(signal: DataFrame, n: int = 10) -> DataFrame:
    return signal.orderBy(F.desc("n_ai_builder"), "ticker", "snapshot").limit(n)


def test_retest(signal: DataFrame, first: str, second: str, min_matched: int = 5) -> DataFrame:
    """Rank correlation of the builder rate across two snapshots, entities well covered in both."""
    enough = signal.where(F.col("n_matched") >= min_matched)

    def side(snapshot: str, name: str) -> DataFrame:
        return enough.where(F.col("snapshot") == snapshot).select("ticker", F.col("builder_rate").alias(name))

    return spearman(side(first, "x").join(side(second, "y"), "ticker"), [])


test_retest.__test__ = False  # an operator, not a test


def movers(signal: DataFrame, first: str, second: str, min_matched: int = 5) -> DataFrame:
    """Change of an entity's percentile rank within its snapshot."""
    rows = signal.where((F.col("n_matched") >= min_matched) & F.col("snapshot").isin(first, second))
    ranked = add_percentile_rank(rows.select("ticker", "snapshot", "builder_rate"), "builder_rate", "rk", by=["snapshot"])
    wide = ranked.groupBy("ticker").agg(
        F.max(F.when(F.col("snapshot") == first, F.col("rk"))).alias("rank_before"),
        F.max(F.when(F.col("snapshot") == second, F.col("rk"))).alias("rank_after"),
    )
    return wide.where("rank_before IS NOT NULL AND rank_after IS NOT NULL").withColumn("shift", F.col("rank_after") - F.col("rank_before"))


def rerun_stability(first: DataFrame, second: DataFrame, key: str, score: str) -> DataFrame:
    """Exact and within-one agreement and rank correlation of two runs."""
    both = first.select(key, F.col(score).alias("x")).join(second.select(key, F.col(score).alias("y")), key)
    gap = F.abs(F.col("x") - F.col("y"))
    shares = both.agg(
        F.count(gap).alias("n"), F.avg((gap == 0).cast("double")).alias("exact"), F.avg((gap <= 1).cast("double")).alias("within_one")
    )
    rho = spearman(both, []).select("ic").scalar()
    return shares.withColumn("rank_correlation", rho)


def classifier_agreement(pairs: DataFrame, negative: str = "non-ai") -> DataFrame:
    """Agreement of (truth, prediction) among matched rows: 4-class, binary, precision and recall."""
    matched = F.coalesce(F.col("company_match"), F.lit(False))
    # An unknown label is not the negative class.
    truth, pred = F.coalesce(F.col("truth") != negative, F.lit(True)), F.coalesce(F.col("prediction") != negative, F.lit(True))
    same = F.coalesce(F.col("truth") == F.col("prediction"), F.lit(False))

    def share(flag: Column) -> Column:
        return F.avg(F.when(matched, flag.cast("double")))

    counts = pairs.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.avg(matched.cast("double")).alias("match_rate"),
        F.count_if(matched).alias("n"),
        share(same).alias("agreement"),
        share(truth == pred).alias("binary_agreement"),
        F.count_if(matched & truth & pred).alias("tp"),
        F.count_if(matched & ~truth & pred).alias("fp"),
        F.count_if(matched & truth & ~pred).alias("fn"),
    )
    tp = F.col("tp")
    return counts.withColumns(
        {"precision": tp / F.greatest(tp + F.col("fp"), F.lit(1)), "recall": tp / F.greatest(tp + F.col("fn"), F.lit(1))}
    )


def confusion_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    matched = pairs.where(F.col("company_match") & F.col("truth").isNotNull())
    return matched.groupBy("truth").pivot("prediction", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


# --- sampling ------------------------------------------------------------------------------------


def stratified_sample(df: DataFrame, id_col: str, bucket: str = "sampling_bucket", per_bucket: int = 25, seed: int = 0) -> DataFrame:
    """Up to ``per_bucket`` rows per bucket by a seeded hash of the id, weighted by available / sampled.

    The rank filter is applied before the shuffle too, so a hot bucket sends only its leaders.
    """
    if per_bucket < 0:
        raise ValueError("per_bucket is less than zero")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_available"))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy("_draw", id_col))
    picked = df.withColumn("_draw", draw).withColumn("_place", place).where(F.col("_place") <= per_bucket).drop("_draw", "_place")
    weight = F.col("_available") / F.least(F.col("_available"), F.lit(per_bucket))
    # sizes has one row per bucket present; buckets are a fixed list of four
    return picked.join(sizes, bucket).withColumns({"sample_weight": weight, "random_seed": F.lit(seed), "sampled_at": F.current_timestamp()}).drop("_available")


def weighted_share(sample: DataFrame, flag: str = "is_ai_keyword_matched", weight: str = "sample_weight") -> DataFrame:
    w = F.col(weight) if weight in sample.columns else F.lit(1.0)
    hit = F.coalesce(F.col(flag), F.lit(False)) if flag in sample.columns else F.col("sampling_bucket") == "ai_keyword_matched"
    return sample.agg(F.coalesce(F.try_divide(F.sum(F.when(hit, w).otherwise(0.0)), F.sum(w)), F.lit(0.0)).alias("weighted_share"))


def sample_summary(full: DataFrame, sample: DataFrame, flag: str = "is_ai_keyword_matched") -> DataFrame:
    """One row per sampled bucket with its share, beside the totals."""
    sample = materialize(sample)
    size = sample.agg(F.count(F.lit(1))).scalar()
    totals = full.agg(F.struct(F.count(F.lit(1)).alias("total_postings"), F.count_if(F.col(flag)).alias("ai_keyword_count"))).scalar()
    shares = sample.groupBy("sampling_bucket").agg(F.count(F.lit(1)).alias("sampled")).withColumn("_t", totals)
    return shares.withColumns(
        {"sample_share": F.col("sampled") / size, "sample_size": size, "weighted_ai_share": weighted_share(sample, flag).scalar()}
    ).select("*", "_t.*").drop("_t")


def stratified_pilot(df: DataFrame, score: str, sector: str, tie: str, bands: Sequence[tuple[str, Column]], per_band: int = 4) -> DataFrame:
    """Per score band up to ``per_band`` rows of distinct sectors, each sector's first by ``tie``."""
    band = F.lit(None).cast("string")
    for name, condition in reversed(bands):
        band = F.when(condition, name).otherwise(band)
    rows = df.withColumn("band", band).where(F.col("band").isNotNull())
    firsts = rows.withColumn("_s", F.row_number().over(Window.partitionBy("band", sector).orderBy(tie))).where(F.col("_s") == 1)
    place = F.row_number().over(Window.partitionBy("band").orderBy(tie))
    return firsts.withColumn("_p", place).where(F.col("_p") <= per_band).drop("_s", "_p")


# --- requests and replies ----------------------------------------------------------------------------


def result_line(title: Column, url: Column, snippet: Column) -> Column:
    """One result in a request: its number in the batch, title and address, and below them what its text says, if anything."""
    head = F.concat(F.lit("["), F.col("result_index").cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit(" <"), F.coalesce(url, F.lit("")), F.lit(">"))
    return F.concat(head, F.when(F.length(tx.strip(snippet)) > 0, F.concat(F.lit("\n    "), snippet)).otherwise(F.lit("")))


def request_batches(results: DataFrame, entity: str, order: str, header: Column, body: Column, size: int = 25) -> DataFrame:
    """Results of an entity in groups of ``size``, each rendered as one request text.

    ``body`` may use the 0-based ``result_index``.  Positions come from range-partitioned prefix sums, so
    an entity with many results is not numbered in one task; a group collects at most ``size`` rows.
    """
    placed = prefix_sums(results, [entity], [order], before="_position")
    placed = placed.withColumns({"batch": F.floor(F.col("_position") / size).cast("int"), "result_index": (F.col("_position") % size).cast("int")})
    lines = placed.select(entity, "batch", "result_index", header.alias("_header"), body.alias("_body"))
    grouped = lines.groupBy(entity, "batch").agg(
        F.first("_header").alias("_header"),
        F.transform(F.array_sort(F.collect_list(F.struct("result_index", "_body"))), lambda s: s["_body"]).alias("_bodies"),
    )
    text = F.concat(F.col("_header"), F.lit("\n\nRESULTS:\n"), F.array_join("_bodies", "\n"))
    return grouped.select(entity, "batch", F.size("_bodies").alias("results"), text.alias("request"))


_REPLY = (
    "array<struct<result_index:int,is_company_match:boolean,ai_role_type:string,seniority:string,"
    "ai_requirement_strength:string,confidence:double,evidence:string>>"
)


def _reply_items() -> Column:
    return F.from_json(tx.strip_code_fence(F.col("reply")), _REPLY)


def failed_replies(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batches whose reply is missing or no JSON, with the reason and the reply as it came."""
    reason = F.when(F.col("reply").isNull(), "no_reply").when(_reply_items().isNull(), "invalid_json")
    return replies.select(*keys, reason.alias("error"), "reply").where(F.col("error").isNotNull())


def parse_replies(replies: DataFrame, results: DataFrame, keys: Sequence[str], entity: Sequence[str] = ()) -> DataFrame:
    """Fenced JSON-array replies to classified results; indexes outside the batch are dropped.

    ``replies`` has the batch keys and ``reply``; ``results`` the same keys, ``result_index`` and the fields.
    With ``entity``, some of the keys, an entity has no results while one of its batches is among the
    ``failed_replies`` or has no reply row, so that no rate is computed on a part of them.
    """
    answers = replies.select(*keys, F.explode(_reply_items()).alias("_a")).select(*keys, "_a.*")
    if entity:
        unanswered = results.select(*keys).distinct().join(replies, keys, "left_anti").select(*entity)
        failed = failed_replies(replies, keys).select(*entity).unionByName(unanswered)
        answers = answers.join(failed, list(entity), "left_anti")
    joined = results.join(answers, [*keys, "result_index"])
    return joined.withColumns(
        {"is_company_match": F.coalesce("is_company_match", F.lit(False)), "ai_role_type": tx.role_type(F.col("ai_role_type"))}
    )
