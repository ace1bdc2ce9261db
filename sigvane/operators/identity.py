"""Identifier joins, mapping reports and name-based entity resolution."""

from __future__ import annotations

import difflib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigvane import constants as K
from sigvane.functions import text as tx
from sigvane.operators import quality as q
from sigvane.operators.ordering import attach_by_key
from sigvane.runtime import materialize, written


def _normalized(df: DataFrame, key: str) -> DataFrame:
    clean = tx.normalize_ticker if key == "ticker" else tx.clean_text
    return df.withColumn(key, clean(F.col(key)))


def key_cardinality(left: DataFrame, right: DataFrame, key: str) -> str:
    """``one_to_one``, ``many_to_one``, ``one_to_many`` or ``many_to_many``, nulls equal each other."""
    many = [not q.duplicate_keys(side, [key]).isEmpty() for side in (left, right)]
    return {(False, False): "one_to_one", (True, False): "many_to_one", (False, True): "one_to_many"}.get(tuple(many), "many_to_many")


def join_on_key(left: DataFrame, right: DataFrame, key: str, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Join on a cleaned identifier; refuses a key that repeats on both sides."""
    q.require_columns(left, [key], "left dataset")
    q.require_columns(right, [key], "right dataset")
    left, right = _normalized(left, key), _normalized(right, key)
    if key_cardinality(left, right, key) == "many_to_many":
        raise ValueError(f"{key} repeats on both sides of the join")
    clashes = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clashes), key, how)


def join_on_company_id(left: DataFrame, right: DataFrame, how: str = "left", suffix: str = "_right") -> DataFrame:
    return join_on_key(left, right, "company_id", how, suffix)


def join_on_ticker(left: DataFrame, right: DataFrame, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Fallback join; every result row says that the identifier was the ticker."""
    return join_on_key(left, right, "ticker", how, suffix).withColumn(
        "join_warning", F.lit("joined on ticker; prefer company_id and audit unmatched rows")
    )


def mapping_violations(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Ids that map to another ticker, unknown ids, and tickers that cannot be mapped where an id is missing."""
    master = companies.select(F.col("company_id").alias("_id"), F.col("ticker").alias("_ticker"))
    frames = []
    if "company_id" in df.columns:
        ids = df.select("company_id", *[c for c in ("ticker",) if c in df.columns]).where(F.col("company_id").isNotNull()).distinct()
        known = ids.join(master, F.col("company_id") == F.col("_id"), "left")
        checks = [q.Check("unknown_company_id", F.col("_id").isNull(), F.col("company_id"))]
        if "ticker" in df.columns:
            checks.append(q.Check("conflicting_mapping", F.col("ticker") != F.col("_ticker"), F.concat_ws(" vs ", "ticker", "_ticker")))
        frames.append(q.row_violations(known, checks, F.col("company_id")))
    if "ticker" in df.columns:
        rows = df if "company_id" not in df.columns else df.where(F.col("company_id").isNull())
        unmapped = rows.select("ticker").distinct().join(master, F.col("ticker") == F.col("_ticker"), "left_anti")
        frames.append(q.row_violations(unmapped, [q.Check("unmapped_ticker", F.lit(True), F.col("ticker"))], F.col("ticker")))
    return q.union_violations(frames)


def attach_company_id(df: DataFrame, companies: DataFrame, strict: bool = True) -> DataFrame:
    """Keep complete ids; when any id is missing all rows are mapped again by ticker."""
    q.require_any_column(df, ("company_id", "ticker"), "dataset")
    out = df
    for key in ("company_id", "ticker"):
        if key in out.columns:
            out = _normalized(out, key)
    if strict:
        q.raise_on(mapping_violations(out, companies), "unable to map to company_id")
    if "ticker" not in out.columns:
        return out
    lookup = companies.select("ticker", F.col("company_id").alias("_mapped"))
    sizes = out.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.count(F.lit(1)).alias("_rows"))
    mapped = attach_by_key(out, sizes.join(lookup, "ticker"), ["ticker"], unmatched=["ticker"]).drop("_rows")
    if "company_id" not in df.columns:
        return mapped.withColumnRenamed("_mapped", "company_id")
    complete = out.agg(F.coalesce(F.min(F.col("company_id").isNotNull()), F.lit(True)).alias("complete")).scalar()
    return mapped.withColumn("company_id", F.when(complete, F.col("company_id")).otherwise(F.col("_mapped"))).drop("_mapped").select(*out.columns)


def unmatched_rows(companies: DataFrame, datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (dataset, ticker, unmatched_rows) whose id or ticker is present but unknown, one per ticker."""
    ids = companies.select(F.col("company_id").alias("_id"), F.lit(True).alias("_id_known")).where(F.col("_id").isNotNull()).distinct()
    tickers = companies.select(F.col("ticker").alias("_ticker"), F.lit(True).alias("_ticker_known")).where(F.col("_ticker").isNotNull()).distinct()
    reports = []
    for name, data in datasets.items():
        rows, bad, ticker = data, F.lit(False), F.lit(None).cast("string")
        counted = data.groupBy(*[c for c in ("company_id", "ticker") if c in data.columns]).agg(F.count(F.lit(1)).alias("_rows"))
        rows = counted
        if "company_id" in data.columns:
            rows = rows.withColumn("_i", tx.clean_text(F.col("company_id"))).join(ids, F.col("_i") == F.col("_id"), "left")
            bad = bad | (F.col("_i").isNotNull() & F.col("_id_known").isNull())
        if "ticker" in data.columns:
            ticker = F.col("_t")
            rows = rows.withColumn("_t", tx.normalize_ticker(F.col("ticker"))).join(tickers, ticker == F.col("_ticker"), "left")
            bad = bad | (ticker.isNotNull() & F.col("_ticker_known").isNull())
        reports.append(rows.where(bad).groupBy(F.lit(name).alias("dataset"), ticker.alias("ticker")).agg(F.sum("_rows").alias("unmatched_rows")))
    return q.union_violations(reports)


def master_report(companies: DataFrame) -> DataFrame:
    """Missing ids, tickers and sectors, and duplicate identifiers, of a raw master."""

    def missing(name: str) -> Column:
        return F.count_if(tx.is_missing(F.col(name))) if name in companies.columns else F.count(F.lit(1))

    counts = companies.agg(*[missing(c).alias(f"missing_{c}") for c in ("company_id", "ticker", "sector")])
    ids = q.duplicate_keys(_normalized(companies, "company_id"), ["company_id"], True).agg(F.count(F.lit(1))).scalar()
    tickers = q.duplicate_keys(_normalized(companies, "ticker"), ["ticker"], True).agg(F.count(F.lit(1))).scalar()
    return counts.withColumns({"duplicate_company_ids": ids, "duplicate_tickers": tickers, "duplicate_mapping": ids + tickers})


# --- fuzzy names ---------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def similarity(candidate: pd.Series, word: pd.Series) -> pd.Series:
    """Matching-block ratio of the candidate against the word."""
    matcher = difflib.SequenceMatcher()
    scores = []
    for a, b in zip(candidate, word, strict=True):
        matcher.set_seqs(a, b)
        scores.append(matcher.ratio())
    return pd.Series(scores, dtype=float)


SPARE_PIECES = (0, 1, 2, 4)
RARE_PIECE = 16  # names that may share a piece before other cuts are tried
_START = "CAST(i * (n div k) + greatest(0, i - (k - n % k)) AS INT)"
_WIDTH = "CAST(n div k + CASE WHEN i >= k - n % k THEN 1 ELSE 0 END AS INT)"


def _edits(length: str, cutoff: float) -> str:
    """SQL for the edits that a string of ``length`` must survive.

    A pair with ratio r has at least r (a + b) / 2 characters in common, so it differs by at most
    (1 - r)(a + b) insertions and deletions, and its longer side by at most (2 - r) / r times the shorter.
    """
    longest = f"floor({length} * {(2 - cutoff) / cutoff!r}D + 1e-9D)"
    return f"CAST(floor(({length} + {longest}) * {1 - cutoff!r}D + 1e-9D) AS INT)"


def _cut(names: DataFrame) -> DataFrame:
    """Rows (name, n, d, k, i, piece) of names that are to be cut into ``k`` pieces."""
    pieces = names.selectExpr("name", "n", "d", "k", "explode(sequence(0, k - 1)) AS i")
    return pieces.selectExpr("name", "n", "d", "k", "i", f"substring(name, {_START} + 1, {_WIDTH}) AS piece")


def name_pieces(names: DataFrame, cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """Rows (name, n, k, j, i, piece): the pieces to look each name up by, complete for the cutoff.

    Of d + 1 + s pieces, d edits leave s + 1 unchanged, so any d + 1 of them find every partner; ``j`` numbers those taken.
    A name whose d + 1 plain pieces are all rare (``RARE_PIECE``) is looked up by these.  Other names are cut in
    several ways (``SPARE_PIECES`` for s), each keeps its d + 1 rarest pieces, and the way whose commonest piece is rarest
    is taken: a word that many names share is then in the spare pieces, and nobody is looked up by it.
    """
    sized = names.selectExpr("name", "length(name) AS n").where("n > 0").selectExpr("name", "n", f"{_edits('n', cutoff)} AS d")
    plain = _cut(sized.selectExpr("*", "least(d + 1, n) AS k"))
    place = ["n", "k", "i", "piece"]
    common = written(plain.groupBy(*place).agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > RARE_PIECE).select(*place), "common_pieces")
    crowded = written(plain.join(common, place, "left_semi").select("name").distinct(), "crowded_names")
    cut = sized.join(crowded, "name", "left_semi").selectExpr("name", "n", "d", f"explode(array({', '.join(f'd + {1 + s}' for s in SPARE_PIECES)})) AS k")
    pieces = _cut(cut.where("k <= n OR k = d + 1").selectExpr("name", "n", "d", "least(k, n) AS k"))
    often = pieces.groupBy(*place).agg(F.count(F.lit(1)).alias("often"))
    counted = attach_by_key(pieces, often, place).repartition("name")
    ways = counted.groupBy("name", "n", "d", "k").agg(F.array_sort(F.collect_list(F.struct("often", "i", "piece"))).alias("rarest"))
    ways = ways.selectExpr("name", "n", "k", "slice(rarest, 1, d + 1) AS rarest").selectExpr("*", "element_at(rarest, -1).often AS commonest")
    best = ways.groupBy("name", "n").agg(F.min_by(F.struct("k", "rarest"), F.struct("commonest", "k")).alias("way"))
    best = best.selectExpr("name", "n", "way.k AS k", "posexplode(array_sort(transform(way.rarest, x -> struct(x.i AS i, x.piece AS piece)))) AS (j, taken)")
    alone = plain.join(crowded, "name", "left_anti").selectExpr("name", "n", "k", "i AS j", "i", "piece")
    return alone.unionByName(best.selectExpr("name", "n", "k", "j", "taken.i AS i", "taken.piece AS piece"))


def _proposals(words: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (word, name) with a piece of the name where edits may have left it; a pair may come more than once.

    A shortest way from a name to a word takes t insertions and deletions at most, with t as odd or even as the lengths'
    difference.  Let piece j be the first of those taken with no more than j edits up to its end: it is unchanged and has
    exactly j edits before it and t - j at most behind it.  So it moved by -j, -j + 2, ... or j places, and
    what is left of the lengths' difference is within t - j.
    """
    pieces = written(name_pieces(names, cutoff), "name_pieces")
    low, high = cutoff / (2 - cutoff), (2 - cutoff) / cutoff
    probes = words.selectExpr("word", "length(word) AS m").where("m > 0")
    probes = probes.selectExpr(
        "word", "m", f"explode(sequence(greatest(1, CAST(ceil(m * {low!r}D - 1e-9D) AS INT)), CAST(floor(m * {high!r}D + 1e-9D) AS INT))) AS n"
    )
    used = pieces.select("n", "k").distinct()  # a few rows per length of a name
    probes = probes.join(F.broadcast(used), "n").selectExpr("*", f"{_edits('n', cutoff)} AS d", f"CAST(floor((m + n) * {1 - cutoff!r}D + 1e-9D) AS INT) AS t")
    probes = probes.selectExpr("word", "m", "n", "d", "k", "m - n AS more", "t - abs(t - m + n) % 2 AS t").where("t >= abs(more)")
    probes = probes.selectExpr("*", "explode(sequence(0, k - 1)) AS i").selectExpr("*", f"{_START} AS p", f"{_WIDTH} AS w").where("m >= w")
    # Before piece i there are i others, of which all but the k - d - 1 spare ones are taken.
    probes = probes.selectExpr("*", "greatest(0, i - greatest(0, k - d - 1)) AS j0", "CASE WHEN k > d THEN least(i, t) ELSE i END AS j1").where("j0 <= j1")
    probes = probes.selectExpr("*", "explode(sequence(j0, j1)) AS j")
    # A name too short for d + 1 pieces has one a character, and each may have moved anywhere.
    probes = probes.selectExpr("*", "CASE WHEN k > d THEN greatest(-j, more - t + j) ELSE -d END AS lo", "CASE WHEN k > d THEN least(j, more + t - j) ELSE d END AS hi")
    probes = probes.where("lo <= hi").selectExpr("word", "m", "n", "k", "j", "i", "p", "w", "explode(sequence(lo, hi, CASE WHEN k > d THEN 2 ELSE 1 END)) AS moved")
    probes = probes.where("p + moved BETWEEN 0 AND m - w").selectExpr("word", "n", "k", "j", "i", "substring(word, p + moved + 1, w) AS piece")
    return probes.join(pieces, ["n", "k", "j", "i", "piece"]).select("word", "name")


def fuzzy_pairs(words: DataFrame, names: DataFrame, cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """Pairs (word, name) that share a piece of the name at a compatible place."""
    return _proposals(words, names, cutoff).distinct()


def fuzzy_candidates(words: DataFrame, names: DataFrame, cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """The pairs of ``fuzzy_pairs`` whose edit distance the cutoff allows; complete for it.

    Pairs are judged where they are found, so only those within the distance are shuffled.
    """
    # The edit distance is at most the number of insertions and deletions the ratio allows.
    allowed = f"CAST(floor((length(word) + length(name)) * {1 - cutoff!r}D + 1e-9D) AS INT)"
    return _proposals(words, names, cutoff).where(f"levenshtein(word, name, {allowed}) >= 0").distinct()


def fuzzy_match(words: DataFrame, names: DataFrame, cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """Best name per word with similarity at least ``cutoff``; the largest text wins a tie.

    ``words`` and ``names`` are distinct texts in columns ``word`` and ``name``.
    """
    scored = fuzzy_candidates(words, names, cutoff).withColumn("score", similarity("name", "word"))
    best = scored.where(F.col("score") >= cutoff).groupBy("word").agg(F.max(F.struct("score", "name")).alias("_b"))
    return best.select("word", F.col("_b.name").alias("name"), F.col("_b.score").alias("score"))


# --- entity resolution ----------------------------------------------------------------------------


def first_per_name(registry: DataFrame, name: str, order: str, columns: list[str]) -> DataFrame:
    """One row per normalized name: the first in source order."""
    keyed = registry.withColumn("norm", tx.name_key(F.col(name)))
    first = F.min(F.struct(order, *columns)).alias("_f")
    return keyed.groupBy("norm").agg(first).select("norm", *[F.col(f"_f.{c}").alias(c) for c in columns])


def _literal_map(spark, pairs: Mapping[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()) or [], f"{key} string, {value} string")


def resolve_entities(
    entities: DataFrame,
    members: DataFrame,
    registry: DataFrame,
    private: Mapping[str, str],
    manual: Mapping[str, str],
    cutoff: float = K.FUZZY_CUTOFF,
    labels: tuple[str, str] = ("member", "registry"),
) -> DataFrame:
    """Match entities to tickers: private list, manual map, exact member, exact registry, fuzzy member,
    fuzzy registry, unmatched.

    ``entities`` has (company_id, name, sector); ``members`` (member_name, ticker, cik, gics_sector, ord);
    ``registry`` (title, ticker, cik, ord).  ``labels`` name the two lists in ``match_method``.
    """
    first, second = labels
    spark = entities.sparkSession
    keyed = entities.withColumn("norm", tx.name_key(F.col("name")))
    # Both name lists are read by the exact and the fuzzy steps.
    a = materialize(first_per_name(members, "member_name", "ord", ["ticker", "cik", "gics_sector"]))
    b = materialize(first_per_name(registry, "title", "ord", ["ticker", "cik"]))
    a_exact = a.selectExpr("norm", "ticker AS a_ticker", "cik AS a_cik", "gics_sector AS a_sector")
    b_exact = b.selectExpr("norm", "ticker AS b_ticker", "cik AS b_cik")

    # Both lists are literals of the caller, so their joined rows are as few.
    listed = _literal_map(spark, private, "name", "private_as")
    chosen = _literal_map(spark, manual, "name", "manual_ticker")
    wanted = list(manual.values())
    by_ticker_a = members.where(F.col("ticker").isin(wanted)).groupBy(F.col("ticker").alias("manual_ticker")).agg(
        F.min(F.struct("ord", "cik", "gics_sector")).alias("ma")
    )
    by_ticker_b = registry.where(F.col("ticker").isin(wanted)).groupBy(F.col("ticker").alias("manual_ticker")).agg(F.min(F.struct("ord", "cik")).alias("mb"))
    chosen = chosen.join(by_ticker_a, "manual_ticker", "left").join(by_ticker_b, "manual_ticker", "left")
    rows = keyed.join(F.broadcast(listed), "name", "left").join(F.broadcast(chosen), "name", "left")
    rows = materialize(rows.join(a_exact, "norm", "left").join(b_exact, "norm", "left"))

    open_words = rows.where("private_as IS NULL AND manual_ticker IS NULL AND a_ticker IS NULL AND b_ticker IS NULL")
    words = open_words.select(F.col("norm").alias("word")).distinct()
    # The tickers are joined to the few matches, not to the entities, whose unmatched rows have no key.  The matches are
    # written, because later steps read the result more than once.
    fuzzy_a = fuzzy_match(words, a.select(F.col("norm").alias("name")), cutoff).selectExpr("word AS norm", "name AS fa")
    fuzzy_a = written(fuzzy_a.join(a.selectExpr("norm AS fa", "ticker AS fa_ticker", "cik AS fa_cik", "gics_sector AS fa_sector"), "fa"), "fuzzy_first")
    fuzzy_b = fuzzy_match(words, b.select(F.col("norm").alias("name")), cutoff).selectExpr("word AS norm", "name AS fb")
    fuzzy_b = written(fuzzy_b.join(b.selectExpr("norm AS fb", "ticker AS fb_ticker", "cik AS fb_cik"), "fb"), "fuzzy_second")
    rows = rows.join(fuzzy_a, "norm", "left").join(fuzzy_b, "norm", "left")

    def pick(private_v: str, manual_v: str, a_v: str, b_v: str, fa_v: str, fb_v: str, other: str) -> Column:
        return F.expr(
            f"CASE WHEN private_as IS NOT NULL THEN {private_v} WHEN manual_ticker IS NOT NULL THEN {manual_v} "
            f"WHEN a_ticker IS NOT NULL THEN {a_v} WHEN b_ticker IS NOT NULL THEN {b_v} "
            f"WHEN fa IS NOT NULL THEN {fa_v} WHEN fb IS NOT NULL THEN {fb_v} ELSE {other} END"
        )

    nothing = "CAST(NULL AS STRING)"
    return rows.select(
        "company_id",
        "name",
        "sector",
        F.lit(True).alias("in_coverage"),
        pick(nothing, "manual_ticker", "a_ticker", "b_ticker", "fa_ticker", "fb_ticker", nothing).alias("ticker"),
        pick(nothing, "coalesce(ma.cik, mb.cik)", "a_cik", "b_cik", "fa_cik", "fb_cik", nothing).alias("cik"),
        pick(nothing, "ma.gics_sector", "a_sector", nothing, "fa_sector", nothing, nothing).alias("gics_sector"),
        pick("false", "ma IS NOT NULL", "true", "false", "true", "false", "false").alias("in_members"),
        pick(
            "concat('private:', private_as)", "'manual'", f"'{first}_exact'", f"'{second}_exact'",
            f"concat('{first}_fuzzy:', fa)", f"concat('{second}_fuzzy:', fb)", "'unmatched'",
        ).alias("match_method"),
    )


def add_uncovered_members(resolved: DataFrame, members: DataFrame, label: str = "member") -> DataFrame:
    """Members whose ticker no entity took, appended as fill-in rows."""
    taken = resolved.select("ticker").where(F.col("ticker").isNotNull())
    fill = members.join(taken, "ticker", "left_anti")
    return resolved.unionByName(
        fill.select(
            F.lit(None).cast("string").alias("company_id"), F.col("member_name").alias("name"), F.lit(None).cast("string").alias("sector"),
            F.lit(False).alias("in_coverage"), "ticker", "cik", "gics_sector", F.lit(True).alias("in_members"),
            F.lit(f"{label}_fill_in").alias("match_method"),
        )
    )


def flag_universe_duplicates(universe: DataFrame, order: str = "name") -> DataFrame:
    """``ticker_dup``: the ticker occurs more than once.  ``share_class_dup``: not the preferred row of its
    cik (covered entities first, then ``order``).
    """
    tickers = universe.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.count(F.lit(1)).alias("_same_ticker"))
    place = F.struct((~F.col("in_coverage")).alias("late"), F.col(order).alias("o"), F.coalesce("company_id", F.lit("")).alias("i"), F.coalesce("ticker", F.lit("")).alias("t"))
    ciks = universe.where(F.col("cik").isNotNull()).groupBy("cik").agg(F.min(place).alias("_preferred"), F.count(F.lit(1)).alias("_same_cik"))
    rows = attach_by_key(universe, tickers, ["ticker"], unmatched=["ticker"])
    rows = attach_by_key(rows, ciks, ["cik"], unmatched=["cik"])
    return rows.withColumns(
        {"ticker_dup": F.coalesce(F.col("_same_ticker") > 1, F.lit(False)), "share_class_dup": F.coalesce(place != F.col("_preferred"), F.lit(False))}
    ).drop("_same_ticker", "_preferred", "_same_cik")


def match_method_counts(universe: DataFrame) -> DataFrame:
    method = F.split("match_method", ":")[0]
    return universe.groupBy(method.alias("match_method")).agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("in_coverage") & F.col("in_members")).alias("covered_members")
    )
