"""Every reported number of a cross-section, for all samples at once, as one long table.

The regressions (ladder, group premia, within categories, complete cases, placebo) are problems of one long table of
(sample, block, key, group, y, regressors): its rows are read once into cells of mergeable moments, which all
specifications of all problems share, and once for the robust errors.  A problem without fixed effects has one group; one
without momentum has a constant in its place, which the reported specification leaves out.  Signals and the
placebo are ranked in one pass for all samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.operators import ic, ols, summaries
from sigvane.operators.ordering import add_quantile_label

SCHEMA = ["sample", "block", "key", "statistic", "value"]
COVERAGE = [*K.CROSS_SECTION_SIGNALS, "log_mktcap"]
SIZE, MOMENTUM = "log_mktcap", "prior_rev_growth_yoy"


def long_form(df: DataFrame, block: Column, key: Column, statistics: Sequence[str]) -> DataFrame:
    """One row per statistic; those of ``df`` are columns."""
    cells = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in statistics])
    return df.select("sample", block.alias("block"), key.cast("string").alias("key"), F.explode(cells).alias("_c")).select("sample", "block", "key", "_c.*")


def _problem(block: str, key: Column, group: Column, y: Column, momentum: Column, applies: Column) -> Column:
    return F.when(
        applies, F.struct(F.lit(block).alias("block"), key.alias("key"), group.alias("group"), y.cast("double").alias("y"), momentum.cast("double").alias(MOMENTUM))
    )


def _ranked_problems(base: DataFrame, signals: Sequence[str], reported: Sequence[str], single: str, sector: str) -> DataFrame:
    """(sample, block, key, group, y, x, size, momentum) of every regression on the rank of a signal."""
    outcomes = [K.PRIMARY_OUTCOME, *K.SECONDARY_OUTCOMES]
    whole = F.expr(" AND ".join(f"{s} IS NOT NULL" for s in signals))
    flagged = base.withColumns({"_whole": whole, "_name_length": F.length(F.coalesce(F.col("company_name"), F.lit("")))})
    ranked = ols.rank_signals(flagged, [*signals, "_name_length"], ["sample", sector, "category", *outcomes, SIZE, MOMENTUM, "_whole"])
    signal, primary = F.col("signal"), F.col(K.PRIMARY_OUTCOME)
    of_signal = signal != "_name_length"
    problems = [_problem("ladder", F.concat_ws("/", signal, F.lit(o)), F.col(sector), F.col(o), F.col(MOMENTUM), of_signal) for o in outcomes]
    problems += [
        _problem("complete_case", signal, F.col(sector), primary, F.col(MOMENTUM), F.col("_whole") & signal.isin(list(reported))),
        _problem("within_category", F.col("category"), F.lit("all"), primary, F.col(MOMENTUM), (signal == single) & F.col("category").isNotNull()),
        _problem("placebo", F.lit("name length"), F.col(sector), primary, F.col(MOMENTUM), ~of_signal),
    ]
    exploded = ranked.select("sample", "x", SIZE, F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("_p"))
    return exploded.select("sample", "_p.block", "_p.key", "_p.group", "_p.y", "x", SIZE, f"_p.{MOMENTUM}")


def _premium_problems(base: DataFrame, category: str, versus: str, sector: str) -> DataFrame:
    """The same columns for the return premium of a category over all others and over one other."""
    known = base.where(F.col("fwd_ret_4m").isNotNull())
    x = F.coalesce((F.col("category") == category).cast("double"), F.lit(0.0))
    problems = [
        _problem("premium", F.lit("all others"), F.col(sector), F.col("fwd_ret_4m"), F.lit(0.0), F.lit(True)),
        _problem("premium", F.lit(versus), F.col(sector), F.col("fwd_ret_4m"), F.lit(0.0), F.col("category").isin(category, versus)),
    ]
    exploded = known.select("sample", x.alias("x"), SIZE, F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("_p"))
    return exploded.select("sample", "_p.block", "_p.key", "_p.group", "_p.y", "x", SIZE, f"_p.{MOMENTUM}")


def regressions(base: DataFrame, signals: Sequence[str], reported: Sequence[str], single: str, category: str, versus: str, sector: str = "sector") -> DataFrame:
    """(sample, block, key, n, coef, se, p): all regressions from one table of cells."""
    rows = _ranked_problems(base, signals, reported, single, sector).unionByName(_premium_problems(base, category, versus, sector))
    fits = ols.hc3_regressions(rows, ["sample", "block", "key"], "group", "y", ols.LADDER)
    ladder = (F.col("block") == "ladder") & (F.col("n") >= 50) & ((F.col("spec") == "4_full") | F.col("key").endswith("/" + K.PRIMARY_OUTCOME))
    within = (F.col("block") == "within_category") & (F.col("n") >= 20) & (F.col("spec") == "4_full")
    premium = (F.col("block") == "premium") & (F.col("spec") == "3_size")
    single_spec = F.col("block").isin("complete_case", "placebo") & (F.col("spec") == "4_full")
    key = F.when(F.col("block") == "ladder", F.concat_ws("/", "key", "spec")).otherwise(F.col("key"))
    return fits.where(ladder | within | premium | single_spec).withColumn("key", key)


def correlations(base: DataFrame, signals: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """(sample, key, n, rho, p): rank correlation of every signal and outcome."""
    pairs = ic.unpivot_pairs(base, ["sample"], signals, outcomes)
    found = ic.spearman(pairs, ["sample", "signal", "outcome"], min_obs=10)
    return found.select("sample", F.concat_ws("/", "signal", "outcome").alias("key"), F.col("n_obs").alias("n"), F.col("ic").alias("rho"), ic.correlation_pvalue("ic", "n_obs").alias("p"))


def quantile_means(base: DataFrame, score: str, value: str, ties: Sequence[str], bins: int = 5) -> DataFrame:
    """(sample, quantile, mean, n) of ``value`` on the rows that know both."""
    rows = base.where(F.col(score).isNotNull() & F.col(value).isNotNull()).select("sample", score, value, *ties)
    labelled = add_quantile_label(rows, score, ties, ["sample"], bins, "quantile")
    return summaries.mean_by(labelled, ["sample", "quantile"], value)


def all_numbers(
    base: DataFrame,
    company: str,
    signals: Sequence[str] = K.CROSS_SECTION_SIGNALS,
    reported: Sequence[str] = ("conc", "inv", "adoption_score", "maturity_index", "builder_rate"),
    single: str = "conc",
    score: str = "maturity_index",
    category: str = K.CATEGORIES[0],
    versus: str = K.CATEGORIES[3],
    n_perm: int = 1000,
    sector: str = "sector",
) -> DataFrame:
    """(sample, block, key, statistic, value) of the prepared cross-section ``base``, whose samples are rows of one table."""
    primary = K.PRIMARY_OUTCOME
    outcomes = [primary, "op_margin_delta_yoy", "fwd_ret_4m"]
    fits = regressions(base, signals, reported, single, category, versus, sector)
    left_out = ols.leave_one_out(base, single, sector)
    worst = ols.summarize_leave_one_out(left_out)
    shuffled = ols.permutation_test(base, company, n_perm=n_perm)
    counts = base.groupBy("sample").agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in dict.fromkeys([*COVERAGE, *outcomes, MOMENTUM])])
    bins = summaries.mean_by(base, ["sample", single], primary)
    spread = summaries.high_minus_low(base, single, primary, by=["sample"])
    blocks = [
        long_form(fits, F.col("block"), F.col("key"), ["n", "coef", "se", "p"]),
        long_form(left_out, F.lit("leave_one_out"), F.col("left_out"), ["n", "coef", "se", "p"]),
        long_form(worst, F.lit("leave_one_out_summary"), F.col("worst_sector"), ["worst_coef", "worst_p", "n_significant", "n_sectors"]),
        long_form(shuffled, F.lit("permutation"), F.lit(single), ["n", "obs_coef", "p", "n_perm", "n_ge"]),
        long_form(correlations(base, signals, outcomes), F.lit("rank_correlation"), F.col("key"), ["n", "rho", "p"]),
        long_form(bins, F.lit("score_bins"), F.col(single).cast("int"), ["mean", "n"]),
        long_form(spread, F.lit("high_minus_low"), F.lit(single), ["diff", "t", "n_hi", "n_lo"]),
        long_form(summaries.mean_by(base, ["sample", "category"], "fwd_ret_4m"), F.lit("category_return"), F.col("category"), ["mean", "n"]),
        long_form(counts, F.lit("coverage"), F.lit("rows"), [c for c in counts.columns if c != "sample"]),
    ]
    for value in (primary, "fwd_ret_4m"):
        key = F.concat_ws("/", F.lit(value), F.col("quantile").cast("string"))
        blocks.append(long_form(quantile_means(base, score, value, [company]), F.lit("quantile_means"), key, ["mean", "n"]))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out.select(*SCHEMA)
