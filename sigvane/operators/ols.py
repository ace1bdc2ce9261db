"""Least squares on sufficient statistics.

Rows are reduced once to cells: per (key, fixed-effect level) the count, means and co-moments of all
variables.  Every nested specification is solved from sums of cells, so a row is read twice whatever
the number of specifications: once for the cells and once for the leverage-corrected errors.
Fixed effects are absorbed by centring on the cell mean.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigvane import constants as K
from sigvane.functions import permute
from sigvane.functions.tails import t_critical, t_two_sided, z_pvalue
from sigvane.operators.ordering import (
    add_percentile_ranks,
    attach_by_key,
    average_rank_expr,
    exact_quantiles,
    null_safe_join,
    prefix_sums,
    value_ranks,
)
from sigvane.runtime import materialize


@dataclass(frozen=True)
class Spec:
    """A named regression of the outcome on ``regressors`` (the first one is reported)."""

    name: str
    regressors: tuple[str, ...]
    absorb: bool  # whether the group enters as fixed effects


LADDER = (
    Spec("1_univariate", ("x",), False),
    Spec("2_sector", ("x",), True),
    Spec("3_size", ("x", "log_mktcap"), True),
    Spec("4_full", ("x", "log_mktcap", "prior_rev_growth_yoy"), True),
)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return df.where(condition)


def _moments(variables: Sequence[str]) -> list[Column]:
    aggs = ["count(1) AS _n", *[f"avg({v}) AS _m_{v}" for v in variables]]
    aggs += [f"covar_pop({a}, {b}) AS _c_{a}_{b}" for a, b in _pairs(variables)]
    return [F.expr(a) for a in aggs]


def _pairs(variables: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(variables) for b in variables[i:]]


def _totals(cells: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Per key: rows, groups, means, and the within-group and total centred cross products.

    Cell means are centred on the key's mean before they are multiplied, so a large common offset costs no digits.
    """
    key = Window.partitionBy(*keys)  # a key has one row per fixed-effect level
    centre = {f"_d_{v}": F.col(f"_m_{v}") - F.sum(F.col("_n") * F.col(f"_m_{v}")).over(key) / F.sum("_n").over(key) for v in variables}
    aggs = ["sum(_n) AS n", "count(1) AS groups", *[f"sum(_n * _m_{v}) / sum(_n) AS _all_{v}" for v in variables]]
    for a, b in _pairs(variables):
        within = f"sum(_n * _c_{a}_{b})"
        between = f"sum(_n * _d_{a} * _d_{b}) - sum(_n * _d_{a}) * sum(_n * _d_{b}) / sum(_n)"
        aggs += [f"{within} AS _w_{a}_{b}", f"{within} + {between} AS _t_{a}_{b}"]
    return cells.withColumns(centre).groupBy(*keys).agg(*[F.expr(a) for a in aggs])


_SOLUTION = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_SOLUTION)
def _solve(gram: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Pseudo-inverse solution of one small normal-equation system per row."""
    betas, inverses = [], []
    for g, t in zip(gram, target, strict=True):
        k = len(t)
        matrix = np.asarray(g, dtype=float).reshape(k, k)
        if not np.isfinite(matrix).all():
            betas.append([None] * k)
            inverses.append([None] * (k * k))
            continue
        scale = np.sqrt(np.where(np.diag(matrix) > 0, np.diag(matrix), 1.0))
        inverse = np.linalg.pinv(matrix / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale)
        betas.append((inverse @ np.asarray(t, dtype=float)).tolist())
        inverses.append(inverse.ravel().tolist())
    return pd.DataFrame({"beta": betas, "inverse": inverses})


def _solve_specs(totals: DataFrame, specs: Sequence[Spec], variables: Sequence[str], y: str) -> DataFrame:
    order = {v: i for i, v in enumerate(variables)}

    def entry(side: str, a: str, b: str) -> str:
        first, second = sorted((a, b), key=order.__getitem__)
        return f"{side}{first}_{second}"

    solutions = {}
    for i, spec in enumerate(specs):
        side = "_w_" if spec.absorb else "_t_"
        gram = ", ".join(entry(side, a, b) for a in spec.regressors for b in spec.regressors)
        target = ", ".join(entry(side, a, y) for a in spec.regressors)
        solutions[f"_s{i}"] = _solve(F.expr(f"array({gram})"), F.expr(f"array({target})"))
    return totals.withColumns(solutions)


def _errors(rows: DataFrame, keys: Sequence[str], specs: Sequence[Spec], y: str) -> DataFrame:
    """Sums over rows of squared residuals and of the leverage-corrected influence on the first coefficient."""
    aggs = []
    for i, spec in enumerate(specs):
        mean, size = ("_m_", "_n") if spec.absorb else ("_all_", "n")
        x = [f"({v} - {mean}{v})" for v in spec.regressors]
        k = len(x)

        def inverse(j: int, m: int, i: int = i, k: int = k) -> str:
            return f"_s{i}.inverse[{j * k + m}]"

        residual = f"({y} - {mean}{y} - " + " - ".join(f"_s{i}.beta[{j}] * {x[j]}" for j in range(k)) + ")"
        influence = "(" + " + ".join(f"{inverse(0, j)} * {x[j]}" for j in range(k)) + ")"
        quadratic = " + ".join(f"{inverse(j, m)} * {x[j]} * {x[m]}" for j in range(k) for m in range(k))
        # A row alone in its group is fitted exactly and does not move the slopes.
        corrected = f"CASE WHEN {size} > 1 THEN try_divide({influence} * {residual}, 1 - 1D / {size} - ({quadratic})) ELSE 0D END"
        aggs += [F.expr(f"sum({residual} * {residual}) AS _rss{i}"), F.expr(f"sum(pow({corrected}, 2)) AS _var{i}")]
    return rows.groupBy(*keys).agg(*aggs)


def _report(solved: DataFrame, errors: DataFrame, keys: Sequence[str], specs: Sequence[Spec], y: str) -> DataFrame:
    joined = null_safe_join(solved, errors, keys)
    results = F.expr(
        "array("
        + ", ".join(
            f"named_struct('spec', '{spec.name}', 'n', n, 'coef', _s{i}.beta[0], 'se', sqrt(_var{i}), "
            f"'r2', 1 - try_divide(_rss{i}, _t_{y}_{y}))"
            for i, spec in enumerate(specs)
        )
        + ")"
    )
    flat = joined.select(*keys, F.explode(results).alias("_r")).select(*keys, "_r.*")
    flat = flat.withColumn("t", F.try_divide(F.col("coef"), F.col("se")))
    return flat.select(*keys, "spec", "n", "coef", "se", "t", z_pvalue("t").alias("p"), "r2")


def hc3_regressions(
    rows: DataFrame,
    keys: Sequence[str],
    group: str,
    y: str,
    specs: Sequence[Spec],
    min_rows: int = 0,
) -> DataFrame:
    """First coefficient of every spec per key with HC3 errors and normal tails.

    All specs share the rows complete in every variable of every spec and in ``group``.
    """
    keys = list(keys)
    variables = list(dict.fromkeys([v for s in specs for v in s.regressors] + [y]))
    rows = complete_rows(rows, [group, *variables]).select(*keys, group, *[F.col(v).cast("double").alias(v) for v in variables])
    cells = materialize(rows.groupBy(*keys, group).agg(*_moments(variables)))
    solved = materialize(_solve_specs(_totals(cells, keys, variables).where(F.col("n") >= min_rows), specs, variables, y))
    needed = ["n", *[f"_all_{v}" for v in variables], *[f"_s{i}" for i in range(len(specs))]]
    per_cell = null_safe_join(cells.select(*keys, group, "_n", *[f"_m_{v}" for v in variables]), solved.select(*keys, *needed), keys)
    enriched = attach_by_key(rows, per_cell, [*keys, group])
    return _report(solved, _errors(enriched.where(F.col("n").isNotNull()), keys, specs, y), keys, specs, y)


# --- cross-section -------------------------------------------------------------------------------


def winsorize(df: DataFrame, columns: Sequence[str], by: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip columns at their exact interpolated quantiles per ``by`` value; infinite becomes null.

    ``by`` is a sample tag: its few values are chosen by the caller, so the bounds are a few rows.
    """
    finite = df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in columns})
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns])
    long = finite.select(by, F.explode(cells).alias("_c")).select(by, "_c.*")
    bounds = exact_quantiles(long, [by, "_column"], "_value", {"_low": low, "_high": high})

    def at(c: str, side: str) -> Column:
        return F.max(F.when(F.col("_column") == c, F.col(side))).alias(f"{side}{c}")

    wide = bounds.groupBy(by).agg(*[at(c, side) for c in columns for side in ("_low", "_high")])
    joined = null_safe_join(finite, F.broadcast(wide), [by], "left")
    clipped = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_low{c}"), F.least(F.col(f"_high{c}"), F.col(c)))) for c in columns}
    return joined.withColumns(clipped).select(*df.columns)


def rank_signals(base: DataFrame, signals: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Rows (sample, signal, x, carried columns): ``x`` is the percentile rank of the signal in its sample.

    Written once, because a regression reads its rows twice.
    """
    cells = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])
    long = base.select(*carry, F.explode(cells).alias("_c")).select(*carry, "_c.*").where(F.col("value").isNotNull())
    ranks = value_ranks(long, ["sample", "signal"], "value")
    ranks = ranks.select("sample", "signal", "value", "count", (average_rank_expr() / F.col("total")).alias("x"))
    return materialize(attach_by_key(long, ranks, ["sample", "signal", "value"]).drop("count"))


def prepare_cross_section(table: DataFrame, exclude: Sequence[str] = (), samples: Sequence[str] = ("full",)) -> DataFrame:
    """The analysis table per sample: excluded tickers dropped first, then thin rates nulled, outcomes
    and momentum winsorized and size logged.  ``samples`` may hold ``full`` and ``excluded``.
    """
    tag = F.explode(F.array(*[F.lit(s) for s in samples])).alias("sample")
    rows = table.select(tag, "*")
    if exclude:
        rows = rows.where((F.col("sample") == "full") | ~F.col("ticker").isin(list(exclude)))
    # NULL < 5 is not true: a rate without a count stays.
    thin = F.coalesce(F.col("n_matched") < 5, F.lit(False))
    rows = rows.withColumn("builder_rate", F.when(~thin, F.col("builder_rate")))
    rows = winsorize(rows, [K.PRIMARY_OUTCOME, "op_margin_delta_yoy", "prior_rev_growth_yoy"], "sample")
    return rows.withColumn("log_mktcap", F.when(F.col("mktcap_t0") > 0, F.log("mktcap_t0")))


_CONTROLS = ["log_mktcap", "prior_rev_growth_yoy"]


def spec_ladder(
    base: DataFrame,
    signals: Sequence[str] = K.CROSS_SECTION_SIGNALS,
    primary: str = K.PRIMARY_OUTCOME,
    secondary: Sequence[str] = K.SECONDARY_OUTCOMES,
    sector: str = "sector",
    min_rows: int = 50,
) -> DataFrame:
    """Four nested HC3 regressions per signal on the primary outcome, the full one on the others."""
    outcomes = [primary, *secondary]
    ranked = rank_signals(base, signals, ["sample", sector, *outcomes, *_CONTROLS])
    cells = F.array(*[F.struct(F.lit(o).alias("dv"), F.col(o).alias("y")) for o in outcomes])
    rows = ranked.select("sample", "signal", sector, "x", *_CONTROLS, F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c")
    results = hc3_regressions(rows, ["sample", "signal", "dv"], sector, "y", LADDER, min_rows)
    return results.where((F.col("dv") == primary) | (F.col("spec") == "4_full"))


def add_fdr(results: DataFrame, q: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg flag over the full-spec rows of each sample, joined back on (signal, dv).

    There is one row per test, so ordering them in one task is cheap.
    """
    tests = results.where(F.col("spec") == "4_full")
    family = Window.partitionBy("sample")
    ranked = tests.withColumn("_i", F.row_number().over(family.orderBy("p", "signal", "dv"))).withColumn("_m", F.count("p").over(family))
    passing = F.max(F.when(F.col("p") <= F.col("_i") / F.col("_m") * q, F.col("_i"))).over(family)
    flags = ranked.withColumn("_cut", passing)
    flags = flags.select("sample", "signal", "dv", F.coalesce(F.col("_i") <= F.col("_cut"), F.lit(False)).alias("fdr_significant"))
    return results.join(flags, ["sample", "signal", "dv"], "left")


def pivot_ladder(results: DataFrame, primary: str = K.PRIMARY_OUTCOME) -> DataFrame:
    specs = [s.name for s in LADDER]
    wide = results.where(F.col("dv") == primary).groupBy("sample", "signal")
    return wide.pivot("spec", specs).agg(F.first("coef").alias("coef"), F.first("p").alias("p"))


def compare_samples(results: DataFrame) -> DataFrame:
    """Full against excluded sample for every full-spec test, with the verdict."""
    tests = results.where(F.col("spec") == "4_full")

    def side(sample: str) -> DataFrame:
        part = tests.where(F.col("sample") == sample)
        return part.select("signal", "dv", *[F.col(c).alias(f"{sample}_{c}") for c in ("coef", "p", "n")])

    both = side("full").join(side("excluded"), ["signal", "dv"])
    before, after = F.col("full_p") < 0.05, F.col("excluded_p") < 0.05
    verdict = F.when(before & after, "SURVIVES").when(before, "LOST significance").otherwise("n.s. either way")
    return both.withColumn("verdict", verdict)


def placement(base: DataFrame, tickers: Sequence[str], signal: str, outcome: str = K.PRIMARY_OUTCOME) -> DataFrame:
    """Where the named tickers sit: value and percentile rank of signal and outcome in the full sample."""
    rows = base.where(F.col("sample") == "full").select("ticker", signal, outcome)
    ranked = add_percentile_ranks(rows, [signal, outcome])
    return ranked.where(F.col("ticker").isin(list(tickers)))


def group_premium(base: DataFrame, category: str, versus: str | None = None, sector: str = "sector") -> DataFrame:
    """Return premium of one category with sector effects and size: against all others, or one category."""
    rows = base if versus is None else base.where(F.col("category").isin(category, versus))
    rows = rows.where(F.col("fwd_ret_4m").isNotNull())
    rows = rows.withColumn("is_group", F.coalesce((F.col("category") == category).cast("double"), F.lit(0.0)))
    spec = Spec("premium", ("is_group", "log_mktcap"), True)
    fit = hc3_regressions(rows, ["sample"], sector, "fwd_ret_4m", [spec])
    inside = F.col("category") == category
    means = rows.groupBy("sample").agg(
        F.count_if(inside).alias("n_group"),
        F.avg(F.when(inside, F.col("fwd_ret_4m"))).alias("group_mean"),
        F.avg(F.when(~inside, F.col("fwd_ret_4m"))).alias("other_mean"),
    )
    return means.join(fit.drop("spec"), "sample", "left")


def within_category(base: DataFrame, signal: str = "conc", min_rows: int = 20) -> DataFrame:
    """Size- and momentum-controlled regression inside every category; ranks are of the whole sample."""
    rows = rank_signals(base, [signal], ["sample", "category", K.PRIMARY_OUTCOME, *_CONTROLS])
    rows = rows.where(F.col("category").isNotNull())
    spec = Spec("within", ("x", *_CONTROLS), False)
    return hc3_regressions(rows, ["sample", "category"], "signal", K.PRIMARY_OUTCOME, [spec], min_rows)


def complete_case(base: DataFrame, signals: Sequence[str], report: Sequence[str], sector: str = "sector") -> DataFrame:
    """Full spec on rows where every signal, the outcome and the controls are known."""
    # A rank is known exactly where its signal is, so completeness is a property of the row.
    whole = F.expr(" AND ".join(f"{s} IS NOT NULL" for s in signals))
    flagged = base.withColumn("_whole", whole)
    rows = rank_signals(flagged, report, ["sample", sector, K.PRIMARY_OUTCOME, *_CONTROLS, "_whole"]).where("_whole")
    return hc3_regressions(rows, ["sample", "signal"], sector, K.PRIMARY_OUTCOME, [LADDER[3]])


def placebo(base: DataFrame, sector: str = "sector") -> DataFrame:
    """Full spec with the rank of the company name's length as the signal."""
    named = base.withColumn("namelen", F.length(F.coalesce(F.col("company_name"), F.lit(""))))
    rows = rank_signals(named, ["namelen"], ["sample", sector, K.PRIMARY_OUTCOME, *_CONTROLS])
    return hc3_regressions(rows, ["sample", "signal"], sector, K.PRIMARY_OUTCOME, [LADDER[3]])


def leave_one_out(base: DataFrame, signal: str = "conc", sector: str = "sector") -> DataFrame:
    """Full spec without each sector in turn; ranks are not recomputed.

    Cross products are those of all sectors minus the one left out.  For the errors every row is
    evaluated against each other sector's solution and summed map-side.
    """
    y, spec = K.PRIMARY_OUTCOME, LADDER[3]
    variables = [*spec.regressors, y]
    ranked = rank_signals(base, [signal], ["sample", sector, y, *_CONTROLS])
    rows = complete_rows(ranked, [sector, *variables]).select("sample", F.col(sector).alias("_g"), *variables)
    cells = materialize(rows.groupBy("sample", "_g").agg(*_moments(variables)))
    whole = _totals(cells, ["sample"], variables)
    without = {
        f"_w_{a}_{b}": F.col(f"_w_{a}_{b}") - F.col("_n") * F.col(f"_c_{a}_{b}") for a, b in _pairs(variables)
    }
    reduced = null_safe_join(cells, whole, ["sample"]).withColumns(without).withColumn("n", F.col("n") - F.col("_n"))
    reduced = reduced.select("sample", F.col("_g").alias("left_out"), "n", *without, F.lit(None).cast("double").alias(f"_t_{y}_{y}"))
    solved = materialize(_solve_specs(reduced, [spec], variables, y))
    # One array per sample, as long as there are sectors.
    fits = solved.groupBy("sample").agg(F.collect_list(F.struct("left_out", "n", "_s0")).alias("_fits"))
    per_cell = null_safe_join(cells.select("sample", "_g", "_n", *[f"_m_{v}" for v in variables]), fits, ["sample"])
    enriched = attach_by_key(rows, per_cell, ["sample", "_g"])
    others = F.filter("_fits", lambda f: f["left_out"] != F.col("_g"))
    each = enriched.select("sample", *variables, "_n", *[f"_m_{v}" for v in variables], F.explode(others).alias("_f"))
    each = each.select("*", "_f.*").drop("_f")
    return _report(solved, _errors(each, ["sample", "left_out"], [spec], y), ["sample", "left_out"], [spec], y).drop("r2")


def summarize_leave_one_out(runs: DataFrame) -> DataFrame:
    """The sector whose absence weakens the result most, and how many runs stay significant."""
    return runs.groupBy("sample").agg(
        F.max_by("left_out", F.struct("p", "left_out")).alias("worst_sector"),
        F.max_by("coef", F.struct("p", "left_out")).alias("worst_coef"),
        F.max("p").alias("worst_p"),
        F.count_if(F.col("p") < 0.05).alias("n_significant"),
        F.count(F.lit(1)).alias("n_sectors"),
    )


def permutation_test(
    base: DataFrame,
    id_col: str,
    signal: str = "conc",
    n_perm: int = 1000,
    seed: int = 12345,
    sector: str = "sector",
) -> DataFrame:
    """Two-sided permutation p-value of the full-spec coefficient, per sample.

    By Frisch-Waugh a replicate needs only sums of the shuffled signal against the outcome residual
    and the centred controls.  The row whose signal a row gets is computed (``functions.permute``), so no replicate is
    sorted: the signals of rows times replicates are shuffled once, in blocks, to meet their rows.
    """
    y, spec = K.PRIMARY_OUTCOME, LADDER[3]
    variables = [*spec.regressors, y]
    ranked = rank_signals(base, [signal], ["sample", id_col, sector, y, *_CONTROLS])
    rows = complete_rows(ranked, [sector, *variables]).select("sample", id_col, F.col(sector).alias("_g"), *variables)
    cells = materialize(rows.groupBy("sample", "_g").agg(*_moments(variables)))
    controls = Spec("controls", tuple(_CONTROLS), True)
    totals = _totals(cells, ["sample"], variables)
    solved = materialize(_solve_specs(totals, [spec, controls], variables, y))
    per_cell = null_safe_join(
        cells.select("sample", "_g", "_n", *[f"_m_{v}" for v in variables]),
        solved.select("sample", F.col("n").cast("long").alias("_rows"), F.col("_s1.beta").alias("_b")),
        ["sample"],
    )
    enriched = attach_by_key(rows, per_cell, ["sample", "_g"])
    z = [F.col(c) - F.col(f"_m_{c}") for c in _CONTROLS]
    residual = F.col(y) - F.col(f"_m_{y}") - F.col("_b")[0] * z[0] - F.col("_b")[1] * z[1]
    fixed = enriched.select(
        "sample", id_col, "_g", "_rows", F.col("x").alias("_x"), residual.alias("_r"), z[0].alias("_z1"), z[1].alias("_z2")
    )
    fixed = prefix_sums(fixed, ["sample"], [id_col], before="_slot")
    by_group = permute.shuffled_sums(fixed, "sample", "_slot", "_rows", "_x", ["_r", "_z1", "_z2"], "_g", n_perm, seed)
    within = F.col("_squares") - F.col("_sum") * F.col("_sum") / F.col("_n")
    sums = by_group.groupBy("sample", "_rep").agg(
        F.sum("_by__r").alias("_xr"), F.sum("_by__z1").alias("_x1"), F.sum("_by__z2").alias("_x2"), F.sum(within).alias("_xx")
    )
    inverse = F.col("_s1.inverse")
    solved = solved.select("sample", "n", F.col("_s0.beta")[0].alias("obs_coef"), inverse.alias("_i"))
    fits = null_safe_join(sums, solved, ["sample"])
    explained = (
        F.col("_i")[0] * F.col("_x1") * F.col("_x1") + 2 * F.col("_i")[1] * F.col("_x1") * F.col("_x2") + F.col("_i")[3] * F.col("_x2") * F.col("_x2")
    )
    coef = F.try_divide(F.col("_xr"), F.col("_xx") - explained)
    return fits.groupBy("sample").agg(
        F.max("n").alias("n"),
        F.max("obs_coef").alias("obs_coef"),
        F.lit(n_perm).alias("n_perm"),
        F.count_if(F.abs(coef) >= F.abs("obs_coef")).alias("n_ge"),
        ((F.count_if(F.abs(coef) >= F.abs("obs_coef")) + 1) / F.lit(n_perm + 1.0)).alias("p"),
    )


# --- pooled panel regressions ---------------------------------------------------------------------

_TERM_SCHEMA = (
    "signal string, outcome string, term string, coefficient double, std_error double, t_stat double, p_value double, "
    "conf_low double, conf_high double, nobs long, r_squared double, warning string"
)


def _fit_cells(controls: list[str], min_obs: int):
    """A solver for the cells of one (signal, outcome): one row per (sector, quarter), never data rows."""
    variables = ["x", *controls, "y"]

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        signal, outcome = cells["signal"].iloc[0], cells["outcome"].iloc[0]
        cells = cells[cells["_n"] > 0]
        n = int(cells["_n"].sum())

        def warn(text: str) -> pd.DataFrame:
            row = dict.fromkeys(c.split()[0] for c in _TERM_SCHEMA.split(", "))
            row |= {"signal": signal, "outcome": outcome, "nobs": n, "warning": text}
            return pd.DataFrame([row], dtype=object)

        if n < min_obs:
            return warn(f"{n} rows are fewer than the {min_obs} asked for")
        weight = cells["_n"].to_numpy(float)
        names, dummies = ["Intercept"], [np.ones(len(cells))]
        for column, label in (("_fe1", "sector"), ("_fe2", "quarter")):
            for level in sorted(cells[column].unique())[1:]:
                names.append(f"C({label})[T.{level}]")
                dummies.append((cells[column] == level).to_numpy(float))
        d = np.column_stack(dummies)
        names += [signal, *controls]
        if n <= len(names):
            return warn(
                f"{n} rows cannot settle {len(names)} coefficients"
            )
        means = cells[[f"_m_{v}" for v in variables]].to_numpy(float)
        grand = weight @ means / n
        means = means - grand
        k = len(variables)
        moments = (means * weight[:, None]).T @ means
        for i, a in enumerate(variables):
            for j in range(i, k):
                within = float(weight @ cells[f"_c_{a}_{variables[j]}"].to_numpy(float))
                moments[i, j] += within
                if i != j:
                    moments[j, i] += within
        dd, dv = d.T @ (d * weight[:, None]), d.T @ (means * weight[:, None])
        p = d.shape[1]
        gram = np.block([[dd, dv[:, :-1]], [dv[:, :-1].T, moments[:-1, :-1]]])
        target = np.concatenate([dv[:, -1], moments[:-1, -1]])
        scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
        scaled = gram / np.outer(scale, scale)
        inverse = np.linalg.pinv(scaled, rcond=1e-12, hermitian=True) / np.outer(scale, scale)
        beta = inverse @ target
        total = moments[-1, -1]
        rss = max(total - float(beta @ target), 0.0)
        df = n - int(np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True))
        covariance = inverse * rss / df
        # Undo the centring: it moved only the intercept.
        back = np.eye(len(beta))
        back[0, p:] = -grand[:-1]
        covariance = back @ covariance @ back.T
        beta = back @ beta
        beta[0] += grand[-1]
        error = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / error
        reach = t_critical(df) * error
        table = pd.DataFrame(
            {
                "signal": signal, "outcome": outcome, "term": names, "coefficient": beta, "std_error": error, "t_stat": t,
                "p_value": [t_two_sided(v, df) for v in t], "conf_low": beta - reach, "conf_high": beta + reach,
                "nobs": n, "r_squared": 1 - rss / total if total > 0 else None, "warning": None,
            }
        )
        return table.astype({c: object for c in ("signal", "outcome", "term", "warning")})

    return fit


def pooled_regressions(
    panel: DataFrame,
    signals: Sequence[str],
    outcomes: Sequence[str],
    controls: Sequence[str] | None = None,
    sector_effects: bool = True,
    quarter_effects: bool = True,
    min_obs: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Coefficient table (every term, t inference) and warnings table for all signals x outcomes.

    An empty control list means the defaults.  A group handed to the solver holds one row per
    (sector, quarter), so its size is that of the fixed effects, not of the data.
    """
    controls = [c for c in (controls or K.DEFAULT_CONTROLS) if c in panel.columns]
    quarter = "quarter" if "quarter" in panel.columns else "score_quarter"
    fe1 = F.col("sector") if sector_effects and "sector" in panel.columns else F.lit("")
    fe2 = F.col(quarter) if quarter_effects and quarter in panel.columns else F.lit("")
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("signal"), F.lit(o).alias("outcome"), F.col(s).cast("double").alias("x"), F.col(o).cast("double").alias("y"))
            for s in signals if s in panel.columns
            for o in outcomes if o in panel.columns
        ]
    )
    long = panel.select(
        fe1.alias("_fe1"), fe2.alias("_fe2"), *[F.col(c).cast("double").alias(c) for c in controls], F.explode(pairs).alias("_p")
    ).select("_fe1", "_fe2", *controls, "_p.*")
    usable = F.lit(True)
    for c in ["_fe1", "_fe2", "x", "y", *controls]:
        usable = usable & F.col(c).isNotNull()
    variables = ["x", *controls, "y"]
    # Incomplete rows stay as empty cells so a pair without any usable row still gets its warning.
    masked = long.withColumns({v: F.when(usable, F.col(v)) for v in variables}).withColumn("_ok", usable)
    aggs = [F.count_if("_ok").alias("_n"), *_moments(variables)[1:]]
    cells = masked.groupBy("signal", "outcome", "_fe1", "_fe2").agg(*aggs)
    fitted = cells.groupBy("signal", "outcome").applyInPandas(_fit_cells(controls, min_obs), _TERM_SCHEMA)
    formula = F.concat(F.col("outcome"), F.lit(" ~ "), F.concat_ws(" + ", F.col("signal"), *[F.lit(c) for c in controls]))
    for on, column, label in ((sector_effects, "sector", "C(sector)"), (quarter_effects, quarter, f"C({quarter})")):
        if on and column in panel.columns:
            several = panel.agg((F.min(column) < F.max(column)).alias("several")).scalar()
            formula = F.concat(formula, F.when(several, F.lit(f" + {label}")).otherwise(F.lit("")))
    fitted = fitted.withColumn("formula", formula)
    table = fitted.where(F.col("warning").isNull()).drop("warning")
    warnings = fitted.where(F.col("warning").isNotNull()).select("signal", "outcome", "warning", "nobs", "formula")
    return table, warnings


def baseline_regression(panel: DataFrame, signal: str, outcome: str, **options: object) -> DataFrame:
    """One pooled regression on at least five rows; raises with the warning when it cannot be fitted."""
    table, warnings = pooled_regressions(panel, [signal], [outcome], min_obs=5, **options)
    problem = warnings.select("warning").first()
    if problem is not None:
        raise ValueError(problem["warning"])
    return table
