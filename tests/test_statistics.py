import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions import permute, tails
from sigvane.operators import backtest, ic, ols, ordering, robustness, summaries


def values(spark, xs, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(xs)], f"id int, {name} double")


def test_percentile_rank_with_ties_and_null(spark):
    ranked = ordering.add_percentile_rank(values(spark, [1.0, 2.0, 2.0, None, 5.0]), "x", "rk")
    assert [r["rk"] for r in rows(ranked, "id")] == [0.25, 0.625, 0.625, None, 1.0]


@pytest.mark.parametrize("merge_ranges", ["true", "false"])
def test_hot_values_give_the_same_ranks(spark, merge_ranges):
    """One value holds most rows, and a third of the rows is null."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge_ranges)
    random.seed(5)
    xs = [random.choice([1.0] * 12 + [2.0, 3.5] + [None] * 7) for _ in range(900)]
    known = sorted(x for x in xs if x is not None)
    got = rows(ordering.add_percentile_rank(values(spark, xs), "x", "rk"), "id")
    for x, r in zip(xs, got, strict=True):
        expected = None if x is None else (known.index(x) + (known.count(x) + 1) / 2) / len(known)
        assert r["rk"] == (None if expected is None else pytest.approx(expected))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("merge_ranges", ["true", "false"])
def test_prefix_sums_against_brute_force(spark, merge_ranges):
    random.seed(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge_ranges)
    data = [(random.choice(["a", "b", None]), i, random.randint(1, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "g string, i int, w int")
    for r in rows(ordering.prefix_sums(df, ["g"], ["i"], weight="w")):
        group = [(i, w) for g, i, w in data if g == r["g"]]
        assert r["before"] == sum(w for i, w in group if i < r["i"])
        assert r["total"] == sum(w for _, w in group)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantile_sizes(spark):
    df = values(spark, [float(i) for i in range(12)])
    labels = [r["signal_quantile"] for r in rows(ordering.add_quantile_label(df, "x", ["id"]), "id")]
    assert [labels.count(q) for q in range(1, 6)] == [3, 2, 2, 2, 3]
    few = ordering.add_quantile_label(values(spark, [1.0, 2.0, 3.0]), "x", ["id"])
    assert {r["signal_quantile"] for r in rows(few)} == {None}


def test_exact_quantiles_interpolate(spark):
    xs = [float(v) for v in [9, 1, 4, 4, 30, 2]]
    got = rows(ordering.exact_quantiles(values(spark, xs), [], "x", {"a": 0.1, "b": 0.5, "c": 0.99}))[0]
    assert [got["a"], got["b"], got["c"]] == pytest.approx(list(np.quantile(xs, [0.1, 0.5, 0.99])))


@pytest.mark.parametrize(("most", "bins"), [(65_536, 4096), (3, 4), (1, 64)])
def test_selected_values_equal_a_sort(spark, monkeypatch, most, bins):
    """Groups of every shape: one hot, a null key, close neighbours, wide spans, both signs, NaN and infinite values."""
    monkeypatch.setattr(ordering, "SELECTION_ROWS", most)
    monkeypatch.setattr(ordering, "SELECTION_BINS", bins)
    random.seed(3)
    near = [1.0 + random.randint(0, 40) * 2.0**-52 for _ in range(90)]
    groups = {
        "hot": [random.gauss(0, 100) for _ in range(400)],
        None: [random.choice([0.0, -0.0, 5e-324, -5e-324, 1.0]) for _ in range(40)],
        "near": near,
        "wide": [random.choice([-1, 1]) * 10.0 ** random.randint(-300, 300) for _ in range(60)],
        "ends": [math.inf, -math.inf, math.nan, 1.7e308, -1.7e308, 0.0],
        "one": [7.0],
        "same": [2.5] * 30,
    }
    data = [(g, x) for g, xs in groups.items() for x in [*xs, None]] + [("nothing", None)]
    random.shuffle(data)
    df = spark.createDataFrame(data, "g string, x double")

    def places(total):
        return [F.floor(total / 4), total - 1, F.lit(0)]

    got = rows(ordering.selected_values(df, ["g"], "x", places))
    assert {r["g"] for r in got} == set(groups)
    for g, xs in groups.items():
        known = sorted(xs, key=lambda x: (math.isnan(x), x))
        mine = [r for r in got if r["g"] == g]
        assert {str(r["x"] + 0.0) for r in mine} == {str(known[p] + 0.0) for p in (len(xs) // 4, len(xs) - 1, 0)}
        for r in mine:
            same = [i for i, x in enumerate(known) if x == r["x"] or (math.isnan(x) and math.isnan(r["x"]))]
            assert (r["before"], r["count"], r["total"]) == (same[0], len(same), len(xs))


def test_quantiles_of_no_rows(spark):
    empty = values(spark, []).withColumn("g", F.lit("a"))
    assert rows(ordering.exact_quantiles(empty, ["g"], "x", {"m": 0.5})) == []
    assert rows(ordering.exact_quantiles(empty, ["g"], "x", {"m": 0.5}, stored=True)) == []


def test_winsorize(spark):
    xs = [float(v) for v in range(1, 102)] + [math.inf, -math.inf]
    df = values(spark, xs).selectExpr("'full' AS sample", "id", "x")
    got = [r["x"] for r in rows(ols.winsorize(df, ["x"], "sample"), "id")]
    assert got[-2:] == [None, None]
    assert got[0] == 2.0 and got[100] == 100.0 and got[50] == 51.0


def test_ic_and_summary(spark):
    data = [(q, float(s), s / 100) for q in ("2025Q1", "2025Q2") for s in range(1, 6)]
    panel = spark.createDataFrame(data, f"quarter string, {K.COMPOSITE} double, fwd_return_1q double")
    got = rows(ic.ic_by_quarter(panel), "quarter")
    assert [r["ic"] for r in got] == [1.0, 1.0]
    summary = rows(ic.summarize_ic(ic.ic_by_quarter(panel)))[0]
    assert (summary["positive_ic_hit_rate"], summary["total_observations"], summary["ic_t_stat"]) == (1.0, 10, None)
    holed = spark.createDataFrame([("q", float(i), None if i < 3 else 1.0) for i in range(5)], f"quarter string, {K.COMPOSITE} double, fwd_return_1q double")
    thin = rows(ic.ic_by_quarter(holed))[0]
    assert (thin["n_obs"], thin["status"], thin["ic"]) == (2, "too_few_obs", None)
    flat = holed.na.fill(1.0)
    assert rows(ic.ic_by_quarter(flat))[0]["status"] == "constant_input"


def panel_for_backtest(spark, size):
    data = [(f"e{i}", q, float(i), i / d) for q, d in (("2025Q1", 100), ("2025Q2", 200)) for i in range(size)]
    return spark.createDataFrame(data, "company_id string, quarter string, s double, r double")


def test_backtest(spark):
    result = backtest.run_quantile_backtest(panel_for_backtest(spark, 10), "s", ["company_id"], "r")
    first = rows(result.long_short, "quarter")[0]
    assert (first["long_return"], first["short_return"], first["long_short_return"]) == pytest.approx((0.085, 0.005, 0.08))
    assert {r["n"] for r in rows(result.quantile_returns)} == {2}
    metrics = rows(result.metrics)[0]
    assert metrics["number_of_rebalances"] == 2
    assert metrics["cumulative_return"] == pytest.approx(1.08 * 1.04 - 1)
    assert metrics["max_drawdown"] == 0.0


def test_backtest_small_and_constant(spark):
    small = backtest.run_quantile_backtest(panel_for_backtest(spark, 4), "s", ["company_id"], "r")
    assert small.quantile_returns.isEmpty() and small.long_short.isEmpty()
    assert "not enough observations" in rows(small.warnings)[0]["warning"]
    flat = spark.createDataFrame([(f"q{i}", 0.02) for i in range(3)], "quarter string, long_short_return double")
    metrics = rows(backtest.backtest_metrics(flat))[0]
    assert metrics["volatility"] == pytest.approx(0.0, abs=1e-12) and metrics["sharpe_ratio"] is None


def test_missing_edge_quantile_gives_no_rows(spark):
    returns = spark.createDataFrame([("q", 1, 0.1), ("q", 4, 0.2)], "quarter string, signal_quantile int, mean_return double")
    assert backtest.long_short_returns(returns).isEmpty()


def test_drawdown(spark):
    path = spark.createDataFrame([("a", 0.5), ("b", -0.5), ("c", 0.1)], "quarter string, long_short_return double")
    assert rows(backtest.backtest_metrics(path))[0]["max_drawdown"] == pytest.approx(-0.5)


def robustness_panel(spark):
    data = [("a", "Tech", "q", 1.0, 0.1), ("b", "Tech", "q", 2.0, 0.2), ("c", "Tech", "q", 3.0, 0.1), ("d", "Tech", "q", 4.0, 0.5), ("e", "Retail", "q", None, 0.2), ("f", "Retail", "q", 5.0, 0.1)]
    return spark.createDataFrame(data, f"company_id string, sector string, score_quarter string, {K.COMPOSITE} double, fwd_return_1q double")


def test_robustness(spark):
    panel = robustness_panel(spark)
    neutral = {r["sector"]: r for r in rows(robustness.sector_neutral_ic(panel))}
    assert neutral["Retail"]["status"] == "insufficient_observations"
    assert neutral["Tech"]["raw_ic"] is not None
    assert neutral["Tech"]["sector_neutral_ic"] == neutral["Tech"]["sector_ic"]
    lag = {r["outcome"]: r for r in rows(robustness.lag_sensitivity(panel))}
    assert lag["fwd_return_4q"]["status"] == "unavailable"
    assert lag["fwd_return_1q"]["interpretation"] == "near_term_candidate"
    assert rows(robustness.size_bucket_analysis(panel, ["company_id"]))[0]["status"] == "market_cap_unavailable"
    suite = robustness.robustness_suite(panel, ["company_id"])
    assert {r["diagnostic"] for r in rows(robustness.diagnostic_counts(suite))} >= {"sector_neutral_ic", "lag_sensitivity", "llm_extraction_reliability"}


def test_missing_rate(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "value double")
    assert rows(robustness.missing_rates(df, ["value"]))[0]["missing_rate"] == 0.5
    no_groups = robustness.missingness_diagnostics(spark.createDataFrame([(1.0,)], f"{K.COMPOSITE} double"))
    assert {r["status"] for r in rows(no_groups)} == {"ok", "sector_unavailable", "score_quarter_unavailable"}


def test_tails():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.t_critical(10) == pytest.approx(2.228138852, abs=1e-7)
    assert tails.z_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)


# --- regressions ----------------------------------------------------------------------------------


def hc3_by_dummies(y, x, groups):
    """Brute force: full dummy matrix, pseudo-inverse, leverage-corrected sandwich."""
    levels = sorted(set(groups))
    matrix = np.column_stack([np.ones(len(y)), x, *[[g == level for g in groups] for level in levels[1:]]]).astype(float)
    inverse = np.linalg.pinv(matrix.T @ matrix)
    beta = inverse @ matrix.T @ y
    e = y - matrix @ beta
    h = np.einsum("ij,jk,ik->i", matrix, inverse, matrix)
    meat = (matrix * ((e / (1 - h)) ** 2)[:, None]).T @ matrix
    return beta[1], math.sqrt((inverse @ meat @ inverse)[1, 1])


def test_demeaned_hc3_equals_dummies(spark):
    rng = np.random.default_rng(3)
    n = 200
    g = [f"g{i}" for i in rng.integers(0, 6, n)]
    x, c1, c2 = rng.normal(size=n), rng.normal(5, 2, n), rng.normal(size=n)
    y = 0.3 * x + 0.1 * c1 + rng.normal(size=n) * (1 + abs(x))
    data = [(gi, float(a), float(b), float(c), float(d)) for gi, a, b, c, d in zip(g, x, c1, c2, y, strict=True)]
    df = spark.createDataFrame(data, "g string, x double, c1 double, c2 double, y double")
    got = rows(
        ols.hc3_regressions(df.selectExpr("'k' AS k", "*"), ["k"], "g", "y", [ols.Spec("full", ("x", "c1", "c2"), True), ols.Spec("plain", ("x",), False)]), "spec"
    )
    coef, se = hc3_by_dummies(y, np.column_stack([x, c1, c2]), g)
    assert (got[0]["coef"], got[0]["se"]) == pytest.approx((coef, se))
    coef, se = hc3_by_dummies(y, x[:, None], ["one"] * n)
    assert (got[1]["coef"], got[1]["se"]) == pytest.approx((coef, se))


def test_singleton_group_keeps_a_finite_error(spark):
    data = [("k", "a", 1.0, 1.0), ("k", "a", 2.0, 2.5), ("k", "a", 3.0, 2.0), ("k", "b", 9.0, 4.0)]
    df = spark.createDataFrame(data, "k string, g string, x double, y double")
    got = rows(ols.hc3_regressions(df, ["k"], "g", "y", [ols.Spec("s", ("x",), True)]))[0]
    assert got["n"] == 4 and got["coef"] == pytest.approx(0.5) and math.isfinite(got["se"])


def test_fdr(spark):
    tests = spark.createDataFrame([("full", f"s{i}", "y", "4_full", p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5])], "sample string, signal string, dv string, spec string, p double")
    assert [r["fdr_significant"] for r in rows(ols.add_fdr(tests), "signal")] == [True, True, True, False]
    none = tests.selectExpr("sample", "signal", "dv", "spec", "0.9D AS p")
    assert {r["fdr_significant"] for r in rows(ols.add_fdr(none))} == {False}


def regression_panel(spark, per_quarter):
    data = []
    for q in ("2025Q1", "2025Q2"):
        for i in range(per_quarter):
            s = float(i + 1)
            data.append((f"e{i}", "Tech" if i % 2 else "Retail", q, s, 0.02 + 0.01 * s, 0.01 * s, 0.02 * s, 0.03 * s, 5.0 + s))
    return spark.createDataFrame(
        data,
        f"company_id string, sector string, quarter string, {K.COMPOSITE} double, fwd_return_1q double, prior_return_1q double, "
        "revenue_growth_qoq double, operating_margin_t double, log_market_cap double",
    )


def test_pooled_regression_with_collinear_controls(spark):
    table = ols.baseline_regression(regression_panel(spark, 8), K.COMPOSITE, "fwd_return_1q")
    found = {r["term"]: r for r in rows(table)}
    assert found[K.COMPOSITE]["coefficient"] > 0
    assert len(table.columns) == 12 and "C(quarter)[T.2025Q2]" in found
    assert found["Intercept"]["formula"].endswith("C(sector) + C(quarter)")


def test_pooled_regression_warnings(spark):
    table, warnings = ols.pooled_regressions(regression_panel(spark, 2), [K.COMPOSITE], ["fwd_return_1q"])
    assert table.isEmpty()
    assert rows(warnings)[0]["warning"] == "4 rows are fewer than the 10 asked for"
    with pytest.raises(ValueError, match="fewer than the 5 asked for"):
        ols.baseline_regression(regression_panel(spark, 2), K.COMPOSITE, "fwd_return_1q")


def test_pooled_regression_against_brute_force(spark):
    rng = np.random.default_rng(0)
    n = 60
    sector, quarter = rng.integers(0, 3, n), rng.integers(0, 4, n)
    x, c = rng.normal(size=n), rng.normal(50, 3, n)
    y = 1 + 0.5 * x - 0.2 * c + 0.3 * sector + rng.normal(size=n)
    data = [(f"s{a}", f"q{b}", float(p), float(q), float(r)) for a, b, p, q, r in zip(sector, quarter, x, c, y, strict=True)]
    df = spark.createDataFrame(data, "sector string, quarter string, sig double, ctrl double, out double")
    table, _ = ols.pooled_regressions(df, ["sig"], ["out"], ["ctrl"])
    got = {r["term"]: r for r in rows(table)}
    dummies = [sector == k for k in (1, 2)] + [quarter == k for k in (1, 2, 3)]
    matrix = np.column_stack([np.ones(n), *dummies, x, c]).astype(float)
    beta, *_ = np.linalg.lstsq(matrix, y, rcond=None)
    residual = y - matrix @ beta
    cov = np.linalg.inv(matrix.T @ matrix) * (residual @ residual) / (n - matrix.shape[1])
    names = ["Intercept", "C(sector)[T.s1]", "C(sector)[T.s2]", "C(quarter)[T.q1]", "C(quarter)[T.q2]", "C(quarter)[T.q3]", "sig", "ctrl"]
    for i, name in enumerate(names):
        assert got[name]["coefficient"] == pytest.approx(beta[i], rel=1e-8)
        assert got[name]["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-8)
        assert got[name]["conf_high"] - got[name]["conf_low"] == pytest.approx(2 * tails.t_critical(n - 8) * math.sqrt(cov[i, i]), rel=1e-6)


def cross_section(spark, effect, n=90):
    rng = np.random.default_rng(11)
    data = []
    for i in range(n):
        conc = float(rng.integers(1, 6))
        data.append(("full", f"t{i}", f"s{i % 4}", conc, float(effect * conc + rng.normal()), float(rng.normal(8, 1)), float(rng.normal())))
    return spark.createDataFrame(data, "sample string, ticker string, sector string, conc double, rev_growth_yoy double, log_mktcap double, prior_rev_growth_yoy double")


def test_permuted_places_are_a_bijection_and_spread_evenly(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 7, 64, 101)], "n long")
    slots = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"))
    both = slots.select("*", F.explode(F.sequence(F.lit(1), F.lit(200))).alias("rep"))
    got = {}
    for r in both.select("n", "x", "rep", permute.permuted(F.col("x"), F.col("n"), F.col("rep"), 7).alias("to")).collect():
        got.setdefault((r["n"], r["rep"]), {})[r["x"]] = r["to"]
    assert len(got) == 6 * 200
    assert all(sorted(places.values()) == list(range(n)) for (n, _), places in got.items())
    orders = {tuple(got[3, rep][x] for x in range(3)) for rep in range(1, 201)}
    assert len(orders) == 6  # all of them
    ends = np.array([[got[64, rep][x] for x in range(64)] for rep in range(1, 201)])
    where = np.array([np.bincount(ends[:, x] // 16, minlength=4) for x in range(64)])
    assert abs(where / 200 - 0.25).max() < 0.16  # five standard errors
    assert abs(np.corrcoef(np.arange(64 * 200) % 64, ends.ravel())[0, 1]) < 0.05
    neighbours = ((ends[:, 1:] - ends[:, :-1]) % 64 == 1).mean()
    assert neighbours == pytest.approx(1 / 63, abs=0.006)
    assert len({tuple(got[64, rep][x] for x in range(64)) for rep in range(1, 201)}) == 200


def test_shuffled_sums_of_several_blocks(spark):
    rng = np.random.default_rng(5)
    sizes, replicates = {"a": 37, "b": 8, "c": 1}, 7
    data = [(s, i, n, float(rng.normal()), float(rng.normal()), f"g{rng.integers(3)}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "sample string, slot long, size long, x double, w double, g string").repartition(5)
    got = permute.shuffled_sums(df, "sample", "slot", "size", "x", ["w"], "g", replicates, 7, block=8, at_once=3).collect()
    want = {}
    for sample, n in sizes.items():
        part = [r for r in data if r[0] == sample]
        for rep in range(1, replicates + 1):
            to = permute.walked(np.arange(n), n, permute.round_keys(7, rep))
            for r in part:
                x = part[to[r[1]]][3]
                want.setdefault((sample, rep, r[5]), []).append((1, x, x * x, x * r[4]))
    assert len(got) == len(want)
    for r in got:
        assert (r["_n"], r["_sum"], r["_squares"], r["_by_w"]) == pytest.approx(tuple(np.sum(want[r["sample"], r["_rep"], r["g"]], axis=0)))


def test_permutation_draws_few_rows_by_many_tasks(spark):
    # By its size in bytes the table is one partition, with all replicates of all rows in its task.
    plan = ols.permutation_test(cross_section(spark, 1.0), "ticker", n_perm=60)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "_slot#" not in plan


def test_permutation_strong_and_null(spark):
    strong = rows(ols.permutation_test(cross_section(spark, 1.0), "ticker", n_perm=60))[0]
    null = rows(ols.permutation_test(cross_section(spark, 0.0), "ticker", n_perm=60))[0]
    assert strong["p"] == pytest.approx(1 / 61)
    assert null["p"] > 0.02
    assert strong["n_perm"] == 60


def test_leave_one_out_equals_refit(spark):
    base = cross_section(spark, 0.4)
    got = {r["left_out"]: r for r in rows(ols.leave_one_out(base))}
    assert set(got) == {"s0", "s1", "s2", "s3"}
    ranked = rows(ols.rank_signals(base, ["conc"], ["sample", "ticker", "sector", "rev_growth_yoy", "log_mktcap", "prior_rev_growth_yoy"]))
    part = [r for r in ranked if r["sector"] != "s2"]
    x = np.array([[r["x"], r["log_mktcap"], r["prior_rev_growth_yoy"]] for r in part])
    coef, se = hc3_by_dummies(np.array([r["rev_growth_yoy"] for r in part]), x, [r["sector"] for r in part])
    assert (got["s2"]["coef"], got["s2"]["se"], got["s2"]["n"]) == pytest.approx((coef, se, len(part)))


def test_high_minus_low(spark):
    df = spark.createDataFrame([(5.0, 3.0), (4.0, 5.0), (1.0, 1.0), (2.0, 2.0), (3.0, 9.0)], "s double, y double")
    got = rows(summaries.high_minus_low(df, "s", "y"))[0]
    assert got["diff"] == pytest.approx(2.5)
    assert got["t"] == pytest.approx(2.5 / math.sqrt(2.0 / 2 + 0.5 / 2))


def test_total_products_of_shifted_values(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    y = 0.5 * x + rng.normal(size=400)
    groups = (np.arange(400) % 7).tolist()
    df = spark.createDataFrame(list(zip(groups, (x + 1e8).tolist(), y.tolist(), strict=True)), "g int, x double, y double")
    cells = df.withColumn("sample", ols.F.lit("all")).groupBy("sample", "g").agg(*ols._moments(["x", "y"]))
    r = ols._totals(cells, ["sample"], ["x", "y"]).first()
    expected = np.cov(x, y, bias=True) * 400
    assert (r["_t_x_x"], r["_t_x_y"], r["_t_y_y"]) == pytest.approx((expected[0, 0], expected[0, 1], expected[1, 1]), rel=1e-6)


def test_all_numbers_from_one_table_equal_each_regression_alone(spark):
    from sigvane.operators import all_numbers

    random.seed(11)
    some = lambda v, share=0.05: None if random.random() < share else v
    rows_in = []
    for i in range(260):
        signals = [some(float(random.randint(1, 5))) for _ in K.CROSS_SECTION_SIGNALS]
        rows_in.append((
            random.choice(["full", "excluded"]), f"c{i}", "n" * random.randint(1, 9), some(random.choice("stuv")), some(random.choice(K.CATEGORIES)),
            *signals, some(random.random()), some(random.random()), some(random.random()), some(random.random()), some(random.random()),
        ))
    outcomes = list(dict.fromkeys([K.PRIMARY_OUTCOME, *K.SECONDARY_OUTCOMES, "fwd_ret_4m", "log_mktcap", "prior_rev_growth_yoy"]))
    numbers_in = [*K.CROSS_SECTION_SIGNALS, *outcomes][: len(rows_in[0]) - 5]
    schema = "sample string, company_id string, company_name string, sector string, category string, " + ", ".join(f"{c} double" for c in numbers_in)
    base = spark.createDataFrame([r[: 5 + len(numbers_in)] for r in rows_in], schema)
    reported = ["conc", "inv"]
    fits = all_numbers.regressions(base, K.CROSS_SECTION_SIGNALS, reported, "conc", K.CATEGORIES[0], K.CATEGORIES[3])
    got = {(r["sample"], r["block"], r["key"]): (r["n"], r["coef"], r["se"]) for r in fits.collect()}
    alone = {
        "ladder": (ols.spec_ladder(base), lambda r: f"{r['signal']}/{r['dv']}/{r['spec']}"),
        "within_category": (ols.within_category(base), lambda r: r["category"]),
        "complete_case": (ols.complete_case(base, K.CROSS_SECTION_SIGNALS, reported), lambda r: r["signal"]),
        "placebo": (ols.placebo(base), lambda r: "name length"),
        "premium": (ols.group_premium(base, K.CATEGORIES[0]), lambda r: "all others"),
    }
    expected = {(r["sample"], block, key(r)): (r["n"], r["coef"], r["se"]) for block, (df, key) in alone.items() for r in df.collect()}
    expected |= {(r["sample"], "premium", K.CATEGORIES[3]): (r["n"], r["coef"], r["se"]) for r in ols.group_premium(base, K.CATEGORIES[0], K.CATEGORIES[3]).collect()}
    assert set(got) == set(expected) and len(got) > 60
    for k, (n, coef, se) in expected.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(coef, rel=1e-9, abs=1e-12) and got[k][2] == pytest.approx(se, rel=1e-9, abs=1e-12), k


def test_many_pairs_are_dealt_to_more_tasks_with_the_same_result(spark, monkeypatch):
    """The rows of a task are exploded into pairs and counted in memory, so their number is bounded."""
    random.seed(4)
    data = [(random.choice(["Q1", "Q2", None]), random.choice([1.0, 2.0, None]), random.random(), random.choice([None, random.random()])) for _ in range(300)]
    panel = spark.createDataFrame(data, "quarter string, s double, a double, b double").coalesce(1)
    order = ["quarter", "outcome"]
    plain = rows(ic.ic_by_quarter(panel, ["s"], ["a", "b"]), *order)
    monkeypatch.setattr(ic, "PAIRS_A_TASK", 10)
    assert ic._dealt(panel, ["quarter"], ["s"], ["a", "b"]).rdd.getNumPartitions() == 60
    dealt = rows(ic.ic_by_quarter(panel, ["s"], ["a", "b"]), *order)
    assert [r["n_obs"] for r in dealt] == [r["n_obs"] for r in plain]
    assert [r["ic"] for r in dealt] == pytest.approx([r["ic"] for r in plain])


def test_rank_correlation_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return v

    data = spark.createDataFrame([("g", float(i), float(-i)) for i in range(20)] + [("h", None, 1.0)], "g string, a double, y double")
    marked = data.select("g", "y", seen("a").alias("x"))
    got = {r["g"]: r for r in rows(ic.spearman(marked.select("g", "x", "y"), ["g"]))}
    assert got["g"]["ic"] == pytest.approx(-1.0) and (got["h"]["n_obs"], got["h"]["status"]) == (0, "too_few_obs")
    assert read.value <= 2 * 21  # before, every step that needed pairs read the rows again
