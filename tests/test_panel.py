import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.operators import pit

A, B, C, D = K.SCORE_COLUMNS


@pytest.fixture()
def inputs(spark):
    companies = spark.createDataFrame(
        [("C1", "AAA", "Alpha", "Tech", 100.0), ("C2", "BBB", "Beta", "Tech", 400.0)],
        "company_id string, ticker string, company_name string, sector string, market_cap double",
    )
    scores = spark.createDataFrame(
        [("C1", date(2025, 3, 31), datetime(2025, 4, 2), 4, 3, 5, 4), ("C2", date(2025, 3, 31), datetime(2025, 4, 2), 2, 3, 2, 1)],
        f"company_id string, snapshot_date date, available_at timestamp, {A} int, {B} int, {C} int, {D} int",
    )
    days = [date(2024, 12, 31), date(2025, 3, 31), date(2025, 6, 30), date(2025, 9, 30)]
    closes = {"C1": [90.0, 100.0, 110.0, 121.0], "C2": [50.0, 55.0, 60.0, 54.0]}
    prices = spark.createDataFrame(
        [(c, d, v) for c, vs in closes.items() for d, v in zip(days, vs, strict=True)], "company_id string, price_date date, adjusted_close double"
    )
    reports = spark.createDataFrame(
        [
            ("C1", q, d, datetime(d.year, d.month, d.day), r, m, e)
            for q, d, r, m, e in zip(
                ["2024Q4", "2025Q1", "2025Q2", "2025Q3"], days, [909.0909, 1000.0, 1100.0, 1210.0], [0.18, 0.20, 0.22, 0.25], [100.0, 100.0, 100.0, 110.0], strict=True
            )
        ],
        "company_id string, fiscal_quarter string, fiscal_period_end date, available_at timestamp, revenue double, operating_margin double, employee_count double",
    )
    return companies, scores, prices, reports


def test_expected_values(inputs):
    first, second = rows(pit.build_panel(*inputs), "ticker")
    assert first[K.COMPOSITE] == 4.0
    assert first["prior_return_1q"] == pytest.approx(100 / 90 - 1)
    assert (first["outcome_start_date"], first["outcome_end_date"]) == (date(2025, 6, 30), date(2025, 9, 30))
    assert first["fwd_return_1q"] == pytest.approx(0.1)
    assert first["fwd_return_2q"] is None
    assert first["fwd_excess_return_1q"] == pytest.approx(0.1)
    assert second["fwd_return_1q"] == pytest.approx(-0.1)
    assert first["revenue_growth_qoq"] == pytest.approx(0.1, abs=1e-6)
    assert first["operating_margin_t"] == 0.20
    assert first["revenue_per_employee_t"] == 10.0
    assert first["future_revenue_growth_qoq"] == pytest.approx(0.1)
    assert first["future_operating_margin_delta_qoq"] == pytest.approx(0.03)
    assert first["future_revenue_per_employee_growth_qoq"] == pytest.approx(0.0)
    assert second["revenue_growth_qoq"] is None
    assert list(first) == pit.PANEL_COLUMNS


def test_timing_violations(inputs, spark):
    companies, scores, prices, reports = inputs
    early = scores.selectExpr("*", "date'2025-04-01' AS prediction_date")
    loose = rows(pit.build_panel(companies, early, prices, reports, strict=False))
    assert [r["timing_violation"] for r in loose] == [True, True]
    assert loose[0]["timing_warning"] == "score_available_at after prediction_date"
    assert pit.build_panel(companies, early, prices, reports, strict=True).isEmpty()


def test_sparse_history(inputs):
    companies, scores, prices, reports = inputs
    few = pit.build_panel(companies, scores, prices.where("price_date <= date'2025-03-31'"), reports.where("fiscal_quarter = '2025Q1'"))
    got = rows(few)
    assert len(got) == 2
    assert all(r["fwd_return_1q"] is None and r["future_revenue_growth_qoq"] is None for r in got)


def test_row_order_does_not_matter(inputs):
    companies, scores, prices, reports = inputs
    shuffled = pit.build_panel(companies, scores.orderBy("company_id", ascending=False), prices.orderBy("adjusted_close"), reports.orderBy("revenue"))
    assert rows(pit.build_panel(*inputs), "ticker") == rows(shuffled, "ticker")


def test_late_filing_of_an_older_period_is_second(spark):
    """Reports are ordered by period end, not by the day they became known."""
    scores = spark.createDataFrame([("C1", date(2025, 6, 1))], "company_id string, prediction_date date")
    reports = spark.createDataFrame(
        [
            ("C1", "2025Q1", date(2025, 3, 31), datetime(2025, 4, 1), 300.0),
            ("C1", "2024Q3", date(2024, 9, 30), datetime(2024, 10, 1), 100.0),
            ("C1", "2024Q4", date(2024, 12, 31), datetime(2025, 5, 20), 200.0),
            ("C1", "2025Q2", date(2025, 5, 31), datetime(2025, 6, 2), 999.0),
        ],
        "company_id string, fiscal_quarter string, fiscal_period_end date, available_at timestamp, revenue double",
    )
    got = rows(pit.point_in_time(scores, None, reports))[0]
    assert got["revenue_growth_qoq"] == pytest.approx(0.5)


def test_nearest_within_tolerance_and_tie(spark):
    target = date(2025, 3, 31)
    targets = spark.createDataFrame([(k, target) for k in "abcd"], "ticker string, t date")
    series = spark.createDataFrame(
        [
            ("a", date(2025, 3, 11), 1.0), ("b", date(2025, 4, 21), 2.0), ("c", date(2025, 4, 22), 3.0),
            ("d", date(2025, 3, 26), 4.0), ("d", date(2025, 4, 5), 5.0),
        ],
        "ticker string, end date, val double",
    )
    got = {r["ticker"]: r["x_val"] for r in rows(pit.nearest_within(targets, series, ["ticker"], "t", "end", 21, ["val"], "x"))}
    assert got == {"a": 1.0, "b": 2.0, "c": None, "d": 4.0}


def test_horizon_returns_use_the_table_calendar(spark):
    prices = spark.createDataFrame(
        [("A", date(2025, 1, 21), 10.0), ("A", date(2025, 2, 18), 12.0), ("B", date(2025, 1, 21), 20.0), ("B", date(2025, 2, 17), 30.0)],
        "ticker string, price_date date, adjusted_close double",
    )
    common = {r["ticker"]: r for r in rows(pit.horizon_returns(prices, "2025-01-19", [1]))}
    assert common["A"]["fwd_ret_1m"] == pytest.approx(0.2) and common["B"]["fwd_ret_1m"] is None
    own = {r["ticker"]: r for r in rows(pit.horizon_returns(prices, "2025-01-19", [1], per_ticker=True))}
    assert own["B"]["fwd_ret_1m"] == pytest.approx(0.5)


def test_panel_refuses_repeated_keys(inputs):
    companies, scores, prices, reports = inputs
    twice = scores.unionByName(scores.limit(1))
    with pytest.raises(ValueError, match="more than one row"):
        pit.build_panel(companies, twice, prices, reports)
    found = rows(pit.panel_key_violations(pit.build_panel(companies, twice, prices, reports, unique=False)))
    assert [r["detail"] for r in found] == ["2 rows"]


def test_looks_equal_brute_force(spark):
    """Random series with gaps, one kind or no start row missing, ties at equal distance, null values and keys."""
    random.seed(11)
    data, day0 = [], date(2020, 1, 1)
    for key in ["A", "B", "C", "D", "E", None]:
        for kind in ("x", "y") if key != "D" else ("x",):
            for day in sorted(random.sample(range(900), random.choice([1, 12, 60, 200]))):
                data.append((key, kind, day0 + timedelta(days=day), random.choice([None, float(day)])))
    data += [("tie", "x", day0 + timedelta(days=d), float(d)) for d in (0, 20, 50, 60, 64, 100)]
    series = spark.createDataFrame(data, "k string, kind string, day date, v double")
    begin = {k: max((d for key, kind, d, _ in data if key == k and kind == "x"), default=None) for k in {r[0] for r in data} - {"E"}}
    first = spark.createDataFrame(list(begin.items()), "b_k string, begin date")
    marked = series.join(first, F.col("k").eqNullSafe(F.col("b_k")), "left")
    start = F.coalesce((F.col("kind") == "x") & (F.col("day") == F.col("begin")), F.lit(False))
    looks = {"near": ("x", 38, 21), "far": ("x", 300, 30), "other": ("y", 0, 5), "back": ("y", 90, 400), "self": ("x", 0, 0)}
    got = {r["k"]: r for r in rows(pit.nearest_looks(marked, ["k"], "kind", "day", ["v"], start, looks))}
    assert set(got) == set(begin)
    for k, r in got.items():
        assert r["start_day"] == begin[k]
        for name, (kind, days, tolerance) in looks.items():
            at = begin[k] - timedelta(days=days)
            best = min(((abs((d - at).days), d, v) for key, what, d, v in data if key == k and what == kind and abs((d - at).days) <= tolerance), default=(0, None, None))
            assert r[f"{name}_v"] == best[2], (k, name)
    assert got["tie"]["near_v"] == 60.0


def test_looks_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, kind string, day date, v double")
    assert rows(pit.nearest_looks(none, ["k"], "kind", "day", ["v"], F.lit(True), {"a": ("x", 1, 1)})) == []


def test_group_means_meet_the_rows_without_a_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id % 7 AS STRING) AS g", "CAST(id AS DOUBLE) AS v").write.parquet(f"{tmp_path}/t")
    out = pit.add_group_excess(spark.read.parquet(f"{tmp_path}/t"), "v", ["g"], "e")
    assert abs(out.agg(F.sum("e")).first()[0]) < 1e-6
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_entity_quarters_count_every_part_once(spark, tmp_path):
    """Lines of one part in several rows, against sums of all lines; the lines are shuffled by less than their parts."""
    from sigvane.plans import bindings

    rng = random.Random(3)
    data = [(rng.randrange(3), rng.randrange(12), float(rng.randint(1, 9)), rng.randint(100, 999) / 100, rng.randint(0, 9) / 100, rng.choice("NR"), datetime(2000, rng.randint(1, 6), 5)) for _ in range(400)]
    names = "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(data, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    built = bindings._build_entity_quarters(spark, str(tmp_path))
    expected = {}
    for supplier, part, quantity, price, discount, flag, day in data:
        e = expected.setdefault((str(supplier), (day.month - 1) // 3), [0, 0, 0, 0, 0, set()])
        net = round(price * 100) * (100 - round(discount * 100))
        for i, v in enumerate((quantity, round(price * 100), net, net if flag == "N" else 0, 1)):
            e[i] += v
        e[5].add(part)
    got = {(r["company_id"], (r["period_end"].month - 1) // 3): [r["quantity"], r["cents"], r["net"], r["net_n"], r["lines"], r["parts"]] for r in built.collect()}
    assert got == {k: [*e[:5], len(e[5])] for k, e in expected.items()}
    assert "l_partkey" not in "".join(line for line in built._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line)


def test_only_lines_of_a_large_supplier_are_dealt(spark, tmp_path, monkeypatch):
    """Suppliers 0 and null are large: theirs meet again as one row; all others have one row per quarter before the second shuffle."""
    from sigvane.plans import bindings

    rng = random.Random(4)
    keys = [0] * 300 + [None] * 120 + [1 + i % 9 for i in range(90)]
    data = [(k, rng.choice([None, *range(40)]), float(rng.randint(1, 9)), rng.randint(100, 999) / 100, 0.05, rng.choice("NR"), datetime(2000, rng.randint(1, 6), 5)) for k in keys]
    names = "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(data, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = {tuple(r) for r in bindings._build_entity_quarters(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(bindings, "LINES_A_DEAL", 50)
    dealt = bindings._dealt_totals(spark.read.parquet(f"{tmp_path}/lineitem.parquet")).collect()
    deals = {}
    for r in dealt:
        deals.setdefault((r["l_suppkey"], r["period_end"]), []).append(r["deal"])
    assert all(sorted(d) == [0] for (k, _), d in deals.items() if k)
    assert all(len(d) > 4 for (k, _), d in deals.items() if k == 0)
    assert all(1 < len(d) <= 3 for (k, _), d in deals.items() if k is None)
    built = bindings._build_entity_quarters(spark, str(tmp_path)).collect()
    assert len(built) == len(whole) == 22 and {tuple(r) for r in built} == whole
    for r in built:
        mine = [x for x in data if (None if x[0] is None else str(x[0])) == r["company_id"] and (x[6].month - 1) // 3 == (r["period_end"].month - 1) // 3]
        assert (r["lines"], r["parts"]) == (len(mine), len({x[1] for x in mine} - {None}))


def test_errors_are_gathered_by_one_job(spark):
    from sigvane.operators import quality

    rows_ = spark.range(4000, numPartitions=16).withColumn("v", F.when(F.col("id") == 3999, -1).otherwise(1))
    found = quality.row_violations(rows_, [quality.Check("negative", F.col("v") < 0, F.col("v"))], F.col("id"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("errors at once", "")
    with pytest.raises(ValueError, match=r"odd: negative \[3999\] -1"):
        quality.raise_on(found, "odd")
    read = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("errors at once") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(s.numTasks for s in read if s)[-1] == 16
