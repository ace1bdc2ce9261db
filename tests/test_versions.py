"""Tables that are published together, and the panel of raw exports."""

import pytest
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.operators import bootstrap, pit
from sigvane.sources import readers, sinks, versions


def numbers(spark, n, by=1):
    return spark.range(n).select((F.col("id") * by).alias("v"))


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "tables")
    assert versions.current(spark, root).count() == 0
    with pytest.raises(ValueError, match="no table a"):
        versions.read_current(spark, root, "a")
    first = versions.Publication(spark, root)
    first.stage("a", numbers(spark, 3))
    first.stage("b", numbers(spark, 0))
    assert versions.current(spark, root).count() == 0  # staged, not published
    counts = {r["table"]: r["rows"] for r in first.commit().collect()}
    assert counts == {"a": 3, "b": 0}

    second = versions.Publication(spark, root)
    second.stage("a", numbers(spark, 5))
    with pytest.raises(Exception, match="boom"):
        second.stage("b", numbers(spark, 5).select(F.when(F.col("v") == 4, F.raise_error(F.lit("boom"))).otherwise(F.col("v")).alias("v")))
    assert {r["v"] for r in versions.read_current(spark, root, "a").collect()} == {0, 1, 2}
    assert versions.read_current(spark, root, "b").count() == 0

    third = versions.Publication(spark, root)
    read_back = third.stage("a", numbers(spark, 4, by=10))
    assert read_back.count() == 4
    with pytest.raises(ValueError, match="already part"):
        third.stage("a", numbers(spark, 1))
    third.commit()
    assert {r["v"] for r in versions.read_current(spark, root, "a").collect()} == {0, 10, 20, 30}
    with pytest.raises(ValueError, match="no table b"):
        versions.read_current(spark, root, "b")
    assert {(r["version"], r["table"]) for r in versions.manifest(spark, root).collect()} == {(1, "a"), (1, "b"), (2, "a")}


def test_of_two_versions_of_one_number_readers_agree_on_one(spark, tmp_path):
    root = str(tmp_path / "tables")
    one, other = versions.Publication(spark, root), versions.Publication(spark, root)
    one.stage("a", numbers(spark, 1))
    other.stage("a", numbers(spark, 2))
    row = [(1, run.run, *run.staged[0]) for run in (one, other)]
    for r in row:  # both saw an empty manifest
        spark.createDataFrame([r], versions.MANIFEST.rsplit(",", 1)[0]).withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest.parquet")
    assert versions.current(spark, root).count() == 1
    assert versions.read_current(spark, root, "a").count() == (1 if one.run > other.run else 2)


COMPANIES = [("1", " aa ", "Aa Inc", "Tech"), ("2", "bb", "Bb Corp", "Tech")]
SCORES = [("aa", "2024-03-31", *("34225"[:4]), "x", "2024-04-02", "2024-04-05"), ("BB ", "2024-03-31", *"1234", "x", "2024-04-09", "2024-04-05")]
PRICES = [(t, d, p) for t, base in (("AA", 10), ("bb", 20)) for d, p in (("2024-03-01", str(base)), ("2024-04-01", str(base * 1.1)), ("2024-05-01", str(base * 1.2)), ("2024-06-03", str(base * 1.5)))]
REPORTS = [("1", "2023Q4", "2023-12-31", "2024-02-01", "100"), ("2", "2023Q4", "2023-12-31", "2024-02-01", "50"), ("1", "2024Q2", "2024-06-30", "2024-08-01", "130")]


def exports(spark, folder):
    frames = {
        "companies": spark.createDataFrame(COMPANIES, "company_id string, ticker string, company_name string, sector string"),
        "scores": spark.createDataFrame(
            SCORES, ", ".join(f"{c} string" for c in ["ticker", "snapshot_date", *K.SCORE_COLUMNS, "source_name", "available_at", "prediction_date"])
        ),
        "prices": spark.createDataFrame(PRICES, "ticker string, price_date string, adjusted_close string"),
        "financials": spark.createDataFrame(REPORTS, "company_id string, fiscal_quarter string, fiscal_period_end string, available_at string, revenue string"),
    }
    return {name: readers.read_table(spark, sinks.write_table(df, f"{folder}/{name}.csv")) for name, df in frames.items()}


def test_raw_exports_become_a_published_panel(spark, tmp_path):
    raw, root = exports(spark, tmp_path), str(tmp_path / "published")
    counts = {r["table"]: r["rows"] for r in bootstrap.publish_panel(spark, raw, root, strict=False).collect()}
    assert counts == {"companies": 2, "scores": 2, "prices": 8, "financials": 3, bootstrap.PANEL: 2}
    panel = {r["company_id"]: r for r in versions.read_current(spark, root, bootstrap.PANEL).collect()}
    assert set(panel["1"].asDict()) == set(pit.PANEL_COLUMNS)
    assert str(panel["1"]["prediction_date"]) == "2024-04-05" and not panel["1"]["timing_violation"] and panel["2"]["timing_violation"]
    assert panel["1"]["fwd_return_1q"] == pytest.approx(15 / 12 - 1) and panel["1"]["prior_return_1q"] == pytest.approx(0.1)
    bootstrap.publish_panel(spark, raw, root)  # strict: the late score goes
    assert [r["company_id"] for r in versions.read_current(spark, root, bootstrap.PANEL).collect()] == ["1"]


def test_an_export_without_a_column_or_with_a_bad_row_publishes_nothing(spark, tmp_path):
    raw, root = exports(spark, tmp_path), str(tmp_path / "published")
    with pytest.raises(ValueError, match="sector"):
        bootstrap.publish_panel(spark, raw | {"companies": raw["companies"].drop("sector")}, root)
    spoilt = raw["prices"].withColumn("adjusted_close", F.when(F.col("price_date") == "2024-06-03", "-1").otherwise(F.col("adjusted_close")))
    with pytest.raises(ValueError, match="adjusted_close_not_positive"):
        bootstrap.publish_panel(spark, raw | {"prices": spoilt}, root)
    assert versions.current(spark, root).count() == 0
