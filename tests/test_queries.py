"""The registered queries against their SQL; ``ALL_QUERIES=1`` runs every one."""

import glob
import os

import duckdb
import pytest
from check_oracle import compare

import __spark_entry__ as entrypoint

QUICK = [
    "panel_point_in_time", "line_percentile_rank", "ic_by_quarter", "backtest_metrics", "spec_ladder", "permutation_test", "pooled_regression_grid",
    "panel_from_raw_sources", "all_numbers", "normalize_postings", "unmatched_identifier_report", "document_excerpts", "evidence_extraction", "facts_quarter_outcomes", "entity_profiles",
    "postings_csv_round_trip", "score_dimensions", "search_results_by_key",
]
NAMES = sorted(entrypoint.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, sf_dir, name):
    status, _, _, note = compare(spark, tables, name, entrypoint.queries()[name], entrypoint.oracle_sql()[name], sf_dir)
    assert status == "ok", note


def test_entry_has_rows_and_schema(spark):
    df = entrypoint.entry(spark)
    assert df.count() > 0 and "fwd_excess_return_1q" in df.columns


def test_every_query_names_what_it_covers():
    from sigvane.plans.catalog import QUERIES

    assert all(q.covers for q in QUERIES.values())
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_every_file_source_is_read_by_a_query():
    from sigvane.plans.catalog import QUERIES

    assert {f"A{n}" for n in range(1, 19)} <= {c for q in QUERIES.values() for c in q.covers}
