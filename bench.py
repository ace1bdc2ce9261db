"""Time the headline queries.  Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` (default 8) the cores.
Each query is run once to warm up and then timed; results are written to the no-op sink, whole.  The stage
tables queries share (entity quarters, panel, vintage, prepared samples, posting buckets) are built in the
warm-up, so the timed run reads them; the panel and the postings are also timed from their inputs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigvane.plans.catalog import QUERIES  # noqa: E402
from sigvane.runtime import local_session  # noqa: E402

HEADLINE = [
    "panel_point_in_time",
    "line_percentile_rank",
    "line_price_quantiles",
    "ic_lines_by_flag",
    "line_regression_hc3",
    "ic_by_quarter",
    "sector_neutral_ic_pooled",
    "backtest_metrics",
    "missingness_diagnostics",
    "spec_ladder",
    "leave_one_sector_out",
    "permutation_test",
    "pooled_regression_grid",
    "normalize_postings",
    "normalize_prices",
    "facts_quarter_outcomes",
    "horizon_returns",
    "hiring_signal",
    "hiring_movers",
    "document_excerpts",
    "evidence_extraction",
    "html_to_text",
    "request_batches",
    "stratified_sample",
    "entity_profiles",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].run(spark, directory).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/"))}))


if __name__ == "__main__":
    main()
