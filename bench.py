"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose the data and the cores.
Each query is run ``RUNS`` times and its best time counts; DuckDB's time for the same SQL
is given beside it where there is one.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES, SQL  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

HEADLINE = (
    "category_b1", "category_by_date_b4", "top_n_fold_b6", "numeric_buckets_b7", "many_groups_one_pass_a13",
    "count_distinct_a5", "median_a6", "median_of_large_groups_a6", "total_row_a16", "label_totals_a18",
    "two_axis_display_filter_f11", "dictionary_lookup_j1", "share_of_period_w4", "close_values_w10", "carry_forward_w8",
    "change_from_year_ago_w12", "pivot_o8", "clean_cells_s11", "column_statistics_s19", "format_value_v3",
    "flatten_leaves_h7", "roll_up_h12",
)
RUNS = 2
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def best(run) -> float:
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def duckdb_times(folder: str, cpus: int) -> dict[str, float]:
    try:
        import duckdb
    except ImportError:
        return {}
    con = duckdb.connect()
    con.execute(f"SET threads TO {cpus}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return {n: best(lambda: con.execute(SQL[n]).fetchall()) for n in HEADLINE if n in SQL}  # noqa: B023


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, "bench", "8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    queries = {n: best(lambda: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()) for n in HEADLINE}  # noqa: B023
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "duckdb": duckdb_times(folder, cpus),
    }))


if __name__ == "__main__":
    main()
