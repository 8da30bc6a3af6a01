"""Breakdowns by category, date and second axis (B rows)."""

from pyspark.sql import functions as F

from catalog.base import query, rounded
from tallyframe import Agg, Axis, Breakdown, Dashboard, Metric, MetricGroup
from tallyframe.operators.views import time_series

REVENUE = Metric("revenue", Agg("o_totalprice"))
QUANTITY = Metric("quantity", Agg("l_quantity"))
VALUE = Metric("value", Agg("value"))


@query("category_b1", """
SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS record_count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(Breakdown(t.lineitem, [QUANTITY], "l_partkey").rows(), 2, "quantity")


# DuckDB label formats matching the six granularities.
FORMATS = {
    "minute": "%Y-%m-%d %H:%M", "hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d",
    "week": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y",
}


def register_granularity(granularity: str, fmt: str):
    @query(f"date_{granularity}_b2", f"""
SELECT strftime(date_trunc('{granularity}', ts), '{fmt}') AS label, count(*) AS record_count,
  round(sum(value), 2) AS value FROM events GROUP BY 1""")
    def _(t):
        return rounded(Breakdown(t.events, [VALUE], axis=Axis("ts", "date", granularity)).rows(), 2, "value")


for _g, _f in FORMATS.items():
    register_granularity(_g, _f)


@query("date_only_b3", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, count(*) AS record_count,
  round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1""")
def _(t):
    return rounded(Breakdown(t.orders, [REVENUE], axis=Axis("o_orderdate", "date", "month")).rows(), 2, "revenue")


@query("category_by_date_b4", """
SELECT o_orderpriority AS label, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS date_label, count(*) AS record_count,
  round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2""")
def _(t):
    return rounded(Breakdown(t.orders, [REVENUE], "o_orderpriority", Axis("o_orderdate", "date", "month")).rows(), 2, "revenue")


@query("category_by_column_b5", """
SELECT l_returnflag AS label, CAST(l_linenumber AS VARCHAR) AS date_label, count(*) AS record_count,
  round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2""")
def _(t):
    return rounded(Breakdown(t.lineitem, [QUANTITY], "l_returnflag", Axis("l_linenumber")).rows(), 2, "quantity")


@query("top_n_fold_b6", """
WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 5)
SELECT l_returnflag AS label, CASE WHEN l_suppkey IN (SELECT l_suppkey FROM top) THEN CAST(l_suppkey AS VARCHAR) ELSE 'Прочее' END AS date_label,
  count(*) AS record_count, round(sum(l_quantity), 2) AS quantity, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS parts
FROM lineitem GROUP BY 1, 2""")
def _(t):
    metrics = [QUANTITY, Metric("parts", Agg("l_partkey", "COUNT_DISTINCT"))]
    return rounded(Breakdown(t.lineitem, metrics, "l_returnflag", Axis("l_suppkey", top_n=5)).rows(), 2, "quantity")


@query("numeric_buckets_b7", """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_returnflag AS label,
  lpad(CAST(least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 12) AS BIGINT), 11) + 1 AS VARCHAR), 2, '0') AS date_label,
  count(*) AS record_count, round(sum(l_quantity), 2) AS quantity FROM lineitem, e GROUP BY 1, 2""")
def _(t):
    axis = Axis("l_extendedprice", "bucket", buckets=12)
    return rounded(Breakdown(t.lineitem, [QUANTITY], "l_returnflag", axis).rows(), 2, "quantity")


@query("buckets_of_unclean_numbers_b7", """
WITH v AS (SELECT CASE WHEN l_orderkey % 10 > 1 THEN l_extendedprice END AS v, l_quantity FROM lineitem), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT lpad(CAST(least(CAST(floor((v - lo) / (hi - lo) * 12) AS BIGINT), 11) + 1 AS VARCHAR), 2, '0') AS label,
  count(*) AS record_count, round(sum(l_quantity), 2) AS quantity FROM v, e WHERE v IS NOT NULL GROUP BY 1""")
def _(t):
    k = F.col("l_orderkey") % 10
    unclean = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice"))
    rows = Breakdown(t.lineitem.withColumn("v", unclean), [QUANTITY], axis=Axis("v", "bucket", buckets=12)).rows()
    return rounded(rows, 2, "quantity")


@query("row_cap_b8", """
SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS record_count, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 1000""")
def _(t):
    return rounded(Breakdown(t.lineitem, [QUANTITY], "l_partkey", limit=1000).rows(), 2, "quantity")


@query("unknown_axis_b9", """
SELECT o_orderstatus AS label, count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1""")
def _(t):
    return rounded(Breakdown(t.orders, [REVENUE], "o_orderstatus", Axis("o_orderdate", "date", "decade")).rows(), 2, "revenue")


@query("blank_labels_b10", """
SELECT trim(label) AS label, record_count, round(revenue, 2) AS revenue FROM (
  SELECT CASE o_orderstatus WHEN 'P' THEN '  ' WHEN 'F' THEN ' F ' ELSE o_orderstatus END AS label, count(*) AS record_count,
    sum(o_totalprice) AS revenue FROM orders GROUP BY 1) WHERE trim(label) <> ''""")
def _(t):
    status = F.when(F.col("o_orderstatus") == "P", "  ").when(F.col("o_orderstatus") == "F", " F ").otherwise(F.col("o_orderstatus"))
    return rounded(Breakdown(t.orders.withColumn("status", status), [REVENUE], "status").rows(), 2, "revenue")


@query("group_time_series_b12", """
WITH g AS (SELECT strftime(date_trunc('year', o_orderdate), '%Y') AS date_label, count(*) AS record_count,
  sum(o_totalprice) AS revenue, CAST(count(o_orderkey) AS DOUBLE) AS n FROM orders GROUP BY 1)
SELECT 'Money' AS label, date_label, record_count, 'main' AS metric_id, round(revenue, 2) AS value FROM g
UNION ALL SELECT 'Orders', date_label, record_count, 'main', n FROM g""")
def _(t):
    groups = [
        MetricGroup("money", [REVENUE], "Money", {"main": "revenue"}),
        MetricGroup("orders", [Metric("n", Agg("o_orderkey", "COUNT"))], "Orders", {"main": "n"}),
    ]
    long = Dashboard(groups, ["main"]).breakdown(t.orders, None, Axis("o_orderdate", "date", "year"))
    return rounded(time_series(long), 2, "value")
