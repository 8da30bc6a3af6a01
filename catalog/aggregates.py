"""Aggregates, metrics over metrics, total rows and cards (A rows)."""

from pyspark.sql import functions as F

from catalog.base import query, rounded
from tallyframe import Agg, Breakdown, Calc, Card, Dashboard, Metric, MetricGroup, Template, fx
from tallyframe.operators.breakdown import Axis, to_long, total_records
from tallyframe.operators.lookup import level_nodes
from tallyframe.operators.views import label_totals
from tallyframe.operators.pivot import row_totals

PRICE, KEY, CUST = "o_totalprice", "o_orderkey", "o_custkey"


@query("sum_a1", """
SELECT o_orderpriority AS label, count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue
FROM orders GROUP BY 1""")
def _(t):
    return rounded(Breakdown(t.orders, [Metric("revenue", Agg(PRICE))], "o_orderpriority").rows(), 2, "revenue")


@query("avg_a2", """
SELECT o_orderpriority AS label, count(*) AS record_count, round(avg(o_totalprice), 4) AS mean
FROM orders GROUP BY 1""")
def _(t):
    return rounded(Breakdown(t.orders, [Metric("mean", Agg(PRICE, "AVG"))], "o_orderpriority").rows(), 4, "mean")


@query("min_max_a3", """
SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS record_count, min(l_quantity) AS low, max(l_extendedprice) AS high
FROM lineitem GROUP BY 1""")
def _(t):
    metrics = [Metric("low", Agg("l_quantity", "MIN")), Metric("high", Agg("l_extendedprice", "MAX"))]
    return Breakdown(t.lineitem, metrics, "l_suppkey").rows()


@query("count_a4", """
SELECT event_type AS label, count(*) AS record_count, CAST(count(user_id) AS DOUBLE) AS n FROM events GROUP BY 1""")
def _(t):
    return Breakdown(t.events, [Metric("n", Agg("user_id", "COUNT"))], "event_type").rows()


@query("count_distinct_a5", """
SELECT l_returnflag AS label, count(*) AS record_count, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS parts,
  CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS suppliers, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY 1""")
def _(t):
    metrics = [
        Metric("parts", Agg("l_partkey", "COUNT_DISTINCT")),
        Metric("suppliers", Agg("l_suppkey", "COUNT_DISTINCT")),
        Metric("quantity", Agg("l_quantity")),
    ]
    return rounded(Breakdown(t.lineitem, metrics, "l_returnflag").rows(), 2, "quantity")


MEDIAN_SQL = """
SELECT l_returnflag AS label, count(*) AS record_count, round(median(l_extendedprice), 4) AS mid,
  round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1"""
PERCENTILE_SQL = """
SELECT o_orderpriority AS label, count(*) AS record_count, round(quantile_cont(o_totalprice, 0.9), 4) AS p90,
  round(quantile_cont(o_totalprice, 0.25), 4) AS p25 FROM orders GROUP BY 1"""
MEDIAN = [Metric("mid", Agg("l_extendedprice", "MEDIAN")), Metric("revenue", Agg("l_extendedprice"))]
PERCENTILES = [Metric("p90", Agg(PRICE, "PERCENTILE", 0.9)), Metric("p25", Agg(PRICE, "PERCENTILE", 0.25))]


@query("median_a6", MEDIAN_SQL)
def _(t):
    return rounded(rounded(Breakdown(t.lineitem, MEDIAN, "l_returnflag").rows(), 4, "mid"), 2, "revenue")


@query("median_of_large_groups_a6", MEDIAN_SQL)
def _(t):
    rows = Breakdown(t.lineitem, MEDIAN, "l_returnflag").rows()
    return rounded(rounded(rows, 4, "mid"), 2, "revenue")


@query("percentile_a7", PERCENTILE_SQL)
def _(t):
    return rounded(Breakdown(t.orders, PERCENTILES, "o_orderpriority").rows(), 4, "p90", "p25")


@query("percentile_of_large_groups_a7", PERCENTILE_SQL)
def _(t):
    return rounded(Breakdown(t.orders, PERCENTILES, "o_orderpriority").rows(), 4, "p90", "p25")


@query("record_count_a8", "SELECT o_orderstatus AS label, count(*) AS record_count FROM orders GROUP BY 1")
def _(t):
    return Breakdown(t.orders, [], "o_orderstatus").rows()


@query("default_aggregate_a9", """
SELECT o_orderstatus AS label, count(*) AS record_count, round(sum(o_totalprice) / nullif(sum(o_custkey), 0), 6) AS per_key,
  round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def _(t):
    metrics = [
        Metric("per_key", {"a": PRICE, "b": CUST}, lambda a, b: a / b),
        Metric("mean", {"a": PRICE}, lambda a: a, default_agg="AVG"),
    ]
    return rounded(rounded(Breakdown(t.orders, metrics, "o_orderstatus").rows(), 6, "per_key"), 4, "mean")


@query("several_aggregates_a11", """
SELECT o_orderpriority AS label, count(*) AS record_count,
  round(max(o_totalprice) / nullif(sum(o_totalprice), 0) - min(o_totalprice) / nullif(sum(o_totalprice), 0), 8) AS spread
FROM orders GROUP BY 1""")
def _(t):
    spread = Metric(
        "spread",
        {"top": (PRICE, "MAX"), "low": (PRICE, "MIN"), "s": (PRICE, "SUM"), "s2": (PRICE, "SUM")},
        lambda top, low, s, s2: top / s - low / s2,
    )
    return rounded(Breakdown(t.orders, [spread], "o_orderpriority").rows(), 8, "spread")


SALES = MetricGroup(
    "sales",
    [Metric("revenue", Agg(PRICE)), Metric("orders", Agg(KEY, "COUNT")),
     Metric("check", {}, lambda r, n: r / n, {"r": "revenue", "n": "orders"})],
    "Sales", {"main": "revenue", "ratio": "check"},
)
CLIENTS = MetricGroup(
    "clients",
    [Metric("buyers", Agg(CUST, "COUNT_DISTINCT")),
     Metric("per_buyer", {}, lambda r, b: r / b, {"r": "revenue", "b": "buyers"})],
    "Clients", {"main": "buyers", "ratio": "per_buyer"},
)
PLAIN = Template("Revenue", lambda value: value, fmt="currency", unit="₽")
COUNT = Template("Orders", lambda value: value, {"value": "COUNT"}, decimals=0)
RATIO = Template("Check", lambda a, b: a / b, fmt="decimal")
CARDS = [Card("rev", PLAIN, {"value": PRICE}), Card("num", COUNT, {"value": KEY}), Card("chk", RATIO, {"a": "rev", "b": "num"})]
GROUPED_SQL = """
WITH g AS (SELECT o_orderpriority AS label, count(*) AS record_count, sum(o_totalprice) AS revenue,
  count(o_orderkey) AS orders, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1)
"""


@query("many_groups_one_pass_a13", GROUPED_SQL + """
SELECT label, record_count, round(revenue, 2) AS sales__revenue, CAST(orders AS DOUBLE) AS sales__orders,
  round(revenue / orders, 4) AS sales__check, CAST(buyers AS DOUBLE) AS clients__buyers,
  round(revenue / buyers, 4) AS clients__per_buyer FROM g""")
def _(t):
    rows = Breakdown(t.orders, [SALES, CLIENTS], "o_orderpriority").rows()
    return rounded(rounded(rows, 2, "sales__revenue"), 4, "sales__check", "clients__per_buyer")


@query("kpi_cards_a14", """
WITH s AS (SELECT sum(o_totalprice) AS rev, CAST(count(o_orderkey) AS DOUBLE) AS num FROM orders)
SELECT 'rev' AS card, 'Revenue' AS name, round(rev, 2) AS value FROM s
UNION ALL SELECT 'num', 'Orders', num FROM s UNION ALL SELECT 'chk', 'Check', round(rev / num, 2) FROM s""")
def _(t):
    return rounded(Dashboard([], [], CARDS).card_values(t.orders), 2, "value").drop("text")


@query("metric_over_metrics_a15", """
WITH g AS (SELECT l_returnflag AS label, count(*) AS record_count, sum(l_extendedprice) AS total, sum(l_quantity) AS need FROM lineitem GROUP BY 1)
SELECT label, record_count, round(total, 2) AS total, round(need, 2) AS need, round(total / need, 6) AS unit_price,
  round(total / need * 2 - 1, 6) AS doubled FROM g""")
def _(t):
    metrics = [
        Metric("doubled", {}, lambda u: u * 2 - 1, {"u": "unit_price"}),
        Metric("unit_price", {}, lambda a, b: a / b, {"a": "total", "b": "need"}),
        Metric("total", Agg("l_extendedprice")),
        Metric("need", Agg("l_quantity")),
    ]
    rows = Breakdown(t.lineitem, metrics, "l_returnflag").rows()
    return rounded(rounded(rows, 2, "total", "need"), 6, "unit_price", "doubled")


@query("total_row_a16", """
SELECT count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 4) AS mean,
  min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(count(o_orderkey) AS DOUBLE) AS n,
  CAST(NULL AS DOUBLE) AS buyers, CAST(NULL AS DOUBLE) AS mid FROM orders""")
def _(t):
    metrics = [
        Metric("revenue", Agg(PRICE)), Metric("mean", Agg(PRICE, "AVG")), Metric("low", Agg(PRICE, "MIN")),
        Metric("high", Agg(PRICE, "MAX")), Metric("n", Agg(KEY, "COUNT")),
        Metric("buyers", Agg(CUST, "COUNT_DISTINCT")), Metric("mid", Agg(PRICE, "MEDIAN")),
    ]
    return rounded(rounded(Breakdown(t.orders, metrics, "o_orderpriority").total(), 2, "revenue"), 4, "mean")


@query("total_row_exact_a16", """
SELECT count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue,
  CAST(count(DISTINCT o_custkey) AS DOUBLE) AS buyers, round(median(o_totalprice), 4) AS mid FROM orders""")
def _(t):
    metrics = [Metric("revenue", Agg(PRICE)), Metric("buyers", Agg(CUST, "COUNT_DISTINCT")), Metric("mid", Agg(PRICE, "MEDIAN"))]
    total = Breakdown(t.orders, metrics, "o_orderpriority").total(exact=True)
    return rounded(rounded(total, 2, "revenue"), 4, "mid")


ABOUT = [
    Metric("buyers", Agg(CUST, "COUNT_DISTINCT", approximate=True)), Metric("mid", Agg(PRICE, "MEDIAN", approximate=True)),
    Metric("high", Agg(PRICE, "PERCENTILE", 0.9, approximate=True)), Metric("revenue", Agg(PRICE)),
]


@query("total_row_of_sketches_a16", """
SELECT count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue, TRUE AS buyers_near, TRUE AS mid_near, TRUE AS high_near FROM orders""")
def _(t):
    total = Breakdown(t.orders, ABOUT, "o_orderpriority").store().total()
    below = lambda m: F.avg((F.col(PRICE) <= total.select(m).scalar()).cast("int"))
    near = total.select(
        "record_count", "revenue", (F.abs(F.col("buyers") / t.orders.agg(F.count_distinct(CUST)).scalar() - 1) < 0.03).alias("buyers_near"),
        (F.abs(t.orders.agg(below("mid")).scalar() - 0.5) < 0.01).alias("mid_near"), (F.abs(t.orders.agg(below("high")).scalar() - 0.9) < 0.01).alias("high_near"))
    return rounded(near, 2, "revenue")


@query("total_row_of_kept_rows_a16", """
WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS label, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
k AS (SELECT * FROM g ORDER BY s DESC NULLS LAST, label LIMIT 100)
SELECT CAST(sum(n) AS BIGINT) AS record_count, round(sum(s), 2) AS revenue, (SELECT count(*) FROM g) > 100 AS truncated FROM k""")
def _(t):
    return rounded(Breakdown(t.orders, [Metric("revenue", Agg(PRICE))], "o_custkey", limit=100).total(), 2, "revenue")


@query("calculated_total_a17", """
SELECT count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue, CAST(count(o_orderkey) AS DOUBLE) AS orders,
  round(sum(o_totalprice) / count(o_orderkey), 4) AS "check", round(max(o_totalprice) / avg(o_totalprice), 6) AS peak FROM orders""")
def _(t):
    peak = Metric("peak", {"a": (PRICE, "MAX"), "b": (PRICE, "AVG")}, lambda a, b: a / b)
    total = Breakdown(t.orders, [*SALES.metrics, peak], "o_orderpriority").total()
    return rounded(rounded(rounded(total, 2, "revenue"), 4, "check"), 6, "peak")


def cells(t):
    metrics = [Metric("a", Agg("l_extendedprice")), Metric("b", Agg("l_quantity")),
               Metric("ratio", {}, lambda a, b: a / b, {"a": "a", "b": "b"})]
    return Breakdown(t.lineitem, metrics, "l_suppkey", Axis("l_shipdate", "date", "year")).rows(ordered=False)


@query("totals_by_label_a18", """
SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS record_count, round(avg(l_extendedprice), 4) AS mean, max(l_quantity) AS most,
  round(sum(l_extendedprice) / max(l_quantity), 4) AS ratio, CAST(NULL AS DOUBLE) AS parts, TRUE AS parts_near FROM lineitem GROUP BY 1""")
def _(t):
    metrics = [Metric("mean", Agg("l_extendedprice", "AVG")), Metric("most", Agg("l_quantity", "MAX")),
               Metric("ratio", {"a": "l_extendedprice", "b": ("l_quantity", "MAX")}, lambda a, b: a / b),
               Metric("parts", Agg("l_partkey", "COUNT_DISTINCT")), Metric("about", Agg("l_partkey", "COUNT_DISTINCT", approximate=True))]
    totals = Breakdown(t.lineitem, metrics, "l_suppkey", Axis("l_shipdate", "date", "year")).totals_by_label()
    real = t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("__label")).agg(F.count_distinct("l_partkey").alias("real"))
    near = F.abs(F.col("about") / F.col("real") - 1) < 0.05
    return rounded(totals.join(real, F.col("label") == F.col("__label")).withColumn("parts_near", near).drop("__label", "real", "about"), 4, "mean", "ratio")


RATIO_CALC = Calc(lambda a, b: a / b, {"a": "a", "b": "b"})


@query("label_totals_a18", """
SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS record_count, round(sum(l_extendedprice), 2) AS a,
  round(sum(l_quantity), 2) AS b, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(rounded(label_totals(cells(t), ["a", "b", "ratio"], {"ratio": RATIO_CALC}), 2, "a", "b"), 6, "ratio")


@query("calculated_row_total_a19", """
SELECT CAST(l_suppkey AS VARCHAR) AS label, round(sum(l_extendedprice) / sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1""")
def _(t):
    return rounded(row_totals(cells(t), "ratio", RATIO_CALC), 6, "total")


@query("hierarchy_nodes_a20", """
SELECT trim(l_linestatus) AS value, count(*) AS record_count FROM lineitem
WHERE l_returnflag = 'A' AND trim(l_linestatus) <> '' GROUP BY l_linestatus""")
def _(t):
    from tallyframe import Path

    path = Path(("l_returnflag", "l_linestatus")).drill("A")
    return level_nodes(t.lineitem, path.next_level, path.filters)


@query("total_records_a21", "SELECT count(*) AS total_records FROM lineitem")
def _(t):
    return total_records(Breakdown(t.lineitem, [], "l_suppkey").grouped())


@query("group_by_column_rows_a23", GROUPED_SQL + """
SELECT label, record_count, group_id, group_name, metric_id, round(value, 4) AS value FROM (
  SELECT label, record_count, 'sales' AS group_id, 'Sales' AS group_name, 'main' AS metric_id, revenue AS value FROM g
  UNION ALL SELECT label, record_count, 'sales', 'Sales', 'ratio', revenue / orders FROM g
  UNION ALL SELECT label, record_count, 'sales', 'Sales', 'free', NULL FROM g
  UNION ALL SELECT label, record_count, 'clients', 'Clients', 'main', CAST(buyers AS DOUBLE) FROM g
  UNION ALL SELECT label, record_count, 'clients', 'Clients', 'ratio', revenue / buyers FROM g
  UNION ALL SELECT label, record_count, 'clients', 'Clients', 'free', NULL FROM g)""")
def _(t):
    rows = Dashboard([SALES, CLIENTS], ["main", "ratio", "free"], CARDS).breakdown(t.orders, "o_orderpriority")
    return rounded(rows, 4, "value")
