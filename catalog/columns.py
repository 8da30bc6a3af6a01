"""Whole-column computations: references, shares, carries, runs, changes (W rows)."""

from pyspark.sql import functions as F

from catalog.base import query, rounded
from tallyframe import Agg, Axis, Breakdown, Metric
from tallyframe.functions.numeric import finite
from tallyframe.operators.normalize import axis_domain, column_reference, heat_map, normalize, normalize_by_period, reference
from tallyframe.operators.pivot import row_totals, total_shares
from tallyframe.operators.report import carry_forward
from tallyframe.operators.series import best_ranked, merge_close_values, with_change

QUANTITY = Metric("quantity", Agg("l_quantity"))
PRICE = Metric("price", Agg("l_extendedprice"))
ROWS_SQL = """
WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS record_count, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1)
"""
CELLS_SQL = """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, strftime(date_trunc('year', l_shipdate), '%Y') AS date_label, count(*) AS record_count,
  sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
"""


def rows(t):
    return Breakdown(t.lineitem, [QUANTITY, PRICE], "l_suppkey").rows(ordered=False)


def cells(t):
    return Breakdown(t.lineitem, [QUANTITY], "l_suppkey", Axis("l_shipdate", "date", "year")).rows(ordered=False)


@query("column_reference_w1", ROWS_SQL + """
SELECT round(sum(quantity), 2) AS total, max(quantity) AS max, min(quantity) AS min, round(avg(quantity), 4) AS mean FROM g""")
def _(t):
    refs = [reference("quantity", b).alias(b) for b in ("total", "max", "min", "mean")]
    return rounded(rounded(rows(t).agg(*refs), 2, "total"), 4, "mean")


@query("column_reference_of_missing_w1", "SELECT CAST(NULL AS DOUBLE) AS reference")
def _(t):
    gone = t.orders.select(F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("v"))
    return column_reference(gone, "v", "total")


@query("share_of_column_w2", ROWS_SQL + "SELECT label, record_count, round(quantity / (SELECT max(quantity) FROM g), 8) AS quantity FROM g")
def _(t):
    return rounded(normalize(rows(t).drop("price"), {"quantity": "max"}), 8, "quantity")


@query("normalised_metrics_w3", ROWS_SQL + """
SELECT label, record_count, round(quantity / (SELECT sum(quantity) FROM g), 8) AS quantity, round(price, 2) AS price,
  replace(regexp_replace(regexp_replace(format('{:.1f}', round(quantity / (SELECT sum(quantity) FROM g) * 100, 1)), '0+$', ''), '\\.$', ''), '.', ',') || '%' AS quantity_text FROM g""")
def _(t):
    return rounded(rounded(normalize(rows(t), {"quantity": "total"}, text=True), 8, "quantity"), 2, "price")


@query("share_of_period_w4", CELLS_SQL + """
SELECT label, date_label, record_count, round(quantity / sum(quantity) OVER (PARTITION BY date_label), 8) AS quantity FROM c""")
def _(t):
    return rounded(normalize_by_period(cells(t), "quantity", "total"), 8, "quantity")


@query("share_of_grand_total_w5", CELLS_SQL + """
, r AS (SELECT label, sum(quantity) AS total FROM c GROUP BY 1)
SELECT label, round(total, 2) AS total, round(total / (SELECT sum(total) FROM r), 8) AS share FROM r""")
def _(t):
    return rounded(rounded(total_shares(row_totals(cells(t), "quantity")), 2, "total"), 8, "share")


@query("heat_map_w6", CELLS_SQL + """
, e AS (SELECT min(quantity) AS lo, max(quantity) AS hi FROM c)
SELECT label, date_label, record_count, round(quantity, 2) AS quantity, round(0.06 + 0.64 * (quantity - lo) / (hi - lo), 6) AS heat FROM c, e""")
def _(t):
    return rounded(rounded(heat_map(cells(t), "quantity"), 2, "quantity"), 6, "heat").drop("heat_color")


@query("axis_domain_w7", ROWS_SQL + """
, e AS (SELECT min(least(quantity, price)) AS lo, max(greatest(quantity, price)) AS hi FROM g)
SELECT round(lo - (hi - lo) * 0.08, 2) AS low, round(hi + (hi - lo) * 0.08, 2) AS high FROM e""")
def _(t):
    return rounded(axis_domain(rows(t), ["quantity", "price"]), 2, "low", "high")


@query("carry_forward_w8", """
SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 97 = 0 THEN o_orderstatus WHEN o_orderkey % 1009 = 5 THEN '' END IGNORE NULLS)
  OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS carried FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    event = F.when(k % 97 == 0, F.col("o_orderstatus")).when(k % 1009 == 5, "")
    lines = t.orders.select(F.col("o_orderpriority").alias("file_id"), k.alias("row_idx"), "o_orderkey", "o_orderstatus")
    return carry_forward(lines, {"carried": event}, block=1000).select("o_orderkey", "carried")


@query("close_values_w10", """
WITH p AS (SELECT l_returnflag AS metric, l_linestatus AS member, l_extendedprice AS value FROM lineitem),
s AS (SELECT metric, (max(value) - min(value)) * 0.0005 AS tol FROM p GROUP BY 1),
o AS (SELECT p.*, CASE WHEN value - lag(value) OVER (PARTITION BY p.metric ORDER BY value) <= tol THEN 0 ELSE 1 END AS starts FROM p JOIN s ON p.metric = s.metric),
i AS (SELECT *, sum(starts) OVER (PARTITION BY metric ORDER BY value ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT metric, min(value) AS low, max(value) AS high, round(avg(value), 7) AS y, count(DISTINCT (member, value)) AS members,
  count(DISTINCT (member, value)) > 1 AS is_overlap FROM i GROUP BY metric, run""")
def _(t):
    points = t.lineitem.select(
        F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("member"), F.col("l_extendedprice").alias("value")
    )
    return rounded(merge_close_values(points, 0.05), 7, "y")


@query("best_ranked_w11", """
SELECT label, record_count, quantity, rank FROM (SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS record_count, sum(l_quantity) AS quantity,
  rank() OVER (ORDER BY sum(l_quantity) DESC) AS rank FROM lineitem GROUP BY 1) WHERE rank <= 25""")
def _(t):
    return best_ranked(Breakdown(t.lineitem, [QUANTITY], "l_partkey").rows(ordered=False), "quantity", 25)


CHANGE_SQL = """
WITH c AS (SELECT o_orderpriority AS label, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS date_label, count(*) AS record_count,
  sum(o_totalprice) AS revenue FROM orders GROUP BY 1, 2),
"""


def monthly(t):
    return Breakdown(t.orders, [Metric("revenue", Agg("o_totalprice"))], "o_orderpriority", Axis("o_orderdate", "date", "month")).rows(ordered=False)


def change_rounded(df):
    return rounded(rounded(df, 2, "revenue", "previous_value", "change"), 6, "change_percent")


CHANGE_OUT = """
SELECT label, date_label, record_count, round(revenue, 2) AS revenue, round(p, 2) AS previous_value, round(revenue - p, 2) AS change,
  round((revenue - p) / p * 100, 6) AS change_percent FROM x"""


@query("change_from_previous_w12", CHANGE_SQL + "x AS (SELECT *, lag(revenue) OVER (PARTITION BY label ORDER BY date_label) AS p FROM c)" + CHANGE_OUT)
def _(t):
    return change_rounded(with_change(monthly(t), "revenue"))


@query("change_from_year_ago_w12", CHANGE_SQL + """
x AS (SELECT c.*, b.revenue AS p FROM c LEFT JOIN c b ON b.label = c.label
  AND c.date_label = CAST(CAST(left(b.date_label, 4) AS INT) + 1 AS VARCHAR) || substr(b.date_label, 5))""" + CHANGE_OUT)
def _(t):
    return change_rounded(with_change(monthly(t), "revenue", "year_ago"))


@query("non_finite_is_missing_w1", "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 3 = 0")
def _(t):
    k = F.col("o_orderkey") % 3
    v = F.when(k == 0, F.col("o_totalprice")).when(k == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return t.orders.select(finite(v).alias("v")).agg(F.round(reference("v", "total"), 2).alias("total"))
