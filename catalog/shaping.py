"""Sorts, pages, top series, pivots, chart tables and unions (O and U rows)."""

from pyspark.sql import functions as F

from catalog.aggregates import CLIENTS, GROUPED_SQL, RATIO_CALC, SALES, cells
from catalog.base import query, rounded
from tallyframe import Agg, Axis, Breakdown, Dashboard, Metric
from tallyframe.functions.text import natural_key
from tallyframe.operators.pivot import long_cells, pivot, pivot_axis, row_totals
from tallyframe.operators.views import Pages, chart_table, first_values, flatten_groups, group_rows, page, placed, row_order, sort_rows, top_series, treemap
from tallyframe.session import shared_folder
from tallyframe.sources.tables import save_dataset

QUANTITY = Metric("quantity", Agg("l_quantity"))
PART_SQL = """
WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS label, count(*) AS record_count, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
"""
CELLS_SQL = """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, strftime(date_trunc('year', l_shipdate), '%Y') AS date_label, count(*) AS record_count,
  sum(l_extendedprice) AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2)
"""


def parts(t):
    return Breakdown(t.lineitem, [QUANTITY], "l_partkey").rows(ordered=False)


@query("sort_by_metric_o1", PART_SQL + "SELECT label, record_count, nullif(quantity, 0) AS quantity, row_number() OVER (ORDER BY quantity DESC NULLS LAST, label) AS place FROM g")
def _(t):
    return placed(parts(t), row_order("quantity", descending=True))


@query("sort_by_record_count_o2", PART_SQL + "SELECT label, record_count, quantity, row_number() OVER (ORDER BY record_count, label) AS place FROM g")
def _(t):
    return placed(parts(t), row_order("record_count"))


@query("label_null_order_o3", """
SELECT label, record_count, row_number() OVER (ORDER BY label ASC NULLS LAST) AS place FROM (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS label, count(*) AS record_count FROM orders GROUP BY 1)""")
def _(t):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    counts = t.orders.groupBy(status.alias("label")).agg(F.count(F.lit(1)).alias("record_count"))
    return placed(counts, row_order("label"))


@query("natural_order_o4", """
SELECT 'Part ' || CAST(p_partkey AS VARCHAR) AS label, 'Part ' || lpad(CAST(length(CAST(p_partkey AS VARCHAR)) AS VARCHAR), 6, '0') || CAST(p_partkey AS VARCHAR) AS sort_key FROM part""")
def _(t):
    named = t.part.select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("label"))
    return sort_rows(named).withColumn("sort_key", natural_key("label").cast("string"))


@query("locale_order_o4", """
SELECT label, row_number() OVER (ORDER BY letter IN ('Ж', 'ж'), p_partkey) AS place FROM (
  SELECT p_partkey, letter, letter || ' ' || CAST(p_partkey AS VARCHAR) AS label FROM (SELECT p_partkey, ('ЖЁеёЕж')[CAST(p_partkey % 6 + 1 AS BIGINT)] AS letter FROM part))""")
def _(t):
    letter = F.substring(F.lit("ЖЁеёЕж"), (F.col("p_partkey") % 6 + 1).cast("int"), F.lit(1))
    return placed(t.part.select(F.concat(letter, F.lit(" "), F.col("p_partkey").cast("string")).alias("label")), row_order("label"))


@query("page_o5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return page(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 3)


@query("pages_of_one_result_o5", """
SELECT o_orderkey, o_orderpriority, 1 AS page FROM (SELECT * FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100)
UNION ALL SELECT o_orderkey, o_orderpriority, 12 FROM (SELECT * FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100 OFFSET 1100)""")
def _(t):
    pages = Pages(t.orders.select("o_orderkey", "o_orderpriority"), [F.desc("o_orderpriority")], 100)
    return pages.page(1).withColumn("page", F.lit(1)).unionByName(pages.page(12).withColumn("page", F.lit(12)))


@query("last_page_o5", """
SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET (SELECT greatest(ceil(count(*) / 50.0) - 1, 0) * 50 FROM customer)""")
def _(t):
    return page(t.customer.select("c_custkey", "c_name"), ["c_custkey"], 10**9)


@query("top_series_o6", CELLS_SQL + """
, top AS (SELECT label FROM c GROUP BY 1 ORDER BY sum(b) DESC, label LIMIT 8)
SELECT label, date_label, record_count, round(a, 2) AS a, round(b, 2) AS b FROM c WHERE label IN (SELECT label FROM top)""")
def _(t):
    c = cells(t).drop("ratio")
    return rounded(top_series(c, row_totals(c, "b"), "total"), 2, "a", "b")


@query("chosen_series_o6", CELLS_SQL + "SELECT label, date_label, record_count, round(a, 2) AS a, round(b, 2) AS b FROM c WHERE label IN ('3', '11')")
def _(t):
    return rounded(top_series(cells(t).drop("ratio"), None, "total", chosen=["3", "11"]), 2, "a", "b")


@query("pivot_o8", """
SELECT l_returnflag AS label, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS "O",
  round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1""")
def _(t):
    c = Breakdown(t.lineitem, [QUANTITY], "l_returnflag", Axis("l_linestatus")).rows(ordered=False)
    return rounded(pivot(c, "quantity"), 2, "F", "O", "total")


@query("pivot_of_untrimmed_labels_o8", """
SELECT l_returnflag AS label, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS "F", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS "O",
  round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1""")
def _(t):
    padded = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit(" "), "l_linestatus", F.lit("  "))).otherwise(F.col("l_linestatus"))
    c = Breakdown(t.lineitem.withColumn("s", padded), [QUANTITY], "l_returnflag", Axis("s")).rows(ordered=False)
    return rounded(pivot(c, "quantity"), 2, "F", "O", "total")


@query("long_cells_o8", """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, strftime(l_shipdate, '%Y-%m-%d') AS date_label, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
SELECT label, date_label, round(value, 2) AS value, round(sum(value) OVER (PARTITION BY label), 2) AS total, round(value / sum(value) OVER (PARTITION BY label), 8) AS share FROM c""")
def _(t):
    c = Breakdown(t.lineitem, [QUANTITY], "l_suppkey", Axis("l_shipdate", "date", "day")).rows(ordered=False)
    return rounded(rounded(long_cells(c, "quantity"), 2, "value", "total"), 8, "share")


@query("pivot_calculated_o8", """
SELECT l_returnflag AS label, round(sum(l_extendedprice) FILTER (l_linestatus = 'F') / sum(l_quantity) FILTER (l_linestatus = 'F'), 6) AS "F",
  round(sum(l_extendedprice) FILTER (l_linestatus = 'O') / sum(l_quantity) FILTER (l_linestatus = 'O'), 6) AS "O",
  round(sum(l_extendedprice) / sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1""")
def _(t):
    metrics = [Metric("a", Agg("l_extendedprice")), Metric("b", Agg("l_quantity")), Metric("ratio", {}, lambda a, b: a / b, {"a": "a", "b": "b"})]
    c = Breakdown(t.lineitem, metrics, "l_returnflag", Axis("l_linestatus")).rows(ordered=False)
    return rounded(pivot(c, "ratio", ["F", "O"], RATIO_CALC), 6, "F", "O", "total")


@query("pivot_axis_o9", """
WITH top AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT DISTINCT CASE WHEN o_orderpriority IN (SELECT * FROM top) THEN o_orderpriority ELSE 'Прочее' END AS date_label FROM orders""")
def _(t):
    return pivot_axis(Breakdown(t.orders, [], "o_orderstatus", Axis("o_orderpriority", top_n=3)).rows(ordered=False))


@query("treemap_o10", """
SELECT CAST(c_nationkey AS VARCHAR) AS name, round(sum(c_acctbal) / count(*) * 100, 4) AS value FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 0""")
def _(t):
    metric = Metric("m", {"a": ("c_acctbal", "SUM"), "n": ("c_custkey", "COUNT")}, lambda a, n: a / n, fmt="percent")
    return rounded(treemap(Breakdown(t.customer, [metric], "c_nationkey").rows(ordered=False), "m", "percent"), 4, "value")


@query("chart_table_o11", """
SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS mean, round(coalesce(sum(o_totalprice) FILTER (o_orderkey < 0), 0), 2) AS lacking,
  CAST(100000 AS DOUBLE) AS threshold FROM orders GROUP BY 1""")
def _(t):
    rows = Breakdown(t.orders.withColumn("none", F.when(F.col("o_orderkey") < 0, 1.0)), [
        Metric("mean", Agg("o_totalprice", "AVG")), Metric("lacking", Agg("none")),
    ], "o_orderpriority").rows(ordered=False)
    return rounded(chart_table(rows, ["mean", "lacking"], thresholds={"threshold": 100_000}), 4, "mean")


@query("append_batches_u1", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    folder = shared_folder(t.spark)
    save_dataset(t.customer.select("c_custkey", "c_name", "c_acctbal"), folder)
    return save_dataset(t.supplier.toDF("c_custkey", "c_name", "x", "c_acctbal").drop("x"), folder, append=True)


@query("repeated_batches_u1", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    folder = shared_folder(t.spark)
    for status in ("F", "O", "F", "P", "O"):  # a batch that comes again adds nothing
        back = save_dataset(t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"), folder, append=True, batch=status)
    return back


@query("group_breakdowns_union_u2", GROUPED_SQL + """
SELECT 'Sales · ' || label AS label, record_count, 'sales' AS group_id, 'Sales' AS group_name, 'main' AS metric_id, round(revenue, 2) AS value FROM g
UNION ALL SELECT 'Clients · ' || label, record_count, 'clients', 'Clients', 'main', CAST(buyers AS DOUBLE) FROM g""")
def _(t):
    long = Dashboard([SALES, CLIENTS], ["main"]).breakdown(t.orders, "o_orderpriority")
    return rounded(flatten_groups(long, 2), 2, "value")


@query("groups_as_rows_u2", """
SELECT 'Sales' AS label, count(*) AS record_count, 'sales' AS group_id, 'Sales' AS group_name, 'main' AS metric_id, round(sum(o_totalprice), 2) AS value FROM orders
UNION ALL SELECT 'Clients', count(*), 'clients', 'Clients', 'main', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders""")
def _(t):
    return rounded(group_rows(Dashboard([SALES, CLIENTS], ["main"]).summary(t.orders)), 2, "value")


@query("distinct_metrics_u3", """
SELECT 'main' AS metric_id, round(sum(o_totalprice), 2) AS value FROM orders
UNION ALL SELECT 'ratio', round(sum(o_totalprice) / count(o_orderkey), 2) FROM orders""")
def _(t):
    long = Dashboard([SALES, CLIENTS], ["main", "ratio"]).summary(t.orders)
    return rounded(first_values(long, F.when(F.col("group_id") == "sales", 0).otherwise(1)), 2, "value")
