"""Filters, drill-down paths and display filters (F rows)."""

from pyspark.sql import functions as F

from catalog.aggregates import RATIO_CALC, cells
from catalog.base import query, rounded
from tallyframe import Agg, Breakdown, DisplayRule, Filter, Metric, Path
from tallyframe.functions.display import cell_text
from tallyframe.operators.filters import apply_filters, classify, select_visible
from tallyframe.operators.lookup import resolve_names
from tallyframe.operators.views import display_filter, display_filter_2d, search

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
PICK = "SELECT " + ", ".join(ORDER_COLUMNS) + " FROM orders "


def chosen(t, *filters):
    return apply_filters(t.orders, filters).select(*ORDER_COLUMNS)


@query("conjunction_f1", PICK + "WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    return chosen(t, Filter("o_orderstatus", "F"), Filter("o_orderpriority", "1-URGENT", None))


@query("comparisons_f2", PICK + "WHERE o_totalprice > 100000 AND o_custkey <= 1000 AND o_orderstatus <> 'P' AND o_orderdate >= '1996-01-01' AND o_orderkey < 12000 AND o_custkey != 77")
def _(t):
    return chosen(
        t, Filter("o_totalprice", "100000", ">"), Filter("o_custkey", "1000", "<="), Filter("o_orderstatus", "P", "<>"),
        Filter("o_orderdate", "1996-01-01", ">="), Filter("o_orderkey", 12000, "<"), Filter("o_custkey", "77", "!="),
    )


@query("comparison_with_bad_literal_f2", PICK + "WHERE o_totalprice > TRY_CAST('abc' AS DOUBLE)")
def _(t):
    return chosen(t, Filter("o_totalprice", "abc", ">"))


@query("like_f3", PICK + "WHERE o_orderpriority LIKE '%URGENT' OR FALSE")
def _(t):
    return chosen(t, Filter("o_orderpriority", "%URGENT", "LIKE"))


@query("ilike_f3", PICK + "WHERE o_orderpriority ILIKE '%medium'")
def _(t):
    return chosen(t, Filter("o_orderpriority", "%medium", "ilike"))


@query("between_f4", PICK + "WHERE o_totalprice BETWEEN 50000 AND 90000")
def _(t):
    return chosen(t, Filter("o_totalprice", "50000", "between", "90000"))


@query("unknown_operator_and_column_f5", PICK + "WHERE o_orderstatus = 'O'")
def _(t):
    return chosen(t, Filter("o_orderstatus", "O", "~*"), Filter("no_such_column", 1, ">"))


@query("drill_down_f7", """
SELECT o_orderpriority AS label, count(*) AS record_count, round(sum(o_totalprice), 2) AS revenue
FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def _(t):
    path = Path(("o_orderstatus", "o_orderpriority", "o_custkey")).drill("F").drill("5-LOW").drill("O", level=0)
    rows = Breakdown(t.orders, [Metric("revenue", Agg("o_totalprice"))], path.next_level, filters=path.filters).rows()
    return rounded(rows, 2, "revenue")


SHARE = [Metric("big", {"a": ("l_quantity", "SUM"), "b": ("l_extendedprice", "SUM")}, lambda a, b: a / b, fmt="percent"),
         Metric("quantity", Agg("l_quantity")), Metric("lines", Agg("l_orderkey", "COUNT"))]
SHARE_SQL = """
WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS record_count, sum(l_quantity) / sum(l_extendedprice) AS big,
  sum(l_quantity) AS quantity, CAST(count(l_orderkey) AS DOUBLE) AS lines FROM lineitem GROUP BY 1)
SELECT label, record_count, round(big, 9) AS big, round(quantity, 2) AS quantity, lines FROM g """


def shares(t):
    return Breakdown(t.lineitem, SHARE, "l_suppkey").rows(ordered=False)


@query("display_filter_f8", SHARE_SQL + "WHERE big * 100 > 0.05 AND quantity BETWEEN 10000 AND 16000")
def _(t):
    rules = [DisplayRule("big", ">", 0.05), DisplayRule("quantity", "between", 16000, 10000), DisplayRule("lines", "<", 0, level=2)]
    return rounded(rounded(display_filter(shares(t), rules, {"big": "percent"}), 9, "big"), 2, "quantity")


@query("metric_versus_metric_f9", SHARE_SQL + "WHERE quantity - lines * 25 > greatest(1.0, abs(quantity), abs(lines * 25)) * 1e-9")
def _(t):
    rows = shares(t).withColumn("expected", F.col("lines") * 25)
    out = display_filter(rows, [DisplayRule("quantity", ">", compare="expected")]).drop("expected")
    return rounded(rounded(out, 9, "big"), 2, "quantity")


@query("two_axis_display_filter_f11", """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, strftime(date_trunc('year', l_shipdate), '%Y') AS date_label, count(*) AS record_count,
  sum(l_extendedprice) AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2)
SELECT label, date_label, record_count, round(a, 2) AS a, round(b, 2) AS b, round(a / b, 6) AS ratio FROM c
WHERE label IN (SELECT label FROM c GROUP BY 1 HAVING sum(a) / sum(b) > 2100)""")
def _(t):
    out = display_filter_2d(cells(t), [DisplayRule("ratio", ">", 2100)], ["a", "b", "ratio"], calcs={"ratio": RATIO_CALC})
    return rounded(rounded(out, 2, "a", "b"), 6, "ratio")


@query("search_f12", """
SELECT CAST(c_nationkey AS VARCHAR) AS label, n_name AS name, count(*) AS record_count FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1, 2 HAVING contains(lower(CAST(c_nationkey AS VARCHAR)), 'ion_1') OR contains(lower(n_name), 'ion_1')""")
def _(t):
    names = t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    rows = resolve_names(Breakdown(t.customer, [], "c_nationkey").rows(ordered=False), names)
    return search(rows, "ION_1", "name").select("label", "name", "record_count")


@query("cell_text_f13", r"""
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '—' ELSE o_orderstatus END AS status,
  CASE WHEN o_totalprice > 200000 THEN '✓' ELSE '✗' END AS large,
  regexp_replace(regexp_replace(replace(replace(replace(format('{:,.4f}', o_totalprice), ',', ' '), '.', ','), ' ', chr(160)), '(,\d*?)0+$', '\1'), ',$', '') AS price
FROM orders""")
def _(t):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = t.orders.withColumns({"s": status, "b": F.col("o_totalprice") > 200000})
    return rows.select(
        F.col("o_orderkey").alias("id"), cell_text("s", "string").alias("status"),
        cell_text("b", "boolean").alias("large"), cell_text("o_totalprice", "double").alias("price"),
    )


@query("visible_columns_f14", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(t):
    return select_visible(classify(t.customer, {"c_acctbal": "ignore", "c_name": "categorical"}))


@query("ignored_column_gives_null_f14", """
SELECT c_mktsegment AS label, count(*) AS record_count, CAST(NULL AS DOUBLE) AS balance FROM customer GROUP BY 1""")
def _(t):
    hidden = classify(t.customer, {"c_acctbal": "ignore"})
    return Breakdown(hidden, [Metric("balance", Agg("c_acctbal"))], "c_mktsegment").rows()
