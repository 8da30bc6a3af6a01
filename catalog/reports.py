"""Report tables with embedded subtotals (H rows), built from the region, nation and customer tables."""

from pyspark.sql import DataFrame, functions as F

from catalog.base import joined, query, rounded
from tallyframe import Agg, Axis, Breakdown, Calc, DisplayRule, GroupView, Layout, Metric, Path, import_report
from tallyframe.operators import report as R

HEADER = ("region", "nation", "segment", "client", "balance", "customers")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
LAYOUT = Layout((0, 1, 2, 3), empty_tokens=("н/д",))
COLUMNS = R.report_columns([HEADER], (0, 1, 2, 3), (4, 5))
METRICS = {"balance": "balance", "customers": "customers"}
# rows of one report in order: region, nation, segment, customer
PLACE = 10**12


def leaves(t) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )


def cells(*values):
    """Cells split from one line of text, as a file reader gives them."""
    line = F.concat_ws("|", *[v if not isinstance(v, str) else F.lit(v) for v in values])
    return F.split(line, r"\|", -1).alias("cells")


def whole(c):
    return c.cast("bigint").cast("string")


def matrix(t) -> DataFrame:
    """One report file in outline form: a row fills only the key of its own level.

    All subtotal rows come from one aggregation by grouping sets.
    """
    base = leaves(t).select("r_regionkey", "r_name", "n_nationkey", "n_name", "c_mktsegment", "c_custkey", "c_name", "c_acctbal")
    region, nation, segment = ["r_regionkey", "r_name"], ["n_nationkey", "n_name"], ["c_mktsegment"]
    sets = [[], region, region + nation, region + nation + segment]
    subtotals = base.groupingSets(sets, *region, *nation, *segment).agg(
        F.sum(F.floor("c_acctbal")).alias("s"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("missing")
    )
    # bits of the grouping id: segment 1, nation 2 and 4, region 8 and 16
    missing = F.col("missing")
    subtotals = subtotals.withColumn("level", F.when(missing == 0, 2).when(missing == 1, 1).when(missing == 7, 0).otherwise(-1))
    level = F.col("level")

    def place(level_place):
        nation_place = F.when(level_place > 0, F.col("n_nationkey") + 1).otherwise(0)
        segment_place = F.when(level_place > 1, F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))).otherwise(0)
        return ((F.col("r_regionkey").cast("bigint") * 100 + nation_place) * 10 + segment_place) * PLACE + 1

    def at(n, value):
        return F.when(level == n, value).otherwise("")

    off = F.when(F.col("n_nationkey") % 3 == 1, 100).otherwise(0)
    balance = F.when(level == 1, F.when(F.col("n_nationkey") % 3 == 0, "н/д").otherwise(whole(F.col("s") + off)))
    balance = F.coalesce(balance, F.when(level != 0, whole(F.col("s"))), F.lit(""))
    customers = F.when(level == 0, whole(F.col("n") + F.col("r_regionkey") % 2)).when(level == 1, "").otherwise(whole(F.col("n")))
    nodes = subtotals.select(
        F.when(level < 0, F.lit(10**17)).otherwise(place(level)).alias("row_idx"),
        cells(F.when(level < 0, "Итого").otherwise(at(0, F.col("r_name"))), at(1, F.col("n_name")), at(2, F.col("c_mktsegment")), "", balance, customers),
    )
    clients = base.select(
        (place(F.lit(2)) + F.col("c_custkey") + 1).alias("row_idx"),
        cells("", "", "", F.col("c_name"), F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")), "1"),
    )
    header = t.spark.range(1).select(F.lit(0).cast("bigint").alias("row_idx"), cells(*HEADER))
    rows = header.union(nodes).union(clients)
    return rows.select(F.lit("report").alias("file_id"), "row_idx", "cells")


def report_nodes(t) -> DataFrame:
    return R.extract_nodes(matrix(t), LAYOUT, COLUMNS)


def rolled(t) -> DataFrame:
    return R.roll_up(R.node_values(report_nodes(t)), 4)


LEAVES_SQL = """
WITH leaves AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
NODES_SQL = LEAVES_SQL + """
, nodes AS (
  SELECT r_name AS path, 0 AS level, r_name AS label, FALSE AS is_total, CAST(NULL AS DOUBLE) AS balance,
    CAST(count(*) + r_regionkey % 2 AS DOUBLE) AS customers FROM leaves GROUP BY r_name, r_regionkey
  UNION ALL SELECT r_name || '/' || n_name, 1, n_name, FALSE,
    CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(sum(floor(c_acctbal)) + CASE WHEN n_nationkey % 3 = 1 THEN 100 ELSE 0 END AS DOUBLE) END, NULL
    FROM leaves GROUP BY r_name, n_name, n_nationkey
  UNION ALL SELECT r_name || '/' || n_name || '/' || c_mktsegment, 2, c_mktsegment, FALSE, CAST(sum(floor(c_acctbal)) AS DOUBLE), CAST(count(*) AS DOUBLE)
    FROM leaves GROUP BY r_name, n_name, c_mktsegment
  UNION ALL SELECT 'Итого', 0, 'Итого', TRUE, CAST(sum(floor(c_acctbal)) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM leaves)
"""
ROLLED_SQL = NODES_SQL + """
, long AS (SELECT path, level, is_total, 'balance' AS col, balance AS own FROM nodes UNION ALL SELECT path, level, is_total, 'customers', customers FROM nodes)
, r2 AS (SELECT path, col, own, CAST(NULL AS DOUBLE) AS children_sum, own AS value FROM long WHERE level = 2)
, r1 AS (SELECT l.path, l.col, l.own, s.children_sum, coalesce(l.own, s.children_sum) AS value FROM long l
    LEFT JOIN (SELECT regexp_replace(path, '/[^/]*$', '') AS path, col, sum(value) AS children_sum FROM r2 GROUP BY 1, 2) s USING (path, col) WHERE level = 1)
, r0 AS (SELECT l.path, l.col, l.own, s.children_sum, coalesce(l.own, s.children_sum) AS value FROM long l
    LEFT JOIN (SELECT regexp_replace(path, '/[^/]*$', '') AS path, col, sum(value) AS children_sum FROM r1 GROUP BY 1, 2) s USING (path, col) WHERE level = 0)
, rolled AS (SELECT * FROM r2 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r0
    UNION ALL SELECT '' AS path, col, NULL, sum(value), sum(value) FROM r0 WHERE path <> 'Итого' GROUP BY col)
"""


def code_matrix(t) -> DataFrame:
    """Files of order rows: a code, a text, a price with some gaps, a time-like code."""
    price = F.when(F.col("o_orderkey") % 5 == 0, "н/д").otherwise(F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")))
    return t.orders.select(
        F.col("o_orderstatus").alias("file_id"), (F.col("o_orderkey") + 1).alias("row_idx"),
        cells(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.col("o_orderpriority"), price, F.concat_ws(":", F.lit("8"), F.col("o_custkey").cast("string"))),
    )


@query("empty_cells_h1", """
SELECT o_orderkey, o_orderkey % 4 < 3 AS is_empty FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.lit("  ")).when(k == 1, F.lit(" Н/Д ")).when(k == 3, F.lit("0"))
    return t.orders.select("o_orderkey", R.is_empty(cell, ["н/д"]).alias("is_empty"))


@query("metric_columns_h2", """
WITH f AS (SELECT o_orderstatus AS file_id, count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS filled,
  count(*) FILTER (length(CAST(o_custkey AS VARCHAR)) >= 6) AS wide FROM orders GROUP BY 1)
SELECT file_id, 0 AS pos, n AS filled, wide AS numbers, wide / n > 0.6 AS is_metric FROM f
UNION ALL SELECT file_id, 1, n, 0, FALSE FROM f UNION ALL SELECT file_id, 2, filled, filled, filled > 0 FROM f
UNION ALL SELECT file_id, 3, n, 0, FALSE FROM f""")
def _(t):
    return R.column_scores(code_matrix(t), 1, ["н/д"])


@query("header_rows_h3", """
SELECT CAST(c_custkey AS VARCHAR) AS file_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 2 ELSE 1 END AS header_rows FROM customer""")
def _(t):
    even = F.col("c_custkey") % 2 == 0
    first = F.when(even, F.array(*map(F.lit, ["", "A", "", ""]))).otherwise(F.array(*map(F.lit, "xyzw")))
    names, data = F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "1234"))
    rows = F.when(F.col("c_custkey") % 3 == 0, F.array(first, names)).otherwise(F.array(first, names, data))
    files = t.customer.select(F.col("c_custkey").cast("string").alias("file_id"), F.posexplode(rows).alias("row_idx", "cells"))
    return R.detect_header_rows(files)


@query("key_columns_h4", "SELECT DISTINCT o_orderstatus AS file_id, 2 AS key_count FROM orders")
def _(t):
    return R.detect_key_columns(code_matrix(t), 1, ["н/д"])


@query("row_classes_h6", LEAVES_SQL + """
, rows AS (SELECT 'node' AS kind, 0 AS level, r_name AS label FROM leaves GROUP BY r_name
  UNION ALL SELECT 'node', 1, n_name FROM leaves GROUP BY r_name, n_name
  UNION ALL SELECT 'node', 2, c_mktsegment FROM leaves GROUP BY r_name, n_name, c_mktsegment
  UNION ALL SELECT 'leaf', 3, c_name FROM leaves UNION ALL SELECT 'total', 0, 'Итого')
SELECT kind, level, label, count(*) AS n FROM rows GROUP BY 1, 2, 3""")
def _(t):
    return R.classify_rows(matrix(t), LAYOUT).groupBy("kind", "level", "label").agg(F.count(F.lit(1)).alias("n"))


@query("flatten_leaves_h7", LEAVES_SQL + """
SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, c_name AS client, c_acctbal AS balance, CAST(1 AS DOUBLE) AS customers FROM leaves""")
def _(t):
    return R.flatten_leaves(matrix(t), LAYOUT, COLUMNS).drop("file_id", "row_idx")


@query("extract_nodes_h8", NODES_SQL + "SELECT * FROM nodes")
def _(t):
    v = F.col("values")
    return report_nodes(t).select(
        joined("path").alias("path"), "level", "label", "is_total", v["balance"].alias("balance"), v["customers"].alias("customers")
    )


@query("hierarchy_preview_h9", LEAVES_SQL + """
SELECT r_name AS path, '' AS parent, r_name AS label, 0 AS level FROM leaves GROUP BY r_name
UNION ALL SELECT r_name || '/' || n_name, r_name, n_name, 1 FROM leaves GROUP BY r_name, n_name
UNION ALL SELECT r_name || '/' || n_name || '/' || c_mktsegment, r_name || '/' || n_name, c_mktsegment, 2 FROM leaves GROUP BY r_name, n_name, c_mktsegment
UNION ALL SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name, r_name || '/' || n_name || '/' || c_mktsegment, c_name, 3 FROM leaves
  GROUP BY r_name, n_name, c_mktsegment, c_name""")
def _(t):
    rows = leaves(t).select(
        F.lit("report").alias("file_id"), (F.col("c_custkey") + 1).alias("row_idx"),
        cells(F.col("r_name"), F.col("n_name"), F.col("c_mktsegment"), F.col("c_name")),
    )
    nodes = R.hierarchy_preview(rows, LAYOUT, max_nodes=None)
    return nodes.select(joined("path").alias("path"), joined("parent").alias("parent"), "label", "level")


@query("metric_cells_h11", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(1234567.5 AS DOUBLE) END AS value FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 4
    price = F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    cell = F.when(k == 0, price).when(k == 1, "1 234 567,5").when(k == 2, "нет данных").otherwise("-")
    return t.orders.select("o_orderkey", R.parse_metric(cell, ["-"]).alias("value"))


@query("roll_up_h12", ROLLED_SQL + """SELECT path, col AS "column", value, own, children_sum FROM rolled WHERE path <> ''""")
def _(t):
    return rolled(t).where(F.size("path") > 0).select(joined("path").alias("path"), "column", "value", "own", "children_sum")


@query("synthetic_root_h13", ROLLED_SQL + """SELECT col AS "column", value, own, children_sum FROM rolled WHERE path = ''""")
def _(t):
    return rolled(t).where(F.size("path") == 0).drop("path")


HEADER_GROUPS = R.report_columns(
    [["", "Open", "", "Closed", ""], ["flag", "quantity", "price", "quantity", "price"]], (0,), (1, 2, 3, 4)
)


@query("header_groups_h14", """
WITH g AS (SELECT l_returnflag AS label, count(*) AS record_count,
  sum(l_quantity) FILTER (l_linestatus = 'O') AS oq, sum(l_extendedprice) FILTER (l_linestatus = 'O') AS op,
  sum(l_quantity) FILTER (l_linestatus = 'F') AS fq, sum(l_extendedprice) FILTER (l_linestatus = 'F') AS fp FROM lineitem GROUP BY 1)
SELECT label, record_count, round(op, 2) AS open_price, round(op / oq, 6) AS open_unit, round(fp, 2) AS closed_price, round(fp / fq, 6) AS closed_unit FROM g""")
def _(t):
    opened = F.col("l_linestatus") == "O"
    wide = t.lineitem.select(
        F.col("l_returnflag").alias("flag"),
        F.when(opened, F.col("l_quantity")).alias("Open · quantity"), F.when(opened, F.col("l_extendedprice")).alias("Open · price"),
        F.when(~opened, F.col("l_quantity")).alias("Closed · quantity"), F.when(~opened, F.col("l_extendedprice")).alias("Closed · price"),
    )
    groups = R.groups_by_header(
        HEADER_GROUPS, [R.Indicator("quantity", service_only=True)],
        [R.CalculatedIndicator("unit", lambda p, q: p / q, {"p": "price", "q": "quantity"}),
         R.CalculatedIndicator("lacking", lambda p, x: p / x, {"p": "price", "x": "no such indicator"})],
    )
    rows = Breakdown(wide, groups, "flag").rows()
    names = {f"{g}__{m}": f"{g.lower()}_{m}" for g in ("Open", "Closed") for m in ("price", "unit")}
    rows = rows.withColumnsRenamed(names)
    return rounded(rounded(rows, 2, "open_price", "closed_price"), 6, "open_unit", "closed_unit")


PER_CUSTOMER = Calc(lambda a, b: a / b, {"a": "balance", "b": "customers"})


@query("entered_by_column_h15", ROLLED_SQL + """
SELECT path, max(value) FILTER (col = 'balance') AS money, max(value) FILTER (col = 'customers') AS people FROM rolled GROUP BY 1""")
def _(t):
    out = R.entered_values(rolled(t), {"money": "balance", "people": "customers"})
    return out.withColumn("path", joined("path"))


@query("entered_formula_h16", ROLLED_SQL + """
SELECT path, round(coalesce(max(value) FILTER (col = 'balance'), 0) / nullif(coalesce(max(value) FILTER (col = 'customers'), 0), 0), 6) AS mean,
  CAST(NULL AS DOUBLE) AS lacking FROM rolled GROUP BY 1""")
def _(t):
    lacking = Calc(lambda a, x: a / x, {"a": "balance", "x": "no such column"})
    out = R.entered_values(rolled(t), {}, {"mean": PER_CUSTOMER, "lacking": lacking})
    return rounded(out.withColumn("path", joined("path")), 6, "mean")


OVERLAY_SQL = NODES_SQL + """
, rows AS (SELECT r_name AS label, count(*) AS record_count, sum(c_acctbal) AS balance, CAST(count(c_custkey) AS DOUBLE) AS customers FROM leaves GROUP BY 1)
, shown AS (SELECT r.label, r.record_count, coalesce(n.balance, r.balance) AS balance, coalesce(n.customers, r.customers) AS customers,
  n.balance IS NOT NULL AS balance_from_node, n.customers IS NOT NULL AS customers_from_node FROM rows r LEFT JOIN nodes n ON n.path = r.label)
"""


def own_values(t):
    own = R.node_values(report_nodes(t)).withColumn("value", F.col("own"))
    return R.entered_values(own, METRICS)


REGION_METRICS = [Metric("balance", Agg("c_acctbal")), Metric("customers", Agg("c_custkey", "COUNT"))]


@query("overlay_h17", OVERLAY_SQL + """
SELECT label, record_count, round(balance, 2) AS balance, customers, balance_from_node, customers_from_node FROM shown""")
def _(t):
    rows = Breakdown(leaves(t), REGION_METRICS, "r_name").rows(ordered=False)
    return rounded(R.overlay(rows, own_values(t), ["balance", "customers"]), 2, "balance")


@query("discrepancies_h18", ROLLED_SQL + """
, pairs AS (SELECT path, max(own) FILTER (col = 'balance') AS ob, max(children_sum) FILTER (col = 'balance') AS cb,
  max(own) FILTER (col = 'customers') AS oc, max(children_sum) FILTER (col = 'customers') AS cc FROM rolled WHERE own IS NOT NULL AND children_sum IS NOT NULL GROUP BY 1)
SELECT path, metric, round(own, 6) AS own, round(children_sum, 6) AS children_sum FROM (
  SELECT path, 'balance' AS metric, ob AS own, cb AS children_sum FROM pairs UNION ALL SELECT path, 'customers', oc, cc FROM pairs
  UNION ALL SELECT path, 'mean', ob / oc, cb / cc FROM pairs WHERE ob IS NOT NULL AND oc IS NOT NULL) WHERE abs(own - children_sum) > 1e-9""")
def _(t):
    out = R.discrepancies(rolled(t), METRICS, {"mean": PER_CUSTOMER})
    return rounded(out.withColumn("path", joined("path")), 6, "own", "children_sum")


@query("view_order_h19", OVERLAY_SQL + """
, kept AS (SELECT * FROM shown WHERE customers > 300)
SELECT label, record_count, round(balance / (SELECT sum(balance) FROM kept), 8) AS balance, customers, balance_from_node, customers_from_node FROM kept""")
def _(t):
    base = leaves(t)
    metrics = [Metric("balance", Agg("c_acctbal"), normalize_by="total"), REGION_METRICS[1]]
    view = GroupView(metrics, [DisplayRule("customers", ">", 300)], "customers")
    return rounded(view.rows(base, Path(("r_name", "n_name")), own_values(t)), 8, "balance")


@query("view_two_axes_h19", """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, strftime(date_trunc('year', l_shipdate), '%Y') AS date_label, count(*) AS record_count, sum(l_quantity) AS quantity
  FROM lineitem GROUP BY 1, 2)
, kept AS (SELECT * FROM c WHERE label IN (SELECT label FROM c GROUP BY 1 HAVING sum(quantity) > 1000))
SELECT label, date_label, record_count, round(quantity / sum(quantity) OVER (PARTITION BY date_label), 8) AS quantity FROM kept""")
def _(t):
    metrics = [Metric("quantity", Agg("l_quantity"), normalize_by="total")]
    view = GroupView(metrics, [DisplayRule("quantity", ">", 1000)], "quantity", axis=Axis("l_shipdate", "date", "year"))
    return rounded(view.rows(t.lineitem, Path(("l_suppkey",))), 8, "quantity")


@query("report_import_h7_h12", ROLLED_SQL + """
SELECT path, col AS "column", value FROM rolled
UNION ALL SELECT 'leaves', 'balance', round(sum(c_acctbal), 2) FROM leaves""")
def _(t):
    report = import_report(matrix(t), LAYOUT)
    total = report.leaves.agg(F.round(F.sum("balance"), 2).alias("value"))
    total = total.select(F.lit("leaves").alias("path"), F.lit("balance").alias("column"), "value")
    return report.rolled.select(joined("path").alias("path"), "column", "value").union(total)


FILES_LAYOUT = Layout((0, 1, 2))


def files_matrix(t) -> DataFrame:
    """Three files with the same nodes and their own values: regions, some without a value, over nations."""
    base = leaves(t).withColumn("file_id", F.concat(F.lit("file"), (F.col("c_custkey") % 3).cast("string")))
    nations = base.groupBy("file_id", "r_regionkey", "r_name", "n_nationkey", "n_name").agg(F.sum(F.floor("c_acctbal")).alias("s"))
    regions = nations.groupBy("file_id", "r_regionkey", "r_name").agg(F.max(F.substring("file_id", 5, 1).cast("int")).alias("f"))
    place = F.col("r_regionkey").cast("bigint") * 1000 + 10
    own = F.when(F.col("r_regionkey") % 2 == 1, (1000 * F.col("f") + F.col("r_regionkey")).cast("string")).otherwise("")
    rows = regions.select("file_id", place.alias("row_idx"), cells(F.col("r_name"), "", "", own))
    rows = rows.union(nations.select("file_id", (place + F.col("n_nationkey") + 1).alias("row_idx"), cells("", F.col("n_name"), "", whole(F.col("s")))))
    header = nations.select("file_id").distinct().select("file_id", F.lit(0).cast("bigint").alias("row_idx"), cells("region", "nation", "client", "balance"))
    return header.union(rows)


@query("report_files_h12", LEAVES_SQL + """
, n AS (SELECT 'file' || (c_custkey % 3) AS file_id, c_custkey % 3 AS f, r_regionkey, r_name, n_name, CAST(sum(floor(c_acctbal)) AS DOUBLE) AS s FROM leaves GROUP BY ALL)
, r AS (SELECT file_id, r_name AS path, CASE WHEN r_regionkey % 2 = 1 THEN CAST(1000 * f + r_regionkey AS DOUBLE) ELSE sum(s) END AS value FROM n GROUP BY file_id, f, r_name, r_regionkey)
SELECT file_id, r_name || '/' || n_name AS path, s AS value FROM n UNION ALL SELECT * FROM r UNION ALL SELECT file_id, '', sum(value) FROM r GROUP BY file_id""")
def _(t):
    return import_report(files_matrix(t), FILES_LAYOUT).rolled.select("file_id", joined("path").alias("path"), "value")
