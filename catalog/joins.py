"""Dictionary lookups and node joins (J rows)."""

from pyspark.sql import functions as F

from catalog.base import joined, query, rounded
from catalog.reports import NODES_SQL, report_nodes
from tallyframe import Agg, Breakdown, Metric
from tallyframe.functions.text import normalize_key
from tallyframe.operators.breakdown import fold_top_n
from tallyframe.operators.lookup import build_dictionary, resolve_names
from tallyframe.operators.report import entered_values, node_values, roll_up


@query("dictionary_lookup_j1", """
SELECT label, record_count, round(balance, 2) AS balance, coalesce(n_name, label) AS name FROM (
  SELECT CAST(c_nationkey + c_custkey % 2 * 5 AS VARCHAR) AS label, count(*) AS record_count, sum(c_acctbal) AS balance FROM customer GROUP BY 1)
LEFT JOIN nation ON label = CAST(n_nationkey AS VARCHAR)""")
def _(t):
    entries = build_dictionary(t.nation, "n_nationkey", "n_name", "n_nationkey")
    coded = t.customer.withColumn("code", (F.col("c_nationkey") + F.col("c_custkey") % 2 * 5).cast("int"))  # some codes are unknown
    rows = Breakdown(coded, [Metric("balance", Agg("c_acctbal"))], "code").rows(ordered=False)
    return rounded(resolve_names(rows, entries), 2, "balance")


@query("key_normalisation_j2", """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS wide8, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS wide11,
  CAST(c_custkey AS VARCHAR) AS plain, 'C-' || CAST(c_custkey AS VARCHAR) AS letters FROM customer""")
def _(t):
    key = F.col("c_custkey").cast("string")
    return t.customer.select(
        "c_custkey",
        normalize_key(F.concat(F.lit("  "), key, F.lit(".0 ")), "lpad8").alias("wide8"),
        normalize_key(key, "lpad11").alias("wide11"),
        normalize_key(F.concat(key, F.lit(".0"))).alias("plain"),
        normalize_key(F.concat(F.lit("C-"), key), "lpad11").alias("letters"),
    )


@query("dictionary_build_j3", """
SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS code, arg_max(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1""")
def _(t):
    return build_dictionary(t.orders, "o_custkey", "o_orderpriority", "o_orderkey", "lpad8")


@query("top_n_lookup_j4", """
WITH top AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*) DESC, o_custkey LIMIT 10)
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM top) THEN CAST(o_custkey AS VARCHAR) ELSE 'Прочее' END AS client FROM orders""")
def _(t):
    return fold_top_n(t.orders, "o_custkey", 10, "client").select("o_orderkey", "client")


@query("entered_values_join_j5", NODES_SQL + """
, rows AS (SELECT n_name AS label, count(*) AS record_count, sum(c_acctbal) AS balance FROM leaves WHERE r_name = 'ASIA' GROUP BY 1)
SELECT rows.label, rows.record_count, round(rows.balance, 2) AS balance, round(e.balance, 2) AS entered
FROM rows LEFT JOIN nodes e ON e.path = 'ASIA/' || rows.label""")
def _(t):
    from catalog.reports import leaves

    rows = Breakdown(leaves(t).where("r_name = 'ASIA'"), [Metric("balance", Agg("c_acctbal"))], "n_name").rows(ordered=False)
    rolled = node_values(report_nodes(t))
    entered = entered_values(rolled.withColumn("value", F.col("own")), {"entered": "balance"})
    at = F.array(F.lit("ASIA"), F.col("label")) == F.col("path")
    return rounded(rows.join(entered, at, "left").drop("path"), 2, "balance", "entered")


@query("parent_child_join_j6", NODES_SQL + """
SELECT p.path AS parent, count(*) AS children, CAST(count(c.customers) AS BIGINT) AS filled FROM nodes c JOIN nodes p
  ON p.path = regexp_replace(c.path, '/[^/]*$', '') AND c.path <> p.path GROUP BY 1""")
def _(t):
    nodes = node_values(report_nodes(t)).where("column = 'customers'")
    parents = nodes.select(F.col("path").alias("parent"))
    children = nodes.select(F.slice("path", 1, F.size("path") - 1).alias("parent"), "own")
    pairs = children.join(parents, "parent")
    return pairs.groupBy(joined("parent").alias("parent")).agg(F.count(F.lit(1)).alias("children"), F.count("own").alias("filled"))
