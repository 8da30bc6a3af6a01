"""Display columns: colours, scales, number texts and ids (V rows)."""

from pyspark.sql import functions as F

from catalog.base import query
from tallyframe import Agg, Breakdown, Metric, Rule, fx
from tallyframe.functions import display as D
from tallyframe.operators.views import formatted

# DuckDB: number text with a no-break space and a comma, trailing zeros cut
RU = r"regexp_replace(regexp_replace(replace(replace(replace(format('{:,.{d}f}', {x}), ',', ' '), '.', ','), ' ', chr(160)), '(,\d*?)0+$', '\1'), ',$', '')"
FIXED = "replace(replace(replace(format('{:,.{d}f}', {x}), ',', ' '), '.', ','), ' ', chr(160))"


def ru(x: str, digits: int, pattern: str = RU) -> str:
    return pattern.replace("{d}", str(digits)).replace("{x}", f"CAST({x} AS DOUBLE)")


@query("rule_color_v1", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN '#10b981' WHEN o_totalprice BETWEEN 200000 AND 300000 THEN '#f59e0b'
  WHEN o_totalprice < 50000 THEN '#f43f5e' END AS color, CASE WHEN o_totalprice / 500000 * 100 > 50 THEN '#3b82f6' ELSE '#94a3b8' END AS share_color FROM orders""")
def _(t):
    rules = [Rule(">=", 400_000, color="emerald"), Rule("between", 300_000, 200_000, "amber"), Rule("<", 50_000, color="rose")]
    halves = [Rule(">", 50, color="blue"), Rule("!=", -1, color="slate")]
    return t.orders.select(
        "o_orderkey", D.rule_color("o_totalprice", rules).alias("color"),
        D.rule_color(F.col("o_totalprice") / 500_000, halves, "percent").alias("share_color"),
    )


@query("display_scale_v2", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 100 AS discount, l_tax AS tax FROM lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", D.display_scale("l_discount", "percent").alias("discount"),
        D.display_scale("l_tax", "percent_raw").alias("tax"),
    )


@query("format_value_v3", f"""
SELECT o_orderkey, {ru('o_totalprice', 2)} AS number, {ru('o_totalprice', 2, FIXED)} || ' ₽' AS currency,
  {ru('o_totalprice', 2, FIXED)} AS "decimal", {ru('round(o_custkey / 64.0 * 100, 2)', 2)} || '%' AS percent,
  {ru('o_custkey', 0)} || '%' AS percent_raw,
  regexp_replace(format('{{:.3e}}', CAST(o_custkey * 1000 + 300 AS DOUBLE)), 'e([+-])0+(\\d)', 'e\\1\\2') AS scientific,
  CASE WHEN o_orderkey % 2 = 0 THEN '—' ELSE {ru('o_totalprice', 2)} || ' шт' END AS missing FROM orders""")
def _(t):
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", D.format_value(price, "number", 2).alias("number"), D.format_value(price, "currency", 2, "₽").alias("currency"),
        D.format_value(price, "decimal", 2).alias("decimal"), D.format_value(key / 64.0, "percent", 2, "шт").alias("percent"),
        D.format_value(key.cast("double"), "percent_raw", 0).alias("percent_raw"),
        D.format_value((key * 1000 + 300).cast("double"), "scientific", 3).alias("scientific"),
        D.format_value(F.when(F.col("o_orderkey") % 2 != 0, price), "number", 2, "шт").alias("missing"),
    )


@query("formatted_metrics_v3", f"""
WITH g AS (SELECT o_orderpriority AS label, count(*) AS record_count, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1)
SELECT label, record_count, {ru('mean', 2, FIXED)} || ' ₽' AS mean_text, CASE WHEN mean > 253000 THEN '#10b981' ELSE '#f43f5e' END AS mean_color FROM g""")
def _(t):
    rules = [Rule(">", 253_000, color="emerald"), Rule("<=", 253_000, color="rose")]
    metric = Metric("mean", {"v": Agg("o_totalprice", "AVG")}, lambda v: fx.round(v, 2), fmt="currency", unit="₽", rules=rules)
    return formatted(Breakdown(t.orders, [metric], "o_orderpriority").rows(), [metric]).drop("mean")


@query("number_text_v4", f"SELECT o_orderkey, {ru('round(o_totalprice, 1)', 1)} AS one, {ru('o_totalprice', 3)} AS three, {ru('o_orderkey', 0)} AS whole FROM orders")
def _(t):
    return t.orders.select(
        "o_orderkey", D.ru_text("o_totalprice", 1).alias("one"), D.ru_text("o_totalprice", 3).alias("three"),
        D.ru_text(F.col("o_orderkey").cast("double"), 0).alias("whole"),
    )


def _compact_sql(x: str) -> str:
    tiers = [(0, ""), (1, "тыс."), (2, "млн"), (3, "млрд")]
    whens = " ".join(
        f"WHEN abs(round({x} / 1000.0 ** {p}, 1)) < 1000 THEN {ru(f'round({x} / 1000.0 ** {p}, 1)', 1)} || '{(' ' + s) if s else ''}'"
        for p, s in tiers
    )
    return f"replace(CASE {whens} END, ' ', chr(160))"


@query("compact_number_v5", f"SELECT o_orderkey, {_compact_sql('CAST(o_custkey AS DOUBLE)')} AS small, {_compact_sql('o_totalprice * 4096')} AS large FROM orders")
def _(t):
    return t.orders.select(
        "o_orderkey", D.compact_text(F.col("o_custkey").cast("double")).alias("small"), D.compact_text(F.col("o_totalprice") * 4096).alias("large")
    )


@query("value_label_v6", f"SELECT o_orderkey, {ru('o_totalprice', 3)} || '%' AS percent, {ru('o_totalprice', 3)} || ' кг' AS unit, {ru('o_totalprice', 3)} AS plain FROM orders")
def _(t):
    c = "o_totalprice"
    return t.orders.select(
        "o_orderkey", D.value_label(c, "percent", "кг").alias("percent"), D.value_label(c, "number", "кг").alias("unit"), D.value_label(c).alias("plain")
    )


@query("metric_id_v8", """
SELECT p_partkey, 'vm-' || left(sha256(p_brand || '::' || p_type || '::' || p_name || '::number::' || CAST(p_size AS VARCHAR) || '::'), 16) AS id FROM part""")
def _(t):
    return t.part.select("p_partkey", D.metric_id("p_brand", "p_type", "p_name", F.lit("number"), "p_size", F.lit(None)).alias("id"))
