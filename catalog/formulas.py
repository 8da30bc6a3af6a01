"""The formula vocabulary (M rows): each function over the aggregates of every customer."""

from pyspark.sql import functions as F

from catalog.base import query
from tallyframe import Breakdown, Metric, fx

# a: a large sum, b: a small count, c: a value that is 0 for some groups and missing for others
BINDINGS = {"a": ("o_totalprice", "SUM"), "b": ("o_orderkey", "COUNT"), "c": ("gap", "MAX")}
BASE_SQL = """
WITH o AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN 0 ELSE o_custkey % 7 - 3 END AS gap FROM orders),
g AS (SELECT CAST(o_custkey AS VARCHAR) AS label, count(*) AS record_count, sum(o_totalprice) AS a, CAST(count(o_orderkey) AS DOUBLE) AS b,
  coalesce(CAST(max(gap) AS DOUBLE), 0) AS c FROM o GROUP BY o_custkey)
"""

# name -> (formula, the same in SQL over a, b, c)
FORMULAS = {
    "add_m1": (lambda a, b, c: fx.add(a, b, c, 1) + a, "a + b + c + 1 + a"),
    "subtract_m2": (lambda a, b, c: fx.subtract(a, b) - c, "a - b - c"),
    "multiply_m3": (lambda a, b, c: fx.multiply(a, b, 2) * c, "a * b * 2 * c"),
    "divide_m4": (lambda a, b, c: a / c + fx.divide(a, b), "a / nullif(c, 0) + a / nullif(b, 0)"),
    "mod_m5": (lambda a, b, c: fx.mod(c, 3) + b % c, "c % 3 + CASE WHEN c <> 0 THEN b % c END"),
    "power_m6": (lambda a, b, c: b**2 + fx.pow(c, 3), "power(b, 2) + power(c, 3)"),
    "unary_m7": (lambda a, b, c: -a + +b, "-a + b"),
    "logic_m8": (
        lambda a, b, c: fx.if_((b > 10) & ~(c == 0) | (a < 1e6), 1, 0),
        "CASE WHEN (b > 10 AND NOT c = 0) OR a < 1e6 THEN 1 ELSE 0 END",
    ),
    "comparisons_m9": (
        lambda a, b, c: fx.if_(fx.equal(c, 0), 1, 0) + fx.if_(fx.smaller(c, 0), 10, 0) + fx.if_(fx.larger(b, 9), 100, 0)
        + fx.if_(fx.smaller_eq(b, 9), 1000, 0) + fx.if_(fx.larger_eq(a, 1e6), 10000, 0) + fx.if_(c != 2, 100000, 0),
        """CASE WHEN c = 0 THEN 1 ELSE 0 END + CASE WHEN c < 0 THEN 10 ELSE 0 END + CASE WHEN b > 9 THEN 100 ELSE 0 END
        + CASE WHEN b <= 9 THEN 1000 ELSE 0 END + CASE WHEN a >= 1e6 THEN 10000 ELSE 0 END + CASE WHEN c <> 2 THEN 100000 ELSE 0 END""",
    ),
    "condition_is_no_value_m9": (lambda a, b, c: b > 10, "NULL"),
    "if_m10": (lambda a, b, c: fx.if_(b > 10, a / b, -1), "CASE WHEN b > 10 THEN a / nullif(b, 0) ELSE -1 END"),
    "sqrt_m11": (lambda a, b, c: fx.sqrt(c), "CASE WHEN c >= 0 THEN sqrt(c) END"),
    "abs_sign_m12": (lambda a, b, c: fx.abs(c) + fx.sign(c) * 10, "abs(c) + sign(c) * 10"),
    "round_m13": (lambda a, b, c: fx.round(a / b * 1.4142135, 1) + fx.round(c / 2), "round(a / nullif(b, 0) * 1.4142135, 1) + round(c / 2)"),
    "floor_ceil_m14": (lambda a, b, c: fx.floor(c / 2) + fx.ceil(a / 1000), "floor(c / 2) + ceil(a / 1000)"),
    "exp_m15": (lambda a, b, c: fx.exp(c), "exp(c)"),
    "log_m16": (
        lambda a, b, c: fx.log(a) + fx.log(b, 2) + fx.log(c),
        "ln(a) + ln(b) / nullif(ln(2), 0) + CASE WHEN c > 0 THEN ln(c) END",
    ),
    "log10_m17": (lambda a, b, c: fx.log10(a), "log10(a)"),
    "min_max_m18": (lambda a, b, c: fx.min(b, c, 5) + fx.max(b, c, 12), "least(b, c, 5) + greatest(b, c, 12)"),
    "constants_m19": (lambda a, b, c: b * 2.5 + fx.if_(True, 1, 0), "b * 2.5 + 1"),
    "null_constant_m19": (lambda a, b, c: a + fx.if_(b > 10, None, 1), "a + CASE WHEN b > 10 THEN NULL ELSE 1 END"),
    "trigonometry_m20": (
        lambda a, b, c: fx.sin(c) + fx.cos(c) + fx.tan(c) + fx.asin(c / 4) + fx.acos(c / 4) + fx.atan(c),
        "sin(c) + cos(c) + tan(c) + asin(c / 4) + acos(c / 4) + atan(c)",
    ),
    "out_of_domain_m20": (lambda a, b, c: fx.asin(c), "CASE WHEN c BETWEEN -1 AND 1 THEN asin(c) END"),
    "mean_median_m21": (
        lambda a, b, c: fx.sum(b, c) + fx.mean(b, c, 4) + fx.median(b, c, 4, 9),
        "b + c + (b + c + 4) / 3 + list_median([b, c, 4, 9])",
    ),
    "unequal_m22": (lambda a, b, c: fx.if_(fx.unequal(c, 0), b, 0), "CASE WHEN c <> 0 THEN b ELSE 0 END"),
    "non_finite_m24": (lambda a, b, c: fx.exp(a) + b, "NULL"),
}


def with_gap(t):
    k = F.col("o_custkey")
    gap = F.when(k % 3 == 0, None).when(k % 3 == 1, 0).otherwise(k % 7 - 3)
    return t.orders.withColumn("gap", gap)


# quotients by a power of two end on halves of the fourth digit
DIGITS = {"divide_m4": 7, "if_m10": 7}


def register(name: str, formula, sql: str):
    digits = DIGITS.get(name, 4)
    value = sql.replace("list_median([b, c, 4, 9])", "list_aggregate([b, c, 4, 9], 'median')")

    @query(name, f"{BASE_SQL} SELECT label, record_count, round(CAST({value} AS DOUBLE), {digits}) AS v FROM g")
    def _(t):
        rows = Breakdown(with_gap(t), [Metric("v", BINDINGS, formula)], "o_custkey").rows(ordered=False)
        return rows.withColumn("v", F.round("v", digits))


for _name, (_formula, _sql) in FORMULAS.items():
    register(_name, _formula, _sql)


@query("sql_expression_m1", f"{BASE_SQL} SELECT label, record_count, round(a / nullif(c, 0) + greatest(b, 3), 4) AS v FROM g")
def _(t):
    metric = Metric("v", BINDINGS, "try_divide(a, c) + greatest(b, 3)")
    return Breakdown(with_gap(t), [metric], "o_custkey").rows(ordered=False).withColumn("v", F.round("v", 4))
