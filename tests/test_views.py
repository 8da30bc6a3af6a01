"""Rows as shown: pivots, shares, display filters, orders, colours and number texts."""

import pytest
from pyspark.sql import functions as F

from tallyframe import Agg, Axis, Calc, DisplayRule, GroupView, Metric, Path, Rule
from tallyframe.functions import display as D
from tallyframe.operators import normalize as N, pivot as PV, series as S, views as V
from tallyframe.operators.lookup import build_dictionary, resolve_names

NAN, INF = float("nan"), float("inf")
CELLS = [("A", "2024-01", 10.0), ("A", "2024-02", 20.0), ("B", "2024-01", 30.0), ("B", "2024-02", 40.0), ("C", None, 5.0)]


@pytest.fixture
def cells(frame):
    return frame([(a, b, 1, v) for a, b, v in CELLS], "label string, date_label string, record_count long, m double")


def test_pivot(cells):
    rows = PV.pivot(cells, "m").collect()
    assert [tuple(r) for r in rows] == [("B", 30.0, 40.0, 70.0), ("A", 10.0, 20.0, 30.0)]
    shares = {r["label"]: r["share"] for r in PV.total_shares(PV.row_totals(cells, "m")).collect()}
    assert shares == {"A": pytest.approx(0.3), "B": pytest.approx(0.7)}


def test_axis_order(frame):
    df = frame([("x", l, 1) for l in ("Прочее", "Бета", "Альфа", "", "Бета")], "label string, date_label string, record_count long")
    assert PV.axis_values(df) == ["Альфа", "Бета", "Прочее"]


def test_calculated_row_total(frame):
    df = frame([("R", "1", 1, 100.0, 50.0), ("R", "2", 1, 20.0, 30.0)], "label string, date_label string, record_count long, a double, b double")
    calc = Calc(lambda a, b: a / b, {"a": "a", "b": "b"})
    assert PV.row_totals(df, "x", calc).collect()[0]["total"] == 1.5
    total = V.label_totals(df, ["a", "b", "r"], {"r": calc}).collect()[0]
    assert (total["a"], total["b"], total["r"], total["record_count"]) == (120, 80, 1.5, 2)


def test_share_within_a_period(cells):
    out = {(r["label"], r["date_label"]): r["m"] for r in N.normalize_by_period(cells, "m", "total").collect()}
    assert out[("A", "2024-01")] == 0.25 and out[("B", "2024-02")] == pytest.approx(40 / 60)


@pytest.mark.parametrize("base, expected", [("total", 100), ("max", 40), ("min", 10), ("mean", 25)])
def test_column_reference(frame, base, expected):
    df = frame([(v,) for v in (10.0, 20.0, 30.0, 40.0, None, NAN, INF)], "v double")
    assert N.column_reference(df, "v", base).collect()[0][0] == expected


def test_normalise_leaves_others_and_handles_zero(frame):
    df = frame([("a", 1.0, 0.0), ("b", 3.0, 0.0), ("c", None, 0.0)], "label string, m double, z double")
    out = N.normalize(df, {"m": "total", "z": "total"}, text=True).orderBy("label").collect()
    assert [(r["m"], r["m_text"], r["z"], r["z_text"]) for r in out] == [(0.25, "25%", None, "—"), (0.75, "75%", None, "—"), (None, "—", None, "—")]


def test_heat_and_domain(frame):
    df = frame([(0.0,), (5.0,), (10.0,), (None,)], "v double")
    heat = [r["heat_color"] for r in N.heat_map(df, "v").collect()]
    assert heat == ["rgba(99, 102, 241, 0.060)", "rgba(99, 102, 241, 0.380)", "rgba(99, 102, 241, 0.700)", None]
    flat = frame([(2.0,), (2.0,)], "v double")
    assert N.heat_map(flat, "v").collect()[0]["heat"] == 0.06
    assert tuple(N.axis_domain(df, ["v"]).collect()[0]) == (-0.8, 10.8)
    assert tuple(N.axis_domain(flat, ["v"]).collect()[0]) == (1.8, 2.2)
    assert tuple(N.axis_domain(frame([(0.0,)], "v double"), ["v"]).collect()[0]) == (-1, 1)
    assert tuple(N.axis_domain(df.where("v > 99"), ["v"]).collect()[0]) == (0, 1)


def test_close_values(frame):
    points = frame([("m", "r1", 0.0), ("m", "r2", 1000.0), ("m", "r3", 1002.0), ("n", "r", 5.0)], "metric string, member string, value double")
    out = sorted(tuple(r) for r in S.merge_close_values(points).collect())
    assert out == [("m", 0.0, 0.0, 0.0, 1, False), ("m", 1000.0, 1002.0, 1001.0, 2, True), ("n", 5.0, 5.0, 5.0, 1, False)]
    assert S.merge_close_values(points, 0).count() == 4


def test_ranks_and_changes(frame):
    rows = frame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("d", 1.0), ("e", None)], "label string, m double")
    assert {r["label"]: r["rank"] for r in S.best_ranked(rows, "m", 2).collect()} == {"b": 1, "a": 2, "c": 2}
    dated = frame([("a", "2023-01", 4.0), ("a", "2024-01", 5.0), ("a", "2024-02", 0.0)], "label string, date_label string, m double")
    previous = {r["date_label"]: (r["previous_value"], r["change"], r["change_percent"]) for r in S.with_change(dated, "m").collect()}
    assert previous == {"2023-01": (None, None, None), "2024-01": (4, 1, 25), "2024-02": (5, -5, -100)}
    ago = {r["date_label"]: r["previous_value"] for r in S.with_change(dated, "m", "year_ago").collect()}
    assert ago == {"2023-01": None, "2024-01": 4, "2024-02": None}


def test_display_filter(frame):
    df = frame([("a", 0.5, 0.5 + 1e-12), ("b", 0.2, 0.3), ("c", None, 1.0)], "label string, m double, n double")
    keep = lambda *rules, **k: [r["label"] for r in V.display_filter(df, rules, {"m": "percent"}, **k).collect()]
    assert keep(DisplayRule("m", ">", 40)) == ["a"]
    assert keep(DisplayRule("m", "between", 60, 10)) == ["a", "b"]
    assert keep(DisplayRule("m", ">", 40, level=1)) == ["a", "b", "c"]
    assert keep(DisplayRule("m", ">", 40, level=1), depth=1) == ["a"]
    assert keep(DisplayRule("lacking", ">", 0)) == []
    same = [r["label"] for r in V.display_filter(df, [DisplayRule("m", "==", compare="n")]).collect()]
    other = [r["label"] for r in V.display_filter(df, [DisplayRule("m", "between", compare="n")]).collect()]
    assert same == ["a"] and other == ["b"]


def test_two_axis_filter_uses_label_totals(cells):
    out = V.display_filter_2d(cells, [DisplayRule("m", ">=", 70)], ["m"]).collect()
    assert {r["label"] for r in out} == {"B"} and len(out) == 2


def test_orders(frame):
    df = frame([("n10", 1, None), ("n2", 3, 5.0), ("N1", 2, -1.0)], "label string, record_count long, m double")
    order = lambda *a, **k: [r["label"] for r in V.sort_rows(df, *a, **k).collect()]
    assert order() == ["N1", "n2", "n10"] and order(descending=True) == ["n10", "n2", "N1"]
    assert order("m", descending=True) == ["n2", "N1", "n10"] and order("m") == ["n10", "N1", "n2"]
    assert order("record_count") == ["n10", "N1", "n2"]


def test_pages(spark):
    df = spark.range(120)
    ids = lambda n: [r["id"] for r in V.page(df, ["id"], n).collect()]
    assert ids(1) == list(range(50)) and ids(3) == list(range(100, 120)) and ids(99) == ids(3) and ids(0) == ids(1)
    assert V.page(df.where("id < 0"), ["id"], 4).collect() == []
    big = spark.range(5000).repartition(7)
    for n in (1, 37, 100):
        assert [r["id"] for r in V.page(big, [F.desc("id")], n).collect()] == list(range(5000 - 50 * (n - 1) - 1, 5000 - 50 * n - 1, -1))


def test_pages_of_one_result_sort_once_and_read_few_ranges(spark):
    df = spark.range(5000).repartition(7).withColumn("v", F.col("id") % 10)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        pages = V.Pages(df, [F.desc("v")], 100)
    finally:
        spark.conf.set(key, was)
    want = sorted(range(5000), key=lambda i: (-(i % 10), i))
    assert pages.rows == 5000 and pages.last == 50 and len(pages.ranges) > 1
    for n in (1, 2, 13, 50, 99):
        shown = pages.page(n)
        n = min(n, 50)
        assert [r["id"] for r in shown.collect()] == want[100 * (n - 1) : 100 * n] and shown.columns == ["id", "v"]
        plan = shown._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Sort") == 1  # of the page's own rows
        assert len(shown.inputFiles()) == len(pages.ranges) and "__range" in shown._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1]
    assert V.Pages(df.where("id < 0"), ["id"]).page(3).collect() == []


def test_labels_sort_by_locale(frame):
    labels = ["Ж 1", "Ё 2", "Е 10", "ё 1", "part 2", "Part 10", "a1", "a b", "ab", "élan 1", "elan 2", "Elan 1", "é", "x 007", "x 7", "x 08", None]
    df = frame([(v,) for v in labels], "label string")
    order = [r["label"] for r in V.sort_rows(df).collect()]
    assert order == ["ё 1", "Ё 2", "Е 10", "Ж 1", "a b", "a1", "ab", "é", "Elan 1", "élan 1", "elan 2", "part 2", "Part 10", "x 007", "x 7", "x 08", None]


def test_search_treemap_and_chart(frame):
    df = frame([("01", "Север", 0.5), ("02", "Юг", -1.0), ("03", "Юго-восток", None)], "label string, name string, m double")
    assert [r["label"] for r in V.search(df, "ЮГ", "name").collect()] == ["02", "03"]
    assert [tuple(r) for r in V.treemap(df, "m", "percent").collect()] == [("01", 50.0)]
    chart = V.chart_table(df, ["m"], {"m": "percent"}, {"limit": 7}).collect()
    assert [(r["m"], r["limit"]) for r in chart] == [(50, 7), (-100, 7), (0, 7)]
    many = df.select("label", *[F.col("m").alias(f"m{i}") for i in range(6)])
    assert len(V.chart_table(many, [f"m{i}" for i in range(6)]).columns) == 7


def test_places_are_the_same_for_ties(frame):
    df = frame([(i % 3, chr(97 + i % 7)) for i in range(60)], "k int, v string").repartition(5)
    got = [tuple(r) for r in V.placed(df, ["k"]).orderBy("place").collect()]
    assert got == [(k, v, i + 1) for i, (k, v) in enumerate(sorted((i % 3, chr(97 + i % 7)) for i in range(60)))]


def test_steps_of_a_view(frame):
    df = frame([("r", "a", 10.0), ("r", "b", 30.0), ("r", "c", 1.0), ("s", "z", 9.0)], "lvl1 string, lvl2 string, v double")
    view = GroupView([Metric("v", Agg("v"), normalize_by="total")], [DisplayRule("v", ">", 5, level=1)], "v")
    entered = frame([(["r", "a"], 20.0)], "path array<string>, v double")
    path = Path(("lvl1", "lvl2")).drill("r")
    out = [(r["label"], r["v"], r["v_from_node"]) for r in view.rows(df, path, entered).collect()]
    assert out == [("b", 0.6, False), ("a", 0.4, True)]
    assert view.total(df, path).collect()[0]["v"] == 41


def show(frame, column, values, kind="double"):
    return [r[0] for r in frame([(v,) for v in values], f"v {kind}").select(column(F.col("v"))).collect()]


def test_number_texts(frame):
    nb = "\u00a0"
    f = lambda *a: lambda c: D.format_value(c, *a)
    assert show(frame, f("number", 2), [1234567.5, 0.0, None, -1234.567]) == [f"1{nb}234{nb}567,5", "0", "—", f"-1{nb}234,57"]
    assert show(frame, f("currency", 2, "₽"), [1234.5]) == [f"1{nb}234,50 ₽"]
    assert show(frame, f("percent", 1, "x"), [0.5687, 1.0]) == ["56,9%", "100%"]
    assert show(frame, f("percent_raw", 0), [57.4]) == ["57%"]
    assert show(frame, f("scientific", 2), [123456.0, 0.00012, 0.0]) == ["1.23e+5", "1.20e-4", "0.00e+0"]
    assert show(frame, D.compact_text, [12.34, 1234.0, 999_960.0, 3.4e6, -2.5e9, None]) == ["12,3", f"1,2{nb}тыс.", f"1{nb}млн", f"3,4{nb}млн", f"-2,5{nb}млрд", None]
    assert show(frame, lambda c: D.cell_text(c, "double"), [1.23456, None]) == ["1,2346", "—"]
    assert show(frame, lambda c: D.cell_text(c, "boolean"), [True, False, None], "boolean") == ["✓", "✗", "—"]


def test_rule_colors(frame):
    rules = [Rule(">", 50, color="emerald"), Rule("between", 20, 10, "rose")]
    assert show(frame, lambda c: D.rule_color(c, rules, "percent"), [0.6, 0.15, 0.3, None]) == ["#10b981", "#f43f5e", None, None]


def test_dictionary(frame):
    pairs = frame([(1, "1201802", "first"), (2, "01201802", "last"), (3, " ", "x"), (4, "абв", "text")], "i int, k string, v string")
    entries = build_dictionary(pairs, "k", "v", "i", "lpad8")
    assert {r["code"]: r["name"] for r in entries.collect()} == {"01201802": "last", "абв": "text"}
    rows = frame([("1201802",), ("77",)], "label string")
    assert {r["label"]: r["name"] for r in resolve_names(rows, entries, mode="lpad8").collect()} == {"1201802": "last", "77": "77"}


def test_two_axes_are_shared_by_period_and_sorted(frame):
    df = frame([("a", "p1", 1.0), ("a", "p2", 9.0), ("b", "p1", 3.0), ("b", "p2", 1.0)], "lvl1 string, period string, v double")
    view = GroupView([Metric("v", Agg("v"), normalize_by="total")], sort_key="v", axis=Axis("period"))
    out = [(r["label"], r["date_label"], r["v"]) for r in view.rows(df, Path(("lvl1",))).collect()]
    assert out == [("a", "p1", 0.25), ("a", "p2", 0.9), ("b", "p1", 0.75), ("b", "p2", pytest.approx(0.1))]
    with pytest.raises(ValueError):
        view.rows(df, Path(("lvl1",)), frame([(["a"], 1.0)], "path array<string>, v double"))
