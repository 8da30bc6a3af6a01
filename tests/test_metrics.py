"""Metrics, totals and breakdowns on small values."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from tallyframe import Agg, Axis, Breakdown, Card, Dashboard, Filter, Metric, MetricGroup, Path, Template, fx

NAN = float("nan")


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("A", 10.0, 2.0)] * 4 + [("B", 50.0, 0.0), ("C", None, 5.0)]
    return spark.createDataFrame(rows, "region string, revenue double, cost double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by_label(df):
    return {r["label"]: r.asDict() for r in df.collect()}


def test_average_in_total_is_weighted(sales):
    b = Breakdown(sales, [Metric("m", Agg("revenue", "AVG"))], "region")
    assert by_label(b.rows())["A"]["m"] == 10 and by_label(b.rows())["B"]["m"] == 50
    assert one(b.total())["m"] == pytest.approx(18)


def test_sum_extremes_and_counts_in_total(frame):
    df = frame([("A", 10.0), ("B", 30.0), ("C", None), ("D", NAN)], "g string, v double")
    metrics = [Metric("s", Agg("v")), Metric("lo", Agg("v", "MIN")), Metric("n", Agg("v", "COUNT"))]
    rows = by_label(Breakdown(df, metrics, "g").rows())
    assert rows["D"]["s"] is None and rows["C"]["s"] is None
    total = one(Breakdown(df, metrics, "g").total())
    assert (total["s"], total["lo"], total["n"], total["record_count"]) == (40, 10, 3, 4)


def test_holistic_aggregates_have_no_total_but_an_exact_one(sales):
    metrics = [Metric("d", Agg("revenue", "COUNT_DISTINCT")), Metric("m", Agg("revenue", "MEDIAN")),
               Metric("twice", {"d": ("revenue", "COUNT_DISTINCT")}, lambda d: d * 2), Metric("on", {}, lambda x: x + 1, {"x": "twice"})]
    b = Breakdown(sales, metrics, "region")
    total = one(b.total())
    assert [total[k] for k in ("d", "m", "twice", "on")] == [None] * 4
    exact = one(b.total(exact=True))
    assert (exact["d"], exact["m"], exact["twice"], exact["on"]) == (2, 10, 4, 5)


def test_average_of_a_group_that_is_no_number(frame):
    df = frame([("A", 10.0), ("A", 20.0), ("B", NAN), ("C", None)], "g string, v double")
    b = Breakdown(df, [Metric("m", Agg("v", "AVG"))], "g")
    assert {k: r["m"] for k, r in by_label(b.rows()).items()} == {"A": 15, "B": None, "C": None} and one(b.total())["m"] == 15


def test_sketches(frame):
    df = frame([("A", float(i % 50)) for i in range(1000)], "g string, v double")
    metrics = [Metric("d", Agg("v", "COUNT_DISTINCT", approximate=True)), Metric("m", Agg("v", "MEDIAN", approximate=True)), Metric("x", Agg("v", "MEDIAN"))]
    row = by_label(Breakdown(df, metrics, "g").rows())["A"]
    assert abs(row["d"] - 50) <= 3 and abs(row["m"] - row["x"]) <= 1


@pytest.mark.parametrize("store", [False, True])
def test_totals_of_sketches_are_near_the_exact_ones(frame, store):
    rng = random.Random(8)
    groups = ["hot"] * 18 + ["a", "b"]
    df = frame([(rng.choice(groups), rng.choice("xyz"), float(int(rng.expovariate(1) * 3000)), None) for _ in range(20_000)], "g string, h string, v double, none double")
    about = [Metric("d", Agg("v", "COUNT_DISTINCT", approximate=True)), Metric("m", Agg("v", "MEDIAN", approximate=True)),
             Metric("p", Agg("v", "PERCENTILE", 0.9, approximate=True)), Metric("twice", {"d": Agg("v", "COUNT_DISTINCT", approximate=True)}, lambda d: d * 2),
             Metric("nd", Agg("none", "COUNT_DISTINCT", approximate=True)), Metric("nm", Agg("none", "MEDIAN", approximate=True)), Metric("lost", Agg("v", "MEDIAN"))]
    b = Breakdown(df, about, "g", Axis("h"))
    assert sorted(b.plan.partials) == ["__hll__none", "__hll__v", "__kll__none", "__kll__v"]
    b = b.store() if store else b
    values = sorted(r["v"] for r in df.collect())

    def near(row, values):
        rank = lambda x: sum(v <= x for v in values) / len(values)
        assert row["d"] == pytest.approx(len(set(values)), rel=0.03) and row["twice"] == 2 * row["d"]
        assert rank(row["m"]) == pytest.approx(0.5, abs=0.01) and rank(row["p"]) == pytest.approx(0.9, abs=0.01)
        assert row["nd"] == 0 and row["nm"] is None and row["lost"] is None

    near(one(b.total()), values)
    totals = by_label(b.totals_by_label())
    assert set(totals) == {"hot", "a", "b"} and sum(r["record_count"] for r in totals.values()) == 20_000
    near(totals["hot"], [r["v"] for r in df.where("g = 'hot'").collect()])


def test_operand_of_a_formula_keeps_its_aggregate_in_total(frame):
    df = frame([("A", 12.0), ("B", 47.0), ("C", 30.0)], "g string, v double")
    assert one(Breakdown(df, [Metric("m", {"a": ("v", "MAX")}, lambda a: a + 0)], "g").total())["m"] == 47


def test_missing_operand_is_zero_and_division_by_zero_is_null(sales):
    metrics = [Metric("share", {"a": "revenue", "b": "cost"}, lambda a, b: a / b), Metric("raw", Agg("revenue"))]
    rows = by_label(Breakdown(sales, metrics, "region").rows())
    assert rows["A"]["share"] == 5 and rows["B"]["share"] is None
    assert rows["C"]["share"] == 0 and rows["C"]["raw"] is None


def test_unknown_column_gives_null_not_an_error(sales):
    row = by_label(Breakdown(sales, [Metric("m", Agg("nope")), Metric("n", {"a": "nope", "b": "cost"}, lambda a, b: a + b)], "region").rows())["A"]
    assert row["m"] is None and row["n"] == 8


def test_metrics_over_metrics_across_groups_and_cycles(sales):
    one_group = MetricGroup("g1", [Metric("total", Agg("revenue"))])
    other = MetricGroup("g2", [Metric("need", Agg("cost")), Metric("ratio", {}, lambda a, b: a / b, {"a": "total", "b": "need"})])
    row = by_label(Breakdown(sales, [one_group, other], "region").rows())["A"]
    assert row["g2__ratio"] == 5
    loop = [Metric("x", {}, lambda y: y + 1, {"y": "y"}), Metric("y", {}, lambda x: x + 1, {"x": "x"})]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        rows = by_label(Breakdown(sales, loop, "region").rows())
    assert any("circular" in str(w.message) for w in caught) and rows["A"]["x"] == 2


def test_equal_aggregates_are_computed_once(sales):
    metrics = [Metric("a", {"x": "revenue", "y": "revenue"}, lambda x, y: x + y), Metric("b", Agg("revenue")), Metric("c", Agg("revenue", "AVG"))]
    assert sorted(Breakdown(sales, metrics, "region").plan.partials) == ["__n__revenue", "__sum__revenue"]


def test_metric_checks():
    with pytest.raises(ValueError):
        Metric("m", {"a": ("c", "SUMM")})
    with pytest.raises(ValueError):
        Metric("m", {"a": "c"}, lambda a, b: a / b)
    with pytest.raises(ValueError):
        Metric("m", {"a": "c", "b": "d"})
    with pytest.raises(ValueError):
        Metric("m", {"a": "c"}, lambda a: a, {"a": "other"})


def test_text_cells_are_numbers_where_they_can_be(frame):
    df = frame([("A", "10"), ("A", "x"), ("A", None), ("A", "2.5")], "g string, v string")
    metrics = [Metric("s", Agg("v")), Metric("n", Agg("v", "COUNT")), Metric("m", Agg("v", "AVG")), Metric("p", Agg("v", "MEDIAN"))]
    row = by_label(Breakdown(df, metrics, "g").rows())["A"]
    assert (row["s"], row["n"], row["m"], row["p"]) == (12.5, 3, 6.25, 6.25)


def test_blank_labels_stay_in_the_total(frame):
    df = frame([(" ", 1.0), (None, 2.0), (" A ", 4.0)], "g string, v double")
    b = Breakdown(df, [Metric("v", Agg("v"))], "g")
    assert list(by_label(b.rows())) == ["A"]
    assert one(b.total()) == {"record_count": 3, "v": 7.0}


def test_cap_cuts_rows_and_marks_the_total(frame):
    df = frame([(str(i), float(i)) for i in range(10)], "g string, v double")
    b = Breakdown(df, [Metric("v", Agg("v"))], "g", limit=3)
    assert [r["label"] for r in b.rows().collect()] == ["9", "8", "7"]
    assert one(b.total()) == {"record_count": 3, "v": 24.0, "truncated": True}
    assert one(Breakdown(df, [Metric("v", Agg("v"))], "g", limit=10).total())["truncated"] is False


def test_order_of_breakdowns(frame):
    df = frame([("b", 1, None), ("a", 1, 5.0), ("c", 2, 7.0)], "g string, d int, v double")
    metric = [Metric("v", Agg("v"))]
    assert [r["label"] for r in Breakdown(df, metric, "g").rows().collect()] == ["c", "a", "b"]
    two = Breakdown(df, metric, "g", Axis("d")).rows().collect()
    assert [(r["date_label"], r["label"]) for r in two] == [("1", "a"), ("1", "b"), ("2", "c")]


def test_top_n_folds_the_rest_and_null(frame):
    rows = [("r", s, 1.0) for s in ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + [None]]
    df = frame(rows, "g string, s string, v double")
    out = {r["date_label"]: r["v"] for r in Breakdown(df, [Metric("v", Agg("v"))], "g", Axis("s", top_n=2)).rows().collect()}
    assert out == {"a": 4, "b": 3, "Прочее": 3}


def test_store_gives_the_same_rows_and_total(sales):
    metrics = [Metric("m", Agg("revenue", "AVG")), Metric("r", {"a": "revenue", "b": "cost"}, lambda a, b: a / b)]
    plain, kept = Breakdown(sales, metrics, "region"), Breakdown(sales, metrics, "region").store()
    assert plain.rows().collect() == kept.rows().collect() and plain.total().collect() == kept.total().collect()


def test_columns_named_like_labels_do_no_harm(frame):
    df = frame([("x", 1.0, "k"), ("y", 2.0, "k")], "label string, date_label double, record_count string")
    rows = Breakdown(df, [Metric("m", Agg("date_label"))], "record_count", Axis("label")).rows().collect()
    assert [(r["label"], r["date_label"], r["m"]) for r in rows] == [("k", "x", 1.0), ("k", "y", 2.0)]


def test_total_equals_direct_aggregates_on_random_data(frame):
    rng = random.Random(5)
    rows = [(rng.choice("abcdefg"), rng.choice([None, rng.uniform(-5, 5)])) for _ in range(500)]
    df = frame(rows, "g string, v double")
    metrics = [Metric(f, Agg("v", f)) for f in ("SUM", "AVG", "MIN", "MAX", "COUNT")]
    total = one(Breakdown(df, metrics, "g").total())
    direct = one(Breakdown(df, metrics).rows())
    for f in ("SUM", "AVG", "MIN", "MAX", "COUNT"):
        assert total[f] == pytest.approx(direct[f])


def test_path_and_filters(frame):
    path = Path(("a", "b", "c")).drill(1).drill("x")
    assert path.next_level == "c" and path.values == ["1", "x"] and path.drill(2, level=0).next_level == "b"
    with pytest.raises(ValueError):
        path.drill("z", level=3)
    df = frame([(1, "x", "p"), (1, "y", "q"), (None, "x", "r")], "a int, b string, c string")
    rows = Breakdown(df, [], path.next_level, filters=[Filter("a", "1"), Filter("b", "x", "exact")]).rows().collect()
    assert [(r["label"], r["record_count"]) for r in rows] == [("p", 1)]
    from tallyframe.operators.filters import apply_filters

    assert apply_filters(df, [Filter("a", "not a number", ">")]).count() == 0


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("g", F.col("id") % 3).withColumn("unused", F.lit("x")).write.parquet(str(tmp_path / "t"))
    b = Breakdown(spark.read.parquet(str(tmp_path / "t")), [Metric("s", Agg("id"))], "g", filters=[Filter("id", "50", ">")])
    plan = b.rows()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "unused" not in plan


def test_cards_may_use_each_other(sales):
    ratio = Template("r", lambda a, b: a / b, fmt="percent")
    plain = Template("p", lambda v: v)
    cards = [Card("r", ratio, {"a": "x", "b": "cost"}), Card("x", plain, {"v": "revenue"})]
    out = {r["card"]: (r["value"], r["text"]) for r in Dashboard([], [], cards).card_values(sales).collect()}
    assert out["x"] == (90.0, "90") and out["r"][0] == pytest.approx(90 / 13)
    empty = Dashboard([], [], [Card("n", ratio, {"a": "revenue", "b": "revenue"})]).card_values(sales.where("region = 'C'")).collect()
    assert (empty[0]["value"], empty[0]["text"]) == (0.0, "—")


def test_formula_vocabulary_edges(frame):
    df = frame([(1, 4.0)], "g int, v double")
    cases = {
        "mod0": lambda a: a % 0, "sqrt": lambda a: fx.sqrt(-a), "inf": lambda a: fx.exp(a * 1000), "log0": lambda a: fx.log(a - a),
        "power": lambda a: 2**a, "cond": lambda a: a > 1, "if": lambda a: fx.if_(a, 7, 8), "median": lambda a: fx.median(a, 1, 10),
    }
    metrics = [Metric(k, {"a": "v"}, f) for k, f in cases.items()]
    row = one(Breakdown(df, metrics).rows())
    assert [row[k] for k in cases] == [None, None, None, None, 16, None, 7, 4]


def test_date_labels_do_not_depend_on_the_time_zone(spark, frame):
    df = frame([("2024-03-10 02:30:59",), ("2024-12-31T23:59:00",), ("2024-01-01",), ("bad",), (None,)], "d string")
    moments = df.select(F.col("d").try_cast("timestamp_ntz").alias("d"))
    expected = {
        "minute": {"2024-03-10 02:30", "2024-12-31 23:59", "2024-01-01 00:00"}, "hour": {"2024-03-10 02:00", "2024-12-31 23:00", "2024-01-01 00:00"},
        "day": {"2024-03-10", "2024-12-31", "2024-01-01"}, "week": {"2024-03-04", "2024-12-30", "2024-01-01"},
        "month": {"2024-03", "2024-12", "2024-01"}, "year": {"2024"},
    }
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for granularity, labels in expected.items():
            for source in (df, moments):
                b = Breakdown(source, [], axis=Axis("d", "date", granularity))
                assert {r["label"] for r in b.rows().collect()} == labels
                assert one(b.total())["record_count"] == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("case", ["skewed", "flat", "few", "ties", "empty"])
def test_top_values_by_bounded_counters(spark, monkeypatch, case):
    from tallyframe.operators import breakdown

    monkeypatch.setattr(breakdown, "TRACKED", 64)
    rng = random.Random(3)
    values = {
        "skewed": [rng.choice(["hot"] * 5 + [None] * 2 + ["warm", "b"]) if rng.random() < 0.6 else f"v{rng.randrange(4000)}" for _ in range(6000)],
        "flat": [f"v{rng.randrange(900)}" for _ in range(6000)],
        "few": [rng.choice("abc") for _ in range(500)] + [None] * 200,
        "ties": [f"t{i}" for i in range(30)] * 20,
        "empty": [],
    }[case]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    counts = sorted(((values.count(v), v) for v in set(values)), key=lambda x: (-x[0], x[1] is None, x[1] or ""))
    for n in (1, 3, 5):
        assert breakdown.top_values(df, "v", n) == [v for _, v in counts[:n]]
    folded = breakdown.fold_top_n(df, "v", 3, "f").groupBy("f").count().collect()
    kept = {v for _, v in counts[:3] if v is not None}
    want = {v: values.count(v) for v in kept} | {breakdown.OTHER_LABEL: sum(v not in kept for v in values)}
    assert {r["f"]: r["count"] for r in folded} == {k: c for k, c in want.items() if c}
