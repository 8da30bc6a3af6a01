"""Report matrices, nodes and roll-ups."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe import Calc, Layout, import_report
from tallyframe.operators import report as R

HEADER = ["region", "city", "zone", "object", "area", "headcount"]
BODY = [
    ["Тюменская обл", "", "", "", "", "1639132"],
    ["Тюменская обл", "Тюмень", "", "", "", "88701"],
    ["Тюменская обл", "Тюмень", "8:01:06", "", "0,144", ""],
    ["Тюменская обл", "Тюмень", "8:01:06", "{guid1}", "1,45", "0"],
    ["Тюменская обл", "Тюмень", "8:01:06", "{guid2}", "6,91", "1"],
    ["Итого", "", "", "", "", "1727833"],
]
LAYOUT = Layout((0, 1, 2, 3))
COLUMNS = R.report_columns([HEADER], LAYOUT.key_columns, (4, 5))


@pytest.fixture
def matrix(spark):
    def build(rows, file_id="f"):
        return spark.createDataFrame([(file_id, i, r) for i, r in enumerate(rows)], "file_id string, row_idx long, cells array<string>")

    return build


def test_row_classes(matrix):
    out = R.classify_rows(matrix([HEADER, *BODY, ["", "", "", "", "1", "2"]]), LAYOUT).orderBy("row_idx").collect()
    assert [(r["kind"], r["level"]) for r in out] == [
        ("node", 0), ("node", 1), ("node", 2), ("leaf", 3), ("leaf", 3), ("total", 0), ("node", -1)
    ]
    assert [r["label"] for r in out][-2:] == ["Итого", ""]


def test_leaves_have_all_ancestors(matrix):
    out = R.flatten_leaves(matrix([HEADER, *BODY]), LAYOUT, COLUMNS).orderBy("row_idx").collect()
    assert [tuple(r)[2:] for r in out] == [
        ("Тюменская обл", "Тюмень", "8:01:06", "{guid1}", 1.45, 0.0), ("Тюменская обл", "Тюмень", "8:01:06", "{guid2}", 6.91, 1.0)
    ]


def test_outline_and_total_rows_in_the_carry(matrix):
    rows = [HEADER, ["Обл", "", "", ""], ["", "Гор", "", ""], ["", "", "8:01", "{g1}"], ["", "", "Итого по зоне", ""], ["", "", "", "{g2}"],
            ["Край", "", "", ""], ["", "", "", "{g3}"]]
    leaves = R.flatten_leaves(matrix(rows), LAYOUT, COLUMNS[:4], block=2).orderBy("row_idx").collect()
    assert [tuple(r)[2:] for r in leaves] == [
        ("Обл", "Гор", "8:01", "{g1}"), ("Обл", "Гор", "8:01", "{g2}"), ("Край", "", "", "{g3}")
    ]
    nodes = R.extract_nodes(matrix(rows), LAYOUT, COLUMNS, block=2).orderBy("row_idx").collect()
    assert [(r["path"], r["is_total"]) for r in nodes] == [
        (["Обл"], False), (["Обл", "Гор"], False), (["Обл", "Гор", "Итого по зоне"], True), (["Край"], False)
    ]


def test_nodes_keep_entered_values(matrix):
    out = {"/".join(r["path"]): r for r in R.extract_nodes(matrix([HEADER, *BODY]), LAYOUT, COLUMNS).collect()}
    assert set(out) == {"Тюменская обл", "Тюменская обл/Тюмень", "Тюменская обл/Тюмень/8:01:06", "Итого"}
    assert out["Тюменская обл/Тюмень/8:01:06"]["values"] == {"area": 0.144, "headcount": None}
    assert out["Итого"]["is_total"] and out["Итого"]["values"]["headcount"] == 1727833


def test_leaves_and_nodes_are_all_rows(matrix):
    m = matrix([HEADER, *BODY])
    assert R.flatten_leaves(m, LAYOUT, COLUMNS).count() + R.extract_nodes(m, LAYOUT, COLUMNS).count() == len(BODY)


def test_detection(matrix):
    m = matrix([HEADER, *BODY])
    assert R.detect_key_columns(m).collect()[0]["key_count"] == 4
    assert R.detect_header_rows(m).collect()[0]["header_rows"] == 1
    two = matrix([["Расположение", "", "", "Дошкольные", ""], ["Регион", "Город", "Зона", "Потребность", "Мощность"], ["a", "b", "c", "1", "2"]])
    assert R.detect_header_rows(two).collect()[0]["header_rows"] == 2
    names = [c.full_name for c in R.report_columns(
        [["Расположение", "", "", "Дошкольные", ""], ["Регион", "Город", "Зона", "Потребность", "Мощность"]], (0, 1, 2), (3, 4))]
    assert names[3:] == ["Дошкольные · Потребность", "Дошкольные · Мощность"] and names[0] == "Расположение · Регион"
    scores = {r["pos"]: r["is_metric"] for r in R.column_scores(matrix([["h"] * 3, ["007", "1 234,5", "8:01"], ["08", "2", "9"]])).collect()}
    assert scores == {0: False, 1: True, 2: False}


def test_empty_cells_and_metric_cells(spark):
    rows = spark.createDataFrame([(c,) for c in (None, "  ", " Н/Д", "0", "1 234,5", "x")], "c string")
    c = F.col("c")
    out = rows.select(R.is_empty(c, ["н/д"]).alias("e"), R.parse_metric(c, ["н/д"]).alias("v")).collect()
    assert [r["e"] for r in out] == [True, True, True, False, False, False]
    assert [r["v"] for r in out] == [None, None, None, 0.0, 1234.5, None]


def test_carry_in_blocks_equals_a_plain_loop(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for f in ("hot", "small"):
        last = None
        for i in range(400 if f == "hot" else 30):
            event = rng.choice([None, None, None, None, "", f"{f}{i}"])
            last = event if event is not None else last
            rows.append((f, i * 3, event))
            expected[(f, i * 3)] = last
    df = spark.createDataFrame(rows, "file_id string, row_idx long, event string")
    out = R.carry_forward(df, {"carried": F.col("event")}, block=17).collect()
    assert {(r["file_id"], r["row_idx"]): r["carried"] for r in out} == expected


def test_hierarchy_preview(matrix):
    nodes = R.hierarchy_preview(matrix([HEADER, *BODY, ["", "gap", "", ""]]), LAYOUT).collect()
    assert sorted("/".join(r["path"]) for r in nodes) == sorted(
        ["Тюменская обл", "Тюменская обл/Тюмень", "Тюменская обл/Тюмень/8:01:06", "Тюменская обл/Тюмень/8:01:06/{guid1}", "Тюменская обл/Тюмень/8:01:06/{guid2}"])
    assert R.hierarchy_preview(matrix([HEADER, *BODY]), LAYOUT, max_nodes=2).count() == 2


def rolled(spark, cases, depth=3):
    rows = [(c, i, p.split("/") if p else [], t, {"potr": v}) for c, nodes in enumerate(cases) for i, (p, v, t) in enumerate(nodes)]
    schema = "case int, row_idx int, path array<string>, is_total boolean, values map<string,double>"
    return R.roll_up(R.node_values(spark.createDataFrame(rows, schema), ["case"]), depth, ["case"])


CASES = [
    ([("C", 100.0, False), ("C/a", 30.0, False), ("C/b", 50.0, False)], {"C": (100, 100, 80), "": (100, None, 100)}),
    ([("C", None, False), ("C/a", 30.0, False), ("C/b", 50.0, False)], {"C": (80, None, 80)}),
    ([("G", None, False), ("G/R1", None, False), ("G/R1/a", 10.0, False), ("G/R1/b", 5.0, False), ("G/R2", 20.0, False)],
     {"G/R1": (15, None, 15), "G": (35, None, 35), "": (35, None, 35)}),
    ([("G", 0.0, False), ("G/a", 99.0, False)], {"G": (0, 0, 99)}),
    ([("G", None, False)], {"G": (None, None, None), "": (None, None, None)}),
    ([("A", 100.0, False), ("B", 250.0, False), ("A/x", 40.0, False)], {"": (350, None, 350)}),
    ([("A", 100.0, False), ("Итого", 999.0, True)], {"": (100, None, 100), "Итого": (999, 999, None)}),
    ([("", 7.0, False), ("A", 3.0, False)], {"": (7, 7, 3)}),
    ([("A", 1.0, False), ("X/y/z", 5.0, False)], {"": (6, None, 6)}),
    ([("A", 1.0, False), ("A", 2.0, False), ("A/b", 9.0, False)], {"A": (2, 2, 9)}),
]


def test_roll_up(spark):
    got = {(r["case"], "/".join(r["path"])): (r["value"], r["own"], r["children_sum"]) for r in rolled(spark, [n for n, _ in CASES]).collect()}
    assert len(got) == sum(len({p for p, _, _ in n} | {""}) for n, _ in CASES)
    for c, (_, expected) in enumerate(CASES):
        for path, cell in expected.items():
            assert got[c, path] == cell, (c, path)


def test_entered_overlay_and_discrepancies(spark):
    cells = rolled(spark, [[("C", 100.0, False), ("C/a", 30.0, False), ("C/b", 50.0, False), ("D", 8.0, False), ("D/a", 8.0, False)]])
    out = R.discrepancies(cells, {"m": "potr"}, {"half": Calc(lambda p: p / 2, {"p": "potr"})}).collect()
    assert sorted((r["path"], r["metric"], r["own"], r["children_sum"]) for r in out) == [(["C"], "half", 50, 40), (["C"], "m", 100, 80)]
    entered = R.entered_values(cells, {"m": "potr"}, {"none": Calc(lambda p, q: p / q, {"p": "potr", "q": "lacking"})})
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("z", 2.0, 2.0)], "label string, m double, none double")
    shown = {r["label"]: (r["m"], r["m_from_node"], r["none"], r["none_from_node"]) for r in R.overlay(rows, entered, ["m", "none"], ["C"]).collect()}
    assert shown == {"a": (30.0, True, 1.0, False), "z": (2.0, False, 2.0, False)}


def test_import_from_a_matrix(matrix):
    report = import_report(matrix([HEADER, *BODY]), LAYOUT)
    assert [c.role for c in report.columns] == ["key"] * 4 + ["metric"] * 2
    assert report.leaves.count() == 2
    top = {("/".join(r["path"]), r["column"]): r["value"] for r in report.rolled.collect()}
    assert top[("", "headcount")] == 1639132 and top[("Тюменская обл", "area")] == 0.144


def test_header_groups():
    cols = R.report_columns([["", "G1", "", "G2", ""], ["k", "a", "b", "a", "c"]], (0,), (1, 2, 3, 4))
    groups = R.groups_by_header(cols, [R.Indicator("b", service_only=True)], [R.CalculatedIndicator("r", lambda x, y: x / y, {"x": "a", "y": "b"})], exclude=[])
    assert [(g.id, [m.id for m in g.metrics]) for g in groups] == [("G1", ["a", "r"]), ("G2", ["a", "c"])]
    ratio = groups[0].metrics[1]
    assert ratio.depends_on == {"x": "a"} and ratio.bindings["y"].column == "G1 · b"
    assert R.groups_by_header(cols, exclude=["G1", "G2"]) == []
