"""Text files, cleaning and profiling."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as TX
from tallyframe.operators import profile as P
from tallyframe.operators.report import ReportColumn
from tallyframe.sources import matrix as M, tables as S


def column(frame, values, f):
    return [r[0] for r in frame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_keys(frame):
    key = lambda mode: lambda c: TX.normalize_key(c, mode)
    assert column(frame, ["  01512000106 "], key("none")) == ["01512000106"]
    assert column(frame, ["1512000106", "1512000106.0", "абв-123", None], key("lpad11")) == ["01512000106", "01512000106", "абв-123", ""]
    assert column(frame, ["1201802", "123456789"], key("lpad8")) == ["01201802", "123456789"]


def test_clean_cells(frame):
    raw = ["  x ", "", " — ", "н/д", "НД", "N/A", "na", "NULL", "1 234,56", "-3.5e2", "1000000000000", "15.01.2024", "1/2/2024 10:30",
           "2024-01-15T10:30:00", "31.02.2024", "05:03", "007", None, "1,2,3"]
    out = TX.clean_cells(frame([(i, v) for i, v in enumerate(raw)], "i int, v string"), ["v"]).orderBy("i").select("v.*").collect()
    assert [tuple(r) for r in out] == [
        ("text", "x", None), *[(None, None, None)] * 7, ("number", "1234.56", 1234.56), ("number", "-3.5e2", -350.0),
        ("text", "1000000000000", None), ("date", "2024-01-15", None), ("date", "2024-02-01", None), ("date", "2024-01-15", None),
        ("text", "31.02.2024", None), ("text", "05:03", None), ("number", "007", 7.0), (None, None, None), ("text", "1,2,3", None),
    ]


def test_transliterate(frame):
    assert column(frame, ["Общая площадь, м2", "Ёж - Щука", "ABC"], TX.transliterate) == ["obschaya_ploschad_m2", "yozh_schuka", "abc"]


@pytest.mark.parametrize(
    "values, decimal, expected",
    [
        (["1.5", "2", "x"], ".", "numeric"), (["1,5", "2,5"], ".", "categorical"), (["1,5", "2,5"], ",", "numeric"), (["1 234,56"], ",", "numeric"),
        (["01:01", "02:02"], ".", "categorical"), (["2024-01-15", "2024-02-01"], ".", "date"), (["15.03.2024"], ",", "date"), (["", "  "], ".", "categorical"),
        (["1", "a"], ".", "categorical"),
    ],
)
def test_guess_types(frame, values, decimal, expected):
    assert P.guess_types(frame([(v,) for v in values], "c string"), decimal).collect()[0]["type"] == expected


def test_date_format(frame):
    df = frame([("15.03.2024", "1/2/2024"), ("16.03.2024", None), ("", "")], "a string, b string")
    chosen = lambda *c: P.detect_date_format(df, c).collect()[0][0]
    assert chosen("a") == "d.M.yyyy" and chosen("b") == "d/M/yyyy" and chosen("a", "b") == "d.M.yyyy" and chosen() is None


def test_statistics(frame):
    df = frame([(1.0, "x", True), (2.0, "y", None), (4.0, "x", False), (None, None, None)], "n double, s string, b boolean")
    out = {r["column"]: r for r in P.column_statistics(df).collect()}
    n = out["n"]
    assert (n["total_values"], n["null_count"], n["unique_count"], n["min"], n["max"], n["sum"], n["median"]) == (3, 1, 3, 1, 4, 7, 2)
    assert n["avg"] == pytest.approx(7 / 3) and (out["s"]["unique_count"], out["s"]["text_count"], out["s"]["samples"]) == (2, 3, ["x", "y"])
    assert out["b"]["boolean_count"] == 2 and out["b"]["sum"] is None


def test_csv_rows_of_wrong_length(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code;v;day\n007;1 234,5;15.03.2024\n008;x\n009;1;2024-01-02;extra\n"a;""b""";2;\n', encoding="utf8")
    df = S.read_csv(spark, str(tmp_path), {"code": "categorical", "v": "numeric", "day": "date"}, ";", ",", "dd.MM.yyyy")
    rows = [(r["code"], r["v"], r["day"] and str(r["day"].date())) for r in df.collect()]
    assert rows == [("007", 1234.5, "2024-03-15"), ("008", None, None), ('a;"b"', 2.0, None)]
    assert df.schema["code"].metadata["classification"] == "categorical"


def test_matrix_rows_are_numbered_over_splits(spark, tmp_path):
    for name, n in (("big", 3000), ("small", 5)):
        (tmp_path / f"{name}.csv").write_text("".join(f'{name},"{i}, ""q""",\n' for i in range(n)), encoding="utf8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = M.read_matrix(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3005
    for r in rows:
        assert r["cells"] == [r["cells"][0], f'{r["row_idx"]}, "q"', ""]


def test_dialects(spark, tmp_path):
    files = {"a": '"x,y,z";b\r\n1;2\r\n', "b": "x\ty\n", "c": "plain\n", "d": "a|b|c,d\r1|2|3"}
    for name, body in files.items():
        (tmp_path / f"{name}.txt").write_bytes(body.encode())
    out = {r["file_id"][-5]: (r["delimiter"], r["line_ending"]) for r in M.sniff_dialect(spark, str(tmp_path)).collect()}
    assert out == {"a": (";", "\r\n"), "b": ("\t", "\n"), "c": (",", "\n"), "d": ("|", "\r")}


def test_leaf_csv(spark, frame, tmp_path):
    df = frame([('a "x", b', 1.5), ("c", 2.0), ("", None), ("d", 0.1), ("e", 12345678.5), ("f", -0.00012)], "k string, v double")
    S.write_leaves(df, [ReportColumn(0, "", "k", "key"), ReportColumn(1, "", "v", "metric")], str(tmp_path / "out"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert lines == {"k,v", '"a ""x"", b",1.5', "c,2", ",", "d,0.1", "e,12345678.5", "f,-0.00012"}


def test_align_append_and_pieces(spark, frame, tmp_path):
    saved = frame([(1, "x")], "a int, gone string").schema
    out = S.align_to(frame([("5", True), ("x", False)], "a string, new boolean"), saved)
    assert [tuple(r) for r in out.collect()] == [(5, None, True), (None, None, False)]
    assert out.schema["gone"].metadata["classification"] == "ignore" and S.column_changes(out.drop("gone"), saved) == (["new"], ["gone"])
    parts = S.append_parts([frame([(1,)], "a int"), frame([("z", 2)], "b string, a int")])
    assert {tuple(r) for r in parts.collect()} == {(1, None), (2, "z")}
    back = S.export_pieces(spark.range(250).coalesce(1), str(tmp_path / "p"), rows=100)
    assert back.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).collect()[0][0] <= 100 and back.count() == 250
    assert S.preview(spark.range(10), 0).count() == 1 and S.preview(spark.range(9000), 9000).count() == 9000
    assert S.sync(spark.range(60_000)).count() == 60_000 and S.sync(spark.range(100), 7).count() == 7


def matrix_rows(spark, folder, **k):
    return {(r["file_id"].rsplit("/", 1)[-1], r["row_idx"]): r["cells"] for r in M.read_matrix(spark, str(folder), **k).collect()}


def test_matrix_takes_quoted_breaks_wide_rows_and_carriage_returns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n"x, ""y""\nz",2\n,\n')
    (tmp_path / "b.csv").write_bytes(b"p,q\r1,2\r")
    (tmp_path / "c.csv").write_text(",".join('"a,b"' for _ in range(20_000)) + "\n")
    got = matrix_rows(spark, tmp_path)
    assert got["a.csv", 0] == ["h1", "h2"] and got["a.csv", 1] == ['x, "y"\nz', "2"] and got["a.csv", 2] == ["", ""]
    assert got["b.csv", 0] == ["p", "q"] and got["b.csv", 1] == ["1", "2"]
    assert got["c.csv", 0] == ["a,b"] * 20_000 and len(got) == 6


def test_matrix_rows_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f'{i},"a\nb {i}"\n' if i % 97 == 0 else f"{i},v\n" for i in range(30_000))
    (tmp_path / "big.csv").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        rows = M.read_matrix(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "17000")
        got = {r["row_idx"]: r["cells"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {i: [str(i), f"a\nb {i}" if i % 97 == 0 else "v"] for i in range(30_000)}


def test_overlong_rows_are_left_out_and_can_be_seen(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,2\n1,2,,9\n1,2,\n3\n4,"x\ny"\n5,6,7\n')
    read = lambda **k: S.read_csv(spark, str(tmp_path), {"a": "numeric", "b": "categorical"}, **k)
    assert sorted(map(tuple, read().collect()), key=str) == [(1.0, "2"), (3.0, None), (4.0, "x\ny")]
    assert len(read(rejects=True).collect()) == 3
