"""Delimited records over split edges, against Spark's own reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import tables as S
from tallyframe.sources.records import inside_after, records

COLUMNS = {"a": "categorical", "b": "categorical", "c": "categorical"}


@pytest.fixture
def split_bytes(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = [spark.conf.get(k) for k in keys]

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "10")

    yield use
    for k, v in zip(keys, was):
        spark.conf.set(k, v)


def whole_files(spark, folder):
    back = spark.read.csv(str(folder), schema="a string, b string, c string", quote='"', escape='"', header=True, multiLine=True)
    return sorted((tuple(r) for r in back.collect() if any(x and x.strip() for x in r)), key=str)


def in_splits(spark, folder):
    back = S.read_csv(spark, str(folder), COLUMNS)
    return back, sorted((tuple(r) for r in back.collect() if any(x and x.strip() for x in r)), key=str)


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("a,b", False, True), ('a,"b', True, False), ('a,"b",c', False, False), ('"a""b",c', False, False), ('5" pipe,x', False, False),
        ('x"', False, False), ('"', True, False), ('""', False, True), ('"x"y,"z', True, True), ("", False, True), ('b","c', True, True),
    ],
)
def test_effect_of_a_line(line, outside, inside):
    assert (inside_after(line, False, ","), inside_after(line, True, ",")) == (outside, inside)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_equal_those_of_whole_files(spark, tmp_path, split_bytes, seed):
    rng = random.Random(seed)

    def cell():
        body = "".join(rng.choice(["a", "b", "x y", "é", ",", "\n", '""', "1"]) for _ in range(rng.randrange(6)))
        kind = rng.random()
        if kind < 0.5:
            return "".join(c for c in body if c not in ',\n"')
        return '"' + body + '"' if kind < 0.9 else rng.choice(['5" pipe', 'a"b', '"x"y', '"x" ', ' "z"', '"a"b"c'])

    for name in "pq":
        end = rng.choice(["\n", "\r\n"])
        text = end.join(["h1,h2,h3", *(",".join(cell() for _ in range(3)) for _ in range(150))]) + end
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    want = whole_files(spark, tmp_path)
    split_bytes(rng.choice([300, 900]))
    back, got = in_splits(spark, tmp_path)
    assert got == want and back.rdd.getNumPartitions() > 4


def test_a_cell_over_many_splits_and_a_header_with_breaks(spark, tmp_path, split_bytes):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "t.csv").write_text(f'"a\nhead",b,c\n1,"{long}",x\n2,y,"{long}"\n3,,z\n')
    split_bytes(500)
    _, got = in_splits(spark, tmp_path)
    assert got == sorted([("1", long, "x"), ("2", "y", long), ("3", None, "z")], key=str)


def test_a_quote_that_is_never_closed_ends_with_its_file(spark, tmp_path, split_bytes):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n" + '4,5,"6\n' + "7,8,9\n" * 200)
    (tmp_path / "u.csv").write_text('a,b,c\n1,"x\ny",3\n')
    split_bytes(100)
    _, got = in_splits(spark, tmp_path)
    assert [r[:2] for r in got] == [("1", "2"), ("1", "x\ny"), ("4", "5")] and got[2][2].startswith("6\n7,8,9\n7,8,9")


def test_files_without_breaks_are_read_line_by_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,"x ""y"", z",3\n5" pipe,,\n')
    assert records(spark, str(tmp_path)) is None
    assert in_splits(spark, tmp_path)[1] == [("1", 'x "y", z', "3"), ('5" pipe', None, None)]


def test_other_splits_than_at_first_are_an_error(spark, tmp_path, split_bytes):
    (tmp_path / "t.csv").write_text("a,b,c\n" + '1,"x\ny",3\n' * 300)
    split_bytes(500)
    back = S.read_csv(spark, str(tmp_path), COLUMNS)
    split_bytes(700)
    with pytest.raises(Exception, match="other splits"):
        back.agg(F.count("b")).collect()
