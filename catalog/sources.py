"""Sources, sinks, cleaning and profiling (S rows). Text is made from the tables by string expressions."""

from pyspark.sql import functions as F, types as T

from catalog.base import query, rounded
from tallyframe.functions.text import clean_cells, fetched_cells, parse_date_text, transliterate
from tallyframe.operators import profile as P
from tallyframe.operators.report import ReportColumn
from tallyframe.session import shared_folder
from tallyframe.sources import matrix as M, tables as S


def price_text():
    return F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))


def day_text():
    return F.date_format("o_orderdate", "dd.MM.yyyy")


def code():
    return F.lpad(F.col("o_orderkey").cast("string"), 9, "0")



@query("csv_scan_s1", """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS code, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price,
  strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority || '; "' || o_orderstatus || '"' AS note FROM orders""")
def _(t):
    folder = shared_folder(t.spark)
    price = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(price_text())
    note = F.concat("o_orderpriority", F.lit('; "'), "o_orderstatus", F.lit('"'))
    text = t.orders.select(code().alias("code"), price.alias("price"), day_text().alias("day"), note.alias("note"))
    text.write.csv(folder, header=True, sep=";", quote='"', escape='"')
    columns = {"code": "categorical", "price": "numeric", "day": "date", "note": "categorical"}
    back = S.read_csv(t.spark, folder, columns, ";", ",", "dd.MM.yyyy")
    return back.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("csv_breaks_and_overlong_rows_s1", """
SELECT CAST(o_orderkey AS VARCHAR) AS code, o_orderpriority || chr(10) || 'second "line"' AS note FROM orders WHERE o_orderkey % 5 <> 0""")
def _(t):
    folder = shared_folder(t.spark)
    note = F.concat(F.lit('"'), "o_orderpriority", F.lit('\nsecond ""line"""'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), note, F.when(F.col("o_orderkey") % 10 == 0, ",9").when(F.col("o_orderkey") % 5 == 0, ""))
    t.orders.select(F.concat(F.lit("code,note\n"), line)).write.text(folder)
    return S.read_csv(t.spark, folder, {"code": "categorical", "note": "categorical"}).where(F.col("code") != "code")


@query("csv_rejects_s1", "SELECT count(*) FILTER (o_orderkey % 5 = 0) AS rejected FROM orders")
def _(t):
    folder = shared_folder(t.spark)
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, ",9").when(F.col("o_orderkey") % 5 == 0, ""))
    t.orders.select(F.concat(F.lit("code,note\n"), line)).write.text(folder)
    got = S.read_csv(t.spark, folder, {"code": "categorical", "note": "categorical"}, rejects=True)
    header = F.regexp_extract("record", "^[0-9]+", 0) != ""
    return got.where(header).agg(F.count(F.lit(1)).alias("rejected"))


@query("append_parts_s3", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS o_orderpriority FROM orders""")
def _(t):
    o = t.orders
    pick = lambda s, *c: o.where(F.col("o_orderstatus") == s).select(*c)
    return S.append_parts([
        pick("P", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"),
        pick("F", "o_orderpriority", "o_custkey", "o_orderkey"),
        pick("O", "o_totalprice", "o_orderkey", "o_custkey"),
    ])


@query("raw_matrix_s4", """
SELECT 'seg=' || c_mktsegment AS file, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS row_idx, c_name AS first,
  'a "b", ' || c_mktsegment AS second, CAST(c_acctbal AS VARCHAR) AS third, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 4 END AS width FROM customer""")
def _(t):
    folder = shared_folder(t.spark)
    quoted = F.concat(F.lit('"a ""b"", '), "c_mktsegment", F.lit('"'))
    extra = F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit(","))
    lines = t.customer.select(F.col("c_mktsegment").alias("seg"), "c_custkey", F.concat(F.concat_ws(",", "c_name", quoted, F.col("c_acctbal").cast("string")), extra).alias("line"))
    lines.repartition("seg").sortWithinPartitions("seg", "c_custkey").select("seg", "line").write.partitionBy("seg").text(folder)
    rows = M.read_matrix(t.spark, folder)
    return rows.select(F.regexp_extract("file_id", "/(seg=[^/]+)/", 1).alias("file"), "row_idx", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("first", "second", "third"))], F.size("cells").alias("width"))


@query("save_and_reload_s5", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return S.save_dataset(t.supplier, shared_folder(t.spark))


@query("replace_from_itself_s5", "SELECT count(*) AS before, count(*) FILTER (s_acctbal > 0) AS after FROM supplier")
def _(t):
    folder = shared_folder(t.spark)
    first = S.save_dataset(t.supplier, folder)
    second = S.save_dataset(first.where("s_acctbal > 0"), folder)
    return first.agg(F.count(F.lit(1)).alias("before")).withColumn("after", second.agg(F.count(F.lit(1))).scalar())


@query("export_in_pieces_s6", "SELECT count(*) AS n, TRUE AS within FROM lineitem")
def _(t):
    back = S.export_pieces(t.lineitem, shared_folder(t.spark), rows=10_000)
    files = back.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 10_000).alias("within"))


@query("preview_s7", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7000")
def _(t):
    return S.preview(t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), 7_000)


@query("key_value_pairs_s9", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 0""")
def _(t):
    value = F.when(F.col("o_orderstatus") == "P", "   ").otherwise(F.concat(F.lit(" "), "o_orderstatus"))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, value).alias("v"))
    return S.key_value_pairs(rows, "o_orderkey", "v")


LEAF_COLUMNS = [ReportColumn(0, "", "name", "key"), ReportColumn(1, "", "price", "metric")]


@query("leaf_csv_s10", """
SELECT '"' || p_name || ', ""' || p_brand || repeat(chr(34), 3) || ',' || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR)
  ELSE CAST(p_retailprice + 0.25 AS VARCHAR) END AS line FROM part""")
def _(t):
    folder = shared_folder(t.spark)
    price = F.when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("double")).when(F.col("p_partkey") % 3 == 2, F.col("p_retailprice") + 0.25)
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    S.write_leaves(t.part.select(name.alias("name"), price.alias("price")), LEAF_COLUMNS, folder)
    return t.spark.read.text(folder).select(F.col("value").alias("line")).where(F.col("line") != "name,price")


# o_orderkey % 10 -> a raw cell
def dirty():
    k = F.col("o_orderkey") % 10
    return (
        F.when(k == 0, F.concat(F.lit("  1 "), price_text(), F.lit(" "))).when(k == 1, " Н/Д ").when(k == 2, "——").when(k == 3, day_text())
        .when(k == 4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 5, "N/A").when(k == 6, "12:30")
        .when(k == 7, F.concat(F.lit("7900"), code())).when(k == 8, "31.02.2024").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    )


KIND_SQL = """
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'number' WHEN 3 THEN 'date' WHEN 4 THEN 'date' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 5 THEN NULL ELSE 'text' END AS kind,
  CASE o_orderkey % 10 WHEN 0 THEN '1' || CAST(o_totalprice AS VARCHAR) WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 6 THEN '12:30' WHEN 7 THEN '7900' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') WHEN 8 THEN '31.02.2024' WHEN 9 THEN o_orderpriority END AS text,
  CASE WHEN o_orderkey % 10 = 0 THEN CAST('1' || CAST(o_totalprice AS VARCHAR) AS DOUBLE) END AS number FROM orders"""


@query("clean_cells_s11", KIND_SQL)
def _(t):
    c = clean_cells(t.orders.select("o_orderkey", dirty().alias("c")), ["c"])
    return c.select("o_orderkey", "c.kind", "c.text", "c.number")


@query("date_texts_s12", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(k == 1, F.date_format("o_orderdate", "d.M.yyyy H:mm"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"))
        .otherwise("05:03:01")
    )
    return t.orders.select("o_orderkey", parse_date_text(text).alias("day"))


@query("fetched_cells_s13", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN NULL WHEN 2 THEN 'text' ELSE 'number' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 3 THEN 125 END AS number,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 2 THEN '15.01.2024' WHEN 3 THEN '1.25e2' END AS text FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, price_text()).when(k == 1, " ").when(k == 2, "15.01.2024 ").otherwise("1,25e2")
    c = fetched_cells(t.orders.select("o_orderkey", cell.alias("c")), ["c"])
    return c.select("o_orderkey", "c.kind", "c.number", "c.text")


@query("drop_empty_rows_s14", "SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END AS b FROM orders WHERE o_orderkey % 4 IN (1, 2)")
def _(t):
    k = F.col("o_orderkey") % 4
    raw = t.orders.select(
        F.when(k == 0, "-").when(k.isin(1, 2), F.col("o_orderpriority")).otherwise("").alias("a"),
        F.when(k == 1, F.col("o_orderstatus")).when(k == 2, "n/a").when(k == 0, "NULL").alias("b"),
    )
    return S.drop_empty_rows(S.cleaned(raw)).select(F.col("a.text").alias("a"), F.col("b.text").alias("b"))


def text_columns(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        code().alias("code"), price_text().alias("price"), day_text().alias("day"), F.lit(" ").alias("blank"),
        F.lit("01:01").alias("time"), F.when(k % 5 < 2, F.lit("x")).otherwise(k.cast("string")).alias("mostly_numbers"),
        F.col("o_orderpriority").alias("words"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("iso"),
    )


@query("guess_types_comma_s15", """
SELECT * FROM (VALUES ('code', 'numeric'), ('price', 'numeric'), ('day', 'date'), ('blank', 'categorical'), ('time', 'categorical'),
  ('mostly_numbers', CASE WHEN (SELECT count(*) FILTER (o_orderkey % 5 >= 2) / count(*) FROM orders) > 0.5 THEN 'numeric' ELSE 'categorical' END),
  ('words', 'categorical'), ('iso', 'date')) AS v("column", type)""")
def _(t):
    return P.guess_types(text_columns(t), ",")


@query("guess_types_point_s15", """
SELECT * FROM (VALUES ('price', CASE WHEN (SELECT count(*) FROM orders) < 0 THEN 'numeric' ELSE 'categorical' END), ('mostly_numbers', 'numeric')) AS v("column", type)""")
def _(t):
    return P.guess_types(text_columns(t).select("price", "mostly_numbers"))


@query("classify_typed_s16", """
SELECT * FROM (VALUES ('p_partkey', 'numeric'), ('p_name', 'categorical'), ('p_retailprice', 'numeric'), ('made', 'date'), ('flag', 'categorical')) AS v("column", type)
WHERE (SELECT count(*) FROM part) > 0""")
def _(t):
    made = F.when(F.col("p_partkey") % 5 < 3, F.lit("2024-01-15")).otherwise("01:01")
    return P.classify_typed(t.part.select("p_partkey", "p_name", "p_retailprice", made.alias("made"), (F.col("p_size") > 10).alias("flag")))


@query("date_format_s17", """
SELECT CASE WHEN count(*) FILTER (o_orderkey % 3 > 0) / count(*) > 0.5 THEN 'd.M.yyyy' END AS date_format FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 3 > 0, day_text()).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return P.detect_date_format(t.orders.select(text.alias("day"), code().alias("code")), ["day"])


STAT_SQL = """
SELECT '{c}' AS "column", count(v) AS total_values, count(*) - count(v) AS null_count, count(DISTINCT v) AS unique_count,
  {n} AS numeric_count, {t} AS text_count, CAST(0 AS BIGINT) AS boolean_count,
  (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT CAST({e} AS VARCHAR) AS x FROM orders WHERE {e} IS NOT NULL ORDER BY x LIMIT 5)) AS samples,
  {stats} FROM (SELECT {e} AS v FROM orders)"""
NUMERIC = "CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max, round(avg(v), 4) AS avg, round(CAST(sum(v) AS DOUBLE), 2) AS sum, round(CAST(median(v) AS DOUBLE), 4) AS median"
TEXTUAL = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg, CAST(NULL AS DOUBLE) AS sum, CAST(NULL AS DOUBLE) AS median"


def _stat(column: str, numeric: bool, expression: str | None = None) -> str:
    n, text = ("count(v)", "CAST(0 AS BIGINT)") if numeric else ("CAST(0 AS BIGINT)", "count(v)")
    return STAT_SQL.format(c=column, e=expression or column, n=n, t=text, stats=NUMERIC if numeric else TEXTUAL)


@query("column_statistics_s19", " UNION ALL ".join([
    _stat("o_custkey", True), _stat("o_totalprice", True), _stat("o_orderpriority", False),
    _stat("some", True, "CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END"),
]))
def _(t):
    rows = t.orders.select("o_custkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("some"))
    stats = P.column_statistics(rows).withColumn("samples", F.array_join("samples", "|"))
    return rounded(rounded(stats, 4, "avg", "median"), 2, "sum")


@query("statistics_of_unclean_numbers_s19", """
SELECT 'v' AS "column", count(*) AS total_values, round(avg(o_totalprice) FILTER (o_orderkey % 5 > 0), 4) AS avg, round(min(o_totalprice) FILTER (o_orderkey % 5 > 0), 2) AS min,
  round(max(o_totalprice) FILTER (o_orderkey % 5 > 0), 2) AS max, round(median(o_totalprice) FILTER (o_orderkey % 5 > 0), 4) AS median FROM orders""")
def _(t):
    v = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    stats = P.column_statistics(t.orders.select(v.alias("v"))).select("column", "total_values", "avg", "min", "max", "median")
    return rounded(rounded(stats, 4, "avg", "median"), 2, "min", "max")


@query("dialect_sniff_s20", "SELECT ';' AS delimiter, chr(13) || chr(10) AS line_ending, count(DISTINCT n_nationkey % 3) AS files FROM nation")
def _(t):
    folder = shared_folder(t.spark)
    parts = t.nation.select(
        F.concat(F.lit("part="), (F.col("n_nationkey") % 3).cast("string")).alias("p"),
        F.concat_ws(";", F.lit('"a,b,c"'), "n_name", F.col("n_regionkey").cast("string"), F.lit("\r")).alias("value"),
    )
    parts.write.partitionBy("p").text(folder)
    return M.sniff_dialect(t.spark, folder).groupBy("delimiter", "line_ending").agg(F.count(F.lit(1)).alias("files"))


@query("align_to_saved_s22", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_orderstatus AS VARCHAR) AS o_orderstatus, CAST(NULL AS DOUBLE) AS gone, o_orderpriority AS added FROM orders""")
def _(t):
    saved = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.StringType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("gone", T.DoubleType()),
    ])
    fresh = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("added"))
    return S.align_to(fresh, saved)


@query("transliterate_s23", """
SELECT p_partkey, 'obschaya_ploschad_' || regexp_replace(lower(replace(p_name, ' ', '_')), '[^a-z0-9_]', '', 'g') || '_zhyoltyy_' || CAST(p_size AS VARCHAR) AS alias FROM part""")
def _(t):
    text = F.concat(F.lit("Общая  площадь - "), "p_name", F.lit(" (Жёлтый) -"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", transliterate(text).alias("alias"))
