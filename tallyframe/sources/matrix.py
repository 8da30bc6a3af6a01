"""Report files as raw matrices, and what their text says about its dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyframe.session import stored

# Delimiter candidates in the order in which ties are decided.
DELIMITERS = (",", ";", "\t", "|")
# Stands for a delimiter inside quotes while a record is cut; a private-use character.
HIDDEN = "\ue000"


def split_cells(record: Column, sep: str) -> Column:
    """The cells of a record; delimiters inside quotes do not count, quoted cells are unquoted.

    The text is cut at its quotes, so every second part lies inside them; no look-ahead, and
    time in proportion to the record's length.
    """
    parts = F.transform(F.split(record, '"', -1), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(sep), F.lit(HIDDEN))).otherwise(p))
    cells = F.split(F.array_join(parts, '"'), f"\\Q{sep}\\E", -1)

    def unquote(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, r'(?s)^\s*"(.*)"\s*$', 1), F.lit('""'), F.lit('"'))
        return F.replace(F.when(c.rlike(r'(?s)^\s*".*"\s*$'), inner).otherwise(c), F.lit(HIDDEN), F.lit(sep))

    return F.transform(cells, unquote)


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``file_id, row_idx, cells`` of delimited files, without a header assumption.

    Lines end with LF, CR LF or CR; a quoted cell may hold line ends, which become LF. Large files are read in
    splits by many tasks. The lines are stored once with their split and their place in it, and all that is counted
    afterwards - rows of earlier splits, open quotes at the start of a split - is counted on the stored lines,
    so a second reading with other splits cannot disagree.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"), "value", (quotes % 2).cast("int").alias("odd"),
    )
    lines = stored(raw)
    # within a split: is the line's start inside quotes, if the split's start is outside
    in_split = Window.partitionBy("file_id", "split").orderBy("id")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    # records start at lines outside quotes; both cases of a split are numbered, one holds
    placed = placed.withColumns({
        "outer": F.sum(F.when(F.col("inside") == 0, 1).otherwise(0)).over(in_split),
        "inner": F.sum(F.when(F.col("inside") == 1, 1).otherwise(0)).over(in_split),
    })
    splits = lines.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).groupBy("file_id", "split").agg(
        F.sum("odd").alias("odd"), F.count_if(F.col("inside") == 0).alias("n_outer"), F.count_if(F.col("inside") == 1).alias("n_inner")
    )
    earlier = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("n", F.when(F.col("open") == 0, F.col("n_outer")).otherwise(F.col("n_inner")))
    splits = splits.select("file_id", "split", "open", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = placed.join(splits, ["file_id", "split"]).withColumns({
        "row_idx": F.col("first") + F.when(F.col("open") == 0, F.col("outer")).otherwise(F.col("inner")) - 1,
        "begins": F.col("inside") == F.col("open"),
    })
    # only lines of records that go over several lines are brought together
    alone = F.col("begins") & (F.col("odd") == 0)
    whole = rows.where(alone).select("file_id", "row_idx", "value")
    pieces = rows.where(~alone).groupBy("file_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("lines"))
    joined = pieces.select("file_id", "row_idx", F.array_join(F.transform("lines", lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(joined).select("file_id", "row_idx", split_cells(F.col("value"), sep).alias("cells"))


def sniff_dialect(spark: SparkSession, path: str) -> DataFrame:
    """Per file, the delimiter with most hits outside quotes on the header line, and the line ending.

    The line ending needs the text with its carriage returns, so lines are cut at LF only here.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value"
    )
    first = lines.where(F.col("split") == 0).groupBy("file_id").agg(F.min_by("value", "id").alias("line"))
    header = F.regexp_extract("line", "^([^\r]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(header, '"[^"]*"', ""), '".*$', "")
    hits = [F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*hits)
    delimiter = F.coalesce(*[F.when(h == most, F.lit(d)) for d, h in zip(DELIMITERS, hits)])
    ending = F.when(F.col("line").rlike("^[^\r]*\r$"), "\r\n").when(F.contains("line", F.lit("\r")), "\r").otherwise("\n")
    return first.select("file_id", delimiter.alias("delimiter"), ending.alias("line_ending"))
