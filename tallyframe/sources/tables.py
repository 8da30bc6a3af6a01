"""Delimited text, saved datasets and appended parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyframe.functions.numeric import as_column, num
from tallyframe.functions.text import SPACE, clean_cells, trim_all
from tallyframe.operators.filters import CLASSIFICATION
from tallyframe.operators.report import ReportColumn
from tallyframe.sources.datasets import load_dataset, save_dataset  # noqa: F401
from tallyframe.sources.matrix import split_cells
from tallyframe.sources.records import records

# Rows of a preview and of one exported piece, where the caller names no number.
PREVIEW_ROWS = 500
EXPORT_PIECE_ROWS = 100_000
RECORD = "__record"


def typed(c: Column, classification: str, decimal: str = ".", date_format: str | None = None) -> Column:
    """A text cell as its column's classification asks; what cannot be read is null."""
    if classification == "numeric":
        packed = F.regexp_replace(c, SPACE, "")
        return num(F.replace(packed, F.lit(","), F.lit(".")) if decimal == "," else packed)
    if classification == "date":
        iso = c.try_cast("timestamp")
        return F.coalesce(F.try_to_timestamp(c, F.lit(date_format)), iso) if date_format else iso
    return c


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Mapping[str, str],
    sep: str = ",",
    decimal: str = ".",
    date_format: str | None = None,
    quoted_breaks: bool | None = None,
    rejects: bool = False,
) -> DataFrame:
    """Delimited text with a header, each column typed by its classification.

    ``columns`` maps the names in file order to ``numeric``, ``categorical``, ``date`` or
    ``ignore``; codes in categorical columns keep their leading zeros. Short rows are padded
    with nulls. Rows with too many cells are left out; with ``rejects`` they are what is
    given, as ``record``. ``date_format`` is a Spark pattern. Quoted cells may hold line breaks, which a first
    pass over the files looks for (see ``sources.records``); ``quoted_breaks=False`` says that there are none and
    saves it. Files are read in splits either way. Records of white space alone are no rows.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*columns, RECORD]])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": "false"}
    several = records(spark, path, sep) if quoted_breaks is not False else None
    if several is None:
        raw = spark.read.schema(schema).options(header=True, **options).csv(path)
    else:
        cells = several.where("NOT head").select(F.from_csv("value", F.lit(schema.toDDL()), options).alias("cells"))
        raw = cells.select(*[F.col("cells")[n].alias(n) for n in schema.names])
    # Spark keeps the record of a row whose number of cells is not the header's, and wants another column read with it
    beside = F.coalesce(as_column(next(iter(columns))), F.lit("")) >= ""
    overlong = F.coalesce(F.size(split_cells(F.rtrim(F.col(RECORD), F.lit("\r\n")), sep)) > len(columns), F.lit(False)) & beside
    if rejects:
        return raw.where(overlong).select(F.col(RECORD).alias("record"))
    rows = raw.where(~overlong)
    return rows.select(
        *[
            typed(as_column(n), kind, decimal, date_format).alias(n, metadata={CLASSIFICATION: kind})
            for n, kind in columns.items()
        ]
    )


def append_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Many parts as one table, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def export_pieces(df: DataFrame, path: str, rows: int = EXPORT_PIECE_ROWS) -> DataFrame:
    """Write in files of at most ``rows`` rows each."""
    return save_dataset(df, path, max_rows_per_file=rows)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, as many as asked for, at least one."""
    return df.limit(max(1, rows))


def sync(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The load of a database table, for a reader such as ``spark.read.jdbc``: whole unless a number is given."""
    return df if rows is None else preview(df, rows)


def key_value_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Both columns as trimmed text, without rows where either is missing or blank."""
    pairs = df.select(trim_all(key).alias("key"), trim_all(value).alias("value"))
    return pairs.where((F.col("key") != "") & (F.col("value") != ""))


def cleaned(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns as ``kind, text, number`` structs of their cleaned cells."""
    return clean_cells(df, columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a cell that is neither null nor an empty text, after cleaning."""
    filled = []
    for f in df.schema.fields:
        if columns and f.name not in columns:
            continue
        c = as_column(f.name)
        if isinstance(f.dataType, T.StructType):
            filled.append(c["text"].isNotNull())
        elif isinstance(f.dataType, T.StringType):
            filled.append(c != "")
        else:
            filled.append(c.isNotNull())
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in filled]))


def align_to(df: DataFrame, saved: T.StructType) -> DataFrame:
    """A replaced dataset under its saved configuration.

    Kept columns take their saved type and classification, vanished ones become typed nulls
    marked ``ignore``, new ones follow as they are.
    """
    out = []
    for f in saved.fields:
        kept = f.name in df.columns
        cell = as_column(f.name).try_cast(f.dataType.simpleString()) if kept else F.lit(None).cast(f.dataType)
        metadata = dict(f.metadata or {}) if kept else {**(f.metadata or {}), CLASSIFICATION: "ignore"}
        out.append(cell.alias(f.name, metadata=metadata))
    return df.select(*out, *[as_column(n) for n in df.columns if n not in saved.fieldNames()])


def column_changes(df: DataFrame, saved: T.StructType) -> tuple[list[str], list[str]]:
    """Names added to and removed from the saved configuration."""
    names = saved.fieldNames()
    return [n for n in df.columns if n not in names], [n for n in names if n not in df.columns]


def write_leaves(leaves: DataFrame, columns: Sequence[ReportColumn], path: str) -> None:
    """Flat leaf table as CSV: metrics with a decimal point or empty, text quoted where needed."""
    names = [c.full_name for c in columns]
    text = [_plain_number(as_column(c.full_name)).alias(c.full_name) if c.role == "metric" else as_column(c.full_name) for c in columns]
    leaves.select(*names).select(*text).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def _plain_number(c: Column) -> Column:
    """Shortest decimal text of a double, without an exponent and without a trailing ``.0``."""
    size = F.abs(c)

    def decimal(scale: int) -> Column:
        return F.rtrim(F.rtrim(c.try_cast(f"decimal(38,{scale})").cast("string"), F.lit("0")), F.lit("."))

    return (
        F.when((c == F.floor(c)) & (size < 1e15), c.cast("decimal(38,0)").cast("string"))
        .when((size >= 1e7) & (size < 1e21), decimal(9))
        .when((size >= 1e-6) & (size < 1e-3), decimal(24))
        .otherwise(c.cast("string"))
    )
