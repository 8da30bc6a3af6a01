"""Column types, date formats and statistics of a table, each in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyframe.functions.numeric import as_column, finite, num
from tallyframe.functions.text import DAY_FIRST_DATE_START, ISO_DATE_START, NUMBER, SPACE, TIME_ONLY, trim_all
from tallyframe.operators import percentile

SAMPLES = 5
# Date patterns that a majority of day-first dates calls for.
DOT_DATES, SLASH_DATES = "d.M.yyyy", "d/M/yyyy"


def _verdict(numbers: Column, dates: Column, filled: Column) -> Column:
    return (
        F.when(F.try_divide(numbers, filled) > 0.5, "numeric")
        .when(F.try_divide(dates, filled) > 0.5, "date")
        .otherwise("categorical")
    )


def _unpivoted_counts(df: DataFrame, counts: dict[str, list[Column]], names: Sequence[str]) -> DataFrame:
    """One aggregation of several counts over every column, turned to a row per column."""
    flat = df.agg(*[a.alias(f"__{i}_{n}") for i, per in enumerate(counts.values()) for n, a in zip(names, per)])
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"__{i}_{n}").alias(n) for n in names])
        for i, c in enumerate(counts)
    ]
    return flat.select(F.inline(F.array(*rows)))


def guess_types(df: DataFrame, decimal: str = ".") -> DataFrame:
    """``column, type`` guessed from text cells: over half numbers, over half dates, else categorical.

    A time is neither; with a decimal point a comma makes no number.
    """
    counts = {}
    for name in df.columns:
        text = trim_all(name)
        filled = text != ""
        time = text.rlike(TIME_ONLY)
        date = text.rlike(ISO_DATE_START) | text.rlike(DAY_FIRST_DATE_START)
        packed = F.regexp_replace(text, SPACE, "")
        packed = F.regexp_replace(packed, r"^([^,]*),", "$1.") if decimal == "," else packed
        number = packed.rlike(NUMBER)
        counts[name] = [F.count_if(filled & ~time & ~date & number), F.count_if(filled & ~time & date), F.count_if(filled)]
    table = _unpivoted_counts(df, counts, ["numbers", "dates", "filled"])
    return table.select("column", _verdict(F.col("numbers"), F.col("dates"), F.col("filled")).alias("type"))


def classify_typed(df: DataFrame) -> DataFrame:
    """``column, type`` of a typed table: numbers by type, whole-cell ISO dates in text."""
    counts = {}
    for f in df.schema.fields:
        c = as_column(f.name)
        is_text = isinstance(f.dataType, T.StringType)
        filled = c.isNotNull() & (c != "") if is_text else c.isNotNull()
        number = filled & F.lit(isinstance(f.dataType, T.NumericType))
        iso = c.rlike(r"^\d{4}-\d{2}-\d{2}$") if is_text else F.lit(isinstance(f.dataType, T.DateType))
        counts[f.name] = [F.count_if(number), F.count_if(filled & iso), F.count_if(filled)]
    table = _unpivoted_counts(df, counts, ["numbers", "dates", "filled"])
    return table.select("column", _verdict(F.col("numbers"), F.col("dates"), F.col("filled")).alias("type"))


def detect_date_format(df: DataFrame, date_columns: Sequence[str]) -> DataFrame:
    """One row ``date_format``: the pattern over half of the filled date cells have, else null."""
    if not date_columns:
        return df.limit(1).agg(F.lit(None).cast("string").alias("date_format"))
    counts = {}
    for name in date_columns:
        text = trim_all(name)
        counts[name] = [
            F.count_if(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}")),
            F.count_if(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}")),
            F.count_if(text != ""),
        ]
    table = _unpivoted_counts(df, counts, ["dots", "slashes", "filled"])
    dots, slashes, filled = (F.sum(c) for c in ("dots", "slashes", "filled"))
    chosen = F.when(F.try_divide(dots, filled) > 0.5, DOT_DATES).when(F.try_divide(slashes, filled) > 0.5, SLASH_DATES)
    return table.agg(chosen.alias("date_format"))


def _cell(f: T.StructField, number: int) -> Column:
    """A cell as a row of its column's number and its value under the narrowest type that keeps values apart."""
    c, kind = as_column(f.name), f.dataType
    whole, fractional = isinstance(kind, T.IntegralType), isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)
    return F.struct(
        F.lit(number).alias("i"),
        (F.lit(None) if whole or fractional else c).cast("string").alias("text"),
        (c if whole else F.lit(None)).cast("long").alias("whole"),
        (c if fractional else F.lit(None)).cast("double").alias("fraction"),
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """One row per column: counts by kind of cell, distinct values, five samples and number statistics.

    One wide aggregation gives all counts, extremes, sums and the bracket of each median. For the rest, columns are
    turned to rows of their typed values and reduced to distinct values with their counts, combined before the
    shuffle; unique counts, samples and medians come from that one shuffle, so the table is read twice and no value
    is turned to text before it is one of the distinct ones.
    """
    fields = df.schema.fields
    margins = [0.5 - percentile.MARGIN, 0.5 + percentile.MARGIN]
    counts: dict[str, list[Column]] = {}
    names = ("n", "total_values", "min", "max", "sum", "finite_count", "bracket")
    for f in fields:
        c, numeric = as_column(f.name), isinstance(f.dataType, T.NumericType)
        v = finite(num(c))
        null = F.max(F.lit(None).cast("double"))
        numbers = [F.min(v), F.max(v), F.sum(v), F.count(v), F.percentile_approx(v, margins, percentile.ACCURACY)]
        counts[f.name] = [F.count(F.lit(1)), F.count(c), *(numbers if numeric else [null, null, null, F.lit(0).cast("long"), F.lit(None).cast("array<double>")])]
    flat = df.agg(*[a.alias(f"__{i}_{n}") for i, per in enumerate(counts.values()) for n, a in zip(names, per)])
    rows = []
    for i, f in enumerate(fields):
        is_number, is_boolean = (F.lit(isinstance(f.dataType, t)) for t in (T.NumericType, T.BooleanType))
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), is_number.alias("is_number"), is_boolean.alias("is_boolean"), *[F.col(f"__{i}_{n}").alias(n) for n in names]))
    stats = flat.select(F.inline(F.array(*rows)))

    long = df.select(F.inline(F.array(*[_cell(f, i) for i, f in enumerate(fields)])))
    filled = F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("fraction").isNotNull()
    distinct = long.where(filled).groupBy("i", "text", "whole", "fraction").agg(F.count(F.lit(1)).alias("c"))
    distinct = distinct.withColumn("text", F.coalesce("text", F.col("whole").cast("string"), F.col("fraction").cast("string")))
    unique = distinct.groupBy("i").agg(F.count_if(F.col("c") > 0).alias("unique_count"))
    first = F.row_number().over(Window.partitionBy("i").orderBy("text"))
    # tests that look at the counts as well stay above the shuffle, so that all uses of the distinct values share it
    samples = distinct.where(F.col("c") > 0).select("i", "text", first.alias("place")).where(F.col("place") <= SAMPLES).groupBy("i").agg(F.sort_array(F.collect_list("text")).alias("samples"))
    out = stats.join(unique, "i", "left").join(samples, "i", "left")
    decimal = {i for i, f in enumerate(fields) if isinstance(f.dataType, T.DecimalType)}
    if any(isinstance(f.dataType, T.NumericType) for f in fields):
        as_number = F.coalesce(F.col("whole").cast("double"), F.col("fraction"), *([F.when(F.col("i").isin(decimal), F.col("text").try_cast("double"))] if decimal else []))
        bracket = stats.where(F.col("finite_count") > 0).select(
            F.col("i").alias("__k_i"), (F.lit(0.5) * (F.col("finite_count") - 1)).alias("rank"),
            F.get("bracket", F.lit(0)).alias("low"), F.get("bracket", F.lit(1)).alias("high"), percentile.salts_of(F.col("finite_count")).alias("salts"),
        )
        values = distinct.select("i", F.when(F.col("c") > 0, finite(as_number)).alias("v"), "c").where(F.col("v").isNotNull())
        out = out.join(percentile.by_cells(values, bracket, ["i"]).withColumnRenamed("exact", "median"), "i", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    count_if = lambda test: F.when(test, F.col("total_values")).otherwise(F.lit(0))
    return out.where(F.col("total_values") > 0).select(
        "column", "total_values", (F.col("n") - F.col("total_values")).alias("null_count"), "unique_count",
        count_if(F.col("is_number")).alias("numeric_count"), count_if(~F.col("is_number")).alias("text_count"), count_if(F.col("is_boolean")).alias("boolean_count"),
        "samples", "min", "max", F.try_divide("sum", "finite_count").alias("avg"), "sum", "median",
    )
