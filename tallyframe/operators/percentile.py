"""Exact interpolated percentiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here a
mergeable sketch brackets the wanted rank first; values outside the bracket are only
counted, and those inside are cut into cells by value. Counts per cell tell which cell
holds the rank, so what is put in order is one cell of a sliver of the group.

Rows meet the bracket of their group by a join on the group and a salt. A group that the first pass found to be large
has one salt for each ``SALT_ROWS`` of its rows, with its bracket repeated as often, so no task gets more of it than
that whatever share of the table the group has. What rows learn of it beforehand is the list of large groups: one entry
for that many rows of the table at most, small enough to be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.numeric import as_column, finite, num

# The sketch's rank error is 1/ACCURACY of a group; the bracket is wider on both sides.
ACCURACY = 10_000
MARGIN = 5 / ACCURACY
# Cells a bracket is cut into.
CELLS = 1024
# Rows of a group that meet its bracket under one salt.
SALT_ROWS = 1_000_000


def salts_of(n: Column) -> Column:
    return F.ceil(n / SALT_ROWS).cast("int")


def with_brackets(rows: DataFrame, brackets: DataFrame, same_group: Sequence[Column]) -> DataFrame:
    """The rows beside the bracket of their group, large groups dealt over several tasks."""
    large = brackets.where("salts > 1").select(*[c for c in brackets.columns if c.startswith("__k_")], F.col("salts").alias("__dealt"))
    names = [c for c in large.columns if c.startswith("__k_")]
    salted = rows.join(F.broadcast(large), list(same_group), "left").drop(*names)
    salted = salted.withColumn("__row_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__dealt")), F.lit(0)).cast("int"))
    repeated = brackets.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return salted.join(repeated, [*same_group, F.col("__row_salt") == F.col("__salt")])


def exact_percentiles(df: DataFrame, keys: Sequence[str], wanted: Sequence[tuple[str, str, float]]) -> DataFrame:
    """One row per group of ``keys`` with a column per wanted ``(name, column, fraction)``.

    One plan for all sizes, and lazy: the source is read for the brackets, a few numbers per
    group, and once more for the counts.
    """
    fractions = sorted({p for _, _, p in wanted})
    bounds = [min(1.0, max(0.0, p + side)) for p in fractions for side in (-MARGIN, MARGIN)]
    cells = [
        F.struct(F.lit(i).alias("item"), finite(num(column)).alias("v"))
        for i, (_, column, _) in enumerate(wanted)
    ]
    long = df.select(*map(as_column, keys), F.inline(F.array(*cells))).where(F.col("v").isNotNull())
    group = [*keys, "item"]

    at = F.element_at(F.array(*[F.lit(fractions.index(p)) for _, _, p in wanted]), F.col("item") + 1)
    p = F.element_at(F.array(*[F.lit(float(p)) for _, _, p in wanted]), F.col("item") + 1)
    bracket = (
        long.groupBy(*map(as_column, group))
        .agg(F.count("v").alias("n"), F.percentile_approx("v", bounds, ACCURACY).alias("b"))
        .select(
            *[as_column(k).alias(f"__k_{k}") for k in group],
            (p * (F.col("n") - 1)).alias("rank"),
            F.get("b", 2 * at).alias("low"),
            F.get("b", 2 * at + 1).alias("high"),
            salts_of(F.col("n")).alias("salts"),
        )
    )
    picked = by_cells(long.withColumn("c", F.lit(1)), bracket, group)
    columns = [F.max(F.when(F.col("item") == i, F.col("exact"))).alias(name) for i, (name, _, _) in enumerate(wanted)]
    return picked.groupBy(*map(as_column, keys)).agg(*columns)


def by_cells(rows: DataFrame, bracket: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group`` and ``exact``, the value at the rank of each bracket.

    ``rows`` have the group, a value ``v`` and ``c``, how often it occurs; ``bracket`` the group's columns behind
    ``__k_``, the wanted ``rank``, ``low`` and ``high`` around it and the number of ``salts``.
    """
    low, high, v = F.col("low"), F.col("high"), F.col("v")
    place = F.least(F.floor((v - low) / (high - low) * CELLS), F.lit(CELLS - 1)).cast("int")
    cell = F.when(v < low, -1).when(v > high, CELLS).when(low == high, 0).otherwise(place)
    same_group = [as_column(k).eqNullSafe(as_column(f"__k_{k}")) for k in group]
    by = [as_column(k) for k in group]
    # All rows below a bracket become one row with their largest value, all above one with their smallest.
    inside = F.when(v.between(low, high), v)
    counted = (
        with_brackets(rows, bracket, same_group)
        .select(*by, cell.alias("cell"), inside.alias("inside"), "v", "c", "rank")
        .groupBy(*by, "cell", "inside")
        .agg(F.sum("c").alias("c"), F.max("rank").alias("rank"), F.min("v").alias("least"), F.max("v").alias("most"))
        .select(*by, "cell", "c", "rank", F.when(F.col("cell") < 0, F.col("most")).otherwise(F.col("least")).alias("v"))
    )
    # asking for the values too lets both uses of the counts share one shuffle
    cells = counted.groupBy(*by, "cell").agg(F.sum("c").alias("c"), F.max("rank").alias("rank"), F.max("v").alias("top"))
    cells = cells.where(F.col("top").isNotNull())
    through = cells.withColumn("through", F.sum("c").over(Window.partitionBy(*by).orderBy("cell")))
    before = F.col("through") - F.col("c")
    targets = through.where((F.col("through") > F.floor("rank")) & (before <= F.ceil("rank"))).select(
        *[as_column(k).alias(f"__k_{k}") for k in group], F.col("cell").alias("__cell"), before.alias("before")
    )
    in_target = counted.join(targets, [*same_group, F.col("cell") == F.col("__cell")])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "cell").orderBy("v"))
    row = F.struct("upto", "cell", "v", "c")
    picked = (
        in_target.withColumn("upto", upto)
        .groupBy(*by)
        .agg(
            F.min(F.when(F.col("upto") > F.floor("rank"), row)).alias("low"),
            F.min(F.when(F.col("upto") > F.ceil("rank"), row)).alias("high"),
            F.max("rank").alias("rank"),
        )
    )

    def value(row: Column, rank: Column) -> Column:
        """The row's value; outside the bracket it is known for the nearest rank only.

        A rank further out would mean that the sketch broke its promise: fail rather than be wrong.
        """
        known = row["cell"].between(0, CELLS - 1)
        known = known | (row["cell"] < 0) & (rank == row["upto"] - 1) | (row["cell"] == CELLS) & (rank == row["upto"] - row["c"])
        return F.when(known, row["v"]).otherwise(F.raise_error(F.lit("percentile rank outside its bracket")).cast("double"))

    rank = F.col("rank")
    low_value, high_value = value(F.col("low"), F.floor(rank)), value(F.col("high"), F.ceil(rank))
    exact = low_value + (rank - F.floor(rank)) * (high_value - low_value)
    return picked.select(*by, exact.alias("exact"))
