"""Records of delimited text whose quoted cells hold line breaks, read in splits by many tasks.

Whether a line starts a record depends on all that stands before it in the file. A line has one effect when it starts
outside a quoted cell and one when it starts inside, and so has a split. A light first pass counts the lines with
quotes of each split without leaving the JVM; where there are any, only those lines are walked for the effects of
their split. A window over the splits of each file then settles the state in which each begins. The second pass reads
the splits apart: records that begin and end in one leave it whole, and only the pieces of records that go over the
end of a split are brought together.

Both passes read the files; no copy of the text is stored. They must see the same splits: a session whose settings
cut the files otherwise in between gets an error, not other rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.session import stored

_SPLIT = "file string, start long"


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether the end of the line is inside a quoted cell.

    A quote opens a cell at its first character only. Within quotes two quotes are one character; after the closing
    quote whatever stands before the next delimiter belongs to the cell.
    """
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(sep, at) + len(sep)
                if at < len(sep):
                    return False
                continue
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at = line.find(sep, at + 1) + len(sep)
        if at < len(sep):
            return False
        inside = False


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as LF ends them: a carriage return before it stays, as it belongs to the text inside quotes."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), "value"
    )


def _map(df: DataFrame, schema: str, rows) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            out.append(row)
            if len(out) == 4096:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(apply, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _effects(quoted: DataFrame, sep: str) -> DataFrame:
    """Per split with quotes: is its end inside a cell if its start was outside, if it was inside; does a line of it open one."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, state = None, [False, True, False]
        for file, start, line in rows:
            if (file, start) != now:
                if now:
                    yield *now, *state
                now, state = (file, start), [False, True, False]
            opens, stays = inside_after(line, False, sep), inside_after(line, True, sep)
            state = [stays if state[0] else opens, stays if state[1] else opens, state[2] or opens]
        if now:
            yield *now, *state

    return _map(quoted.select("file", "start", "value"), f"{_SPLIT}, if_out boolean, if_in boolean, opens boolean", walk)


def splits_of(lines: DataFrame, sep: str) -> DataFrame | None:
    """file, start, length and ``open`` (the state it begins in) of the splits of all files in which a cell holds a line break.

    None if there is no such file.
    """
    has_quote = F.contains("value", F.lit('"'))
    splits = stored(lines.groupBy("file", "start", "length").agg(F.count_if(has_quote).alias("quoted")))
    if splits.where("quoted > 0").isEmpty():
        return None
    effects = stored(_effects(lines.where(has_quote), sep))
    files = effects.where("opens").select("file").distinct()
    if files.isEmpty():
        return None
    split = splits.join(files, "file", "left_semi").join(effects, ["file", "start"], "left")
    swaps = F.coalesce(F.col("if_out") & ~F.col("if_in"), F.lit(False)).cast("int")
    split = split.withColumn("swaps", F.sum(swaps).over(Window.partitionBy("file").orderBy("start")))
    # the last split before that ends the same way whatever came before it, and the changes of state since then
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("if_out") == F.col("if_in"), F.struct(F.col("if_in").cast("int").alias("state"), "swaps"))
    last, now = F.last(fixed, ignorenulls=True).over(earlier), F.coalesce(F.max("swaps").over(earlier), F.lit(0))
    state = F.when(last.isNull(), now).otherwise(last["state"] + now - last["swaps"]) % 2
    return stored(split.select("file", "start", "length", (state == 1).alias("open")))


def _cut(edges: bool, sep: str):
    """Rows of (value, head, file, start, part): whole records of splits, or the pieces of those that cross their edges.

    ``head`` marks the first record of a file. A piece is part 0 if it goes on with an earlier split's record, else 1.
    """

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, inside, held, first, part = None, False, [], False, 1

        def rest():
            if edges and held:
                yield "\n".join(held), first and part == 1, *now, part

        for file, start, is_open, line in rows:
            if (file, start) != now:
                yield from rest()
                now, inside, held, first, part = (file, start), is_open, [], start == 0, 0 if is_open else 1
            if inside or '"' in line:
                was, inside = inside, inside_after(line, inside, sep)
                held.append(line)
                if inside:
                    continue
                whole, held = ("\n".join(held) if was else line).removesuffix("\r"), []
            else:
                whole = line.removesuffix("\r")
            if edges == (part == 0):
                if whole.strip() or part == 0:
                    yield whole, first and part == 1, *now, part
            if whole.strip() or part == 0:
                first = False
            part = 1
        yield from rest()

    return walk


def records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame | None:
    """``value`` (a record's text) and ``head`` (is it the first of its file) of all records that are not blank.

    None if no cell of any file holds a line break, so that every line is a record.
    """
    lines = _lines(spark, path)
    splits = splits_of(lines, sep)
    if splits is None:
        return None
    schema = f"value string, head boolean, {_SPLIT}, part int"
    files = splits.groupBy("file").agg(F.lit(True).alias("spans"))
    # a row of some hundred bytes for each split of the files with breaks, next to the megabytes of the split itself
    known = lines.join(F.broadcast(splits), ["file", "start", "length"], "left").join(F.broadcast(files), "file", "left")
    moved = F.raise_error(F.lit("the files are cut into other splits than when they were first read; read them again"))
    state = F.when(F.col("spans") & F.col("open").isNull(), moved.cast("boolean")).otherwise(F.coalesce("open", F.lit(False)))
    settled = known.select("file", "start", state.alias("open"), "value")
    whole = _map(settled, schema, _cut(False, sep)).select("value", "head")

    following = Window.partitionBy("file").orderBy("start")
    crossing = splits.withColumn("next", F.lead("open", 1, True).over(following)).where(F.col("open") | F.col("next"))
    at_edges = settled.join(F.broadcast(crossing.select("file", "start")), ["file", "start"], "left_semi").select("file", "start", "open", "value")
    pieces = _map(at_edges, schema, _cut(True, sep))
    number = F.sum("part").over(Window.partitionBy("file").orderBy("start", "part"))
    of_record = pieces.withColumn("record", number).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "part", "value"))).alias("pieces"), F.bool_or("head").alias("head")
    )
    text = F.regexp_replace(F.array_join("pieces.value", "\n"), "\r$", "")
    return whole.unionByName(of_record.select(text.alias("value"), "head"))
