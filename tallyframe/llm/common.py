"""What the operators share: the shared folder, stored tables, free column names, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: ASCII white space splits words; every other character belongs to one.
WORD = "[^\x20\x09-\x0d]+"


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share.

    The session names it in ``spark.checkpoint.dir``. Where that is unset, as in tests, it is set to a
    folder of the warehouse, which a session always has.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: one evaluation, no lineage, a known size."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, with underscores until no column has it (column names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns under the names ``id`` and ``text``; all others are left unread."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_rows(df: DataFrame, schema: str, rows: Callable[..., Iterator[tuple]], batch: int = 2000) -> DataFrame:
    """``mapInArrow`` for a generator of row tuples.

    ``rows`` gets an iterator over the partition's input tuples and yields output tuples; they are sent on
    in batches, so a task never holds more than one batch in and one out.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flow():
            for b in batches:
                for start in range(0, b.num_rows, 256):
                    part = b.slice(start, 256)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        out: list[tuple] = []
        for row in rows(flow()):
            out.append(row)
            if len(out) >= batch:
                yield _batch(out, arrow)
                out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(apply, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_HELD: dict[str, Callable[[], None]] = {}


def begin_memos(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Say that an operator begins its work in this worker process: the memos of all others are dropped. ``drop``
    drops its own, if it has any.

    Worker processes outlive the stages of a pipeline, so what each operator has learnt would else add up in them.
    """
    for name in [n for n in _HELD if n != owner]:
        _HELD.pop(name)()
    if drop is not None:
        _HELD[owner] = drop


class RecentDict:
    """A bounded memo: two generations, the older one dropped when the younger is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
