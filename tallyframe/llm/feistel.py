"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered by the order of their id (ties by checksum and size, so the order is the data's own), the
number is permuted over exactly ``0 .. n-1``, and ``shard = p % shards``, ``slot = p // shards``. Shard counts
differ by one at most and every shard's slots are gapless. The place of a row follows from its number and the
key alone, and ``row_at`` goes back from a place to the number.

Defined cases: null ids come first and null texts count as empty; repeated rows get numbers of their own;
an empty table gives no rows. Rows of any common id are dealt over the sorting tasks by a stored tie-break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.common import stored

_ROWS = 33  # bits that monotonically_increasing_id gives to the row within its partition


class Permutation:
    """A keyed permutation of ``0 .. n-1``: a balanced Feistel network on the next even number of bits; values
    that leave the range are walked on until they return."""

    def __init__(self, n: int, key: int = 20240229, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.shift = np.uint64(self.half)
        keys = np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, rounds, dtype=np.uint64)
        self.keys = [np.uint64(k) for k in keys]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> self.shift, x & self.mask
        for k in keys:
            left, right = right, left ^ self._mix(right, k)
        return (right << self.shift) | left

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        outside = np.flatnonzero(out >= self.n)
        while outside.size:  # under 4 steps each on average, as the domain is under 4 n
            out[outside] = self._once(out[outside], keys)
            outside = outside[out[outside] >= self.n]
        return out

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self.keys)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1])


def row_at(shard: int, slot: int, n: int, shards: int, key: int = 20240229) -> int:
    """The row number that lies in a place, without any table."""
    return int(Permutation(n, key).backward(np.array([slot * shards + shard], np.uint64))[0])


def numbered(light: DataFrame, order: list[str], into: str = "row") -> DataFrame:
    """Consecutive numbers from 0 in the given order, by sorted ranges and the counts before each.

    The input is stored first with a tie-break of its own, and the sorted ranges are stored with the numbers
    within them: no step depends on evaluating anything twice.
    """
    kept = stored(light.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [*order, "_tie"]
    ranged = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.select(*light.columns, F.shiftright("_at", _ROWS).alias("_part"), F.col("_at").bitwiseAND((1 << _ROWS) - 1).alias("_at")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return ranged.join(starts, "_part").select(*light.columns, (F.col("_start") + F.col("_at")).alias(into))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", key: int = 20240229) -> DataFrame:
    """id, size, text_crc32, row, shard and slot of every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    light = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    rows = stored(numbered(light, ["id", "text_crc32", "size"]))
    permutation = Permutation(rows.count(), key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permutation.forward(b.column("row").to_numpy())
            columns = [*b.columns, pa.array((p % np.uint64(shards)).astype(np.int32)), pa.array((p // np.uint64(shards)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "shard", "slot"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(place, f"id {kind}, size long, text_crc32 long, row long, shard int, slot long")
