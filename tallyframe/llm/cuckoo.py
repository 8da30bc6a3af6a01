"""Exact duplicates: a sharded cuckoo-filter index of live digests whose hits are verified against content.

A shard holds the texts whose SHA-256 begins with its bits. Beside them lies a cuckoo filter of 16-bit marks, four to
a bucket, each mark in one of two buckets. A digest that the filter does not know is new without looking further; one
that it knows is compared with the content of its bucket, digest and whole text. A filter in which no mark can be
moved any more is built anew with twice the buckets from the stored keys. Digests can be deleted again.

Spark deals the work: each input partition first runs its rows through a bounded index of its own, so that a text with
very many copies leaves it once, then the distinct texts of all partitions meet in their shards. Texts travel once.
The number of shards follows the bytes of the table, so a shard stays near ``SHARD_BYTES`` at any size.

Defined cases: a null text counts as empty, and empty texts are equal to each other. Of equal texts the row with the
largest id stays; a null id is less than any other, and rows that repeat the largest id with the same text all carry
``kept``. Different texts under one digest are kept apart by their content. Very long texts are one entry like any
other. An empty table gives no rows and an index of empty shards. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.llm.common import map_rows, stored, texts

#: Bytes of text that a shard should hold, and that a partition's own index gathers before it sends its texts on.
SHARD_BYTES = 16 << 20
#: Shards at least, so that small tables are dealt out as well.
LEAST_SHARDS = 64


class CuckooFilter:
    """Marks of digests in buckets of four; ``add`` says False when no place could be freed."""

    WIDTH, KICKS = 4, 250

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.buckets = buckets
        self.slots = array("H", bytes(2 * self.WIDTH * buckets) if slots is None else slots)

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = self.bucket(digest)
        return mark, first, self._other(first, mark)

    def bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[4:8], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _put(self, bucket: int, mark: int) -> bool:
        for i in range(bucket * self.WIDTH, (bucket + 1) * self.WIDTH):
            if not self.slots[i]:
                self.slots[i] = mark
                return True
        return False

    def holds(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        w, slots = self.WIDTH, self.slots
        return mark in slots[first * w : first * w + w] or mark in slots[second * w : second * w + w]

    def add(self, digest: bytes) -> bool:
        mark, bucket, second = self.places(digest)
        if self._put(bucket, mark) or self._put(second, mark):
            return True
        for kick in range(self.KICKS):  # the slot to clear goes round, so that a build is the same each time
            at = bucket * self.WIDTH + kick % self.WIDTH
            mark, self.slots[at] = self.slots[at], mark
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            for i in range(bucket * self.WIDTH, (bucket + 1) * self.WIDTH):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    return True
        return False


class Shard:
    """The live texts of a shard in the buckets of their digests, and the filter over the digests.

    An entry is a list of digest, text, largest id and number of rows.
    """

    def __init__(self, entries: Iterable[list] = (), buckets: int = 64, slots: bytes | None = None):
        self.filter = CuckooFilter(buckets, slots)
        self.content: list[list[list]] = [[] for _ in range(buckets)]
        self.resized = 0
        for e in entries:
            self.content[self.filter.bucket(e[0])].append(e)
        if slots is None and any(self.content):
            self._fill(buckets)

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket

    def add(self, digest: bytes, text: bytes | None, keep, n: int) -> bool:
        """Whether the text is new; else its entry takes up the rows."""
        bucket = self.content[self.filter.bucket(digest)]
        known = False
        if self.filter.holds(digest):
            for e in bucket:
                if e[0] == digest:
                    if e[1] == text:
                        e[2], e[3] = _larger(e[2], keep), e[3] + n
                        return False
                    known = True
        bucket.append([digest, text, keep, n])
        if not known and not self.filter.add(digest):
            self._fill(self.filter.buckets * 2)
        return True

    def remove(self, digest: bytes, text: bytes | None) -> bool:
        """Take a text out; its digest leaves the filter with the last text that has it."""
        if not self.filter.holds(digest):
            return False
        bucket = self.content[self.filter.bucket(digest)]
        found = [e for e in bucket if e[0] == digest]
        gone = [e for e in found if e[1] == text]
        for e in gone:
            bucket.remove(e)
        if gone and len(found) == 1:
            self.filter.delete(digest)
        return bool(gone)

    def _fill(self, buckets: int) -> None:
        """A filter of so many buckets, or more, from the stored keys."""
        entries = list(self.entries())
        digests = {e[0] for e in entries}
        while True:
            self.filter = CuckooFilter(buckets)
            if all(map(self.filter.add, digests)):
                break
            buckets *= 2
        self.resized += 1
        self.content = [[] for _ in range(buckets)]
        for e in entries:
            self.content[self.filter.bucket(e[0])].append(e)


def _larger(a, b):
    return b if a is None or (b is not None and b > a) else a


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def shard_of(digest: Column, shards: int) -> Column:
    """The first bits of the digest; the number of shards is a power of two."""
    first = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.floor(first / F.lit((1 << 32) // shards)).cast("int")


def shards_for(octets: int) -> int:
    return max(LEAST_SHARDS, 1 << max(0, (octets // SHARD_BYTES)).bit_length())


def distinct_texts(rows: DataFrame, shards: int) -> DataFrame:
    """shard, digest, text, keep and n of the texts of each partition, combined by an index of bounded size."""
    kind = rows.schema["id"].dataType.simpleString()

    def combine(given: Iterator[tuple]) -> Iterator[tuple]:
        index, octets = Shard(), 0
        for id_, digest, text in given:
            octets += len(text) if index.add(digest, text, id_, 1) else 0
            if octets > SHARD_BYTES:
                yield from index.entries()
                index, octets = Shard(), 0
        yield from index.entries()

    schema = f"digest binary, text binary, keep {kind}, n long"
    return map_rows(rows.select("id", "digest", F.col("text").cast("binary")), schema, combine, 200).withColumn("shard", shard_of(F.col("digest"), shards))


@dataclass
class Index:
    """A stored index: ``entries`` (shard, digest, text, keep, n) and ``filters`` (shard, buckets, slots)."""

    rows: DataFrame
    shards: int

    @property
    def entries(self) -> DataFrame:
        return self.rows.where("slots IS NULL").select("shard", "digest", "text", "keep", "n")

    @property
    def filters(self) -> DataFrame:
        return self.rows.where("slots IS NOT NULL").select("shard", "buckets", "slots")

    def changed(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
        return distinct_texts(_rows(docs, id_col, text_col, digest), self.shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> Index:
        """The index with the rows of these documents as well."""
        return Index(stored(_updated(self.rows, self.changed(docs, id_col, text_col, digest), False)), self.shards)

    def delete(self, docs: DataFrame, text_col: str = "text", digest=digest_of) -> Index:
        """The index without the texts of these documents, however many rows had them."""
        return Index(stored(_updated(self.rows, self.changed(docs, text_col, text_col, digest).withColumn("keep", F.lit(None)), True)), self.shards)

    def live(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
        """id and live of each row. Rows that the filter of their shard does not know never meet the content."""
        rows = _rows(docs, id_col, text_col, digest).withColumn("shard", shard_of(F.col("digest"), self.shards)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(8)))
        salts = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<long>")))
        kind = rows.schema["id"].dataType.simpleString()

        def probe(probed: pa.Table, filters: pa.Table) -> pa.Table:
            held = [CuckooFilter(b, s) for b, s in zip(filters["buckets"].to_pylist(), filters["slots"].to_pylist())]
            hits = [any(f.holds(d) for f in held) for d in probed["digest"].to_pylist()]
            return probed.select(["id", "digest", "text"]).append_column("hit", pa.array(hits, pa.bool_()))

        probed = rows.groupBy("shard", "salt").cogroup(salts.groupBy("shard", "salt")).applyInArrow(probe, f"id {kind}, digest binary, text string, hit boolean")
        probed = stored(probed)
        known = self.entries.select("digest", F.col("text").cast("string").alias("text"), F.lit(True).alias("live"))
        hits = probed.where("hit").join(known, ["digest", "text"], "left").select("id", F.coalesce("live", F.lit(False)).alias("live"))
        return hits.unionByName(probed.where("NOT hit").select("id", F.lit(False).alias("live")))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, digest=digest_of) -> Index:
    """An index of all texts, with their content."""
    rows = _rows(docs, id_col, text_col, digest)
    if shards is None:
        shards = shards_for(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    return Index(stored(_indexed(distinct_texts(rows, shards), content=True)), shards)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    return texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", digest(F.col("text")))


def _out(shard: int, index: Shard, schema: pa.Schema, content: bool) -> pa.Table:
    """The entries by bucket and the filter. Without content, only texts that share a digest are given."""
    entries = list(index.entries())
    if not content:
        seen: dict[bytes, int] = {}
        for e in entries:
            seen[e[0]] = seen.get(e[0], 0) + 1
        entries = [e if seen[e[0]] > 1 else [e[0], None, e[2], e[3]] for e in entries]
    filter_row = [None, None, None, 0, index.filter.buckets, index.filter.slots.tobytes()]
    lines = [[shard, *e, None, None] for e in entries] + [[shard, *filter_row]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), schema)], schema=schema)


def _index_schema(kind: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"shard int, digest binary, text binary, keep {kind}, n long, buckets int, slots binary"
    return ddl, to_arrow_schema(_parse_datatype_string(ddl))


def _indexed(found: DataFrame, content: bool) -> DataFrame:
    """The shards of combined texts, one group a shard."""
    ddl, schema = _index_schema(found.schema["keep"].dataType.simpleString())

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Shard()
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("digest", "text", "keep", "n"))):
                index.add(*row)
        yield from _out(key[0].as_py(), index, schema, content).to_batches(2000)

    return found.groupBy("shard").applyInArrow(gather, ddl)


def _updated(rows: DataFrame, found: DataFrame, gone: bool) -> DataFrame:
    ddl, schema = _index_schema(rows.schema["keep"].dataType.simpleString())

    def change(key: tuple[pa.Scalar, ...], old: pa.Table, new: pa.Table) -> pa.Table:
        filters = old.filter(pc.is_valid(old["slots"])).to_pylist()
        entries = old.filter(pc.is_null(old["slots"])).select(["digest", "text", "keep", "n"])
        state = {"buckets": filters[0]["buckets"], "slots": filters[0]["slots"]} if filters else {}
        index = Shard(map(list, zip(*(c.to_pylist() for c in entries.columns))), **state)
        for digest, text, keep, n in zip(*(new[c].to_pylist() for c in ("digest", "text", "keep", "n"))):
            index.remove(digest, text) if gone else index.add(digest, text, keep, n)
        return _out(key[0].as_py(), index, schema, True)

    return rows.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(change, ddl)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest_of) -> DataFrame:
    """id, keep_id, group_size, kept and digest of every row.

    The joins back to the rows are by digest; a text with very many copies makes its partition large on one side
    only, which adaptive execution splits.
    """
    rows = _rows(docs, id_col, text_col, digest)
    light = stored(rows.select("id", "digest", F.octet_length("text").cast("long").alias("octets")))
    shards = shards_for(light.agg(F.sum("octets")).first()[0] or 0)
    found = stored(_indexed(distinct_texts(rows, shards), content=False).where("slots IS NULL AND (n > 1 OR text IS NOT NULL)").select("digest", "text", "keep", "n"))
    groups = found.where("text IS NULL").select("digest", "keep", "n")
    result = light.select("id", "digest").join(groups, "digest", "left")
    shared = found.where("text IS NOT NULL")
    if not shared.isEmpty():  # different texts under one digest: their rows are told apart by the text
        result = result.join(shared.select("digest").distinct(), "digest", "left_anti")
        apart = rows.select("id", "digest", F.col("text").cast("binary").alias("text")).join(shared, ["digest", "text"])
        result = result.unionByName(apart.select("digest", "id", "keep", "n"))
    keep, n = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")), F.coalesce("n", F.lit(1).cast("long"))
    return result.select("id", keep.alias("keep_id"), n.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest")
