"""Ranked lexical search by bag deduplication: equal bags of words are scored once.

A document counts only by the terms that the items use, with their frequencies, and by its length factor ``m``.
Documents with the same frequencies and the same ``m`` get the same score for every item, so they form a class: its
hash brings it together, its bytes are compared, it is scored once for all items, and the best classes are opened to
their members by ascending id. A class keeps its ``k`` smallest ids only: no others can reach a list of ``k``.

Texts are read once for each block of items. A block holds about ``BLOCK`` (item, term) pairs, which is what the driver
and each task have of the items; more items make more blocks. Classes are combined within each partition before they
are shuffled, by a combiner of bounded bytes, so copies of one text leave a partition once. Each task keeps ``k`` rows
an item, and the last ranking joins those.

All sums are of whole numbers and exact. Terms are cut in bytes: every byte of a character past ASCII is a part of a term.

Defined cases: null or empty texts have no term, count nowhere and are never found; null ids come last among equal
scores; repeated rows are documents of their own, repeated items are ranked each for itself; very long texts are read
whole; an empty table, or one without any term, gives no rows. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.common import map_rows, stored, texts

#: (item, term) pairs that one block should hold.
BLOCK = 200_000
#: Bytes of term frequencies that a partition's combiner holds before it sends its classes on.
HELD = 16 << 20
#: Products of a document's terms with the items that have them, in one step of the scoring.
STEP = 1 << 21

#: ASCII digits and letters, lower-cased, and all bytes from 0x80 stay; every other byte parts terms.
_CUT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(_CUT).split()


def postings(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (a number for each row), item_id, term and times."""
    rows = texts(items, item_col, text_col).withColumn("item", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()

    def cut(given: Iterator[tuple]) -> Iterator[tuple]:
        for item, id_, text in given:
            for term, times in Counter(terms(text or b"")).items():
                yield item, id_, term, times

    return map_rows(rows.select("item", "id", F.col("text").cast("binary")), f"item long, item_id {kind}, term binary, times long", cut)


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n and vector of every document with a term; vector holds (term number, frequency) pairs by term number."""
    kind = docs.schema["id"].dataType.simpleString()

    def count(given: Iterator[tuple]) -> Iterator[tuple]:
        for id_, text in given:
            words = terms(text or b"")
            if words:
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                yield id_, len(words), np.array(sorted(found.items()), np.uint32).tobytes()

    return map_rows(docs.select("id", F.col("text").cast("binary")), f"id {kind}, n long, vector binary", count)


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term is, summed within the partitions first."""

    def count(given: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros(size, np.int64)
        for (vector,) in given:
            total[np.frombuffer(vector, np.uint32)[::2]] += 1
        for term in np.flatnonzero(total).tolist():
            yield term, int(total[term])

    found = np.zeros(size, np.int64)
    for term, n in map_rows(vectors.select("vector"), "term long, n long", count).groupBy("term").agg(F.sum("n")).collect():
        found[term] = n
    return found


def _order(id_) -> tuple:
    return id_ is None, id_


def classes(vectors: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """hash, m, vector and the k smallest ids of the classes of each partition, dealt by hash and put in order."""
    kind = vectors.schema["id"].dataType.simpleString()

    def combine(given: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {}
        octets = 0
        for id_, n, vector in given:
            m = 75 + 25 * n * documents // length
            name = int.from_bytes(hashlib.blake2b(vector + m.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
            of_name = held.setdefault(name, [])
            same = next((c for c in of_name if c[0] == m and c[1] == vector), None)
            if same is None:
                of_name.append([m, vector, [id_]])
                octets += len(vector) + 200
            else:
                same[2].append(id_)
                if len(same[2]) > 4 * k:
                    same[2] = sorted(same[2], key=_order)[:k]
            if octets > HELD:
                yield from _classes_of(held, k)
                held, octets = {}, 0
        yield from _classes_of(held, k)

    rows = vectors.where(F.octet_length("vector") > 0).select("id", "n", "vector")
    made = map_rows(rows, f"hash long, m long, vector binary, ids array<{kind}>", combine)
    return made.repartition("hash").sortWithinPartitions("hash", "m", "vector")


def _classes_of(held: dict[int, list], k: int) -> Iterator[tuple]:
    for name, found in held.items():
        for m, vector, ids in found:
            yield name, m, vector, sorted(ids, key=_order)[:k]


def merged(given: Iterable[tuple], k: int) -> Iterator[tuple[int, bytes, list]]:
    """Neighbouring rows of one class as one."""
    now, ids = None, []
    for _, m, vector, more in given:
        if now == (m, vector):
            ids = sorted(ids + list(more), key=_order)[:k]
        else:
            if now is not None:
                yield *now, ids
            now, ids = (m, vector), list(more)
    if now is not None:
        yield *now, ids


class Best:
    """The k best documents of each item so far, and the scoring of whole blocks of classes."""

    def __init__(self, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, times: np.ndarray, n_items: int, k: int):
        self.weights, self.starts, self.items, self.times, self.n_items, self.k = weights, starts, items, times, n_items, k
        self.most = int(np.diff(starts).max(initial=1))
        self.found: list[list[tuple]] = [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, np.int64)

    def room(self) -> tuple[int, int]:
        """Classes and (class, term) pairs of one step."""
        return max(1, STEP // self.n_items), max(1, STEP // self.most)

    def scores(self, block: list[tuple]) -> np.ndarray:
        sizes = np.array([len(v) // 8 for _, v, _ in block])
        pairs = np.frombuffer(b"".join(v for _, v, _ in block), np.uint32).reshape(-1, 2).astype(np.int64)
        term, tf = pairs[:, 0], pairs[:, 1]
        m = np.repeat(np.array([c[0] for c in block], np.int64), sizes)
        part = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        many = self.starts[term + 1] - self.starts[term]
        before = np.cumsum(many) - many
        at = np.repeat(self.starts[term] - before, many) + np.arange(int(many.sum()))
        cell = np.repeat(np.repeat(np.arange(len(block)), sizes) * self.n_items, many) + self.items[at]
        value = np.repeat(part, many) * self.times[at]
        low, high = (np.bincount(cell, weights, len(block) * self.n_items).astype(np.int64) for weights in (value & (1 << 26) - 1, value >> 26))
        return (low + (high << 26)).reshape(len(block), self.n_items)

    def take(self, block: list[tuple]) -> None:
        scores = self.scores(block)
        for row, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.floor))):
            score, mine = int(scores[row, item]), self.found[item]
            mine.extend((-score, *_order(id_)) for id_ in block[row][2])
            if len(mine) > 4 * self.k:
                self._cut(item)

    def _cut(self, item: int) -> None:
        mine = self.found[item] = sorted(self.found[item])[: self.k]
        if len(mine) == self.k:
            self.floor[item] = -mine[-1][0]

    def rows(self) -> Iterator[tuple]:
        for item in range(self.n_items):
            self._cut(item)
            for score, _, id_ in self.found[item]:
                yield item, id_, -score


def _ranked_block(docs: DataFrame, pairs: list, k: int) -> DataFrame | None:
    """item, rank, id and score of the best k documents for the items of one block."""
    vocabulary = {t: i for i, t in enumerate(sorted({p["term"] for p in pairs}))}
    places = {item: i for i, item in enumerate(sorted({p["item"] for p in pairs}))}
    vectors = stored(frequencies(docs, vocabulary))
    documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    counts = document_counts(vectors, len(vocabulary)).tolist()
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in counts], np.int64)
    lists = sorted((vocabulary[p["term"]], places[p["item"]], p["times"]) for p in pairs)
    term, items, times = (np.array(x, np.int64) for x in zip(*lists))
    starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    kind = docs.schema["id"].dataType.simpleString()

    def score(given: Iterator[tuple]) -> Iterator[tuple]:
        best, block, width = Best(weights, starts, items, times, len(places), k), [], 0
        most_rows, most_pairs = best.room()
        for one in merged(given, k):
            block.append(one)
            width += len(one[1]) // 8
            if len(block) >= most_rows or width >= most_pairs:
                best.take(block)
                block, width = [], 0
        if block:
            best.take(block)
        yield from best.rows()

    found = map_rows(classes(vectors, documents, length, k), f"place long, id {kind}, score long", score)
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, item) for item, i in places.items()], "place long, item long")
    return ranked.join(F.broadcast(names), "place").drop("place")  # as many rows as the block has items


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """item_id, rank, id and score of each item's k best documents."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    wanted = stored(postings(items, item_col, item_text_col))
    blocks = -(-wanted.count() // block)
    found = []
    for b in range(blocks):
        pairs = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "term", "times").collect()
        ranked = _ranked_block(rows, pairs, k) if pairs else None
        if ranked is not None:
            found.append(ranked)
    kinds = rows.schema["id"].dataType.simpleString(), wanted.schema["item_id"].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"item_id {kinds[1]}, rank int, id {kinds[0]}, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", "rank", "id", "score")
