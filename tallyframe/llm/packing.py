"""Packing: harmonic classes.

A document's ids, closed by the end id, are cut into pieces whose lengths lie at or just under a reciprocal
``capacity // k``. Pieces of the class of ``k`` fill sequences of exactly ``k`` pieces: the place of a piece
follows from its number within the class, and workers number their pieces independently; only the counts a
worker has of each class are added up. What is left of each class, under ``k`` pieces, is at most
``rest_bound`` pieces in all, whatever the size of the input, and is packed by best fit.

Defined cases: a null text counts as empty and gives one piece with the end id; repeated rows are packed each;
very long texts give many full pieces; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.llm.common import WORD, begin_memos, map_rows, stored, texts

_WORD = re.compile(WORD)
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LATIN = re.compile("[^\0-\xff]")
_REST = 1 << 62


class Classes:
    """The slot lengths of a capacity: the first reciprocals, a few between, and all short lengths."""

    def __init__(self, capacity: int = 4096, short: int = 40, slack: int = 64):
        ks = {k for k in (*range(1, 17), 20, 24, 28, 32, 40, 48, 56, 64, 80, 96) if capacity // k > short}
        self.capacity, self.slack = capacity, slack
        self.slots = sorted({capacity // k for k in ks} | set(range(1, min(short, capacity) + 1)))
        self.count = {s: capacity // s for s in self.slots}

    @property
    def rest_bound(self) -> int:
        return sum(k - 1 for k in self.count.values())

    def cut(self, n: int) -> list[tuple[int, int]]:
        """(length, slot) of the pieces: a length close under a slot stays whole, else the largest slot is cut off."""
        out = [(self.capacity, self.capacity)] * (n // self.capacity)
        n %= self.capacity
        while n:
            at = bisect.bisect_left(self.slots, n)
            if at < len(self.slots) and (self.slots[at] - n) * self.slack <= n:
                return [*out, (n, self.slots[at])]
            slot = self.slots[at - 1]
            out.append((slot, slot))
            n -= slot
        return out


def _latin(text: str) -> bool:
    """No character above U+00FF."""
    return _LATIN.search(text) is None


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space: words are encoded apart and met ones looked up."""

    def __init__(self, path: str, memo: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the names of special tokens are ordinary text in a document
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.size, self.known, self.older, self.parts = memo, {}, {}, {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if text.isascii() or _latin(text):
            text = text.lower()  # as the tokenizer does; here no letter's case hangs on its neighbours or on composition
        # str.split also parts at four separators that the tokenizer keeps
        words = text.split() if _SEPARATORS.search(text) is None else _WORD.findall(text)
        ids = list(map(self.known.get, words))
        if None in ids:
            self._learn({w for w, b in zip(words, ids) if b is None})
            known = self.known
            ids = [known[w] if b is None else b for w, b in zip(words, ids)]
        return b"".join(ids)

    def _learn(self, new: set[str]) -> None:
        """Make the words known; when the memo is full a new one is begun and the full one kept beside it."""
        if len(self.known) > self.size:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        unmet = new.difference(older)
        for w in new - unmet:
            known[w] = older[w]
        if unmet:
            self._encode(unmet)

    def _encode(self, words: set[str]) -> None:
        """Closing stops and commas after a letter are pieces of their own, and ASCII letters lose case anyway."""
        if len(self.parts) > 2 * self.size:
            self.parts = {}
        known, parts, split = self.known, self.parts, []
        for w in words:
            core = w.rstrip(".,")
            if core == w or not core or not core[-1].isalpha():
                core, tail = w, ""
            else:
                tail = w[len(core) :]
            split.append((w, core.lower() if core.isascii() else core, tail))
        todo = list({p for _, core, tail in split for p in (core, tail)}.difference(parts))
        letters = [p for p in todo if p.isalpha()]
        if self._joined(letters):
            todo = [p for p in todo if not p.isalpha()]
        for p, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False)):
            parts[p] = np.array(e.ids, "<u4").tobytes()
        for w, core, tail in split:
            known[w] = parts[core] + parts[tail] if tail else parts[core]

    def _joined(self, letters: list[str]) -> bool:
        """Encode words of letters in one text; each has one token that ends a word, its last. False if not so."""
        if not letters:
            return True
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(letters):
            return False
        data, start = ids.tobytes(), 0
        for p, end in zip(letters, ends):
            self.parts[p] = data[start:end]
            start = end
        return True


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """One coder a process. Its memos are named here: what a task's own function names is sent to workers as a copy."""
    begin_memos("packing", _CODERS.clear)
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def pieces(docs: DataFrame, path: str, classes: Classes, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document, numbered within worker and class."""

    def rows(flow: Iterator[tuple]) -> Iterator[tuple]:
        own, worker, numbers = coder(path), TaskContext.get().partitionId(), dict.fromkeys(classes.slots, 0)
        end = int(end_id).to_bytes(4, "little")
        for i, text in flow:
            ids = own.encode(text or "") + end
            start = 0
            for length, slot in classes.cut(len(ids) // 4):
                yield i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, slot, worker, numbers[slot]
                numbers[slot] += 1
                start += length

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, slot int, worker int, number long"
    return map_rows(texts(docs, id_col, text_col), schema, rows)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    classes = Classes(capacity)
    cut = stored(pieces(docs, path, classes, end_id, id_col, text_col))
    before = Window.partitionBy("slot").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    per_worker = cut.groupBy("slot", "worker").count().select(
        "slot", "worker", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"), F.sum("count").over(Window.partitionBy("slot")).alias("total")
    )
    k = (F.lit(capacity) / F.col("slot")).cast("long")
    placed = stored(
        cut.join(per_worker, ["slot", "worker"]).withColumns({"at": F.col("first") + F.col("number"), "k": k})
        .select("id", "start", "length", "ids_crc32", "doc_tokens", "slot", "at", (F.col("at") % F.col("k")).alias("nth"),
                F.expr("at div k").alias("bin"), (F.expr("at div k") >= F.expr("total div k")).alias("rest"))
    )
    in_bin = Window.partitionBy("slot", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    full = placed.where(~F.col("rest")).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("slot").cast("long") * (1 << 44) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"),
    )
    rest = placed.where("rest").select("id", "start", "length", "ids_crc32", "doc_tokens", "slot", "at")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return full.unionByName(rest.groupBy().applyInPandas(lambda x: _best_fit(x, capacity), schema))


def _best_fit(rest: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The bounded rest, longest first, each into the fullest sequence that still has room."""
    rest = rest.sort_values(["slot", "at"], ascending=[False, True], ignore_index=True)
    room: list[tuple[int, int]] = []  # (room left, sequence), sorted
    sequence, offset, used = [], [], 0
    for length in rest["length"]:
        at = bisect.bisect_left(room, (length, -1))
        left, s = room.pop(at) if at < len(room) else (capacity, used)
        used = max(used, s + 1)
        sequence.append(_REST + s)
        offset.append(capacity - left)
        if left > length:
            bisect.insort(room, (left - length, s))
    out = rest[["id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
    out["sequence_id"], out["offset"] = np.array(sequence, np.int64), np.array(offset, np.int64)
    return out
