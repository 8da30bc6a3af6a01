"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has one valid last token: the encoding of the prefix is the encoding of the prefix
before that token, followed by it. Whether a token may follow another depends on the two alone, so the table of
last tokens is filled from left to right. Appending bytes extends the table; an edit refills it from the edit
on until it agrees with the old one again.

Defined cases: a null text counts as empty and has no tokens; lone surrogates become U+FFFD, as text that Spark
holds has none; long pieces take time in proportion to their length; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tallyframe.llm.common import RecentDict, begin_memos, map_rows, texts


class PrefixBpe:
    """Ranks of a byte-level vocabulary (token bytes to id; a lower id merges earlier)."""

    #: Pairs of tokens whose judgement is kept.
    PAIRS = 2_000_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.bytes_of}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follow: dict[int, bool] = {}
        self._suffixes = ahocorasick.Automaton()  # finds, at each byte, the tokens that end there
        for token, b in self.bytes_of.items():
            if self.reached(token):
                self._suffixes.add_word(b.decode("latin-1"), (token, len(b)))
        self._suffixes.make_automaton()

    @classmethod
    def load(cls, path: str) -> PrefixBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a single byte or a token no merge reaches."""
        if token not in self._halves:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def reached(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two stay apart when their bytes are merged together.

        Going back in time, the younger of the two tokens at the border is taken apart; at each point a merge
        over the border must not have come earlier than the one that is being undone. Of equal merges the left
        one comes first, so undoing on the right allows one rank less.
        """
        pair = left << 32 | right
        known = self._follow.get(pair)
        if known is None:
            if len(self._follow) >= self.PAIRS:
                self._follow.clear()
            known = self._follow[pair] = self._apart(left, right)
        return known

    def fill(self, data: bytes, last: list[int]) -> list[int]:
        """Extend the last tokens of the first prefixes to all prefixes of ``data``.

        An automaton over the tokens gives those that end at each byte, so nothing but real tokens is tried.
        """
        begin = len(last)
        back = max(0, begin - self.longest)
        last += [-1] * (len(data) + 1 - begin)
        follow, may_follow = self._follow, self.may_follow
        for at, (token, length) in self._suffixes.iter(data[back:].decode("latin-1")):
            end = back + at + 1
            start = end - length
            if end < begin or start < 0 or last[end] >= 0:
                continue
            if start:
                known = follow.get(last[start] << 32 | token)
                if not (may_follow(last[start], token) if known is None else known):
                    continue
            last[end] = token
        if -1 in last[begin:]:
            raise ValueError(f"byte {data[last.index(-1, begin) - 1]} is not in the vocabulary")
        return last

    def _apart(self, left: int, right: int) -> bool:
        before = 1 << 62
        while True:
            over = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if over is not None and over < before:
                return False
            born_left = left if len(self.bytes_of[left]) > 1 else -1
            born_right = right if len(self.bytes_of[right]) > 1 else -1
            if born_left > born_right:
                before, left = left, self.halves(left)[1]
            elif born_right >= 0:
                before, right = right + 1, self.halves(right)[0]
            else:
                return True

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The valid last token of ``data[:end]``, given those of all shorter prefixes."""
        ranks = self.ranks
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(data[start:end])
            if token is not None and self.reached(token) and (start == 0 or self.may_follow(last[start], token)):
                return token
        raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def table(self, data: bytes) -> PrefixTable:
        return PrefixTable(self).append(data)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of text; a piece that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, follow = [-1] * len(piece), self._follow  # here the last token of a prefix stands at its last byte
        for at, (token, length) in self._suffixes.iter(piece.decode("latin-1")):
            if last[at] < 0:
                if at < length:
                    last[at] = token
                else:
                    left = last[at - length]
                    known = follow.get(left << 32 | token)
                    if known or known is None and self.may_follow(left, token):
                        last[at] = token
        ids, at = [], len(piece) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                raise ValueError(f"byte {piece[at]} is not in the vocabulary")
            ids.append(token)
            at -= len(self.bytes_of[token])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of some bytes, open to appends and edits."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.data, self.last = bpe, b"", [-1]

    def append(self, more: bytes) -> PrefixTable:
        self.data += more
        self.bpe.fill(self.data, self.last)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Put ``new`` in the place of ``data[start:end]``; the rest is refilled only until it agrees again."""
        rest, old = self.data[end:], self.last[end + 1 :]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(new)
        self.data += rest
        agreed = 0
        for i, was in enumerate(old):
            if agreed >= self.bpe.longest:  # later tokens look back no further than this
                self.last += old[i:]
                break
            now = self.bpe.last_token(self.data, len(self.last), self.last)
            agreed = agreed + 1 if now == was else 0
            self.last.append(now)
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.bpe.bytes_of[self.last[at]])
        return out[::-1]


class TextCodec:
    """Whole texts: each match of the pattern is a piece; pieces met before are looked up."""

    def __init__(self, bpe: PrefixBpe, pattern: str, memo: int = 400_000):
        self.bpe, self.find, self.memo = bpe, regex.compile(pattern).findall, RecentDict(memo)

    def encode(self, text: str) -> list[int]:
        young, out = self.memo.young, []
        for piece in self.find(text):
            ids = young.get(piece)
            if ids is None:
                ids = self._met(piece)
                young = self.memo.young
            out += ids
        return out

    def _met(self, piece: str) -> tuple[int, ...]:
        ids = self.memo.get(piece)
        if ids is None:
            ids = tuple(self.bpe.encode(piece.encode("utf-8", "replace")))
            if len(piece) <= 64:
                self.memo.put(piece, ids)
        return ids


_CODECS: dict[tuple[str, str], TextCodec] = {}


def codec(path: str, pattern: str) -> TextCodec:
    """One codec a process; the vocabulary file is read where it is used."""
    begin_memos("prefix_bpe", _CODECS.clear)
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TextCodec(PrefixBpe.load(path), pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the ids of the whole text, ``ids array<int>``."""

    def rows(flow: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(path, pattern)
        for i, text in flow:
            yield i, own.encode(text or "")

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(texts(docs, id_col, text_col), f"id {kind}, ids array<int>", rows, batch=200)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids and of the bytes they decode to; the ids stay in the task."""

    def rows(flow: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(path, pattern)
        sha = hashlib.sha256
        for i, text in flow:
            ids = own.encode(text or "")
            yield i, len(ids), sha(",".join(map(own.bpe.decimals.__getitem__, ids)).encode()).hexdigest(), sha(own.bpe.decode(ids)).hexdigest()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(texts(docs, id_col, text_col), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
