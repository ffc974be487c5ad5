"""Token ids of whole texts under a public byte-level BPE vocabulary.

Method: a contiguous rank array per short word. A word's bytes are parts laid side by side with the rank of each
adjacent pair; the least rank (leftmost of equals) is found by a scan, the boundary between the two parts is deleted by
closing the gap, and the ranks on both sides are refreshed, until no adjacent pair is in the vocabulary. All new words of
a batch go through it together as rows of one matrix. Words above ``SHORT`` bytes merge by a heap over linked parts, in
n log n, with the same result. Ids of words are kept in a bounded memo per worker, as texts repeat their words.

Defined results: null and empty texts have an empty list of ids; special tokens are ordinary text; texts are read whole
and never cut; every row comes out once, whatever its length or repetition; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
import re
import sys
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter, as they aren't part of this repository.
TOKENIZERS = os.environ.get("STRANDFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
SHORT = 32
MEMO_WORDS = 400_000
CHARS_AT_ONCE = 4_000_000


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return str(Path(folder) / name)


def _class(starts: str) -> str:
    """A character class of all characters whose general category starts with one of ``starts``, ASCII left out."""
    runs, begin = [], None
    for c in range(0x80, sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in starts
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            runs.append((begin, c - 1))
            begin = None
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


_ASCII_SPACE = r"\t\n\x0b\x0c\r "
_SPACE = _ASCII_SPACE + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _pattern(letters: str, digits: str, space: str) -> re.Pattern:
    """The published split pattern of the vocabulary with its classes written out."""
    return re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    return _pattern("A-Za-z", "0-9", _ASCII_SPACE), _pattern("A-Za-z" + _class("L"), "0-9" + _class("N"), _SPACE)


def split_words(text: str) -> list[str]:
    """The words of a text before any merge; they spell it without a gap."""
    return _patterns()[0 if text.isascii() else 1].findall(text)


class Encoder:
    """Ranks of a vocabulary file and the words met so far."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                word, rank = line.split()
                self.ranks[base64.b64decode(word)] = int(rank)
        top = max(self.ranks.values()) + 1
        self.none = np.int32(2**31 - 1)
        self.byte_rank = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte_rank[b] = self.ranks.get(bytes([b]), -1)
        # adjacent parts -> rank of their union, as one sorted table
        keys, values = [], []
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                a, b = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if a is not None and b is not None:
                    keys.append(a * top + b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.top = np.int64(top)
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.memo: dict[str, tuple[int, ...]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.top + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], self.none)

    def merge_short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Contiguous rank arrays of words of at most ``SHORT`` bytes, merged in step."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        width = int(size.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        parts = np.full((n, width + 1), -1, np.int32)
        parts[row, col] = self.byte_rank[flat]
        ranks = np.full((n, width), self.none, np.int32)
        inner = np.flatnonzero(col > 0)
        ranks[row[inner], col[inner] - 1] = self.pair_ranks(parts[row[inner], col[inner] - 1], parts[row[inner], col[inner]])
        out: list = [None] * n
        alive = np.arange(n)
        places = np.arange(width + 1)
        while len(alive):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(alive)), at]
            done = least == self.none
            if done.any():
                kept = parts[done]
                for i, k, p in zip(alive[done], (kept >= 0).sum(axis=1), kept.tolist()):
                    out[i] = tuple(p[:k])
                stay = ~done
                parts, ranks, alive, at, least = parts[stay], ranks[stay], alive[stay], at[stay], least[stay]
                if not len(alive):
                    break
            # delete the boundary: everything behind it moves up by one
            shift = places[None, :] + (places[None, :] > at[:, None])
            parts = np.take_along_axis(np.pad(parts, ((0, 0), (0, 1)), constant_values=-1), shift, 1)
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=self.none), shift[:, :-1], 1)
            rows = np.arange(len(alive))
            parts[rows, at] = least
            ranks[rows, at] = self.pair_ranks(parts[rows, at], parts[rows, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pair_ranks(parts[before, at[before] - 1], parts[before, at[before]])
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges for a long word: a heap of pair ranks over linked parts."""
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        alive = [True] * n
        ranks, get = self.ranks, self.ranks.get
        heap = []
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue  # one of the two parts has changed since
            j = after[i]
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                e2 = after[end]
                r = get(word[i:e2])
                if r is not None:
                    heapq.heappush(heap, (r, i, e2))
            p = before[i]
            if p >= 0:
                r = get(word[p:end])
                if r is not None:
                    heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return tuple(out)

    def learn(self, words: set[str]) -> None:
        """Put the ids of new words into the memo."""
        short_words, short_bytes = [], []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            r = self.ranks.get(b)
            if r is not None:
                self.memo[w] = (r,)
            elif len(b) <= SHORT:
                short_words.append(w)
                short_bytes.append(b)
            else:
                self.memo[w] = self.merge_long(b)
        for i in range(0, len(short_words), 20_000):
            self.memo.update(zip(short_words[i : i + 20_000], self.merge_short(short_bytes[i : i + 20_000])))

    def split_batch(self, texts: list[str | None]) -> list[list[str]]:
        """Words of each text, all of them in the memo afterwards."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        split = [split_words(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        new.difference_update(self.memo)
        if new:
            self.learn(new)
        return split

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = self.split_batch(texts)
        memo = self.memo
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += memo[w]
            out.append(ids)
        return out

    def count_batch(self, texts: list[str | None]) -> list[int]:
        split = self.split_batch(texts)
        memo = self.memo
        return [sum([len(memo[w]) for w in words]) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    return Encoder(path)


def _slices(column: pa.Array):
    """Runs of a text column of about ``CHARS_AT_ONCE`` bytes, a text never split."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    begin = 0
    while begin < len(column):
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + CHARS_AT_ONCE, "right")))
        yield begin, end
        begin = end


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row."""
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                ids = enc.encode_batch(batch.column(1).slice(a, b - a).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.empty(offsets[-1], np.int32)
                for i, x in enumerate(ids):
                    flat[offsets[i] : offsets[i + 1]] = x
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` columns and n_tokens of every row."""
    path = path or vocabulary_path()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for a, b in _slices(batch.column(0)):
                n = enc.count_batch(batch.column(0).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i + 1).slice(a, b - a) for i in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"]
                )

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "n_tokens bigint"])
    return df.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(run, schema)


def available(path: str | None = None) -> bool:
    return os.path.exists(path or vocabulary_path()) and importlib.util.find_spec("numpy") is not None
