"""Windows of sequences as 2-bit codes: Arrow batches in, counted codes out.

Symbols are A, C, G, T in this order; any other symbol ends a fragment. Sequences of any length are read in slices, equal
codes of a batch are counted before they leave it, and only 8-byte codes are shuffled. Code order is string order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import dna

#: Symbols of one slice.
SLICE = 4_000_000
_BREAK = 255
_CODE = np.full(256, _BREAK, np.uint8)
for _i, _b in enumerate(dna.BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def roll(codes: np.ndarray, width: int) -> np.ndarray:
    """Code of the ``width`` <= 32 symbols from each position on, by doubling; windows over a break give nonsense."""
    part, size, out, have = codes.astype(np.uint64), 1, None, 0
    while width:
        if width & 1:
            if out is None:
                out, have = part, size
            else:
                n = len(codes) - have - size + 1
                out, have = (out[:n] << np.uint64(2 * size)) | part[have : have + n], have + size
        width >>= 1
        if width:
            n = len(part) - size
            part, size = (part[:n] << np.uint64(2 * size)) | part[size : size + n], 2 * size
    return out


class Symbols:
    """Sequences of a batch laid end to end with breaks between them."""

    def __init__(self, texts: list[str]):
        self.codes = _CODE[np.frombuffer(("\n".join(texts) + "\n").encode("ascii", "replace"), np.uint8)]
        self.row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.breaks = np.flatnonzero(self.codes == _BREAK)

    def reverse(self) -> Symbols:
        """The reverse complement of everything, also in the order of the sequences."""
        out = object.__new__(Symbols)
        flipped = self.codes[:-1][::-1]
        out.codes = np.append(np.where(flipped == _BREAK, _BREAK, 3 - flipped).astype(np.uint8), np.uint8(_BREAK))
        out.row = np.append(self.row[:-1][::-1], self.row[0] if len(self.row) else 0)
        out.breaks = np.flatnonzero(out.codes == _BREAK)
        return out

    def windows(self, width: int):
        """(row, code) of all windows without a break, slice by slice."""
        n = len(self.codes)
        for lo in range(0, max(0, n - width + 1), SLICE):
            part = self.codes[lo : min(n, lo + SLICE + width - 1)]
            at = np.arange(lo, lo + len(part) - width + 1)
            ok = self.breaks[np.searchsorted(self.breaks, at)] - at >= width
            yield self.row[at[ok]], roll(part, width)[ok]

    def fragments(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length) of the runs between breaks of at least ``least`` symbols."""
        begin = np.r_[0, self.breaks[:-1] + 1]
        length = self.breaks - begin
        ok = length >= max(least, 1)
        return begin[ok], length[ok]

    def words(self, begin: np.ndarray, width: int) -> np.ndarray:
        """Code of the ``width`` symbols from each of some positions on."""
        out = np.zeros(len(begin), np.uint64)
        for i in range(width):
            out = (out << np.uint64(2)) | self.codes[begin + i].astype(np.uint64)
        return out


def _tally(code: np.ndarray, *others: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct (code, others) and how often each occurs."""
    order = np.lexsort((*others, code)) if others else np.argsort(code, kind="stable")
    cols = [c[order] for c in (code, *others)]
    new = np.ones(len(code), bool)
    if len(code):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.diff(np.r_[at, len(code)])


def _valid(batch: pa.RecordBatch, seq: int = 0) -> pa.RecordBatch:
    return batch.filter(batch.column(seq).is_valid())


def window_counts(seqs: DataFrame, k: int, seq: str = "seq", canonical: bool = False, by: str | None = None) -> DataFrame:
    """([by,] code, n): windows of ``k`` <= 32 symbols on both strands, or the lesser of both strands', counted within batches only."""
    kind = f"`{by}` {seqs.schema[by].dataType.simpleString()}, " if by else ""

    def run(batches):
        for batch in map(_valid, batches):
            if not batch.num_rows:
                continue
            one = Symbols(batch.column(0).to_pylist())
            if canonical:
                parts = ((row, np.minimum(code, _complement(code, k))) for row, code in one.windows(k))
            else:
                parts = (x for s in (one, one.reverse()) for x in s.windows(k))
            for row, code in parts:
                cols, n = _tally(code, row) if by else _tally(code)
                out = [pa.array(cols[0].view(np.int64)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(([batch.column(1).take(pa.array(cols[1]))] if by else []) + out, names=([by] if by else []) + ["code", "n"])

    return seqs.select(seq, *([by] if by else [])).mapInArrow(run, kind + "code bigint, n bigint")


def _complement(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements, by swapping groups of bits."""
    x = ~code
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        s, m = np.uint64(shift), np.uint64(mask)
        x = ((x >> s) & m) | ((x & m) << s)
    return x >> np.uint64(64 - 2 * k)


def edge_counts(seqs: DataFrame, k: int, seq: str = "seq", by: str | None = None) -> DataFrame:
    """(code, pad [, by], n): edges of the padded fragments on both strands, ``k`` <= 31, counted within batches.

    pad 0: a node and the next symbol, k + 1 symbols; pad p > 0: a node that begins with p pads, k + 1 - p symbols; pad -1: a
    node at a fragment's end, k symbols, whose next symbol is the pad. ``by`` is 0 for all but pad 0.
    """
    kind = ", by bigint" if by else ""

    def run(batches):
        for batch in map(_valid, batches):
            if not batch.num_rows:
                continue
            group = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) if by else None
            one = Symbols(batch.column(0).to_pylist())
            for s in (one, one.reverse()):
                for row, code in s.windows(k + 1):
                    yield _edges(code, np.zeros(len(code), np.int8), group[row] if by else None)
                begin, length = s.fragments(k)
                head, tail = s.words(begin, k), s.words(begin + length - k, k)
                codes = [head >> np.uint64(2 * (p - 1)) for p in range(1, k + 1)] + [tail]
                pads = [np.full(len(begin), p, np.int8) for p in range(1, k + 1)] + [np.full(len(begin), -1, np.int8)]
                yield _edges(np.concatenate(codes), np.concatenate(pads), np.zeros((k + 1) * len(begin), np.int64) if by else None)

    def _edges(code, pad, group):
        cols, n = _tally(code, pad, *([group] if group is not None else []))
        names = ["code", "pad", *(["by"] if group is not None else []), "n"]
        return pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:]), pa.array(n, pa.int64())], names=names)

    return seqs.select(seq, *([F.col(by).cast("bigint")] if by else [])).mapInArrow(run, f"code bigint, pad tinyint{kind}, n bigint")


def decode(code: Column, width: Column) -> Column:
    """The last ``width`` symbols of a code."""
    half = lambda c: F.lpad(F.conv(c.cast("string"), 10, 4), 16, "0")
    digits = F.concat(half(F.shiftrightunsigned(code, 32)), half(code.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))))
    return dna.unrank4(F.right(digits, width))


def decode_edges(edges: DataFrame, k: int) -> DataFrame:
    """``edges`` with node and sym instead of code and pad."""
    pad = F.col("pad").cast("int")
    text = F.concat(F.repeat(F.lit(dna.PAD), F.greatest(pad, F.lit(0))), decode(F.col("code"), F.when(pad < 0, k).otherwise(F.lit(k + 1) - pad)), F.when(pad < 0, dna.PAD).otherwise(""))
    rows = edges.withColumn("_e", text)
    return rows.select(F.substring("_e", 1, k).alias("node"), F.substring("_e", k + 1, 1).alias("sym"), *[c for c in edges.columns if c not in ("code", "pad")])


def settle(edges: DataFrame, k: int, flags: bool = False) -> DataFrame:
    """``$`` edges of nodes with another one pruned, and flags added, within blocks of nodes of equal last k - 1 symbols; then decoded."""
    code, pad = F.col("code"), F.col("pad")
    node = F.when(pad < 0, code).otherwise(F.shiftrightunsigned(code, 2))
    low = node.bitwiseAND(F.lit((1 << (2 * (k - 1))) - 1).cast("bigint"))
    # one key per block: the symbols, and how many pads come before them
    keyed = edges.withColumn("_tail", F.when(pad > 0, node).otherwise(low)).withColumn("_pads", F.greatest(pad - 1, F.lit(0)).cast("tinyint"))
    head = F.when(pad > 0, -1).otherwise(F.shiftrightunsigned(node, 2 * (k - 1))).cast("int")
    sym = F.when(pad < 0, -1).otherwise(code.bitwiseAND(F.lit(3).cast("bigint"))).cast("int")
    block = ["_tail", "_pads"]
    rows = keyed.withColumn("_head", head).withColumn("_sym", sym).repartition(*block)
    real = F.max(F.col("_sym") >= 0).over(Window.partitionBy(*block, "_head"))
    out = rows.withColumn("_real", real).where((F.col("_sym") >= 0) | ~F.col("_real"))
    if flags:
        first = Window.partitionBy(*block, "_sym").orderBy("_head")
        last = Window.partitionBy(*block, "_head").orderBy(F.desc("_sym"))
        out = out.withColumn("first", (F.row_number().over(first) == 1).cast("int")).withColumn("last", (F.row_number().over(last) == 1).cast("int"))
    return decode_edges(out.drop(*block, "_head", "_sym", "_real"), k)
