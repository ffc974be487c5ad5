"""Sequence columns: pure ``Column -> Column`` expressions that stay inside whole-stage code generation.

A null sequence gives null. Symbols are A, C, G, T in this order; ``$`` pads and sorts below A.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
PAD = "$"


def complement(s: Column) -> Column:
    return F.translate(s, BASES, "TGCA")


def reverse_complement(s: Column) -> Column:
    """Of the upper-cased sequence."""
    return F.reverse(complement(F.upper(s)))


def both_strands(s: Column) -> Column:
    """ARRAY of the sequence and its reverse complement."""
    return F.array(s, reverse_complement(s))


def canonical(s: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(s, reverse_complement(s))


def rank4(s: Column) -> Column:
    """Each base as its digit 0..3."""
    return F.translate(s, BASES, "0123")


def rank5(s: Column) -> Column:
    """Each symbol as its digit: pad 0, bases 1..4."""
    return F.translate(s, PAD + BASES, "01234")


def unrank4(s: Column) -> Column:
    return F.translate(s, "0123", BASES)


def base_rank(b: Column) -> Column:
    """0..3 for one base, null for anything else."""
    return F.when(F.length(b) == 1, F.nullif(F.instr(F.lit(BASES), b), F.lit(0)) - 1)


def gc_count(s: Column) -> Column:
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def _fold(s: Column, step) -> Column:
    """Left fold over the positions 1..length of ``s``."""
    places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    digit = lambda i: F.instr(F.lit(BASES), F.substring(s, i, F.lit(1))).cast("bigint") - 1
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, i: step(acc, i, digit(i)))


def pack(s: Column) -> Column:
    """2-bit code with the first base in the lowest bits, for up to 31 bases."""
    return _fold(s, lambda acc, i, d: acc + d * F.pow(F.lit(4.0), (i - 1).cast("double")).cast("bigint"))


def suffix_count(s: int) -> int:
    """Number of suffixes of length 0..s."""
    return (4 ** (s + 1) - 1) // 3


def suffix_index(suffix: Column, s: int) -> Column:
    """Position of a suffix among all of length 0..s in co-lexicographic order (shorter before longer)."""
    r = F.reverse(suffix)
    return _fold(r, lambda acc, i, d: acc + 1 + d * F.element_at(F.expr(_suffix_counts(s)), F.lit(s) - i + 1))


def _suffix_counts(s: int) -> str:
    return "array(" + ", ".join(f"{suffix_count(i)}L" for i in range(s + 1)) + ")"


def suffix_from_index(index: int, s: int) -> str:
    """The suffix at a position of the co-lexicographic order."""
    out = ""
    room = s
    while index > 0:
        below = suffix_count(room - 1)
        d = (index - 1) // below
        out = BASES[d] + out
        index -= d * below + 1
        room -= 1
    return out


def roll(kmer: Column, base: Column) -> Column:
    """Drop the first base, append one."""
    return F.concat(F.substring(kmer, 2, 1_000_000), base)


def fragments(s: Column, least: int, alphabet: str = "N") -> Column:
    """ARRAY of maximal runs without ``N`` (or, with alphabet='ACGT', without any other symbol) of at least ``least``."""
    pattern = "N+" if alphabet == "N" else "[^ACGT]+"
    return F.filter(F.split(F.upper(s), pattern), lambda x: F.length(x) >= max(least, 1))


def fragment_spans(s: Column, least: int) -> Column:
    """ARRAY of (begin, end, seq) of the maximal runs without N, 0-based half open."""
    pieces = F.transform(F.split(F.upper(s), "N"), lambda x: F.struct(x.alias("seq"), F.length(x).alias("n")))
    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,seq:string>>").alias("out"))
    folded = F.aggregate(
        pieces,
        init,
        lambda a, p: F.struct(
            (a["at"] + p["n"] + 1).alias("at"),
            F.when(p["n"] >= max(least, 1), F.concat(a["out"], F.array(F.struct(a["at"].alias("begin"), (a["at"] + p["n"]).alias("end"), p["seq"].alias("seq")))))
            .otherwise(a["out"])
            .alias("out"),
        ),
    )
    return folded["out"]


def discarded_bases(s: Column) -> Column:
    """Symbols other than A, C, G, T."""
    return F.length(s) - F.length(F.regexp_replace(F.upper(s), "[^ACGT]", ""))


def floor_log2(x: Column) -> Column:
    """Of a positive integer, exactly."""
    return F.length(F.bin(x)) - 1


def ceil_log2(x: Column) -> Column:
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x - 1)))


def bits_required(x: Column) -> Column:
    """Bits to store values up to ``x``, at least one."""
    return F.greatest(F.lit(1), F.length(F.bin(x)))


def bytes_required(x: Column) -> Column:
    return F.ceil(bits_required(x) / 8).cast("int")
