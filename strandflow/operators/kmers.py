"""K-mer tables: strands, padded windows, terminals, suffix histograms and size statistics.

A node is ``k`` symbols, an edge a node and the next symbol. Every fragment is padded with ``k`` times ``$`` in front and one
behind. Fragments shorter than ``k`` give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import dna
from strandflow.operators import packed


def fragments(seqs: DataFrame, k: int, seq: str = "seq", alphabet: str = "N") -> DataFrame:
    """One row per fragment of at least ``k`` symbols, other columns kept."""
    return seqs.withColumn(seq, F.explode(dna.fragments(F.col(seq), k, alphabet)))


def strands(frags: DataFrame, seq: str = "seq") -> DataFrame:
    """Each fragment and its reverse complement."""
    return frags.withColumn(seq, F.explode(dna.both_strands(F.col(seq))))


def _windows(s: Column, width: int) -> Column:
    n = F.length(s) - width + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: s.substr(i, F.lit(width))))


def kmers(frags: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row per window of ``k`` symbols, as ``kmer``."""
    return frags.withColumn("kmer", F.explode(_windows(F.col(seq), k))).drop(seq)


def edges(frags: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row per (node, sym) occurrence of the padded fragments, other columns kept."""
    padded = F.concat(F.lit(dna.PAD * k), F.col(seq), F.lit(dna.PAD))
    w = frags.where(F.length(seq) >= k).withColumn("_w", F.explode(_windows(padded, k + 1))).drop(seq)
    return w.withColumn("node", F.substring("_w", 1, k)).withColumn("sym", F.substring("_w", k + 1, 1)).drop("_w")


def count_kmers(seqs: DataFrame, k: int, seq: str = "seq", canonical: bool = False) -> DataFrame:
    """(kmer, n) over both strands, or over canonical k-mers; counted map-side first, as codes up to 32 symbols."""
    if k <= 32:
        codes = packed.window_counts(seqs, k, seq, canonical).groupBy("code").agg(F.sum("n").alias("n"))
        return codes.select(packed.decode(F.col("code"), F.lit(k)).alias("kmer"), "n")
    frags = fragments(seqs.select(seq), k, seq)
    if canonical:
        return kmers(frags, k, seq).select(dna.canonical(F.col("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return kmers(strands(frags, seq), k, seq).groupBy("kmer").agg(F.count("*").alias("n"))


def terminals(frags: DataFrame, k: int, seq: str = "seq", below: int | None = None) -> DataFrame:
    """Distinct padded prefixes (node, sym) of fewer than ``k`` symbols; ``below``: only those of fewer symbols than that."""
    most = k if below is None else min(below, k)
    s = F.col(seq)
    pref = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda i: F.struct(F.concat(F.repeat(F.lit(dna.PAD), k - i), s.substr(F.lit(1), i)).alias("node"), s.substr(i + 1, F.lit(1)).alias("sym")),
    )
    if most < 1:
        return frags.sparkSession.createDataFrame([], "node string, sym string")
    return frags.where(F.length(s) >= k).select(F.explode(pref).alias("p")).select("p.node", "p.sym").distinct()


def suffix_histogram(frags: DataFrame, k: int, s: int, seq: str = "seq", by: list[str] | None = None) -> DataFrame:
    """(``by``, suffix, n) over the last ``s`` symbols of every window of ``k``."""
    return kmers(frags, k, seq).groupBy(*(by or []), F.substring("kmer", k - s + 1, s).alias("suffix")).agg(F.count("*").alias("n"))


def suffix_plan(histogram: DataFrame, container: str) -> DataFrame:
    """Histogram with the running total per suffix over the containers, before and including each."""
    w = Window.partitionBy("suffix").orderBy(container).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("until", F.sum("n").over(w)).withColumn("from", F.col("until") - F.col("n"))


def filter_by_suffix(kmer_rows: DataFrame, suffix: str) -> DataFrame:
    return kmer_rows.where(F.col("kmer").endswith(suffix))


def size_stats(frags: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """Per container fragments, symbols, windows of ``k`` and of ``k + 1``, padded terminals, on one strand."""
    n = F.length(seq)
    return frags.groupBy(*by).agg(
        F.count("*").alias("n_fragments"),
        F.sum(n).alias("n_symbols"),
        F.sum(F.greatest(n - k + 1, F.lit(0))).alias("n_kmers"),
        F.sum(F.greatest(n - k, F.lit(0))).alias("n_edges"),
        F.sum(F.when(n >= k, k).otherwise(0)).alias("n_terminals"),
    )


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The element at position n div 2 of each group's sorted values, by ranks of distinct values and not by a list."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("_u", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    at = F.floor(F.col("_n") / 2)
    return upto.where((F.col("_u") > at) & (F.col("_u") - F.col("_c") <= at)).select(*by, F.col(value).alias("median"))


def chunks(frags: DataFrame, size: int, overlap: int, seq: str = "seq") -> DataFrame:
    """Pieces of ``size`` that overlap by ``overlap``; (piece_no, first, last) tell the fragment's ends apart.

    Bounds the work of one row for very long sequences: k-mers of the pieces are those of the fragment if overlap = k.
    """
    s, n, step = F.col(seq), F.length(seq), size - overlap
    last = F.greatest(F.ceil((n - overlap) / step), F.lit(1)) - 1
    out = frags.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("last", F.col("piece_no") == last)
    return out.withColumn("first", F.col("piece_no") == 0).withColumn(seq, s.substr(F.col("piece_no") * step + 1, F.when(F.col("last"), n).otherwise(size)))


def chunk_size(median_length: int, threads: int, least: int = 10_000) -> int:
    return max(median_length // threads, least)


def chunk_bounds(n: int, parts: int, i: int) -> tuple[int, int]:
    """Half-open bounds of chunk ``i`` of ``parts``: sizes differ by at most one, the longer first."""
    if parts < 1 or not 0 <= i < parts:
        raise IndexError("no such chunk")
    q, r = divmod(n, parts)
    return i * q + min(i, r), (i + 1) * q + min(i + 1, r)
