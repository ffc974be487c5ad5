"""FASTQ scans: single files, paired files and interleaved files, as logical reads of ACGT fragments.

Malformed input raises: a truncated record, a bad header or separator, sequence and quality of different lengths, mates
of different ids, files of different lengths, an odd number of interleaved records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import dna, names
from strandflow.sources.lines import numbered_lines


def _fail(condition: Column, message: str) -> Column:
    return F.when(condition, F.raise_error(F.lit("FASTQ: " + message)).cast("string"))


_PARTS = "file string, record_no bigint, head string, seq string, plus string, qual string, n int"


def _assemble(batches):
    """Records whose four lines follow each other here; the lines of others one by one, which are few: those at a split's ends."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        yield from _records(rows.slice(0, max(0, rows.num_rows - 3)), rows)
        held = rows.slice(max(0, rows.num_rows - 3))
        held = held.filter(pa.array(_tail(rows)[-held.num_rows :])) if held.num_rows else held
    if held is not None and held.num_rows:
        yield from _records(held, held)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a whole record begins: a first line whose three next lines are the next three rows."""
    line = rows.column("line_no").to_numpy()
    file = rows.column("file").combine_chunks().dictionary_encode()
    code = file.indices.to_numpy(zero_copy_only=False) if isinstance(file, pa.DictionaryArray) else file.combine_chunks().indices.to_numpy(zero_copy_only=False)
    n = max(0, len(line) - 3)
    return np.flatnonzero((line[:n] % 4 == 0) & (line[3:] == line[:n] + 3) & (code[3:] == code[:n])) if n else np.empty(0, np.int64)


def _tail(rows: pa.Table) -> np.ndarray:
    """Which rows are in no whole record."""
    lone = np.ones(rows.num_rows, bool)
    for i in range(4):
        lone[_starts(rows) + i] = False
    return lone


def _records(settled: pa.Table, rows: pa.Table):
    """Whole records of ``rows``, and the lone lines among the first ``settled``."""
    start = _starts(rows)
    line, value = rows.column("line_no").to_numpy(), rows.column("value")
    if len(start):
        cells = [value.take(pa.array(start + i)).combine_chunks() for i in range(4)]
        yield _batch(rows.column("file").take(pa.array(start)), line[start] // 4, cells, 4)
    lone = np.flatnonzero(_tail(rows)[: settled.num_rows])
    if len(lone):
        texts, which = value.take(pa.array(lone)).to_pylist(), line[lone] % 4
        cells = [pa.array([t if w == i else None for t, w in zip(texts, which)], pa.string()) for i in range(4)]
        yield _batch(rows.column("file").take(pa.array(lone)), line[lone] // 4, cells, 1)


def _batch(file, record, cells, n) -> pa.RecordBatch:
    flat = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    cols = [flat(file).cast(pa.string()), pa.array(record, pa.int64()), *[flat(c).cast(pa.string()) for c in cells], pa.array(np.full(len(record), n), pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _PARTS.split(", ")])


def records(lines: DataFrame) -> DataFrame:
    """(file, record_no, read_id, seq, qual) from numbered lines; blank lines at the end are left out."""
    kept = lines.where(F.length("value") > 0).select("file", F.col("line_no").cast("bigint").alias("line_no"), "value")
    parts = kept.mapInArrow(_assemble, _PARTS)
    names_of = ("head", "seq", "plus", "qual")
    split = parts.where("n < 4").groupBy("file", "record_no").agg(*[F.max(n).alias(n) for n in names_of], F.sum("n").cast("int").alias("n"))
    rows = parts.where("n = 4").unionByName(split)
    error = F.coalesce(
        _fail(F.col("n") != 4, "truncated record"),
        _fail(~F.col("head").startswith("@"), "header without @"),
        _fail(~F.col("plus").startswith("+"), "separator without +"),
        _fail(F.length("seq") != F.length("qual"), "sequence and quality differ in length"),
        _fail(F.col("qual").rlike(r"[^\x21-\x7e]"), "bad quality"),
        _fail(F.col("seq").rlike(r"[^A-Za-z]"), "bad symbol"),
    )
    checked = rows.withColumn("_e", error).where("_e is null")
    return checked.select("file", "record_no", names.read_id(F.expr("substring(head, 2)")).alias("read_id"), F.upper("seq").alias("seq"), "qual")


def fragments_with_quality(seq: Column, qual: Column) -> Column:
    """ARRAY of (seq, qual) of the maximal ACGT runs, qualities aligned."""
    marked = F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "N", "\n")
    spans = dna.fragment_spans(F.translate(marked, "\n", "N"), 1)
    return F.transform(spans, lambda x: F.struct(x["seq"].alias("seq"), qual.substr(x["begin"] + 1, x["end"] - x["begin"]).alias("qual")))


def unpaired(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, read_no, read_id, fragments, n_records, discarded): one logical read per record."""
    r = records(numbered_lines(spark, path))
    return r.select(
        "file", F.col("record_no").alias("read_no"), "read_id", fragments_with_quality(F.col("seq"), F.col("qual")).alias("fragments"),
        F.lit(1).alias("n_records"), dna.discarded_bases(F.col("seq")).alias("discarded"),
    )


def _mates(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    joined = a.join(b, "read_no", how)
    error = F.coalesce(
        _fail(F.col("id_1").isNull() | F.col("id_2").isNull(), "mates without a partner"),
        _fail(F.col("id_1") != F.col("id_2"), "mates of different ids"),
    )
    return joined.withColumn("_e", error).where("_e is null").select(
        "file", "read_no", F.col("id_1").alias("read_id"), F.concat("frag_1", "frag_2").alias("fragments"), F.lit(2).alias("n_records"), (F.col("lost_1") + F.col("lost_2")).alias("discarded")
    )


def _side(r: DataFrame, i: int, read_no: Column) -> DataFrame:
    return r.select(
        *([F.col("file")] if i == 1 else []), read_no.alias("read_no"), F.col("read_id").alias(f"id_{i}"),
        fragments_with_quality(F.col("seq"), F.col("qual")).alias(f"frag_{i}"), dna.discarded_bases(F.col("seq")).alias(f"lost_{i}"),
    )


def paired(spark: SparkSession, forward: str, reverse: str) -> DataFrame:
    """Mates of two files in lockstep, as one logical read of both mates' fragments."""
    a, b = records(numbered_lines(spark, forward)), records(numbered_lines(spark, reverse))
    return _mates(_side(a, 1, F.col("record_no")), _side(b, 2, F.col("record_no")), "full")


def interleaved(spark: SparkSession, path: str) -> DataFrame:
    """Consecutive records of one file as mates."""
    r = records(numbered_lines(spark, path))
    pair = F.floor(F.col("record_no") / 2)
    return _mates(_side(r.where("record_no % 2 = 0"), 1, pair), _side(r.where("record_no % 2 = 1"), 2, pair), "full")


def metadata(reads: DataFrame) -> DataFrame:
    """Input records, logical reads, discarded bases and whether the input is compressed."""
    return reads.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.count("*").alias("n_reads"), F.coalesce(F.sum("discarded"), F.lit(0)).alias("discarded"),
        F.coalesce(F.max(F.col("file").endswith(".gz")), F.lit(False)).alias("compressed"),
    )


def group_files(paths: DataFrame, path: str = "file") -> DataFrame:
    """(sample, lane, fragment, forward, reverse) from FASTQ paths; missing lane and fragment become the text null.

    Raises where a group has other orientations than 1 and 2 with one file each.
    """
    rows = paths.select(path, names.fastq_parts(names.file_name(F.col(path))).alias("p")).where("p is not null").select(path, "p.*")
    keyed = rows.withColumn("lane", F.coalesce("lane", F.lit("null"))).withColumn("fragment", F.coalesce("fragment", F.lit("null")))
    one = lambda o: F.max(F.when(F.col("orientation") == o, F.col(path)))
    n = lambda o: F.sum(F.when(F.col("orientation") == o, 1).otherwise(0))
    groups = keyed.groupBy("sample", "lane", "fragment").agg(one(1).alias("forward"), one(2).alias("reverse"), n(1).alias("_n1"), n(2).alias("_n2"), F.count("*").alias("_n"))
    bad = _fail((F.col("_n1") != 1) | (F.col("_n2") != 1) | (F.col("_n") != 2), "a sample needs one file of each orientation")
    return groups.withColumn("_e", bad).where("_e is null").select("sample", "lane", "fragment", "forward", "reverse")
