"""FASTA scans. A record starts at a line with ``>``, so large files split between records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import dna


def _record(value: Column) -> tuple[Column, Column]:
    text = F.regexp_replace(F.regexp_replace(value, "^\\s*>", ""), "\r", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, text.substr(F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    return F.regexp_extract(head, r"^(\S*)", 1), F.regexp_replace(body, r"\s", "")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq_id, seq): id up to the first blank; records without sequence and blank lines are left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    seq_id, seq = _record(F.col("value"))
    return raw.select("file", seq_id.alias("seq_id"), F.upper(seq).alias("seq")).where(F.length("seq") > 0)


def split_gff_fasta(texts: DataFrame, text: str = "value") -> DataFrame:
    """(file, seq_id, seq) of the FASTA section of whole GFF texts (file, value)."""
    part = F.get(F.split(F.col(text), r"(?m)^##FASTA[ \t\r]*\n", 2), F.lit(1))
    records = texts.select("file", F.explode(F.split(part, r"(?m)^>")).alias("_r"))
    seq_id, seq = _record(F.col("_r"))
    return records.select("file", seq_id.alias("seq_id"), F.upper(seq).alias("seq")).where(F.length("seq") > 0)


def coloured_contigs(seqs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(fragments with colour, colour dictionary): one colour per contig id, from 1 in id order; both strands of each fragment."""
    from strandflow.operators.graph import colour_ids

    colours = colour_ids(seqs, "seq_id")
    frags = seqs.withColumn("seq", F.explode(dna.fragments(F.col("seq"), least)))
    both = frags.select("*", F.posexplode(dna.both_strands(F.col("seq"))).alias("strand_no", "_s")).withColumn("seq", F.col("_s")).drop("_s")
    return both.join(colours.withColumnRenamed("seed", "seq_id"), "seq_id"), colours
