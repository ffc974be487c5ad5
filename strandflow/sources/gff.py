"""GFF3 scans: features with 0-based half-open coordinates, and the genome of a GFF file with its FASTA section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import names
from strandflow.sources.fasta import split_gff_fasta

STRANDS = ("+", "-", ".", "?")


def parse_line(line: Column, strict: bool = True) -> Column:
    """STRUCT(seqid, source, type, begin, end, strand, attributes, error) of a feature line; null for comments and blank lines.

    With ``strict`` a malformed line raises; otherwise ``error`` tells what is wrong.
    """
    plain = names.trim_ascii(line)
    f = F.split(plain, "\t", -1)
    at = lambda i: names.trim_ascii(F.get(f, F.lit(i)))
    start, stop = names.strict_int(at(3)), names.strict_int(at(4))
    error = (
        F.when(F.size(f) != 9, "not 9 fields")
        .when(F.length(at(0)) == 0, "no sequence id")
        .when(start.isNull() | stop.isNull(), "coordinate is no integer or too large")
        .when((start < 1) | (stop < 1), "coordinate below 1")
        .when(start > stop, "start after end")
        .when(~at(6).isin(*STRANDS), "bad strand")
    )
    checked = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("GFF line: "), error)).cast("string")) if strict else error
    row = F.struct(at(0).alias("seqid"), at(1).alias("source"), at(2).alias("type"), (start - 1).alias("begin"), stop.alias("end"), at(6).alias("strand"), at(8).alias("attributes"), checked.alias("error"))
    return F.when((F.length(plain) > 0) & ~plain.startswith("#"), row)


def whole_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): one row per file. An annotated genome is some megabytes; its two sections need each other."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def features(texts: DataFrame, strict: bool = True) -> DataFrame:
    """(file, seqid, source, type, begin, end, strand, attributes, feature_id, seed); records without an ID have no seed."""
    head = F.element_at(F.split(F.col("value"), r"(?m)^##FASTA[ \t\r]*$", 2), 1)
    lines = texts.select("file", F.explode(F.split(head, "\n")).alias("line"))
    rows = lines.select("file", parse_line(F.col("line"), strict).alias("r")).where("r is not null").select("file", "r.*")
    fid = names.attribute(F.col("attributes"), "ID")
    return rows.withColumn("feature_id", fid).withColumn("seed", names.seed_name(F.col("seqid"), F.col("feature_id")))


def read_gff(spark: SparkSession, path: str | list[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features, contigs) of GFF files with a FASTA section."""
    texts = whole_texts(spark, path)
    return features(texts, strict), split_gff_fasta(texts)


#: Annotator whose ``region`` records describe whole contigs (fixed value).
ANNOTATOR = "bakta"


def normalise(feats: DataFrame) -> DataFrame:
    """Without the annotator's ``region`` records, which describe the whole contig; made ones (:func:`whole_contig_features`) stay."""
    return feats.where((F.col("source") != ANNOTATOR) | (F.col("type") != "region"))


def genomes(records: DataFrame, gff_contigs: DataFrame, fasta_contigs: DataFrame) -> DataFrame:
    """(accession, seq_id, seq) of ``records`` (accession, gff, fasta: files as the scans name them).

    The sequences of a GFF file are preferred to those of the FASTA file; a record with neither raises.
    """
    rows = records.select("accession", "gff", "fasta")
    inside = rows.join(gff_contigs.withColumnRenamed("file", "gff"), "gff").select("accession", "seq_id", "seq")
    rest = rows.join(inside.select("accession").distinct(), "accession", "left_anti")
    outside = rest.join(fasta_contigs.withColumnRenamed("file", "fasta"), "fasta", "left").select("accession", "seq_id", "seq")
    lacking = F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("GFF: no sequence for "), "accession")).cast("string"))
    return inside.unionByName(outside.withColumn("_e", lacking).where("_e is null").drop("_e"))


def whole_contig_features(contigs: DataFrame) -> DataFrame:
    """One feature per contig and strand over its length, ID ``base``: annotations for genomes without any."""
    rows = contigs.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    return rows.select(
        "file", F.col("seq_id").alias("seqid"), F.lit("base").alias("source"), F.lit("region").alias("type"), F.lit(0).cast("bigint").alias("begin"), F.length("seq").cast("bigint").alias("end"),
        "strand", F.lit("ID=base").alias("attributes"), F.lit("base").alias("feature_id"), F.concat("seq_id", F.lit("-base")).alias("seed"),
    )
