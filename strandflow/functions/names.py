"""Names, paths and identifiers: scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by file type (fixed values of the formats).
FASTA_EXTENSIONS = ("fna", "fa", "fasta")
GFF_EXTENSIONS = ("gff3", "gff")
FASTQ_EXTENSIONS = ("fq", "fastq")

#: FASTQ file names (fixed value): sample, lane, orientation, fragment, suffix.
FASTQ_NAME = r"^(.+?)(?:[_.-](L\d\d\d))?[_.-](R?[12])?(?:[_.-](\d\d\d))?(\.(?:f(?:ast)?q)(?:\.gz)?)$"

#: Prefixes tried in this order for a name of one word (fixed values).
RANK_PREFIXES = ("g", "f", "o", "c", "p", "d")

#: Ranks from the lowest (fixed values).
RANKS = ("species", "genus", "family", "order", "class", "phylum", "superkingdom")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_compression(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.tar)?\.gz$", "")


def file_type(path: Column) -> Column:
    """FASTA, GFF or FASTQ by extension, null for others."""
    ext = F.regexp_extract(F.lower(without_compression(file_name(path))), r"\.([^.]+)$", 1)
    return F.when(ext.isin(*FASTA_EXTENSIONS), "FASTA").when(ext.isin(*GFF_EXTENSIONS), "GFF").when(ext.isin(*FASTQ_EXTENSIONS), "FASTQ")


def sequence_name(path: Column) -> Column:
    """Base name without compression and type extension."""
    ext = "|".join(FASTA_EXTENSIONS + GFF_EXTENSIONS + FASTQ_EXTENSIONS)
    return F.regexp_replace(without_compression(file_name(path)), rf"\.({ext})$", "")


def delimiter(path: Column) -> Column:
    """Tab for .tsv, comma for .csv, null for others; compression aside."""
    p = F.lower(without_compression(path))
    return F.when(p.endswith(".tsv"), "\t").when(p.endswith(".csv"), ",")


def read_id(name: Column) -> Column:
    """A read's identifier: up to the first blank or tab, without the mate suffix /1 /2 .1 .2."""
    word = F.regexp_replace(name, r"[ \t].*$", "")
    return F.when(F.length(word) > 2, F.regexp_replace(word, r"[/.][12]$", "")).otherwise(word)


def fastq_parts(name: Column) -> Column:
    """STRUCT(sample, lane, orientation, fragment, suffix) of a FASTQ file name; null where it doesn't parse."""
    part = lambda i: F.nullif(F.regexp_extract(name, FASTQ_NAME, i), F.lit(""))
    return F.when(
        name.rlike(FASTQ_NAME),
        F.struct(
            part(1).alias("sample"),
            part(2).alias("lane"),
            F.right(part(3), F.lit(1)).cast("int").alias("orientation"),
            part(4).alias("fragment"),
            part(5).alias("suffix"),
        ),
    )


def trim_ascii(c: Column) -> Column:
    """Without surrounding space, tab, CR, LF."""
    return F.btrim(c, F.lit(" \t\r\n"))


def strict_int(c: Column) -> Column:
    """BIGINT of a string of digits only; null for anything else and on overflow."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def attribute(attributes: Column, key: str) -> Column:
    """Value of the first ``key=`` of a ;-separated attribute list, trimmed; null where absent or empty; no unescaping."""
    value = F.regexp_extract(attributes, rf"(?:^|;)[ \t\r\n]*{key}[ \t\r\n]*=([^;]*)", 1)
    return F.nullif(trim_ascii(value), F.lit(""))


def dbxrefs(value: Column) -> Column:
    """ARRAY of (database, label) of a comma-separated list, each split at its first colon; entries without one are left out."""
    entries = F.filter(F.split(value, ","), lambda x: F.instr(x, ":") > 1)
    return F.transform(
        entries,
        lambda x: F.struct(
            F.trim(F.substring_index(x, ":", 1)).alias("database"),
            F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))).alias("label"),
        ),
    )


def seed_name(accession: Column, feature_id: Column) -> Column:
    """``accession-id``; null where either is."""
    return F.concat(accession, F.lit("-"), feature_id)


def set_digest(values: Column, separator: str = "") -> Column:
    """SHA-256 of an ARRAY of strings, whatever its order."""
    return F.sha2(F.array_join(F.array_sort(values), separator), 256)


def sharded_path(key: Column, levels: int = 2, width: int = 2) -> Column:
    """Digest-named path below ``levels`` folders, so that no folder holds too many files."""
    d = F.sha2(key, 256)
    return F.concat_ws("/", *[F.substring(d, 1 + i * width, width) for i in range(levels)], d)


def safe_file_name(name: Column) -> Column:
    """Characters other than letters, digits, dot, dash and underscore replaced."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def taxon_candidates(name: Column) -> Column:
    """ARRAY of the names to look up in turn: as typed, then with rank prefixes."""
    plain = F.trim(F.regexp_replace(name, r"\s+", " "))
    parts = F.split(plain, " ")
    binomial = F.array(F.concat(F.lit("s__"), parts[0], F.lit(" "), parts[1]))
    single = F.array(*[F.concat(F.lit(f"{p}__"), plain) for p in RANK_PREFIXES])
    return F.concat(F.array(F.trim(name)), F.when(F.size(parts) > 1, binomial).otherwise(single))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
