"""Sinks: manifests, catalogue plans, per-accession results, cluster stores, sequence files, staged writes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def staged(df: DataFrame, path: str, write) -> None:
    """Run ``write(temporary path)`` beside ``path``, then rename, so that readers never see a partial result."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    write(part)
    if not fs.rename(_fs(spark, part)[1], target):
        raise OSError(f"could not move {part} to {path}")


FINAL = "_FINAL"


def finalise(spark: SparkSession, path: str) -> None:
    """Mark the tables below ``path`` as final; a second time raises. Writers ask :func:`require_open` first."""
    require_open(spark, path)
    fs, p = _fs(spark, f"{path.rstrip('/')}/{FINAL}")
    fs.create(p, False).close()


def require_open(spark: SparkSession, path: str) -> None:
    """Raises if the tables below ``path`` are final."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/{FINAL}")
    if fs.exists(p):
        raise PermissionError(f"{path} is final")


def append_rows(df: DataFrame, path: str, name: str) -> None:
    """Rows added to the table ``name`` of an index below ``path`` that isn't final."""
    require_open(df.sparkSession, path)
    df.write.mode("append").parquet(f"{path.rstrip('/')}/{name}")


def save_csv(df: DataFrame, path: str) -> bool:
    """Gzipped CSV with a header; nothing is written for an empty table."""
    if not df.take(1):
        return False
    staged(df, path, lambda p: df.write.option("header", "true").option("compression", "gzip").csv(p))
    return True


def save_plan(df: DataFrame, path: str, about: dict) -> None:
    """A catalogue plan: CSV rows and a JSON side file of what it was made from."""
    save_csv(df, path)
    fs, p = _fs(df.sparkSession, path.rstrip("/") + ".about.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
    out.close()


def with_file_paths(df: DataFrame, archive: str, sample: str, root: str) -> DataFrame:
    """``fa`` and ``gff`` paths derived from archive and sample names."""
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(F.col(archive), r"\.tar\.xz\z", ""), F.lit("/"))
    return df.withColumn("fa", F.concat(folder, sample, F.lit(".fa.gz"))).withColumn("gff", F.concat(folder, sample, F.lit(".gff3.gz")))


def save_results(results: DataFrame, path: str, key: str = "accession") -> None:
    """One folder of gzipped JSON per query, also for queries without hits."""
    staged(results, path, lambda p: results.write.partitionBy(key).option("compression", "gzip").json(p))


def save_clusters(clusters: DataFrame, path: str) -> None:
    staged(clusters, path, lambda p: clusters.write.option("compression", "bzip2").json(p))


def fasta_lines(df: DataFrame, seq_id: str, seq: str, width: int = 60) -> DataFrame:
    """(value): FASTA text of each row, wrapped."""
    s = F.col(seq)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / width).cast("int")), lambda i: s.substr(i * width + 1, F.lit(width)))
    return df.select(F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), F.array_join(cut, "\n")).alias("value"))


def fastq_lines(df: DataFrame, read_id: str, seq: str, keep: list[str] = ()) -> DataFrame:
    """(``keep``, value): FASTQ text of each row with one constant quality."""
    return df.select(*keep, F.concat_ws("\n", F.concat(F.lit("@"), F.col(read_id)), F.col(seq), F.lit("+"), F.repeat(F.lit("I"), F.length(seq))).alias("value"))


def save_json(df: DataFrame, path: str) -> None:
    staged(df, path, lambda p: df.write.json(p))
