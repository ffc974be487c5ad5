"""Text lines with their number in the file, from splits read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions.session import broadcast_if_small

#: Splits up to this number are broadcast as (file, block, shift), some 100 MB; beyond it lines are shuffled by split.
MAX_SPLITS = 500_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value), line numbers from 0; compressed files are read transparently.

    Lines are numbered within their split, and splits are shifted by the lines before them: no sort of the data.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("low"), F.count("*").alias("n"))  # one row per split
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("file", "block", "low", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return raw.join(broadcast_if_small(shifts, MAX_SPLITS), ["file", "block"]).select("file", (F.col("id") - F.col("low") + F.col("before")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size, modified) of all files below a path, without reading them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
