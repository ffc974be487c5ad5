"""Row numbers in a global order without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.session import materialise


def number_rows(df: DataFrame, order: list[Column], name: str, start: int = 0, label: str = "order") -> DataFrame:
    """``df`` with ``name``: positions from ``start`` in the order given, which must be total.

    Rows are range-partitioned and sorted, numbered within their partition, and shifted by the partitions before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order)))
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
    placed = materialise(ranged.withColumn("_m", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn("_b", before).drop("_n")
    return placed.join(F.broadcast(shifts), "_p").withColumn(name, F.col("_r") + F.col("_b") + F.lit(start)).drop("_p", "_r", "_m", "_b")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, label: str = "running") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one in a total order, from sums per range of it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order))).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
    placed = materialise(ranged.withColumn("_m", F.monotonically_increasing_id()), label).withColumn("_p", F.shiftright("_m", 33))
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    met = placed.withColumn("_r", inside).join(F.broadcast(sums.withColumn("_b", before).drop("_n")), "_p")
    return met.withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_m", "_b")


def locate(points: DataFrame, chunks: DataFrame, point: str, bucket: int = 4096) -> DataFrame:
    """``points`` with ``chunk_no``: the chunk (chunk_no, start, count) whose [start, start + count) holds the point, else -1."""
    from strandflow.operators.annotations import overlap_join

    one = points.select(F.col(point).alias("begin"), (F.col(point) + 1).alias("end")).distinct().withColumn("_all", F.lit(0))
    spans = chunks.select("chunk_no", F.col("start").alias("r_begin"), (F.col("start") + F.col("count")).alias("r_end")).withColumn("_all", F.lit(0))
    met = overlap_join(one, spans, ["_all"], bucket).select(F.col("begin").alias(point), "chunk_no")
    return points.join(met, point, "left").withColumn("chunk_no", F.coalesce("chunk_no", F.lit(-1)))
