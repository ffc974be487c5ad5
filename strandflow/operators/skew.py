"""Joins of rows with hot keys to a table of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.session import materialise

#: Rows that a single task can take, whatever their keys.
ONE_TASK = 200_000
#: Hot keys are at most so many, so the rows that are broadcast for them are too.
MOST_HOT = 20_000


def hot_from(df: DataFrame, rows: int) -> int:
    """Rows of one key from which on it is hot: a quarter of an even task's share, but at most MOST_HOT keys can have so many."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1000, rows // min(4 * parts, MOST_HOT) + 1)


def lookup(df: DataFrame, key: str, table: DataFrame, how: str = "left", one_task: int = ONE_TASK, rows: int | None = None) -> DataFrame:
    """``df`` with the columns of ``table`` (one row per ``key``).

    Rows of hot keys meet a broadcast of just those keys' rows of ``table`` where they are; the others are shuffled. ``df``
    is read three times, so it should be a written table, unless it is known to have few ``rows``. A null key finds nothing.
    """
    rows = df.count() if rows is None else rows
    if rows <= one_task:
        return df.join(table, key, how)
    hot = materialise(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_from(df, rows)).select(key), "hot-keys")
    if hot.isEmpty():
        return df.join(table, key, how)
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    warm = F.broadcast(table.join(hot, key, "left_semi"))
    near = df.join(hot, key, "left_semi").join(warm, key, how)
    return near.unionByName(df.join(hot, key, "left_anti").join(table, key, how))


def salted_join(df: DataFrame, rows: int, key: str, other: DataFrame, spread: str) -> DataFrame:
    """``df`` (``rows`` rows) joined to ``other`` (several rows per ``key``) where a key may be in very many rows of ``df``: those
    are dealt to slices by ``spread``, and ``other``'s rows of the key go to each."""
    least = hot_from(df, rows)
    if rows <= least:
        return df.join(other, key)
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    slices = F.broadcast(materialise(hot.select(key, F.ceil(F.col("_n") / least).cast("int").alias("_s")), "hot-slices"))  # at most MOST_HOT rows
    one = F.coalesce(F.col("_s"), F.lit(1))
    left = df.join(slices, key, "left").withColumn("_k", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_s")
    right = other.join(slices, key, "left").withColumn("_k", F.explode(F.sequence(F.lit(0), one - 1))).drop("_s")
    return left.join(right, [key, "_k"]).drop("_k")
