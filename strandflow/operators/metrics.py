"""Benchmark metrics, seeded samples and cache pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.operators.order import running_sum

SUMS = ("elapsed_seconds", "user_seconds", "system_seconds", "major_page_faults", "minor_page_faults", "voluntary_context_switches", "involuntary_context_switches", "filesystem_inputs", "filesystem_outputs")


def aggregate(runs: DataFrame, by: list[str], order: str, sums: tuple[str, ...] = SUMS) -> DataFrame:
    """Sums of times and counts, CPU % weighted by samples, greatest memory, exit code of the last run."""
    return runs.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in sums],
        (F.sum(F.col("cpu_percent") * F.col("samples")) / F.sum("samples")).alias("cpu_percent"),
        F.max("max_rss_kb").alias("max_rss_kb"),
        F.max_by("exit_code", order).alias("exit_code"),
        F.sum("samples").alias("samples"),
    )


def averages(total: DataFrame, columns: tuple[str, ...] = ("elapsed_seconds", "user_seconds", "system_seconds")) -> DataFrame:
    return total.withColumns({f"average_{c}": F.col(c) / F.col("samples") for c in columns})


def sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows, the least by a seeded hash of ``key``; fewer rows than that raise."""
    out = df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), key).limit(n)
    if out.count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return out


def to_prune(files: DataFrame, most_bytes: int) -> DataFrame:
    """Files to delete, oldest first, until at most ``most_bytes`` are left: (file, size, modified)."""
    ranked = running_sum(files, [F.col("modified"), F.col("file")], "size", "_upto", "cache")
    whole = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one number
    return ranked.where(F.lit(whole) - F.col("_upto") + F.col("size") > most_bytes).drop("_upto")


def total_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
