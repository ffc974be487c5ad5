"""Aggregation by skewed keys without a hot task: eager aggregation through joins.

Both inputs are aggregated by join key first (map-side, so a hot key sends one state per task), the compact states are
joined, counts multiplied and sums scaled, and only then rolled up to the group.

Defined results: null join keys match nothing; a null group is a group (callers drop it where it isn't a value);
repeated rows count as often as they occur; empty inputs give empty results; columns not named are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.session import materialise


def compact(df: DataFrame, keys: list[str], sums: dict[str, str] | None = None, prefix: str = "") -> DataFrame:
    """State per key: row count, and for each of ``sums`` (name -> column) its exact sum and number of values."""
    aggs = [F.count("*").alias(f"{prefix}n")]
    for name, column in (sums or {}).items():
        aggs += [F.sum(F.col(column).cast("decimal(24,6)")).alias(f"{prefix}sum_{name}"), F.count(column).alias(f"{prefix}cnt_{name}")]
    return df.groupBy(*keys).agg(*aggs)


def join_counts(
    left: DataFrame,
    right: DataFrame,
    on: str,
    group: list[str],
    left_sums: dict[str, str] | None = None,
    right_sums: dict[str, str] | None = None,
) -> DataFrame:
    """Per ``group`` (columns of ``left``) the row count and sums of ``left JOIN right USING (on)``, without that join.

    n = sum of n_left * n_right per key; a left sum counts n_right times, a right sum n_left times.
    Also ``n_left``: rows of ``left`` in the group, matched or not.
    """
    keys = [on, *[g for g in group if g != on]]
    lc = compact(left.select(*keys, *set((left_sums or {}).values())), keys, left_sums, "l_")
    rc = compact(right.where(F.col(on).isNotNull()).select(on, *set((right_sums or {}).values())), [on], right_sums, "r_")
    return join_states(lc, rc, on, group, left_sums or {}, right_sums or {}).withColumn("n_joined", F.col("n_joined").cast("bigint"))


def join_states(left: DataFrame, right: DataFrame, on: str, group: list[str], left_sums: dict[str, str], right_sums: dict[str, str]) -> DataFrame:
    """:func:`join_counts` from the compact states of both sides: ``l_`` per (on, group), ``r_`` per ``on``; n_joined is a decimal."""
    joined = left.join(right, on, "left")
    rn = F.coalesce(F.col("r_n"), F.lit(0))
    out = [F.sum("l_n").alias("n_left"), F.sum(F.col("l_n").cast("decimal(18,0)") * rn.cast("decimal(18,0)")).cast("decimal(38,0)").alias("n_joined")]
    for name in left_sums:
        out.append(F.sum((F.col(f"l_sum_{name}") * rn.cast("decimal(12,0)")).cast("decimal(30,6)")).alias(f"sum_{name}"))
    for name in right_sums:
        out.append(F.sum((F.col(f"r_sum_{name}") * F.col("l_n").cast("decimal(12,0)")).cast("decimal(30,6)")).alias(f"sum_{name}"))
        out.append(F.sum(F.col(f"r_cnt_{name}") * F.col("l_n")).alias(f"cnt_{name}"))
    return joined.groupBy(*group).agg(*out)


def heavy_values(rows: DataFrame, percent: int) -> DataFrame:
    """(table_name, key_value) of values that hold at least ``percent`` % of all rows of their table.

    The rows of a table joined with themselves by ``table_name`` would give n * N rows for a value of n rows in a table of N:
    :func:`join_states` counts them from compact states, and N is that count over n. The state per value is written once; the
    one per table is rolled up from it, so the tables are read once and no row meets another.
    """
    values = materialise(compact(rows.select("table_name", "key_value"), ["table_name", "key_value"], prefix="l_"), "value-states")
    tables = F.broadcast(values.groupBy("table_name").agg(F.sum("l_n").alias("r_n")))  # one row per table
    met = join_states(values, tables, "table_name", ["table_name", "key_value"], {}, {})
    whole = F.expr("n_joined div n_left")
    return met.where("key_value is not null").where(F.col("n_left") * 100 >= whole * percent).select("table_name", "key_value")
