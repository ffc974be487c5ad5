"""References to records that do not exist at the time of the reference.

Method: a skew-aware split. References are pre-aggregated per key and month to one state (rows, first and last time);
heavy keys (from a quarter of an even task's share on) are checked against a broadcast of just their targets, the
remaining keys by a shuffle join, and the orphans of both are united. The check sees states, not rows: a month in which a
target is there throughout, or never, is settled at once, and only rows of the others are looked at.

Defined results: a blank reference is no reference; a null time finds a target only if one exists at no given time, so
such a row comes out as ``missing`` or ``late`` with a null period; repeated rows count once in :func:`find_orphans`
and by their number in :func:`orphan_counts`; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.session import materialise, rows_at_most
from strandflow.functions.text import base_name, blank, strip_space
from strandflow.operators.skew import hot_from

#: Kind of a period whose rows differ.
MIXED = "mixed"
#: Orphan periods up to this number are broadcast, some 50 MB; beyond it rows are shuffled.
BROADCAST_PERIODS = 200_000


def references(df: DataFrame, ref_table: str, field: str, record_key: str, at: str, key: Column) -> DataFrame:
    """Rows of ``df`` with a reference that isn't blank: (ref_table, ref_field, ref_key, record_key, at)."""
    return df.where(~blank(F.col(field))).select(
        F.lit(ref_table).alias("ref_table"),
        F.lit(field).alias("ref_field"),
        key.alias("ref_key"),
        F.col(record_key).cast("string").alias("record_key"),
        F.col(at).alias("at"),
    )


def lifetimes(df: DataFrame, field: str, key: Column, start: str, end: str | None = None) -> DataFrame:
    """One state per target key: its distinct lifetimes and the first removal.

    Targets without an end (``end=None``) need only their first appearance, so their state has one lifetime.
    """
    rows = df.select(
        key.alias("ref_key"),
        F.col(start).alias("s"),
        (F.col(end) if end else F.lit(None).cast("timestamp_ntz")).alias("e"),
    ).where("ref_key is not null and s is not null")
    if end is None:
        spans = rows.groupBy("ref_key").agg(F.min("s").alias("s")).withColumn("e", F.lit(None).cast("timestamp_ntz"))
    else:  # one row per end: a lifetime with an earlier start covers those that end with it
        spans = rows.groupBy("ref_key", "e").agg(F.min("s").alias("s"))
    return spans.groupBy("ref_key").agg(
        F.collect_list(F.struct("s", "e")).alias("spans"), F.min("e").alias("first_end")
    ).withColumn("ref_field", F.lit(field))


_ALL = ["ref_table", "ref_field", "ref_key", "month"]


def _month(at: Column) -> Column:
    """Months since year 0, -1 for no time: a group key without nulls."""
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(-1))


def _period(month: Column) -> Column:
    return F.when(month >= 0, F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int")))


def per_period(refs: DataFrame) -> DataFrame:
    """References per table, field, key and month: how many, and the first and last time. Combined map-side."""
    return refs.groupBy("ref_table", "ref_field", "ref_key", _month(F.col("at")).alias("month")).agg(
        F.count("*").alias("n_rows"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


def _kind_at(at: Column) -> Column:
    """Kind of a reference at one time, null where its target is there."""
    live = F.exists("spans", lambda x: (x["s"] <= at) & (x["e"].isNull() | (x["e"] > at)))
    return (
        F.when(F.col("spans").isNull(), "missing")
        .when(F.coalesce(live, F.lit(False)), None)
        .when(F.col("first_end") <= at, "deleted")
        .otherwise("late")
    )


def judge(periods: DataFrame, states: DataFrame) -> DataFrame:
    """``periods`` with ``kind`` of all their rows (null: the target is there for all), or MIXED where it depends on the row.

    The skew-aware split: heavy keys are checked against a broadcast of just their states, the others by a shuffle join, and
    both are united. A key has one row per month here, however many references it has.
    """
    keys = ["ref_field", "ref_key"]
    per_key = periods.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))
    rows = periods.agg(F.sum("n_rows")).first()[0] or 0
    heavy = F.broadcast(per_key.where(F.col("n_rows") >= hot_from(periods, rows)).select(*keys))  # at most MOST_HOT keys
    heavy_states = F.broadcast(states.join(heavy, keys, "left_semi"))
    met = periods.join(heavy, keys, "left_semi").join(heavy_states, keys, "left")
    met = met.unionByName(periods.join(heavy, keys, "left_anti").join(states, keys, "left"))
    first, last = F.col("first_at"), F.col("last_at")
    covered = F.exists("spans", lambda x: (x["s"] <= first) & (x["e"].isNull() | (x["e"] > last)))
    touched = F.exists("spans", lambda x: (x["s"] <= last) & (x["e"].isNull() | (x["e"] > first)))
    same = (F.col("first_end") <= first) | F.coalesce(F.col("first_end") > last, F.lit(True))
    kind = (
        F.when(F.col("spans").isNull() | (F.col("month") < 0) | (first == last), _kind_at(first))
        .when(covered, None)
        .when(~touched & same, _kind_at(first))
        .otherwise(MIXED)
    )
    return met.withColumn("kind", kind)


def _row_kinds(refs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``refs`` in a period that is judged, with the kind of each; rows without one left out.

    ``judged`` holds one row per table, field, key and month. Where it is proven small it is broadcast and no reference is
    moved; beyond that the periods with most rows are broadcast and the rows of the others shuffled.
    """
    keyed = refs.withColumn("month", _month(F.col("at")))
    slim = judged.select(*_ALL, "kind", F.when(F.col("kind") == MIXED, F.col("spans")).alias("spans"), F.when(F.col("kind") == MIXED, F.col("first_end")).alias("first_end"), "n_rows")
    if rows_at_most(slim, BROADCAST_PERIODS):
        met = keyed.join(F.broadcast(slim.drop("n_rows")), _ALL)
    else:
        rows = slim.agg(F.sum("n_rows")).first()[0]
        least = hot_from(refs, rows)
        hot = F.broadcast(slim.where(F.col("n_rows") >= least).drop("n_rows"))  # at most MOST_HOT rows
        rest = keyed.join(hot.select(*_ALL), _ALL, "left_anti").join(slim.where(F.col("n_rows") < least).drop("n_rows"), _ALL)
        met = keyed.join(hot, _ALL).unionByName(rest)
    return met.withColumn("kind", F.when(F.col("kind") == MIXED, _kind_at(F.col("at"))).otherwise(F.col("kind"))).where("kind is not null").drop("spans", "first_end")


def find_orphans(refs: DataFrame, states: DataFrame) -> DataFrame:
    """One row per orphan record, field, period and kind."""
    judged = materialise(judge(materialise(per_period(refs), "reference-periods"), states).where("kind is not null"), "reference-kinds")
    return (
        _row_kinds(refs, judged)
        .select("ref_table", "ref_field", "record_key", "month", "kind")
        .distinct()
        .select("ref_table", "ref_field", "record_key", _period(F.col("month")).alias("period"), "kind")
    )


def orphan_counts(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Orphan rows and keys per table, field, period and kind. Only the rows of mixed periods are looked at one by one."""
    judged = materialise(judge(materialise(per_period(refs), "reference-periods"), states).where("kind is not null"), "reference-kinds")
    whole = judged.where(F.col("kind") != MIXED).select(*_ALL, "kind", "n_rows")
    mixed = _row_kinds(refs, judged.where(F.col("kind") == MIXED)).groupBy(*_ALL, "kind").agg(F.count("*").alias("n_rows"))
    return (
        whole.unionByName(mixed)
        .groupBy("ref_table", "ref_field", "month", "kind")
        .agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_keys"))
        .select("ref_table", "ref_field", _period(F.col("month")).alias("period"), "kind", "n_rows", "n_keys")
    )


def catalogue_references(assembly: DataFrame, bakta: DataFrame) -> DataFrame:
    """The three references of the catalogue tables."""
    return (
        references(assembly, "assembly", "osf_tarball_filename", "sample_accession", "listed_at", base_name(F.col("osf_tarball_filename")))
        .unionByName(references(bakta, "bakta", "tar_xz", "file_name", "listed_at", base_name(F.col("tar_xz"))))
        .unionByName(references(bakta, "bakta", "sample", "file_name", "listed_at", strip_space(F.col("sample"))))
    )


def catalogue_states(assembly: DataFrame, asm_batches: DataFrame, ann_batches: DataFrame) -> DataFrame:
    """Target states for :func:`catalogue_references`."""
    return (
        lifetimes(asm_batches, "osf_tarball_filename", base_name(F.col("asm_tar_xz")), "published_at", "removed_at")
        .unionByName(lifetimes(ann_batches, "tar_xz", base_name(F.col("ann_tar_xz")), "published_at", "removed_at"))
        .unionByName(lifetimes(assembly, "sample", strip_space(F.col("sample_accession")), "listed_at"))
    )
