"""The accession state machine: reserve, clean up, complete, fail, each as one new table from the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "accession string, taxid string, state string, package_id string, reserved_at timestamp, completed_at timestamp, "
    "cleanup_started_at timestamp, error string"
)
SCHEMA_VERSION = 1
STATES = ("cleaning", "reserved", "complete", "failed")


def _fail(condition: Column, message: str, name: str) -> Column:
    return F.when(condition, F.raise_error(F.concat(F.lit(message + ": "), F.col(name).cast("string"))).cast("string"))


def check_records(records: DataFrame) -> DataFrame:
    """(accession, taxid) trimmed; a blank accession, one given twice, or a missing taxid raises."""
    rows = records.select(F.trim("accession").alias("accession"), F.col("taxid").cast("string").alias("taxid"))
    per = rows.groupBy("accession").agg(F.count("*").alias("_n"), F.min("taxid").alias("taxid"))
    error = F.coalesce(
        F.when(F.coalesce(F.length("accession") == 0, F.lit(True)), F.raise_error(F.lit("blank accession")).cast("string")),
        _fail(F.col("_n") > 1, "accession given twice", "accession"),
        _fail(F.col("taxid").isNull(), "no taxid for", "accession"),
    )
    return per.withColumn("_e", error).where("_e is null").select("accession", "taxid")


def plan(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(accession, taxid, action) of a reservation: new, clean (failed before), occupied (reserved or cleaning) or complete."""
    now = manifest.select("accession", "state")
    action = (
        F.when(F.col("state").isNull(), "new").when(F.col("state") == "failed", "clean").when(F.col("state").isin("reserved", "cleaning"), "occupied").otherwise("complete")
    )
    return records.join(now, "accession", "left").select("accession", "taxid", action.alias("action"))


def reserve(manifest: DataFrame, records: DataFrame, package_id: str, at: Column, fail_if_complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new manifest, plan). Occupied accessions raise before complete ones; either leaves the old table as it is."""
    steps = plan(manifest, check_records(records))
    counts = {r["action"]: r["n"] for r in steps.groupBy("action").agg(F.count("*").alias("n")).collect()}  # four rows at most
    if counts.get("occupied"):
        raise ValueError(f"{counts['occupied']} accessions are occupied")
    if fail_if_complete and counts.get("complete"):
        raise ValueError(f"{counts['complete']} accessions are complete")
    take = steps.where("action in ('new', 'clean')")
    none = F.lit(None)
    fresh = take.select(
        "accession", "taxid", F.when(F.col("action") == "new", "reserved").otherwise("cleaning").alias("state"), F.lit(package_id).alias("package_id"), at.alias("reserved_at"),
        none.cast("timestamp").alias("completed_at"), F.when(F.col("action") == "clean", at).alias("cleanup_started_at"), none.cast("string").alias("error"),
    )
    return manifest.join(take, "accession", "left_anti").unionByName(fresh), steps


def _advance(manifest: DataFrame, accessions: DataFrame, package_id: str, source: str, changes: dict[str, Column]) -> DataFrame:
    """Rows of ``accessions`` changed; one that isn't in state ``source`` and owned by the package raises."""
    asked = accessions.select("accession").distinct().withColumn("_asked", F.lit(1))
    joined = manifest.join(asked, "accession", "full")
    wrong = (F.col("_asked") == 1) & ~F.coalesce((F.col("state") == source) & (F.col("package_id") == package_id), F.lit(False))
    checked = joined.withColumn("_e", _fail(wrong, f"not {source} by this package", "accession")).where("_e is null")
    mine = F.col("_asked") == 1
    return checked.select(*[(F.when(mine, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in manifest.columns])


def finish_cleanup(manifest, accessions, package_id):
    return _advance(manifest, accessions, package_id, "cleaning", {"state": F.lit("reserved")})


def fail_cleanup(manifest, accessions, package_id, error):
    return _advance(manifest, accessions, package_id, "cleaning", {"state": F.lit("failed"), "error": F.lit(error)})


def mark_complete(manifest, accessions, package_id, at):
    return _advance(manifest, accessions, package_id, "reserved", {"state": F.lit("complete"), "completed_at": at})


def mark_failed(manifest, accessions, package_id, error):
    return _advance(manifest, accessions, package_id, "reserved", {"state": F.lit("failed"), "error": F.lit(error), "completed_at": F.lit(None).cast("timestamp")})


def listing(manifest: DataFrame, state: str | None = None) -> DataFrame:
    rows = manifest if state is None else manifest.where(F.col("state") == state)
    return rows.orderBy("accession")


def counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("state").agg(F.count("*").alias("n"))


def taxonomy(manifest: DataFrame, complete_only: bool = True) -> DataFrame:
    rows = manifest.where("state = 'complete'") if complete_only else manifest
    return rows.select("accession", "taxid").orderBy("accession")


def integrity(manifest: DataFrame) -> DataFrame:
    """(accession, fault) of rows that no transition could have made; empty for a sound manifest."""
    per = manifest.withColumn("_n", F.count("*").over(Window.partitionBy("accession")))
    none = lambda c: F.col(c).isNull()
    fault = (
        F.when(none("accession") | (F.trim("accession") == ""), "no accession")
        .when(F.col("_n") > 1, "accession repeated")
        .when(none("state") | ~F.col("state").isin(*STATES), "unknown state")
        .when(none("taxid"), "no taxid")
        .when(none("package_id") | none("reserved_at"), "never reserved")
        .when((F.col("state") == "complete") == none("completed_at"), "completion and state differ")
        .when((F.col("state") == "failed") == none("error"), "error and state differ")
        .when((F.col("state") == "cleaning") & none("cleanup_started_at"), "cleanup without a start")
    )
    return per.select("accession", fault.alias("fault")).where("fault is not null")


def check_version(found: int) -> None:
    if found != SCHEMA_VERSION:
        raise ValueError(f"schema version {found}, expected {SCHEMA_VERSION}")
