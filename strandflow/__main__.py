"""Command line: builds, samples, classification, sketches, clusters, and catalogue queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandflow import workflows as W
from strandflow.operators import catalog

CATALOGUE = ("assembly", "asm_batches", "assembly_stats", "checkm2", "bakta", "ann_batches")


def _options(a: argparse.Namespace) -> catalog.Options:
    return catalog.Options(a.species, a.high_quality, a.has_assembly, a.max_contamination, a.min_completeness, a.has_annotation)


def _catalogue(spark: SparkSession, folder: str) -> dict:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in CATALOGUE if W._there(spark, f"{folder}/{n}.parquet")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandflow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *args):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    command("build", "manifest", "out").add_argument("-k", type=int, default=31)
    c = command("sample", "forward", "out")
    c.add_argument("--reverse")
    c.add_argument("-k", type=int, default=31)
    command("classify", "sample", "reference", "out")
    for name in ("sketch", "cluster", "screen"):
        c = command(name, "out")
        c.add_argument("files", nargs="*")
        c.add_argument("-k", type=int, default=31)
        c.add_argument("--scaled", type=int, default=1000)
        c.add_argument("--index")
        c.add_argument("--ani", type=float, action="append")
        c.add_argument("--threshold-bp", type=int, default=50_000)
    for name in ("count", "count-by", "head", "plan-download", "inspect"):
        c = command(name, "catalogue")
        c.add_argument("--species")
        c.add_argument("--limit", type=int)
        c.add_argument("--out")
        full = name == "plan-download"
        for flag in ("--high-quality", "--has-assembly", "--has-annotation"):
            c.add_argument(flag, action=argparse.BooleanOptionalAction, default=full)
        c.add_argument("--max-contamination", type=float, default=5.0 if full else None)
        c.add_argument("--min-completeness", type=float, default=95.0 if full else None)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandflow").getOrCreate()
    if a.command == "build":
        return W.build_from_manifest(spark, a.manifest, a.k, a.out)
    if a.command == "sample":
        return W.construct_weighted(spark, a.forward, a.reverse, a.k, a.out)
    if a.command == "classify":
        return W.classify_sample(spark, a.sample, a.reference, a.out)
    if a.command == "sketch":
        return W.sketch_files(spark, a.files, a.k, a.scaled, a.out)
    if a.command == "cluster":
        out = W.cluster_sketches(spark.read.parquet(a.index), a.k, a.ani or [0.95])
        out.write.parquet(a.out)
        return out
    if a.command == "screen":
        return W.screen_files(spark, a.files, spark.read.parquet(a.index), a.k, a.scaled, a.threshold_bp, a.out)
    tables = _catalogue(spark, a.catalogue)
    if a.command == "inspect":
        rows = [(t, c, kind) for t, df in sorted(tables.items()) for c, kind in catalog.inspect(df)]
        df = spark.createDataFrame(rows, "table string, column string, type string")
    elif a.command == "count":
        df = catalog.count(tables, _options(a))
    elif a.command == "count-by":
        df = catalog.count_by_species(tables, _options(a), a.limit)
    elif a.command == "head":
        df = catalog.head(tables, _options(a), ["sample_accession"], a.limit or 10)
    else:
        df = catalog.download_plan(tables, _options(a))
    if a.out:
        df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t.startswith("timestamp")}).write.option("header", "true").csv(a.out)
    else:
        df.show(a.limit or 50, truncate=False)
    return df


if __name__ == "__main__":
    main()
