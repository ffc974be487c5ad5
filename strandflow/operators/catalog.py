"""Catalogue queries: a small builder over DataFrames, and the star joins of the genome catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Query:
    """select / join / where / group / order / limit, applied in SQL's order; the plan stays one Catalyst plan."""

    def __init__(self, core: DataFrame):
        self._df, self._columns = core, list(core.columns)
        self._where: list[Column] = []
        self._group: list[str] = []
        self._order: list[Column] = []
        self._limit: int | None = None

    def join(self, right: DataFrame, left_on: str, right_on: str, how: str = "inner") -> Query:
        """Columns of ``right`` follow in its order, without its join key and without those there already."""
        kept = [c for c in right.columns if c != right_on and c not in self._columns]
        side = right.select(F.col(right_on).alias("_key"), *kept)
        self._df = self._df.join(side, self._df[left_on] == side["_key"], how).drop("_key")
        self._columns += kept
        return self

    def where(self, condition: Column | None) -> Query:
        """A condition to hold as well; None is no condition."""
        if condition is not None:
            self._where.append(condition)
        return self

    def group_by(self, *columns: str) -> Query:
        self._group += columns
        return self

    def order_by(self, *columns: Column) -> Query:
        self._order += columns
        return self

    def limit(self, n: int | None) -> Query:
        self._limit = n
        return self

    def build(self, *select: Column | str) -> DataFrame:
        df = self._df
        for c in self._where:
            df = df.where(c)
        if self._group:
            df = df.groupBy(*self._group).agg(*select)
        else:
            df = df.select(*(select or self._columns))
        if self._order:
            df = df.orderBy(*self._order)
        return df if self._limit is None else df.limit(self._limit)


@dataclass(frozen=True)
class Options:
    """Conditions of a catalogue query; None means no condition, so a bound of 0 is a bound."""

    species: str | None = None
    high_quality: bool = False
    has_assembly: bool = False
    max_contamination: float | None = None
    min_completeness: float | None = None
    has_annotation: bool = False


def select_assemblies(t: dict[str, DataFrame], o: Options) -> Query:
    """Assemblies under ``o``; quality and annotation tables are joined only where a condition needs them."""
    q = Query(t["assembly"])
    if o.max_contamination is not None or o.min_completeness is not None:
        q.join(t["checkm2"], "sample_accession", "sample")
        q.where(F.col("contamination") <= o.max_contamination if o.max_contamination is not None else None)
        q.where(F.col("completeness_general") >= o.min_completeness if o.min_completeness is not None else None)
    if o.has_annotation:
        q.join(t["bakta"], "sample_accession", "sample").where(F.col("status") == "PASS")
    q.where(F.col("sylph_species") == o.species if o.species is not None else None)
    q.where(F.col("hq_filter") == "PASS" if o.high_quality else None)
    q.where(F.col("asm_fasta_on_osf") == "1" if o.has_assembly else None)
    return q


def count(t: dict[str, DataFrame], o: Options) -> DataFrame:
    return select_assemblies(t, o).build(F.count("*").alias("n"))


def count_by_species(t: dict[str, DataFrame], o: Options, limit: int | None = None) -> DataFrame:
    return select_assemblies(t, o).group_by("sylph_species").order_by(F.desc("n"), F.asc("sylph_species")).limit(limit).build(F.count("*").alias("n"))


def head(t: dict[str, DataFrame], o: Options, order: list[str], n: int) -> DataFrame:
    return select_assemblies(t, o).order_by(*map(F.asc, order)).limit(n).build()


def download_plan(t: dict[str, DataFrame], o: Options) -> DataFrame:
    """Assemblies with their archives (and annotation archives), all columns except the right join keys."""
    q = select_assemblies(t, o)
    if "assembly_stats" in t:
        q.join(t["assembly_stats"], "sample_accession", "sample_accession")
    q.join(t["asm_batches"], "osf_tarball_filename", "asm_tar_xz")
    if o.has_annotation:
        q.join(t["ann_batches"], "tar_xz", "ann_tar_xz")
    return q.build()


def batches(plan: DataFrame, archive: str, accession: str) -> DataFrame:
    """(archive, n, first): rows of a plan per archive to fetch; a row without one raises."""
    bad = F.when(F.col(archive).isNull(), F.raise_error(F.lit("plan: row without archive")).cast("string"))
    return plan.withColumn("_e", bad).where("_e is null").groupBy(archive).agg(F.count("*").alias("n"), F.min(accession).alias("first"))


def subset(manifest: DataFrame, wanted: DataFrame, key: str = "accession") -> DataFrame:
    """Manifest rows of the wanted keys; a key that isn't there raises."""
    asked = wanted.select(key).distinct()
    joined = asked.join(manifest.withColumn("_there", F.lit(1)), key, "left")
    bad = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("not in the manifest: "), F.col(key).cast("string"))).cast("string"))
    return joined.withColumn("_e", bad).where("_e is null").select(*manifest.columns)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Wanted rows without a result."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def inspect(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes
