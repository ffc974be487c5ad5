"""Groups of records linked directly or through others, over any number of pairs.

Method: union-find runs within the partitions the pairs arrive in and keeps only spanning forests (stars: vertex and local
root). Forests are then merged level by level through partitions of at most ``EDGES_AT_ONCE`` edges. Once a level's forest
fits one such partition, a last union-find gives the global components. While it doesn't, every vertex is replaced by the
least of the local roots it has met, which merges the forests it belongs to; the edges left between different roots are the
next level's, again run through union-find in their partitions. The levels are read back from the last to the first.

Roots are the least by a hash that is seeded anew on every level, not by name, so no order of names is bad: a vertex stays
only if it is the least one that some vertex has met, of a chain fewer than half of them. The levels grow with the logarithm
of pairs / EDGES_AT_ONCE, and as the greatest vertex of a component is never chosen, each level has fewer vertices than the
one before. The group identifier is the least member.

Hot vertices: a hub meets its leaves in the partition where the pairs are and leaves one row per vertex there; where a
root's replacement has to reach the rows that carry it, :func:`lookup` sends that of hot roots to the rows.

Defined results: a null or blank name names no record; a pair of a record with itself links nothing but names it;
repeated pairs and both directions count once; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.session import materialise, release
from strandflow.functions.text import SPACES, strip_space
from strandflow.operators.skew import lookup

EDGES_AT_ONCE = 200_000

_STAR = "v string, r string"


def forest(a: list[int], b: list[int], n: int) -> list[int]:
    """Root of each of ``n`` vertices (the least of its component) after joining the pairs (a, b)."""
    parent = list(range(n))
    for x, y in zip(a, b):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for v in range(n):  # a parent is never greater than its child
        parent[v] = parent[parent[v]]
    return parent


def _stars(edges: pa.Table) -> pa.RecordBatch:
    """Stars of the spanning forest of edges (a, b, hash of a, hash of b); every vertex comes out once, a root with itself."""
    n = len(edges)
    both = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks], pa.string())
    hashes = pa.chunked_array([*edges.column(2).chunks, *edges.column(3).chunks], pa.int64())
    coded = both.combine_chunks().dictionary_encode()
    codes = coded.indices
    first = pc.index_in(pa.array(range(len(coded.dictionary)), pa.int32()), codes)
    known = pa.table({"v": coded.dictionary, "h": hashes.combine_chunks().take(first)})
    order = pc.sort_indices(known, [("h", "ascending"), ("v", "ascending")])
    names = coded.dictionary.take(order)
    place = pc.index_in(pa.array(range(len(names)), pa.int64()), order.cast(pa.int64()))
    ranks = place.take(codes).to_pylist()
    roots = forest(ranks[:n], ranks[n:], len(names))
    return pa.RecordBatch.from_arrays([names, names.take(pa.array(roots, pa.int64()))], names=["v", "r"])


def _local_forests(at_once: int):
    """Forests of bounded runs of edges, whatever the partition's size."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, at_once):
                part = batch.slice(begin, at_once)
                held.append(part)
                rows += part.num_rows
                if rows >= at_once:
                    yield _stars(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield _stars(pa.Table.from_batches(held))

    return run


def _hash(level: int, c: str) -> Column:
    return F.xxhash64(F.lit(level), c)


def _forests(edges: DataFrame, level: int, at_once: int) -> DataFrame:
    return edges.select("a", "b", _hash(level, "a").alias("ha"), _hash(level, "b").alias("hb")).mapInArrow(_local_forests(at_once), _STAR)


def components(edges: DataFrame, at_once: int = EDGES_AT_ONCE, levels: list[int] | None = None) -> DataFrame:
    """(vertex, group_id) of every vertex of ``edges`` (a STRING, b STRING); ``levels`` receives each level's number of edges."""
    linked = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    stars = materialise(_forests(linked, 0, at_once), "components-stars")
    merged: list[DataFrame] = []  # per level: each vertex and what replaces it
    while True:
        links = stars.where("v <> r")
        n = links.count()
        if levels is not None:
            levels.append(n)
        if n <= at_once:
            last = links.select(F.col("v").alias("a"), F.col("r").alias("b")).repartition(1)
            # by name, so that without further levels the root is the least member
            top = last.select("a", "b", F.lit(0).cast("bigint").alias("ha"), F.lit(0).cast("bigint").alias("hb")).mapInArrow(_local_forests(at_once + 1), _STAR)
            break
        level = len(merged)
        chosen = materialise(stars.groupBy("v").agg(F.min(F.struct(_hash(level, "r").alias("h"), F.col("r").alias("r")))["r"].alias("p")), "components-chosen")
        met = materialise(links.join(chosen, "v").select("r", F.col("p").alias("a")), "components-met")
        between = lookup(met, "r", chosen.select(F.col("v").alias("r"), F.col("p").alias("b"))).where("a <> b").select("a", "b").distinct()
        after = materialise(_forests(between, level + 1, at_once), "components-stars")
        release(stars)
        release(met)
        stars = after
        merged.append(chosen)
    if not merged:
        return top.select(F.col("v").alias("vertex"), F.col("r").alias("group_id"))
    labels = materialise(top.select(F.col("v").alias("p"), F.col("r").alias("top")), "components-labels")
    for chosen in reversed(merged):
        found = lookup(chosen, "p", labels).select(F.col("v").alias("p"), F.coalesce("top", "p").alias("top"))
        before, labels = labels, materialise(found, "components-labels")
        release(before)
    least = labels.groupBy("top").agg(F.min("p").alias("group_id"))
    return lookup(labels, "top", least).select(F.col("p").alias("vertex"), "group_id")


def first_word(c: Column) -> Column:
    """The first word of a name, null where it has none."""
    plain = F.translate(strip_space(c), SPACES, " " * len(SPACES))
    return F.nullif(F.substring_index(plain, " ", 1), F.lit(""))


def share(c: Column) -> Column:
    """A measurement as a share: null for null and NaN, values above 1 are percentages."""
    return F.when(F.isnan(c) | c.isNull(), None).when(c > 1, c / 100).otherwise(c)


def pair_groups(pairs: DataFrame, name_a: str, name_b: str, measure: str, at_least: float, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(accession, group_id) of every accession named in ``pairs``; linked where any row measures ``at_least``."""
    named = pairs.select(first_word(F.col(name_a)).alias("a"), first_word(F.col(name_b)).alias("b"), share(F.col(measure)).alias("m"))
    groups = components(named.where(F.col("m") >= at_least).select("a", "b"), at_once)
    everyone = named.select("a").unionByName(named.select(F.col("b").alias("a"))).where("a is not null").distinct()
    return everyone.join(groups.withColumnRenamed("vertex", "a"), "a", "left").select(
        F.col("a").alias("accession"), F.coalesce("group_id", "a").alias("group_id")
    )
