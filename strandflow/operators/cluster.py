"""Clusters of a similarity graph at thresholds, their statistics, refinement and dereplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.session import materialise, release
from strandflow.operators.order import number_rows
from strandflow.operators.skew import lookup

#: Edges up to this number are finished in one task.
EDGES_AT_ONCE = 500_000
SEPARATOR = "\u0001"


def _least_members(batches):
    """(member, root) of all edges of one task: least labels spread over the edges, chains of labels shortened at once."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    edges = pa.Table.from_batches(parts)
    both = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks], pa.string())
    names = both.unique()
    names = names.take(pc.sort_indices(names))
    codes = pc.index_in(both, names).to_numpy()
    u, v = codes[: len(edges)], codes[len(edges) :]
    label = np.arange(len(names))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["member", "root"])


def connected(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(member, root) of every vertex of (a STRING, b STRING): the least vertex of its component, by contraction.

    On every level a vertex is replaced by the neighbour (or itself) with the least hash, seeded anew per level, until the
    edges left fit one task. No order of names is bad for it: the levels grow with the logarithm of the edges (a chain
    loses half of its vertices per level), and since the greatest vertex of a component is never chosen, they end. A
    hub's neighbours are aggregated map-side; its label reaches them through :func:`skew.lookup`.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    level, maps = materialise(pairs, "connected"), []
    while level.count() > at_once:
        h = lambda c, seed=len(maps): F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("x"))
        both = level.unionByName(level.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(h("v")).alias("m"))
        chosen = materialise(near.select("u", F.least("m", h("u"))["x"].alias("p")), "connected-chosen")
        moved = materialise(lookup(level, "u", chosen).select("v", F.col("p").alias("pu")), "connected-moved")
        moved = lookup(moved, "v", chosen.select(F.col("u").alias("v"), "p")).where("pu <> p")
        after = materialise(moved.select(F.least("pu", "p").alias("u"), F.greatest("pu", "p").alias("v")).distinct(), "connected")
        release(level)
        level = after
        maps.append(chosen.select(F.col("u").alias("member"), F.col("p").alias("root")))
    labels = level.repartition(1).mapInArrow(_least_members, "member string, root string")
    if not maps:
        return labels
    for chosen in reversed(maps):
        labels = materialise(labels.select(F.col("member").alias("root"), F.col("root").alias("_top")), "connected-labels")
        labels = lookup(chosen, "root", labels).select("member", F.coalesce("_top", "root").alias("root"))
    labels = materialise(labels, "connected-labels")
    least = labels.groupBy("root").agg(F.min("member").alias("_least"))
    return lookup(labels, "root", least).select("member", F.col("_least").alias("root"))


def clusters_at(edges: DataFrame, members: DataFrame, measure: str, threshold: float) -> DataFrame:
    """(accession, root, size) at ``measure >= threshold``; every member comes out, alone if need be."""
    return clusters_at_all(edges, members, measure, [threshold]).drop("tag")


def clusters_at_all(edges: DataFrame, members: DataFrame, measure: str, thresholds: list[float]) -> DataFrame:
    """(tag, accession, root, size) at every threshold. A finer clustering lies inside the coarser ones, so all of them are one
    graph whose vertices are (tag, accession): one contraction serves all thresholds."""
    tags = [(t, f"ani{t:g}") for t in thresholds]
    holds = F.filter(F.array(*[F.when(F.col(measure) >= t, F.lit(tag)) for t, tag in tags]), lambda x: x.isNotNull())
    named = edges.select("a", "b", F.explode(holds).alias("tag"))
    both = connected(named.select(*[F.concat("tag", F.lit(SEPARATOR), c).alias(c) for c in "ab"]))
    part = lambda c, i: F.get(F.split(c, SEPARATOR, 2), F.lit(i))
    groups = both.select(part("member", 0).alias("tag"), part("member", 1).alias("accession"), part("root", 1).alias("root"))
    everyone = members.select("accession").where("accession is not null").distinct().withColumn("tag", F.explode(F.array(*[F.lit(tag) for _, tag in tags])))
    out = materialise(everyone.join(groups, ["tag", "accession"], "left").withColumn("root", F.coalesce("root", "accession")).withColumn("_k", F.concat("tag", F.lit(SEPARATOR), "root")), "clusters")
    sizes = out.groupBy("_k").agg(F.count("*").alias("size"))
    return lookup(out, "_k", sizes).select("tag", "accession", "root", "size")


def numbered(clusters: DataFrame) -> DataFrame:
    """(accession, cluster_id), with the tag if there is one: consecutive ids from 0 per tag, clusters of several first, then
    singletons, each in order of their root."""
    by = [c for c in ("tag",) if c in clusters.columns]
    clusters = clusters.withColumn("_k", F.concat_ws(SEPARATOR, *by, "root"))
    roots = clusters.where("accession = root").select(*by, "root", "_k", (F.col("size") == 1).cast("int").alias("single"))
    ids = number_rows(roots, [F.col(c) for c in (*by, "single", "root")], "_id", label="cluster-ids")
    if by:
        first = F.broadcast(ids.groupBy(*by).agg(F.min("_id").alias("_first")))  # one row per tag
        ids = ids.join(first, by).withColumn("_id", F.col("_id") - F.col("_first"))
    return lookup(clusters, "_k", ids.select("_k", F.col("_id").alias("cluster_id"))).select(*by, "accession", "cluster_id")


def refine(edges: DataFrame, members: DataFrame, measure: str, thresholds: list[float], done: list[float] = ()) -> DataFrame:
    """(tag, accession, cluster_id) for every threshold not done yet."""
    todo = sorted(set(thresholds) - set(done))
    if not todo:
        raise ValueError("no new threshold")
    return numbered(clusters_at_all(edges, members, measure, todo))


def new_singletons(edges: DataFrame, measure: str, threshold: float) -> DataFrame:
    """Accessions with edges, but none that survives the threshold."""
    ends = lambda e: e.select(F.col("a").alias("accession")).unionByName(e.select(F.col("b").alias("accession"))).distinct()
    return ends(edges).join(ends(edges.where(F.col(measure) >= threshold)), "accession", "left_anti")


def missing_members(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edge endpoints that are in no cluster; empty if the clustering is whole."""
    ends = edges.select(F.col("a").alias("accession")).unionByName(edges.select(F.col("b").alias("accession"))).distinct()
    return ends.join(clusters, "accession", "left_anti")


def size_stats(clusters: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, min_size, median_size, max_size) of cluster sizes with the shortcuts for singletons.

    With c the ascending sizes above 1 and S singletons: the median is 1 if S > len(c), else c[max((len(c) + S) div 2 - S, 0)].
    Sizes are aggregated to a histogram first, so the work depends on distinct sizes only.
    """
    sizes = clusters.groupBy(tag, "cluster_id").agg(F.count("*").alias("size")).groupBy(tag, "size").agg(F.count("*").alias("n"))
    head = sizes.groupBy(tag).agg(F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("size") > 1, F.col("n")).otherwise(0)).alias("k"), F.max("size").alias("max_size"), F.min("size").alias("low"))
    big = sizes.where("size > 1").withColumn("u", F.sum("n").over(Window.partitionBy(tag).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)))
    at = F.greatest(F.floor((F.col("k") + F.col("s")) / 2) - F.col("s"), F.lit(0))
    pick = big.join(head, tag).where((F.col("u") > at) & (F.col("u") - F.col("n") <= at)).select(tag, F.col("size").alias("mid"))
    return head.join(pick, tag, "left").select(
        tag, F.when(F.col("s") > 0, 1).otherwise(F.col("low")).cast("bigint").alias("min_size"),
        F.when(F.col("s") > F.col("k"), 1).otherwise(F.coalesce("mid", F.lit(1))).cast("bigint").alias("median_size"), F.col("max_size").cast("bigint"),
    )


def members(clusters: DataFrame, by: list[str], page: int = 10_000) -> DataFrame:
    """Sorted members per cluster as text, in pages of about ``page`` members, so that no list grows with its cluster."""
    sizes = clusters.groupBy(*by).agg(F.count("*").alias("n"))
    paged = clusters.join(sizes, by).withColumn("page", F.pmod(F.xxhash64("accession"), F.ceil(F.col("n") / page)).cast("int"))
    return paged.groupBy(*by, "n", "page").agg(F.array_join(F.array_sort(F.collect_list("accession")), ",").alias("members"))


def digests(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Order-independent digest per cluster: sum of member hashes and their number, so no member list is built."""
    return clusters.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5("accession"), 1, 12), 16, 10).cast("decimal(20,0)")).alias("digest"))


def changed(new: DataFrame, old: DataFrame, by: list[str]) -> DataFrame:
    """Clusters whose digest differs from the one indexed before, or that weren't indexed."""
    return new.join(old, [*by, "n", "digest"], "left_anti")


def pick_representatives(clusters: DataFrame, derep: DataFrame, seed: int) -> DataFrame:
    """One accession per (cluster_id, derep_id): the least by a seeded hash, ties by name."""
    w = Window.partitionBy("cluster_id", "derep_id").orderBy(F.md5(F.concat(F.col("accession"), F.lit(f":{seed}"))), "accession")
    joined = clusters.select("cluster_id", "accession").join(derep.select("accession", F.col("cluster_id").alias("derep_id")), "accession")
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tag_for_rank(rank_tags: DataFrame, cluster_tags: DataFrame) -> str:
    """The one tag that is in both; anything else raises."""
    both = [r[0] for r in rank_tags.select("tag").intersect(cluster_tags.select("tag")).limit(2).collect()]
    if len(both) != 1:
        raise ValueError(f"expected one common tag, found {both or 'none'}")
    return both[0]


def check_filter_tag(tag: str, indexed: str) -> None:
    """An ani tag must be at least as strict as the indexed one; a rank accepts any ani tag."""
    if tag.startswith("ani") and indexed.startswith("ani") and float(tag[3:]) < float(indexed[3:]):
        raise ValueError(f"{tag} is coarser than the indexed {indexed}")


def edges_of(pairs: DataFrame, a: Column, b: Column, measure: Column) -> DataFrame:
    """(a, b, m) with the greatest measurement of each unordered pair; null and NaN are none."""
    rows = pairs.select(a.alias("x"), b.alias("y"), measure.alias("m")).where("m is not null and not isnan(m) and x is not null and y is not null")
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("m").alias("m"))
