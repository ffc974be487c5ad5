"""Taxonomy: name resolution, lineages, ancestors at a rank. A tree is (taxid, parent_taxid, tax_rank, tax_name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import names
from strandflow.functions.session import broadcast_if_small, materialise

BROADCAST_TAXA = 1_000_000


def resolve(values: DataFrame, taxa: DataFrame, value: str) -> DataFrame:
    """``values`` with ``taxid``: the value itself if it is an id, else the first candidate name that is known; null if none.

    ``taxa`` names may carry rank prefixes; plain names match as well.
    """
    options = F.concat(F.array(F.trim(value)), names.taxon_candidates(F.col(value)), F.transform(names.taxon_candidates(F.col(value)), lambda x: F.regexp_replace(x, "^[a-z]__", "")))
    asked = values.select(value).where(F.col(value).isNotNull()).distinct()
    listed = taxa.select(F.col("tax_name").alias("_name"), "taxid").unionByName(taxa.select(F.col("taxid").alias("_name"), "taxid"))
    tried = asked.select(value, F.posexplode(options).alias("_i", "_name")).join(broadcast_if_small(listed, BROADCAST_TAXA), "_name")
    found = tried.groupBy(value).agg(F.min_by("taxid", "_i").alias("taxid"))
    return values.join(found, value, "left")


def require_all(resolved: DataFrame, value: str) -> DataFrame:
    """``resolved``, or an error that lists up to five values without taxid."""
    lacking = [r[0] for r in resolved.where("taxid is null").select(value).distinct().limit(5).collect()]
    if lacking:
        raise ValueError(f"no taxid for: {', '.join(map(str, lacking))}")
    return resolved


def lineages(taxa: DataFrame) -> DataFrame:
    """(taxid, steps, ancestor, ancestor_rank) of every entry, itself at step 0, whatever the tree's depth.

    Jumps of 1, 2, 4, ... steps: each round joins the ancestors found so far with the jump of their own length, so a tree of
    depth d takes log2(d) rounds. A root is its own parent or has none or an unknown one; a cycle raises.
    """
    nodes = taxa.select("taxid", "parent_taxid", "tax_rank")
    known = nodes.select(F.col("taxid").alias("ancestor"))
    up = nodes.where("parent_taxid is not null and parent_taxid <> taxid").select("taxid", F.col("parent_taxid").alias("ancestor")).join(known, "ancestor", "left_semi")
    jump, n = materialise(up.select("taxid", "ancestor"), "lineage-jumps"), nodes.count()
    found, length = nodes.select("taxid", F.lit(0).alias("steps"), F.col("taxid").alias("ancestor")), 1
    while not jump.isEmpty():
        if length > n:
            raise ValueError("taxonomy: an entry is its own ancestor")
        via = jump.select(F.col("taxid").alias("ancestor"), F.col("ancestor").alias("_next"))
        small = broadcast_if_small(via, BROADCAST_TAXA)
        further = found.join(small, "ancestor").select("taxid", (F.col("steps") + length).alias("steps"), F.col("_next").alias("ancestor"))
        found = materialise(found.unionByName(further), "lineages")
        jump = materialise(jump.join(small, "ancestor").select("taxid", F.col("_next").alias("ancestor")), "lineage-jumps")
        length *= 2
    ranks = nodes.select(F.col("taxid").alias("ancestor"), F.col("tax_rank").alias("ancestor_rank"))
    return found.join(broadcast_if_small(ranks, BROADCAST_TAXA), "ancestor").select("taxid", "steps", "ancestor", "ancestor_rank")


def ancestors_at(taxa: DataFrame, rank: str) -> DataFrame:
    """(taxid, ancestor) at ``rank``; entries above it have none."""
    if rank not in names.RANKS:
        raise ValueError(f"unknown rank {rank}")
    return lineages(taxa).where(F.col("ancestor_rank") == rank).groupBy("taxid").agg(F.min_by("ancestor", "steps").alias("ancestor"))


def lineage_text(taxa: DataFrame) -> DataFrame:
    """(taxid, lineage): names from the root down."""
    named = lineages(taxa).join(taxa.select(F.col("taxid").alias("ancestor"), "tax_name"), "ancestor")
    rows = named.groupBy("taxid").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("o"), "tax_name"))).alias("l"))  # at most the tree's depth
    return rows.select("taxid", F.array_join(F.transform("l", lambda x: x["tax_name"]), ";").alias("lineage"))


def group_by_rank(accessions: DataFrame, taxa: DataFrame, rank: str) -> DataFrame:
    """(accession, cluster_id): clusters by the ancestor at ``rank``; accessions without one are left to their own taxid."""
    up = ancestors_at(taxa, rank)
    return accessions.join(up, "taxid", "left").select("accession", F.coalesce("ancestor", "taxid").alias("cluster_id"))
