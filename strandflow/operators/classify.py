"""Labelling of a sample's edges by a reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Every query edge with the reference's edge id, -1 where it has none; both tables (node, sym, eid)."""
    ref = reference.select("node", "sym", F.col("eid").alias("ref_eid"))
    return query.join(ref, ["node", "sym"], "left").withColumn("ref_eid", F.coalesce("ref_eid", F.lit(-1)).cast("bigint"))


def accumulate(query: DataFrame, reference: DataFrame) -> DataFrame:
    """(node, sym, colour, depth): the reference's colours of every matched query edge, with the query's count."""
    ref = reference.select("node", "sym", "colours")
    return query.join(ref, ["node", "sym"]).select("node", "sym", F.explode("colours").alias("colour"), F.col("n").alias("depth"))


def colour_depths(accumulated: DataFrame) -> DataFrame:
    """Per colour the matched edges and their summed depth."""
    return accumulated.groupBy("colour").agg(F.count("*").alias("n_edges"), F.sum("depth").alias("depth"))


def classify_clusters(query: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Accumulated colours against several references, each row naming its cluster."""
    parts = [accumulate(query, r).withColumn("cluster_id", F.lit(c)) for c, r in sorted(references.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
