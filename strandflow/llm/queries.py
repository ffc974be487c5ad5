"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions.session import table
from strandflow.llm import canonical, components, overlap, packing, subjects, tokens

MIN_SHARE = 0.1
#: Words of typed taxonomies that aren't part of a name.
TAXON_MARKERS = canonical.Markers(
    leaf_rank="species",
    open_names=frozenset("sp spp species".split()),
    below=frozenset("strain isolate subsp subspecies str substr var variety serovar serotype biovar pathovar pv bv clone culture ssp atx type".split()),
    around=frozenset("candidatus ca uncultured unclassified unidentified cf aff nov gen comb complex group genomosp the of bacterium".split()),
)
MIN_ANI = 0.95


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "sketch_hash"), overlap.sketch_sets(table(spark, d, "metagenome_sketch")), MIN_SHARE)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_overlaps(spark, d).select("sketch_path_a", "sketch_path_b").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "genome_manifest"), table(spark, d, "taxa"), "taxonomy", ["accession"], markers=TAXON_MARKERS)


def p2_unmatched_values(spark: SparkSession, d: str) -> DataFrame:
    """The typed values that mean no entry, with the accessions that carry each."""
    typed = table(spark, d, "genome_manifest").withColumn("typed", F.col("taxonomy"))
    mapped = canonical.map_values(typed, table(spark, d, "taxa"), "taxonomy", ["accession", "typed"], markers=TAXON_MARKERS)
    return mapped.where(F.col("taxid") == canonical.UNMATCHED).groupBy("typed").agg(F.count("*").alias("n_accessions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.pair_groups(table(spark, d, "pairwise"), "query_name", "match_name", "average_containment_ani", MIN_ANI)


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """As p6_found, with partitions of at most 500 edges, so that small tables too are merged over several levels."""
    return components.pair_groups(table(spark, d, "pairwise"), "query_name", "match_name", "average_containment_ani", MIN_ANI, 500)


def p6_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size; size 1 are the singletons."""
    sizes = p6_found(spark, d).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_groups"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents"), "doc_id", "text", "source"), "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their room and what is unused of it."""
    held = p8_pack(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    total = held.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return total.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * packing.CAPACITY))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source per window, beside the source's share of the window."""
    return packing.mixture(p8_pack(spark, d))


def p8_targets(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a packing at equal shares of all sources, unlike the corpus: per kind of window how many there are, their
    tokens, and the mean and the greatest distance of a source from its share in windows of at least half their containers."""
    sizes = packing.sized(table(spark, d, "documents"), "doc_id", "text", "source")
    names = [r[0] for r in sizes.where("source is not null and n_tokens > 0").select("source").distinct().collect()]  # a target is given per source
    out = packing.mixture(packing.pack(sizes, "doc_id", targets=dict.fromkeys(names, 1.0)))
    whole = F.sum("n_tokens").over(Window.partitionBy("bucket", "window_no"))
    off = F.when(F.col("at_target") & (F.col("w") >= packing.CAPACITY * packing.CONTAINERS_PER_WINDOW / 2), F.abs(F.col("share") - 1 / max(len(names), 1)))
    return out.withColumn("w", whole).groupBy("at_target").agg(
        F.countDistinct("bucket", "window_no").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"), F.avg(off).alias("mean_off"), F.max(off).alias("worst_off")
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject; a document of two subjects counts for both."""
    return p9_found(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_overlaps, p2_found, p2_unmatched_values, p6_found, p6_hierarchy, p6_cluster_sizes, p7_ids, p8_pack, p8_fill, p8_mixture, p8_targets, p9_found, p9_composition)}

_P1 = """
WITH s AS (SELECT DISTINCT sketch_path, ksize, seed, scaled FROM metagenome_sketch WHERE ksize IS NOT NULL AND scaled IS NOT NULL AND seed IS NOT NULL),
h AS (SELECT DISTINCT s.*, h.hash_value FROM sketch_hash h JOIN s USING (sketch_path) WHERE hash_value::HUGEINT * scaled < 18446744073709551616),
levels AS (SELECT DISTINCT scaled AS cut FROM s),
sizes AS (SELECT sketch_path, ksize, seed, h.scaled, cut, count(*) FILTER (hash_value::HUGEINT * cut < 18446744073709551616) AS n FROM h, levels WHERE cut >= h.scaled GROUP BY ALL),
pairs AS (
  SELECT a.sketch_path AS pa, b.sketch_path AS pb, a.ksize, a.seed, a.scaled AS sa, b.scaled AS sb, greatest(a.scaled, b.scaled) AS cut, count(*) AS n_shared
  FROM h a JOIN h b ON a.hash_value = b.hash_value AND a.ksize = b.ksize AND a.seed = b.seed AND a.sketch_path < b.sketch_path
  GROUP BY ALL)
SELECT DISTINCT pa AS sketch_path_a, pb AS sketch_path_b{more}
FROM pairs t JOIN sizes x ON x.sketch_path = pa AND x.ksize = t.ksize AND x.seed = t.seed AND x.scaled = sa AND x.cut = t.cut
JOIN sizes y ON y.sketch_path = pb AND y.ksize = t.ksize AND y.seed = t.seed AND y.scaled = sb AND y.cut = t.cut
WHERE n_shared * 10 >= least(x.n, y.n)
"""

_P6 = r"""
WITH RECURSIVE p AS (
  SELECT regexp_extract(query_name, '(\S+)', 1) AS a, regexp_extract(match_name, '(\S+)', 1) AS b,
    CASE WHEN isnan(average_containment_ani) THEN NULL WHEN average_containment_ani > 1 THEN average_containment_ani / 100 ELSE average_containment_ani END AS m
  FROM pairwise),
e AS (SELECT a, b FROM p WHERE m >= 0.95 AND a <> b UNION SELECT b, a FROM p WHERE m >= 0.95 AND a <> b),
v AS (SELECT a AS accession FROM p UNION SELECT b FROM p),
reach AS (SELECT accession, accession AS other FROM v UNION SELECT r.accession, e.b FROM reach r JOIN e ON r.other = e.a),
g AS (SELECT accession, min(other) AS group_id FROM reach GROUP BY 1)
"""

SQL = {
    "p6_found": _P6 + "SELECT accession, group_id FROM g",
    "p6_hierarchy": _P6 + "SELECT accession, group_id FROM g",
    "p6_cluster_sizes": _P6 + "SELECT size, count(*) AS n_groups FROM (SELECT group_id, count(*) AS size FROM g GROUP BY 1) GROUP BY 1",
    "p1_found": _P1.format(more=""),
    "p1_overlaps": _P1.format(more=", t.ksize, t.seed, t.cut AS scaled, n_shared, x.n AS n_a, y.n AS n_b"),
}
