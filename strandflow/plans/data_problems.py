"""Queries of the data problems that belong to the core: orphans (p3), hot keys (p4), nested records (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions.session import table
from strandflow.operators import eager, nested, orphans

HEAVY_PERCENT = 2


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    assembly = table(spark, d, "assembly")
    refs = orphans.catalogue_references(assembly, table(spark, d, "bakta"))
    return refs, orphans.catalogue_states(assembly, table(spark, d, "asm_batches"), table(spark, d, "ann_batches"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(*_references(spark, d))


def p3_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, d))


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assembly").select(F.lit("assembly").alias("table_name"), F.col("sylph_species").alias("key_value")).unionByName(
        table(spark, d, "genome_manifest").select(F.lit("genome_manifest").alias("table_name"), F.col("taxonomy").alias("key_value"))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.heavy_values(keyed_rows(spark, d), HEAVY_PERCENT)


def p4_species_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per species the assembly rows, the annotation rows joined to them by sample, and the archive sizes of those."""
    out = eager.join_counts(
        table(spark, d, "assembly").withColumnRenamed("sample_accession", "sample"),
        table(spark, d, "bakta"),
        "sample",
        ["sylph_species"],
        right_sums={"tar_xz_size_mb": "tar_xz_size_mb"},
    )
    return out.select(
        "sylph_species",
        F.col("n_left").alias("n_assembly"),
        F.col("n_joined").alias("n_annotation"),
        F.col("sum_tar_xz_size_mb").cast("double").alias("sum_size_mb"),
        F.col("cnt_tar_xz_size_mb").alias("n_size"),
    )


def p4_taxonomy_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per typed taxonomy the records, the pairwise rows that query them, and the hashes those share."""
    out = eager.join_counts(
        table(spark, d, "genome_manifest"),
        table(spark, d, "pairwise").withColumn("accession", F.regexp_extract("query_name", r"(\S+)", 1)),
        "accession",
        ["taxonomy"],
        right_sums={"intersect_hashes": "intersect_hashes"},
    )
    return out.select(
        "taxonomy",
        F.col("n_left").alias("n_records"),
        F.col("n_joined").alias("n_pairs"),
        F.col("sum_intersect_hashes").cast("bigint").alias("sum_hashes"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.report_elements(table(spark, d, "bakta_json"))


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.label_nodes(table(spark, d, "bakta_json"), "report_id", "payload")


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """Features as a flat table: position, sequence and own values; repeated rows of a report count once."""
    nodes = nested.label_nodes(table(spark, d, "bakta_json"), "report_id", "payload")
    flat = nested.flat_table(nodes, "features", ["type", "start", "stop", "strand", "locus", "product"])
    return flat.select(
        F.col("record_id").alias("report_id"), F.col("position").alias("feature_no"), F.col("linked_position").alias("sequence_no"), "type",
        F.col("start").try_cast("bigint").alias("start"), F.col("stop").try_cast("bigint").alias("stop"), "strand", "locus", "product",
    ).distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_orphan_counts, p4_found, p4_species_summary, p4_taxonomy_summary, p5_found, p5_features, p5_nodes)}

_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _base(c: str) -> str:
    return _strip(f"regexp_replace({_strip(c)}, '^.*[/\\\\]', '')")


_ORPHANS = f"""
WITH refs AS (
  SELECT 'assembly' AS ref_table, 'osf_tarball_filename' AS ref_field, {_base("osf_tarball_filename")} AS k, sample_accession AS record_key, listed_at AS t
  FROM assembly WHERE length({_strip("osf_tarball_filename")}) > 0
  UNION ALL SELECT 'bakta', 'tar_xz', {_base("tar_xz")}, file_name, listed_at FROM bakta WHERE length({_strip("tar_xz")}) > 0
  UNION ALL SELECT 'bakta', 'sample', {_strip("sample")}, file_name, listed_at FROM bakta WHERE length({_strip("sample")}) > 0
), targets AS (
  SELECT 'osf_tarball_filename' AS ref_field, {_base("asm_tar_xz")} AS k, published_at AS s, removed_at AS e FROM asm_batches
  UNION ALL SELECT 'tar_xz', {_base("ann_tar_xz")}, published_at, removed_at FROM ann_batches
  UNION ALL SELECT 'sample', {_strip("sample_accession")}, min(listed_at), NULL FROM assembly GROUP BY ALL
), once AS (SELECT ref_table, ref_field, k, record_key, t, count(*) AS n FROM refs GROUP BY ALL
), checked AS (
  SELECT o.ref_table, o.ref_field, o.k, o.record_key, o.t, any_value(o.n) AS n, count(x.k) AS n_targets,
    coalesce(bool_or(x.s <= o.t AND (x.e IS NULL OR x.e > o.t)), false) AS live, coalesce(bool_or(x.e <= o.t), false) AS gone
  FROM once o LEFT JOIN targets x ON o.ref_field = x.ref_field AND o.k = x.k
  GROUP BY o.ref_table, o.ref_field, o.k, o.record_key, o.t
), orphans AS (
  SELECT ref_table, ref_field, k, record_key, strftime(t, '%Y-%m') AS period, n,
    CASE WHEN n_targets = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS kind
  FROM checked WHERE NOT live
)
"""

def _list(x: str) -> str:
    """A JSON value as a list: null and absent empty, a lone value as one."""
    x = f"({x})"
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN from_json({x}, '[\"JSON\"]') ELSE [{x}] END"


def _items(name: str, source: str, keys: str, x: str) -> str:
    """Elements of a list with their positions; null elements left out."""
    return f"""{name}_ AS (SELECT {keys}, {_list(x)} AS l FROM {source}),
{name}__ AS (SELECT * EXCLUDE (l), unnest(l) AS e, unnest(range(len(l))) AS n FROM {name}_), {name} AS (SELECT * FROM {name}__ WHERE e IS NOT NULL AND json_type(e) <> 'NULL')"""


_UNWRAP = """CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) END
  WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j -> 0 ELSE j END"""
_REPORTS = ", ".join(f"v{i + 1} AS (SELECT report_id, {_UNWRAP} AS j FROM v{i})" for i in range(5))
_REPORT_SQL = f"""
WITH v0 AS (SELECT report_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM bakta_json),
{_REPORTS}, r AS (SELECT report_id, j FROM v5 WHERE json_type(j) = 'OBJECT'),
{_items("s", "r", "report_id", "j -> 'sequences'")},
ids AS (SELECT report_id, e ->> 'id' AS id, min(n) AS n FROM s WHERE json_type(e) = 'OBJECT' GROUP BY 1, 2),
{_items("f0", "r", "report_id", "j -> 'features'")},
f AS (SELECT f0.report_id, f0.e, f0.n AS fn, coalesce(ids.n, -1) AS sn FROM f0 LEFT JOIN ids ON ids.report_id = f0.report_id AND ids.id = coalesce(f0.e ->> 'sequence', f0.e ->> 'contig')),
{_items("x", "f", "report_id, fn, sn", "e -> 'db_xrefs'")}"""
_ELEMENTS = f"""{_REPORT_SQL},
{_items("p", "f", "report_id, fn, sn", "e -> 'pfams'")},
{_items("y", "(SELECT report_id, fn, sn, n AS pn, e FROM p)", "report_id, fn, sn, pn", "e -> 'db_xrefs'")}
SELECT DISTINCT report_id, child, CAST(a AS INT) AS sequence_no, CAST(b AS INT) AS feature_no, CAST(c AS INT) AS item_no, CAST(d AS INT) AS sub_no FROM (
  SELECT report_id, 'sequences' AS child, n AS a, -1 AS b, -1 AS c, -1 AS d FROM s
  UNION ALL SELECT report_id, 'features', sn, fn, -1, -1 FROM f UNION ALL SELECT report_id, 'db_xrefs', sn, fn, n, -1 FROM x
  UNION ALL SELECT report_id, 'pfams', sn, fn, n, -1 FROM p UNION ALL SELECT report_id, 'pfam_db_xrefs', sn, fn, pn, n FROM y)"""

SQL = {
    "p5_found": _ELEMENTS,
    "p5_features": _REPORT_SQL
    + """ SELECT DISTINCT report_id, CAST(fn AS INT) AS feature_no, CAST(sn AS INT) AS sequence_no, e ->> 'type' AS type, TRY_CAST(e ->> 'start' AS BIGINT) AS start,
  TRY_CAST(e ->> 'stop' AS BIGINT) AS stop, e ->> 'strand' AS strand, e ->> 'locus' AS locus, e ->> 'product' AS product FROM f""",
    "p3_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_field, record_key, period, kind FROM orphans",
    "p3_orphan_counts": _ORPHANS
    + "SELECT ref_table, ref_field, period, kind, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT k) AS n_keys FROM orphans GROUP BY ALL",
    "p4_found": """
WITH r AS (SELECT 'assembly' AS table_name, sylph_species AS key_value FROM assembly UNION ALL SELECT 'genome_manifest', taxonomy FROM genome_manifest),
t AS (SELECT table_name, count(*) AS total FROM r GROUP BY 1)
SELECT table_name, key_value FROM r JOIN t USING (table_name) WHERE key_value IS NOT NULL GROUP BY table_name, key_value, total HAVING count(*) * 100 >= 2 * total""",
    "p4_species_summary": """
WITH j AS (
  SELECT a.sylph_species, b.sample, CAST(b.tar_xz_size_mb AS DECIMAL(24,6)) AS mb FROM assembly a JOIN bakta b ON a.sample_accession = b.sample
), s AS (SELECT sylph_species, count(*) AS n_annotation, CAST(sum(mb) AS DOUBLE) AS sum_size_mb, count(mb) AS n_size FROM j GROUP BY 1
), l AS (SELECT sylph_species, count(*) AS n_assembly FROM assembly GROUP BY 1)
SELECT l.sylph_species, n_assembly, coalesce(n_annotation, 0) AS n_annotation, sum_size_mb, CASE WHEN n_annotation > 0 THEN n_size END AS n_size
FROM l LEFT JOIN s ON l.sylph_species IS NOT DISTINCT FROM s.sylph_species""",
    "p4_taxonomy_summary": r"""
WITH p AS (SELECT regexp_extract(query_name, '(\S+)', 1) AS accession, intersect_hashes FROM pairwise
), j AS (SELECT g.taxonomy, count(*) AS n_pairs, CAST(sum(intersect_hashes) AS BIGINT) AS sum_hashes FROM genome_manifest g JOIN p USING (accession) GROUP BY 1
), l AS (SELECT taxonomy, count(*) AS n_records FROM genome_manifest GROUP BY 1)
SELECT l.taxonomy, n_records, coalesce(n_pairs, 0) AS n_pairs, sum_hashes FROM l LEFT JOIN j ON l.taxonomy IS NOT DISTINCT FROM j.taxonomy""",
}
