"""Catalogue, manifest, taxonomy, sketch, cluster, annotation and metric queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions import names
from strandflow.functions.session import table
from strandflow.operators import annotations as A
from strandflow.operators import catalog, cluster, manifest, metrics, nested, sketch, taxonomy
from strandflow.operators.order import locate
from strandflow.plans.sequence_queries import _S, sequences
from strandflow.sources import manifests

K_SKETCH, SCALED = 11, 4
THRESHOLDS = (0.95, 0.97, 0.99)
RANK = "genus"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("assembly", "asm_batches", "bakta", "ann_batches")}


# --- catalogue -----------------------------------------------------------------------------------------------------

DEFAULT = catalog.Options(high_quality=True, has_assembly=True, has_annotation=True)


def catalog_count(spark, d):
    return catalog.count(_tables(spark, d), catalog.Options(high_quality=True, has_assembly=True))


def catalog_count_annotated(spark, d):
    return catalog.count(_tables(spark, d), DEFAULT)


def catalog_count_by(spark, d):
    return catalog.count_by_species(_tables(spark, d), catalog.Options(has_assembly=True))


def catalog_top_species(spark, d):
    return catalog.count_by_species(_tables(spark, d), catalog.Options(), 20)


def catalog_head(spark, d):
    q = catalog.select_assemblies(_tables(spark, d), catalog.Options(high_quality=True))
    return q.order_by(F.asc("listed_at"), F.asc("sample_accession"), F.asc("osf_tarball_filename"), F.asc("loaded_at")).limit(50).build("sample_accession", "sylph_species", "listed_at")


def catalog_plan(spark, d):
    plan = catalog.download_plan(_tables(spark, d), DEFAULT)
    return plan.select("sample_accession", "sylph_species", "osf_tarball_filename", "asm_tar_xz_md5", "file_name", "tar_xz", "ann_tar_xz_md5").distinct()


def catalog_plan_batches(spark, d):
    plan = catalog.download_plan(_tables(spark, d), catalog.Options(has_assembly=True))
    return catalog.batches(plan, "osf_tarball_filename", "sample_accession")


def catalog_paths(spark, d):
    from strandflow.sources.sinks import with_file_paths

    rows = table(spark, d, "assembly").where("osf_tarball_filename is not null").select("sample_accession", "osf_tarball_filename").distinct()
    return with_file_paths(rows, "osf_tarball_filename", "sample_accession", "/data")


def star_join(spark, d):
    """Revenue per region, nation and segment: a four-way star join, the small sides by size."""
    o, li, c = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    revenue = (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(28,4)")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.sum(revenue).cast("double").alias("revenue"))


def batch_group(spark, d):
    return catalog.batches(table(spark, d, "bakta").where("tar_xz is not null"), "tar_xz", "file_name")


# --- manifests -----------------------------------------------------------------------------------------------------


def manifest_last_rows(spark, d):
    """The last entry of every accession."""
    rows = table(spark, d, "genome_manifest").select("accession", F.col("entered_at"), F.coalesce("taxid", F.lit("")).alias("taxid"), F.coalesce("taxonomy", F.lit("")).alias("taxonomy"))
    return manifests.last_rows(rows, ["accession"], F.struct("entered_at", "taxid", "taxonomy"))


def manifest_paths(spark, d):
    rows = table(spark, d, "genome_manifest").select(F.explode(F.array("fasta", "gff")).alias("path")).where("path is not null").distinct()
    return rows.select("path", names.file_type(F.col("path")).alias("file_type"), names.sequence_name(F.col("path")).alias("name"), names.safe_file_name(F.col("path")).alias("safe"))


def manifest_reserve(spark, d):
    """Actions for all annotated samples against a manifest of the assemblies' states."""
    state = F.when(F.max("hq_filter") == "FAIL", "failed").when(F.max("asm_fasta_on_osf") == "0", "reserved").otherwise("complete")
    stored = table(spark, d, "assembly").groupBy(F.col("sample_accession").alias("accession")).agg(state.alias("state"))
    asked = table(spark, d, "bakta").where("sample is not null").select(F.col("sample").alias("accession"), F.lit("0").alias("taxid")).distinct()
    return manifest.plan(stored, asked)


def manifest_counts(spark, d):
    return manifest.counts(table(spark, d, "bakta").select(F.col("file_name").alias("accession"), F.col("status").alias("state")).distinct())


def manifest_transitions(spark, d):
    """Annotations reserved by one package, then completed or failed by their status."""
    rows = table(spark, d, "bakta").where("file_name is not null").groupBy(F.col("file_name").alias("accession")).agg(F.max("status").alias("status"))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    empty = spark.createDataFrame([], manifest.SCHEMA)
    m, _ = manifest.reserve(empty, rows.select("accession", F.lit("1").alias("taxid")), "p", at)
    m = manifest.mark_complete(m, rows.where("status = 'PASS'"), "p", at)
    m = manifest.mark_failed(m, rows.where("status = 'FAIL'"), "p", "annotation failed")
    return m.groupBy("state", "error").agg(F.count("*").alias("n"), F.count("completed_at").alias("n_completed"))


def pending_anti(spark, d):
    """Assemblies without an annotation."""
    wanted = table(spark, d, "assembly").select(F.col("sample_accession").alias("sample")).distinct()
    return catalog.pending(wanted, table(spark, d, "bakta"), "sample")


def accession_subset(spark, d):
    wanted = table(spark, d, "genome_manifest").where("taxonomy like '% sp.'").select("accession")
    rows = table(spark, d, "genome_manifest").select("accession", "fasta").distinct()
    return catalog.subset(rows, wanted)


def sample_rows(spark, d):
    return metrics.sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), 100, 7)


def cache_prune(spark, d):
    files = table(spark, d, "asm_batches").groupBy(F.col("asm_tar_xz").alias("file")).agg(F.max(F.col("asm_tar_xz_size_mb") * 10).cast("bigint").alias("size"), F.max("published_at").alias("modified"))
    return metrics.to_prune(files.where("size is not null"), 200_000).select("file", "size")


def upsert_taxonomy(spark, d):
    g = table(spark, d, "genome_manifest").where("taxid is not null and accession is not null")
    stored = g.groupBy("accession").agg(F.min("taxid").alias("taxid"))
    new = g.where("gff is not null").groupBy("accession").agg(F.max("taxid").alias("taxid"))
    return A.upsert(stored, new, "accession")


def insert_missing(spark, d):
    a = table(spark, d, "bakta").select(F.col("sample").alias("k")).distinct()
    b = table(spark, d, "assembly").select(F.col("sample_accession").alias("k"))
    return A.add_missing(a, b, ["k"])


# --- taxonomy ------------------------------------------------------------------------------------------------------


def lineage_ancestor(spark, d):
    return taxonomy.ancestors_at(table(spark, d, "taxa"), RANK)


def lineage_paths(spark, d):
    return taxonomy.lineage_text(table(spark, d, "taxa"))


def taxon_resolve(spark, d):
    values = table(spark, d, "genome_manifest").select("taxonomy").where("taxonomy is not null").distinct()
    return taxonomy.resolve(values, table(spark, d, "taxa"), "taxonomy")


def taxon_groups(spark, d):
    """Records with a resolved taxid, clustered by genus."""
    g = table(spark, d, "genome_manifest").join(table(spark, d, "taxa").select(F.col("tax_name").alias("taxonomy"), F.col("taxid").alias("t")), "taxonomy")
    rows = g.select("accession", F.col("t").alias("taxid")).distinct()
    return taxonomy.group_by_rank(rows, table(spark, d, "taxa"), RANK).groupBy("cluster_id").agg(F.count("*").alias("n"))


def taxon_candidates(spark, d):
    values = table(spark, d, "genome_manifest").select("taxonomy").where("taxonomy is not null").distinct()
    return values.select("taxonomy", F.array_join(names.taxon_candidates(F.col("taxonomy")), "|").alias("candidates"))


# --- names and nested values ---------------------------------------------------------------------------------------


def read_ids(spark, d):
    return table(spark, d, "pairwise").select("query_name").distinct().select("query_name", names.read_id(F.ltrim("query_name")).alias("read_id"))


def fastq_names(spark, d):
    o = F.col("o_orderkey")
    name = F.concat(F.lit("S"), F.col("o_custkey"), F.when(o % 3 == 0, F.concat(F.lit("_L00"), o % 8 + 1)).otherwise(""), F.lit("_R"), o % 2 + 1, F.when(o % 5 == 0, "_001").otherwise(""), F.when(o % 7 == 0, ".fq").otherwise(".fastq.gz"))
    p = names.fastq_parts(F.col("name"))
    return table(spark, d, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", p["sample"].alias("sample"), p["lane"].alias("lane"), p["orientation"].alias("orientation"), p["fragment"].alias("fragment"), p["suffix"].alias("suffix"))


def dbxref_parse(spark, d):
    refs = F.concat(F.lit("RefQ:"), F.col("l_partkey"), F.lit(",UniX:a:"), F.col("l_suppkey"), F.lit(",none"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(names.dbxrefs(refs)).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.database", "x.label")


def gff_attributes(spark, d):
    o = F.col("o_orderkey")
    attrs = F.concat(F.lit("Name=n;"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit(" ID = gene:"), o, F.lit(" ;"))), F.lit("ID=later"))
    rows = table(spark, d, "orders").select("o_orderkey", names.attribute(attrs, "ID").alias("id"), names.strict_int(F.substring("o_orderpriority", 1, 1)).alias("level"), names.strict_int(F.col("o_orderpriority")).alias("none"))
    return rows.withColumn("seed", names.seed_name(F.lit("chr"), F.col("id")))


def json_props(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", "event_type", F.size(F.json_object_keys("props")).alias("n_keys"), (v.isNotNull()).alias("readable"))


def set_digests(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("k"))  # orders of one customer
    return rows.select("o_custkey", names.set_digest(F.col("k"), ",").alias("digest"), names.sharded_path(F.col("o_custkey").cast("string")).alias("path"))


# --- sketches ------------------------------------------------------------------------------------------------------


def _sketches(spark, d):
    s = sequences(spark, d).select(F.concat("source", F.lit("/"), F.coalesce("lang", F.lit("none"))).alias("name"), "source", "seq")
    return s, sketch.sketch(s, K_SKETCH, SCALED)


def sketch_frac(spark, d):
    return _sketches(spark, d)[1]


def sketch_sizes(spark, d):
    return sketch_frac(spark, d).groupBy("name").agg(F.count("*").alias("n"))


def sketch_downsample(spark, d):
    return sketch.downsample(sketch_frac(spark, d), SCALED, 4 * SCALED)


def pairwise_containment(spark, d):
    out = sketch.pairwise(sketch_frac(spark, d), K_SKETCH)
    return out.select("query_name", "match_name", "intersect_hashes", *[F.round(c, 6).alias(c) for c in ("query_containment", "match_containment", "average_containment_ani")])


def pairwise_within(spark, d):
    named = sketch_frac(spark, d).withColumn("cluster_id", F.substring_index("name", "/", 1))
    return sketch.pairwise(named, K_SKETCH, "cluster_id").select("cluster_id", "query_name", "match_name", "intersect_hashes")


def _metagenomes(spark, d):
    m = table(spark, d, "metagenome_sketch").where("ksize = 31 and seed = 42 and scaled <= 1000").select("sketch_path", "scaled").distinct()
    limit = (F.lit(2**64 / 1000)).cast("bigint")
    return table(spark, d, "sketch_hash").join(F.broadcast(m) if m.count() <= 500_000 else m, "sketch_path").where(F.col("hash_value") < limit).select(F.col("sketch_path").alias("name"), F.col("hash_value").alias("hash")).distinct()


def screen_top(spark, d):
    """Coarse sketches screened against all of ksize 31 at scaled 1000, from 5 kbp of shared sequence."""
    m = _metagenomes(spark, d)
    hits = sketch.screen(m, m, 1000, 5_000).where("query_name <> match_name")
    return hits.select("query_name", "match_name", "intersect_hashes", F.round("match_containment", 6).alias("match_containment"))


def screen_results(spark, d):
    m = _metagenomes(spark, d)
    hits = sketch.screen(m, m, 1000, 5_000).where("query_name <> match_name")
    out = sketch.split_results(hits, m.select(F.col("name").alias("accession")).distinct())
    return out.select("accession", "n_hits")


# --- clusters ------------------------------------------------------------------------------------------------------


def _edges(spark, d):
    p = table(spark, d, "pairwise")
    word = lambda c: F.regexp_extract(c, r"(\S+)", 1)
    m = F.col("average_containment_ani")
    edges = cluster.edges_of(p, word("query_name"), word("match_name"), F.when(m > 1, m / 100).otherwise(m))
    people = p.select(word("query_name").alias("accession")).unionByName(p.select(word("match_name").alias("accession"))).distinct()
    return edges, people


def ani_clusters(spark, d):
    edges, people = _edges(spark, d)
    return cluster.numbered(cluster.clusters_at(edges, people, "m", 0.97))


def ani_refine(spark, d):
    edges, people = _edges(spark, d)
    return cluster.refine(edges, people, "m", list(THRESHOLDS))


def ani_cluster_stats(spark, d):
    return cluster.size_stats(ani_refine(spark, d))


def ani_new_singletons(spark, d):
    return cluster.new_singletons(_edges(spark, d)[0], "m", 0.99)


def ani_digests(spark, d):
    c = cluster.digests(ani_clusters(spark, d), ["cluster_id"])
    return c.select("cluster_id", "n", F.col("digest").cast("string").alias("digest"))


def derep_pick(spark, d):
    edges, people = _edges(spark, d)
    wide = cluster.numbered(cluster.clusters_at(edges, people, "m", 0.95))
    fine = cluster.numbered(cluster.clusters_at(edges, people, "m", 0.99))
    return cluster.pick_representatives(wide, fine, 42)


# --- annotations ---------------------------------------------------------------------------------------------------

K_GFF = 5


def _features(spark, d):
    docs = table(spark, d, "documents").where("text is not null and source is not null")
    one = F.struct((F.col("n_chars") % 40).cast("bigint").alias("begin"), (F.col("n_chars") % 40 + 20).cast("bigint").alias("end"), F.lit("+").alias("strand"), F.lit(1).cast("bigint").alias("colour"))
    two = F.struct((F.col("doc_id") % 50).cast("bigint").alias("begin"), (F.col("doc_id") % 50 + 12).cast("bigint").alias("end"), F.lit("-").alias("strand"), F.lit(2).cast("bigint").alias("colour"))
    return docs.select(F.col("doc_id").cast("string").alias("seqid"), F.explode(F.array(one, two)).alias("f")).select("seqid", "f.*")


def _tokens(spark, d):
    contigs = sequences(spark, d).select(F.col("doc_id").cast("string").alias("seqid"), "seq")
    frags = A.fragments_of(contigs, K_GFF)
    return frags, A.clip(frags, A.flip(_features(spark, d), contigs.select("seqid", F.length("seq").alias("length"))), K_GFF + 1)


def fragment_clip(spark, d):
    return _tokens(spark, d)[1].select("seqid", "strand", "frag_no", "colour", F.col("begin").cast("bigint").alias("begin"), F.col("end").cast("bigint").alias("end"))


def interval_colours(spark, d):
    frags, tokens = _tokens(spark, d)
    return A.coloured_edges(frags, tokens, K_GFF).select("seqid", "strand", "p", "node", "sym", "colour")


def interval_overlap(spark, d):
    """Live periods of assembly archives that overlap those of annotation archives of the same size class."""
    cols = lambda t, c, b, e: t.where(f"{c} is not null").select(F.floor(F.col(c) / 50).alias("size_class"), F.unix_date(F.to_date("published_at")).alias(b), F.unix_date(F.to_date(F.coalesce("removed_at", F.col("published_at") + F.expr("INTERVAL 30 DAYS")))).alias(e))
    a = cols(table(spark, d, "asm_batches"), "asm_tar_xz_size_mb", "begin", "end")
    b = cols(table(spark, d, "ann_batches"), "ann_tar_xz_size_mb", "r_begin", "r_end")
    return A.overlap_join(a, b, ["size_class"], 30).groupBy("size_class").agg(F.count("*").alias("n"))


def _index(spark, d):
    b = table(spark, d, "bakta").where("file_name is not null and sample is not null")
    records = b.select(F.col("sample").alias("accession"), F.col("file_name").alias("seed_name"), F.concat(F.lit("status:"), F.coalesce("status", F.lit("none")), F.lit(",archive:"), F.coalesce("tar_xz", F.lit("none"))).alias("dbxref"))
    return A.build_index(records)


def annotation_index(spark, d):
    return _index(spark, d)["annotation"]


def annotation_databases(spark, d):
    return A.databases(_index(spark, d)["annotation"])


def annotations_nested(spark, d):
    asked = table(spark, d, "bakta").select(F.col("file_name").alias("seed_name")).unionByName(table(spark, d, "assembly").select(F.col("sample_accession").alias("seed_name")))
    out = A.annotations_of(asked.where("seed_name is not null"), _index(spark, d)["annotation"])
    entries = F.transform(F.array_sort(F.map_entries("annotations")), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "|")))
    return out.select("seed_name", F.array_join(entries, ";").alias("annotations"))


def seed_info_left(spark, d):
    asked = table(spark, d, "bakta").select(F.col("file_name").alias("seed_name")).distinct()
    tax = table(spark, d, "assembly").groupBy(F.col("sample_accession").alias("accession")).agg(F.max("sylph_species").alias("taxid"))
    return A.seed_info(asked, _index(spark, d)["seed"], tax)


def report_features(spark, d):
    return manifests.report_features(table(spark, d, "bakta_json"), nested.REPORT_TYPES, nested.REPORT_LINKS)


# --- metrics -------------------------------------------------------------------------------------------------------


def metric_aggregate(spark, d):
    e = table(spark, d, "events")
    runs = e.select("event_type", "event_id", F.col("value").cast("decimal(18,4)").alias("elapsed_seconds"), (F.col("user_id") % 100).alias("cpu_percent"), F.col("user_id").alias("max_rss_kb"), (F.col("event_id") % 3).alias("exit_code"), (F.col("event_id") % 5 + 1).alias("samples"))
    out = metrics.aggregate(runs, ["event_type"], "event_id", ("elapsed_seconds",))
    return out.select("event_type", F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"), F.round("cpu_percent", 6).alias("cpu_percent"), "max_rss_kb", "exit_code", "samples")


def count_by_tuple(spark, d):
    return table(spark, d, "lineitem").groupBy(F.array("l_returnflag", "l_linestatus").alias("t")).agg(F.count("*").alias("n")).select(F.array_join("t", ",").alias("t"), "n")


def cache_size(spark, d):
    return metrics.total_size(table(spark, d, "documents").select(F.col("size_bytes").alias("size")))


def chunk_lookup(spark, d):
    """Orders placed in id ranges of uneven sizes: one range per supplier that has a positive balance."""
    s = F.col("s_suppkey")
    chunks = table(spark, d, "supplier").where("s_acctbal > 0").select(s.alias("chunk_no"), (s * 100).alias("start"), (s % 90).alias("count"))
    return locate(table(spark, d, "orders").select("o_orderkey"), chunks, "o_orderkey")


_FUNCTIONS = (
    chunk_lookup, catalog_count, catalog_count_annotated, catalog_count_by, catalog_top_species, catalog_head, catalog_plan, catalog_plan_batches, catalog_paths, star_join,
    batch_group, manifest_last_rows, manifest_paths, manifest_reserve, manifest_counts, manifest_transitions, pending_anti, accession_subset, sample_rows, cache_prune,
    upsert_taxonomy, insert_missing, lineage_ancestor, lineage_paths, taxon_resolve, taxon_groups, taxon_candidates, read_ids, fastq_names, dbxref_parse,
    gff_attributes, json_props, set_digests, sketch_frac, sketch_sizes, sketch_downsample, pairwise_containment, pairwise_within, screen_top, screen_results,
    ani_clusters, ani_refine, ani_cluster_stats, ani_new_singletons, ani_digests, derep_pick, fragment_clip, interval_colours, interval_overlap,
    annotation_index, annotation_databases, annotations_nested, seed_info_left, report_features, metric_aggregate, count_by_tuple, cache_size,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_EXT = r"\.(fna|fa|fasta|gff3|gff|fq|fastq)$"
_GOOD = "hq_filter = 'PASS' AND asm_fasta_on_osf = '1'"
_FASTQ = r"^(.+?)(?:[_.-](L\d\d\d))?[_.-](R?[12])?(?:[_.-](\d\d\d))?(\.(?:f(?:ast)?q)(?:\.gz)?)$"
_UP = """WITH RECURSIVE up AS (
  SELECT taxid, taxid AS ancestor, tax_rank AS ancestor_rank, parent_taxid AS p, 0 AS steps FROM taxa
  UNION ALL SELECT u.taxid, t.taxid, t.tax_rank, t.parent_taxid, u.steps + 1 FROM up u JOIN taxa t ON u.p = t.taxid WHERE u.p <> u.ancestor)"""
_CAND = r"""WITH v AS (SELECT DISTINCT taxonomy FROM genome_manifest WHERE taxonomy IS NOT NULL),
w AS (SELECT taxonomy, trim(taxonomy, ' ') AS t, string_split(trim(regexp_replace(taxonomy, '\s+', ' ', 'g'), ' '), ' ') AS parts FROM v),
c AS (SELECT taxonomy, list_concat([t], CASE WHEN len(parts) > 1 THEN ['s__' || parts[1] || ' ' || parts[2]]
  ELSE ['g__' || parts[1], 'f__' || parts[1], 'o__' || parts[1], 'c__' || parts[1], 'p__' || parts[1], 'd__' || parts[1]] END) AS l FROM w)"""
_SK = rf"""{_S}, k0 AS (SELECT source || '/' || coalesce(lang, 'none') AS name, seq, unnest(range(1, 64 - {K_SKETCH} + 2)) AS i FROM s),
k1 AS (SELECT name, substr(seq, i, {K_SKETCH}) AS m FROM k0),
sk AS (SELECT DISTINCT name, substr(md5(least(m, reverse(translate(m, 'ACGT', 'TGCA')))), 1, 16) AS hash FROM k1),
sketches AS (SELECT * FROM sk WHERE hash < '{sketch.max_hash(SCALED)}')"""
_PAIR = f"""WITH {_SK}, z AS (SELECT name, count(*) AS n FROM sketches GROUP BY 1),
sh AS (SELECT a.name AS query_name, b.name AS match_name, count(*) AS intersect_hashes FROM sketches a JOIN sketches b ON a.hash = b.hash AND a.name < b.name GROUP BY 1, 2)"""
_MG = """WITH m AS (SELECT DISTINCT sketch_path FROM metagenome_sketch WHERE ksize = 31 AND seed = 42 AND scaled <= 1000),
h AS (SELECT DISTINCT sketch_path AS name, hash_value AS hash FROM sketch_hash JOIN m USING (sketch_path) WHERE hash_value < 18446744073709551),
z AS (SELECT name, count(*) AS n FROM h GROUP BY 1),
hits AS (SELECT a.name AS query_name, b.name AS match_name, count(*) AS intersect_hashes FROM h a JOIN h b ON a.hash = b.hash AND a.name <> b.name GROUP BY 1, 2 HAVING count(*) * 1000 >= 5000)"""


def _clusters(*thresholds: float) -> str:
    """Components at several thresholds with their ids: clusters of several first, then singletons."""
    values = ", ".join(f"({t}, 'ani{t:g}')" for t in thresholds)
    return rf"""WITH RECURSIVE p AS (
  SELECT regexp_extract(query_name, '(\S+)', 1) AS a, regexp_extract(match_name, '(\S+)', 1) AS b,
    CASE WHEN isnan(average_containment_ani) THEN NULL WHEN average_containment_ani > 1 THEN average_containment_ani / 100 ELSE average_containment_ani END AS m FROM pairwise),
th(t, tag) AS (VALUES {values}),
e AS (SELECT DISTINCT tag, a, b FROM p, th WHERE m >= t AND a <> b UNION SELECT DISTINCT tag, b, a FROM p, th WHERE m >= t AND a <> b),
v AS (SELECT tag, accession FROM th, (SELECT a AS accession FROM p UNION SELECT b FROM p)),
reach AS (SELECT tag, accession, accession AS other FROM v UNION SELECT r.tag, r.accession, e.b FROM reach r JOIN e ON r.tag = e.tag AND r.other = e.a),
g AS (SELECT tag, accession, min(other) AS root FROM reach GROUP BY 1, 2),
gs AS (SELECT *, count(*) OVER (PARTITION BY tag, root) AS size FROM g),
cl AS (SELECT tag, accession, dense_rank() OVER (PARTITION BY tag ORDER BY CAST(size = 1 AS INT), root) - 1 AS cluster_id, size FROM gs)"""


_FEAT = f"""WITH {_S}, fs AS (
  SELECT doc_id, n_chars % 40 AS fb, n_chars % 40 + 20 AS fe, '+' AS strand, 1 AS colour FROM documents WHERE text IS NOT NULL AND source IS NOT NULL
  UNION ALL SELECT doc_id, doc_id % 50, doc_id % 50 + 12, '-', 2 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
fl AS (SELECT doc_id, strand, colour, CASE WHEN strand = '-' THEN greatest(0, 64 - fe) ELSE fb END AS b, CASE WHEN strand = '-' THEN greatest(0, 64 - fb) ELSE least(fe, 64) END AS e FROM fs),
tok AS (SELECT * FROM fl WHERE e - b >= {K_GFF + 1})"""
_IDX = """WITH b AS (SELECT sample, file_name, 'status:' || coalesce(status, 'none') || ',archive:' || coalesce(tar_xz, 'none') AS refs FROM bakta WHERE file_name IS NOT NULL AND sample IS NOT NULL),
x AS (SELECT file_name AS seed_name, unnest(string_split(refs, ',')) AS r FROM b),
ann AS (SELECT DISTINCT seed_name, split_part(r, ':', 1) AS database, trim(substr(r, instr(r, ':') + 1)) AS label FROM x WHERE instr(r, ':') > 1)"""

SQL = {
    "chunk_lookup": """SELECT o_orderkey, coalesce(s_suppkey, -1) AS chunk_no FROM orders LEFT JOIN supplier ON s_acctbal > 0 AND o_orderkey >= s_suppkey * 100 AND o_orderkey < s_suppkey * 100 + s_suppkey % 90""",
    "catalog_count": f"SELECT count(*) AS n FROM assembly WHERE {_GOOD}",
    "catalog_count_annotated": f"SELECT count(*) AS n FROM assembly a JOIN bakta b ON a.sample_accession = b.sample WHERE {_GOOD} AND status = 'PASS'",
    "catalog_count_by": "SELECT sylph_species, count(*) AS n FROM assembly WHERE asm_fasta_on_osf = '1' GROUP BY 1",
    "catalog_top_species": "SELECT sylph_species, count(*) AS n FROM assembly GROUP BY 1 ORDER BY n DESC, sylph_species NULLS FIRST LIMIT 20",
    "catalog_head": """SELECT sample_accession, sylph_species, listed_at FROM assembly WHERE hq_filter = 'PASS'
ORDER BY listed_at, sample_accession, osf_tarball_filename NULLS FIRST, loaded_at LIMIT 50""",
    "catalog_plan": f"""SELECT DISTINCT sample_accession, sylph_species, osf_tarball_filename, asm_tar_xz_md5, file_name, tar_xz, ann_tar_xz_md5
FROM assembly a JOIN bakta b ON a.sample_accession = b.sample JOIN asm_batches x ON a.osf_tarball_filename = x.asm_tar_xz JOIN ann_batches y ON b.tar_xz = y.ann_tar_xz
WHERE {_GOOD} AND status = 'PASS'""",
    "catalog_plan_batches": """SELECT osf_tarball_filename, count(*) AS n, min(sample_accession) AS first FROM assembly a JOIN asm_batches x ON a.osf_tarball_filename = x.asm_tar_xz
WHERE asm_fasta_on_osf = '1' GROUP BY 1""",
    "catalog_paths": r"""SELECT DISTINCT sample_accession, osf_tarball_filename, '/data/' || regexp_replace(osf_tarball_filename, '\.tar\.xz$', '') || '/' || sample_accession || '.fa.gz' AS fa,
  '/data/' || regexp_replace(osf_tarball_filename, '\.tar\.xz$', '') || '/' || sample_accession || '.gff3.gz' AS gff FROM assembly WHERE osf_tarball_filename IS NOT NULL""",
    "star_join": """SELECT r_name, n_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(28,4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
    "batch_group": "SELECT tar_xz, count(*) AS n, min(file_name) AS first FROM bakta WHERE tar_xz IS NOT NULL GROUP BY 1",
    "manifest_last_rows": """SELECT accession, entered_at, taxid, taxonomy FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY entered_at DESC, taxid DESC, taxonomy DESC) AS r FROM (
  SELECT accession, entered_at, coalesce(taxid, '') AS taxid, coalesce(taxonomy, '') AS taxonomy FROM genome_manifest WHERE accession IS NOT NULL)) WHERE r = 1""",
    "manifest_paths": rf"""WITH p AS (SELECT fasta AS path FROM genome_manifest UNION SELECT gff FROM genome_manifest), n AS (
  SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(\.tar)?\.gz$', '') AS base FROM p WHERE path IS NOT NULL), x AS (SELECT *, regexp_extract(lower(base), '\.([^.]+)$', 1) AS ext FROM n)
SELECT path, CASE WHEN ext IN ('fna', 'fa', 'fasta') THEN 'FASTA' WHEN ext IN ('gff3', 'gff') THEN 'GFF' WHEN ext IN ('fq', 'fastq') THEN 'FASTQ' END AS file_type,
  regexp_replace(base, '{_EXT}', '') AS name, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM x""",
    "manifest_reserve": """WITH st AS (SELECT sample_accession AS accession, CASE WHEN max(hq_filter) = 'FAIL' THEN 'failed' WHEN max(asm_fasta_on_osf) = '0' THEN 'reserved' ELSE 'complete' END AS state FROM assembly GROUP BY 1)
SELECT DISTINCT b.sample AS accession, '0' AS taxid, CASE WHEN state IS NULL THEN 'new' WHEN state = 'failed' THEN 'clean' WHEN state IN ('reserved', 'cleaning') THEN 'occupied' ELSE 'complete' END AS action
FROM bakta b LEFT JOIN st ON b.sample = st.accession WHERE b.sample IS NOT NULL""",
    "manifest_counts": "SELECT status AS state, count(*) AS n FROM (SELECT DISTINCT file_name, status FROM bakta) GROUP BY 1",
    "manifest_transitions": """WITH r AS (SELECT file_name, max(status) AS s FROM bakta WHERE file_name IS NOT NULL GROUP BY 1)
SELECT CASE s WHEN 'PASS' THEN 'complete' WHEN 'FAIL' THEN 'failed' ELSE 'reserved' END AS state, CASE s WHEN 'FAIL' THEN 'annotation failed' END AS error, count(*) AS n,
  count(CASE s WHEN 'PASS' THEN 1 END) AS n_completed FROM r GROUP BY 1, 2""",
    "pending_anti": "SELECT DISTINCT sample_accession AS sample FROM assembly WHERE sample_accession NOT IN (SELECT sample FROM bakta WHERE sample IS NOT NULL)",
    "accession_subset": "SELECT DISTINCT accession, fasta FROM genome_manifest WHERE accession IN (SELECT accession FROM genome_manifest WHERE taxonomy LIKE '% sp.')",
    "sample_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey LIMIT 100",
    "cache_prune": """WITH f AS (SELECT asm_tar_xz AS file, CAST(trunc(max(asm_tar_xz_size_mb * 10)) AS BIGINT) AS size, max(published_at) AS modified FROM asm_batches GROUP BY 1)
SELECT file, size FROM (SELECT *, sum(size) OVER (ORDER BY modified DESC, file DESC) AS kept FROM f WHERE size IS NOT NULL) WHERE kept > 200000""",
    "upsert_taxonomy": """WITH g AS (SELECT * FROM genome_manifest WHERE taxid IS NOT NULL AND accession IS NOT NULL), o AS (SELECT accession, min(taxid) AS taxid FROM g GROUP BY 1),
n AS (SELECT accession, max(taxid) AS taxid FROM g WHERE gff IS NOT NULL GROUP BY 1) SELECT accession, coalesce(n.taxid, o.taxid) AS taxid FROM o FULL JOIN n USING (accession)""",
    "insert_missing": "SELECT sample AS k FROM bakta UNION SELECT sample_accession FROM assembly",
    "lineage_ancestor": f"{_UP} SELECT taxid, ancestor FROM up WHERE ancestor_rank = '{RANK}'",
    "lineage_paths": f"{_UP} SELECT up.taxid, string_agg(t.tax_name, ';' ORDER BY steps DESC) AS lineage FROM up JOIN taxa t ON t.taxid = up.ancestor GROUP BY 1",
    "taxon_resolve": rf"""{_CAND}, o AS (SELECT taxonomy, list_concat([trim(taxonomy, ' ')], l, list_transform(l, lambda x: regexp_replace(x, '^[a-z]__', ''))) AS opts FROM c),
n AS (SELECT tax_name AS name, taxid FROM taxa UNION ALL SELECT taxid, taxid FROM taxa),
t AS (SELECT taxonomy, i, opts[i] AS name FROM (SELECT taxonomy, opts, unnest(range(1, len(opts) + 1)) AS i FROM o)),
f AS (SELECT taxonomy, arg_min(taxid, i) AS taxid FROM t JOIN n USING (name) GROUP BY 1) SELECT v.taxonomy, taxid FROM v LEFT JOIN f USING (taxonomy)""",
    "taxon_groups": f"""{_UP}, r AS (SELECT DISTINCT accession, t.taxid FROM genome_manifest g JOIN taxa t ON g.taxonomy = t.tax_name), a AS (SELECT taxid, ancestor FROM up WHERE ancestor_rank = '{RANK}')
SELECT coalesce(ancestor, r.taxid) AS cluster_id, count(*) AS n FROM r LEFT JOIN a USING (taxid) GROUP BY 1""",
    "taxon_candidates": f"{_CAND} SELECT taxonomy, array_to_string(l, '|') AS candidates FROM c",
    "read_ids": r"""WITH q AS (SELECT DISTINCT query_name, regexp_replace(ltrim(query_name), '[ \t].*$', '') AS w FROM pairwise)
SELECT query_name, CASE WHEN length(w) > 2 THEN regexp_replace(w, '[/.][12]$', '') ELSE w END AS read_id FROM q""",
    "fastq_names": f"""WITH n AS (SELECT o_orderkey, 'S' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '_L00' || (o_orderkey % 8 + 1) ELSE '' END || '_R' || (o_orderkey % 2 + 1) ||
  CASE WHEN o_orderkey % 5 = 0 THEN '_001' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '.fq' ELSE '.fastq.gz' END AS name FROM orders)
SELECT o_orderkey, regexp_extract(name, '{_FASTQ}', 1) AS sample, nullif(regexp_extract(name, '{_FASTQ}', 2), '') AS lane, CAST(right(regexp_extract(name, '{_FASTQ}', 3), 1) AS INT) AS orientation,
  nullif(regexp_extract(name, '{_FASTQ}', 4), '') AS fragment, regexp_extract(name, '{_FASTQ}', 5) AS suffix FROM n""",
    "dbxref_parse": """SELECT l_orderkey, l_linenumber, 'RefQ' AS database, CAST(l_partkey AS VARCHAR) AS label FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'UniX', 'a:' || l_suppkey FROM lineitem""",
    "gff_attributes": """WITH i AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'later' ELSE 'gene:' || o_orderkey END AS id FROM orders)
SELECT o_orderkey, id, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, CAST(NULL AS BIGINT) AS none, 'chr-' || id AS seed FROM i""",
    "json_props": "SELECT event_id, event_type, CAST(len(json_keys(props)) AS INT) AS n_keys, json_valid(props) AS readable FROM events",
    "set_digests": """WITH g AS (SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest, sha256(CAST(o_custkey AS VARCHAR)) AS p FROM orders GROUP BY 1)
SELECT o_custkey, digest, substr(p, 1, 2) || '/' || substr(p, 3, 2) || '/' || p AS path FROM g""",
    "sketch_frac": f"WITH {_SK} SELECT name, hash FROM sketches",
    "sketch_sizes": f"WITH {_SK} SELECT name, count(*) AS n FROM sketches GROUP BY 1",
    "sketch_downsample": f"WITH {_SK} SELECT name, hash FROM sketches WHERE hash < '{sketch.max_hash(4 * SCALED)}'",
    "pairwise_containment": f"""{_PAIR} SELECT query_name, match_name, intersect_hashes, round(intersect_hashes / a.n, 6) AS query_containment, round(intersect_hashes / b.n, 6) AS match_containment,
  round((pow(intersect_hashes / a.n, 1.0 / {K_SKETCH}) + pow(intersect_hashes / b.n, 1.0 / {K_SKETCH})) / 2, 6) AS average_containment_ani FROM sh JOIN z a ON a.name = query_name JOIN z b ON b.name = match_name""",
    "pairwise_within": f"{_PAIR} SELECT split_part(query_name, '/', 1) AS cluster_id, query_name, match_name, intersect_hashes FROM sh WHERE split_part(query_name, '/', 1) = split_part(match_name, '/', 1)",
    "screen_top": f"{_MG} SELECT query_name, match_name, intersect_hashes, round(intersect_hashes / n, 6) AS match_containment FROM hits JOIN z ON name = match_name",
    "screen_results": f"{_MG} SELECT name AS accession, CAST(count(match_name) AS INT) AS n_hits FROM z LEFT JOIN hits ON match_name = name GROUP BY 1",
    "ani_clusters": f"{_clusters(0.97)} SELECT accession, cluster_id FROM cl",
    "ani_refine": f"{_clusters(*THRESHOLDS)} SELECT tag, accession, cluster_id FROM cl",
    "ani_cluster_stats": f"""{_clusters(*THRESHOLDS)}, sz AS (SELECT tag, cluster_id, any_value(size) AS size FROM cl GROUP BY 1, 2),
q AS (SELECT tag, list_sort(list(size) FILTER (size > 1)) AS c, count(*) FILTER (size = 1) AS s FROM sz GROUP BY 1)
SELECT tag, CASE WHEN s > 0 THEN 1 ELSE c[1] END AS min_size, CASE WHEN s > len(c) THEN 1 ELSE c[greatest((len(c) + s) // 2 - s, 0) + 1] END AS median_size, coalesce(c[-1], 1) AS max_size FROM q""",
    "ani_new_singletons": f"""{_clusters(0.99)}, ok AS (SELECT * FROM p WHERE m IS NOT NULL), ends AS (SELECT a AS accession FROM ok UNION SELECT b FROM ok), kept AS (SELECT a FROM ok WHERE m >= 0.99 UNION SELECT b FROM ok WHERE m >= 0.99)
SELECT accession FROM ends WHERE accession NOT IN (SELECT a FROM kept)""",
    "ani_digests": f"{_clusters(0.97)} SELECT cluster_id, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(accession), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM cl GROUP BY 1",
    "derep_pick": f"""{_clusters(0.95, 0.99)}, j AS (SELECT a.cluster_id, a.accession, b.cluster_id AS derep_id FROM cl a JOIN cl b ON a.accession = b.accession AND a.tag = 'ani0.95' AND b.tag = 'ani0.99')
SELECT accession, cluster_id, derep_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, derep_id ORDER BY md5(accession || ':42'), accession) AS r FROM j) WHERE r = 1""",
    "fragment_clip": f'{_FEAT} SELECT CAST(doc_id AS VARCHAR) AS seqid, strand, 0 AS frag_no, colour, b AS "begin", e AS "end" FROM tok',
    "interval_colours": f"""{_FEAT}, st AS (SELECT doc_id, '+' AS strand, seq FROM s UNION ALL SELECT doc_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM s),
ps AS (SELECT *, unnest(range(0, 65)) AS p FROM st)
SELECT CAST(ps.doc_id AS VARCHAR) AS seqid, ps.strand, p, substr('{"$" * K_GFF}' || seq || '$', p + 1, {K_GFF}) AS node, substr('{"$" * K_GFF}' || seq || '$', p + {K_GFF} + 1, 1) AS sym, coalesce(tok.colour, 0) AS colour
FROM ps LEFT JOIN tok ON tok.doc_id = ps.doc_id AND tok.strand = ps.strand AND tok.b <= p - {K_GFF} AND p < tok.e""",
    "interval_overlap": """WITH a AS (SELECT CAST(floor(asm_tar_xz_size_mb / 50) AS BIGINT) AS size_class, published_at::DATE AS b, coalesce(removed_at, published_at + INTERVAL 30 DAY)::DATE AS e FROM asm_batches WHERE asm_tar_xz_size_mb IS NOT NULL),
x AS (SELECT CAST(floor(ann_tar_xz_size_mb / 50) AS BIGINT) AS size_class, published_at::DATE AS b, coalesce(removed_at, published_at + INTERVAL 30 DAY)::DATE AS e FROM ann_batches WHERE ann_tar_xz_size_mb IS NOT NULL)
SELECT size_class, count(*) AS n FROM a JOIN x USING (size_class) WHERE a.e > a.b AND x.e > x.b AND x.b < a.e AND x.e > a.b GROUP BY 1""",
    "annotation_index": f"{_IDX} SELECT seed_name, database, label FROM ann",
    "annotation_databases": f"{_IDX} SELECT DISTINCT database FROM ann",
    "annotations_nested": f"""{_IDX}, asked AS (SELECT file_name AS seed_name FROM bakta WHERE file_name IS NOT NULL UNION SELECT sample_accession FROM assembly WHERE sample_accession IS NOT NULL),
per AS (SELECT seed_name, database || '=' || string_agg(label, '|' ORDER BY label) AS t FROM ann GROUP BY seed_name, database),
n AS (SELECT seed_name, string_agg(t, ';' ORDER BY t) AS annotations FROM per GROUP BY 1) SELECT seed_name, coalesce(annotations, '') AS annotations FROM asked LEFT JOIN n USING (seed_name)""",
    "seed_info_left": """WITH asked AS (SELECT DISTINCT file_name AS seed_name FROM bakta), sd AS (SELECT DISTINCT file_name AS seed_name, sample AS accession FROM bakta WHERE file_name IS NOT NULL AND sample IS NOT NULL),
tx AS (SELECT sample_accession AS accession, max(sylph_species) AS taxid FROM assembly GROUP BY 1) SELECT seed_name, accession, taxid FROM asked LEFT JOIN sd USING (seed_name) LEFT JOIN tx USING (accession)""",
    "metric_aggregate": """SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS elapsed_seconds, round(sum((user_id % 100) * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS cpu_percent,
  max(user_id) AS max_rss_kb, arg_max(event_id % 3, event_id) AS exit_code, CAST(sum(event_id % 5 + 1) AS BIGINT) AS samples FROM events GROUP BY 1""",
    "count_by_tuple": "SELECT l_returnflag || ',' || l_linestatus AS t, count(*) AS n FROM lineitem GROUP BY 1",
    "cache_size": "SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM documents",
}
