"""Queries over files: the given tables are written as FASTA, GFF, FASTQ, manifests, catalogues and results, and read back.

A registered query writes its files below the session's shared folder; they are removed when the driver's JVM ends.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow import workflows as W
from strandflow.functions import dna, names
from strandflow.functions.session import shared_dir, table
from strandflow.operators import annotations as A
from strandflow.operators import catalog, classify, cluster, graph, kmers, manifest, sketch
from strandflow.plans import catalogue_queries as CQ
from strandflow.plans.sequence_queries import _S, _edge_rows, _edge_table, sequences
from strandflow.sources import fasta, fastq, gff, lines, manifests, sinks

K, K_GFF, K_SKETCH, SCALED = 21, 5, 11, 4
#: Contigs of one written GFF file, and files of one written sample.
PER_FILE, PARTS = 100, 2


def _folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _contigs(spark, d) -> DataFrame:
    """Contigs with N in them."""
    return sequences(spark, d).select("doc_id", "source", "lang", F.concat(F.lit("d"), "doc_id").alias("seq_id"), F.replace("seq", F.lit("ACG"), F.lit("N")).alias("seq"))


# --- FASTA and GFF -------------------------------------------------------------------------------------------------


def _fasta(spark, d) -> str:
    path = _folder(spark)
    sinks.fasta_lines(_contigs(spark, d), "seq_id", "seq", 20).write.option("compression", "gzip").text(path)
    return path


def fasta_scan(spark, d):
    return fasta.read_fasta(spark, _fasta(spark, d)).select("seq_id", "seq")


def fasta_contigs(spark, d):
    return fasta.coloured_contigs(fasta.read_fasta(spark, _fasta(spark, d)), 5)[0].select("seq_id", "strand_no", "seq", "colour")


def _gff(spark, d) -> str:
    path = _folder(spark)
    f = CQ._features(spark, d).withColumn("line", F.concat_ws("\t", "seqid", F.lit("S"), F.lit("CDS"), F.col("begin") + 1, "end", F.lit("."), "strand", F.lit("0"), F.concat(F.lit("Note=x; ID=f"), "colour")))
    per = f.groupBy("seqid").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))  # two features
    c = sequences(spark, d).select(F.col("doc_id").cast("string").alias("seqid"), "doc_id", "seq").join(per, "seqid")
    whole = F.concat_ws("\t", "seqid", F.lit(gff.ANNOTATOR), F.lit("region"), F.lit("1"), F.length("seq"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "seqid"))
    text = lambda x: F.array_join(F.array_sort(F.collect_list(x)), "\n")  # noqa: E731  at most PER_FILE contigs
    files = c.groupBy(F.floor(F.col("doc_id") / PER_FILE).alias("part")).agg(text(F.concat_ws("\n", whole, "lines")).alias("a"), text(F.concat(F.lit(">"), "seqid", F.lit("\n"), "seq")).alias("b"))
    out = files.select("part", F.concat(F.lit("##gff-version 3\n"), "a", F.lit("\n##FASTA\n"), "b").alias("value"))
    out.repartition("part").write.partitionBy("part").text(path)
    return path + "/*/*"


def gff_features(spark, d):
    feats, _ = gff.read_gff(spark, _gff(spark, d))
    return gff.normalise(feats).select("seqid", "begin", "end", "strand", "seed")


def gff_contigs(spark, d):
    return gff.read_gff(spark, _gff(spark, d))[1].select("seq_id", "seq")


def gff_base(spark, d):
    """Whole-contig features of genomes without annotations stay through the normaliser."""
    base = gff.whole_contig_features(fasta.read_fasta(spark, _fasta(spark, d)))
    return gff.normalise(base).select("seqid", "begin", "end", "strand", "seed")


def gff_genomes(spark, d):
    """Every second genome has its sequence in the GFF file, all have one in FASTA."""
    c = _contigs(spark, d)
    records = c.select(F.col("seq_id").alias("accession"), F.concat("seq_id", F.lit(".gff")).alias("gff"), F.concat("seq_id", F.lit(".fna")).alias("fasta"))
    inside = c.where("doc_id % 2 = 0").select(F.concat("seq_id", F.lit(".gff")).alias("file"), "seq_id", "seq")
    outside = c.select(F.concat("seq_id", F.lit(".fna")).alias("file"), "seq_id", F.reverse("seq").alias("seq"))
    return gff.genomes(records, inside, outside)


# --- FASTQ ---------------------------------------------------------------------------------------------------------


def _reads(spark, d, mates: int = 0) -> str:
    """One file per part, reads in order of doc_id; with ``mates`` the forward (1) or reverse (2) mates, 3: both interleaved."""
    path = _folder(spark)
    c = _contigs(spark, d).withColumn("part", F.col("doc_id") % PARTS)
    mate = lambda i: F.struct(F.concat("seq_id", F.lit(f"/{i} x")).alias("id"), (F.col("seq") if i == 1 else dna.reverse_complement(F.col("seq"))).alias("s"), F.lit(i).alias("i"))
    rows = c.select("part", "doc_id", F.explode(F.array(*[mate(i) for i in {0: (1,), 1: (1,), 2: (2,), 3: (1, 2)}[mates]])).alias("m")).select("part", "doc_id", "m.*")
    ordered = rows.repartition(PARTS, "part").sortWithinPartitions("part", "doc_id", "i")
    sinks.fastq_lines(ordered, "id", "s", ["part"]).write.partitionBy("part").text(path)
    return path


def _read_rows(r: DataFrame) -> DataFrame:
    return r.select("read_id", F.array_join("fragments.seq", ",").alias("fragments"), F.array_join("fragments.qual", ",").alias("quals"), "n_records", "discarded")


def fastq_reads(spark, d):
    return _read_rows(fastq.unpaired(spark, _reads(spark, d) + "/*"))


def _by_part(spark, one, *paths) -> DataFrame:
    out = None
    for p in range(PARTS):
        part = one(spark, *[f"{x}/part={p}" for x in paths])
        out = part if out is None else out.unionByName(part)
    return out


def fastq_paired(spark, d):
    return _read_rows(_by_part(spark, fastq.paired, _reads(spark, d, 1), _reads(spark, d, 2)))


def fastq_interleaved(spark, d):
    return _read_rows(_by_part(spark, fastq.interleaved, _reads(spark, d, 3)))


def fastq_metadata(spark, d):
    return fastq.metadata(fastq.unpaired(spark, _reads(spark, d) + "/*"))


def fastq_groups(spark, d):
    o = F.col("o_orderkey")
    name = lambda i: F.concat(F.lit("/x/S"), o, F.when(o % 2 == 0, F.concat(F.lit("_L00"), o % 9)).otherwise(""), F.lit(f"_R{i}"), F.when(o % 3 == 0, "_001").otherwise(""), F.lit(".fastq.gz"))
    return fastq.group_files(table(spark, d, "orders").select(F.explode(F.array(name(1), name(2))).alias("file")))


# --- manifests and catalogues --------------------------------------------------------------------------------------


def _lines(df: DataFrame, value: Column, head: list[str]) -> str:
    """One text file of a small table: the given lines, then a line per row in order."""
    spark, path = df.sparkSession, _folder(df.sparkSession)
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "o long, value string")
    rows = df.select(F.monotonically_increasing_id().alias("o"), value.alias("value"))
    first.unionByName(rows).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
    return path


def _batches(spark, d) -> DataFrame:
    return table(spark, d, "asm_batches").where("asm_tar_xz is not null").select("asm_tar_xz", F.coalesce("asm_tar_xz_md5", F.lit("")).alias("md5")).distinct().orderBy("asm_tar_xz", "md5")


def manifest_files(spark, d):
    """Second field of the lines of a manifest, with its type."""
    g = table(spark, d, "genome_manifest").where("fasta is not null").select("fasta").distinct()
    path = _folder(spark)
    g.select(F.concat_ws(";", F.lit("x"), F.concat(F.lit(" "), "fasta", F.lit("\t")), F.lit("y"))).write.text(path)
    return manifests.file_paths(spark, path, 1, ";").select("value", "file_type")


def genome_manifest_csv(spark, d):
    """The last row of each accession of a CSV manifest with other column names."""
    g = table(spark, d, "genome_manifest").where("accession is not null").select(
        F.col("accession").alias("acc"), F.lower(F.regexp_replace(F.coalesce("taxonomy", F.lit("")), "[^A-Za-z]", "")).alias("tax"), F.coalesce("taxid", F.lit("")).alias("tid"), F.coalesce("entered_at", F.to_timestamp_ntz(F.lit("1900-01-01"))).alias("at")
    )
    path = _folder(spark)
    g.repartition("acc").sortWithinPartitions("acc", "at", "tid", "tax").select("acc", "tax", "tid").write.option("header", "true").csv(path)
    return manifests.genome_manifest(spark, path, {"accession": "acc", "taxonomy": "tax", "taxid": "tid"}).select("accession", "taxonomy", "taxid")


def _catalogue(spark, d) -> str:
    b = _batches(spark, d)
    return _lines(b, F.concat_ws(",", "asm_tar_xz", "md5"), ["# made by: a test", "#version:2", "asm_tar_xz,md5"])


def catalogue_csv(spark, d):
    rows = manifests.catalogue_csv(spark, _catalogue(spark, d))
    return rows.select("asm_tar_xz", F.coalesce("md5", F.lit("")).alias("md5"))


def catalogue_metadata(spark, d):
    return manifests.catalogue_metadata(spark, _catalogue(spark, d))


def sample_manifest_csv(spark, d):
    b = _batches(spark, d).select("asm_tar_xz").distinct().orderBy("asm_tar_xz")
    return manifests.sample_manifest(spark, _lines(b, F.concat("asm_tar_xz", F.lit(",a/"), "asm_tar_xz", F.lit("_1.fq,a/"), "asm_tar_xz", F.lit("_2.fq")), ["sample,forward,reverse"]))


def delimited_tsv(spark, d):
    path = _folder(spark) + "/x.tsv"
    _batches(spark, d).write.option("header", "true").option("sep", "\t").csv(path)
    return manifests.delimited(spark, path).select("asm_tar_xz", F.coalesce("md5", F.lit("")).alias("md5"))


def file_listing(spark, d):
    """Archives and file lists of a listing of files."""
    b = _batches(spark, d).select("asm_tar_xz").distinct()
    listing = b.select(F.concat("asm_tar_xz", F.lit(".batch.1")).alias("filename")).unionByName(b.select(F.concat(F.lit("x/File_Lists/"), "asm_tar_xz").alias("filename"))).unionByName(b.select(F.col("asm_tar_xz").alias("filename")))
    archives, lists = manifests.file_list(listing)
    return archives.withColumn("kind", F.lit("archive")).unionByName(lists.withColumn("kind", F.lit("list")))


def _datasets(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    entry = F.to_json(F.struct(
        n.cast("string").alias("id"), F.col("n_name").alias("name"), F.when(n % 2 == 0, "genomes").otherwise("reads").alias("domain"), F.lit("fasta").alias("data_type"), F.col("n_regionkey").alias("region"),
        F.array(F.struct(F.lit("main").alias("role"), F.concat(F.lit("u/"), "n_name").alias("url"), F.lit("f").alias("filename"), (n * 10).alias("size_bytes"), F.when(n % 3 == 0, F.struct(F.lit("md5").alias("algorithm"), F.md5("n_name").alias("value"))).alias("checksum"))).alias("files"),
        F.struct(F.array(F.lit("all"), F.when(n % 5 == 0, "five").otherwise("other")).alias("tags"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes")).alias("metadata"),
    ))
    path = _folder(spark)
    table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit('{"schema_version": "1", "datasets": ['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("value")).select("value", "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return manifests.datasets(spark, path + "/*/*")


def dataset_catalogue(spark, d):
    r = _datasets(spark, d)
    f = F.col("files")[0]
    return r.select("id", "name", "domain", f["url"].alias("url"), f["size_bytes"].alias("size_bytes"), f["checksum"].alias("checksum"), F.array_join("metadata.tags", ",").alias("tags"), F.col("metadata.attributes")["region"].alias("region"), F.size("metadata.attributes").alias("n_attributes"))


def dataset_filter(spark, d):
    return manifests.filter_datasets(_datasets(spark, d), ["five", "all"], domain="reads", organism=None).select("id")


# --- sinks ---------------------------------------------------------------------------------------------------------


def plan_csv(spark, d):
    """A catalogue plan saved as CSV with its side file, and read back."""
    path, b = _folder(spark), _batches(spark, d)
    sinks.save_plan(b, path, {"rows": b.count(), "from": "asm_batches"})
    about = json.loads("".join(r.value for r in spark.read.text(path + ".about.json").collect()))  # one line
    return spark.read.option("header", "true").csv(path).select("asm_tar_xz", F.coalesce("md5", F.lit("")).alias("md5"), F.lit(about["rows"]).cast("bigint").alias("n"))


def results_json(spark, d):
    """Results per query with an empty list for queries without hits, as folders of JSON."""
    p = table(spark, d, "nation")
    hits = p.where("n_regionkey < 3").select(F.col("n_name").alias("match_name"), F.concat(F.lit("q"), "n_regionkey").alias("query_name"), F.col("n_nationkey").cast("bigint").alias("intersect_hashes"))
    path = _folder(spark)
    sinks.save_results(sketch.split_results(hits, p.select(F.col("n_name").alias("accession"))), path)
    return spark.read.json(path).select("accession", "n_hits", F.to_json("hits").alias("hits"))


def clusters_json(spark, d):
    path, c = _folder(spark), CQ.ani_clusters(spark, d)
    sinks.save_clusters(c, path)
    return spark.read.schema(c.schema).json(path)


def metrics_json(spark, d):
    path, m = _folder(spark), CQ.metric_aggregate(spark, d).select("event_type", "samples")
    sinks.save_json(m, path)
    return spark.read.schema(m.schema).json(path)


def files_listing(spark, d):
    """Files below a folder with their sizes: those of a gzipped CSV that was written there."""
    path = _folder(spark)
    sinks.save_csv(table(spark, d, "region").select("r_regionkey"), path)
    found = lines.files(spark, path).where(F.col("file").endswith(".csv.gz") & (F.col("size") > 0))
    read = spark.read.option("header", "true").csv(path).select(F.col("r_regionkey").cast("bigint").alias("k"))
    return read.agg(F.count("*").alias("n_rows"), F.sum("k").alias("sum_keys")).withColumn("any_files", F.lit(found.count() > 0))


# --- workflows -----------------------------------------------------------------------------------------------------


def workflow_reference(spark, d):
    """A coloured graph built from FASTA files, stored, and loaded again."""
    e = W.construct_coloured(spark, [_fasta(spark, d)], K, _folder(spark))
    return e.select("eid", "node", "sym", F.array_join("colours", ",").alias("colours"), "first", "last")


def workflow_colours(spark, d):
    out = _folder(spark)
    W.construct_coloured(spark, [_fasta(spark, d)], K, out)
    return spark.read.parquet(f"{out}/colours")


def workflow_offsets(spark, d):
    out = _folder(spark)
    W.construct_coloured(spark, [_fasta(spark, d)], K, out)
    return spark.read.parquet(f"{out}/offsets")


def workflow_annotated(spark, d):
    """A graph whose colours are the annotations of GFF files."""
    path = _gff(spark, d)
    feats, contigs = gff.read_gff(spark, path)
    edges, _ = A.gff_graph(gff.normalise(feats), contigs.select(F.col("seq_id").alias("seqid"), "seq"), K_GFF)
    return edges.select("node", "sym", F.array_join("colours", ",").alias("colours"))


def _sample(spark, d, weighted=True) -> tuple[str, DataFrame]:
    out, f, r = _folder(spark), _reads(spark, d, 1), _reads(spark, d, 2)
    return out, W.construct_weighted(spark, f + "/part=0", r + "/part=0", K, out, weighted)


def workflow_sample(spark, d):
    """The weighted graph of a sample of paired reads."""
    return _sample(spark, d)[1].select("eid", "node", "sym", "n")


def workflow_sample_plain(spark, d):
    return _sample(spark, d, False)[1].select("eid", "node", "sym")


def workflow_classify(spark, d):
    """What the edges of a sample mean in a reference of all contigs."""
    ref = _folder(spark)
    W.construct_coloured(spark, [_fasta(spark, d)], K, ref)
    return W.classify_sample(spark, _sample(spark, d)[0], ref, _folder(spark)).select("colour", "seed", "n_edges", "depth")


def classify_clusters(spark, d):
    """A sample against one reference per language group."""
    s = sequences(spark, d)
    q = graph.build(s.where("lang = 'python'"), K, "weighted")
    refs = {name: graph.build(s.where(cond), K, "coloured") for name, cond in (("none", "lang is null"), ("some", "lang is not null"))}
    return classify.classify_clusters(q, refs).groupBy("cluster_id", "colour").agg(F.count("*").alias("n_edges"), F.sum("depth").alias("depth"))


def graph_saved(spark, d):
    """Edges saved in graph order and loaded again."""
    path = _folder(spark)
    graph.save(graph.build(sequences(spark, d), K), path)
    return graph.load(spark, path)


def _sketch_files(spark, d) -> list[str]:
    """One FASTA file and one FASTQ file per part of the documents."""
    path, c = _folder(spark), _contigs(spark, d)
    for p in range(PARTS):
        sinks.fasta_lines(c.where(F.col("doc_id") % PARTS == p), "seq_id", "seq").write.text(f"{path}/a{p}.fna")
        sinks.fastq_lines(c.where((F.col("doc_id") % PARTS == p) & (F.length("seq") > 0) & (F.col("doc_id") % 3 == 0)), "seq_id", "seq").write.text(f"{path}/r{p}.fq")
    return [f"{path}/{x}{p}.{e}" for p in range(PARTS) for x, e in (("a", "fna"), ("r", "fq"))]


def _folder_name(c: Column) -> Column:
    return names.sequence_name(F.element_at(F.split(c, "/"), -2))


def workflow_sketch(spark, d):
    """Sketches of assemblies (FASTA) and of samples (FASTQ)."""
    seqs = W.read_sequences(spark, _sketch_files(spark, d)).withColumn("name", _folder_name(F.col("file")))
    return sketch.sketch(seqs, K_SKETCH, SCALED)


def workflow_screen(spark, d):
    """Samples screened against an index of assemblies stored by hash ranges."""
    path, all_of = _folder(spark), workflow_sketch(spark, d)
    sketch.reverse_index(all_of.where(F.col("name").startswith("a")), path, 4)
    hits = sketch.screen(all_of.where(F.col("name").startswith("r")), spark.read.parquet(path), SCALED, 100)
    return hits.select("query_name", "match_name", "intersect_hashes", "match_size")


def workflow_cluster(spark, d):
    """Clusters of sketches at two thresholds."""
    s = CQ.sketch_frac(spark, d)
    return W.cluster_sketches(s, CQ.K_SKETCH, [0.9, 0.99]).groupBy("tag", "cluster_id").agg(F.count("*").alias("n"), F.min("accession").alias("first"))


# --- what no other query runs --------------------------------------------------------------------------------------


def missing_members(spark, d):
    """Edge ends that a clustering of the querying accessions leaves out: those that are matches only."""
    edges, _ = CQ._edges(spark, d)
    people = table(spark, d, "pairwise").select(F.regexp_extract("query_name", r"(\S+)", 1).alias("accession"))
    some = cluster.numbered(cluster.clusters_at(edges, people, "m", 0.97))
    return cluster.missing_members(edges, some.select("accession").distinct())


def cluster_members(spark, d):
    return cluster.members(CQ.ani_clusters(spark, d), ["cluster_id"])


def clusters_changed(spark, d):
    """Clusters of one threshold whose members are no cluster of another: an index of those needs these again."""
    edges, people = CQ._edges(spark, d)
    root = lambda t: cluster.digests(cluster.clusters_at(edges, people, "m", t).select("accession", "root"), ["root"])
    return cluster.changed(root(0.99), root(0.95), ["root"]).select("root", "n")


def catalog_quality(spark, d):
    """Assemblies within quality bounds; the quality table is made from the annotations."""
    t = CQ._tables(spark, d)
    b = t["bakta"].where("sample is not null").groupBy("sample").agg((F.count("*") % 7).alias("contamination"), (F.ascii(F.right("sample", F.lit(1))) % 10 * 10).alias("completeness_general"))
    return catalog.count_by_species({**t, "checkm2": b}, catalog.Options(max_contamination=1, min_completeness=50))


def manifest_cleanup(spark, d):
    """Failed accessions reserved again by another package: cleaned or given up."""
    rows = table(spark, d, "bakta").where("file_name is not null").groupBy(F.col("file_name").alias("accession")).agg(F.max("status").alias("status"))
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    m, _ = manifest.reserve(spark.createDataFrame([], manifest.SCHEMA), rows.select("accession", F.lit("1").alias("taxid")), "p", at)
    m = manifest.mark_failed(m, rows, "p", "lost")
    m, _ = manifest.reserve(m, rows.select("accession", F.lit("1").alias("taxid")), "q", at)
    m = manifest.finish_cleanup(m, rows.where("status = 'PASS'"), "q")
    m = manifest.fail_cleanup(m, rows.where("status = 'FAIL'"), "q", "still there")
    return m.groupBy("state", "package_id").agg(F.count("*").alias("n"), F.count("cleanup_started_at").alias("n_cleaned"))


def _states(spark, d) -> DataFrame:
    a = table(spark, d, "assembly").where("sample_accession is not null")
    return a.groupBy(F.col("sample_accession").alias("accession")).agg(F.max("sylph_species").alias("taxid"), F.min(F.when(F.col("hq_filter") == "PASS", "complete").otherwise("reserved")).alias("state"))


def manifest_listing(spark, d):
    return manifest.listing(_states(spark, d), "complete").select("accession", "state")


def manifest_taxonomy(spark, d):
    return manifest.taxonomy(_states(spark, d))


def manifest_integrity(spark, d):
    s = _states(spark, d).withColumns({"package_id": F.when(F.col("state") == "complete", "p"), "reserved_at": F.lit("2024"), "completed_at": F.when(F.col("state") == "complete", "2024"), "cleanup_started_at": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return manifest.integrity(s)


def terminal_plan(spark, d):
    """Padded prefixes per source with their running totals: where each source's begin in a common range."""
    stats = kmers.size_stats(sequences(spark, d), K, ["source"]).select("source", F.lit("$").alias("suffix"), F.col("n_terminals").cast("bigint").alias("n"))
    return kmers.suffix_plan(stats, "source").select("source", "n", "from", "until")


def text_checks(spark, d):
    """CRC32 of names, the delimiter of a path, a time in ISO form."""
    b = table(spark, d, "asm_batches").where("asm_tar_xz is not null")
    path = F.concat("asm_tar_xz", F.when(F.length("asm_tar_xz") % 3 == 0, ".tsv.gz").when(F.length("asm_tar_xz") % 3 == 1, ".CSV").otherwise(".txt"))
    crc = F.hex(F.crc32("asm_tar_xz"))
    return b.select("asm_tar_xz", (F.conv(crc, 16, 10).cast("bigint") == F.crc32("asm_tar_xz")).alias("crc_kept"), F.coalesce(names.delimiter(path), F.lit("none")).alias("delimiter"), names.iso_time(F.col("published_at")).alias("published")).distinct()


def suffixes_in_order(spark, d):
    """Every suffix of up to three bases with its place, written from the place and read back to it."""
    listed = spark.createDataFrame([(i, dna.suffix_from_index(i, 3)) for i in range(dna.suffix_count(3))], "place long, suffix string")  # 85 suffixes
    return listed.select("place", "suffix", dna.suffix_index(F.col("suffix"), 3).alias("again"), dna.roll(F.concat(F.lit("A"), "suffix"), F.lit("T")).alias("rolled"))


def filter_tags(spark, d):
    """The one tag of a rank's groups among those of the clusters, and which tags an index at ani0.97 accepts."""
    tags = CQ.ani_refine(spark, d).select("tag").distinct()
    common = cluster.tag_for_rank(spark.createDataFrame([("ani0.97",), ("genus",)], "tag string"), tags)

    def accepted(tag: str) -> bool:
        try:
            cluster.check_filter_tag(tag, common)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(t, accepted(t)) for t in ("ani0.95", "ani0.97", "ani0.99", "genus")], "tag string, accepted boolean")


def chunk_sizes(spark, d):
    """Piece length per source for 4 workers, from the upper median of text lengths."""
    docs = table(spark, d, "documents").where("text is not null").select("source", F.length("text").alias("n"))
    return kmers.upper_median(docs, "n", ["source"]).select("source", F.greatest(F.floor(F.col("median") / 4), F.lit(200)).cast("bigint").alias("size"))


_FUNCTIONS = (
    fasta_scan, fasta_contigs, gff_features, gff_contigs, gff_base, gff_genomes, fastq_reads, fastq_paired, fastq_interleaved, fastq_metadata, fastq_groups, manifest_files, genome_manifest_csv,
    catalogue_csv, catalogue_metadata, sample_manifest_csv, delimited_tsv, file_listing, dataset_catalogue, dataset_filter, plan_csv, results_json, clusters_json, metrics_json, files_listing,
    workflow_reference, workflow_colours, workflow_offsets, workflow_annotated, workflow_sample, workflow_sample_plain, workflow_classify, classify_clusters, graph_saved, workflow_sketch, workflow_screen,
    workflow_cluster, missing_members, cluster_members, clusters_changed, catalog_quality, manifest_cleanup, manifest_listing, manifest_taxonomy, manifest_integrity, terminal_plan, text_checks,
    suffixes_in_order, filter_tags, chunk_sizes,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_N = f"{_S}, n AS (SELECT doc_id, 'd' || doc_id AS seq_id, source, lang, replace(seq, 'ACG', 'N') AS seq FROM s)"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_FRAG = "list_filter(string_split({}, 'N'), lambda x: length(x) > 0)"
_QUAL = "array_to_string(list_transform({}, lambda x: repeat('I', length(x))), ',')"
_LOST = "length(seq) - length(replace(seq, 'N', ''))"
_COLOURED = f"""{_N}, ids AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) AS colour FROM (SELECT DISTINCT seq_id FROM n WHERE length(seq) > 0)),
fr AS (SELECT n.source, n.lang, ids.colour, n.doc_id, n.seq_id, unnest(string_split(n.seq, 'N')) AS seq FROM n JOIN ids USING (seq_id)),
both_ AS (SELECT source, lang, colour, doc_id, seq_id, unnest([seq, {_RC.format("seq")}]) AS seq FROM fr WHERE length(seq) >= {{}})"""
_REF = f"WITH {_COLOURED.format(K)}, {_edge_rows(K)}, {_edge_table()}"
_ORDER = """x AS (SELECT *, row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid, CAST(row_number() OVER (PARTITION BY substr(node, 2), sym ORDER BY reverse(node)) = 1 AS INT) AS first,
  CAST(row_number() OVER (PARTITION BY node ORDER BY sym DESC) = 1 AS INT) AS last FROM e)"""
# both mates of a read have the same fragments on both strands
_SMP = f"WITH {_COLOURED.format(K)}, smp AS (SELECT * FROM both_ WHERE doc_id % {PARTS} = 0 UNION ALL SELECT * FROM both_ WHERE doc_id % {PARTS} = 0), {_edge_rows(K, 'smp', 'sr')}, {_edge_table('sr', 'q')}"
_SKETCH = rf"""WITH {_N}, fi AS (SELECT 'a' || doc_id % {PARTS} AS name, seq FROM n UNION ALL SELECT 'r' || doc_id % {PARTS}, seq FROM n WHERE doc_id % 3 = 0),
w0 AS (SELECT name, unnest(string_split(seq, 'N')) AS seq FROM fi), w1 AS (SELECT name, substr(seq, i, {K_SKETCH}) AS m FROM (SELECT name, seq, unnest(range(1, length(seq) - {K_SKETCH} + 2)) AS i FROM w0)),
sk AS (SELECT DISTINCT name, substr(md5(least(m, {_RC.format("m")})), 1, 16) AS hash FROM w1), sketches AS (SELECT * FROM sk WHERE hash < '{sketch.max_hash(SCALED)}')"""
_STATE = "WITH st AS (SELECT sample_accession AS accession, max(sylph_species) AS taxid, min(CASE WHEN hq_filter = 'PASS' THEN 'complete' ELSE 'reserved' END) AS state FROM assembly WHERE sample_accession IS NOT NULL GROUP BY 1)"
_B = "SELECT DISTINCT asm_tar_xz, coalesce(asm_tar_xz_md5, '') AS md5 FROM asm_batches WHERE asm_tar_xz IS NOT NULL"

SQL = {
    "fasta_scan": f"WITH {_N} SELECT seq_id, seq FROM n",
    "fasta_contigs": f"WITH {_COLOURED.format(5)}, f2 AS (SELECT seq_id, colour, seq FROM fr WHERE length(seq) >= 5) SELECT seq_id, 0 AS strand_no, seq, colour FROM f2 UNION ALL SELECT seq_id, 1, {_RC.format('seq')}, colour FROM f2",
    "gff_features": f'{CQ._FEAT} SELECT CAST(doc_id AS VARCHAR) AS seqid, CAST(fb AS BIGINT) AS "begin", CAST(fe AS BIGINT) AS "end", strand, doc_id || \'-f\' || colour AS seed FROM fs',
    "gff_contigs": f"WITH {_S} SELECT CAST(doc_id AS VARCHAR) AS seq_id, seq FROM s",
    "gff_base": f'WITH {_N} SELECT seq_id AS seqid, CAST(0 AS BIGINT) AS "begin", CAST(length(seq) AS BIGINT) AS "end", unnest([\'+\', \'-\']) AS strand, seq_id || \'-base\' AS seed FROM n',
    "gff_genomes": f"WITH {_N} SELECT seq_id AS accession, seq_id, CASE WHEN doc_id % 2 = 0 THEN seq ELSE reverse(seq) END AS seq FROM n",
    "fastq_reads": f"WITH {_N}, f AS (SELECT *, {_FRAG.format('seq')} AS l FROM n) SELECT seq_id AS read_id, array_to_string(l, ',') AS fragments, {_QUAL.format('l')} AS quals, 1 AS n_records, CAST({_LOST} AS INT) AS discarded FROM f",
    **dict.fromkeys(
        ("fastq_paired", "fastq_interleaved"),
        f"""WITH {_N}, f AS (SELECT *, list_concat({_FRAG.format('seq')}, {_FRAG.format(_RC.format('seq'))}) AS l FROM n)
SELECT seq_id AS read_id, array_to_string(l, ',') AS fragments, {_QUAL.format('l')} AS quals, 2 AS n_records, CAST(2 * ({_LOST}) AS INT) AS discarded FROM f""",
    ),
    "fastq_metadata": f"WITH {_N} SELECT count(*) AS n_records, count(*) AS n_reads, CAST(sum({_LOST}) AS BIGINT) AS discarded, false AS compressed FROM n",
    "fastq_groups": """WITH p AS (SELECT o_orderkey AS k, '/x/S' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_L00' || o_orderkey % 9 ELSE '' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN '_001' ELSE '' END || '.fastq.gz' AS z FROM orders)
SELECT 'S' || k AS sample, CASE WHEN k % 2 = 0 THEN 'L00' || k % 9 ELSE 'null' END AS lane, CASE WHEN k % 3 = 0 THEN '001' ELSE 'null' END AS fragment, a || '_R1' || z AS forward, a || '_R2' || z AS reverse FROM p""",
    "manifest_files": """SELECT fasta AS value, CASE WHEN t IN ('fna', 'fa', 'fasta') THEN 'FASTA' WHEN t IN ('gff3', 'gff') THEN 'GFF' ELSE 'FASTQ' END AS file_type
FROM (SELECT fasta, lower(regexp_extract(regexp_replace(fasta, '\\.gz$', ''), '\\.([^.]+)$', 1)) AS t FROM (SELECT DISTINCT trim(fasta) AS fasta FROM genome_manifest WHERE fasta IS NOT NULL))""",
    "genome_manifest_csv": """WITH g AS (SELECT accession, lower(regexp_replace(coalesce(taxonomy, ''), '[^A-Za-z]', '', 'g')) AS tax, coalesce(taxid, '') AS tid, coalesce(entered_at, TIMESTAMP '1900-01-01') AS t FROM genome_manifest WHERE accession IS NOT NULL),
r AS (SELECT trim(accession) AS accession, tax, tid, row_number() OVER (PARTITION BY accession ORDER BY t DESC, tid DESC, tax DESC) AS i FROM g)
SELECT accession, nullif(tax, '') AS taxonomy, nullif(tid, '') AS taxid FROM r WHERE i = 1""",
    "catalogue_csv": _B,
    "catalogue_metadata": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'made by: a test'), (1, 'version:2')) AS t(line_no, text)",
    "sample_manifest_csv": "SELECT DISTINCT asm_tar_xz AS sample, 'a/' || asm_tar_xz || '_1.fq' AS forward, 'a/' || asm_tar_xz || '_2.fq' AS reverse FROM asm_batches WHERE asm_tar_xz IS NOT NULL",
    "delimited_tsv": _B,
    "file_listing": """WITH b AS (SELECT DISTINCT asm_tar_xz FROM asm_batches WHERE asm_tar_xz IS NOT NULL) SELECT asm_tar_xz || '.batch.1' AS filename, 'archive' AS kind FROM b
UNION ALL SELECT 'x/File_Lists/' || asm_tar_xz, 'list' FROM b UNION ALL SELECT asm_tar_xz, 'archive' FROM b WHERE contains(asm_tar_xz, '.batch.') UNION ALL SELECT 'x/File_Lists/' || asm_tar_xz, 'archive' FROM b WHERE contains(asm_tar_xz, '.batch.')""",
    "dataset_catalogue": """SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'genomes' ELSE 'reads' END AS domain, 'u/' || n_name AS url, CAST(n_nationkey * 10 AS BIGINT) AS size_bytes,
  CASE WHEN n_nationkey % 3 = 0 THEN 'md5:' || md5(n_name) END AS checksum, 'all,' || CASE WHEN n_nationkey % 5 = 0 THEN 'five' ELSE 'other' END AS tags, CAST(n_regionkey AS VARCHAR) AS region, 2 AS n_attributes FROM nation""",
    "dataset_filter": "SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 5 = 0",
    "plan_csv": f"SELECT asm_tar_xz, md5, count(*) OVER () AS n FROM ({_B})",
    "results_json": """SELECT n_name AS accession, CASE WHEN n_regionkey < 3 THEN 1 ELSE 0 END AS n_hits, CASE WHEN n_regionkey < 3 THEN '[{"intersect_hashes":' || n_nationkey || ',"query_name":"q' || n_regionkey || '"}]' ELSE '[]' END AS hits FROM nation""",
    "clusters_json": CQ.SQL["ani_clusters"],
    "metrics_json": "SELECT event_type, CAST(sum(event_id % 5 + 1) AS BIGINT) AS samples FROM events GROUP BY 1",
    "files_listing": "SELECT count(*) AS n_rows, CAST(sum(r_regionkey) AS BIGINT) AS sum_keys, true AS any_files FROM region",
    "workflow_reference": f"{_REF}, {_ORDER} SELECT eid, node, sym, array_to_string(colours, ',') AS colours, first, last FROM x",
    "workflow_colours": f"{_REF}, c AS (SELECT colour, count(*) AS n FROM (SELECT unnest(colours) AS colour FROM e) GROUP BY 1) SELECT seq_id AS seed, ids.colour, coalesce(n, 0) AS occurrences FROM ids LEFT JOIN c USING (colour)",
    "workflow_offsets": f"""{_REF}, sy AS (SELECT unnest(['$', 'A', 'C', 'G', 'T']) AS sym), t AS (SELECT right(node, 1) AS t, count(*) AS n, count(DISTINCT node) AS m FROM e GROUP BY 1)
SELECT sym, CAST(coalesce(sum(n), 0) AS BIGINT) AS f, CAST(coalesce(sum(m), 0) AS BIGINT) AS c FROM sy LEFT JOIN t ON t.t < sy.sym GROUP BY 1""",
    "workflow_annotated": f"""{CQ._FEAT}, cr AS (SELECT doc_id, colour, row_number() OVER (ORDER BY doc_id || '-f' || colour) AS c FROM fs),
st AS (SELECT doc_id, '+' AS strand, seq FROM s UNION ALL SELECT doc_id, '-', {_RC.format('seq')} FROM s), ps AS (SELECT *, unnest(range(0, 65)) AS p FROM st),
rows_ AS (SELECT substr('{"$" * K_GFF}' || seq || '$', p + 1, {K_GFF}) AS node, substr('{"$" * K_GFF}' || seq || '$', p + {K_GFF} + 1, 1) AS sym, coalesce(cr.c, 0) AS colour
  FROM ps LEFT JOIN tok ON tok.doc_id = ps.doc_id AND tok.strand = ps.strand AND tok.b <= p - {K_GFF} AND p < tok.e LEFT JOIN cr ON cr.doc_id = tok.doc_id AND cr.colour = tok.colour),
e0 AS (SELECT node, sym, list_sort(list_distinct(list(colour))) AS colours FROM rows_ GROUP BY 1, 2), e AS (SELECT * FROM (SELECT *, bool_or(sym <> '$') OVER (PARTITION BY node) AS real FROM e0) WHERE sym <> '$' OR NOT real)
SELECT node, sym, array_to_string(colours, ',') AS colours FROM e""",
    "workflow_sample": f"{_SMP} SELECT row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid, node, sym, n FROM q",
    "workflow_sample_plain": f"{_SMP} SELECT row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid, node, sym FROM q",
    "workflow_classify": f"""{_SMP}, {_edge_rows(K)}, {_edge_table()}, a AS (SELECT unnest(e.colours) AS colour, q.n AS depth FROM q JOIN e USING (node, sym)),
c AS (SELECT colour, count(*) AS n_edges, CAST(sum(depth) AS BIGINT) AS depth FROM a GROUP BY 1) SELECT colour, seq_id AS seed, n_edges, depth FROM c LEFT JOIN ids USING (colour)""",
    "classify_clusters": f"""WITH {_S}, both_ AS (SELECT source, lang, colour, unnest([seq, {_RC.format('seq')}]) AS seq FROM s), qs AS (SELECT * FROM both_ WHERE lang = 'python'), r0 AS (SELECT * FROM both_ WHERE lang IS NULL), r1 AS (SELECT * FROM both_ WHERE lang IS NOT NULL),
{_edge_rows(K, 'qs', 'qr')}, {_edge_rows(K, 'r0', 'rr')}, {_edge_rows(K, 'r1', 'rs')}, {_edge_table('qr', 'q')}, {_edge_table('rr', 'ra')}, {_edge_table('rs', 'rb')},
a AS (SELECT 'none' AS cluster_id, unnest(ra.colours) AS colour, q.n AS depth FROM q JOIN ra USING (node, sym) UNION ALL SELECT 'some', unnest(rb.colours), q.n FROM q JOIN rb USING (node, sym))
SELECT cluster_id, colour, count(*) AS n_edges, CAST(sum(depth) AS BIGINT) AS depth FROM a GROUP BY ALL""",
    "graph_saved": f"WITH {_S}, both_ AS (SELECT source, lang, colour, unnest([seq, {_RC.format('seq')}]) AS seq FROM s), {_edge_rows(K)}, {_edge_table()} SELECT node, sym FROM e",
    "workflow_sketch": f"{_SKETCH} SELECT name, hash FROM sketches",
    "workflow_screen": f"""{_SKETCH}, z AS (SELECT name, count(*) AS n FROM sketches GROUP BY 1)
SELECT a.name AS query_name, b.name AS match_name, count(*) AS intersect_hashes, any_value(z.n) AS match_size FROM sketches a JOIN sketches b USING (hash) JOIN z ON z.name = b.name
WHERE a.name LIKE 'r%' AND b.name LIKE 'a%' GROUP BY 1, 2 HAVING count(*) * {SCALED} >= 100""",
    "missing_members": r"""WITH p AS (SELECT regexp_extract(query_name, '(\S+)', 1) AS a, regexp_extract(match_name, '(\S+)', 1) AS b FROM pairwise WHERE average_containment_ani IS NOT NULL AND NOT isnan(average_containment_ani) AND query_name IS NOT NULL AND match_name IS NOT NULL),
v AS (SELECT a AS accession FROM p UNION SELECT b FROM p) SELECT accession FROM v WHERE accession NOT IN (SELECT regexp_extract(query_name, '(\S+)', 1) FROM pairwise WHERE query_name IS NOT NULL)""",
    "cluster_members": f"{CQ._clusters(0.97)}, m AS (SELECT cluster_id, count(*) AS n, string_agg(accession, ',' ORDER BY accession) AS members FROM cl GROUP BY 1) SELECT cluster_id, n, 0 AS page, members FROM m",
    "catalog_quality": """WITH q AS (SELECT sample, count(*) % 7 AS contamination, ascii(right(sample, 1)) % 10 * 10 AS completeness FROM bakta WHERE sample IS NOT NULL GROUP BY 1)
SELECT sylph_species, count(*) AS n FROM assembly JOIN q ON sample = sample_accession WHERE contamination <= 1 AND completeness >= 50 GROUP BY 1""",
    "manifest_cleanup": """WITH r AS (SELECT file_name, max(status) AS status FROM bakta WHERE file_name IS NOT NULL GROUP BY 1)
SELECT CASE WHEN status = 'PASS' THEN 'reserved' WHEN status = 'FAIL' THEN 'failed' ELSE 'cleaning' END AS state, 'q' AS package_id, count(*) AS n, count(*) AS n_cleaned FROM r GROUP BY 1""",
    "manifest_listing": f"{_STATE} SELECT accession, state FROM st WHERE state = 'complete'",
    "manifest_taxonomy": f"{_STATE} SELECT accession, taxid FROM st WHERE state = 'complete'",
    "manifest_integrity": f"{_STATE} SELECT accession, CASE WHEN trim(accession) = '' THEN 'no accession' WHEN taxid IS NULL THEN 'no taxid' ELSE 'never reserved' END AS fault FROM st WHERE trim(accession) = '' OR taxid IS NULL OR state <> 'complete'",
    "terminal_plan": f"""WITH {_S}, c AS (SELECT source, count(*) * {K} AS n FROM s GROUP BY 1), u AS (SELECT *, CAST(sum(n) OVER (ORDER BY source) AS BIGINT) AS until FROM c) SELECT source, n, until - n AS "from", until FROM u""",
    "text_checks": """SELECT DISTINCT asm_tar_xz, true AS crc_kept, CASE length(asm_tar_xz) % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ',' ELSE 'none' END AS delimiter, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published FROM asm_batches WHERE asm_tar_xz IS NOT NULL""",
    "suffixes_in_order": """WITH b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), t AS (SELECT '' AS suffix UNION ALL SELECT x FROM b UNION ALL SELECT a.x || c.x FROM b a, b c UNION ALL SELECT a.x || c.x || e.x FROM b a, b c, b e),
o AS (SELECT suffix, row_number() OVER (ORDER BY reverse(suffix)) - 1 AS place FROM t) SELECT place, suffix, place AS again, suffix || 'T' AS rolled FROM o""",
    "filter_tags": "SELECT * FROM (VALUES ('ani0.95', false), ('ani0.97', true), ('ani0.99', true), ('genus', true)) AS t(tag, accepted)",
    "chunk_sizes": """SELECT source, CAST(greatest(floor(l[CAST(floor(len(l) / 2) AS BIGINT) + 1] / 4), 200) AS BIGINT) AS size FROM (SELECT source, list_sort(list(length(text))) AS l FROM documents WHERE text IS NOT NULL GROUP BY 1)""",
}
