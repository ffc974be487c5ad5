"""The workflows end to end: build a reference, build a sample, classify, sketch, cluster, screen.

Every stage is a table below one folder, so a stage can be run again alone and a later one starts from stored input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import names
from strandflow.operators import annotations as A
from strandflow.operators import catalog, classify, cluster, graph, sketch
from strandflow.sources import fasta, fastq, gff, manifests
from strandflow.sources.sinks import staged


def _store(df: DataFrame, path: str) -> None:
    staged(df, path, lambda p: df.write.parquet(p))


def _manifest_files(spark: SparkSession, manifest: str, column: int, separator: str) -> list[str]:
    """Paths of a manifest: the work list of a build, as many as there are files."""
    rows = manifests.file_paths(spark, manifest, column, separator).orderBy("line_no").collect()
    kinds = {r.file_type for r in rows}
    if len(kinds) != 1 or not kinds <= {"FASTA", "GFF"}:
        raise ValueError(f"a build takes FASTA or GFF files, not {sorted(kinds)}")
    return manifests.require_files(spark, [r.value for r in rows])


def read_sequences(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, seq) of FASTA and FASTQ files by their extension; of FASTQ reads the ACGT fragments."""
    is_reads = lambda f: f.removesuffix(".gz").lower().endswith(names.FASTQ_EXTENSIONS)
    reads, contigs = [f for f in files if is_reads(f)], [f for f in files if not is_reads(f)]
    parts = []
    if contigs:
        parts.append(fasta.read_fasta(spark, contigs).select("file", "seq"))
    if reads:
        parts.append(fastq.unpaired(spark, reads).select("file", F.explode("fragments.seq").alias("seq")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def construct_coloured(spark: SparkSession, files: list[str], k: int, out: str) -> DataFrame:
    """Coloured graph of FASTA files (a colour per contig) or of GFF files (a colour per annotation), stored below ``out``.

    Tables: edges (node, sym, meta_id, first, last, eid), meta_colours, colours (seed, colour, occurrences), offsets.
    """
    if files[0].removesuffix(".gz").lower().endswith(names.GFF_EXTENSIONS):
        feats, contigs = gff.read_gff(spark, files)
        edges, colours = A.gff_graph(gff.normalise(feats), contigs.select(F.col("seq_id").alias("seqid"), "seq"), k)
    else:
        seqs = fasta.read_fasta(spark, files)
        colours = graph.colour_ids(seqs, "seq_id")
        edges = graph.build(seqs.join(colours.withColumnRenamed("seed", "seq_id"), "seq_id"), k, "coloured")
    seen = colours.join(graph.colour_occurrences(edges), "colour", "left").select("seed", "colour", F.coalesce("n", F.lit(0)).alias("occurrences"))
    _store(seen, f"{out}/colours")
    with_meta, dictionary = graph.meta_colours(edges, spark.read.parquet(f"{out}/colours").count() + 1)
    _store(dictionary, f"{out}/meta_colours")
    numbered = graph.with_ids(graph.with_flags(with_meta.drop("colours"), k))
    _store(numbered, f"{out}/edges")
    _store(graph.offsets(numbered), f"{out}/offsets")
    return load_coloured(spark, out)


def load_coloured(spark: SparkSession, path: str) -> DataFrame:
    """Edges with their colours from the stored tables."""
    edges, sets = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta_colours")
    return edges.join(sets, "meta_id", "left").withColumn("colours", F.coalesce("colours", F.array("meta_id"))).drop("meta_id")


def construct_weighted(spark: SparkSession, forward: str, reverse: str | None, k: int, out: str, weighted: bool = True) -> DataFrame:
    """Weighted (or, with ``weighted=False``, plain) graph of the fragments of single or paired FASTQ files, stored with ids below ``out``."""
    reads = fastq.paired(spark, forward, reverse) if reverse else fastq.unpaired(spark, forward)
    seqs = reads.select(F.explode("fragments.seq").alias("seq"))
    _store(graph.with_ids(graph.build(seqs, k, "weighted" if weighted else "plain", flags=True)), f"{out}/edges")
    return spark.read.parquet(f"{out}/edges")


def classify_sample(spark: SparkSession, sample: str, reference: str, out: str) -> DataFrame:
    """(seed, n_edges, depth): what the sample's edges mean in the reference."""
    found = classify.accumulate(spark.read.parquet(f"{sample}/edges"), load_coloured(spark, reference))
    named = classify.colour_depths(found).join(spark.read.parquet(f"{reference}/colours").select("seed", "colour"), "colour", "left")
    _store(named, out)
    return spark.read.parquet(out)


def sketch_files(spark: SparkSession, files: list[str], k: int, scaled: int, out: str) -> DataFrame:
    """(name, hash) of every FASTA or FASTQ file not sketched below ``out`` yet."""
    done = spark.read.parquet(out).select("name").distinct() if _there(spark, out) else None
    listed = spark.createDataFrame([(f,) for f in files], "path string").withColumn("name", names.sequence_name(F.col("path")))
    todo = listed if done is None else catalog.pending(listed, done, "name")
    paths = [r.path for r in todo.collect()]
    if paths:
        seqs = read_sequences(spark, paths).withColumn("name", names.sequence_name(F.col("file")))
        sketch.sketch(seqs, k, scaled).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cluster_sketches(sketches: DataFrame, k: int, thresholds: list[float]) -> DataFrame:
    """(tag, accession, cluster_id) at every ANI threshold."""
    pairs = sketch.pairwise(sketches, k)
    edges = pairs.select(F.col("query_name").alias("a"), F.col("match_name").alias("b"), F.col("average_containment_ani").alias("m"))
    return cluster.refine(edges, sketches.select(F.col("name").alias("accession")).distinct(), "m", thresholds)


def screen_files(spark: SparkSession, files: list[str], index: DataFrame, k: int, scaled: int, threshold_bp: int, out: str) -> DataFrame:
    """Hits of sample files against an index, one folder per sample below ``out``, also for samples without hits."""
    seqs = read_sequences(spark, files).withColumn("name", names.sequence_name(F.col("file")))
    queries = sketch.sketch(seqs, k, scaled)
    hits = sketch.screen(queries, index, scaled, threshold_bp)
    rows = hits.select(F.col("query_name").alias("accession"), F.struct("match_name", "intersect_hashes", "match_containment").alias("hit")).groupBy("accession").agg(F.collect_list("hit").alias("hits"))
    everyone = spark.createDataFrame([(f,) for f in files], "path string").select(names.sequence_name(F.col("path")).alias("accession")).distinct()
    result = everyone.join(rows, "accession", "left").withColumn("n_hits", F.greatest(F.size("hits"), F.lit(0)))
    staged(result, out, lambda p: result.write.partitionBy("accession").option("compression", "gzip").json(p))
    return spark.read.json(out)


def build_from_manifest(spark: SparkSession, manifest: str, k: int, out: str, column: int = 0, separator: str = ",") -> DataFrame:
    return construct_coloured(spark, _manifest_files(spark, manifest, column, separator), k, out)
