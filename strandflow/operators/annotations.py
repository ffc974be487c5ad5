"""Annotations: intervals on fragments, coloured edges, the annotation index and its look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions import dna, names

BUCKET = 4096


def fragments_of(contigs: DataFrame, least: int, seqid: str = "seqid", seq: str = "seq") -> DataFrame:
    """(seqid, strand, frag_no, begin, end, seq) of both strands; a reverse fragment counts from the contig's other end."""
    both = contigs.select(seqid, F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col(seq).alias("s")), F.struct(F.lit("-").alias("strand"), dna.reverse_complement(F.col(seq)).alias("s")))).alias("x"))
    return both.select(F.col(seqid).alias("seqid"), "x.strand", F.posexplode(dna.fragment_spans(F.col("x.s"), least)).alias("frag_no", "f")).select("seqid", "strand", "frag_no", "f.begin", "f.end", "f.seq")


def flip(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """Features of the reverse strand with coordinates from the contig's other end; strands . and ? are left out."""
    joined = features.where("strand in ('+', '-')").join(lengths.select("seqid", F.col("length").alias("_l")), "seqid")
    b = F.when(F.col("strand") == "-", F.greatest(F.lit(0), F.col("_l") - F.col("end"))).otherwise(F.col("begin"))
    e = F.when(F.col("strand") == "-", F.greatest(F.lit(0), F.col("_l") - F.col("begin"))).otherwise(F.col("end"))
    return joined.withColumns({"begin": b, "end": e}).drop("_l")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of overlapping intervals (begin, end) and (r_begin, r_end) within ``keys``.

    Both sides are spread over position buckets and meet by equality; a pair counts in the bucket where the later of the
    two begins, so none comes twice. Skewed contigs spread over their buckets.
    """
    spread = lambda d, b, e: d.where(F.col(e) > F.col(b)).withColumn("_k", F.explode(F.sequence(F.floor(F.col(b) / bucket), F.floor((F.col(e) - 1) / bucket))))
    met = spread(left, "begin", "end").join(spread(right, "r_begin", "r_end"), [*keys, "_k"])
    first = F.floor(F.greatest("begin", "r_begin") / bucket)
    return met.where((F.col("r_begin") < F.col("end")) & (F.col("r_end") > F.col("begin")) & (F.col("_k") == first)).drop("_k")


def clip(fragments: DataFrame, features: DataFrame, least: int) -> DataFrame:
    """Tokens (seqid, strand, frag_no, colour, begin, end): features cut to the fragments they overlap, in fragment coordinates."""
    right = features.select("seqid", "strand", "colour", F.col("begin").alias("r_begin"), F.col("end").alias("r_end"))
    met = overlap_join(fragments.select("seqid", "strand", "frag_no", "begin", "end"), right, ["seqid", "strand"])
    b = F.greatest(F.col("r_begin") - F.col("begin"), F.lit(0))
    e = F.least("r_end", "end") - F.col("begin")
    return met.select("seqid", "strand", "frag_no", "colour", b.alias("b"), e.alias("e")).where(F.col("e") - F.col("b") >= least).withColumnsRenamed({"b": "begin", "e": "end"})


def colour_runs(fragments: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """(seqid, strand, frag_no, colour, s, t): runs of edge positions and their colour; positions in no token have colour 0.

    The edge at position p (of its symbol) lies inside a token if begin <= p - k and p < end.
    """
    keys = ["seqid", "strand", "frag_no"]
    inside = tokens.select(*keys, "colour", (F.col("begin") + k).alias("s"), F.col("end").alias("t")).where("t > s")
    # gaps: between the furthest end so far and the next start, from the fragment's first position to its end symbol
    bounds = inside.select(*keys, "s", "t").unionByName(fragments.select(*keys, (F.length("seq") + 1).cast("bigint").alias("s"), (F.length("seq") + 1).cast("bigint").alias("t")))
    w = Window.partitionBy(*keys).orderBy("s", "t").rowsBetween(Window.unboundedPreceding, -1)
    gaps = bounds.withColumn("g", F.coalesce(F.max("t").over(w), F.lit(0))).where("s > g").select(*keys, F.lit(0).cast("bigint").alias("colour"), F.col("g").alias("s"), F.col("s").alias("t"))
    return inside.select(*keys, F.col("colour").cast("bigint"), F.col("s").cast("bigint"), F.col("t").cast("bigint")).unionByName(gaps.withColumns({"s": F.col("s").cast("bigint"), "t": F.col("t").cast("bigint")}))


def coloured_edges(fragments: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """(seqid, strand, frag_no, p, node, sym, colour): every edge with each colour that covers it."""
    keys = ["seqid", "strand", "frag_no"]
    runs = colour_runs(fragments, tokens, k).join(fragments.select(*keys, "seq"), keys)
    rows = runs.withColumn("p", F.explode(F.sequence(F.col("s"), F.col("t") - 1)))
    padded = F.concat(F.lit(dna.PAD * k), F.col("seq"), F.lit(dna.PAD))
    return rows.select(*keys, "p", padded.substr(F.col("p").cast("int") + 1, F.lit(k)).alias("node"), padded.substr(F.col("p").cast("int") + k + 1, F.lit(1)).alias("sym"), "colour")


def gff_graph(features: DataFrame, contigs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(edge table with colours, colour dictionary) of annotated contigs: features (seqid, begin, end, strand, seed), contigs (seqid, seq)."""
    from strandflow.operators.graph import colour_ids, settle

    colours = colour_ids(features.where("seed is not null"), "seed")
    named = features.join(colours, "seed")
    frags = fragments_of(contigs, k)
    tokens = clip(frags, flip(named, contigs.select("seqid", F.length("seq").alias("length"))), k + 1)
    rows = coloured_edges(frags, tokens, k).groupBy("node", "sym").agg(F.array_sort(F.collect_set("colour")).alias("colours"))
    return settle(rows, k), colours


# --- index ---------------------------------------------------------------------------------------------------------


def build_index(records: DataFrame) -> dict[str, DataFrame]:
    """seed (seed_name, accession) and annotation (seed_name, database, label) of records (accession, seed_name, dbxref).

    A seed of two accessions raises. Entries are sets: repeated rows count once.
    """
    seeds = records.select("seed_name", "accession").where("seed_name is not null").distinct()
    clash = seeds.groupBy("seed_name").agg(F.count("*").alias("n"), F.min("accession").alias("accession"))
    bad = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("seed of several accessions: "), "seed_name")).cast("string"))
    seed = clash.withColumn("_e", bad).where("_e is null").select("seed_name", "accession")
    rows = records.where("seed_name is not null").select("seed_name", F.explode(names.dbxrefs(F.col("dbxref"))).alias("x"))
    return {"seed": seed, "annotation": rows.select("seed_name", "x.database", "x.label").distinct()}


def _one_per_key(new: DataFrame, keys: list[str], columns: list[str], order: str | None) -> DataFrame:
    """The last row per key by ``order``; without one the greatest by its other columns, so that the result is defined."""
    others = [c for c in columns if c not in keys]
    if not others:
        return new.select(*keys).distinct()
    last = F.max(F.struct(*([F.col(order).alias("_o")] if order else []), *others)).alias("_last")
    return new.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def add_missing(stored: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Stored rows and those new rows whose key isn't stored yet; of several new rows of a key the last by ``order``."""
    return stored.unionByName(_one_per_key(new, keys, stored.columns, order).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New values over stored ones, row by row of ``key``; of several new rows of a key the last by ``order`` counts."""
    others = [c for c in stored.columns if c != key]
    renamed = _one_per_key(new, [key], stored.columns, order).select(key, *[F.col(c).alias(f"_{c}") for c in others], F.lit(1).alias("_new"))
    joined = stored.join(renamed, key, "full")
    return joined.select(key, *[F.when(F.col("_new") == 1, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in others])


def databases(annotation: DataFrame) -> DataFrame:
    return annotation.select("database").distinct().orderBy("database")


def annotations_of(requested: DataFrame, annotation: DataFrame) -> DataFrame:
    """(seed_name, annotations MAP database -> sorted labels) for each requested seed, an empty map for unknown ones."""
    per = annotation.groupBy("seed_name", "database").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    nested = per.groupBy("seed_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("database", "labels")))).alias("annotations"))
    out = requested.select("seed_name").distinct().join(nested, "seed_name", "left")
    return out.withColumn("annotations", F.coalesce("annotations", F.create_map().cast("map<string,array<string>>")))


def seed_info(requested: DataFrame, seed: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(seed_name, accession, taxid) of requested seeds, nulls for unknown ones."""
    return requested.select("seed_name").distinct().join(seed, "seed_name", "left").join(taxonomy, "accession", "left").select("seed_name", "accession", "taxid")
