"""FracMinHash sketches: build, downsample, compare, screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import dna
from strandflow.functions.session import materialise
from strandflow.operators import kmers as K
from strandflow.operators import packed
from strandflow.operators.skew import salted_join


def max_hash(scaled: int) -> str:
    """2^64 / scaled as 16 hex digits; hashes of a sketch are below it."""
    return "g" if scaled <= 1 else f"{-(-(2**64) // scaled):016x}"


def hash16(kmer: Column) -> Column:
    """The first 64 bits of a k-mer's MD5 as 16 hex digits, which compare like unsigned numbers."""
    return F.substring(F.md5(kmer), 1, 16)


def sketch(seqs: DataFrame, k: int, scaled: int, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, hash): distinct hashes below the bound of the canonical k-mers of each name."""
    if k <= 32:
        codes = packed.window_counts(seqs, k, seq, canonical=True, by=name)
        return codes.select(name, hash16(packed.decode(F.col("code"), F.lit(k))).alias("hash")).where(F.col("hash") < max_hash(scaled)).distinct()
    rows = K.kmers(K.fragments(seqs.select(name, seq), k, seq), k, seq)
    return rows.select(name, hash16(dna.canonical(F.col("kmer"))).alias("hash")).where(F.col("hash") < max_hash(scaled)).distinct()


def downsample(sketches: DataFrame, scaled: int, to: int) -> DataFrame:
    """To a coarser ``scaled``; a finer one raises."""
    if to < scaled:
        raise ValueError(f"a sketch of scaled {scaled} can't be refined to {to}")
    return sketches.where(F.col("hash") < max_hash(to))


def check_compatible(query: dict, index: dict) -> int:
    """``scaled`` to compare at: ksize, seed and moltype must agree and the query may not be coarser."""
    for field in ("ksize", "seed", "moltype"):
        if str(query[field]).lower() != str(index[field]).lower():
            raise ValueError(f"sketches of different {field}")
    if query["scaled"] > index["scaled"]:
        raise ValueError("the query is coarser than the index")
    return index["scaled"]


def ani(containment: Column, k: int) -> Column:
    return F.pow(containment, F.lit(1.0 / k))


def pairwise(sketches: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """Pairs of names (of one ``group``) with a common hash: shared hashes, containments, ANI of both sides and their mean.

    Hashes of a single name can't match, so they only count for the sizes.
    """
    keys = [group] if group else []
    sizes = sketches.groupBy(*keys, "name").agg(F.count("*").alias("size"))
    met = sketches.groupBy(*keys, "hash").agg(F.count("*").alias("_df")).where("_df > 1").drop("_df")
    inner = materialise(sketches.join(met, [*keys, "hash"]).select(*keys, F.concat_ws("\u0001", *keys, "hash").alias("_h"), "name"), "sketch-shared")
    # a hash of very many names meets itself in slices
    other = inner.select("_h", F.col("name").alias("match_name"))
    both = salted_join(inner.withColumnRenamed("name", "query_name"), inner.count(), "_h", other, "query_name")
    shared = both.where("query_name < match_name").groupBy(*keys, "query_name", "match_name").agg(F.count("*").alias("intersect_hashes"))
    out = shared.join(sizes.select(*keys, F.col("name").alias("query_name"), F.col("size").alias("query_size")), [*keys, "query_name"])
    out = out.join(sizes.select(*keys, F.col("name").alias("match_name"), F.col("size").alias("match_size")), [*keys, "match_name"])
    cq, cm = F.col("intersect_hashes") / F.col("query_size"), F.col("intersect_hashes") / F.col("match_size")
    return out.select(
        *keys, "query_name", "match_name", "intersect_hashes", cq.alias("query_containment"), cm.alias("match_containment"),
        ((ani(cq, k) + ani(cm, k)) / 2).alias("average_containment_ani"),
    )


def reverse_index(sketches: DataFrame, path: str, partitions: int) -> None:
    """Sketches written by hash ranges, so that a screen prunes by hash and joins sorted runs."""
    sketches.repartitionByRange(partitions, "hash").sortWithinPartitions("hash").write.mode("errorifexists").parquet(path)


def screen(queries: DataFrame, index: DataFrame, scaled: int, threshold_bp: int) -> DataFrame:
    """Matches of each query whose shared hashes stand for at least ``threshold_bp`` bases."""
    found = salted_join(queries, queries.count(), "hash", index.withColumnRenamed("name", "match_name"), "name").groupBy(F.col("name").alias("query_name"), "match_name").agg(F.count("*").alias("intersect_hashes"))
    hits = found.where(F.col("intersect_hashes") * scaled >= threshold_bp)
    sizes = index.groupBy(F.col("name").alias("match_name")).agg(F.count("*").alias("match_size"))
    return hits.join(sizes, "match_name").withColumn("match_containment", F.col("intersect_hashes") / F.col("match_size"))


def split_results(hits: DataFrame, accessions: DataFrame) -> DataFrame:
    """(accession, n_hits, hits ARRAY) per queried accession, an empty list where nothing was found."""
    rows = hits.groupBy(F.col("match_name").alias("accession")).agg(F.array_sort(F.collect_list(F.struct("query_name", "intersect_hashes"))).alias("hits"))
    out = accessions.select("accession").distinct().join(rows, "accession", "left")
    empty = F.array().cast("array<struct<query_name:string,intersect_hashes:bigint>>")
    return out.withColumn("hits", F.coalesce("hits", empty)).withColumn("n_hits", F.size("hits"))
