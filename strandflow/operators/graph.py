"""De Bruijn edge tables: plain, weighted and coloured; flags, ids, offsets and navigation.

An edge table has one row per (node, sym). Co-lexicographic order is the order of the reversed node, then of the symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.operators import kmers as K
from strandflow.operators import packed
from strandflow.operators.order import number_rows

SYMBOLS = "$ACGT"


def build(seqs: DataFrame, k: int, mode: str = "plain", seq: str = "seq", colour: str = "colour", flags: bool = False) -> DataFrame:
    """Edge table of all fragments of ``seqs`` on both strands.

    mode 'plain': (node, sym); 'weighted': and n; 'coloured': and colours, a sorted ARRAY (0: padded or ``$``).
    ``flags`` adds ``first`` and ``last`` as :func:`with_flags` does.

    Two shuffles: occurrences are counted within their batch and meet by edge, where colours become sets, then by the symbols
    that all nodes of a block share, where ``$`` edges and flags are settled. Up to nodes of 31 symbols both move 8-byte codes,
    sequences of any length are read in slices, and symbols other than A, C, G, T end a fragment; larger nodes are strings, and
    only N ends a fragment.
    """
    if k <= 31:
        rows = packed.edge_counts(seqs, k, seq, colour if mode == "coloured" else None)
        if mode == "coloured":
            met = rows.groupBy("code", "pad").agg(F.array_sort(F.collect_set("by")).alias("colours"))
        elif mode == "weighted":
            met = rows.groupBy("code", "pad").agg(F.sum("n").alias("n"))
        else:
            met = rows.select("code", "pad").distinct()
        return packed.settle(met, k, flags)
    keep = [seq, colour] if mode == "coloured" else [seq]
    rows = K.edges(K.strands(K.fragments(seqs.select(*keep), k, seq), seq), k, seq)
    if mode == "coloured":
        padded = F.col("node").contains("$") | (F.col("sym") == "$")
        rows = rows.select("node", "sym", F.when(padded, F.lit(0)).otherwise(F.col(colour)).cast("bigint").alias("colour"))
        met = rows.groupBy("node", "sym").agg(F.array_sort(F.collect_set("colour")).alias("colours"))
    elif mode == "weighted":
        met = rows.groupBy("node", "sym").agg(F.count("*").alias("n"))
    else:
        met = rows.select("node", "sym").distinct()
    return settle(met, k, flags)


def settle(edges: DataFrame, k: int, flags: bool = False) -> DataFrame:
    """``$`` edges pruned and flags added within blocks of nodes."""
    blocks = edges.withColumn("_block", F.substring("node", 2, k - 1)).repartition("_block")
    real = F.max(F.col("sym") != "$").over(Window.partitionBy("_block", "node"))
    out = blocks.withColumn("_real", real).where((F.col("sym") != "$") | ~F.col("_real")).drop("_real")
    if flags:
        first = Window.partitionBy("_block", "sym").orderBy(F.reverse("node"))
        last = Window.partitionBy("_block", "node").orderBy(F.desc("sym"))
        out = out.withColumn("first", (F.row_number().over(first) == 1).cast("int")).withColumn("last", (F.row_number().over(last) == 1).cast("int"))
    return out.drop("_block")


def with_flags(edges: DataFrame, k: int) -> DataFrame:
    """``first``: first edge with its symbol among the nodes that share the last k - 1 symbols; ``last``: last of its node."""
    block = Window.partitionBy(F.substring("node", 2, k - 1), "sym").orderBy(F.reverse("node"))
    node = Window.partitionBy("node").orderBy(F.desc("sym"))
    return edges.withColumn("first", (F.row_number().over(block) == 1).cast("int")).withColumn("last", (F.row_number().over(node) == 1).cast("int"))


def with_ids(edges: DataFrame) -> DataFrame:
    """``eid``: position in co-lexicographic order."""
    return number_rows(edges, [F.reverse("node"), F.col("sym")], "eid", label="graph-order")


def offsets(edges: DataFrame) -> DataFrame:
    """(sym, f, c): edges and nodes whose last symbol is below ``sym``."""
    tail = edges.groupBy("node").agg(F.count("*").alias("e")).groupBy(F.substring("node", -1, 1).alias("t")).agg(F.sum("e").alias("e"), F.count("*").alias("n"))
    above = F.filter(F.array(*map(F.lit, SYMBOLS)), lambda x: x > F.col("t"))
    none = edges.sparkSession.createDataFrame([(s, 0, 0) for s in SYMBOLS], "sym string, e long, n long")
    rows = tail.select(F.explode(above).alias("sym"), "e", "n").unionByName(none)  # a few rows per symbol
    return rows.groupBy("sym").agg(F.sum("e").alias("f"), F.sum("n").alias("c"))


def w_codes(edges: DataFrame) -> DataFrame:
    """``w``: symbol rank, plus 8 for a first edge."""
    return edges.withColumn("w", F.instr(F.lit(SYMBOLS), F.col("sym")) - 1 + 8 * F.col("first"))


def counts(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.countDistinct("node").alias("n_nodes"))


def fwd(edges: DataFrame) -> DataFrame:
    """(eid, fwd): the last edge of the node that an edge leads to; null for ``$`` edges."""
    target = F.when(F.col("sym") != "$", F.concat(F.expr("substring(node, 2)"), "sym"))
    last = edges.where("last = 1").select(F.col("node").alias("_t"), F.col("eid").alias("fwd"))
    return edges.withColumn("_t", target).join(last, "_t", "left").select("eid", "fwd")


def bwd(edges: DataFrame) -> DataFrame:
    """(eid, bwd): the first-flagged edge that leads to the edge's node; null at the root."""
    into = edges.where("first = 1 and sym <> '$'").select(F.concat(F.expr("substring(node, 2)"), "sym").alias("node"), F.col("eid").alias("bwd"))
    return edges.select("eid", "node").join(into, "node", "left").select("eid", "bwd")


def outgoing(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (node, sym) the edge with that symbol, null where there is none."""
    return wanted.join(edges.select("node", "sym", "eid"), ["node", "sym"], "left")


def find_between(edges: DataFrame, low: int, high: int, sym: str) -> DataFrame:
    """First edge of an id range (inclusive) with a symbol, a flagged one preferred."""
    inside = edges.where(F.col("eid").between(low, high) & (F.col("sym") == sym))
    return inside.orderBy(F.desc("first"), "eid").limit(1)


def node_ranges(edges: DataFrame) -> DataFrame:
    """(node, open, close): first and last edge id of each node; the root is the all-``$`` node."""
    return edges.groupBy("node").agg(F.min("eid").alias("open"), F.max("eid").alias("close"))


def labels(edges: DataFrame) -> DataFrame:
    """(eid, label): node and symbol without padding."""
    return edges.select("eid", F.replace(F.concat("node", "sym"), F.lit("$"), F.lit("")).alias("label"))


def _running(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (eid, sym, _w) with ``rank``: the sum of ``_w`` per symbol up to and at an id, from totals per id range."""
    rows = rows.withColumn("_g", F.floor(F.col("eid") / width))
    ranges = Window.partitionBy("sym").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("sym", "_g").agg(F.sum("_w").alias("_n"))  # at most five rows per range
    before = totals.select("sym", "_g", F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("sym", "_g").orderBy("eid").rangeBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_r", F.sum("_w").over(inside)).join(before, ["sym", "_g"])
    return met.select("eid", "sym", "_w", (F.col("_r") + F.col("_b")).alias("rank"))


def rank_symbol(edges: DataFrame, width: int = 100_000) -> DataFrame:
    """(eid, sym, rank): how many edges with the same symbol come up to this one, from totals per symbol and id range of ``width``."""
    return _running(edges.select("eid", "sym", F.lit(1).alias("_w")), width).drop("_w")


def select_symbol(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (sym, rank) the id of the edge with that rank, null where there is none."""
    return wanted.join(rank_symbol(edges), ["sym", "rank"], "left")


def neighbours(edges: DataFrame, wanted: DataFrame, width: int = 100_000) -> DataFrame:
    """For (eid, sym) the last edge with that symbol at or before the id (``pred``) and the first at or after it (``succ``), else null."""
    own = edges.select("eid", "sym")
    marks = wanted.select("eid", "sym").distinct()
    at = _running(own.withColumn("_w", F.lit(1)).unionByName(marks.withColumn("_w", F.lit(0))), width).where("_w = 0").drop("_w")
    at = at.join(own.withColumn("_hit", F.lit(1)), ["eid", "sym"], "left").withColumn("_next", F.col("rank") + 1 - F.coalesce("_hit", F.lit(0)))
    ranked = rank_symbol(edges, width)
    before = ranked.select("sym", "rank", F.col("eid").alias("pred"))
    after = ranked.select("sym", F.col("rank").alias("_next"), F.col("eid").alias("succ"))
    return at.join(before, ["sym", "rank"], "left").join(after, ["sym", "_next"], "left").select("eid", "sym", "pred", "succ")


def difference_class(edges: DataFrame, k: int) -> DataFrame:
    """(node, sym, class): how an edge's node differs from that of the edge before it in order: SAME_NODE, SAME_BLOCK (only the
    last k - 1 symbols are equal) or NEW. Edges of a block follow each other, so blocks are looked at by themselves."""
    w = Window.partitionBy(F.substring("node", 2, k - 1)).orderBy(F.reverse("node"), "sym")
    before = F.lag("node").over(w)
    return edges.select("node", "sym", F.when(before.isNull(), "NEW").when(before == F.col("node"), "SAME_NODE").otherwise("SAME_BLOCK").alias("class"))


def colour_ids(df: DataFrame, seed: str) -> DataFrame:
    """(seed, colour): dense ids from 1 in the order of the seeds, identical seeds sharing one."""
    seeds = df.select(F.col(seed).alias("seed")).where("seed is not null").distinct()
    return number_rows(seeds, [F.col("seed")], "colour", 1, "colours")


def meta_colours(edges: DataFrame, n_colours: int) -> tuple[DataFrame, DataFrame]:
    """(edges with meta_id, dictionary): a single colour is its own id, larger sets are numbered from ``n_colours``."""
    sets = edges.where(F.size("colours") > 1).select("colours").distinct()
    numbered = number_rows(sets, [F.array_join("colours", ",")], "meta_id", n_colours, "meta-colours")
    joined = edges.join(numbered, "colours", "left")
    return joined.withColumn("meta_id", F.coalesce("meta_id", F.col("colours")[0]).cast("bigint")), numbered.select(F.col("meta_id").cast("bigint"), "colours")


def colour_occurrences(edges: DataFrame) -> DataFrame:
    """(colour, n): edges that carry each colour."""
    return edges.select(F.explode("colours").alias("colour")).groupBy("colour").agg(F.count("*").alias("n"))


def append(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """``right`` behind ``left``: positions continue after the greatest of ``left``."""
    top = left.agg(F.max(order)).first()[0]  # one number
    moved = right.withColumn(order, F.col(order) + F.lit(0 if top is None else top + 1))
    return left.unionByName(moved)


def merge_sorted(kmer_edges: DataFrame, terminal_edges: DataFrame) -> DataFrame:
    """K-mers and terminals in one order; a terminal comes before an equal k-mer."""
    both = terminal_edges.withColumn("is_terminal", F.lit(1)).unionByName(kmer_edges.withColumn("is_terminal", F.lit(0)))
    return both.orderBy(F.reverse("node"), "sym", F.desc("is_terminal"))


def save(edges: DataFrame, path: str, partitions: int | None = None) -> None:
    """Edge table as Parquet, range-partitioned in graph order so that row groups prune by node."""
    ordered = edges.withColumn("colex", F.reverse("node"))
    n = partitions or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered.repartitionByRange(n, "colex", "sym").sortWithinPartitions("colex", "sym").write.mode("errorifexists").parquet(path)


def load(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("colex")


def coverage(edge_rows: DataFrame) -> DataFrame:
    """(node, target, colour, n): how often each colour runs between two nodes."""
    target = F.concat(F.expr("substring(node, 2)"), "sym").alias("target")
    return edge_rows.where("sym <> '$'").select("node", target, "colour").groupBy("node", "target", "colour").agg(F.count("*").alias("n"))
