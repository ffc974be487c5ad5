"""Sequence, k-mer, graph and classification queries over ``documents``.

Each text is read whole and encoded as 64 bases; the queries that end in ``_text`` have a base for each of its characters.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.functions import dna
from strandflow.functions.session import broadcast_if_small, table
from strandflow.operators import classify as C
from strandflow.operators import graph as G
from strandflow.operators import kmers as K
from strandflow.operators import sketch as S

KMER, NODE, SUFFIX = 11, 6, 4
#: Nodes of 6 bases saturate: 4^7 unpadded edges, reached at sf0.1. Every graph query also runs on nodes of this length.
LONG_NODE = 21
HEX = "0123456789abcdef"
#: Characters of a text that stand for a base; any other is N.
CHARACTERS = "\n" + "".join(map(chr, range(32, 127)))
TEXT_K, TEXT_SCALED, TEXT_CHUNK = 21, 100, 240


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, lang, seq, colour); colour numbers the sources from 1."""
    docs = table(spark, d, "documents").where("text is not null")
    seq = F.translate(F.concat(F.md5("text"), F.md5(F.concat("text", F.lit("x")))), HEX, "ACGT" * 4)
    rows = docs.select("doc_id", "source", "lang", seq.alias("seq"))
    return rows.join(broadcast_if_small(_colours(docs), 100_000), "source")


def _colours(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.lit(1)).select("source", F.dense_rank().over(_by_source()).cast("bigint").alias("colour"))


def text_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, seq) with a base, or N, for each character of the text."""
    seq = F.regexp_replace(F.translate("text", CHARACTERS, "ACGT" * (len(CHARACTERS) // 4)), "[^ACGT]", "N")
    return table(spark, d, "documents").where("text is not null").select("doc_id", seq.alias("seq"))


def _by_source():
    from pyspark.sql import Window

    return Window.orderBy("source")  # a handful of sources


def _graph(spark, d, mode, k, flags=False):
    return G.build(sequences(spark, d), k, mode, flags=flags)


def _numbered(spark, d, k, mode="plain"):
    return G.with_ids(_graph(spark, d, mode, k, flags=True))


def revcomp(spark, d):
    s = sequences(spark, d)
    return s.select("doc_id", dna.reverse_complement(F.col("seq")).alias("rc"), dna.canonical(F.col("seq")).alias("canon"), dna.gc_count(F.col("seq")).alias("gc"))


def dna_ranks(spark, d):
    s = sequences(spark, d)
    head = F.substring("seq", 1, 8)
    return s.select("doc_id", dna.rank4(F.col("seq")).alias("ranks"), dna.rank5(F.concat(F.lit("$"), "seq")).alias("ranks5"), dna.pack(head).alias("packed"), dna.suffix_index(F.substring("seq", 61, 4), 4).alias("suffix_index"))


def bit_widths(spark, d):
    x = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", dna.floor_log2(x).alias("fl"), dna.ceil_log2(x).alias("cl"), dna.bits_required(x).alias("bits"), dna.bytes_required(x).alias("bytes"))


def split_non_acgt(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    parts = dna.fragments(F.col("text"), 3, "ACGT")
    return docs.select("doc_id", F.size(parts).alias("n_fragments"), F.array_join(parts, ",").alias("fragments"))


def kmer_count_both_strands(spark, d):
    return K.count_kmers(sequences(spark, d), KMER)


def kmer_count_packed(spark, d):
    return K.count_kmers(sequences(spark, d), 2 * KMER)


def kmer_count_canonical(spark, d):
    return K.count_kmers(sequences(spark, d), KMER, canonical=True)


def kmer_colour_sets(spark, d):
    rows = K.kmers(K.strands(sequences(spark, d).select("seq", "source")), KMER).distinct()
    return rows.groupBy("kmer").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def kmer_overview(spark, d):
    """Per k-mer its occurrences on both strands and the sources it occurs in: one aggregation over occurrences."""
    rows = K.kmers(K.strands(sequences(spark, d).select("seq", "source")), KMER)
    per = rows.groupBy("kmer", "source").agg(F.count("*").alias("n"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def suffix_histogram(spark, d):
    return K.suffix_histogram(sequences(spark, d), KMER, SUFFIX, by=["source"])


def suffix_plan_cumulative(spark, d):
    return K.suffix_plan(suffix_histogram(spark, d), "source")


def kmers_by_suffix(spark, d):
    return K.filter_by_suffix(kmer_count_both_strands(spark, d), "ACGT")


def terminals(spark, d, k=NODE):
    return K.terminals(K.strands(sequences(spark, d).select("seq")), k)


def terminals_dense(spark, d):
    return K.terminals(K.strands(sequences(spark, d).select("seq")), NODE, below=3)


def size_statistics(spark, d):
    return K.size_stats(sequences(spark, d), KMER, ["source"])


def median_length(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("source", F.length("text").alias("n"))
    return K.upper_median(docs, "n", ["source"])


def chunks_with_overlap(spark, d):
    out = K.chunks(sequences(spark, d).select("doc_id", "seq"), 24, KMER)
    return out.select("doc_id", "piece_no", "seq", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


def kmer_count_text(spark, d):
    return K.count_kmers(text_sequences(spark, d), KMER)


def sketch_text(spark, d):
    return S.sketch(text_sequences(spark, d), TEXT_K, TEXT_SCALED, "doc_id")


def chunks_text(spark, d):
    out = K.chunks(K.fragments(text_sequences(spark, d), KMER), TEXT_CHUNK, KMER)
    return out.select("doc_id", "piece_no", "seq", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


def ntile_chunks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(7).over(w).alias("chunk"))


def dbg_edges(spark, d, k=NODE):
    return _graph(spark, d, "plain", k, flags=True)


def dbg_edge_ids(spark, d, k=NODE):
    e = G.w_codes(_numbered(spark, d, k))
    return e.select("eid", "node", "sym", "w")


def dbg_counts(spark, d, k=NODE):
    return _graph(spark, d, "weighted", k)


def dbg_colours(spark, d, k=NODE):
    return _graph(spark, d, "coloured", k).select("node", "sym", F.array_join("colours", ",").alias("colours"))


def meta_colours(spark, d, k=NODE):
    edges, _ = G.meta_colours(_graph(spark, d, "coloured", k), 10)
    return edges.select("node", "sym", "meta_id")


def colour_occurrence(spark, d, k=NODE):
    return G.colour_occurrences(_graph(spark, d, "coloured", k))


def dbg_f_c(spark, d, k=NODE):
    return G.offsets(_graph(spark, d, "plain", k))


def dbg_size(spark, d, k=NODE):
    return G.counts(_graph(spark, d, "plain", k))


def dbg_fwd(spark, d, k=NODE):
    return G.fwd(_numbered(spark, d, k))


def dbg_bwd(spark, d, k=NODE):
    return G.bwd(_numbered(spark, d, k))


def dbg_outgoing(spark, d, k=NODE):
    e = _numbered(spark, d, k)
    return G.outgoing(e, e.select("node", F.lit("G").alias("sym")).distinct())


def dbg_find_between(spark, d, k=NODE):
    """The edge with symbol T that a search in one id range meets first."""
    return G.find_between(_numbered(spark, d, k), 100, 400, "T").select("eid", "node", "sym", "first")


def dbg_append(spark, d, k=NODE):
    """Edges of two graphs in one numbering, the second behind the first."""
    q, r = _query_and_reference(spark, d)
    one, two = (G.with_ids(G.build(x, k)).select("eid", "node", "sym") for x in (q, r))
    return G.append(one, two, "eid")


def dbg_node_ranges(spark, d, k=NODE):
    return G.node_ranges(_numbered(spark, d, k))


def dbg_labels(spark, d, k=NODE):
    return G.labels(_numbered(spark, d, k))


def dbg_rank(spark, d, k=NODE):
    return G.rank_symbol(_numbered(spark, d, k))


def dbg_difference_class(spark, d, k=NODE):
    return G.difference_class(_graph(spark, d, "plain", k), k)


def dbg_coverage(spark, d, k=NODE):
    rows = K.edges(K.strands(sequences(spark, d).select("seq", "colour")), k)
    return G.coverage(rows)


def dbg_merge_order(spark, d, k=NODE):
    frags = K.strands(sequences(spark, d).select("seq"))
    t = K.terminals(frags, k)
    e = _graph(spark, d, "plain", k).where(~F.col("node").contains("$"))
    return G.merge_sorted(e, t)


def _query_and_reference(spark, d):
    s = sequences(spark, d)
    return s.where("lang = 'python'"), s.where("lang <> 'python' or lang is null")


def classify_left_join(spark, d, k=NODE):
    q, r = _query_and_reference(spark, d)
    return C.classify(G.with_ids(G.build(q, k)), G.with_ids(G.build(r, k)).select("node", "sym", "eid"))


def accumulate(spark, d, k=NODE):
    q, r = _query_and_reference(spark, d)
    return C.accumulate(G.build(q, k, "weighted"), G.build(r, k, "coloured"))


def accumulate_depths(spark, d, k=NODE):
    return C.colour_depths(accumulate(spark, d, k))


_FUNCTIONS = (
    revcomp, dna_ranks, bit_widths, split_non_acgt, kmer_count_both_strands, kmer_count_packed, kmer_count_canonical, kmer_colour_sets, kmer_overview, suffix_histogram,
    suffix_plan_cumulative, kmers_by_suffix, terminals, terminals_dense, size_statistics, median_length, chunks_with_overlap, kmer_count_text, sketch_text, chunks_text, ntile_chunks, dbg_edges, dbg_edge_ids,
    dbg_counts, dbg_colours, meta_colours, colour_occurrence, dbg_f_c, dbg_size, dbg_fwd, dbg_bwd, dbg_outgoing, dbg_find_between, dbg_append, dbg_node_ranges, dbg_labels, dbg_rank,
    dbg_difference_class, dbg_coverage, dbg_merge_order, classify_left_join, accumulate, accumulate_depths,
)
_GRAPH = (
    terminals, dbg_edges, dbg_edge_ids, dbg_counts, dbg_colours, meta_colours, colour_occurrence, dbg_f_c, dbg_size, dbg_fwd, dbg_bwd, dbg_outgoing, dbg_find_between,
    dbg_append, dbg_node_ranges, dbg_labels, dbg_rank, dbg_difference_class, dbg_coverage, dbg_merge_order, classify_left_join, accumulate, accumulate_depths,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {f"{f.__name__}_k{LONG_NODE}": partial(f, k=LONG_NODE) for f in _GRAPH}

_S = f"""
s AS (
  SELECT doc_id, source, lang, translate(md5(text) || md5(text || 'x'), '{HEX}', '{"ACGT" * 4}') AS seq, dense_rank() OVER (ORDER BY source) AS colour
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"""
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_BOTH = f"both_ AS (SELECT doc_id, source, lang, colour, unnest([seq, {_RC.format('seq')}]) AS seq FROM s)"


_QUOTED = CHARACTERS.replace("'", "''")
_TEXT = f"""ts AS (
  SELECT doc_id, unnest(string_split(regexp_replace(translate(text, '{_QUOTED}', '{"ACGT" * (len(CHARACTERS) // 4)}'), '[^ACGT]', 'N', 'g'), 'N')) AS seq FROM documents WHERE text IS NOT NULL)"""
_STEP = TEXT_CHUNK - KMER


def _edge_rows(k: int, source: str = "both_", name: str = "rows_") -> str:
    pad = "$" * k
    return f"""{name}0 AS (SELECT *, unnest(range(1, length(seq) + 2)) AS i FROM {source}),
{name} AS (SELECT source, lang, colour, substr('{pad}' || seq || '$', i, {k}) AS node, substr('{pad}' || seq || '$', i + {k}, 1) AS sym FROM {name}0)"""


def _edge_table(rows: str = "rows_", name: str = "e") -> str:
    return f"""{name}0 AS (
  SELECT node, sym, count(*) AS n, list_sort(list_distinct(list(CASE WHEN contains(node, '$') OR sym = '$' THEN 0 ELSE colour END))) AS colours FROM {rows} GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, bool_or(sym <> '$') OVER (PARTITION BY node) AS real FROM {name}0) WHERE sym <> '$' OR NOT real)"""


_KM = f"km AS (SELECT source, substr(seq, i, {KMER}) AS kmer FROM (SELECT source, seq, unnest(range(1, length(seq) - {KMER} + 2)) AS i FROM {{}}))"
_HIST = f"h AS (SELECT source, substr(kmer, {KMER - SUFFIX + 1}, {SUFFIX}) AS suffix, count(*) AS n FROM km GROUP BY 1, 2)"
def _term(k: int) -> str:
    return f"""t AS (SELECT DISTINCT repeat('$', {k} - i) || substr(seq, 1, i) AS node, substr(seq, i + 1, 1) AS sym FROM (SELECT seq, unnest(range(0, {{}})) AS i FROM both_))"""


def _graph_sql(k: int) -> dict[str, str]:
    """SQL of the graph and classification queries on nodes of ``k`` bases."""
    base = f"WITH {_S}, {_BOTH}, {_edge_rows(k)}, {_edge_table()}"
    num = f"""{base}, x AS (
  SELECT node, sym, row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid,
    CAST(row_number() OVER (PARTITION BY substr(node, 2), sym ORDER BY reverse(node)) = 1 AS INT) AS first,
    CAST(row_number() OVER (PARTITION BY node ORDER BY sym DESC) = 1 AS INT) AS last
  FROM e)"""
    classify = f"""WITH {_S}, {_BOTH},
qs AS (SELECT * FROM both_ WHERE lang = 'python'), rs AS (SELECT * FROM both_ WHERE lang <> 'python' OR lang IS NULL),
{_edge_rows(k, 'qs', 'qr')}, {_edge_rows(k, 'rs', 'rr')}, {_edge_table('qr', 'q')}, {_edge_table('rr', 'r')}"""
    return {
        "dbg_find_between": f"{num} SELECT eid, node, sym, first FROM x WHERE eid BETWEEN 100 AND 400 AND sym = 'T' ORDER BY first DESC, eid LIMIT 1",
        "dbg_append": f"""{classify} SELECT row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid, node, sym FROM q
UNION ALL SELECT row_number() OVER (ORDER BY reverse(node), sym) - 1 + (SELECT count(*) FROM q), node, sym FROM r""",
        "terminals": f"WITH {_S}, {_BOTH}, {_term(k).format(k)} SELECT node, sym FROM t",
        "dbg_edges": f"{num} SELECT node, sym, first, last FROM x",
        "dbg_edge_ids": f"{num} SELECT eid, node, sym, CAST(instr('$ACGT', sym) - 1 + 8 * first AS INT) AS w FROM x",
        "dbg_counts": f"{base} SELECT node, sym, n FROM e",
        "dbg_colours": f"{base} SELECT node, sym, array_to_string(colours, ',') AS colours FROM e",
        "meta_colours": f"""{base}, m AS (SELECT colours, row_number() OVER (ORDER BY array_to_string(colours, ',')) + 9 AS id FROM (SELECT DISTINCT colours FROM e WHERE len(colours) > 1))
SELECT node, sym, coalesce(m.id, e.colours[1]) AS meta_id FROM e LEFT JOIN m ON e.colours = m.colours""",
        "colour_occurrence": f"{base} SELECT colour, count(*) AS n FROM (SELECT unnest(colours) AS colour FROM e) GROUP BY 1",
        "dbg_f_c": f"""{base}, sy AS (SELECT unnest(['$', 'A', 'C', 'G', 'T']) AS sym)
SELECT sym, (SELECT count(*) FROM e WHERE right(node, 1) < sy.sym) AS f, (SELECT count(DISTINCT node) FROM e WHERE right(node, 1) < sy.sym) AS c FROM sy""",
        "dbg_size": f"{base} SELECT count(*) AS n_edges, count(DISTINCT node) AS n_nodes FROM e",
        "dbg_fwd": f"{num} SELECT a.eid, b.eid AS fwd FROM x a LEFT JOIN x b ON a.sym <> '$' AND b.last = 1 AND b.node = substr(a.node, 2) || a.sym",
        "dbg_bwd": f"{num} SELECT a.eid, b.eid AS bwd FROM x a LEFT JOIN x b ON b.first = 1 AND b.sym <> '$' AND a.node = substr(b.node, 2) || b.sym",
        "dbg_outgoing": f"{num} SELECT n.node, 'G' AS sym, x.eid FROM (SELECT DISTINCT node FROM x) n LEFT JOIN x ON x.node = n.node AND x.sym = 'G'",
        "dbg_node_ranges": f"{num} SELECT node, min(eid) AS open, max(eid) AS close FROM x GROUP BY 1",
        "dbg_labels": f"{num} SELECT eid, replace(node || sym, '$', '') AS label FROM x",
        "dbg_rank": f"{num} SELECT eid, sym, count(*) OVER (PARTITION BY sym ORDER BY eid) AS rank FROM x",
        "dbg_difference_class": f"""{base}, g AS (SELECT node, sym, lag(node) OVER (ORDER BY reverse(node), sym) AS b FROM e)
SELECT node, sym, CASE WHEN b = node THEN 'SAME_NODE' WHEN substr(b, 2) = substr(node, 2) THEN 'SAME_BLOCK' ELSE 'NEW' END AS class FROM g""",
        "dbg_coverage": f"WITH {_S}, {_BOTH}, {_edge_rows(k)} SELECT node, substr(node, 2) || sym AS target, colour, count(*) AS n FROM rows_ WHERE sym <> '$' GROUP BY ALL",
        "dbg_merge_order": f"{base}, {_term(k).format(k)} SELECT node, sym, 1 AS is_terminal FROM t UNION ALL SELECT node, sym, 0 FROM e WHERE NOT contains(node, '$')",
        "classify_left_join": f"""{classify}, qn AS (SELECT node, sym, row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid FROM q),
rn AS (SELECT node, sym, row_number() OVER (ORDER BY reverse(node), sym) - 1 AS eid FROM r)
SELECT node, sym, qn.eid, coalesce(rn.eid, -1) AS ref_eid FROM qn LEFT JOIN rn USING (node, sym)""",
        "accumulate": f"{classify} SELECT node, sym, unnest(r.colours) AS colour, q.n AS depth FROM q JOIN r USING (node, sym)",
        "accumulate_depths": f"{classify}, a AS (SELECT unnest(r.colours) AS colour, q.n AS depth FROM q JOIN r USING (node, sym)) SELECT colour, count(*) AS n_edges, CAST(sum(depth) AS BIGINT) AS depth FROM a GROUP BY 1",
    }


SQL = {
    "revcomp": f"""WITH {_S} SELECT doc_id, {_RC.format('seq')} AS rc, least(seq, {_RC.format('seq')}) AS canon,
  CAST(length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS INT) AS gc FROM s""",
    "dna_ranks": f"""WITH {_S}, r AS (SELECT doc_id, translate(seq, 'ACGT', '0123') AS ranks FROM s)
SELECT doc_id, ranks, '0' || translate(ranks, '0123', '1234') AS ranks5,
  CAST(list_sum(list_transform(range(1, 9), lambda i: CAST(substr(ranks, i, 1) AS BIGINT) * CAST(pow(4, i - 1) AS BIGINT))) AS BIGINT) AS packed,
  CAST(4 + list_sum(list_transform(range(1, 5), lambda i: CAST(substr(ranks, 65 - i, 1) AS BIGINT) * [85, 21, 5, 1][i])) AS BIGINT) AS suffix_index FROM r""",
    "bit_widths": """SELECT o_orderkey, length(bin(o_orderkey)) - 1 AS fl, CASE WHEN o_orderkey <= 1 THEN 0 ELSE length(bin(o_orderkey - 1)) END AS cl,
  greatest(1, length(bin(o_orderkey))) AS bits, CAST(ceil(greatest(1, length(bin(o_orderkey))) / 8) AS INT) AS bytes FROM orders""",
    "split_non_acgt": """WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(upper(text), '[^ACGT]+'), lambda x: length(x) >= 3) AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(parts) AS n_fragments, array_to_string(parts, ',') AS fragments FROM p""",
    "kmer_count_both_strands": f"WITH {_S}, {_BOTH}, {_KM.format('both_')} SELECT kmer, count(*) AS n FROM km GROUP BY 1",
    "kmer_count_packed": f"WITH {_S}, {_BOTH}, {_KM.format('both_').replace(str(KMER), str(2 * KMER))} SELECT kmer, count(*) AS n FROM km GROUP BY 1",
    "kmer_count_canonical": f"WITH {_S}, {_KM.format('s')} SELECT least(kmer, {_RC.format('kmer')}) AS kmer, count(*) AS n FROM km GROUP BY 1",
    "kmer_colour_sets": f"WITH {_S}, {_BOTH}, {_KM.format('both_')} SELECT kmer, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM km GROUP BY 1",
    "kmer_overview": f"WITH {_S}, {_BOTH}, {_KM.format('both_')} SELECT kmer, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM km GROUP BY 1",
    "suffix_histogram": f"WITH {_S}, {_KM.format('s')}, {_HIST} SELECT source, suffix, n FROM h",
    "suffix_plan_cumulative": f"""WITH {_S}, {_KM.format('s')}, {_HIST}, u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY suffix ORDER BY source) AS BIGINT) AS until FROM h)
SELECT source, suffix, n, until, until - n AS "from" FROM u""",
    "kmers_by_suffix": f"WITH {_S}, {_BOTH}, {_KM.format('both_')} SELECT kmer, count(*) AS n FROM km WHERE kmer LIKE '%ACGT' GROUP BY 1",
    "terminals_dense": f"WITH {_S}, {_BOTH}, {_term(NODE).format(3)} SELECT node, sym FROM t",
    "size_statistics": f"""WITH {_S} SELECT source, count(*) AS n_fragments, CAST(sum(length(seq)) AS BIGINT) AS n_symbols, CAST(sum(length(seq) - {KMER} + 1) AS BIGINT) AS n_kmers,
  CAST(sum(length(seq) - {KMER}) AS BIGINT) AS n_edges, count(*) * {KMER} AS n_terminals FROM s GROUP BY 1""",
    "median_length": """SELECT source, l[CAST(floor(len(l) / 2) AS BIGINT) + 1] AS median FROM (
  SELECT source, list_sort(list(length(text))) AS l FROM documents WHERE text IS NOT NULL GROUP BY 1)""",
    "chunks_with_overlap": f"""WITH {_S}, c AS (SELECT doc_id, seq, unnest(range(0, CAST(ceil((64 - {KMER}) / 13.0) AS BIGINT))) AS piece_no FROM s)
SELECT doc_id, piece_no, substr(seq, piece_no * 13 + 1, CASE WHEN piece_no = 4 THEN 64 ELSE 24 END) AS seq, CAST(piece_no = 0 AS INT) AS first, CAST(piece_no = 4 AS INT) AS last FROM c""",
    "kmer_count_text": f"WITH {_TEXT}, tb AS (SELECT NULL AS source, unnest([seq, {_RC.format('seq')}]) AS seq FROM ts), {_KM.format('tb')} SELECT kmer, count(*) AS n FROM km GROUP BY 1",
    "sketch_text": f"""WITH {_TEXT}, w AS (SELECT doc_id, substr(seq, i, {TEXT_K}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {TEXT_K} + 2)) AS i FROM ts))
SELECT DISTINCT doc_id, hash FROM (SELECT doc_id, substr(md5(least(kmer, {_RC.format('kmer')})), 1, 16) AS hash FROM w) WHERE hash < '{S.max_hash(TEXT_SCALED)}'""",
    "chunks_text": f"""WITH {_TEXT}, n AS (SELECT doc_id, seq, CAST(greatest(ceil((length(seq) - {KMER}) / {_STEP}.0), 1) AS BIGINT) AS pieces FROM ts WHERE length(seq) >= {KMER}),
c AS (SELECT *, unnest(range(0, pieces)) AS piece_no FROM n)
SELECT doc_id, piece_no, CASE WHEN piece_no = pieces - 1 THEN substr(seq, piece_no * {_STEP} + 1) ELSE substr(seq, piece_no * {_STEP} + 1, {TEXT_CHUNK}) END AS seq,
  CAST(piece_no = 0 AS INT) AS first, CAST(piece_no = pieces - 1 AS INT) AS last FROM c""",
    "ntile_chunks": "SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS chunk FROM orders",
    **_graph_sql(NODE),
    **{f"{name}_k{LONG_NODE}": text for name, text in _graph_sql(LONG_NODE).items()},
}
