"""Golden graphs, navigation and classification on small inputs, and properties on random ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandflow.functions import dna, synth
from strandflow.operators import annotations as A
from strandflow.operators import classify as C
from strandflow.operators import graph as G
from strandflow.operators import kmers as K

THREE = """
$$$ A 0 | $$$ C 0 | $$$ G 0 | $$$ T 0 | $$A G 0 | ACA C 1 | TCA $ 0 | $GA C 0 | CGA G 2 | TGA G 3
$TA C 0 | GTA $ 0 | $$C G 0 | CAC T 1 | GAC T 3 | TAC A 1 | TAC T 2 | CTC A 3 | CTC G 2 | GTC $ 0
$$G A 0 | $AG T 0 | GAG T 2,3 | $CG A 0 | TCG $ 0 | $TG A 0 | GTG T 1 | $$T A 0 | $$T G 0 | ACT C 2,3
AGT A 2 | AGT C 3 | AGT G 1 | TGT A 1
"""


def seqs(spark, *rows):
    return spark.createDataFrame([(s, i) for i, s in enumerate(rows, 1)], "seq string, colour long")


def numbered(spark, rows, k, mode="plain"):
    return G.with_ids(G.with_flags(G.build(seqs(spark, *rows), k, mode), k)).cache()


def test_three_contigs(spark):
    e = numbered(spark, ["TACACT", "TACTCG", "GACTCA"], 3, "coloured")
    rows = e.orderBy("eid").collect()
    want = [tuple(x.split()) for line in THREE.strip().splitlines() for x in line.split("|")]
    assert [(r.node, r.sym, ",".join(map(str, r.colours))) for r in rows] == want
    assert [r.eid for r in rows if not r["first"]] == [9, 14, 16, 22, 33]
    o = {r.sym: (r.f, r.c) for r in G.offsets(e).collect()}
    assert [o[s][0] for s in "$ACGT"] == [0, 4, 12, 20, 27]
    assert [o[s][1] for s in "$ACGT"] == [0, 1, 9, 15, 22]
    meta, dictionary = G.meta_colours(e, 4)
    assert [(r.meta_id, r.colours) for r in dictionary.collect()] == [(4, [2, 3])]
    assert {r.meta_id for r in meta.collect()} == {0, 1, 2, 3, 4}


def test_navigation(spark):
    e = numbered(spark, ["GACTCA", "TGAGTC"], 3)
    fwd = {r.eid: r.fwd for r in G.fwd(e).collect()}
    bwd = {r.eid: r.bwd for r in G.bwd(e).collect()}
    label = {r.eid: r.label for r in G.labels(e).collect()}
    assert (fwd[0], fwd[1], fwd[4], fwd[2]) == (8, 11, 9, None)
    assert (bwd[9], bwd[8], bwd[11], bwd[0]) == (4, 0, 1, None)
    assert (label[6], label[7], label[8], label[0]) == ("CTCA", "GTC", "GA", "G")
    ranges = {r.node: (r.open, r.close) for r in G.node_ranges(e).collect()}
    assert ranges["$$$"][0] == 0


def test_repeated_record_has_one_colour(spark):
    s = "GTGTCGGAGGCTCCATCGACATGGAACGAGCGGTGGCAAGAAGTTACTAATGAGCTGCTG"
    e = G.build(spark.createDataFrame([(s, 1), (s, 1)], "seq string, colour long"), 9, "coloured")
    o = {r.sym: (r.f, r.c) for r in G.offsets(e).collect()}
    assert e.count() == 122 and [o[x] for x in "$ACGT"] == [(0, 0), (2, 1), (29, 28), (62, 61), (95, 94)]
    assert {tuple(r.colours) for r in e.select("colours").distinct().collect()} == {(0,), (1,)}
    once = G.build(seqs(spark, s), 9)
    twice = G.build(spark.createDataFrame([(s, 1), (s, 1)], "seq string, colour long"), 9)
    assert once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0


def test_merge_fixture(spark):
    ref, query = numbered(spark, ["TACACTNTACTCG"], 3), numbered(spark, ["GACTCA"], 3)
    assert G.counts(ref).first().asDict() == {"n_edges": 23, "n_nodes": 19}
    got = [r.ref_eid for r in C.classify(query.select("node", "sym", "eid"), ref.select("node", "sym", "eid")).orderBy("eid").collect()]
    assert got == [-1, 2, -1, -1, -1, -1, -1, -1, -1, 14, -1, -1, 19, -1]
    self_hits = C.classify(ref.select("node", "sym", "eid"), ref.select("node", "sym", "eid"))
    assert self_hits.where("eid <> ref_eid").count() == 0


@pytest.mark.parametrize("rows", [["ACGTACGT"], ["AAAAAA"], ["CCCCCCCC"], ["ATGC" * 25], [""], ["AC"], None])
def test_both_strand_counts(spark, rows):
    rng = random.Random(11)
    rows = rows if rows is not None else ["".join(rng.choice("AC") if rng.random() < 0.3 else rng.choice("ACGT") for _ in range(200)) for _ in range(4)]
    want = Counter()
    for s in rows:
        for x in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))):
            want.update(x[i : i + 5] for i in range(len(x) - 4))
    got = {r.kmer: r.n for r in K.count_kmers(seqs(spark, *rows), 5).collect()}
    assert got == dict(want)
    edges = {r.node + r.sym: r.n for r in G.build(seqs(spark, *rows), 4, "weighted").collect() if "$" not in r.node + r.sym}
    assert edges == dict(want)


def test_single_change_misses_few_edges(spark):
    rng = random.Random(4)
    k, s = 12, synth.sequence(3000, rng)
    changed = s[:1500] + ("A" if s[1500] != "A" else "C") + s[1501:]
    q, r = (G.with_ids(G.build(seqs(spark, x), k)).select("node", "sym", "eid") for x in (changed, s))
    missing = C.classify(q, r).where("ref_eid = -1").count()
    assert 0 < missing < 4 * k


def test_chunks_hold_the_same_kmers(spark):
    rng = random.Random(5)
    df = seqs(spark, *[synth.sequence(n, rng) for n in (5, 40, 41, 333)])
    k = 7
    whole = Counter(r.kmer for r in K.kmers(df, k).collect())
    parts = Counter(r.kmer for r in K.kmers(K.chunks(df, 40, k - 1), k).collect())
    assert whole == parts
    assert [K.chunk_bounds(10, 4, i) for i in range(4)] == [(0, 3), (3, 6), (6, 8), (8, 10)]
    with pytest.raises(IndexError):
        K.chunk_bounds(3, 0, 0)


def test_suffix_positions(spark):
    for s in (1, 3):
        names = [dna.suffix_from_index(i, s) for i in range(dna.suffix_count(s))]
        assert names == sorted(names, key=lambda x: x[::-1]) and len(set(names)) == len(names)
        df = spark.createDataFrame([(n,) for n in names], "x string").select("x", dna.suffix_index(F.col("x"), s).alias("i"))
        assert {r.x: r.i for r in df.collect()} == {n: i for i, n in enumerate(names)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 9, 3)] + [("b", 7), ("c", None)], "g string, x int")
    assert {r.g: r.median for r in K.upper_median(df, "x", ["g"]).collect()} == {"a": 5, "b": 7}


def test_save_and_load(spark, tmp_path):
    e = G.build(seqs(spark, "TACACT"), 3)
    G.save(e, f"{tmp_path}/g", 2)
    assert G.load(spark, f"{tmp_path}/g").exceptAll(e).count() == 0


# --- annotated intervals --------------------------------------------------------------------------------------------

CONTIGS = [("genome1", "ACGAGNCGGTGGCAANGAAGTTN"), ("genome2", "GTGTCGGAGGNCTCCATCGAC")]
FEATURES = [  # 0-based half open
    ("genome1", 0, 5, "+", "1"), ("genome1", 16, 23, "+", "2"), ("genome1", 10, 16, "-", "3"),
    ("genome2", 0, 6, "+", "4"), ("genome2", 1, 10, "+", "5"), ("genome2", 0, 14, "-", "6"),
]
GOLDEN = {
    ("genome1", "+"): [[[0], [0], [0], [1], [1]], [[0]] * 9, [[0], [0], [0], [2], [2], [2]]],
    ("genome1", "-"): [[[0]] * 6, [[0]] * 3 + [[3], [3]] + [[0]] * 4, [[0]] * 5],
    ("genome2", "+"): [[[0], [0], [0], [4], [4, 5], [4, 5], [5], [5], [5], [5]], [[0]] * 10],
    ("genome2", "-"): [[[0]] * 10, [[0]] * 3 + [[6]] * 7],
}


@pytest.mark.parametrize("bucket", [3, 4096])
def test_edge_colours_of_annotations(spark, bucket, monkeypatch):
    monkeypatch.setattr(A.overlap_join, "__defaults__", (bucket,))
    contigs = spark.createDataFrame(CONTIGS, "seqid string, seq string")
    feats = spark.createDataFrame(FEATURES, "seqid string, begin long, end long, strand string, seed string").withColumn("colour", F.col("seed").cast("long"))
    frags = A.fragments_of(contigs, 3)
    tokens = A.clip(frags, A.flip(feats, contigs.select("seqid", F.length("seq").alias("length"))), 4)
    rows = A.coloured_edges(frags, tokens, 3).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.frag_no, r.p, r.colour)):
        if r.sym != "$":
            got.setdefault((r.seqid, r.strand), {}).setdefault(r.frag_no, {}).setdefault(r.p, []).append(r.colour)
    assert {k: [list(f.values()) for f in v.values()] for k, v in got.items()} == GOLDEN
    edges, colours = A.gff_graph(feats.withColumn("seed", F.concat("seqid", F.lit("-"), "seed")).drop("colour"), contigs, 3)
    assert colours.count() == 6 and edges.count() > 0


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(8)
    make = lambda: [(rng.choice("xy"), b, b + rng.randrange(0, 60)) for b in (rng.randrange(300) for _ in range(80))]
    left, right = make(), make()
    a = spark.createDataFrame(left, "k string, begin long, end long")
    b = spark.createDataFrame(right, "k string, r_begin long, r_end long")
    want = Counter((k, x, y, p, q) for k, x, y in left for j, p, q in right if j == k and x < y and p < q and p < y and q > x)
    assert Counter((r.k, r.begin, r.end, r.r_begin, r.r_end) for r in A.overlap_join(a, b, ["k"], 16).collect()) == want
