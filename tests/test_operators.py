"""State machine, clusters, index, catalogue, taxonomy, metrics, streams and fixtures."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strandflow.functions import synth
from strandflow.operators import annotations as A
from strandflow.operators import catalog, cluster, manifest, metrics, sketch, taxonomy
from strandflow.plans.runner import Runner
from strandflow.streaming import kmer_stream



def test_state_machine(spark):
    NOW = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    m = spark.createDataFrame([], manifest.SCHEMA)
    rec = lambda *a: spark.createDataFrame([(x, "7") for x in a], "accession string, taxid string")
    acc = lambda *a: spark.createDataFrame([(x,) for x in a], "accession string")
    m, steps = manifest.reserve(m, rec(" A", "B"), "p1", NOW)
    assert {(r.accession, r.action) for r in steps.collect()} == {("A", "new"), ("B", "new")}
    with pytest.raises(ValueError, match="occupied"):
        manifest.reserve(m, rec("A"), "p2", NOW)
    m = manifest.mark_complete(m, acc("A"), "p1", NOW)
    m = manifest.mark_failed(m, acc("B"), "p1", "broken")
    assert {r.state: r.n for r in manifest.counts(m).collect()} == {"complete": 1, "failed": 1}
    with pytest.raises(ValueError, match="complete"):
        manifest.reserve(m, rec("A", "B"), "p2", NOW)
    m, _ = manifest.reserve(m, rec("A", "B"), "p2", NOW, fail_if_complete=False)
    assert [(r.accession, r.state, r.error) for r in manifest.listing(m).collect()] == [("A", "complete", None), ("B", "cleaning", None)]
    with pytest.raises(Exception, match="not cleaning"):
        manifest.finish_cleanup(m, acc("B"), "p1").collect()
    m2 = manifest.finish_cleanup(m, acc("B"), "p2")
    assert manifest.listing(m2, "reserved").count() == 1
    assert manifest.listing(manifest.fail_cleanup(m, acc("B"), "p2", "x"), "failed").first().error == "x"
    with pytest.raises(Exception, match="not reserved"):
        manifest.mark_complete(m2, acc("Z"), "p2", NOW).collect()
    assert manifest.taxonomy(m).collect()[0].accession == "A"
    for bad in ([("A", "1"), (" A ", "1")], [("", "1")], [("A", None)]):
        with pytest.raises(Exception, match="accession|taxid"):
            manifest.check_records(spark.createDataFrame(bad, "accession string, taxid string")).collect()
    with pytest.raises(ValueError):
        manifest.check_version(2)


@pytest.mark.parametrize("seed", [1, 2])
def test_connected(spark, seed):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(80):02}", f"v{rng.randrange(80):02}") for _ in range(50)] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(25)] + [("hub", f"z{i}") for i in range(20)] + [(None, "v00")]
    parent = {v: v for e in edges for v in e if v}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a and b and a != b for v in (a, b)}
    got = {r.member: r.root for r in cluster.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in linked}


def test_clusters_keep_everybody(spark):
    e = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.96), ("d", "e", 0.5)], "a string, b string, m double")
    people = spark.createDataFrame([(x,) for x in "abcdef"], "accession string")
    rows = {r.accession: r.cluster_id for r in cluster.numbered(cluster.clusters_at(e, people, "m", 0.96)).collect()}
    assert rows == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 2, "f": 3}
    assert {r.accession for r in cluster.new_singletons(e, "m", 0.96).collect()} == {"d", "e"}
    c = spark.createDataFrame([(k, v) for k, v in rows.items()], "accession string, cluster_id int")
    assert cluster.missing_members(e, c).count() == 0 and cluster.missing_members(e, c.where("accession <> 'a'")).count() == 1
    tagged = cluster.refine(e, people, "m", [0.96, 0.99], done=[0.99])
    assert [r.tag for r in tagged.select("tag").distinct().collect()] == ["ani0.96"]
    s = cluster.size_stats(tagged).first()
    assert (s.min_size, s.median_size, s.max_size) == (1, 1, 3)
    assert cluster.members(c, ["cluster_id"]).where("cluster_id = 0").first().members == "a,b,c"
    d = cluster.digests(c, ["cluster_id"])
    assert cluster.changed(d, d, ["cluster_id"]).count() == 0
    with pytest.raises(ValueError):
        cluster.refine(e, people, "m", [0.99], done=[0.99])
    tag = lambda *x: spark.createDataFrame([(t,) for t in x], "tag string")
    assert cluster.tag_for_rank(tag("genus", "species"), tag("genus", "ani0.95")) == "genus"
    with pytest.raises(ValueError):
        cluster.tag_for_rank(tag("genus"), tag("ani0.95"))
    cluster.check_filter_tag("ani0.99", "ani0.95")
    with pytest.raises(ValueError):
        cluster.check_filter_tag("ani0.9", "ani0.95")


def test_index(spark):
    rec = spark.createDataFrame([("g1", "g1-a", "SO:1,Uni:x:y"), ("g1", "g1-a", "SO:1"), ("g2", "g2-b", None), ("g3", None, "SO:9")], "accession string, seed_name string, dbxref string")
    idx = A.build_index(rec)
    assert idx["seed"].count() == 2
    assert {tuple(r) for r in idx["annotation"].collect()} == {("g1-a", "SO", "1"), ("g1-a", "Uni", "x:y")}
    asked = spark.createDataFrame([("g1-a",), ("nope",)], "seed_name string")
    assert {r.seed_name: r.annotations for r in A.annotations_of(asked, idx["annotation"]).collect()} == {"g1-a": {"SO": ["1"], "Uni": ["x:y"]}, "nope": {}}
    tax = spark.createDataFrame([("g1", "7")], "accession string, taxid string")
    assert {tuple(r) for r in A.seed_info(asked, idx["seed"], tax).collect()} == {("g1-a", "g1", "7"), ("nope", None, None)}
    assert [r.database for r in A.databases(idx["annotation"]).collect()] == ["SO", "Uni"]
    with pytest.raises(Exception, match="several accessions"):
        A.build_index(rec.unionByName(spark.createDataFrame([("g9", "g1-a", None)], rec.schema)))["seed"].collect()
    new = spark.createDataFrame([("g1", "8"), ("g2", "9")], tax.schema)
    assert {tuple(r) for r in A.upsert(tax, new, "accession").collect()} == {("g1", "8"), ("g2", "9")}
    assert A.add_missing(tax, new, ["accession"]).where("taxid = '7' or taxid = '9'").count() == 2


def test_catalogue(spark):
    a = spark.createDataFrame([("s1", "x", "PASS", "1", "t1"), ("s2", "x", "FAIL", "1", "t9")], "sample_accession string, sylph_species string, hq_filter string, asm_fasta_on_osf string, osf_tarball_filename string")
    q = spark.createDataFrame([("s1", 99.0, 0.0), ("s2", 80.0, 3.0)], "sample string, completeness_general double, contamination double")
    t = {"assembly": a, "checkm2": q, "asm_batches": spark.createDataFrame([("t1", "u")], "asm_tar_xz string, asm_tar_xz_url string")}
    assert catalog.count(t, catalog.Options(max_contamination=0)).first().n == 1  # a bound of 0 is a bound
    assert catalog.count(t, catalog.Options(min_completeness=50.0, species="x")).first().n == 2
    assert catalog.download_plan(t, catalog.Options()).columns == [*a.columns, "asm_tar_xz_url"]
    assert catalog.count_by_species(t, catalog.Options()).first().n == 2
    plan = catalog.select_assemblies(t, catalog.Options(high_quality=True)).build()._jdf.queryExecution().optimizedPlan().toString()
    assert "completeness" not in plan
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "sample_accession string")
    assert catalog.subset(a, keys("s1"), "sample_accession").count() == 1
    with pytest.raises(Exception, match="not in the manifest"):
        catalog.subset(a, keys("s7"), "sample_accession").collect()
    assert catalog.head(t, catalog.Options(), ["sample_accession"], 1).first().sample_accession == "s1"
    assert catalog.inspect(a)[0] == ("sample_accession", "string")
    with pytest.raises(Exception, match="without archive"):
        catalog.batches(a.withColumn("osf_tarball_filename", F.lit(None).cast("string")), "osf_tarball_filename", "sample_accession").collect()


def test_taxonomy(spark):
    t = spark.createDataFrame([("1", None, "superkingdom", "d__R"), ("2", "1", "genus", "g__Gen"), ("3", "2", "species", "s__Gen one")], "taxid string, parent_taxid string, tax_rank string, tax_name string")
    assert {r.taxid: r.ancestor for r in taxonomy.ancestors_at(t, "genus").collect()} == {"2": "2", "3": "2"}
    assert {r.taxid: r.lineage for r in taxonomy.lineage_text(t).collect()}["3"] == "d__R;g__Gen;s__Gen one"
    v = spark.createDataFrame([(" Gen  one extra",), ("Gen",), ("3",), ("zzz",), (None,)], "name string")
    got = {r.name: r.taxid for r in taxonomy.resolve(v, t, "name").collect()}
    assert got == {" Gen  one extra": "3", "Gen": "2", "3": "3", "zzz": None, None: None}
    with pytest.raises(ValueError, match="zzz"):
        taxonomy.require_all(taxonomy.resolve(v, t, "name"), "name")
    acc = spark.createDataFrame([("a", "3"), ("b", "1")], "accession string, taxid string")
    assert {tuple(r) for r in taxonomy.group_by_rank(acc, t, "genus").collect()} == {("a", "2"), ("b", "1")}
    with pytest.raises(ValueError):
        taxonomy.ancestors_at(t, "tribe")


def test_sketches(spark, tmp_path):
    rng = random.Random(9)
    s = synth.sequence(4000, rng)
    df = spark.createDataFrame([("a", s), ("b", synth.mutate(s, 0.01, rng)), ("c", synth.sequence(4000, rng))], "name string, seq string")
    sk = sketch.sketch(df, 21, 8)
    pairs = {(r.query_name, r.match_name): r.average_containment_ani for r in sketch.pairwise(sk, 21).collect()}
    assert list(pairs) == [("a", "b")] and 0.98 < pairs["a", "b"] < 0.999
    assert sketch.downsample(sk, 8, 32).count() < sk.count() / 2
    with pytest.raises(ValueError):
        sketch.downsample(sk, 8, 4)
    base = {"ksize": 21, "seed": 42, "moltype": "DNA", "scaled": 8}
    assert sketch.check_compatible(base, base | {"scaled": 16, "moltype": "dna"}) == 16
    for bad in ({"ksize": 31}, {"seed": 1}, {"scaled": 4}):
        with pytest.raises(ValueError):
            sketch.check_compatible(base, base | bad)
    hits = sketch.screen(sk.where("name = 'a'"), sk, 8, 1000)
    assert {r.match_name for r in hits.collect()} == {"a", "b"}
    res = {r.accession: r.n_hits for r in sketch.split_results(hits, spark.createDataFrame([("a",), ("c",)], "accession string")).collect()}
    assert res == {"a": 1, "c": 0}
    sketch.reverse_index(sk, f"{tmp_path}/ri", 3)
    assert spark.read.parquet(f"{tmp_path}/ri").count() == sk.count()


def test_metrics(spark):
    cols = "g string, i int, " + ", ".join(f"{c} double" for c in metrics.SUMS) + ", cpu_percent double, max_rss_kb long, exit_code int, samples int"
    rows = [("x", i, *[float(i)] * len(metrics.SUMS), 10.0 * i, i, i % 2, i) for i in (1, 2, 3)]
    r = metrics.averages(metrics.aggregate(spark.createDataFrame(rows, cols), ["g"], "i")).first()
    assert (r.elapsed_seconds, round(r.cpu_percent, 6), r.max_rss_kb, r.exit_code, r.samples, r.average_elapsed_seconds) == (6.0, round(140 / 6, 6), 3, 1, 6, 1.0)
    with pytest.raises(ValueError):
        metrics.sample(spark.range(3), F.col("id"), 5, 1)
    files = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 3)], "file string, size long, modified int")
    assert [x.file for x in metrics.to_prune(files, 10).collect()] == ["a"] and metrics.total_size(files).first().bytes == 15


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([("a", "ACGTA"), ("b", "CCCCC")], "key string, seq string").write.parquet(src)
    stream = kmer_stream.sequence_stream(spark, src, "key string, seq string")
    q = kmer_stream.running_counts(stream, 3).writeStream.outputMode("complete").format("memory").queryName("kc").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.kmer: r.n for r in spark.table("kc").collect()} == {"ACG": 2, "CGT": 2, "GTA": 1, "TAC": 1, "CCC": 3, "GGG": 3}
    for _ in range(2):
        kmer_stream.ingest_new(kmer_stream.sequence_stream(spark, src, "key string, seq string"), "key", f"{tmp_path}/out", f"{tmp_path}/ck{_}").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_synthetic():
    for kind in synth.OFFSETS:
        a = synth.topology(kind, 5, 4, 50, 1)
        assert a == synth.topology(kind, 5, 4, 50, 1) and a
    pairs = list(synth.reads(["ACGT" * 50], 5, 10, 1, insert=40))
    assert len(pairs) == 5 and all(len(p[1]) == len(p[2]) == 10 for p in pairs)
    with pytest.raises(ValueError):
        list(synth.reads(["AC"], 1, 10, 1))


def test_runner():
    out = Runner().phase("one", lambda: 1).phase("two", lambda: 1 / 0).phase("three", lambda: 1).run()
    assert [(m["phase"], m["exit_code"]) for m in out] == [("one", 0), ("two", 1)]
