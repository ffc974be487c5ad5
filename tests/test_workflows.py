"""Workflows and command line over small files."""

import random

from strandflow import workflows as W
from strandflow.__main__ import main
from strandflow.functions import synth
from tests.test_sources import GFF, write


def test_build_sample_classify(spark, tmp_path):
    rng = random.Random(1)
    a, b = synth.sequence(600, rng), synth.sequence(600, rng)
    fa = write(tmp_path / "r.fna", f">one\n{a}\n>two\n{b}\n")
    manifest = write(tmp_path / "m.csv", fa + "\n")
    ref = main(["build", manifest, f"{tmp_path}/ref", "-k", "15"], spark)
    assert ref.where("size(colours) = 0").count() == 0
    assert {(r.seed, r.colour) for r in spark.read.parquet(f"{tmp_path}/ref/colours").collect()} == {("one", 1), ("two", 2)}
    pairs = list(synth.reads([a], 40, 50, 2, insert=120))
    f, r = ("".join(f"@{p[0]}/{i}\n{p[i]}\n+\n{'I' * 50}\n" for p in pairs) for i in (1, 2))
    main(["sample", write(tmp_path / "s_1.fq", f), f"{tmp_path}/smp", "--reverse", write(tmp_path / "s_2.fq", r), "-k", "15"], spark)
    found = {x.seed: x.depth for x in main(["classify", f"{tmp_path}/smp", f"{tmp_path}/ref", f"{tmp_path}/cls"], spark).collect()}
    assert found["one"] > 1000 and "two" not in found


def test_build_from_annotations(spark, tmp_path):
    edges = W.construct_coloured(spark, [write(tmp_path / "g.gff3", GFF)], 3, f"{tmp_path}/g")
    assert {c for r in edges.collect() for c in r.colours} == {0, 1}


def test_sketch_cluster_screen(spark, tmp_path):
    rng = random.Random(2)
    s = synth.sequence(5000, rng)
    files = [write(tmp_path / f"{n}.fna", f">{n}\n{x}\n") for n, x in (("a", s), ("b", synth.mutate(s, 0.005, rng)), ("c", synth.sequence(5000, rng)))]
    first = main(["sketch", f"{tmp_path}/sk", *files[:2], "-k", "21", "--scaled", "8"], spark).count()
    again = main(["sketch", f"{tmp_path}/sk", *files, "-k", "21", "--scaled", "8"], spark)
    assert again.count() > first and again.where("name = 'a'").distinct().count() == again.where("name = 'a'").count()
    c = {r.accession: r.cluster_id for r in main(["cluster", f"{tmp_path}/cl", "--index", f"{tmp_path}/sk", "-k", "21", "--ani", "0.95"], spark).collect()}
    assert c["a"] == c["b"] != c["c"]
    hits = main(["screen", f"{tmp_path}/hits", files[0], "--index", f"{tmp_path}/sk", "-k", "21", "--scaled", "8", "--threshold-bp", "1000"], spark)
    assert hits.first().n_hits == 2


def test_catalogue_commands(spark, tmp_path, capsys):
    d = "/root/testdata/sf0.001"
    assert main(["count", d, "--high-quality"], spark).first().n > 0
    assert main(["count-by", d, "--limit", "3"], spark).count() == 3
    assert main(["head", d, "--limit", "2"], spark).count() == 2
    assert main(["inspect", d], spark).where("column = 'hq_filter'").count() == 1
    capsys.readouterr()
    main(["head", d, "--limit", "2", "--out", f"{tmp_path}/h"], spark)
    assert spark.read.option("header", "true").csv(f"{tmp_path}/h").count() == 2
