"""Inputs beyond former limits, and the rules of files and indexes."""

import random
from functools import partial

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandflow.operators import annotations, cluster, manifest, metrics, skew, taxonomy
from strandflow.sources import fastq, manifests, sinks


def test_deep_taxonomy(spark):
    n = 150
    rows = [(f"t{i}", f"t{i - 1}" if i else "t0", "genus" if i == 3 else None, f"n{i}") for i in range(n)] + [("lost", "unknown", None, "x")]
    taxa = spark.createDataFrame(rows, "taxid string, parent_taxid string, tax_rank string, tax_name string")
    found = {(r.taxid, r.steps): r.ancestor for r in taxonomy.lineages(taxa).collect()}
    assert found == {(f"t{i}", s): f"t{i - s}" for i in range(n) for s in range(i + 1)} | {("lost", 0): "lost"}
    assert {r.taxid: r.ancestor for r in taxonomy.ancestors_at(taxa, "genus").collect()} == {f"t{i}": "t3" for i in range(3, n)}
    loop = spark.createDataFrame([("a", "b", None, "a"), ("b", "a", None, "b")], taxa.schema)
    with pytest.raises(ValueError):
        taxonomy.lineages(loop)


@pytest.mark.parametrize("at_once", [4, 10**6])
def test_clusters_beyond_one_task(spark, monkeypatch, at_once):
    monkeypatch.setattr(cluster, "lookup", partial(skew.lookup, one_task=10))
    monkeypatch.setattr(skew, "hot_from", lambda df, rows: 6)
    rng = random.Random(1)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [("x", "x"), (None, "y")]
    rng.shuffle(edges)
    got = {r.member: r.root for r in cluster.connected(spark.createDataFrame(edges, "a string, b string"), at_once).collect()}
    assert got == {f"c{i:03}": "c000" for i in range(41)} | {f"h{i}": "h0" for i in range(30)} | {"hub": "h0"}


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "hot_from", lambda df, rows: 20)
    rows = [("hot", i) for i in range(100)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, i int")
    one = spark.createDataFrame([("hot", "h"), ("k1", "one")], "k string, v string")
    key = lambda r: tuple(str(x) for x in r)
    plain = lambda other, how: sorted(map(key, df.join(other, "k", how).select("k", "i", "v").collect()))
    for how in ("left", "inner"):
        assert sorted(map(key, skew.lookup(df, "k", one, how, one_task=10).select("k", "i", "v").collect())) == plain(one, how)
    many = spark.createDataFrame([("hot", str(i)) for i in range(5)] + [("k2", "a"), ("k2", "b")], "k string, v string")
    assert sorted(map(key, skew.salted_join(df, df.count(), "k", many, "i").select("k", "i", "v").collect())) == plain(many, "inner")


def test_last_new_row_wins(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("a", "9", 1), ("a", "3", 2), ("c", "8", 5), ("c", "7", 6)], "k string, v string, n int")
    assert {tuple(r) for r in annotations.upsert(stored, new, "k", "n").collect()} == {("a", "3"), ("b", "2"), ("c", "7")}
    assert {tuple(r) for r in annotations.add_missing(stored, new, ["k"], "n").collect()} == {("a", "1"), ("b", "2"), ("c", "7")}
    assert {tuple(r) for r in annotations.upsert(stored, new, "k").collect()} == {("a", "9"), ("b", "2"), ("c", "8")}


def test_records_within_and_across_batches():
    """Records are put together wherever a batch or a split ends; lone lines keep their place."""
    rng = random.Random(2)
    lines = [("f", i, f"{'@s+q'[i % 4]}{i // 4}") for i in range(42)] + [("g", i, f"{'@s+q'[i % 4]}{i // 4}") for i in range(7, 21)]
    for _ in range(20):
        cuts = sorted(rng.sample(range(len(lines)), 5))
        parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)]) if b > a]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), (pa.string(), pa.int64(), pa.string()))], names=["file", "line_no", "value"]) for p in parts]
        out = [r for b in fastq._assemble(iter(batches)) for r in b.to_pylist()]
        whole = {(r["file"], r["record_no"]): (r["head"], r["seq"], r["plus"], r["qual"]) for r in out if r["n"] == 4}
        assert whole == {("f", k): (f"@{k}", f"s{k}", f"+{k}", f"q{k}") for k in range(10)} | {("g", k): (f"@{k}", f"s{k}", f"+{k}", f"q{k}") for k in range(2, 5)}
        lone = sorted((r["file"], r["record_no"], x) for r in out if r["n"] == 1 for x in (r["head"], r["seq"], r["plus"], r["qual"]) if x)
        assert lone == [("f", 10, "@10"), ("f", 10, "s10"), ("g", 1, "q1"), ("g", 5, "@5")]


def test_rules_of_files(spark, tmp_path):
    (tmp_path / "a.fna").write_text(">a\nA\n")
    assert manifests.require_files(spark, [f"{tmp_path}/a.fna"]) == [f"{tmp_path}/a.fna"]
    with pytest.raises(FileNotFoundError):
        manifests.require_files(spark, [f"{tmp_path}/a.fna", f"{tmp_path}/b.fna"])
    rows = spark.createDataFrame([(1,)], "k int")
    sinks.append_rows(rows, f"{tmp_path}/i", "seed")
    sinks.finalise(spark, f"{tmp_path}/i")
    for again in (lambda: sinks.append_rows(rows, f"{tmp_path}/i", "seed"), lambda: sinks.finalise(spark, f"{tmp_path}/i")):
        with pytest.raises(PermissionError):
            again()
    entry = '{"id":"1","name":"n","domain":"d","data_type":"t","files":[{"role":"r","url":"u","filename":"f"%s}]%s}'
    read = lambda *x: manifests.parse_datasets(spark.createDataFrame([(entry % x,)], "value string").selectExpr("concat('[', value, ']') value")).collect()
    assert read("", ',"x":{"y":1}')[0].metadata.attributes == {"x": '{"y":1}'}
    for bad in (',"size_bytes":-1', ',"checksum":{"algorithm":"md5"}', ',"checksum":{"algorithm":"","value":"1"}'):
        with pytest.raises(PySparkException):
            read(bad, "")


def test_manifest_faults(spark):
    cols = "accession string, taxid string, state string, package_id string, reserved_at string, completed_at string, cleanup_started_at string, error string"
    rows = [("ok", "1", "complete", "p", "t", "t", None, None), ("two", "1", "reserved", "p", "t", None, None, None), ("two", "1", "reserved", "p", "t", None, None, None),
            ("s", "1", "odd", "p", "t", None, None, None), ("c", "1", "complete", "p", "t", None, None, None), ("f", "1", "failed", "p", "t", None, None, None), ("l", "1", "cleaning", "p", "t", None, None, None), (None, "1", "reserved", "p", "t", None, None, None)]
    got = {r.accession: r.fault for r in manifest.integrity(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"two": "accession repeated", "s": "unknown state", "c": "completion and state differ", "f": "error and state differ", "l": "cleanup without a start", None: "no accession"}


def test_pruning_keeps_the_newest(spark):
    files = spark.createDataFrame([(f"f{i}", 10, i // 2) for i in range(20)], "file string, size long, day int").withColumn("modified", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(day)"))
    assert sorted(r.file for r in metrics.to_prune(files, 55).collect()) == sorted(f"f{i}" for i in range(15))
    assert metrics.to_prune(files, 1000).count() == 0 and metrics.to_prune(files.limit(0), 5).count() == 0
