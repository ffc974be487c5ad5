"""Scans and sinks over small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from strandflow.functions import names
from strandflow.sources import fasta, fastq, gff, lines, manifests, sinks

GFF = "\n".join(
    [
        "##gff-version 3",
        "genome1\tbakta\tregion\t1\t24\t.\t+\t0\tID=genome1",
        "genome1\tP\tCDS\t1\t5\t.\t+\t0\tID=A1;Dbxref=SO:0001217,UniRef:X:1",
        "",
        " genome1\tP\tCDS\t11\t16\t.\t-\t0\t Parent=A1 ; Name=n \r",
        "##FASTA",
        ">genome1 test sequence",
        "ACGAGNCGG",
        "TGGCAANGAAGTTN",
        ">genome2 other",
        "GTGTCGG",
    ]
)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    text = ">genome1 a->b\nacgag\nNCGG\n\n>empty\n>genome2\r\nGTGT\r\n"
    for name in ("x.fna", "y.fa.gz"):
        rows = fasta.read_fasta(spark, write(tmp_path / name, text)).collect()
        assert [(r.seq_id, r.seq) for r in rows] == [("genome1", "ACGAGNCGG"), ("genome2", "GTGT")]
    one = fasta.read_fasta(spark, write(tmp_path / "z.fna", ">genome1\nACGAGNCGGTGGCAANGAAGTTN\n>genome2\nGTGTCGGAGGNCTCCATCGAC\n"))
    frags, colours = fasta.coloured_contigs(one, 3)
    rows = frags.collect()
    assert len(rows) == 10 and sum(len(r.seq) for r in rows) == 80 and colours.count() == 2
    assert {r.seq for r in rows if r.seq_id == "genome1" and r.strand_no == 1} == {"CTCGT", "TTGCCACCG", "AACTTC"}


def test_gff(spark, tmp_path):
    feats, contigs = gff.read_gff(spark, write(tmp_path / "g.gff3", GFF))
    rows = [(r.seqid, r.begin, r.end, r.strand, r.seed) for r in gff.normalise(feats).collect()]
    assert rows == [("genome1", 0, 5, "+", "genome1-A1"), ("genome1", 10, 16, "-", None)]
    assert {r.seq_id: r.seq for r in contigs.collect()} == {"genome1": "ACGAGNCGGTGGCAANGAAGTTN", "genome2": "GTGTCGG"}
    base = gff.whole_contig_features(contigs).collect()
    assert {(r.seed, r.strand, r.end) for r in base} == {("genome1-base", "+", 23), ("genome1-base", "-", 23), ("genome2-base", "+", 7), ("genome2-base", "-", 7)}


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ("c\ts\tt\t1\t2\t.\t+\t0", "not 9 fields"), ("\ts\tt\t1\t2\t.\t+\t0\tID=a", "not 9 fields"), (" \ts\tt\t1\t2\t.\t+\t0\tID=a", "not 9 fields"), ("c\ts\tt\t0\t2\t.\t+\t0\tID=a", "below 1"),
        ("c\ts\tt\t-1\t2\t.\t+\t0\tID=a", "no integer"), ("c\ts\tt\tx\t2\t.\t+\t0\tID=a", "no integer"), ("c\ts\tt\t3\t2\t.\t+\t0\tID=a", "after end"),
        ("c\ts\tt\t1\t2\t.\tz\t0\tID=a", "strand"), ("c\ts\tt\t1\t99999999999999999999\t.\t+\t0\tID=a", "too large"), ("c\ts\tt\t4\t4\t.\t?\t0\tID=FIRST;ID=SECOND", None),
    ],
)
def test_gff_lines(spark, line, error):
    df = spark.createDataFrame([(line,)], "line string")
    got = df.select(gff.parse_line(F.col("line"), strict=False).alias("r")).select("r.*").first()
    assert (got.error is None) == (error is None) and (error or "") in (got.error or "")
    if error:
        with pytest.raises(Exception, match="GFF line"):
            df.select(gff.parse_line(F.col("line"))).collect()
    for blank in ("", "# comment", "##gff"):
        assert spark.createDataFrame([(blank,)], "line string").select(gff.parse_line(F.col("line")).alias("r")).first().r is None


def read(*records):
    return "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in records)


def test_fastq(spark, tmp_path):
    p = write(tmp_path / "a_R1.fq", read(("r1/1", "ACNGT", "ABCDE"), ("r2 x", "NNN", "III")))
    rows = fastq.unpaired(spark, p).orderBy("read_no").collect()
    assert [(r.read_id, [(f.seq, f.qual) for f in r.fragments], r.discarded) for r in rows] == [("r1", [("AC", "AB"), ("GT", "DE")], 1), ("r2", [], 3)]
    q = write(tmp_path / "a_R2.fq.gz", read(("r1/2", "TT", "II"), ("r2", "AC", "II")))
    both = fastq.paired(spark, p, q).orderBy("read_no").collect()
    assert [len(r.fragments) for r in both] == [3, 1]
    meta = fastq.metadata(fastq.paired(spark, p, q)).first()
    assert (meta.n_records, meta.n_reads, meta.discarded, meta.compressed) == (4, 2, 4, False)
    inter = write(tmp_path / "i.fq", read(("a/1", "AC", "II"), ("a/2", "GT", "II")))
    assert [r.read_id for r in fastq.interleaved(spark, inter).collect()] == ["a"]


@pytest.mark.parametrize(
    ("text", "what"),
    [("@a\nAC\n+\nI\n", "length"), ("a\nAC\n+\nII\n", "header"), ("@a\nAC\n-\nII\n", "separator"), ("@a\nAC\n+\n", "truncated"), ("@a\nA-\n+\nII\n", "symbol"), ("@a\nAC\n+\nI\x7f\n", "quality")],
)
def test_bad_fastq(spark, tmp_path, text, what):
    with pytest.raises(Exception, match=f"FASTQ: .*{what}"):
        fastq.unpaired(spark, write(tmp_path / "b.fq", text)).collect()


def test_bad_mates(spark, tmp_path):
    a = write(tmp_path / "1.fq", read(("a", "AC", "II"), ("b", "AC", "II")))
    for i, other in enumerate((read(("a", "AC", "II")), read(("a", "AC", "II"), ("z", "AC", "II")))):
        with pytest.raises(Exception, match="mates"):
            fastq.paired(spark, a, write(tmp_path / f"2{i}.fq", other)).collect()
    with pytest.raises(Exception, match="mates"):
        fastq.interleaved(spark, write(tmp_path / "3.fq", read(("a", "AC", "II")))).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    p = write(tmp_path / "n.txt", "\n".join(f"line {i}" for i in range(20_000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lines.numbered_lines(spark, p)
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where(F.concat(F.lit("line "), "line_no") != F.col("value")).count() == 0
        assert rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_groups(spark):
    df = spark.createDataFrame([(f"/d/{n}",) for n in ("S1_L001_R1_001.fastq.gz", "S1_L001_R2_001.fastq.gz", "b.1.fq", "b.2.fq", "notes.txt")], "file string")
    rows = {(r.sample, r.lane, r.fragment): (r.forward, r.reverse) for r in fastq.group_files(df).collect()}
    assert rows == {("S1", "L001", "001"): ("/d/S1_L001_R1_001.fastq.gz", "/d/S1_L001_R2_001.fastq.gz"), ("b", "null", "null"): ("/d/b.1.fq", "/d/b.2.fq")}
    with pytest.raises(Exception, match="orientation"):
        fastq.group_files(df.limit(1)).collect()


def test_manifests(spark, tmp_path):
    p = write(tmp_path / "m.csv", "a,x.fna.gz\nb, y.gff3 \n\nc,z.fq\n")
    assert [(r.value, r.file_type) for r in manifests.file_paths(spark, p, 1).collect()] == [("x.fna.gz", "FASTA"), ("y.gff3", "GFF"), ("z.fq", "FASTQ")]
    assert manifests.file_paths(spark, p, 1, kind="GFF").count() == 1
    with pytest.raises(Exception, match="column"):
        manifests.column_of_lines(spark, p, 5).collect()
    with pytest.raises(Exception, match="unknown type"):
        manifests.file_paths(spark, p, 0).collect()
    g = write(tmp_path / "g.csv", "acc,taxonomy,taxid\nA,one,\nB,two,2\nA,three,3\n")
    rows = {r.accession: (r.taxonomy, r.taxid, r.fasta) for r in manifests.genome_manifest(spark, g, {"accession": "acc"}).collect()}
    assert rows == {"A": ("three", "3", None), "B": ("two", "2", None)}
    with pytest.raises(ValueError, match="accession"):
        manifests.genome_manifest(spark, g)
    c = write(tmp_path / "c.csv", "# made by us\n# today\nx,y\n1,2\n")
    assert manifests.catalogue_csv(spark, c).first().asDict() == {"x": "1", "y": "2"}
    assert manifests.delimited(spark, write(tmp_path / "t.tsv", "x\ty\n1\t2\n")).first().y == "2"
    with pytest.raises(ValueError):
        manifests.delimited(spark, "t.json")
    assert manifests.sample_manifest(spark, write(tmp_path / "s.csv", "sample,forward,reverse\na,b,c\n")).first().reverse == "c"
    listing = spark.createDataFrame([("x.batch.1.tar.xz",), ("File_Lists/a",), ("other",)], "filename string")
    assert [d.count() for d in manifests.file_list(listing)] == [1, 1]


def test_dataset_catalogue(spark, tmp_path):
    entry = {"id": "a", "name": "n", "domain": "d", "data_type": "t", "files": [{"role": "r", "url": "u", "filename": "f"}], "metadata": {"tags": ["x", "y"]}}
    rows = manifests.datasets(spark, write(tmp_path / "c.json", json.dumps([entry, entry | {"id": "b", "metadata": None}])))
    assert [r.id for r in manifests.filter_datasets(rows, ["x"], domain="d", organism=None).collect()] == ["a"]
    with pytest.raises(Exception, match="required"):
        manifests.datasets(spark, write(tmp_path / "d.json", json.dumps([{"id": "a"}]))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "accession string, n int")
    assert sinks.save_csv(df, f"{tmp_path}/m") and not sinks.save_csv(df.limit(0), f"{tmp_path}/none")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/m").count() == 2 and not (tmp_path / "none").exists()
    with pytest.raises(FileExistsError):
        sinks.save_csv(df, f"{tmp_path}/m")
    sinks.save_plan(df, f"{tmp_path}/plan", {"species": "x"})
    assert json.loads((tmp_path / "plan.about.json").read_text()) == {"species": "x"}
    sinks.save_results(df, f"{tmp_path}/res")
    assert (tmp_path / "res" / "accession=A").exists()
    sinks.save_clusters(df, f"{tmp_path}/cl")
    sinks.save_json(df, f"{tmp_path}/js")
    assert spark.read.json(f"{tmp_path}/cl").count() == spark.read.json(f"{tmp_path}/js").count() == 2
    s = spark.createDataFrame([("r", "A" * 130)], "i string, s string")
    assert sinks.fasta_lines(s, "i", "s").first().value.split("\n") == [">r", "A" * 60, "A" * 60, "A" * 10]
    assert sinks.fastq_lines(s, "i", "s").first().value == f"@r\n{'A' * 130}\n+\n{'I' * 130}"


def test_names(spark):
    df = spark.createDataFrame([("a/b/S.fna.tar.gz", "db:x:1,bad, q:2", "r1/2 extra")], "p string, d string, r string")
    r = df.select(names.file_type(F.col("p")).alias("t"), names.sequence_name(F.col("p")).alias("n"), names.dbxrefs(F.col("d")).alias("d"), names.read_id(F.col("r")).alias("r"), names.delimiter(F.lit("x.tsv.gz")).alias("s"), F.crc32(F.lit("123456789")).alias("c"), names.iso_time(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("i")).first()
    assert (r.t, r.n, r.r, r.s, r.c, r.i) == ("FASTA", "S", "r1", "\t", 0xCBF43926, "2024-01-02T03:04:05Z")
    assert [tuple(x) for x in r.d] == [("db", "x:1"), ("q", "2")]
