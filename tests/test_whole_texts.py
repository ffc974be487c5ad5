"""Sequences with a base for each character of a text."""

from pyspark.sql import functions as F

from strandflow.functions.session import table
from strandflow.plans import registry
from strandflow.plans import sequence_queries as Q
from tests.oracle import DATA


def test_no_character_is_lost(spark):
    docs = table(spark, DATA, "documents").where("text is not null")
    rows = docs.select("doc_id", F.length("text").alias("n")).join(Q.text_sequences(spark, DATA), "doc_id")
    assert rows.count() == docs.count() and rows.where(F.length("seq") != F.col("n")).count() == 0
    assert rows.where(F.col("n") > 64).count() > 0 and rows.where("seq rlike '[^ACGTN]'").count() == 0


def test_long_texts_reach_the_operators(spark):
    q = registry.queries()
    assert q["chunks_text"](spark, DATA).where("piece_no > 4").count() > 0
    windows = Q.text_sequences(spark, DATA).select(F.explode(F.split("seq", "N")).alias("s")).agg(F.sum(F.greatest(F.length("s") - Q.KMER + 1, F.lit(0)))).first()[0]
    assert q["kmer_count_text"](spark, DATA).agg(F.sum("n")).first()[0] == 2 * windows
    assert q["sketch_text"](spark, DATA).groupBy("doc_id").count().agg(F.max("count")).first()[0] > 10
