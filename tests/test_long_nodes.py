"""Graph and classification queries on nodes too long to saturate."""

from pyspark.sql import functions as F

from strandflow.plans import registry
from strandflow.plans import sequence_queries as Q
from tests.oracle import DATA

K = 21
NAMES = [f.__name__ for f in Q._FUNCTIONS if f.__name__.startswith(("dbg_", "classify_", "accumulate")) or f.__name__ in ("terminals", "meta_colours", "colour_occurrence")]


def test_every_graph_query_has_long_nodes():
    assert {f"{n}_k{K}" for n in NAMES} <= set(registry.queries()) & set(registry.sql())


def test_edges_grow_with_documents(spark):
    seqs = Q.sequences(spark, DATA)
    n = seqs.select("seq").distinct().count()
    edges = registry.queries()["dbg_edges_k21"](spark, DATA)
    assert edges.where(~F.col("node").contains("$") & (F.col("sym") != "$")).count() == 2 * n * (64 - K)


def test_unmatched_edges_stay(spark):
    q = Q.sequences(spark, DATA).where("lang = 'python'").select("seq").distinct().count()
    rows = registry.queries()["classify_left_join_k21"](spark, DATA).where(~F.col("node").contains("$") & (F.col("sym") != "$"))
    assert rows.count() == 2 * q * (64 - K) and rows.where("ref_eid = -1").count() > 0.9 * rows.count()
