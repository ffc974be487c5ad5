"""Rank and select over id ranges."""

import re

from strandflow.operators import graph as G


def test_rank_and_select_over_ranges(spark):
    symbols = "ACGTTACA$GGATTACAC"
    e = spark.createDataFrame(list(enumerate(symbols)), "eid long, sym string")
    want = {(i, s, symbols[: i + 1].count(s)) for i, s in enumerate(symbols)}
    for width in (1, 4, 100):
        assert {(r.eid, r.sym, r["rank"]) for r in G.rank_symbol(e, width).collect()} == want
    wanted = spark.createDataFrame([(s, n) for _, s, n in want] + [("A", 99)], "sym string, rank long")
    assert {(r.eid, r.sym, r["rank"]) for r in G.select_symbol(e, wanted).collect()} == want | {(None, "A", 99)}


def test_no_window_over_a_whole_symbol(spark):
    plan = G.rank_symbol(spark.range(9).selectExpr("id as eid", "'A' as sym"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\[sym#\d+\], \[eid#", plan)


def test_neighbours(spark):
    symbols = "ACGTTACA$GGATTACAC"
    e = spark.createDataFrame(list(enumerate(symbols)), "eid long, sym string")
    asked = [(i, s) for i in range(len(symbols)) for s in "$ACGT"]
    at = lambda i: None if i < 0 else i
    want = {(i, s, at(symbols.rfind(s, 0, i + 1)), at(symbols.find(s, i))) for i, s in asked}
    got = G.neighbours(e, spark.createDataFrame(asked, "eid long, sym string"), 4)
    assert {(r.eid, r.sym, r.pred, r.succ) for r in got.collect()} == want
