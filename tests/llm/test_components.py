import random
from functools import partial

import pytest

from strandflow.llm import components
from strandflow.operators import skew

PAIRS = "query_name string, match_name string, average_containment_ani double, a string, m double"


def brute(edges, everyone):
    parent = {v: v for v in everyone}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in everyone}


@pytest.mark.parametrize(("bound", "one_task"), [(5, 10), (60, 10**6), (10**6, 10**6)])
def test_against_union_find(spark, monkeypatch, bound, one_task):
    monkeypatch.setattr(components, "lookup", partial(skew.lookup, one_task=one_task))
    monkeypatch.setattr(skew, "hot_from", lambda df, rows: 20)
    rng = random.Random(bound)
    n = 150
    edges = [(f"v{rng.randrange(n):03}", f"v{rng.randrange(n):03}") for _ in range(90)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]  # a long chain
    edges += [("hub", f"h{i:03}") for i in range(80)]  # and a hub
    edges += edges[:20]
    rng.shuffle(edges)
    rows = [(f"{x} strain {i}", y, rng.choice([0.97, 97.0, 0.95]), "x", 0.0) for i, (x, y) in enumerate(edges)]
    weak = [("w1", "v000", 0.949999, "", 1.0), ("w2", "w3", float("nan"), "", 1.0), ("w4", "w5", None, None, None), ("self", "self", 0.99, "", 1.0), (None, "w6", 0.99, "", 1.0), ("  ", "w7", 0.99, "", 1.0)]
    df = spark.createDataFrame(rows + weak, PAIRS).repartition(6)
    got = {tuple(r) for r in components.pair_groups(df, "query_name", "match_name", "average_containment_ani", 0.95, bound).collect()}
    everyone = {v for e in edges for v in e} | {"w1", "v000", "w2", "w3", "w4", "w5", "w6", "w7", "self"}
    assert got == brute(edges, everyone)


def test_empty(spark):
    assert components.pair_groups(spark.createDataFrame([], PAIRS), "query_name", "match_name", "average_containment_ani", 0.95).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chain_needs_few_levels(spark, shuffled):
    """A chain a hundred times as long as what a partition takes; no order of names makes it slow."""
    n, at_once = 20_000, 200
    names = list(range(n + 1))
    if shuffled:
        random.Random(1).shuffle(names)
    edges = [(f"{names[i]:07}", f"{names[i + 1]:07}") for i in range(n)]
    random.Random(2).shuffle(edges)
    levels = []
    got = components.components(spark.createDataFrame(edges, "a string, b string").repartition(16), at_once, levels)
    assert {r.group_id for r in got.collect()} == {"0000000"} and got.count() == n + 1
    assert len(levels) <= 12 and levels[-1] <= at_once
