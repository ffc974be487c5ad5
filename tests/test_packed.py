"""Packed windows against plain strings."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandflow.operators import graph, kmers, packed

FLIP = str.maketrans("ACGT", "TGCA")


def both(text):
    for part in "".join(c if c in "ACGT" else " " for c in text.upper()).split():
        yield part
    for part in "".join(c if c in "ACGT" else " " for c in text.upper()).translate(FLIP)[::-1].split():
        yield part


def brute_edges(texts, k):
    out = defaultdict(lambda: [0, set()])
    for text, colour in texts:
        for part in both(text):
            if len(part) >= k:
                padded = "$" * k + part + "$"
                for i in range(len(part) + 1):
                    e = out[padded[i : i + k], padded[i + k]]
                    e[0] += 1
                    e[1].add(0 if "$" in padded[i : i + k + 1] else colour)
    real = {n for n, s in out if s != "$"}
    return {e: v for e, v in out.items() if e[1] != "$" or e[0] not in real}


@pytest.mark.parametrize("width", [1, 2, 7, 16, 31, 32])
def test_windows(monkeypatch, width):
    monkeypatch.setattr(packed, "SLICE", 37)
    rng = random.Random(width)
    texts = ["".join(rng.choice("ACGTacgtNX") if rng.random() < 0.03 else rng.choice("ACGT") for _ in range(n)) for n in (0, 5, 400, 33, 90)]
    value = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    one = packed.Symbols(texts)
    for s, flip in ((one, False), (one.reverse(), True)):
        got = Counter((int(r), int(c)) for row, code in s.windows(width) for r, c in zip(row, code))
        want = Counter()
        for r, t in enumerate(texts):
            t = t.upper()
            t = t.translate(FLIP)[::-1] if flip else t
            want.update((r, value(t[i : i + width])) for i in range(len(t) - width + 1) if set(t[i : i + width]) <= set("ACGT"))
        assert got == want
    code = np.array([value("ACGT" * 8)], np.uint64)
    assert int(packed._complement(code >> np.uint64(64 - 2 * width), width)[0]) == value(("ACGT" * 8)[:width].translate(FLIP)[::-1])


@pytest.mark.parametrize("k", [1, 2, 5, 21, 31])
def test_graph_against_strings(spark, k):
    rng = random.Random(k)
    rows = [("".join(rng.choice("ACGT" if rng.random() < 0.98 else "NRn") for _ in range(rng.choice([3, 30, 31, 32, 64, 500]))), 1 + i % 3) for i in range(40)]
    rows += rows[:3] + [("", 1), (None, 2), ("A" * 70, 3)]
    want = brute_edges([r for r in rows if r[0]], k)
    df = spark.createDataFrame(rows, "seq string, colour long")
    assert {(r.node, r.sym): r.n for r in graph.build(df, k, "weighted").collect()} == {e: v[0] for e, v in want.items()}
    flagged = graph.build(df, k, "coloured", flags=True).collect()
    assert {(r.node, r.sym): r.colours for r in flagged} == {e: sorted(v[1]) for e, v in want.items()}
    seen, last = set(), {}
    for node, sym in sorted(want, key=lambda e: (e[0][::-1], e[1])):
        last[node] = sym
    firsts = set()
    for node, sym in sorted(want, key=lambda e: (e[0][::-1], e[1])):
        if (node[1:], sym) not in seen:
            firsts.add((node, sym))
            seen.add((node[1:], sym))
    assert {(r.node, r.sym) for r in flagged if r.first} == firsts
    assert {(r.node, r.sym) for r in flagged if r.last} == set(last.items())


def test_long_contig(spark):
    """200,000 bases with nodes of 30, as one row."""
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(200_000))
    df = spark.createDataFrame([(text, 1)], "seq string, colour long")
    assert graph.build(df, 30).count() == len(brute_edges([(text, 1)], 30))
    counts = kmers.count_kmers(df, 31, canonical=True)
    assert counts.count() == len({min(w, w.translate(FLIP)[::-1]) for w in (text[i : i + 31] for i in range(len(text) - 30))})
    assert kmers.count_kmers(df.limit(0), 31).count() == 0
