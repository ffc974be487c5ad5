import random
from collections import defaultdict, deque

import pytest

from strandflow.llm import packing as P
from strandflow.llm import tokens


def check(rows, sizes, capacity):
    """Every item whole and once, none cut unless above the capacity, no container over it, no overlap."""
    per_item, per_box = defaultdict(list), defaultdict(list)
    for item, piece, box, _, begin, at, n in rows:
        per_item[item].append((piece, begin, n))
        per_box[box].append((at, n))
    assert sorted(per_item) == list(range(len(sizes)))
    for i, pieces in per_item.items():
        pieces.sort()
        assert sum(n for _, _, n in pieces) == sizes[i]
        assert sizes[i] > capacity or len(pieces) == 1
        at = 0
        for k, (piece, begin, n) in enumerate(pieces):
            assert (piece, begin) == (k, at)
            at += n
    for spans in per_box.values():
        at = 0
        for begin, n in sorted(spans):
            assert begin == at
            at += n
        assert at <= capacity
    return per_box


@pytest.mark.parametrize("seed", range(6))
def test_bucket(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 50, 700, 1024, 2048, 2049, 9000, rng.randrange(3000)]) for _ in range(800)]
    sources = [rng.choice(["a", "a", "a", "b", None]) for _ in sizes]
    shares = {"a": 0.5, "b": 0.5} if seed % 2 else {"a": 0.6, "b": 0.2, None: 0.2}
    rows = P.pack_bucket(sizes, sources, [0.0] * len(sizes), shares, 2048, 1000)
    boxes = check(rows, sizes, 2048)
    assert sum(sizes) / (len(boxes) * 2048) > 0.95


def test_windows_keep_the_mixture():
    rng = random.Random(1)
    queues = {s: deque((rng.randrange(100, 900), s) for _ in range(3000)) for s in "abc"}
    shares, carry = {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": -3000.0, "b": 3000.0}
    mixer, got = P.Mixer(queues, shares, carry, 2048), defaultdict(int)
    for _ in range(9):
        for s, (n, _) in mixer.window(131_072):
            got[s] += n
    whole = sum(got.values())
    # what was carried in is made up for, so all windows together are at their targets within an item or two
    assert abs(got["a"] - (0.6 * whole - 3000)) < 4000 and abs(got["b"] - (0.3 * whole + 3000)) < 4000 and abs(got["c"] - 0.1 * whole) < 4000


def test_sources_without_target_follow():
    mixer = P.Mixer({"a": deque([(10, 1)] * 5), "z": deque([(10, 2)] * 5)}, {"a": 1.0}, {}, 100)
    out = []
    while mixer:
        out += mixer.window(50)
    assert [s for s, _ in out] == ["a"] * 5 + ["z"] * 5


def test_a_window_keeps_its_own_containers():
    """Each container holds documents of one window only, and windows are near the targets although containers close."""
    rng = random.Random(5)
    sizes = [rng.randrange(50, 1500) for _ in range(4000)]
    sources = [rng.choice("ab") for _ in sizes]
    rows = P.pack_bucket(sizes, sources, [0.0] * len(sizes), {"a": 0.5, "b": 0.5}, 2048, 0)
    boxes = check(rows, sizes, 2048)
    assert len({(r[2], r[3]) for r in rows}) == len(boxes)
    assert sum(sizes) / (len(boxes) * 2048) > 0.985
    per = defaultdict(lambda: defaultdict(int))
    for item, _, _, window, _, _, n in rows:
        per[window][sources[item]] += n
    full = [w for w in per.values() if sum(w.values()) > 50 * 2048][:-2]
    assert len(full) > 10 and max(abs(w["a"] / sum(w.values()) - 0.5) for w in full) < 0.05


@pytest.mark.skipif(not tokens.available(), reason="no vocabulary files here")
def test_rows(spark):
    rng = random.Random(2)
    rows = [(i if i % 9 else None, " ".join(["word"] * rng.choice([1, 100, 900, 5000])), rng.choice(["x", "y", None]), 1) for i in range(300)]
    rows += [(1000, None, "x", 1), (1001, "", None, 1), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    sizes = P.sized(df, "doc_id", "text", "source")
    out = P.pack(sizes, "doc_id", items_per_bucket=100).collect()
    total = sum(r.n_tokens for r in sizes.collect())
    assert sum(r.n_tokens for r in out) == total
    boxes = defaultdict(int)
    for r in out:
        boxes[r.container_id] += r.n_tokens
    assert max(boxes.values()) <= P.CAPACITY
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert P.pack(P.sized(df.limit(0), "doc_id", "text", "source"), "doc_id").count() == 0
    for targets in ({"x": 0.9, "y": 0.1}, {"x": 0.2, "y": 0.8, "absent": 1.0}, {"absent": 1.0}):
        assert sum(r.n_tokens for r in P.pack(sizes, "doc_id", targets=targets).collect()) == total


def test_targets_unlike_the_corpus(spark, monkeypatch):
    """Windows are at the targets until a source is used up; the rest is marked, and each document is packed once."""
    monkeypatch.setattr(P, "BUCKETS_PER_GROUP", 2)
    rng = random.Random(4)
    rows = [(i, rng.choice(["x"] * 6 + ["y"] * 3 + [None]), rng.randrange(1, 1200), i) for i in range(8000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, row long")
    out = P.pack(sizes, "doc_id", targets={"x": 0.5, "y": 0.5}, items_per_bucket=1500).cache()
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(range(8000)) and out.agg({"n_tokens": "sum"}).first()[0] == sum(r[2] for r in rows)
    tokens_of = {s: sum(r[2] for r in rows if r[1] == s) for s in ("x", "y", None)}
    at = {r.source: r.n for r in out.where("at_target").groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert set(at) == {"x", "y"} and at["y"] == tokens_of["y"] and abs(at["x"] / at["y"] - 1) < 0.06
    windows = defaultdict(dict)
    for r in P.mixture(out).where("at_target").collect():
        windows[r.bucket, r.window_no][r.source] = r
    full = [w for w in windows.values() if sum(r.n_tokens for r in w.values()) > 55 * 2048]
    assert len(full) >= 10 and sorted(abs(w["x"].share - 0.5) for w in full)[int(len(full) * 0.8)] < 0.05
