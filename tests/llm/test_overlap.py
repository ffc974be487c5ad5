import random

import numpy as np
import pytest

from strandflow.llm import overlap

SETS = "accession string, sketch_path string, ksize int, scaled long, seed int, moltype string, hash_value int"


def brute(sets, hashes, share):
    rows = {(p, k, s, d) for _, p, k, s, d, *_ in sets if None not in (p, k, s, d) and s >= 1}
    have = {r: {h for p, h in hashes if p == r[0] and h is not None and h % 2**64 * r[2] < 2**64} for r in rows}
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[3] == b[3]:
                s = max(a[2], b[2])
                x, y = ({h for h in have[r] if h % 2**64 * s < 2**64} for r in (a, b))
                if x & y and len(x & y) >= share * min(len(x), len(y)) - 1e-9:
                    out.add((a[0], b[0], s, len(x & y), len(x), len(y)))
    return out


def run(spark, sets, hashes, share):
    s = overlap.sketch_sets(spark.createDataFrame(sets, SETS))
    h = spark.createDataFrame(hashes, "sketch_path string, hash_value long, scaled string")
    return {(r.sketch_path_a, r.sketch_path_b, r.scaled, r.n_shared, r.n_a, r.n_b) for r in overlap.overlaps(h, s, share).collect()}


@pytest.mark.parametrize(("share", "seed", "hot"), [(0.0, 1, 25), (0.1, 1, None), (0.1, 2, 25), (0.5, 2, 25)])
def test_against_all_pairs(spark, monkeypatch, share, seed, hot):
    """With and without hot identifiers, cells as grids, groups of copies and hot sets in slices."""
    if hot:
        for name, value in (("HOT_SETS", hot), ("PAIRS_PER_TASK", 5), ("MEMBERS_PER_SLICE", 2), ("ONE_TASK", 50)):
            monkeypatch.setattr(overlap, name, value)
        monkeypatch.setattr(overlap, "hot_from", lambda df, rows: 4)
    monkeypatch.setattr(overlap, "ROWS_PER_RANGE", 500)
    monkeypatch.setattr(overlap, "_PAIRS_AT_ONCE", 50)
    rng = random.Random(seed)
    pool = [rng.randrange(2**64 // 2000) for _ in range(400)]
    hot = pool[:5]  # in most sets
    sets, hashes = [], []
    for i in range(40):
        scaled = rng.choice([500, 1000, 2000])
        sets.append((f"A{i}", f"s{i}", rng.choice([21, 31]), scaled, 42, "DNA", 7))
        mine = rng.sample(pool, rng.choice([2, 10, 60])) + [rng.randrange(2**64 // scaled) for _ in range(rng.choice([0, 30, 900]))]
        mine += [h for h in hot if rng.random() < 0.9]
        rng.shuffle(mine)
        hashes += [(f"s{i}", h, "x") for h in mine] + [(f"s{i}", h, "x") for h in mine[:3]]
    for i in range(6):  # copies, of equal and of other parameters
        sets.append((f"C{i}", f"copy{i}", 31, 1000 if i < 4 else 2000, 42, "DNA", 7))
        hashes += [(f"copy{i}", h, "x") for h in pool[100:130]]
    sets += [sets[0], ("B", "sn", None, 1000, 42, None, 1), ("B", "sm", 31, None, 42, None, 1), (None, None, 31, 1000, 42, None, None), ("E", "empty", 31, 1000, 42, None, None)]
    hashes += [("sn", pool[0], None), (None, pool[0], None), ("s1", None, None), ("gone", pool[1], None)]
    got = run(spark, sets, hashes, share)
    assert got == brute(sets, [h[:2] for h in hashes], share)
    assert got


def test_unsigned_hashes_at_scaled_one(spark):
    sets = [(n, n, 31, 1, 42, "DNA", 0) for n in "ab"]
    hashes = [(n, h, "") for n in "ab" for h in (-1, -5, 3, 9)] + [("a", -9, "")]
    assert run(spark, sets, hashes, 0.1) == {("a", "b", 1, 4, 5, 4)}


def test_empty_tables(spark):
    assert run(spark, [], [], 0.1) == set()
    assert run(spark, [("A", "a", 31, 1000, 42, "DNA", 0)], [], 0.1) == set()


def test_intersections_both_ways():
    rng = np.random.default_rng(3)
    for _ in range(50):
        runs = []
        for _ in range(2):
            sizes = rng.choice([0, 1, 3, 40, 500], 12)
            vals = [np.sort(rng.choice(2000, n, replace=False)).astype(np.uint64) for n in sizes]
            runs.append((np.r_[0, np.cumsum(sizes)].astype(np.int64), np.concatenate(vals) if vals else np.empty(0, np.uint64), vals))
        (oa, fa, va), (ob, fb, vb) = runs
        want = [len(np.intersect1d(x, y)) for x, y in zip(va, vb)]
        assert overlap.intersect_runs(oa, fa, ob, fb).tolist() == want


def test_merge_of_full_width():
    top = np.uint64(2**64 - 1)
    a = np.array([0, 5, top, 0, top], np.uint64)
    b = np.array([0, top, 1, top], np.uint64)
    assert overlap.linear_merge(np.array([0, 0, 0, 1, 1]), a, np.array([0, 0, 1, 1]), b, 2).tolist() == [2, 1]


def test_runs_decode():
    values = [np.array([5, 9, 2**63 + 3], np.uint64), np.array([], np.uint64), np.array([0, 7], np.uint64)]
    deltas = np.concatenate([np.diff(v, prepend=np.uint64(0)) for v in values])
    assert overlap.decode_runs(np.array([0, 3, 3, 5]), deltas).tolist() == [5, 9, 2**63 + 3, 0, 7]


def test_many_copies(spark):
    """A third of all sets are copies of one: no pair is formed inside the group before the result."""
    rng = random.Random(9)
    core = [rng.randrange(2**64 // 1000) for _ in range(300)]
    sets = [(f"A{i}", f"c{i:03}", 31, 1000, 42, "DNA", 0) for i in range(150)] + [(f"B{i}", f"o{i:03}", 31, 1000, 42, "DNA", 0) for i in range(300)]
    hashes = [(f"c{i:03}", h, "") for i in range(150) for h in core]
    hashes += [(f"o{i:03}", h, "") for i in range(300) for h in [rng.randrange(2**64 // 1000) for _ in range(30)] + (core[:40] if i == 7 else core[:1])]
    got = run(spark, sets, hashes, 0.1)
    copies = {(f"c{i:03}", f"c{j:03}", 1000, 300, 300, 300) for i in range(150) for j in range(i + 1, 150)}
    assert got == copies | {(f"c{i:03}", "o007", 1000, 40, 300, 70) for i in range(150)}
