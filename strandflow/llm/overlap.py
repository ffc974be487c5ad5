"""Shared identifiers of many large sets, without listing the intersections.

Method. Identifiers are range-partitioned, so each task holds one identifier range (a cell) of all sets. There every set
becomes a sorted, delta-encoded run (identifiers that occur in no second set can't be shared and only count for the size),
and candidate pairs are found. The list of pairs then comes to the cells, not the runs to the pairs: a cell's runs are sent
once to the task that counts its pairs (a cell with very many pairs is a grid of tasks over both sets' blocks), and each
pair meets there in a galloping intersection: exponential search of the smaller run in the larger where the sizes differ by
``GALLOP_RATIO`` or more, a linear merge otherwise; the counts of the cells are summed.

Candidates lose no pair: if two sets share at least the share ``t`` of the smaller one, they do so in at least one cell
(range and size level), so in that cell one of the shared identifiers is among the smaller set's rarest
n - ceil(t * n) + 1 identifiers. Only those look for partners.

Hot identifiers (in more than ``HOT_SETS`` sets, found by a sample of rows; which they are changes no result) don't go into
a range, where one of them would fill a task, but form a cell of their own, one run per set. A set looks for partners through
them only where its other identifiers can't make the share: if it has ``h`` hot and ``c`` other identifiers, a pair needs
t * (h + c) - h of the others, so its rate in the ranges is (t * (h + c) - h) / c, and at 0 or below its rarest hot ones look
as well.

Copies (sets of equal identifiers and parameters) are found by a 128-bit digest of their runs before any pair is formed;
one of them stands for all, and pairs are expanded to the members at the end, large groups in slices, so a group of copies
costs what it brings to the result and no more.

Sets of different ``scaled`` are compared at the coarser one: a common identifier is below both bounds anyway, so only
the sizes depend on it; they are counted per level of ``scaled``.

Defined results: rows with null path, ksize, seed or scaled, or a scaled below 1, take no part; repeated rows count
once; a set without identifiers shares nothing; hashes are unsigned (a negative LONG is above 2^63); a path listed with
several parameters counts as one set for each; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.session import broadcast_if_small, materialise, rows_at_most
from strandflow.operators.skew import ONE_TASK, hot_from, lookup

GALLOP_RATIO = 8
ROWS_PER_RANGE = 1_000_000
#: Sets up to this number are broadcast as (path, id, parameters), some 100 MB; beyond it a shuffle join takes over.
BROADCAST_SETS = 500_000
#: An identifier of more sets than this is hot; at most HOT_IDS identifiers are.
HOT_SETS, HOT_IDS = 20_000, 20_000
#: Pairs of one task of the count, and members of one slice of a group of copies.
PAIRS_PER_TASK, MEMBERS_PER_SLICE = 1_000_000, 1_000
_PAIRS_AT_ONCE = 1_000_000
_VALUES_AT_ONCE = 4_000_000

_CELL_SCHEMA = "kind tinyint, a bigint, b bigint, cell int, n bigint, deltas array<bigint>"
_SIZE, _RUN = 0, 1
_HOT_CELL = -1


def sketch_sets(sketches: DataFrame) -> DataFrame:
    """(set_id, sketch_path, ksize, seed, scaled), one row per distinct set; ids are unique and stay as written."""
    once = (
        sketches.select("sketch_path", F.col("ksize").cast("int"), F.col("seed").cast("int"), F.col("scaled").cast("bigint"))
        .where("sketch_path is not null and ksize is not null and seed is not null and scaled >= 1")
        .distinct()
    )
    return materialise(once.withColumn("set_id", F.monotonically_increasing_id()), "overlap-sets")


def _limit(scaled: Column) -> Column:
    """ceil(2^64 / scaled) in the unsigned order of :func:`_order`; null for no limit (scaled 1)."""
    whole = F.ceil(F.lit("18446744073709551616").cast("decimal(38,0)") / scaled.cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(scaled > 1, (whole - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint"))


def _order(h: Column) -> Column:
    """A LONG whose signed order is the unsigned order of ``h``."""
    return h.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))


def _levels(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Level 0 is the coarsest scaled; a hash is at the first level whose limit it is below."""
    return np.searchsorted(bounds, h, "right")


def _cells(members: DataFrame, ranges: int, limits: list[int]) -> DataFrame:
    """Sizes and runs of each identifier range; members: (set_id, grp, hash_value)."""
    bounds = np.array(limits[:-1], np.uint64)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        sid, grp, h = (whole.column(i).to_numpy() for i in range(3))
        h = h.view(np.uint64)
        cell = TaskContext.get().partitionId()
        for g in np.unique(grp):
            at = np.flatnonzero(grp == g)
            yield from _group_cells(sid[at], _levels(h[at], bounds), h[at], cell, int(g))

    return members.repartitionByRange(ranges, _order(F.col("hash_value"))).mapInArrow(run, _CELL_SCHEMA)


def _hot_identifiers(hashes: DataFrame, n_sets: int, rows: int) -> DataFrame | None:
    """(hash_value) of identifiers that very many sets hold, at most some HOT_IDS; None where there can't be any."""
    least = max(HOT_SETS, rows // HOT_IDS)
    if n_sets <= least:
        return None
    every = max(1, least // 256)
    part = hashes.where(F.pmod(F.xxhash64("sketch_path", "hash_value"), F.lit(every)) == 0)
    hot = materialise(part.groupBy("hash_value").agg(F.count("*").alias("n")).where(F.col("n") > least // every).select("hash_value"), "overlap-hot")
    return None if hot.isEmpty() else hot


def _hot_cell(members: DataFrame, limits: list[int]) -> DataFrame:
    """Sizes and runs of the hot identifiers: the same rows as of a range, by set instead of by identifier."""
    bounds = np.array(limits[:-1], np.uint64)

    def run(batches):
        for batch in batches:
            for sid, grp, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = np.sort(np.array(values, np.int64).view(np.uint64))
                level, n = np.unique(_levels(h, bounds), return_counts=True)
                yield _out(_SIZE, np.full(len(level), sid), level, _HOT_CELL, n, None)
                yield _out(_RUN, np.array([sid]), np.array([grp]), _HOT_CELL, np.array([len(h)]), (np.array([0, len(h)]), np.diff(h, prepend=np.uint64(0)).view(np.int64)))

    held = members.groupBy("set_id", "grp").agg(F.collect_list("hash_value").alias("h"))  # at most HOT_IDS of one set
    return held.mapInArrow(run, _CELL_SCHEMA)


def _group_cells(sid, level, h, cell, grp):
    ids, s = np.unique(sid, return_inverse=True)
    order = np.argsort(h, kind="stable")
    h, s, level = h[order], s[order], level[order]
    # equal hashes lie together: order those few by set and drop repeats
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    tied = same.copy()
    tied[:-1] |= same[1:]
    t = np.flatnonzero(tied)
    if len(t):
        inner = np.lexsort((s[t], h[t]))
        h[t], s[t], level[t] = h[t][inner], s[t][inner], level[t][inner]
        repeat = np.zeros(len(h), bool)
        repeat[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
        if repeat.any():
            keep = ~repeat
            h, s, level = h[keep], s[keep], level[keep]
    n_levels = int(level.max()) + 1
    full, n = np.unique(s.astype(np.int64) * n_levels + level, return_counts=True)
    yield _out(_SIZE, ids[full // n_levels], full % n_levels, cell, n, None)

    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    group = np.cumsum(first) - 1
    df_of = np.bincount(group)
    shared = df_of[group] > 1
    if not shared.any():
        return
    # runs: identifiers ascending within each set, as differences
    hs, ss = h[shared], s[shared]
    by_set = np.lexsort((hs, ss))
    rs, rh = ss[by_set], hs[by_set]
    deltas = rh.copy()
    deltas[1:] -= rh[:-1]
    starts = np.flatnonzero(np.r_[True, rs[1:] != rs[:-1]])
    deltas[starts] = rh[starts]
    ends = np.r_[starts[1:], len(rs)]
    yield _out(_RUN, ids[rs[starts]], np.full(len(starts), grp), cell, ends - starts, (np.r_[0, ends], deltas.view(np.int64)))


def _pairs_of_cell(limits: list[int], share: float):
    """Candidate pairs of one range's sizes and runs; ``limits``: ascending bounds of the levels. ``rate`` (null: ``share``) is
    what a set must share in at least one range."""
    bounds = np.array(limits[:-1], np.uint64)
    n_levels = len(limits)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        kind, a, b, n = (table.column(i).to_numpy() for i in ("kind", "a", "b", "n"))
        is_run = kind == _RUN
        ids, owner = np.unique(a[is_run], return_inverse=True)
        grp = b[is_run]
        rates = np.full(len(ids), share)
        given = table.column("rate").to_numpy(zero_copy_only=False).astype(float)[is_run]
        rates[owner] = np.where(np.isnan(given), share, given)
        lists = table.filter(pa.array(is_run)).column("deltas").combine_chunks()
        off = lists.offsets.to_numpy().astype(np.int64)
        h = decode_runs(off - off[0], lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64))
        length = np.diff(off)
        s, g = np.repeat(owner, length), np.repeat(grp, length)
        # sizes per set and level; sets without a run here look for nobody
        at = np.searchsorted(ids, a[~is_run])
        known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == a[~is_run]) if len(ids) else np.zeros(0, bool)
        codes = at[known] * n_levels + b[~is_run][known].astype(np.int64)
        order = np.argsort(codes)
        codes, sizes = codes[order], n[~is_run][known][order]
        found = [_seek(h[m], s[m], _levels(h[m], bounds), codes, sizes, n_levels, rates) for m in (g == x for x in np.unique(grp))]
        code = np.concatenate(found) if found else np.empty(0, np.int64)
        return pa.table({"a": pa.array(ids[code // max(len(ids), 1)], pa.int64()), "b": pa.array(ids[code % max(len(ids), 1)], pa.int64())})

    return run


def _seek(h, s, level, codes, sizes, n_levels, rates) -> np.ndarray:
    """Codes of the pairs that the rarest identifiers of each set and level find."""
    n_ids = len(rates)
    order = np.argsort(h, kind="stable")
    h, s, level = h[order], s[order], level[order]
    first = np.r_[True, h[1:] != h[:-1]]
    where = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    width = np.diff(np.r_[begin, len(h)])
    df = width[where]
    mine, cs = np.unique(s.astype(np.int64) * n_levels + level, return_inverse=True)
    whole = sizes[np.searchsorted(codes, mine)]
    prefix = whole - np.maximum(1, np.ceil(whole * rates[mine // n_levels] - 1e-9).astype(np.int64)) + 1
    lone = whole - np.bincount(cs, minlength=len(mine))  # identifiers of no second set are the rarest
    rare = np.lexsort((h, df, cs))
    c = cs[rare]
    head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    rank = np.empty(len(c), np.int64)
    rank[rare] = np.arange(len(c)) - np.repeat(head, np.diff(np.r_[head, len(c)]))
    seeks = np.flatnonzero((rank + lone[cs] < prefix[cs]) & (df > 1))
    found, lo = np.empty(0, np.int64), 0
    if not len(seeks):
        return found
    todo = np.cumsum(width[where[seeks]])
    cuts = np.searchsorted(todo, np.arange(_PAIRS_AT_ONCE, todo[-1] + _PAIRS_AT_ONCE, _PAIRS_AT_ONCE), "left") + 1
    for hi in np.unique(np.r_[np.minimum(cuts, len(seeks)), len(seeks)]):
        part = seeks[lo:hi]
        if len(part):
            w = width[where[part]]
            left = np.repeat(s[part], w).astype(np.int64)
            offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            right = s[np.repeat(begin[where[part]], w) + offset].astype(np.int64)
            ok = left != right
            found = np.union1d(found, np.minimum(left, right)[ok] * n_ids + np.maximum(left, right)[ok])
        lo = hi
    return found


def _rates(cells: DataFrame, share: float) -> DataFrame:
    """(a, rate, seeks): what a set must share of its other identifiers given its hot ones, the least over its levels, and how
    many of its hot identifiers must look for partners themselves (0: none)."""
    hot = F.col("cell") == _HOT_CELL
    per = cells.where(F.col("kind") == _SIZE).groupBy("a", "b").agg(F.sum(F.when(hot, F.col("n")).otherwise(0)).alias("h"), F.sum(F.when(hot, 0).otherwise(F.col("n"))).alias("c"))
    sizes = per.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "h", "c"))).alias("l"))  # at most one entry per level
    upto = lambda x, f: F.aggregate(F.filter("l", lambda y: y["b"] <= x["b"]), F.lit(0).cast("bigint"), lambda t, y: t + y[f])
    needs = F.transform("l", lambda x: F.struct((F.lit(share) * (upto(x, "h") + upto(x, "c")) - upto(x, "h")).alias("q"), upto(x, "h").alias("h"), upto(x, "c").alias("c")))
    rows = sizes.select("a", needs.alias("q"))
    rate = F.array_min(F.transform("q", lambda x: F.greatest(F.lit(0.0), x["q"]) / F.greatest(x["c"], F.lit(1))))
    # where hot ones alone can make the share t * n, one of the shared is among the rarest h - ceil(t * n) + 1
    seeks = F.array_max(F.transform("q", lambda x: F.when(x["q"] <= 1e-9, x["h"] - F.greatest(F.lit(1), F.ceil(x["q"] + x["h"] - 1e-9)) + 1).otherwise(0)))
    return rows.select("a", rate.alias("rate"), seeks.cast("bigint").alias("seeks"))


def _hot_pairs(members: DataFrame, rates: DataFrame) -> DataFrame:
    """(a, b) found through hot identifiers (set_id, grp, hash_value). Holders of one are dealt to slices; every seeker meets
    each slice. ``rates`` leaves out copies."""
    held = materialise(members.withColumnRenamed("set_id", "a").join(rates.select("a", "seeks"), "a"), "overlap-held")
    df = held.groupBy("grp", "hash_value").agg(F.count("*").alias("df"))
    slices = broadcast_if_small(materialise(df.withColumn("slices", F.ceil(F.col("df") / HOT_SETS).cast("int")), "overlap-slices"), BROADCAST_SETS)
    rank = F.row_number().over(Window.partitionBy("a").orderBy("df", "hash_value"))
    keys = ["grp", "hash_value"]
    seekers = held.where("seeks > 0").join(slices, keys).withColumn("rank", rank).where("rank <= seeks")
    seekers = seekers.select(*keys, F.col("a").alias("x"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    holders = held.join(slices, keys).select(*keys, "a", F.pmod(F.xxhash64("a"), F.col("slices")).cast("int").alias("slice"))
    met = seekers.join(holders, [*keys, "slice"]).where("x <> a")
    return met.select(F.least("x", "a").alias("a"), F.greatest("x", "a").alias("b"))


def _copies(cells: DataFrame, about: DataFrame) -> DataFrame:
    """(a, rep, m) of every set that has copies: equal runs in every range, no identifier of its own, equal parameters."""
    total = cells.where(F.col("kind") == _SIZE).groupBy("a").agg(F.sum("n").alias("total"))
    digest = lambda i: F.sum(F.xxhash64(F.lit(i), "cell", "deltas").cast("decimal(38,0)"))
    content = cells.where(F.col("kind") == _RUN).groupBy("a").agg(F.sum("n").alias("n"), digest(1).alias("d1"), digest(2).alias("d2"))
    whole = content.join(total, "a").where("n = total").join(about.select("a", "ksize", "seed", "scaled"), "a")
    keys = ["ksize", "seed", "scaled", "n", "d1", "d2"]
    classes = whole.groupBy(*keys).agg(F.min("a").alias("rep"), F.count("*").alias("m")).where("m > 1")
    return whole.join(classes, keys).select("a", "rep", "m")


def _out(kind, a, b, cell, n, deltas):
    k = len(a)
    lists = pa.nulls(k, pa.list_(pa.int64()))
    if deltas is not None:
        lists = pa.ListArray.from_arrays(pa.array(deltas[0], pa.int32()), pa.array(deltas[1], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k, kind), pa.int8()),
            pa.array(a, pa.int64()),
            pa.nulls(k, pa.int64()) if b is None else pa.array(b, pa.int64()),
            pa.array(np.full(k, cell), pa.int32()),
            pa.array(n, pa.int64()),
            lists,
        ],
        names=["kind", "a", "b", "cell", "n", "deltas"],
    )


def decode_runs(offsets: np.ndarray, deltas: np.ndarray) -> np.ndarray:
    """Values of delta-encoded runs laid end to end."""
    total = np.cumsum(deltas.astype(np.uint64), dtype=np.uint64)
    starts = offsets[:-1]
    lengths = np.diff(offsets)
    before = np.where(starts > 0, total[np.maximum(starts, 1) - 1], np.uint64(0)) if len(total) else np.zeros(len(starts), np.uint64)
    return total - np.repeat(before, lengths)


def gallop(needles: np.ndarray, lo: np.ndarray, hi: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """Whether each needle is in its own sorted segment hay[lo:hi]: exponential, then binary search, all at once."""
    step = np.ones(len(needles), np.int64)
    left, right = lo.astype(np.int64), hi.astype(np.int64)
    base = left.copy()
    active = np.flatnonzero(left < right)
    while len(active):
        probe = base[active] + step[active] - 1
        inside = probe < right[active]
        smaller = np.zeros(len(active), bool)
        smaller[inside] = hay[probe[inside]] < needles[active[inside]]
        done = ~smaller
        ended = active[done]
        right[ended] = np.minimum(right[ended], base[ended] + step[ended])
        going = active[smaller]
        left[going] = probe[smaller] + 1
        step[going] *= 2
        active = going
    active = np.flatnonzero(left < right)
    while len(active):
        mid = (left[active] + right[active]) // 2
        smaller = hay[mid] < needles[active]
        left[active[smaller]] = mid[smaller] + 1
        right[active[~smaller]] = mid[~smaller]
        active = active[left[active] < right[active]]
    found = left < hi
    found[found] = hay[left[found]] == needles[found]
    return found


def linear_merge(pair_a: np.ndarray, a: np.ndarray, pair_b: np.ndarray, b: np.ndarray, n_pairs: int) -> np.ndarray:
    """Common values per pair of two runs each ascending by (pair, value): one merge of the two.

    Pair and value make one number, the value counted from the least one; as many pairs at a time as its bits allow.
    """
    out = np.zeros(n_pairs, np.int64)
    if not len(a) or not len(b):
        return out
    least = min(a.min(), b.min())
    width = int(max(a.max(), b.max()) - least) + 1
    at_once = max(1, (2**64 - 1) // width)
    for lo in range(0, n_pairs, at_once):
        hi = min(n_pairs, lo + at_once)
        (a0, a1), (b0, b1) = np.searchsorted(pair_a, (lo, hi)), np.searchsorted(pair_b, (lo, hi))
        # with a width of 2^64 there is one pair at a time and nothing to add
        keys = [((p - lo).astype(np.uint64) * np.uint64(width % 2**64)) + (v - least) for p, v in ((pair_a[a0:a1], a[a0:a1]), (pair_b[b0:b1], b[b0:b1]))]
        merged = np.concatenate(keys)
        merged.sort(kind="stable")  # two ascending runs: the stable sort finds them and merges once
        twice = merged[1:][merged[1:] == merged[:-1]]
        if hi - lo == 1:
            out[lo] = len(twice)
        else:
            out[lo:hi] = np.bincount((twice // np.uint64(width)).astype(np.int64), minlength=hi - lo)
    return out


def intersect_runs(off_a, flat_a, off_b, flat_b) -> np.ndarray:
    """Number of common values of run i of A and run i of B, for every i."""
    len_a, len_b = np.diff(off_a), np.diff(off_b)
    n = len(len_a)
    out = np.zeros(n, np.int64)
    far = np.maximum(len_a, len_b) >= GALLOP_RATIO * np.minimum(len_a, len_b)
    for small_off, small, big_off, big, mine in ((off_a, flat_a, off_b, flat_b, len_a <= len_b), (off_b, flat_b, off_a, flat_a, len_a > len_b)):
        rows = np.flatnonzero(far & mine)
        if len(rows):
            size = np.diff(small_off)[rows]
            at = np.repeat(small_off[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit = gallop(small[at], np.repeat(big_off[rows], size), np.repeat(big_off[rows + 1], size), big)
            out[rows] = np.bincount(np.repeat(np.arange(len(rows)), size)[hit], minlength=len(rows))
    rows = np.flatnonzero(~far)
    if len(rows):
        keep_a, keep_b = np.repeat(~far, len_a), np.repeat(~far, len_b)
        index = np.cumsum(~far) - 1
        out[rows] = linear_merge(np.repeat(index, len_a)[keep_a], flat_a[keep_a], np.repeat(index, len_b)[keep_b], flat_b[keep_b], len(rows))
    return out


def _count_pairs(key, pairs: pa.Table, runs: pa.Table) -> pa.Table:
    """(a, b, n) of the pairs of one task, from the runs of its cell; a pair without a run of both sets shares nothing here."""
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    runs = runs.combine_chunks()
    ids = runs.column("a").to_numpy()
    if not len(ids) or not len(a):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    lists = runs.column("deltas").combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = decode_runs(off - off[0], lists.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64))
    off = off - off[0]
    order = np.argsort(ids, kind="stable")
    at = [order[np.minimum(np.searchsorted(ids, x, sorter=order), len(ids) - 1)] for x in (a, b)]
    there = (ids[at[0]] == a) & (ids[at[1]] == b)
    a, b, at = a[there], b[there], [x[there] for x in at]
    size = np.diff(off)
    todo = np.cumsum(size[at[0]] + size[at[1]])
    n = np.zeros(len(a), np.int64)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(todo, (todo[lo - 1] if lo else 0) + _VALUES_AT_ONCE, "right")))
        sides = []
        for x in at:
            m = size[x[lo:hi]]
            ends = np.cumsum(m)
            sides += [np.r_[0, ends], flat[np.repeat(off[x[lo:hi]], m) + np.arange(m.sum()) - np.repeat(ends - m, m)]]
        n[lo:hi] = intersect_runs(*sides)
        lo = hi
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _salted(df: DataFrame, rows: int, key: str, other: DataFrame, spread: str) -> DataFrame:
    """``df`` joined to ``other`` (several rows per ``key``) where a key may be in very many rows of ``df``: those are dealt to
    slices by ``spread``, and ``other``'s rows of the key go to each."""
    least = hot_from(df, rows)
    if rows <= least:
        return df.join(other, key)
    hot = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    slices = F.broadcast(materialise(hot.select(key, F.ceil(F.col("_n") / least).cast("int").alias("_s")), "overlap-degrees"))  # at most MOST_HOT rows
    one = F.coalesce(F.col("_s"), F.lit(1))
    left = df.join(slices, key, "left").withColumn("_k", F.pmod(F.xxhash64(spread), one).cast("int")).drop("_s")
    right = other.join(slices, key, "left").withColumn("_k", F.explode(F.sequence(F.lit(0), one - 1))).drop("_s")
    return left.join(right, [key, "_k"]).drop("_k")


def _counts(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(a, b, n_shared) of ``pairs`` from ``runs`` (a, cell, deltas); both are written tables."""
    n = pairs.count()
    large = lambda df: materialise(df, "overlap-pairs") if n > ONE_TASK else df
    # a pair goes to the cells of the set that has fewer
    cells_of = large(runs.groupBy("a").agg(F.count("*").alias("c")))
    both = large(lookup(pairs, "a", cells_of.withColumnRenamed("c", "ca"), rows=n))
    both = large(lookup(both, "b", cells_of.select(F.col("a").alias("b"), F.col("c").alias("cb")), rows=n))
    swap = F.coalesce(F.col("cb"), F.lit(0)) < F.coalesce(F.col("ca"), F.lit(0))
    facing = large(both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")))
    todo = materialise(_salted(facing, n, "a", runs.select("a", "cell"), "b"), "overlap-todo")
    named = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    sent = runs.join(broadcast_if_small(named, BROADCAST_SETS), "a", "left_semi")
    keys = ["cell"]
    if todo.count() > PAIRS_PER_TASK:
        # a cell with very many pairs is a grid over the blocks of both sets: its runs go to one row and one column of it
        grids = materialise(todo.groupBy("cell").agg(F.ceil(F.sqrt(F.count("*") / PAIRS_PER_TASK)).cast("int").alias("g")), "overlap-grids")
        grids = broadcast_if_small(grids, 1_000_000)
        block = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
        todo = todo.join(grids, "cell").select("a", "b", "cell", block("a").alias("i"), block("b").alias("j"))
        every, mine = F.sequence(F.lit(0), F.col("g") - 1), F.col("_b")
        places = F.array_distinct(F.concat(F.transform(every, lambda k: F.struct(mine.alias("i"), k.alias("j"))), F.transform(every, lambda k: F.struct(k.alias("i"), mine.alias("j")))))
        sent = sent.join(grids, "cell").withColumn("_b", block("a")).withColumn("_p", F.explode(places)).select("a", "deltas", "cell", "_p.i", "_p.j")
        keys = ["cell", "i", "j"]
    met = todo.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_count_pairs, "a bigint, b bigint, n bigint")
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n_shared")).where("n_shared > 0")


def _slices(m: Column) -> Column:
    return F.ceil(m / MEMBERS_PER_SLICE).cast("int")


def _expand(rows: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """``rows`` with the members (``of_<key>``) of the group that ``key`` stands for, large groups in slices."""
    large = broadcast_if_small(members.where(F.col("m") > MEMBERS_PER_SLICE).select(F.col("rep").alias(key), _slices(F.col("m")).alias("_s")).distinct(), BROADCAST_SETS)
    left = rows.join(large, key, "left").withColumn("_k", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_s"), F.lit(1)) - 1))).drop("_s")
    right = members.select(F.col("rep").alias(key), F.col("of").alias(f"of_{key}"), F.pmod(F.xxhash64("a"), _slices(F.col("m"))).cast("int").alias("_k"))
    return left.join(right, [key, "_k"]).drop("_k")


def overlaps(hashes: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(sketch_path_a, sketch_path_b, ksize, seed, scaled, n_shared, n_a, n_b) of pairs that share at least ``share``.

    ``share`` is of the smaller set at the coarser ``scaled``; 0 gives every pair with a common hash. a < b as strings.
    """
    # the distinct values of one parameter, 8 bytes each
    order = sorted((r[0] for r in sets.select("scaled").distinct().collect()), reverse=True)
    limits = [-(-(2**64) // s) for s in order] or [0]
    numbered = sets.sparkSession.createDataFrame(list(enumerate(order)), "level_of_set int, scaled long")
    keyed = sets.join(F.broadcast(numbered), "scaled")
    slim = keyed.select("sketch_path", "set_id", _limit(F.col("scaled")).alias("limit"), F.hash("ksize", "seed").alias("grp"))
    if rows_at_most(slim, BROADCAST_SETS):
        slim = F.broadcast(slim)
    own = hashes.where("hash_value is not null").select("sketch_path", F.col("hash_value").cast("bigint"))
    rows = hashes.count()
    hot = _hot_identifiers(own, sets.count(), rows)
    whole = own if hot is None else own.join(F.broadcast(hot), "hash_value", "left_anti")
    held = lambda part: part.join(slim, "sketch_path").where(F.col("limit").isNull() | (_order(F.col("hash_value")) < F.col("limit"))).select("set_id", "grp", "hash_value")
    cells = _cells(held(whole), max(4, -(-rows // ROWS_PER_RANGE)), limits)
    if hot is not None:
        hot_members = materialise(held(own.join(F.broadcast(hot), "hash_value", "left_semi")).distinct(), "overlap-hot-members")
        cells = cells.unionByName(_hot_cell(hot_members, limits))
    cells = materialise(cells, "overlap-cells")
    # sizes per set as an array over levels, at most one entry per distinct scaled
    sizes = (
        cells.where(F.col("kind") == _SIZE)
        .groupBy("a", F.col("b").cast("int").alias("level"))
        .agg(F.sum("n").alias("n"))
        .groupBy("a")
        .agg(F.collect_list(F.struct("level", "n")).alias("sizes"))
    )
    about = keyed.select(F.col("set_id").alias("a"), "sketch_path", "ksize", "seed", "scaled", "level_of_set").join(sizes, "a")
    copies = materialise(_copies(cells, about), "overlap-copies")
    single = cells.join(copies.where("a <> rep").select("a"), "a", "left_anti")  # one of each group of copies
    found, seen = [], single.withColumn("rate", F.lit(None).cast("double"))
    if hot is not None:
        rates = materialise(_rates(single, share), "overlap-rates")
        found.append(_hot_pairs(hot_members, rates))
        seen = single.join(rates.select("a", "rate"), "a", "left")
    found.append(seen.where(F.col("cell") != _HOT_CELL).groupBy("cell").applyInArrow(_pairs_of_cell(limits, share), "a bigint, b bigint"))
    pairs = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    pairs = materialise(pairs.distinct(), "overlap-candidates")
    counts = _counts(pairs, single.where(F.col("kind") == _RUN).select("a", "cell", "deltas"))
    columns = ["sketch_path", "ksize", "seed", "scaled", "level_of_set", "sizes"]
    members = about.join(copies, "a", "left").select("a", F.coalesce("rep", "a").alias("rep"), F.coalesce("m", F.lit(1)).alias("m"), F.struct(*columns).alias("of"))
    both = _expand(_expand(counts, "a", members), "b", members).select("n_shared", "of_a", "of_b")
    # copies among themselves share all they have
    same = members.join(copies.select("a"), "a", "left_semi")
    total = lambda c: F.aggregate(f"{c}.sizes", F.lit(0).cast("bigint"), lambda t, y: t + y["n"])
    twins = _expand(same.select(F.col("of").alias("of_a"), F.col("rep").alias("b")), "b", same).where("of_a.sketch_path < of_b.sketch_path")
    both = both.unionByName(twins.select(total("of_a").alias("n_shared"), "of_a", "of_b"))
    both = both.where("of_a.ksize = of_b.ksize and of_a.seed = of_b.seed and of_a.sketch_path <> of_b.sketch_path")
    level = F.least("of_a.level_of_set", "of_b.level_of_set")
    size = lambda x: F.aggregate(F.filter(f"of_{x}.sizes", lambda y: y["level"] <= F.col("level")), F.lit(0).cast("bigint"), lambda t, y: t + y["n"])
    both = both.withColumn("level", level).withColumn("size_a", size("a")).withColumn("size_b", size("b"))
    both = both.where(F.col("n_shared") >= F.lit(share) * F.least("size_a", "size_b") - 1e-9)
    swap = F.col("of_a.sketch_path") > F.col("of_b.sketch_path")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return both.select(
        pick("of_a.sketch_path", "of_b.sketch_path").alias("sketch_path_a"),
        pick("of_b.sketch_path", "of_a.sketch_path").alias("sketch_path_b"),
        F.col("of_a.ksize").alias("ksize"),
        F.col("of_a.seed").alias("seed"),
        F.greatest("of_a.scaled", "of_b.scaled").alias("scaled"),
        "n_shared",
        pick("size_a", "size_b").alias("n_a"),
        pick("size_b", "size_a").alias("n_b"),
    ).distinct()
