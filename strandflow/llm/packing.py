"""Documents packed into containers of one fixed capacity in tokens.

Method: mixture-controlled packing. Every source has a target share of the tokens. As long as no source is used up, windows
can be at the targets: of each source the tokens for that many windows are dealt, by a hash of the row, to buckets that are
filled at the targets; what other sources have beyond it goes to buckets that are filled at the shares of that rest. So a
window is either at the targets or made of what the targets left over, and no source or key is hot.

In each bucket every source is a queue. Deficit round-robin gives each queue its target share of tokens per window of
containers; a queue's unspent (or overspent) share is carried into the next window, and what earlier buckets owe a source is
carried into the next bucket through prefix sums of the bucket totals. A window's documents go best-fit-decreasing into its
containers. Containers close with their window: documents of those that are less full than ``FULL`` (the emptiest quarter at
most) go back to the head of their queues, with their share, so a window holds what the round-robin chose for it and hardly
any room is left.

A document is cut only if it exceeds the capacity: into full containers and a rest, which queue like documents.

Defined results: null and empty texts have 0 tokens and still get a place; a null source is a source of its own; target
shares default to the corpus's own, so that nothing is left over; a target for a source that has no tokens is left out and
the others grow to 1; a source without a share is packed with the rest; repeated keys are packed as often as they occur;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.session import broadcast_if_small, materialise
from strandflow.llm import tokens

CAPACITY = 2048
ITEMS_PER_BUCKET = 20_000
CONTAINERS_PER_WINDOW = 64
#: Containers less full than this give their documents back, unless nothing else is left.
FULL = 0.93
#: Buckets whose totals one window function takes; their sums go to the next level.
BUCKETS_PER_GROUP = 10_000


class Mixer:
    """Deficit round-robin over queues: source -> deque of (size, ...)."""

    def __init__(self, queues: dict, shares: dict, carry: dict, quantum: int):
        self.queues, self.shares, self.quantum = queues, shares, quantum
        self.order = sorted(queues, key=str)
        self.deficit = {s: float(carry.get(s, 0.0)) for s in queues}

    def __bool__(self) -> bool:
        return any(self.queues.values())

    def window(self, tokens: int) -> list[tuple]:
        """(source, item) of the next window of at least so many tokens, or of all that is left."""
        taken, used, deficit = [], 0, self.deficit
        active = [s for s in self.order if self.queues[s]]
        while active and used < tokens:
            weights = {s: max(self.shares.get(s, 0.0), 0.0) for s in active}
            whole = sum(weights.values())
            if whole <= 0:  # only sources without a target are left
                weights, whole = dict.fromkeys(active, 1.0), float(len(active))
            # as many rounds at once as the nearest queue needs to send its first item
            rate = {s: self.quantum * w / whole for s, w in weights.items() if w > 0}
            rounds = min(max(0.0, (self.queues[s][0][0] - deficit[s]) / r) for s, r in rate.items())
            for s, r in rate.items():
                deficit[s] += r * max(rounds, 1.0) if rounds > 0 else r
            for s in list(rate):
                q = self.queues[s]
                while q and q[0][0] <= deficit[s] + 1e-9 and used < tokens:
                    item = q.popleft()
                    deficit[s] -= item[0]
                    used += item[0]
                    taken.append((s, item))
                if not q:
                    active.remove(s)
        return taken

    def give_back(self, source, item: tuple) -> None:
        self.queues[source].appendleft(item)
        self.deficit[source] += item[0]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items in each container: by falling size, ties in order, each where the least room is left."""
    boxes: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, container), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, box = room.pop(at)
        else:
            left, box = capacity, len(boxes)
            boxes.append([])
        boxes[box].append(i)
        if left > sizes[i]:
            insort(room, (left - sizes[i], box))
        elif not left:
            insort(room, (0, box))
    return boxes


def pack_bucket(sizes, sources, carries, shares, capacity: int, first_id: int):
    """Placement of items in order: lists (item, piece, container, window, doc_begin, container_begin, n)."""
    queues: dict = {}
    carry: dict = {}
    for i, (n, s, c) in enumerate(zip(sizes, sources, carries)):
        q, begin = queues.setdefault(s, deque()), 0
        while n > capacity:  # pieces of a document above the capacity queue one by one, so that none fills a window alone
            q.append((capacity, i, begin))
            n, begin = n - capacity, begin + capacity
        q.append((n, i, begin))  # tokens, item, tokens before
        carry[s] = c
    mixer, out = Mixer(queues, shares, carry, capacity), []
    box, window = first_id, 0
    while mixer:
        taken = mixer.window(capacity * CONTAINERS_PER_WINDOW)
        boxes = best_fit([item[0] for _, item in taken], capacity)
        fill = [sum(taken[k][1][0] for k in held) for held in boxes]
        # the emptiest give back, at most a quarter, so that a bucket of documents that don't fit together ends as well
        loose = sorted((n, k) for k, n in enumerate(fill) if n < FULL * capacity)[: len(boxes) // 4] if mixer else []
        loose = {k for _, k in loose}
        back = []
        for number, held in enumerate(boxes):
            if number in loose:
                back += held
                continue
            at = 0
            for k in held:
                n, i, begin = taken[k][1]
                out.append((i, begin // capacity, box, window, begin, at, n))
                at += n
            box += 1
        for k in sorted(back, reverse=True):
            mixer.give_back(*taken[k])
        window += 1
    return out


def sized(df: DataFrame, key: str, text: str, source: str, path: str | None = None) -> DataFrame:
    """(key, source, n_tokens, row) of every document, written once."""
    counted = tokens.count(df.withColumn("_source", F.col(source).cast("string")), text, [key, "_source"], path)
    return materialise(counted.withColumnRenamed("_source", "source").withColumn("row", F.monotonically_increasing_id()), "packing-sizes")


def _running(totals: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``totals`` (one row per bucket and ``by``) with the sum of ``value`` over earlier buckets of the same ``by``."""
    groups = totals.groupBy(*by, "group").agg(F.sum(value).alias("_g"))  # one row per BUCKETS_PER_GROUP buckets
    outer = Window.partitionBy(*by).orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("group").alias("_group"), F.coalesce(F.sum("_g").over(outer), F.lit(0)).alias("_b"))
    same = F.col("group") == F.col("_group")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = Window.partitionBy(*by, "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = totals.withColumn("_w", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return own.join(groups, same).withColumn(name, F.col("_w") + F.col("_b")).drop("_w", "_b", "_group", *[f"_{c}" for c in by])


def shares_of(totals: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """(source, t, share, kept): tokens, target share, and which part of the source is packed at the targets; ``totals`` (source, t)."""
    if targets is None:
        whole = totals.agg(F.sum("t")).first()[0] or 0
        return totals.select("source", "t", (F.col("t") / max(whole, 1)).alias("share"), F.lit(1.0).alias("kept"))
    given = totals.sparkSession.createDataFrame([(s, float(w)) for s, w in targets.items() if w > 0], "_s string, w double")
    named = totals.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("w", F.when(F.col("t") > 0, F.col("w")))
    named = materialise(named, "packing-shares")
    whole = named.agg(F.sum("w")).first()[0]
    if not whole:
        return shares_of(totals, None)
    named = named.withColumn("share", F.coalesce(F.col("w") / whole, F.lit(0.0)))
    most = named.where("share > 0").agg(F.min(F.col("t") / F.col("share"))).first()[0]  # tokens until the first source is used up
    return named.select("source", "t", "share", F.when(F.col("share") > 0, F.least(F.lit(1.0), most * F.col("share") / F.col("t"))).otherwise(0.0).alias("kept"))


def pack(
    sizes: DataFrame, key: str, capacity: int = CAPACITY, targets: dict[str, float] | None = None, items_per_bucket: int = ITEMS_PER_BUCKET
) -> DataFrame:
    """(key, piece_no, container_id, window_no, at_target, source, doc_begin, container_begin, n_tokens); ``sizes`` from :func:`sized`.

    ``at_target`` is false in the windows of what the targets left over.
    """
    per_source = materialise(sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "packing-sources")
    shares = shares_of(per_source.select("source", "t"), targets).select(F.col("source").alias("_s"), "share", "kept")
    shares = materialise(shares, "packing-shares")
    met = per_source.join(shares, F.col("source").eqNullSafe(F.col("_s")))
    # documents and tokens that go to buckets at the targets and to the others: two numbers each
    parts = met.agg(F.sum(F.col("n") * F.col("kept")).alias("at"), F.sum(F.col("n") * (1 - F.col("kept"))).alias("rest")).first()
    at, rest = (max(1, -(-int(x or 0) // items_per_bucket)) for x in parts)
    draw = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n))
    items = sizes.join(broadcast_if_small(shares, 1_000_000), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "share")
    items = items.withColumn("at_target", draw(1, 1 << 30) < F.col("kept") * (1 << 30))
    items = items.withColumn("bucket", F.when(F.col("at_target"), draw(2, at)).otherwise(draw(3, rest) + at)).drop("kept")
    totals = items.groupBy("bucket", "at_target", "source").agg(F.sum("n_tokens").alias("t"))
    totals = materialise(totals.withColumn("group", F.floor(F.col("bucket") / BUCKETS_PER_GROUP)), "packing-totals")  # buckets x sources
    # in the buckets of the rest a source's share is its own of the rest
    left = totals.where(~F.col("at_target")).groupBy(F.col("source").alias("_r")).agg(F.sum("t").alias("rest"))
    whole = left.agg(F.sum("rest")).first()[0] or 0
    shares = shares.join(left, F.col("_s").eqNullSafe(F.col("_r")), "left").select("_s", "share", (F.coalesce("rest", F.lit(0)) / max(whole, 1)).alias("rest_share"))
    given = _running(totals.groupBy("at_target", "bucket", "group").agg(F.sum("t").alias("b")), "b", ["at_target"], "given").select(F.col("bucket").alias("_b"), "given")
    carry = (
        _running(totals, "t", ["at_target", "source"], "had")
        .join(given, F.col("bucket") == F.col("_b"))
        .drop("_b")
        .join(shares, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("share", F.when(F.col("at_target"), F.col("share")).otherwise(F.col("rest_share")))
        .select(F.col("bucket").alias("_b"), "_s", "share", (F.col("share") * F.col("given") - F.col("had")).cast("double").alias("carry"))
    )
    ready = items.join(carry, (F.col("bucket") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col(key), "source", "n_tokens", "row", "bucket", "at_target", "share", "carry"
    )
    kind = sizes.schema[key].dataType.simpleString()
    columns = [key, "piece_no", "container_id", "window_no", "at_target", "source", "doc_begin", "container_begin", "n_tokens"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable").reset_index(drop=True)
        source = pdf["source"].where(pdf["source"].notna(), None).tolist()
        shares = dict(zip(source, pdf["share"].tolist()))
        placed = pack_bucket(pdf["n_tokens"].tolist(), source, pdf["carry"].tolist(), shares, capacity, int(pdf["bucket"].iat[0]) << 36)
        out = pd.DataFrame(placed, columns=["item", "piece_no", "container_id", "window_no", "doc_begin", "container_begin", "n_tokens"])
        at = out.pop("item").to_numpy()
        out[key], out["source"], out["at_target"] = pdf[key].to_numpy()[at], pdf["source"].to_numpy()[at], bool(pdf["at_target"].iat[0])
        return out[columns]

    return ready.groupBy("bucket").applyInPandas(
        run,
        f"`{key}` {kind}, piece_no int, container_id bigint, window_no int, at_target boolean, source string, doc_begin bigint, container_begin int, n_tokens int",
    )


def mixture(packed: DataFrame) -> DataFrame:
    """(bucket, window_no, at_target, source, n_tokens, share): what each source holds of each window."""
    mixed = packed.groupBy(F.shiftright("container_id", 36).alias("bucket"), "window_no", "at_target", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    return mixed.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("bucket", "window_no")))
