"""Orphans, hot keys and nested records against brute force, with dirty inputs."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandflow.operators import eager, nested, orphans

T0 = datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


@pytest.mark.parametrize(("hot", "broadcast"), [(1, 0), (100, 0), (10**9, 0), (1000, 10**6)])
def test_orphans(spark, hot, broadcast, monkeypatch):
    monkeypatch.setattr(orphans, "hot_from", lambda df, rows: hot)
    monkeypatch.setattr(orphans, "BROADCAST_PERIODS", broadcast)
    rng = random.Random(1)
    targets = [(f"t{i}", day(s), day(s + rng.randrange(5, 40)) if rng.random() < 0.5 else None) for i in range(30) for s in rng.sample(range(100), 2)]
    refs = [(f"r{i}", rng.choice(["hot", "hot", "t1", f" x/t{rng.randrange(40)}\t", "a\\t2", "", "  ", None, "gone", "T1"]), day(rng.randrange(120)) if rng.random() < 0.95 else None) for i in range(1500)]
    refs += refs[:50]
    targets += [("hot", day(50), None), ("hot", day(10), day(20)), (None, day(1), None), ("noway", None, None)]
    r = spark.createDataFrame(refs, "k string, f string, at timestamp_ntz").withColumn("kind", F.lit("clash")).withColumn("spans", F.lit(1))
    t = spark.createDataFrame(targets, "n string, s timestamp_ntz, e timestamp_ntz")
    rows = orphans.references(r, "tab", "f", "k", "at", orphans.base_name(F.col("f")))
    states = orphans.lifetimes(t, "f", orphans.base_name(F.col("n")), "s", "e")

    def kind(name, at):
        mine = [(s, e) for n, s, e in targets if n == name and s is not None]
        if not mine:
            return "missing"
        if at is not None and any(s <= at and (e is None or e > at) for s, e in mine):
            return None
        return "deleted" if at is not None and any(e is not None and e <= at for _, e in mine) else "late"

    want, counts = set(), Counter()
    for k, f, at in refs:
        name = (f or "").strip().replace("\\", "/").rsplit("/", 1)[-1].strip()
        if (f or "").strip():
            x = kind(name, at)
            if x:
                period = at.strftime("%Y-%m") if at else None
                want.add(("tab", "f", k, period, x))
                counts[period, x] += 1
    assert {tuple(x) for x in orphans.find_orphans(rows, states).collect()} == want
    assert {(x.period, x.kind): x.n_rows for x in orphans.orphan_counts(rows, states).collect()} == dict(counts)
    assert orphans.find_orphans(rows.limit(0), states).count() == 0
    assert {x.kind for x in orphans.find_orphans(rows, states.limit(0)).collect()} == {"missing"}


def test_eager_counts(spark):
    rng = random.Random(2)
    left = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.choice(["g", "h", None]), rng.choice([1.5, 2.25, None])) for _ in range(300)]
    right = [(rng.choice(["hot"] * 5 + ["a", "z", None]), rng.choice([0.1, 10.0, None])) for _ in range(200)]
    lf = spark.createDataFrame(left, "k string, g string, v double").withColumn("l_n", F.lit(1)).withColumn("r_n", F.lit(1))
    rf = spark.createDataFrame(right, "k string, w double").withColumn("g", F.lit("clash"))
    got = {r.g: (r.n_left, r.n_joined, float(r.sum_v or 0), float(r.sum_w or 0)) for r in eager.join_counts(lf, rf, "k", ["g"], {"v": "v"}, {"w": "w"}).collect()}
    want = {}
    for g in {x[1] for x in left}:
        pairs = [(lv, rw) for k, gg, lv in left if gg == g for j, rw in right if j == k and k is not None]
        want[g] = (sum(x[1] == g for x in left), len(pairs), round(sum(a or 0 for a, _ in pairs), 6), round(sum(b or 0 for _, b in pairs), 6))
    assert {k: (a, b, round(c, 6), round(d, 6)) for k, (a, b, c, d) in got.items()} == want
    assert eager.join_counts(lf.limit(0), rf, "k", ["g"]).count() == 0


def test_heavy_values(spark):
    rows = [("t", "a")] * 2 + [("t", "b")] + [("t", None)] * 47 + [("t", f"x{i}") for i in range(50)] + [("u", " a "), ("u", None)]
    df = spark.createDataFrame(rows, "table_name string, key_value string")
    assert {tuple(r) for r in eager.heavy_values(df, 2).collect()} == {("t", "a"), ("u", " a ")}
    assert eager.heavy_values(df.limit(0), 2).count() == 0


def brute_elements(rid, payload):
    root = nested.unwrap(payload)
    if root is None:
        return set()
    as_list, out = nested.as_list, set()
    ids = {}
    for i, s in enumerate(as_list(root.get("sequences"))):
        if s is not None:
            out.add((rid, "sequences", i, -1, -1, -1))
            if isinstance(s, dict) and s.get("id") is not None:
                ids.setdefault(str(s["id"]), i)
    for i, f in enumerate(as_list(root.get("features"))):
        if f is None:
            continue
        ref = (f.get("sequence") if f.get("sequence") is not None else f.get("contig")) if isinstance(f, dict) else None
        s = ids.get(str(ref), -1) if ref is not None else -1
        out.add((rid, "features", s, i, -1, -1))
        if isinstance(f, dict):
            out |= {(rid, "db_xrefs", s, i, j, -1) for j, x in enumerate(as_list(f.get("db_xrefs"))) if x is not None}
            for j, p in enumerate(as_list(f.get("pfams"))):
                if p is not None:
                    out.add((rid, "pfams", s, i, j, -1))
                    if isinstance(p, dict):
                        out |= {(rid, "pfam_db_xrefs", s, i, j, m) for m, x in enumerate(as_list(p.get("db_xrefs"))) if x is not None}
    return out


def test_nested(spark):
    rng = random.Random(3)
    lone = lambda xs: xs[0] if xs and rng.random() < 0.3 else rng.choice([xs, xs, None]) if not xs else xs
    payloads = []
    for n in range(60):
        pf = lambda: {"id": "P", "db_xrefs": lone([f"x{k}" for k in range(rng.randrange(3))])}
        feats = [{"type": "cds", rng.choice(["sequence", "contig"]): rng.choice(["c1", "c2", "zz", None, 3]), "db_xrefs": lone(["a", None, "b"][: rng.randrange(4)]), "pfams": lone([pf() for _ in range(rng.randrange(3))]), "deep": {"x": [[1], {"y": [2]}]}} for _ in range(rng.randrange(5))]
        body = {"features": lone(feats), "sequences": lone([{"id": "c1"}, {"id": "c2"}, {"id": "c1"}, {"id": 3}, None][: rng.randrange(6)]), "version": {"v": 1}}
        if rng.random() < 0.5:
            body = dict(reversed(body.items()))
        text = json.dumps(body)
        payloads.append((n, rng.choice([text, text, json.dumps(text), f"[{text}]", json.dumps([json.dumps(body)]), text[:-3], "﻿" + text])))
    deep = 60_000
    payloads += [(106, '{"a":' * deep + '{"sequences": [{"id": 1}]}' + "}" * deep), (107, '{"sequences": [{"id": "c1"}, {"x": ' + "[" * deep + "]" * deep + "}]}")]
    payloads += [(100, None), (101, ""), (102, "[]"), (103, "7"), (104, "[" * 5000 + "]" * 5000), (105, '{"features": "alone"}'), payloads[0], (0, '{"sequences": [{"id": 1}, {"id": 2}]}')]
    df = spark.createDataFrame(payloads, "report_id long, payload string").withColumn("position", F.lit(1))
    want = set().union(*(brute_elements(*p) for p in payloads))
    got = [tuple(r) for r in nested.report_elements(df).collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {r.record_id: r["count"] for r in nested.label_nodes(df, "report_id", "payload").where("record_id in (106, 107)").groupBy("record_id").count().collect()}
    assert counts == {106: deep + 3, 107: deep + 3}
    nodes = nested.label_nodes(df, "report_id", "payload").where("record_id = 1").collect()
    for x in nodes:
        inside = [y for y in nodes if x.pre < y.pre and y.post < x.post]
        assert {y.pre for y in inside if y.depth == x.depth + 1} <= {y.pre for y in nodes if y.parent_pre == x.pre}
        assert x.pre < x.post
    assert len({n for x in nodes for n in (x.pre, x.post)}) == 2 * len(nodes)
    assert nested.report_elements(df.limit(0)).count() == 0
    assert set(nested.node_tables(nested.label_nodes(df, "report_id", "payload"))) == set(nested.REPORT_TYPES.values())


def test_json_reader():
    good = ['{"a": [1, -2.5e3, true, false, null, "x\\u00e9\\n", {}, [], {"b": {}}]}', " [ ] ", "7", '"t"', '{"a":1,"a":2}', "[[[1],2],3]", "[NaN, -Infinity]"]
    for text in good:
        assert repr(nested.read_json(text)) == repr(json.loads(text))
    for text in ["", "[", "[1", "[1,]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "[1]]", "01", "nul", '"x', "{]", "[}"]:
        with pytest.raises(ValueError):
            nested.read_json(text)
