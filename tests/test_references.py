"""Closures and components over all references, against plain Python."""

import collections
import random

import pandas as pd
import pyarrow as pa

from palimpsest.operators import fold, references
from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"


def reached(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for src in after:
        todo = list(after[src])
        while todo:
            dst = todo.pop()
            if (src, dst) not in out:
                out.add((src, dst))
                todo += after.get(dst, ())
    return out


def test_transitive_closure_of_chains_cycles_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(45)] + [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 200)]
    edges += [(300 + i, 350) for i in range(20)] + [(350, 400 + i) for i in range(20)] + [(400, 3), (44, 103)]
    edges += [(rng.randrange(500, 530), rng.randrange(500, 530)) for _ in range(40)] + edges[:5]
    got = [tuple(r) for r in references.transitive_closure(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == reached(edges)


def test_closures_stored_nowhere_by_component_and_by_doubling_agree(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 200), (104, 210), (None, 105), (106, None), (None, None), (220, None), (None, 221)]
    edges += [(1000 * k + rng.randrange(12), 1000 * k + rng.randrange(12)) for k in range(1, 9) for _ in range(14)]
    frame = spark.createDataFrame(edges, "src bigint, dst int")
    # A null equals no other, so none goes on from one.
    want = {(None if a == "from" else a, None if b == "to" else b) for a, b in reached([("from" if a is None else a, "to" if b is None else b) for a, b in edges])}
    stored = []
    monkeypatch.setattr(references, "_cut", lambda spark, df, cut=references._cut: stored.append(out := cut(spark, df)) or out)
    for most in ((), (70,), (20,)):
        stored.clear()
        closure = references.transitive_closure(frame, *most)
        got = [tuple(r) for r in closure.collect()]
        assert len(got) == len(set(got)) and set(got) == want and closure.schema["dst"].dataType.simpleString() == "int"
        assert most == (20,) or max(df.count() for df in stored) <= len(edges) * 2 < len(want)


def test_closed_in_strips_and_narrow_sets(monkeypatch):
    for seed in range(60):
        rng = random.Random(seed)
        monkeypatch.setattr(references, "BLOCK", rng.choice([64, 128, 1024]))
        monkeypatch.setattr(references, "HELD", rng.choice([100, 1 << 26]))
        monkeypatch.setattr(references, "BATCH", rng.choice([64, 4096]))
        n = rng.choice([3, 8, 40, 300])
        edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))}) + [(n + i, n + i + 1) for i in range(2000 if seed == 1 else 0)]
        graph = references.packed(pa.table({"src": pa.array([a for a, _ in edges], pa.int64()), "dst": pa.array([b for _, b in edges], pa.int64()), "mine": [True] * len(edges)}))
        got = [x for batch in references.closed(range(40), *graph) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        assert len(got) == len(set(got)) and set(got) == reached(edges)


def test_closure_query_is_of_all_references_in_force(spark):
    rows = catalogue.Context(spark, SF).in_force.filter("ref_id is not null and kind <> 'annihilation'").select("item_id", "ref_id").collect()
    want = reached({tuple(r) for r in rows})
    got = [tuple(r) for r in catalogue.QUERIES["transitive_closure"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def shares(values, edges):
    """{item: (component, share)} of (item, value) rows."""
    label = {i: i for i, _ in values} | {i: i for e in edges for i in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    own, total = collections.Counter(), collections.Counter()
    for i, v in values:
        own[i] += v
        total[label[i]] += v
    return {i: (label[i], v / total[label[i]] if total[label[i]] else None) for i, v in own.items()}


def agrees(got, want):
    assert len(got) == len(want)
    for r in got:
        component, share = want[r.item_id]
        assert r.component == component and (r.share is None) == (share is None) and abs((r.share or 0) - (share or 0)) < 1.1e-6


def test_component_shares_of_a_chain_a_hub_and_single_items(spark):
    rng = random.Random(6)
    edges = [(i + 1, i) for i in range(60)] + [(100, 101 + i) for i in range(90)] + [(200, 200), (210, 211), (211, 210)]
    values = [(rng.choice([*range(60), *range(100, 190), 200, 210, 211, 300]), rng.randrange(1, 900) / 4) for _ in range(500)] + [(400, 0.0), (401, 2.0)]
    rows = spark.createDataFrame([(i, 0, "m", v, (0, None, 0, n, 0)) for n, (i, v) in enumerate(values)], "item_id bigint, lifecycle bigint, method string, value double, anchor struct<when_rank int, when_ts timestamp_ntz, revision int, tb int, intra int>")
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    want = shares(values, edges)
    agrees(fold.component_shares(rows, links).collect(), want)

    def reduce(p):
        s = p.groupby("item_id").value.sum()
        return pd.DataFrame({"component": p.component.iloc[0], "item_id": s.index, "share": [v / s.sum() if s.sum() else None for v in s]})

    agrees(fold.component_fold(rows, links, reduce, "component bigint, item_id bigint, share double").filter("item_id <> 400").collect(), {i: w for i, w in want.items() if i != 400})


def test_component_fold_connects_by_all_references_in_force(spark):
    c = catalogue.Context(spark, SF)
    edges = [tuple(r) for r in c.in_force.filter("ref_id is not null and kind <> 'annihilation'").select("item_id", "ref_id").collect()]
    values = [tuple(r) for r in fold.alive(c.updates, c.in_force, catalogue.WHEN).select("item_id", "value").collect()]
    agrees(catalogue.QUERIES["component_fold"](spark, SF).collect(), shares(values, edges))


def test_rows_of_one_key_do_not_come_together(spark):
    rows = spark.range(2000).selectExpr("id AS a", "1L AS k")
    side = spark.range(3).selectExpr("id AS k", "'x' AS v").repartition(8, "k")
    got = references.attached(rows.hint("broadcast"), side.hint("merge"), "k", "a").rdd.glom().map(len).collect()
    assert sum(got) == 2000 and max(got) < 1600
