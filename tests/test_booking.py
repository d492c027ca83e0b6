"""Reads of one item, stores that fail half-way, stored snapshots and their forks."""

import random

import pytest
from test_world import HOUR, REGISTRY, E, day, number

from palimpsest.operators import snapshots
from palimpsest.operators import typing as types
from palimpsest.plans.algebra import Items
from palimpsest.plans.events import encoded
from palimpsest.plans.world import World
from palimpsest.sources.tables import ParquetStore


def test_one_item_is_read_as_among_all(spark):
    w, rng = World(spark, REGISTRY), random.Random(4)
    events = {}
    for i in range(40):
        a, b = rng.sample(range(6), 2)
        event = E.measurement_two if i % 3 == 0 else E.change_two
        events[i] = event("Bar", a, "Bar", b, lambda x, y: x.refer(y), HOUR(i % 20))
    events |= {f"l{i}": E.change("Bar", i, lambda a, i=i: a.level(float(i)), HOUR(i)) for i in range(6)}
    events["end"] = E.annihilation("Bar", 2, HOUR(11))
    w.revise(events, day(1), checked=False)
    scope = w.scope(HOUR(17))
    rows = {r.item_id: r for r in scope.table("Bar").collect()}
    for i in (2,):
        assert scope.table("Bar", i).collect() == [rows[encoded(i)]]
    assert scope.is_empty(Items("Foo"))


def test_ids_cannot_hold_the_separator():
    with pytest.raises(ValueError):
        encoded("a\x01b")


def test_a_failed_commit_leaves_no_revision(spark, tmp_path, monkeypatch):
    store = ParquetStore(spark, f"file://{tmp_path}/store")
    w = World(spark, REGISTRY, store)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_rename", broken)
        with pytest.raises(RuntimeError):
            w.revise({"a": E.change("Foo", "f", number(1.0))}, day(1), checked=False)
    assert w.next_revision == 0 and store.log("main").count() == 0
    assert w.revise({"a": E.change("Foo", "f", number(1.0))}, day(1), checked=False) == 0
    assert ParquetStore(spark, f"file://{tmp_path}/store").commits("main")[0]["as_of"] == day(1)


def test_stored_snapshots_and_their_forks(spark, tmp_path):
    def build(store, at, states):
        rows = spark.createDataFrame([(i, c, k, s) for k, found in states.items() for (i, c), s in found.items()], "item_id string, item_class string, key bigint, state string")
        return store.build(rows, spark.createDataFrame([(k,) for k in states], "key bigint"))

    seen = lambda store, when, inclusive=True: {(r.item_id, r.state) for r in store.time_slice(when, inclusive).collect()}
    empty = snapshots.StoredSnapshots(spark, f"{tmp_path}/snapshots")
    assert seen(empty, 9) == set()
    one = build(empty, 1, {1: {("x", "Foo"): "x1"}, 2: {("x", "Foo"): "x2", ("y", "Bar"): "y2"}, 5: {("x", "Foo"): None}})
    two = build(one, 2, {2: {}})
    assert seen(one, 2) == {("x", "x2"), ("y", "y2")} and seen(one, 2, False) == {("x", "x1")} and seen(one, 9) == {("y", "y2")}
    assert seen(two, 2) == {("x", "x1")}
    fork = one.fork("what-if", 2)
    assert seen(fork, 9) == {("x", "x2"), ("y", "y2")}
    fork = build(fork, 1, {1: {("x", "Foo"): "fork1"}, 2: {}, 7: {("y", "Bar"): "fork7"}})
    build(two, 3, {1: {("x", "Foo"): "later"}})
    assert seen(fork, 2) == {("x", "fork1")} and seen(fork, 9) == {("x", "fork1"), ("y", "fork7")}
    assert seen(fork.fork("deeper", 5), 9) == {("x", "fork1")}
    closure = types.type_closure(spark, REGISTRY.parents())
    with pytest.raises(ValueError):
        build(one, 2, {6: {}})
    slice_ = build(one.fork("other"), 1, {6: {("y", "Foo"): "also y"}}).time_slice(9)
    assert {r.item_id for r in snapshots.of_class(slice_, closure, "History", "y").collect()} == {"y"}
    assert [tuple(r) for r in snapshots.not_unique(slice_, closure, "History").collect()] == [("y", 2)]
    assert snapshots.not_unique(slice_, closure, "Foo").count() == 0
