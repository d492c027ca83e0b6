"""The World facade: bookings, scopes, refusals, forks, stores, streams."""

import pytest

from palimpsest.plans.algebra import Items, Nothing, Point
from palimpsest.plans.events import Events
from palimpsest.plans.registry import ItemType, Op, Registry
from palimpsest.plans.world import RejectedRevision, World
from palimpsest.sources.tables import ConcurrentRevision, ParquetStore

REGISTRY = Registry(
    ItemType("History", abstract=True),
    ItemType("Foo", "History", methods={"number": Op("append", "datums", "double")}),
    ItemType("Negating", "Foo", methods={"number": Op("append_negated", "datums", "double")}),
    ItemType("Bar", "History", methods={"refer": Op("add_ref", "others", mirror=("add_ref", "referrers")), "level": Op("set", "level", "double"), "pay": Op("add", "paid", "double")}, defaults={"level": "1"}, invariants=("paid < 100",)),
)
E = Events(REGISTRY)
HOUR = "2020-01-01 {:02d}:00:00".format


def day(n):
    return f"2021-01-{n:02d} 00:00:00"


def number(v):
    return lambda item: item.number(v)


def test_scopes_corrections_and_refusals(spark):
    w = World(spark, REGISTRY)
    assert w.revise({"a": E.change("Foo", "f", number(1.0)), "b": E.change("Foo", "f", number(2.0), HOUR(2))}, day(1)) == 0
    assert w.revise({"b": E.change("Foo", "f", number(3.0), HOUR(3))}, day(2)) == 1
    datums = lambda s: [r.datums for r in s.table("Foo").collect()]
    assert datums(w.scope("+inf", 1)) == [[1.0, 2.0]]
    assert datums(w.scope("+inf")) == [[1.0, 3.0]]
    assert datums(w.scope(HOUR(2))) == [[1.0]]
    assert w.scope("+inf", 0).as_of is None and datums(w.scope("+inf", 0)) == []
    assert w.scope("+inf", as_of=day(1)).next_revision == 1
    with pytest.raises(ValueError):
        w.scope("+inf", 3)
    with pytest.raises(ValueError):
        w.annul("a", day(1))
    with pytest.raises(RejectedRevision):
        w.revise({"z": E.annihilation("Foo", "nobody", HOUR(1))}, day(3))
    assert w.next_revision == 2
    # A subtype named anywhere in the lifecycle decides how all of it is folded.
    w.revise({"z": E.annihilation("Negating", "f", HOUR(9))}, day(3))
    assert datums(w.scope(HOUR(4))) == [[-1.0, -3.0]]
    assert datums(w.scope(HOUR(9))) == []


def test_references_mirrors_defaults_invariants_and_algebra(spark):
    w = World(spark, REGISTRY)
    w.revise({1: E.change_two("Bar", "x", "Bar", "y", lambda a, b: a.refer(b)), 2: E.change("Bar", "x", lambda a: a.pay(60), HOUR(1))}, day(1))
    rows = {r.item_id: r for r in w.scope("+inf").table("Bar").collect()}
    assert rows["x"].others == ["y"] and rows["y"].referrers == ["x"] and rows["y"].level == 1.0
    with pytest.raises(RejectedRevision, match="invariant"):
        w.revise({3: E.change("Bar", "x", lambda a: a.pay(50), HOUR(2)), 4: E.change("Bar", "x", lambda a: a.pay(-50), HOUR(3))}, day(2))
    scope = w.scope("+inf")
    both = Items("Bar") + Items("History")
    assert scope.number_of(both) == 4 and scope.number_of(both.ap(Items("Bar")) + Nothing() + Point(a=1)) == 9
    assert scope.render(Items("Bar", "x")).count() == 1


def test_recorder_refuses_reads_and_events_have_finite_ends():
    with pytest.raises(AttributeError):
        E.change("Foo", "f", lambda i: i.datums)
    with pytest.raises(ValueError):
        E.annihilation("Foo", "f", None)
    assert E.change("Foo", 5, lambda i: None).patches == ()


def test_forks(spark):
    w = World(spark, REGISTRY)
    w.revise({"a": E.change("Foo", "f", number(1.0), HOUR(1)), "b": E.change("Foo", "f", number(2.0), HOUR(5))}, day(1))
    fork = w.fork(w.scope(HOUR(3)), "what-if")
    datums = lambda x: [r.datums for r in x.scope("+inf").table("Foo").collect()]
    assert datums(fork) == [[1.0]]
    fork.revise({"c": E.change("Foo", "f", number(9.0), HOUR(8))}, day(2))
    w.revise({"a": None}, day(3))
    assert datums(fork) == [[1.0, 9.0]] and datums(w) == [[2.0]]
    assert datums(fork.fork(fork.scope(HOUR(2)), "deeper")) == [[1.0]]


def test_parquet_store_commits_once_and_streams_book_once(spark, tmp_path):
    from palimpsest.streaming.bookings import book_stream

    store = ParquetStore(spark, f"file://{tmp_path}/store")
    w = World(spark, REGISTRY, store)
    w.revise({"a": E.change("Foo", "f", number(1.0))}, day(1), checked=False)
    with pytest.raises(ConcurrentRevision):
        store.append("main", 0, day(2), store.log("main"))
    assert len(store.commits("main")) == 1
    rows = store.log("main").drop("world_id", "revision").selectExpr("'s' as event_id", "kind", "when_rank", "when_ts", "intra", "item_id", "item_class", "method", "args")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    book_stream(w, stream, f"{tmp_path}/checkpoint", checked=False, clock=lambda: day(4)).awaitTermination(120)
    assert World(spark, REGISTRY, store).next_revision == 2
    assert w.revise_rows(rows, day(5), tag="batch-0") == 1 and w.next_revision == 2
    assert [r.datums for r in w.scope("+inf").table("Foo").collect()] == [[1.0, 1.0]]
