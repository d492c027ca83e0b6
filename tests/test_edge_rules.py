"""Rules at the edges: order of same-time events, empty and annulling revisions, shared ids, abstract types, ghosts, chunked bookings."""

import random

import pytest
from test_world import HOUR, REGISTRY, E, day, number

from palimpsest.plans.algebra import Items
from palimpsest.plans.world import RejectedRevision, World


def found(scope, item_class="Foo"):
    return {r.item_id: r for r in scope.table(item_class).collect()}


def test_order_revisions_and_measurements_of_one_item(spark):
    w = World(spark, REGISTRY)
    assert w.revise({}, day(1), checked=False) == 0 and w.next_revision == 1
    assert w.annul("nobody's event", day(1)) == 1
    first = {
        "a": E.change("Foo", "order", number(1.0), HOUR(1)),
        "b": E.change("Foo", "order", number(2.0), HOUR(1)),
        "gone": E.change("Foo", "again", number(4.0), HOUR(2)),
        "m0": E.change("Foo", "measured", number(1.0), HOUR(1)),
        "m1": E.measurement("Foo", "measured", number(5.0), HOUR(3)),
    }
    w.revise(first, day(2), checked=False)
    before = w.scope("+inf")
    was = {i: r.datums for i, r in found(before).items()}
    assert was == {"order": [1.0, 2.0], "again": [4.0], "measured": [5.0]}
    w.revise({"gone": None}, day(3), checked=False)
    w.revise({"gone": E.change("Foo", "again", number(6.0), HOUR(2)), "a": E.change("Foo", "order", number(3.0), HOUR(1))}, day(3), checked=False)
    # A corrected event comes after those of earlier revisions at its time; an annulled id can be booked again.
    assert {i: r.datums for i, r in found(w.scope("+inf")).items()} == {"order": [2.0, 3.0], "again": [6.0], "measured": [5.0]}
    assert {i: r.datums for i, r in found(before).items()} == was
    assert w.scope("+inf", as_of="2020-12-31 23:00:00").next_revision == 0
    assert w.scope("+inf", as_of=day(1)).next_revision == 2 and w.scope("+inf", as_of=day(3)).next_revision == 5


def test_shared_ids_ghosts_and_new_lifecycles(spark):
    w = World(spark, REGISTRY)
    events = {
        1: E.change("Foo", "twin", number(1.0), HOUR(1)),
        2: E.change("Bar", "twin", lambda b: b.level(2.0), HOUR(1)),
        3: E.change("Bar", "z", lambda b: b.level(7.0), HOUR(1)),
        4: E.change_two("Bar", "x", "Bar", "z", lambda a, b: a.refer(b), HOUR(2)),
        5: E.annihilation("Bar", "z", HOUR(3)),
        6: E.change_two("Bar", "y", "Bar", "z", lambda a, b: a.refer(b), HOUR(3)),
    }
    w.revise(events, day(1), checked=False)
    assert sorted(r.item_class for r in w.scope("+inf").render(Items("History", "twin")).collect()) == ["Bar", "Foo"]
    rows = found(w.scope("+inf"), "Bar")
    # The reference made at the annihilation starts another lifecycle, which knows nothing of the one before.
    assert (rows["z"].lifecycle, rows["z"].level, rows["z"].referrers) == (1, 1.0, ["y"])
    assert found(w.scope("2020-01-01 02:30:00"), "Bar")["z"].referrers == ["x"]


def test_an_item_named_by_an_abstract_class_alone_is_refused(spark):
    w = World(spark, REGISTRY)
    vague = E.change_two("Bar", "x", "History", "h", lambda a, b: a.refer(b), HOUR(1))
    with pytest.raises(RejectedRevision, match="abstract type: h"):
        w.revise({1: vague}, day(1))
    assert w.revise({1: vague, 2: E.change("Foo", "h", number(1.0), HOUR(5))}, day(1)) == 0


def test_chunks_and_order_of_bookings_do_not_matter(spark):
    rng = random.Random(3)
    events = {i: E.change("Foo", f"f{i % 3}", number(float(i)), f"2020-01-01 10:{i:02d}:00") for i in range(18)}
    events |= {f"m{i}": E.measurement("Foo", f"f{i % 3}", number(i / 8), f"2020-01-01 10:{3 * i:02d}:30") for i in range(6)}
    events["end"] = E.annihilation("Foo", "f1", "2020-01-01 10:09:00")
    whole, parts = World(spark, REGISTRY), World(spark, REGISTRY)
    whole.revise(events, day(1), checked=False)
    names = rng.sample(list(events), len(events))
    for n, lo in enumerate(range(0, len(names), 9)):
        parts.revise({k: events[k] for k in names[lo : lo + 9]}, day(n + 1), checked=False)
    for when in ("2020-01-01 10:07:00", "+inf"):
        assert found(whole.scope(when)) == found(parts.scope(when))
