"""A booking is refused for the reasons that the whole history gives."""

import random

from test_world import HOUR, REGISTRY, E, day, number

from palimpsest.operators import timeline
from palimpsest.plans.world import Histories, World
from palimpsest.sources.tables import EVENT_LOG


def test_bookings_are_refused_as_by_the_whole_history(spark):
    w, rng = World(spark, REGISTRY), random.Random(1)
    events = {i: E.change("Foo", f"f{i % 9}", number(float(i)), HOUR(i % 24)) for i in range(40)}
    for i in range(20):
        a, b = rng.sample(range(10), 2)
        events[f"r{i}"] = E.change_two("Bar", a, "Bar", b, lambda x, y: x.refer(y), HOUR(i))
    events["best"] = E.measurement_two("Bar", 20, "Bar", 21, lambda x, y: x.refer(y), HOUR(2))
    events["anchor"] = E.change_two("Bar", 20, "Bar", 22, lambda x, y: x.refer(y), HOUR(1))
    events["there"] = E.change("Bar", 21, lambda a: a.level(2.0), HOUR(0))
    events["only"] = E.change("Foo", "gone", number(1.0), HOUR(1))
    events["end"] = E.annihilation("Foo", "gone", HOUR(5))
    w.revise(events, day(1), checked=False)
    bookings = [
        ({"x": E.annihilation("Bar", 3, HOUR(10)), "y": E.change("Foo", "f1", number(1.0), HOUR(9))}, set()),
        ({"x": E.change("Bar", 3, lambda a: a.pay(200), HOUR(3))}, {"broken invariant"}),
        ({"only": E.change("Foo", "f1", number(1.0), HOUR(1))}, {"annihilation of nothing"}),
        ({"x": E.annihilation("Bar", 21, "2020-01-01 01:30:00")}, {"argument from the future"}),
    ]
    for booking, reasons in bookings:
        rows = spark.createDataFrame(w._rows(booking, 1), EVENT_LOG)
        whole = Histories(spark, REGISTRY, timeline.proposed(w.versions(1), rows).filter("item_id is not null"))
        got = {tuple(r) for r in w.contradictions(rows, 1).collect()}
        assert got == {tuple(r) for r in whole.violations().collect()} and {r[0] for r in got} == reasons
