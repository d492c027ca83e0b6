"""Worked scenarios of the kernel: measurements, lifecycles, snapshots, forks, incremental updates."""

import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import fold, forks, lifecycles, measurements, snapshots, timeline
from palimpsest.plans import incremental

T0 = datetime(2020, 1, 1)
LOG = "event_id string, revision int, tb int, kind string, when_rank int, when_ts timestamp_ntz, intra int, item_id string, item_class string, method string, value double, ref_id string"


def log(spark, *rows):
    """(event, revision, kind, hour or None for the beginning of time, method, value) rows about one item."""
    out = []
    for n, (event, revision, kind, hour, method, value) in enumerate(rows):
        when = None if hour is None else T0 + timedelta(hours=hour)
        out.append((event, revision, n, kind, -1 if hour is None else 0, when, 0, "x", "T", method, value, None))
    return spark.createDataFrame(out, LOG)


def datums(df, when="+inf", revision=None):
    force = timeline.events_in_force(df, revision)
    ups = measurements.updates(lifecycles.lifecycles(force))
    rows = fold.histories(fold.alive(ups, force, when)).collect()
    return list(rows[0]["datums"]) if rows else []


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("m", 0, "measurement", 2, "p", 22.0), ("c", 1, "change", 1, "p", 7.0), ("d", 2, "change", 0, "p", 11.0)], [11, 22]),
        ([("m", 0, "measurement", 2, "p", 22.0), ("c", 1, "change", 1, "p", 7.0), ("d", 2, "change", 0, "p", 11.0), ("c", 3, "annulled", None, None, None)], [22]),
        ([("a", 0, "change", 0, "p", 1.0), ("b", 1, "change", 1, "q", 2.0), ("m", 2, "measurement", 2, "p", 9.0)], [9, 2]),
        ([("b", 0, "change", 1, "q", 2.0), ("m", 1, "measurement", 0, "p", 9.0)], [9, 2]),
        ([("a", 0, "change", 0, "p", 0.0), ("z", 1, "annihilation", 1, None, None), ("b", 2, "change", 3, "p", 2.0), ("c", 3, "change", 2, "p", 1.0)], [1, 2]),
        ([("a", 0, "change", -3, "p", 99.0), ("b", 0, "change", 1, "p", 55555.0), ("c", 0, "change", 0, "p", 77.0), ("b", 1, "change", -1, "p", 55555.0), ("d", 1, "change", -2, "p", 88.0)], [99, 88, 55555, 77]),
        ([("a", 0, "change", 0, "p", 1.0), ("z", 1, "annihilation", 1, None, None), ("b", 2, "change", 2, "p", 2.0), ("z", 3, "annulled", None, None, None)], [1, 2]),
        ([("a", 0, "change", 0, "p", 11.0), ("b", 0, "change", 1, "p", 22.0), ("c", 0, "change", 999, "p", 33.0), ("d", 0, "change", 999, "p", 44.0), ("e", 0, "change", 1000, "p", 55.0)], [11, 22, 33, 44, 55]),
    ],
)
def test_scenarios(spark, rows, expected):
    assert datums(log(spark, *rows)) == expected


def test_later_measurement_changes_the_anchor_only_from_its_revision_on(spark):
    df = log(spark, ("c", 0, "change", None, "p", 5.0), ("m", 1, "measurement", 0, "p", 3.8))
    assert datums(df, "-inf", 1) == [5.0]
    assert datums(df, "-inf", 2) == [3.8]
    assert datums(df, "+inf", 0) == []


def test_annihilation_at_the_moment_hides_and_recreation_shows(spark):
    df = log(spark, ("a", 0, "change", 0, "p", 1.0), ("z", 1, "annihilation", 5, None, None), ("b", 2, "change", 5, "p", 2.0))
    at = (T0 + timedelta(hours=5)).isoformat(sep=" ")
    assert datums(df, at, 2) == []
    assert datums(df, at, 3) == [2.0]


def test_best_patch_strategies(spark):
    df = lifecycles.lifecycles(timeline.events_in_force(log(spark, ("c", 0, "change", 0, "p", 5.0), ("m", 1, "measurement", 1, "p", 3.0), ("n", 1, "measurement", 2, "p", 4.0))))
    got = {k: measurements.updates(df, best=k).first()["value"] for k in ("latest", "earliest", "largest", "mean")}
    assert got == {"latest": 4.0, "earliest": 5.0, "largest": 5.0, "mean": 4.0}


def test_snapshot_store(spark):
    store = snapshots.SnapshotStore(
        spark.createDataFrame([], "item_id string, item_class string, key int, store_revision int, state double"), spark.createDataFrame([], "key int, store_revision int")
    )
    one = store.open_revision().record(1, {("a", "T"): 1.0, ("b", "T"): 2.0}).record(5, {("a", "T"): 3.0}).build()
    two = one.open_revision().record(5, {("b", "T"): None}).annul(1).build()
    see = lambda s, *a: sorted((r.item_id, r.state) for r in s.time_slice(*a).collect())
    assert see(one, 5) == [("a", 3.0), ("b", 2.0)]
    assert see(one, 5, False) == [("a", 1.0), ("b", 2.0)]
    assert see(two, 5) == []
    assert see(one.retain_up_to(4), 9) == [("a", 1.0), ("b", 2.0)]
    with pytest.raises(ValueError):
        one.open_revision().record(1, {}).annul(1)


def test_fork_hides_what_it_annuls_and_keeps_apart(spark):
    base = log(spark, ("a", 0, "change", 0, "p", 1.0), ("b", 1, "change", 5, "p", 2.0), ("c", 2, "change", 1, "p", 3.0))
    own = log(spark, ("a", 2, "annulled", None, None, None), ("n", 3, "change", 9, "p", 4.0))
    cut = (T0 + timedelta(hours=5)).isoformat(sep=" ")
    ids = lambda r: sorted(x.event_id for x in forks.fork_in_force(base, own, 2, cut, r).collect())
    assert ids(2) == ["a", "b"]
    assert ids(3) == ["b"]
    assert ids(4) == ["b", "n"]


def test_incremental_refresh_equals_recomputation(spark):
    rng = random.Random(4)
    rows = []
    for n in range(120):
        event = f"e{n if rng.random() < 0.6 else rng.randrange(max(1, n))}"
        item = f"i{rng.randrange(6)}"
        kind = rng.choice(["change", "change", "measurement", "annihilation", "annulled"])
        rows.append((event, n // 4, n % 4, kind, 0, T0 + timedelta(hours=rng.randrange(40)), 0, item, "T", rng.choice("pq"), float(n), f"i{rng.randrange(6)}" if n % 5 == 0 else None))
    seen, kept = set(), []
    for r in rows:  # an event is booked once in a revision
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            kept.append(r)
    df = spark.createDataFrame(kept, LOG)
    fresh = lambda r: measurements.updates(lifecycles.lifecycles(timeline.events_in_force(df, r)))
    key = lambda d: sorted((x.item_id, x.lifecycle, x.method, x.run, x.value, x.anchor) for x in d.collect())
    for r in (10, 29):
        assert key(incremental.refreshed(fresh(r), df, r)) == key(fresh(r + 1))
