"""The query catalogue over the derived log: each query as DataFrames, with the SQL that it must agree with."""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fold, forks, lifecycles, measurements, references, snapshots, timeline, violations
from ..operators import typing as types
from ..sources.tables import DERIVED, DERIVED_TYPES, derived_log, table
from . import algebra

WHEN = "2024-01-20 00:00:00"
EARLY = "2024-01-12 00:00:00"


class Context:
    """The derived log of a directory, cut at the revision that 70% of the events come before."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.log = derived_log(spark, sf_dir)

    @cached_property
    def revision(self) -> int:
        return int(table(self.spark, self.sf_dir, "events").agg((F.floor(F.max("event_id") / 10 * 0.7)).cast("int")).first()[0])

    @cached_property
    def in_force(self) -> DataFrame:
        return timeline.events_in_force(self.log, self.revision)

    @cached_property
    def numbered(self) -> DataFrame:
        return lifecycles.lifecycles(self.in_force)

    @cached_property
    def updates(self) -> DataFrame:
        return measurements.updates(self.numbered)

    def state(self, when=WHEN, inclusive: bool = True) -> DataFrame:
        return fold.latest_values(fold.alive(self.updates, self.in_force, when, inclusive=inclusive))

    @cached_property
    def closure(self) -> DataFrame:
        return types.type_closure(self.spark, DERIVED_TYPES)

    @cached_property
    def typed(self) -> DataFrame:
        return lifecycles.lifecycles(types.with_family(self.in_force, self.closure), ("item_id", "family"))

    def items(self, when=WHEN) -> DataFrame:
        """(item_id, family, lifecycle, item_class): items alive at `when`, each with its lifecycle's most derived class."""
        return types.alive_items(self.typed, self.closure, when)


R_SQL = "(SELECT CAST(floor(max(event_id)/10*0.7) AS INT) FROM events)"
LOG_SQL = "log AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in DERIVED.items()) + " FROM events)"


def _in_force_sql(r: str = R_SQL, log: str = "log", name: str = "eff") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY revision DESC) AS rn FROM {log} WHERE revision < {r}) x
 WHERE rn = 1 AND kind <> 'annulled')"""


def _folded_sql(eff: str = "eff", item: str = "item_id") -> str:
    return f"""lc AS (SELECT *, CAST(coalesce(sum(CASE WHEN kind='annihilation' THEN 1 ELSE 0 END) OVER (PARTITION BY {item}
 ORDER BY when_ts, revision, tb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lifecycle FROM {eff}),
runs AS (SELECT *, CAST(sum(CASE WHEN kind='change' THEN 1 ELSE 0 END) OVER (PARTITION BY {item}, lifecycle, method
 ORDER BY when_ts, revision, tb ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM lc WHERE kind <> 'annihilation'),
pos AS (SELECT *, row_number() OVER (PARTITION BY {item}, lifecycle, method, run ORDER BY when_ts, revision, tb) AS p,
 row_number() OVER (PARTITION BY {item}, lifecycle, method, run ORDER BY when_ts DESC, revision DESC, tb DESC) AS q FROM runs),
upd AS (SELECT {item}, lifecycle, method, run, max(CASE WHEN p=1 THEN when_ts END) AS anchor_when, max(CASE WHEN p=1 THEN revision END) AS anchor_rev,
 max(CASE WHEN p=1 THEN tb END) AS anchor_tb, max(CASE WHEN p=1 THEN event_key END) AS anchor_event, max(CASE WHEN q=1 THEN value END) AS value,
 count(*) AS run_length FROM pos GROUP BY {item}, lifecycle, method, run)"""


def _state_sql(when: str = WHEN, upto: str = "<=", eff: str = "eff") -> str:
    return f"""ended AS (SELECT item_id, count(*) AS n FROM {eff} WHERE kind='annihilation' AND when_ts {upto} TIMESTAMP '{when}' GROUP BY item_id),
live AS (SELECT u.* FROM upd u LEFT JOIN ended e ON u.item_id = e.item_id WHERE anchor_when {upto} TIMESTAMP '{when}' AND u.lifecycle = coalesce(e.n, 0)),
state AS (SELECT item_id, lifecycle, method, value FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lifecycle, method
 ORDER BY anchor_when DESC, anchor_rev DESC, anchor_tb DESC) AS r FROM live) x WHERE r = 1)"""


BASE = f"WITH {LOG_SQL}, {_in_force_sql()}"
FOLDED = f"{BASE}, {_folded_sql()}"
STATE = f"{FOLDED}, {_state_sql()}"
CLOSURE_SQL = "closure(sub, super, distance, depth) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in types.closure_rows(DERIVED_TYPES)) + ")"
TYPED = f"""{BASE}, {CLOSURE_SQL},
used AS (SELECT DISTINCT item_id, item_class FROM eff WHERE kind <> 'annihilation'),
fam AS (SELECT item_id, item_class, family FROM (SELECT u.item_id, u.item_class, c.super AS family, row_number() OVER (PARTITION BY u.item_id, u.item_class ORDER BY c.depth) AS r
 FROM used u JOIN closure c ON u.item_class = c.sub JOIN used t ON t.item_id = u.item_id AND t.item_class = c.super) x WHERE r = 1),
tagged AS (SELECT e.*, f.family FROM eff e JOIN fam f ON e.item_id = f.item_id AND e.item_class = f.item_class WHERE e.kind <> 'annihilation'
 UNION ALL SELECT e.*, f.family FROM eff e JOIN (SELECT DISTINCT item_id, family FROM fam) f ON e.item_id = f.item_id
 WHERE e.kind = 'annihilation' AND EXISTS (SELECT 1 FROM closure c WHERE (c.sub = e.item_class AND c.super = f.family) OR (c.super = e.item_class AND c.sub = f.family))),
{_folded_sql("tagged", "item_id, family")},
bound AS (SELECT item_id, family, lifecycle, max(lpad(CAST(depth AS VARCHAR), 3, '0') || ':' || item_class) AS lo, min(lpad(CAST(depth AS VARCHAR), 3, '0') || ':' || item_class) AS hi
 FROM lc JOIN (SELECT sub, depth FROM closure WHERE distance = 0) d ON lc.item_class = d.sub GROUP BY item_id, family, lifecycle),
ended AS (SELECT item_id, family, count(*) AS n FROM tagged WHERE kind = 'annihilation' AND when_ts <= TIMESTAMP '{WHEN}' GROUP BY item_id, family),
items AS (SELECT DISTINCT u.item_id, u.family, u.lifecycle, substr(b.lo, 5) AS item_class FROM upd u LEFT JOIN ended e ON u.item_id = e.item_id AND u.family = e.family
 JOIN bound b ON b.item_id = u.item_id AND b.family = u.family AND b.lifecycle = u.lifecycle WHERE anchor_when <= TIMESTAMP '{WHEN}' AND u.lifecycle = coalesce(e.n, 0))"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Context under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _revisions(c: Context) -> DataFrame:
    events = table(c.spark, c.sf_dir, "events")
    return events.groupBy(F.floor(F.col("event_id") / 10).cast("int").alias("revision")).agg(F.max("ts").alias("as_of"))


REVISIONS_SQL = "revisions AS (SELECT CAST(floor(event_id/10) AS INT) AS revision, max(ts) AS as_of FROM events GROUP BY 1)"


@query(f"WITH {REVISIONS_SQL}, probes AS (SELECT DATE '2024-01-01' + CAST(i AS INT) AS day FROM range(31) t(i)) SELECT CAST(day AS VARCHAR) AS day, CAST((SELECT count(*) FROM revisions WHERE as_of <= CAST(day AS TIMESTAMP)) AS BIGINT) AS next_revision FROM probes")
def revision_for_asof(c: Context) -> DataFrame:
    """As-of scopes at the start of each day: one count for each day, then a running sum over 31 rows."""
    midnight = F.to_date(F.col("as_of"))
    first = F.when(F.col("as_of") > midnight.cast("timestamp_ntz"), F.date_add(midnight, 1)).otherwise(midnight)
    per_day = _revisions(c).groupBy(first.alias("day")).agg(F.count("*").alias("n"))
    probes = c.spark.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    rows = probes.join(per_day, "day", "left")
    return rows.select(F.col("day").cast("string").alias("day"), F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).cast("bigint").alias("next_revision"))


@query(f"WITH {REVISIONS_SQL} SELECT revision + 1 AS next_revision, as_of FROM revisions UNION ALL SELECT 0, NULL")
def scope_asof_for_revision(c: Context) -> DataFrame:
    none = c.spark.range(1).select(F.lit(0).alias("next_revision"), F.lit(None).cast("timestamp_ntz").alias("as_of"))
    return _revisions(c).select((F.col("revision") + 1).alias("next_revision"), "as_of").union(none)


_EVENT = ["event_id", "revision", "tb", "kind", "item_id", "method", "value", "when_ts"]
_EVENT_SQL = "event_key AS event_id, revision, tb, kind, item_id, method, value, when_ts"


@query(f"{BASE} SELECT {_EVENT_SQL} FROM eff")
def events_in_force(c: Context) -> DataFrame:
    return c.in_force.select(*_EVENT)


@query(f"""WITH {LOG_SQL}, probes AS (SELECT q, CAST(floor((SELECT max(event_id) FROM events)/10*q/10) AS INT) AS r FROM (VALUES (1), (4), (7), (10)) t(q)),
eff AS (SELECT * FROM (SELECT p.q, log.*, row_number() OVER (PARTITION BY p.q, event_key ORDER BY revision DESC) AS rn FROM log JOIN probes p ON log.revision < p.r) x WHERE rn = 1 AND kind <> 'annulled')
SELECT q, kind, count(*) AS n, round(sum(value), 2) AS total FROM eff GROUP BY q, kind""")
def events_in_force_history(c: Context) -> DataFrame:
    """Four scopes in one pass; a row goes to each scope that sees it."""
    last = table(c.spark, c.sf_dir, "events").agg(F.max("event_id")).first()[0]
    cuts = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(int(last / 10 * q / 10)).alias("r")) for q in (1, 4, 7, 10)])
    rows = c.log.withColumn("_c", F.explode(F.filter(cuts, lambda x: F.col("revision") < x["r"])))
    rows = rows.withColumn("q", F.col("_c.q"))
    latest = F.row_number().over(W.partitionBy("q", "event_id").orderBy(F.desc("revision")))
    rows = rows.withColumn("rn", latest).filter("rn = 1 and kind <> 'annulled'")
    return rows.groupBy("q", "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"{BASE} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY when_ts, revision, tb) AS position, event_key AS event_id, kind FROM eff")
def event_timeline(c: Context) -> DataFrame:
    return timeline.timeline(c.in_force).select("item_id", "position", "event_id", "kind")


@query(f"""WITH {LOG_SQL}, booking AS (SELECT * FROM log WHERE revision = {R_SQL}),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY revision DESC) AS rn FROM log WHERE revision < {R_SQL}) x WHERE rn = 1
 AND event_key NOT IN (SELECT event_key FROM booking))
SELECT {_EVENT_SQL} FROM (SELECT *, 1 AS rn FROM booking UNION ALL SELECT * FROM kept) y WHERE kind <> 'annulled'""")
def proposed_revision_timeline(c: Context) -> DataFrame:
    return timeline.proposed(c.log, c.log.filter(F.col("revision") == c.revision), c.revision).select(*_EVENT)


INTERVALS = """spans AS (SELECT item_id, lifecycle, min(CASE WHEN kind <> 'annihilation' THEN when_ts END) AS start_when, max(CASE WHEN kind = 'annihilation' THEN when_ts END) AS end_when,
 count(CASE WHEN kind <> 'annihilation' THEN 1 END) AS n_events FROM lc GROUP BY item_id, lifecycle),
intervals AS (SELECT *, end_when IS NOT NULL AS ended FROM spans WHERE n_events > 0)"""


@query(f"{FOLDED}, {INTERVALS} SELECT * FROM intervals")
def lifecycle_intervals(c: Context) -> DataFrame:
    return lifecycles.lifecycle_intervals(c.numbered)


@query(f"{FOLDED}, {INTERVALS} SELECT item_id, lifecycle, start_when, lead(start_when) OVER (PARTITION BY item_id ORDER BY lifecycle) AS next_start FROM intervals")
def next_lifecycle_start(c: Context) -> DataFrame:
    return lifecycles.next_starts(lifecycles.lifecycle_intervals(c.numbered)).select("item_id", "lifecycle", "start_when", "next_start")


@query(f"""{FOLDED}, {INTERVALS}, k AS (SELECT *, CAST(floor(item_id / 4) AS BIGINT) AS pool FROM intervals)
SELECT a.pool, a.item_id AS a_id, a.lifecycle AS a_life, b.item_id AS b_id, b.lifecycle AS b_life FROM k a JOIN k b ON a.pool = b.pool AND a.item_id < b.item_id
 AND (a.end_when IS NULL OR b.start_when < a.end_when) AND (b.end_when IS NULL OR a.start_when < b.end_when)""")
def lifecycle_overlaps(c: Context) -> DataFrame:
    spans = lifecycles.lifecycle_intervals(c.numbered).withColumn("pool", F.floor(F.col("item_id") / 4))
    return lifecycles.overlaps(spans, spans, "pool").select("pool", "a_id", "a_life", "b_id", "b_life")


_UPDATE = ["item_id", "lifecycle", "method", "run"]


@query(f"{FOLDED} SELECT item_id, lifecycle, method, run, anchor_when, anchor_rev, anchor_tb, anchor_event, value, run_length FROM upd")
def measurement_updates(c: Context) -> DataFrame:
    a = F.col("anchor")
    return c.updates.select(*_UPDATE, a["when_ts"].alias("anchor_when"), a["revision"].alias("anchor_rev"), a["tb"].alias("anchor_tb"), "anchor_event", "value", "run_length")


@query(f"{FOLDED} SELECT item_id, lifecycle, method, run, anchor_when, value FROM upd WHERE anchor_when <= TIMESTAMP '{EARLY}' AND run_length > 1")
def measurement_retroactive_state(c: Context) -> DataFrame:
    """Updates before an early moment that a measurement, maybe a later one, decided."""
    rows = fold.cut(c.updates, EARLY).filter("run_length > 1")
    return rows.select(*_UPDATE, F.col("anchor.when_ts").alias("anchor_when"), "value")


@query(f"{FOLDED} SELECT item_id, lifecycle, method, run, best FROM (SELECT item_id, lifecycle, method, run, max(CASE WHEN p=1 THEN value END) AS best FROM pos GROUP BY 1, 2, 3, 4) x")
def best_patch_earliest(c: Context) -> DataFrame:
    rows = measurements.updates(c.numbered, best="earliest")
    return rows.select(*_UPDATE, F.col("value").alias("best"))


@query(f"{STATE} SELECT * FROM state")
def state_at_when_revision(c: Context) -> DataFrame:
    return c.state()


@query(f"{FOLDED}, {_state_sql(WHEN, '<')} SELECT * FROM state")
def timeslice_exclusive(c: Context) -> DataFrame:
    return c.state(inclusive=False)


@query(f"{STATE} SELECT item_id, lifecycle, method, count(*) AS n, round(sum(value), 2) AS total FROM live GROUP BY 1, 2, 3")
def state_counter_fold(c: Context) -> DataFrame:
    return fold.counters(fold.alive(c.updates, c.in_force, WHEN)).withColumn("total", F.round("total", 2))


@query(f"{STATE} SELECT item_id, lifecycle, CAST(row_number() OVER (PARTITION BY item_id, lifecycle ORDER BY anchor_when, anchor_rev, anchor_tb, method) AS INT) AS place, value AS datum FROM live")
def history_datums(c: Context) -> DataFrame:
    rows = fold.histories(fold.alive(c.updates, c.in_force, WHEN))
    return rows.select("item_id", "lifecycle", F.posexplode("datums").alias("place", "datum")).withColumn("place", F.col("place") + 1)


@query(f"{FOLDED} SELECT item_id, lifecycle, method, run, value, anchor_when AS valid_from, lead(anchor_when) OVER (PARTITION BY item_id, lifecycle, method ORDER BY anchor_when, anchor_rev, anchor_tb) AS valid_to FROM upd")
def validity_intervals(c: Context) -> DataFrame:
    return lifecycles.validity(c.updates).select(*_UPDATE, "value", "valid_from", "valid_to")


_SNAPSHOT_SQL = f"""WITH snap AS (SELECT user_id AS item_id, event_type AS item_class, CAST(floor(event_id / 2) AS BIGINT) AS k, CAST(event_id % 3 AS INT) AS sr,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS state FROM events),
tr AS (SELECT k, max(sr) AS sr FROM (SELECT k, sr FROM snap UNION ALL SELECT CAST(floor(event_id / 2) AS BIGINT), 3 FROM events WHERE event_id % 29 = 0) x WHERE k <= (SELECT max(event_id) / 3 FROM events) GROUP BY k),
valid AS (SELECT s.*, row_number() OVER (PARTITION BY item_id, item_class ORDER BY s.k DESC) AS r FROM snap s JOIN tr ON s.k = tr.k AND s.sr = tr.sr)
SELECT item_id, item_class, state FROM valid WHERE r = 1 AND state IS NOT NULL"""


@query(_SNAPSHOT_SQL)
def snapshot_store_asof(c: Context) -> DataFrame:
    """Snapshots of the events, two at a key, in three store revisions; a fourth retracts some keys."""
    events = table(c.spark, c.sf_dir, "events")
    key = F.floor(F.col("event_id") / 2).alias("key")
    state = F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("state")
    snap = events.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("item_class"), key, (F.col("event_id") % 3).cast("int").alias("store_revision"), state)
    times = snap.select("key", "store_revision").union(events.filter("event_id % 29 = 0").select(key, F.lit(3)))
    upto = events.agg(F.max("event_id") / 3).first()[0]
    return snapshots.as_of(snap, times, upto)


_SNAPS = f"""log_snap AS (SELECT user_id AS item_id, {DERIVED["item_class"]} AS item_class, CAST(floor(event_id / 2) AS BIGINT) AS k, CAST(event_id % 3 AS INT) AS sr,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS state FROM events),
log_times AS (SELECT k, max(sr) AS sr FROM log_snap WHERE k <= (SELECT max(event_id) / 3 FROM events) GROUP BY k),
slice AS (SELECT item_id, item_class, state FROM (SELECT s.*, row_number() OVER (PARTITION BY item_id, item_class ORDER BY s.k DESC) AS r FROM log_snap s JOIN log_times t ON s.k = t.k AND s.sr = t.sr) x WHERE r = 1 AND state IS NOT NULL)"""


def _typed_slice(c: Context) -> DataFrame:
    """The slice of snapshots of the derived items, each under its class."""
    events = table(c.spark, c.sf_dir, "events")
    state = F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("state")
    snap = events.select(F.col("user_id").alias("item_id"), F.expr(DERIVED["item_class"]).alias("item_class"), F.floor(F.col("event_id") / 2).alias("key"), (F.col("event_id") % 3).cast("int").alias("store_revision"), state)
    return snapshots.as_of(snap, snap.select("key", "store_revision"), events.agg(F.max("event_id") / 3).first()[0])


@query(f"WITH {_SNAPS} SELECT * FROM slice WHERE item_class IN ('Account', 'Premium')")
def snapshot_by_class(c: Context) -> DataFrame:
    """Items of a slice of snapshots by class, subtypes included."""
    return snapshots.of_class(_typed_slice(c), c.closure, "Account")


@query(f"WITH {_SNAPS} SELECT item_id, count(*) AS n FROM slice GROUP BY item_id HAVING count(*) > 1")
def snapshot_not_unique(c: Context) -> DataFrame:
    """Ids that a query for one item of class Entity must refuse: several items of the slice have them."""
    return snapshots.not_unique(_typed_slice(c), c.closure, "Entity")


_LINEAGE = """WITH top AS (SELECT max(event_id) AS m FROM events),
snap AS (SELECT 'main' AS lineage, user_id AS item_id, event_type AS item_class, CAST(floor(event_id / 2) AS BIGINT) AS k, CAST(event_id % 3 AS INT) AS sr, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS state FROM events
 UNION ALL SELECT 'fork', user_id, event_type, CAST(floor(event_id / 2) AS BIGINT), CAST(event_id % 2 AS INT), -value FROM events WHERE event_id % 5 = 0),
seen AS (SELECT *, CASE WHEN lineage = 'fork' THEN 1 ELSE 0 END AS place FROM snap, top WHERE lineage = 'fork' OR (sr <= 1 AND k <= m / 4)),
times AS (SELECT k, max(place * 10 + sr) AS v FROM seen WHERE k <= m / {part} GROUP BY k),
valid AS (SELECT s.*, row_number() OVER (PARTITION BY item_id, item_class ORDER BY s.k DESC) AS r FROM seen s JOIN times t ON s.k = t.k AND place * 10 + sr = v)
SELECT item_id, item_class, state FROM valid WHERE r = 1 AND state IS NOT NULL"""


def _forked_slice(c: Context, part: int) -> DataFrame:
    """A slice of a store that was forked at its revision 1 and a key, and records every fifth event anew with the opposite sign."""
    events = table(c.spark, c.sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0]
    common = [F.col("user_id").alias("item_id"), F.col("event_type").alias("item_class"), F.floor(F.col("event_id") / 2).alias("key")]
    main = events.select(F.lit("main").alias("lineage"), *common, (F.col("event_id") % 3).cast("int").alias("store_revision"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("state"))
    fork = events.filter("event_id % 5 = 0").select(F.lit("fork").alias("lineage"), *common, (F.col("event_id") % 2).cast("int").alias("store_revision"), (-F.col("value")).alias("state"))
    both = main.union(fork)
    return snapshots.lineage_as_of(both, both.select("lineage", "key", "store_revision"), [("main", 1, last / 4), ("fork", None, None)], last / part)


@query(_LINEAGE.format(part=3))
def snapshot_lineage_asof(c: Context) -> DataFrame:
    """A forked store beyond the key of the fork: the newest lineage dominates."""
    return _forked_slice(c, 3)


@query(_LINEAGE.format(part=8))
def fork_of_snapshots(c: Context) -> DataFrame:
    """A forked store before the key of the fork: the base's snapshots under the fork's."""
    return _forked_slice(c, 8)


# Types


@query(f"{TYPED} SELECT item_id, family, lifecycle, substr(lo, 5) AS lower_class, substr(hi, 5) AS upper_class FROM bound")
def type_lower_upper_bound(c: Context) -> DataFrame:
    return types.bounds(c.typed, c.closure)


@query(f"{TYPED} SELECT * FROM items WHERE item_id = (SELECT min(item_id) FROM items WHERE item_id % 4 = 1)")
def with_id(c: Context) -> DataFrame:
    wanted = c.items().filter("item_id % 4 = 1").agg(F.min("item_id")).first()[0]
    return algebra.Items(None, wanted).compile(c.items(), c.closure)


@query(f"{TYPED} SELECT * FROM items")
def wildcard(c: Context) -> DataFrame:
    return algebra.Items("Entity").compile(c.items(), c.closure)


@query(f"{TYPED} SELECT * FROM items WHERE item_class IN ('Account', 'Premium')")
def subtype_wildcard(c: Context) -> DataFrame:
    return algebra.Items("Account").compile(c.items(), c.closure)


@query(f"{TYPED} SELECT * FROM items WHERE item_class IN ('Account', 'Premium') UNION ALL SELECT * FROM items")
def plus(c: Context) -> DataFrame:
    return (algebra.Items("Account") + algebra.Items("Entity")).compile(c.items(), c.closure)


@query(f"{TYPED} SELECT a.item_id AS l_item_id, b.item_id AS r_item_id, a.item_class AS l_class, b.item_class AS r_class FROM items a JOIN items b ON a.item_id = b.item_id WHERE a.item_class IN ('Account', 'Premium') AND b.item_class = 'Package'")
def ap_product(c: Context) -> DataFrame:
    """A product with an equality of the two sides, which becomes a hash join."""
    pairs = algebra.Items("Account").ap(algebra.Items("Package"), on=lambda a, b: a["item_id"] == b["item_id"]).compile(c.items(), c.closure)
    return pairs.select(F.col("left.item_id").alias("l_item_id"), F.col("right.item_id").alias("r_item_id"), F.col("left.item_class").alias("l_class"), F.col("right.item_class").alias("r_class"))


@query(f"{TYPED} SELECT * FROM items WHERE false")
def none(c: Context) -> DataFrame:
    return algebra.Nothing().compile(c.items(), c.closure)


@query("SELECT 42 AS value")
def point(c: Context) -> DataFrame:
    return algebra.Point(value=42).compile(c.items(), c.closure)


@query(f"{TYPED} SELECT item_id * 10 AS tenfold, upper(item_class) AS loud FROM items")
def map_projection(c: Context) -> DataFrame:
    return algebra.Items("Entity").map(tenfold=F.col("item_id") * 10, loud=F.upper("item_class")).compile(c.items(), c.closure)


@query(f"{TYPED} SELECT count(*) AS n FROM items WHERE item_class IN ('Account', 'Premium')")
def number_of(c: Context) -> DataFrame:
    return algebra.Items("Account").count(c.items(), c.closure)


@query(f"{TYPED} SELECT CAST((SELECT count(*) FROM items) * (SELECT count(*) FROM items WHERE item_class = 'Package') + 1 AS BIGINT) AS n")
def number_of_product(c: Context) -> DataFrame:
    """Counts of products and sums are products and sums of counts: no pair is made."""
    return (algebra.Items("Entity").ap(algebra.Items("Package")) + algebra.Point(value=1)).count(c.items(), c.closure)


@query(f"""{TYPED}, last AS (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY u.item_id, u.family, u.lifecycle, u.method ORDER BY anchor_when DESC, anchor_rev DESC, anchor_tb DESC) AS r
 FROM upd u JOIN items i ON u.item_id = i.item_id AND u.family = i.family AND u.lifecycle = i.lifecycle WHERE anchor_when <= TIMESTAMP '{WHEN}') x WHERE r = 1),
state AS (SELECT item_id, family, lifecycle, max(CASE WHEN method = 'purchase' THEN value END) AS owed, coalesce(max(CASE WHEN method = 'click' THEN value END), 0) AS paid FROM last GROUP BY 1, 2, 3)
SELECT item_class, count(*) AS items, round(sum(owed - paid), 2) AS uncovered FROM state s JOIN items i ON s.item_id = i.item_id AND s.family = i.family AND s.lifecycle = i.lifecycle WHERE owed > paid GROUP BY item_class""")
def reduce_uncovered_value(c: Context) -> DataFrame:
    """What rendered items owe (the last purchase) beyond what they paid (the last click), by class: filter, map and sum over items."""
    item = ["item_id", "family", "lifecycle"]
    value = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    updates = fold.cut(measurements.updates(c.typed, item=("item_id", "family")), WHEN)
    state = fold.latest_values(updates, ("item_id", "family")).groupBy(*item).agg(value("purchase").alias("owed"), F.coalesce(value("click"), F.lit(0)).alias("paid"))
    rows = state.filter("owed > paid").join(c.items(), item)
    return rows.groupBy("item_class").agg(F.count("*").alias("items"), F.round(F.sum(F.col("owed") - F.col("paid")), 2).alias("uncovered"))


# Forks

FORK = "2024-01-15 00:00:00"


def _fork_sql(when: str = "9999-01-01 00:00:00") -> str:
    """A fork at the first half of the revisions and FORK; revisions of the second half whose number is even are its own."""
    return f"""WITH {LOG_SQL}, common AS (SELECT CAST(floor({R_SQL} / 2) AS INT) AS n),
base0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY revision DESC) AS rn FROM log, common WHERE revision < n) x WHERE rn = 1),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY revision DESC) AS rn FROM log, common WHERE revision >= n AND revision < {R_SQL} AND revision % 2 = 0) x WHERE rn = 1),
forked AS (SELECT * FROM base0 WHERE (when_ts <= TIMESTAMP '{FORK}' OR kind = 'annulled') AND event_key NOT IN (SELECT event_key FROM own) UNION ALL SELECT * FROM own),
eff AS (SELECT * FROM forked WHERE kind <> 'annulled' AND when_ts <= TIMESTAMP '{when}')"""


def _fork(c: Context, when="+inf") -> DataFrame:
    common = c.revision // 2
    own = c.log.filter((F.col("revision") >= common) & (F.col("revision") % 2 == 0))
    return forks.fork_in_force(c.log, own, common, FORK, c.revision, when)


@query(f"{_fork_sql()} SELECT {_EVENT_SQL} FROM eff")
def fork_events_in_force(c: Context) -> DataFrame:
    return _fork(c).select(*_EVENT)


@query(f"{_fork_sql()}, {_folded_sql()}, {_state_sql()} SELECT * FROM state")
def fork_state(c: Context) -> DataFrame:
    effective = _fork(c)
    folded = measurements.updates(lifecycles.lifecycles(effective))
    return fold.latest_values(fold.alive(folded, effective, WHEN))


@query(f"{_fork_sql()}, second AS (SELECT * FROM forked WHERE kind <> 'annulled' AND when_ts <= TIMESTAMP '{EARLY}') SELECT kind, count(*) AS n, round(sum(value), 2) AS total FROM second GROUP BY kind")
def fork_of_fork(c: Context) -> DataFrame:
    """A fork of the fork, at an earlier time, with nothing booked yet."""
    rows = _fork(c, forks.least_when(FORK, EARLY))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# References

_REFS_SQL = f"""{FOLDED}, {_state_sql()},
refs AS (SELECT r.item_id, r.event_key, r.ref_id, r.when_ts, r.revision, r.tb, (SELECT count(*) FROM eff e WHERE e.kind = 'annihilation' AND e.item_id = r.ref_id
 AND (e.when_ts < r.when_ts OR (e.when_ts = r.when_ts AND (e.revision < r.revision OR (e.revision = r.revision AND e.tb <= r.tb))))) AS ref_lifecycle
 FROM lc r WHERE kind <> 'annihilation' AND ref_id IS NOT NULL AND when_ts <= TIMESTAMP '{WHEN}'),
alive AS (SELECT DISTINCT item_id, lifecycle FROM live),
deref AS (SELECT r.item_id, r.event_key AS event_id, r.ref_id, r.ref_lifecycle, a.item_id IS NULL AS is_ghost FROM refs r LEFT JOIN alive a ON r.ref_id = a.item_id AND r.ref_lifecycle = a.lifecycle)"""


def _references(c: Context) -> DataFrame:
    rows = c.in_force.filter("kind <> 'annihilation' and ref_id is not null").filter(F.col("when_ts") <= F.lit(WHEN).cast("timestamp_ntz"))
    placed = references.reference_lifecycles(rows.select("item_id", "event_id", "ref_id", "when_rank", "when_ts", "revision", "tb", "intra"), c.in_force)
    live = fold.alive(c.updates, c.in_force, WHEN).select("item_id", "lifecycle").distinct()
    return references.related(placed.select("item_id", "event_id", "ref_id", "ref_lifecycle"), live)


@query(f"{_REFS_SQL} SELECT item_id, event_id, ref_id, ref_lifecycle FROM deref WHERE NOT is_ghost")
def related_items(c: Context) -> DataFrame:
    return _references(c).filter("not is_ghost").drop("is_ghost")


@query(f"{_REFS_SQL} SELECT item_id, event_id, ref_id, ref_lifecycle FROM deref WHERE is_ghost")
def ghost_references(c: Context) -> DataFrame:
    return _references(c).filter("is_ghost").drop("is_ghost")


@query(f"""WITH RECURSIVE {LOG_SQL}, {_in_force_sql()}, edges AS (SELECT DISTINCT item_id AS src, ref_id AS dst FROM eff WHERE ref_id IS NOT NULL AND kind <> 'annihilation'),
reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM reach""")
def transitive_closure(c: Context) -> DataFrame:
    """Which items each item reaches through all references in force."""
    edges = c.in_force.filter("ref_id is not null and kind <> 'annihilation'").select(F.col("item_id").alias("src"), F.col("ref_id").alias("dst"))
    return references.transitive_closure(edges)


# Violations


@query(f"{FOLDED} SELECT event_key AS event_id, item_id, lifecycle FROM lc a WHERE kind = 'annihilation' AND NOT EXISTS (SELECT 1 FROM lc b WHERE b.item_id = a.item_id AND b.lifecycle = a.lifecycle AND b.kind <> 'annihilation')")
def violations_annihilation(c: Context) -> DataFrame:
    return violations.annihilations_of_nothing(c.numbered)


@query(f"""{TYPED} SELECT DISTINCT l.item_id, l.family, l.lifecycle, l.item_class, substr(b.lo, 5) AS lower_class FROM lc l JOIN bound b ON l.item_id = b.item_id AND l.family = b.family AND l.lifecycle = b.lifecycle
 WHERE l.kind <> 'annihilation' AND NOT EXISTS (SELECT 1 FROM closure c WHERE c.sub = substr(b.lo, 5) AND c.super = l.item_class)""")
def violations_type(c: Context) -> DataFrame:
    return types.inconsistent(c.typed, c.closure)


@query(f"""{TYPED}, u AS (SELECT DISTINCT item_id, family, lifecycle, item_class FROM lc WHERE kind <> 'annihilation'),
leaves AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u d JOIN closure c ON d.item_class = c.sub AND c.super = u.item_class AND c.distance > 0 WHERE d.item_id = u.item_id AND d.family = u.family AND d.lifecycle = u.lifecycle))
SELECT u.item_id, u.family, u.lifecycle, u.item_class, count(*) AS n_leaves FROM u JOIN leaves l ON l.item_id = u.item_id AND l.family = u.family AND l.lifecycle = u.lifecycle
 JOIN closure c ON c.sub = l.item_class AND c.super = u.item_class AND c.distance > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def violations_ambiguous(c: Context) -> DataFrame:
    return types.ambiguous(c.typed, c.closure)


@query(f"{TYPED} SELECT item_id, family, lifecycle, substr(lo, 5) AS lower_class, substr(hi, 5) AS upper_class FROM bound WHERE substr(lo, 5) IN ('Entity', 'Package')")
def violations_abstract(c: Context) -> DataFrame:
    """Lifecycles that could not be made if Entity and Package were abstract."""
    return types.abstract_only(c.typed, c.closure, ["Entity", "Package"])


@query(f"""{FOLDED}, sums AS (SELECT item_id, lifecycle, method, run, sum(value) OVER (PARTITION BY item_id, lifecycle, method ORDER BY anchor_when, anchor_rev, anchor_tb ROWS UNBOUNDED PRECEDING) AS total FROM upd)
SELECT item_id, lifecycle, method, run, round(total, 2) AS total FROM sums WHERE NOT (total < 250)""")
def violations_invariant(c: Context) -> DataFrame:
    return violations.broken_invariants(c.updates, F.col("total") < 250).withColumn("total", F.round("total", 2))


@query(f"""{FOLDED}, firsts AS (SELECT item_id, lifecycle, method, run, when_ts, revision, tb FROM pos WHERE p = 1), bests AS (SELECT item_id, lifecycle, method, run, when_ts, revision, tb, ref_id FROM pos WHERE q = 1 AND ref_id IS NOT NULL),
ends AS (SELECT item_id, when_ts, revision, tb FROM eff WHERE kind = 'annihilation'),
sides AS (SELECT b.item_id, b.lifecycle, b.method, b.run, b.ref_id,
 (SELECT count(*) FROM ends e WHERE e.item_id = b.ref_id AND (e.when_ts < b.when_ts OR (e.when_ts = b.when_ts AND (e.revision < b.revision OR (e.revision = b.revision AND e.tb <= b.tb))))) AS best_lifecycle,
 (SELECT count(*) FROM ends e WHERE e.item_id = b.ref_id AND (e.when_ts < f.when_ts OR (e.when_ts = f.when_ts AND (e.revision < f.revision OR (e.revision = f.revision AND e.tb <= f.tb))))) AS anchor_lifecycle
 FROM bests b JOIN firsts f ON b.item_id = f.item_id AND b.lifecycle = f.lifecycle AND b.method = f.method AND b.run = f.run)
SELECT * FROM sides WHERE best_lifecycle <> anchor_lifecycle""")
def violations_future_item(c: Context) -> DataFrame:
    return violations.future_items(c.numbered, c.in_force)


# Incremental work

_TWO = f"""WITH {LOG_SQL}, {_in_force_sql(name="eff")}, {_in_force_sql(R_SQL + " + 1", name="eff2")}"""


@query(f"""{_TWO} SELECT event_key AS event_id, revision, item_id, CASE WHEN side = 1 THEN 'revoked' ELSE 'added' END AS change FROM (
 SELECT event_key, revision, item_id, 1 AS side FROM (SELECT event_key, revision, item_id FROM eff EXCEPT SELECT event_key, revision, item_id FROM eff2) a
 UNION ALL SELECT event_key, revision, item_id, 2 FROM (SELECT event_key, revision, item_id FROM eff2 EXCEPT SELECT event_key, revision, item_id FROM eff) b) x""")
def revision_delta(c: Context) -> DataFrame:
    new = timeline.events_in_force(c.log, c.revision + 1)
    return timeline.revision_delta(c.in_force, new, ["event_id", "revision", "item_id"])


@query(f"""{_TWO}, touched AS (SELECT item_id, ref_id FROM log WHERE event_key IN (SELECT event_key FROM log WHERE revision = {R_SQL}) AND revision <= {R_SQL}),
direct AS (SELECT item_id FROM touched UNION SELECT ref_id FROM touched WHERE ref_id IS NOT NULL)
SELECT item_id FROM direct UNION SELECT item_id FROM eff2 WHERE ref_id IN (SELECT item_id FROM direct)""")
def dirty_items_for_revision(c: Context) -> DataFrame:
    """Items to recompute after one revision: those its events touch or touched, and those that refer to them."""
    from .incremental import dirty_items

    return dirty_items(c.log, c.revision)


# Folds that need code


@query(f"{STATE} SELECT item_id, lifecycle, count(*) AS steps, round(sum(value), 2) AS total, max(value) AS top FROM live GROUP BY 1, 2")
def custom_reducer_fold(c: Context) -> DataFrame:
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame({"item_id": [first["item_id"]], "lifecycle": [first["lifecycle"]], "steps": [len(rows)], "total": [round(float(rows["value"].sum()), 2)], "top": [rows["value"].max()]})

    return fold.custom(fold.alive(c.updates, c.in_force, WHEN), reduce, "item_id bigint, lifecycle bigint, steps bigint, total double, top double")


@query(f"""{STATE.replace("WITH ", "WITH RECURSIVE ", 1)}, links AS (SELECT DISTINCT item_id AS a, ref_id AS b FROM eff WHERE ref_id IS NOT NULL AND kind <> 'annihilation'),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), meets AS (SELECT a, b FROM both_ways UNION SELECT m.a, w.b FROM meets m JOIN both_ways w ON m.b = w.a),
label AS (SELECT a AS item_id, least(a, min(b)) AS component FROM meets GROUP BY a), own AS (SELECT item_id, sum(value) AS own FROM live GROUP BY item_id),
parts AS (SELECT coalesce(component, o.item_id) AS component, o.item_id, own FROM own o LEFT JOIN label l ON o.item_id = l.item_id)
SELECT component, item_id, round(own / nullif(sum(own) OVER (PARTITION BY component), 0), 6) AS share FROM parts""")
def component_fold(c: Context) -> DataFrame:
    """Each item's share of the values of its component: of all items that references in force connect it with."""
    edges = c.in_force.filter("ref_id is not null and kind <> 'annihilation'").select(F.col("item_id").alias("a"), F.col("ref_id").alias("b"))
    return fold.component_shares(fold.alive(c.updates, c.in_force, WHEN), edges)
