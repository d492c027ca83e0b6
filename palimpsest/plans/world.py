"""Worlds: revisions booked atomically, scopes in two times, what-if forks. Everything rendered is a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import ORDER, at_or_before
from ..operators import fold, lifecycles, measurements, references, timeline, violations
from ..operators import typing as types
from ..sources.tables import EVENT_LOG, ConcurrentRevision, MemoryStore
from .algebra import Items, Query
from .events import Event, encoded
from .registry import Registry

MAIN = "main"
_ITEM = ("item",)
LISTS = ("append", "append_negated", "add_ref", "forget")


class RejectedRevision(ValueError):
    """The bookings contradict each other or the rest of the history; nothing was booked."""


def _iso(as_of) -> str:
    return as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")


def _literal(when):
    return when if when is None or isinstance(when, str) else when.isoformat(sep=" ")


def _links(rows: DataFrame) -> DataFrame:
    """(src, dst): which items rows refer to as arguments of their targets."""
    args = rows.select(F.col("item_id").alias("src"), F.explode("args").alias("_a")).filter("_a.ref is not null")
    return args.select("src", F.col("_a.ref.item_id").alias("dst")).distinct()


def _referring(ids: DataFrame, links: DataFrame) -> DataFrame:
    """ids (item_id) and the items that refer to them."""
    return ids.union(links.join(ids.withColumnRenamed("item_id", "dst"), "dst", "left_semi").select("src")).distinct()


def reach(in_force: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id), (item_id): the items whose history may have changed where events touch items, and all whose rows decide that history.

    A touched item changes itself, those that it refers to (its type decides what its calls do to them), and those that refer to it (its
    annihilations decide which lifecycle they mean). These are folded from their own events, those of items that refer to them, for they may
    change them, those of items that refer to these, for they may decide their types, and those of items that they refer to, for their ends.
    Touched ids come from one revision; all others are found by semi-joins.
    """
    links = _links(in_force)
    forward = lambda ids: ids.union(links.join(ids.withColumnRenamed("item_id", "src"), "src", "left_semi").select("dst")).distinct()
    spark = in_force.sparkSession
    affected = references._cut(spark, forward(touched).union(_referring(touched, links)).distinct())
    return affected, references._cut(spark, forward(affected).union(_referring(_referring(affected, links), links)).distinct())


class Histories:
    """The folded form of a set of versions in force: typed rows, lifecycles, updates, states."""

    def __init__(self, spark: SparkSession, registry: Registry, in_force: DataFrame, held: bool = False) -> None:
        """held: the numbered rows and the updates are persisted, for many queries over them; release() lets them go."""
        self.spark, self.registry = spark, registry
        self.closure = types.type_closure(spark, registry.parents())
        targets = in_force.withColumn("referred", F.lit(False))
        args = in_force.select(*[c for c in in_force.columns if c not in ("item_id", "item_class")], F.explode("args").alias("_a")).filter("_a.ref is not null")
        named = args.select(*[F.col("_a.ref.item_id").alias("item_id") if c == "item_id" else F.col("_a.ref.item_class").alias("item_class") if c == "item_class" else F.col(c) for c in in_force.columns], F.lit(True).alias("referred"))
        parents = list(registry.parents().values())
        if len(set(parents)) == len(parents):  # one branch: an id is one item
            rows = targets.unionByName(named).withColumn("family", F.lit(next(t for t, up in registry.parents().items() if up is None)))
        else:
            rows = types.with_family(targets.unionByName(named), self.closure)
        self.rows = rows.withColumn("item", F.concat_ws("\x01", "item_id", "family"))
        # References give a type but take effect only with the patch that wins its run.
        self.numbered = lifecycles.lifecycles(self.rows, _ITEM)
        if held:
            self.numbered = self.numbered.persist()
            self.rows = self.numbered.drop("lifecycle")
        self.bounds = types.bounds(self.numbered, self.closure, _ITEM)
        own = self.numbered.filter("not referred")
        self.updates = measurements.updates(own, item=("item", "item_id", "family"), values=("args",))
        if held:
            self.updates = self.updates.persist()
        # Annihilations of ids that nothing else names have no family.
        self.lost = in_force.filter("kind = 'annihilation'").join(self.rows.select("item_id").distinct(), "item_id", "left_anti")
        self.ends = self.rows.filter("kind = 'annihilation'").dropDuplicates(["item", *ORDER])

    def release(self) -> None:
        self.updates.unpersist()
        self.numbered.unpersist()

    def references(self) -> DataFrame:
        """(item, item_id, family, lifecycle, method, anchor, ref_item, ref_id, ref_lifecycle) of the patches that took effect."""
        fam = self.rows.filter("kind <> 'annihilation'").select(F.col("item_id").alias("_i"), F.col("item_class").alias("_c"), F.col("item").alias("ref_item")).distinct()
        refs = self.updates.select("item", "item_id", "family", "lifecycle", "method", "anchor", F.explode("args").alias("_a")).filter("_a.ref is not null")
        refs = refs.join(fam, (F.col("_a.ref.item_id") == F.col("_i")) & (F.col("_a.ref.item_class") == F.col("_c"))).drop("_a", "_c").withColumnRenamed("_i", "ref_item_id")
        flat = refs.select("item", "item_id", "family", "lifecycle", "method", F.col("ref_item").alias("ref_id"), "ref_item_id", "anchor", *[F.col(f"anchor.{c}").alias(c) for c in ORDER])
        ends = self.ends.select(F.col("item").alias("item_id"), "kind", *ORDER)
        return references.reference_lifecycles(flat, ends).withColumnRenamed("ref_id", "ref_item").drop(*ORDER)

    def presence(self) -> DataFrame:
        """(item, item_id, lifecycle, anchor): what makes an item be there, as target or argument of a patch that took effect."""
        refs = self.references().select(F.col("ref_item").alias("item"), F.col("ref_item_id").alias("item_id"), F.col("ref_lifecycle").alias("lifecycle"), "anchor")
        return self.updates.select("item", "item_id", "lifecycle", "anchor").union(refs)

    def ended(self, when, inclusive: bool = True) -> DataFrame:
        dead = self.ends.filter(at_or_before(F.col("when_rank"), F.col("when_ts"), when, inclusive))
        return dead.groupBy("item").agg(F.count("*").alias("ended"))

    def steps(self) -> DataFrame:
        """(item, lifecycle, anchor, op, attribute, lit): the operations of all updates, mirrored ones included."""
        methods = F.broadcast(self.spark.createDataFrame(self.registry.method_rows(), "lower_class string, method string, op string, attribute string, sql_type string, m_op string, m_attribute string"))
        low = self.bounds.select("item", "lifecycle", "lower_class")
        own = self.updates.join(low, ["item", "lifecycle"]).join(methods, ["lower_class", "method"])
        first = F.col("args")[0]
        many = F.concat(F.lit("["), F.array_join(F.transform("args", lambda a: F.coalesce(a["lit"], a["ref"]["item_id"])), ", "), F.lit("]"))
        lit = F.when(F.size("args") > 1, many).otherwise(F.coalesce(first["lit"], first["ref"]["item_id"]))
        mine = own.select("item", "lifecycle", "anchor", "op", "attribute", lit.alias("lit"))
        refs = self.references().join(low, ["item", "lifecycle"]).join(methods.filter("m_op is not null"), ["lower_class", "method"])
        mirrored = refs.select(F.col("ref_item").alias("item"), F.col("ref_lifecycle").alias("lifecycle"), "anchor", F.col("m_op").alias("op"), F.col("m_attribute").alias("attribute"), F.col("item_id").alias("lit"))
        return mine.union(mirrored)

    def states(self, when, inclusive: bool = True) -> DataFrame:
        """(item_id, family, lifecycle, item_class, state map, lists map) of the items alive at `when`."""
        here = fold.cut(self.presence(), when, inclusive).select("item", "item_id", "lifecycle").distinct()
        here = here.join(self.ended(when, inclusive), "item", "left").filter(F.col("lifecycle") == F.coalesce("ended", F.lit(0)))
        here = here.join(self.bounds, ["item", "lifecycle"]).select("item", "item_id", F.substring_index("item", "\x01", -1).alias("family"), "lifecycle", F.col("lower_class").alias("item_class"))
        steps = fold.cut(self.steps(), when, inclusive)
        ordered = F.sort_array(F.collect_list(F.struct("anchor", "op", "lit")))
        per = steps.groupBy("item", "lifecycle", "attribute").agg(F.max_by("lit", "anchor").alias("last"), F.max_by("op", "anchor").alias("op"), F.sum(F.expr("try_cast(lit AS double)")).alias("total"), ordered.alias("steps"))

        def advance(held: Column, s: Column) -> Column:
            without = F.array_remove(held, s["lit"])
            return (
                F.when(s["op"] == "forget", without)
                .when(s["op"] == "add_ref", F.array_append(without, s["lit"]))
                .when(s["op"] == "append_negated", F.array_append(held, F.when(s["lit"].startswith("-"), F.substring(s["lit"], 2, 1 << 30)).when(s["lit"] == "0", s["lit"]).otherwise(F.concat(F.lit("-"), s["lit"]))))
                .otherwise(F.array_append(held, s["lit"]))
            )

        items = F.aggregate("steps", F.array().cast("array<string>"), advance)
        entry = F.when(F.col("op") == "add", F.col("total").cast("string")).otherwise(F.col("last"))
        scalar = F.when(~F.col("op").isin(*LISTS), F.struct("attribute", entry.alias("value")))
        many = F.when(F.col("op").isin(*LISTS), F.struct("attribute", items.alias("value")))
        folded = per.groupBy("item", "lifecycle").agg(F.map_from_entries(F.collect_list(scalar)).alias("state"), F.map_from_entries(F.collect_list(many)).alias("lists"))
        return here.join(folded, ["item", "lifecycle"], "left").drop("item")

    def violations(self) -> DataFrame:
        """(reason, item_id, detail) of everything that forbids this history."""
        item = F.substring_index("item", "\x01", 1).alias("item_id")
        out = [
            self.lost.select(F.lit("annihilation of nothing").alias("reason"), "item_id", F.col("event_id").alias("detail")),
            violations.annihilations_of_nothing(self.numbered, _ITEM).select(F.lit("annihilation of nothing").alias("reason"), item, F.col("event_id").alias("detail")),
            types.inconsistent(self.numbered, self.closure, _ITEM).select(F.lit("inconsistent types").alias("reason"), item, F.col("item_class").alias("detail")),
            types.abstract_only(self.numbered, self.closure, self.registry.abstract(), _ITEM).select(F.lit("abstract type").alias("reason"), item, F.col("lower_class").alias("detail")),
            self.future_references(),
        ]
        for name in self.registry.types:
            for rule in self.registry.types[name].invariants:
                out.append(self.broken(name, rule))
        rows = out[0]
        for o in out[1:]:
            rows = rows.unionByName(o)
        return rows

    def future_references(self) -> DataFrame:
        """Runs whose best patch refers to another lifecycle of its argument than the anchor does, or of an id not there before its end."""
        refs = self.references()
        last = self.updates.select("item", "lifecycle", "method", "anchor", "last")
        fam = refs.join(last, ["item", "lifecycle", "method", "anchor"])
        flat = fam.select("item", "item_id", "ref_item", "ref_lifecycle", *[F.col(f"last.{c}").alias(c) for c in ORDER]).withColumnRenamed("ref_item", "ref_id").withColumnRenamed("ref_lifecycle", "at_anchor")
        ends = self.ends.select(F.col("item").alias("item_id"), "kind", *ORDER)
        placed = references.reference_lifecycles(flat, ends)
        return placed.filter("ref_lifecycle <> at_anchor").select(F.lit("argument from the future").alias("reason"), "item_id", F.col("ref_id").alias("detail"))

    def broken(self, name: str, rule: str) -> DataFrame:
        """Updates after which an item of the type breaks `rule`, an expression over its attributes; each update is looked at."""
        subs = [s for s, up, _, _ in types.closure_rows(self.registry.parents()) if up == name]
        low = self.bounds.filter(F.col("lower_class").isin(subs)).select("item", "lifecycle")
        steps = self.steps().join(low, ["item", "lifecycle"])
        w = W.partitionBy("item", "lifecycle").orderBy("anchor").rowsBetween(W.unboundedPreceding, W.currentRow)
        defaults = self.registry.defaults(name)
        for a, op in self.registry.attributes(name).items():
            mine = F.when(F.col("attribute") == a, F.col("lit"))
            if op.kind in LISTS:
                value = F.sum(F.when(F.col("attribute") == a, F.when(F.col("op") == "forget", -1).otherwise(1))).over(w)
                steps = steps.withColumn(a, F.coalesce(value, F.lit(0)))
            elif op.kind == "add":
                steps = steps.withColumn(a, F.coalesce(F.sum(mine.cast("double")).over(w), F.lit(defaults.get(a, "0")).cast("double")).cast(op.sql_type))
            else:
                steps = steps.withColumn(a, F.coalesce(F.last(mine, ignorenulls=True).over(w), F.lit(defaults.get(a))).cast(op.sql_type))
        bad = steps.filter(~F.coalesce(F.expr(rule), F.lit(True)))
        return bad.select(F.lit("broken invariant").alias("reason"), F.substring_index("item", "\x01", 1).alias("item_id"), F.lit(rule).alias("detail"))


@dataclass(frozen=True)
class Scope:
    """A read snapshot: what was known before next_revision about the moment `when`."""

    world: World
    when: object
    next_revision: int

    @property
    def as_of(self):
        """The as-of of the last revision that is seen; None (the beginning of time) when there is none."""
        seen = self.world.revision_as_ofs[: self.next_revision]
        return seen[-1] if seen else None

    def histories(self) -> Histories:
        return Histories(self.world.spark, self.world.registry, self.world.in_force(self.next_revision))

    def items(self) -> DataFrame:
        return self.histories().states(_literal(self.when))

    def about(self, item_id: str) -> DataFrame:
        """items() of one id. Only what can matter for it is folded: its own events, those of items that refer to it, for they may change
        it, and those of items that refer to these, for they may decide their types."""
        world, rows = self.world, self.world.in_force(self.next_revision)
        links, ids = _links(rows), world.spark.createDataFrame([(item_id,)], "item_id string")
        near = references._cut(world.spark, rows.join(_referring(_referring(ids, links), links), "item_id", "left_semi"))
        return Histories(world.spark, world.registry, near).states(_literal(self.when)).filter(F.col("item_id") == item_id)

    def render(self, query: Query) -> DataFrame:
        return query.compile(self.items(), types.type_closure(self.world.spark, self.world.registry.parents()))

    def number_of(self, query: Query) -> int:
        return query.count(self.items(), types.type_closure(self.world.spark, self.world.registry.parents())).first()["n"]

    def table(self, item_class: str, item_id=None) -> DataFrame:
        """Items of a type with a column for each of its attributes, unwritten ones at the type's default."""
        if item_id is None:
            rows = self.render(Items(item_class))
        else:
            rows = Items(item_class).compile(self.about(encoded(item_id)), types.type_closure(self.world.spark, self.world.registry.parents()))
        defaults = self.world.registry.defaults(item_class)
        columns = []
        for a, op in self.world.registry.attributes(item_class).items():
            if op.kind in LISTS:
                columns.append(F.coalesce(F.col("lists")[a], F.array().cast("array<string>")).cast(f"array<{op.sql_type}>").alias(a))
            else:
                columns.append(F.coalesce(F.col("state")[a], F.lit(defaults.get(a))).cast(op.sql_type).alias(a))
        return rows.select("item_id", "item_class", "lifecycle", *columns)

    def is_empty(self, query: Query) -> bool:
        return self.render(query).isEmpty()

    def head(self, query: Query):
        """One rendered row, None if there is none."""
        return self.render(query).first()

    def iterate(self, query: Query):
        """Rendered rows one by one, without gathering them."""
        return self.render(query).toLocalIterator()


class World:
    """A history that only grows. The log is append-only, so a scope never sees a later revision."""

    def __init__(self, spark: SparkSession, registry: Registry, store=None, name: str = MAIN, base: tuple[World, int, object] | None = None) -> None:
        self.spark, self.registry, self.name, self.base = spark, registry, name, base
        self.store = store or MemoryStore(spark)

    def __enter__(self) -> World:
        return self

    def __exit__(self, *_) -> None:
        """Nothing to release: what a booking persists, it lets go itself."""

    @property
    def common(self) -> int:
        return self.base[1] if self.base else 0

    @property
    def revision_as_ofs(self) -> list[str]:
        inherited = self.base[0].revision_as_ofs[: self.common] if self.base else []
        return inherited + [c["as_of"] for c in self.store.commits(self.name)]

    @property
    def next_revision(self) -> int:
        return len(self.revision_as_ofs)

    def versions(self, revision: int) -> DataFrame:
        own = self.store.log(self.name, revision)
        if not self.base:
            return timeline.latest_versions(own, revision)
        parent, common, when = self.base
        # The parent's own versions (it may be a fork too), then what this world laid over them.
        inherited = parent.versions(min(revision, common))
        if revision <= common:
            return timeline.cut_when(inherited, when)
        mine = timeline.latest_versions(own, revision)
        kept = timeline.cut_when(inherited, when).join(mine.select("event_id").distinct(), "event_id", "left_anti")
        return kept.select(*mine.columns).unionByName(mine)

    def in_force(self, revision: int) -> DataFrame:
        return self.versions(revision).filter("kind <> 'annulled' and item_id is not null")

    def _rows(self, events: Mapping, revision: int) -> list[tuple]:
        rows = []
        for tb, (event_id, event) in enumerate(events.items()):
            if event is None:
                rows.append((self.name, revision, tb, encoded(event_id), "annulled", None, None, 0, None, None, None, []))
                continue
            patches = event.patches or (None,)
            for intra, p in enumerate(patches):
                if p is None:  # no effect, but it is the event's version
                    rows.append((self.name, revision, tb, encoded(event_id), event.kind, event.when_rank, event.when_ts, 0, None, None, None, []))
                else:
                    rows.append((self.name, revision, tb, encoded(event_id), event.kind, event.when_rank, event.when_ts, intra, p.item_id, p.item_class, p.method, list(p.args)))
        return rows

    def revise(self, events: Mapping[object, Event | None], as_of, checked: bool = True) -> int:
        """Books all of `events` (event id to event, None annuls) as one revision, or nothing; returns its number.

        Of the history with the bookings, the items that these can affect (see `reach`) are folded, and every contradiction in what they go through
        is a reason to refuse. The rest is as it was before, when it was checked; what was booked unchecked stays unchecked until it is affected.
        """
        revision = self.next_revision
        return self._book(self.spark.createDataFrame(self._rows(events, revision), EVENT_LOG), as_of, checked)

    def revise_rows(self, rows: DataFrame, as_of, checked: bool = True, tag: str | None = None) -> int:
        """Books a table with the columns of EVENT_LOG from tb on (and event_id) as one revision, of any size (which a MemoryStore collects).

        tb is the place of an event in the booking. A tag that is booked already is not booked again: its revision is returned.
        """
        for c in self.store.commits(self.name):
            if tag is not None and c.get("tag") == tag:
                return c["revision"]
        rows = rows.withColumn("world_id", F.lit(self.name)).withColumn("revision", F.lit(self.next_revision))
        schema = self.spark.createDataFrame([], EVENT_LOG).schema
        return self._book(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]), as_of, checked, tag)

    def _book(self, rows: DataFrame, as_of, checked: bool, tag: str | None = None) -> int:
        as_of, known = _iso(as_of), self.revision_as_ofs
        if known and datetime.fromisoformat(as_of) < datetime.fromisoformat(known[-1]):
            raise ValueError(f"as-of {as_of} is before the last revision's {known[-1]}")
        revision = len(known)
        if checked:
            reasons = self.contradictions(rows, revision).limit(10).collect()
            if reasons:
                raise RejectedRevision("; ".join(f"{r['reason']}: {r['item_id']} ({r['detail']})" for r in reasons))
        self.store.append(self.name, revision, as_of, rows, tag)
        return revision

    def contradictions(self, rows: DataFrame, revision: int) -> DataFrame:
        """(reason, item_id, detail) of what forbids booking `rows` as `revision`, among the items that they can affect; a table with no lineage."""
        versions = self.versions(revision)
        proposed = timeline.proposed(versions, rows, None).filter("item_id is not null").persist()
        try:
            replaced = versions.join(rows.select("event_id").distinct(), "event_id", "left_semi").unionByName(rows.select(*versions.columns))
            touched = replaced.select("item_id").union(replaced.select(F.explode("args.ref.item_id"))).filter("item_id is not null").distinct()
            affected, needed = reach(proposed, touched)
            near = references._cut(self.spark, proposed.join(needed, "item_id", "left_semi"))
        finally:
            proposed.unpersist()
        held = Histories(self.spark, self.registry, near, held=True)
        try:
            return references._cut(self.spark, held.violations().join(affected, "item_id", "left_semi").select("reason", "item_id", "detail"))
        finally:
            held.release()

    def book(self, event_id, event: Event | None, as_of) -> int:
        """revise() with a single event."""
        return self.revise({event_id: event}, as_of)

    def annul(self, event_id, as_of) -> int:
        return self.revise({event_id: None}, as_of)

    def scope(self, when, next_revision: int | None = None, as_of=None) -> Scope:
        """At `when` (datetime, ISO text, "-inf", "+inf"), before next_revision or as of an instant."""
        known = self.revision_as_ofs
        if as_of is not None:
            limit = datetime.fromisoformat(_iso(as_of))
            next_revision = sum(datetime.fromisoformat(a) <= limit for a in known)
        next_revision = len(known) if next_revision is None else next_revision
        if next_revision > len(known):
            raise ValueError(f"only {len(known)} revisions are booked")
        return Scope(self, when, next_revision)

    def fork(self, scope: Scope, name: str) -> World:
        """An experimental world: this one as the scope sees it, to be revised on its own."""
        return World(self.spark, self.registry, self.store, name, (self, scope.next_revision, _literal(scope.when)))


__all__ = ["ConcurrentRevision", "Histories", "RejectedRevision", "Scope", "World"]
