"""Incremental recomputation: which items a revision makes dirty, and patching a materialised table of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lifecycles import lifecycles
from ..operators.measurements import updates
from ..operators.timeline import events_in_force


def dirty_items(log: DataFrame, revision: int) -> DataFrame:
    """(item_id): items touched by any version, old or new, of the events that `revision` books, and items that refer to those."""
    booked = log.filter(F.col("revision") == revision).select("event_id").distinct()
    versions = log.filter(F.col("revision") <= revision).join(booked, "event_id", "left_semi")
    direct = versions.select("item_id").union(versions.filter("ref_id is not null").select("ref_id")).distinct()
    now = events_in_force(log, revision + 1)
    referring = now.filter("ref_id is not null").join(direct.withColumnRenamed("item_id", "ref_id"), "ref_id", "left_semi")
    return direct.union(referring.select("item_id")).distinct()


def refreshed(materialised: DataFrame, log: DataFrame, revision: int) -> DataFrame:
    """The updates after `revision` from those before: the timelines of dirty items are folded anew, all others are kept."""
    dirty = dirty_items(log, revision)
    events = log.filter(F.col("revision") <= revision)
    # Versions of an event may name different items, so an event counts as dirty with any item that a version names.
    ids = events.join(dirty, "item_id", "left_semi").select("event_id").distinct()
    again = events_in_force(events.join(ids, "event_id", "left_semi")).join(dirty, "item_id", "left_semi")
    return materialised.join(dirty, "item_id", "left_anti").unionByName(updates(lifecycles(again)).select(*materialised.columns))
