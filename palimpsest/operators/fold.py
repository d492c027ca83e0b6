"""Folding updates to states: built-in operations, pandas reducers, and folds of connected items."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import ORDER, at_or_before
from .lifecycles import ended_by


def cut(updates: DataFrame, when, inclusive: bool = True) -> DataFrame:
    return updates.filter(at_or_before(F.col("anchor.when_rank"), F.col("anchor.when_ts"), when, inclusive))


def alive(updates: DataFrame, in_force: DataFrame, when, item: tuple[str, ...] = ("item_id",), inclusive: bool = True) -> DataFrame:
    """Updates up to `when` of the lifecycle that is running then."""
    ended = ended_by(in_force, when, item, inclusive)
    rows = cut(updates, when, inclusive).join(ended, list(item), "left")
    return rows.filter(F.col("lifecycle") == F.coalesce("ended", F.lit(0))).drop("ended")


def latest_values(live: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(item, lifecycle, method, value): each attribute's last value."""
    return live.groupBy(*item, "lifecycle", "method").agg(F.max_by("value", "anchor").alias("value"))


def counters(live: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(item, lifecycle, method, n, total): attributes that add up."""
    return live.groupBy(*item, "lifecycle", "method").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def histories(live: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(item, lifecycle, datums): all values in the order of their anchors."""
    steps = F.sort_array(F.collect_list(F.struct(F.col("anchor"), F.col("method"), F.col("value"))))
    return live.groupBy(*item, "lifecycle").agg(F.transform(steps, lambda s: s["value"]).alias("datums"))


def custom(live: DataFrame, reducer: Callable[[pd.DataFrame], pd.DataFrame], schema: str, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """A reducer of one item's updates in order, as pandas; for operations that no expression gives."""
    flat = live.select(*item, "lifecycle", "method", "value", *[F.col(f"anchor.{c}").alias(c) for c in ORDER])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return reducer(rows.sort_values([*ORDER, "method"], kind="stable"))

    return flat.groupBy(*item, "lifecycle").applyInPandas(fold, schema)


def component_fold(live: DataFrame, edges: DataFrame, reducer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A reducer over all updates of the items that references connect: for patches that change other items.

    edges(a, b) are item ids. Components come from min-label propagation with pointer jumping; the reducer gets one at a time,
    whole, so a component must fit into one task. What can be added up goes through `component_shares`, which has no such bound.
    """
    from .references import connected

    labels = connected(edges)
    rows = live.join(labels, "item_id", "left").withColumn("component", F.coalesce("component", "item_id"))
    flat = rows.select("component", "item_id", "lifecycle", "method", "value", *[F.col(f"anchor.{c}").alias(c) for c in ORDER])
    return flat.groupBy("component").applyInPandas(lambda p: reducer(p.sort_values([*ORDER, "item_id", "method"], kind="stable")), schema)


def component_shares(live: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, item_id, share): what part of its component's sum of values each item gives, to 6 places; null where the sum is 0.

    edges(a, b) are item ids. Values are added up by item first, and a component's items never come together in one task.
    """
    from .references import _cut, attached, connected

    own = live.groupBy("item_id").agg(F.sum("value").alias("own")).join(connected(edges), "item_id", "left")
    own = _cut(live.sparkSession, own.select(F.coalesce("component", "item_id").alias("component"), "item_id", "own"))
    totals = own.groupBy("component").agg(F.sum("own").alias("total"))
    rows = attached(own, totals, "component", "item_id")
    return rows.select("component", "item_id", F.when(F.col("total") != 0, F.round(F.col("own") / F.col("total"), 6)).alias("share"))


def running(updates: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Adds `total`, the sum of an attribute after each of its updates: the states that invariants are held against."""
    w = W.partitionBy(*item, "lifecycle", "method").orderBy("anchor").rowsBetween(W.unboundedPreceding, W.currentRow)
    return updates.withColumn("total", F.sum("value").over(w))
