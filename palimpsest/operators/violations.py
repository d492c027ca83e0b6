"""What makes a revision inadmissible, as queries whose rows are the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import order_key, ordered
from .fold import running
from .references import reference_lifecycles


def annihilations_of_nothing(numbered: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Annihilations whose lifecycle has no other row: nothing was there to end."""
    body = F.sum(F.when(F.col("kind") != "annihilation", 1).otherwise(0)).over(W.partitionBy(*item, "lifecycle"))
    return numbered.withColumn("_n", body).filter("kind = 'annihilation' and _n = 0").select("event_id", *item, "lifecycle")


def broken_invariants(updates: DataFrame, invariant: Column, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Updates after which `invariant` (of total, the attribute's running sum) fails; it is held against every state in between."""
    return running(updates, item).filter(~invariant).select(*item, "lifecycle", "method", "run", "total")


def future_items(numbered: DataFrame, in_force: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Runs whose best patch refers to a later lifecycle of its argument than there is at the run's anchor."""
    rows = numbered.filter("kind <> 'annihilation'")
    so_far = W.partitionBy(*item, "lifecycle", "method").orderBy(*ordered()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("run", F.sum(F.when(F.col("kind") == "change", 1).otherwise(0)).over(so_far).cast("bigint")).withColumn("_key", order_key())
    runs = rows.groupBy(*item, "lifecycle", "method", "run").agg(F.min("_key").alias("first"), F.max("_key").alias("best"), F.max_by("ref_id", "_key").alias("ref_id")).filter("ref_id is not null")
    points = runs.select(*item, "lifecycle", "method", "run", "ref_id", F.explode(F.array(F.struct(F.lit("best").alias("at"), F.col("best").alias("k")), F.struct(F.lit("first").alias("at"), F.col("first").alias("k")))).alias("p"))
    placed = reference_lifecycles(points.select(*item, "lifecycle", "method", "run", "ref_id", "p.at", "p.k.*"), in_force)
    sides = placed.groupBy(*item, "lifecycle", "method", "run", "ref_id").agg(
        F.max(F.when(F.col("at") == "best", F.col("ref_lifecycle"))).alias("best_lifecycle"), F.max(F.when(F.col("at") == "first", F.col("ref_lifecycle"))).alias("anchor_lifecycle")
    )
    return sides.filter("best_lifecycle <> anchor_lifecycle")
