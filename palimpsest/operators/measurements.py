"""Measurement folding: a run's best patch takes effect where the run begins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import BEST_PATCH, order_key, ordered


def updates(numbered: DataFrame, best: str = "latest", item: tuple[str, ...] = ("item_id",), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """(item, lifecycle, method, run, anchor, anchor_event, values..., last) from rows with `lifecycle`.

    A run of an item's lifecycle and method is a change and the measurements up to the next change of that method; measurements
    before any change are run 0. Its patch is chosen by BEST_PATCH[best] and applied at the key of its first one. The cut by
    time comes after this, on the anchor: a later measurement alters what an earlier moment sees.
    """
    rows = numbered.filter("kind <> 'annihilation'")
    so_far = W.partitionBy(*item, "lifecycle", "method").orderBy(*ordered()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("run", F.sum(F.when(F.col("kind") == "change", 1).otherwise(0)).over(so_far).cast("bigint"))
    rows = rows.withColumn("_key", order_key())
    picked = [BEST_PATCH[best](F.col(v), F.col("_key")).alias(v) for v in values]
    return rows.groupBy(*item, "lifecycle", "method", "run").agg(
        F.min("_key").alias("anchor"), F.min_by("event_id", "_key").alias("anchor_event"), F.max("_key").alias("last"), *picked, F.count("*").alias("run_length")
    )
