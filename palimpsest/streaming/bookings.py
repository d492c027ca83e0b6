"""Bookings from a stream: each micro-batch becomes one revision, once."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.world import World


def book_stream(world: World, bookings: DataFrame, checkpoint: str, checked: bool = True, clock=None, trigger: dict | None = None):
    """Starts a query that books a stream with columns event_id, kind, when_rank, when_ts, intra, item_id, item_class, method, args.

    There is no watermark: an event may be back-dated by any time, and is then a correction. A micro-batch is tagged with its number,
    so one that is tried again after a failure finds its revision and books nothing. Column tb, the place
    of an event in its batch, is optional.
    """
    clock = clock or (lambda: datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" "))

    def book(batch: DataFrame, number: int) -> None:
        if "tb" not in batch.columns:
            # Events of one batch and moment go by a hash of their ids, which needs no order of the whole batch.
            batch = batch.withColumn("tb", F.hash("event_id"))
        world.revise_rows(batch, clock(), checked, tag=f"batch-{number}")

    return bookings.writeStream.foreachBatch(book).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_history(updates: DataFrame, duration: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows over the anchors of rendered updates: (window, method, n, total)."""
    window = F.window(F.col("anchor.when_ts"), duration, slide) if slide else F.window(F.col("anchor.when_ts"), duration)
    return updates.groupBy(window.alias("window"), "method").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

