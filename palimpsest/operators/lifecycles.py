"""Lifecycles: annihilations cut an item's timeline, what follows is another item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import ORDER, at_or_before, ordered


def lifecycles(in_force: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Adds `lifecycle`: how many annihilations of the item come before the row."""
    before = W.partitionBy(*item).orderBy(*ordered()).rowsBetween(W.unboundedPreceding, -1)
    ends = F.sum(F.when(F.col("kind") == "annihilation", 1).otherwise(0)).over(before)
    return in_force.withColumn("lifecycle", F.coalesce(ends, F.lit(0)).cast("bigint"))


def lifecycle_intervals(numbered: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(item, lifecycle, start_when, end_when, n_events, ended) of lifecycles that have an event other than their annihilation."""
    end = F.max(F.when(F.col("kind") == "annihilation", F.col("when_ts")))
    body = F.when(F.col("kind") != "annihilation", F.col("when_ts"))
    out = numbered.groupBy(*item, "lifecycle").agg(F.min(body).alias("start_when"), end.alias("end_when"), F.count(body).alias("n_events"))
    return out.filter("n_events > 0").withColumn("ended", F.col("end_when").isNotNull())


def next_starts(intervals: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Adds next_start: where the item's following lifecycle starts."""
    return intervals.withColumn("next_start", F.lead("start_when").over(W.partitionBy(*item).orderBy("lifecycle")))


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals [start_when, end_when) of a and b with one key that overlap; open ends reach on."""
    left = a.select(key, F.col("item_id").alias("a_id"), F.col("lifecycle").alias("a_life"), F.col("start_when").alias("a_start"), F.col("end_when").alias("a_end"))
    right = b.select(F.col(key).alias("_k"), F.col("item_id").alias("b_id"), F.col("lifecycle").alias("b_life"), F.col("start_when").alias("b_start"), F.col("end_when").alias("b_end"))
    on = (left[key] == right["_k"]) & (F.col("a_id") < F.col("b_id"))
    on &= (F.col("a_end").isNull() | (F.col("b_start") < F.col("a_end"))) & (F.col("b_end").isNull() | (F.col("a_start") < F.col("b_end")))
    return left.join(right, on).drop("_k")


def ended_by(in_force: DataFrame, when, item: tuple[str, ...] = ("item_id",), inclusive: bool = True) -> DataFrame:
    """(item, ended): annihilations up to `when`, the number of the lifecycle that may be alive then."""
    dead = in_force.filter("kind = 'annihilation'").filter(at_or_before(F.col("when_rank"), F.col("when_ts"), when, inclusive))
    return dead.groupBy(*item).agg(F.count("*").alias("ended"))


def validity(updates: DataFrame, item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """As-of intervals of each attribute: from its anchor to the next one's."""
    w = W.partitionBy(*item, "lifecycle", "method").orderBy(*[F.col(f"anchor.{c}") for c in ORDER])
    return updates.withColumn("valid_from", F.col("anchor.when_ts")).withColumn("valid_to", F.lead("anchor.when_ts").over(w))

