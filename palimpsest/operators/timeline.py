"""The relational kernel over an event log: which versions are in force, in which order, and how sets of them differ.

A log has columns event_id, revision, tb, kind (change, measurement, annihilation, annulled), when_rank, when_ts and, for each
patch, intra, item_id, item_class, method, value. Rows of one event and revision form one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import at_or_before, ordered


def latest_versions(log: DataFrame, revision: int | None) -> DataFrame:
    """The latest version of each event before `revision` (None: of all), tombstones included.

    The rank filter becomes a WindowGroupLimit, which cuts old versions before the shuffle too.
    """
    if revision is not None:
        log = log.filter(F.col("revision") < revision)
    latest = F.rank().over(W.partitionBy("event_id").orderBy(F.col("revision").desc()))
    return log.withColumn("_r", latest).filter("_r = 1").drop("_r")


def events_in_force(log: DataFrame, revision: int | None = None) -> DataFrame:
    return latest_versions(log, revision).filter("kind <> 'annulled'")


def timeline(in_force: DataFrame) -> DataFrame:
    """Adds `position`, the place of each patch in its item's timeline. There is no global sort."""
    return in_force.withColumn("position", F.row_number().over(W.partitionBy("item_id").orderBy(*ordered())).cast("bigint"))


def patches(events: DataFrame) -> DataFrame:
    """Rows with `patches ARRAY<STRUCT<...>>` to a row for each patch; events without patches have no effect."""
    return events.select("*", F.posexplode("patches").alias("intra", "_p")).select("*", "_p.*").drop("_p", "patches")


def footprint(in_force: DataFrame) -> DataFrame:
    """(event_id, item_id): the items that an event touches, as target or argument."""
    target = in_force.select("event_id", "item_id")
    return target.union(in_force.filter("ref_id is not null").select("event_id", "ref_id")).distinct()


def proposed(log: DataFrame, booking: DataFrame, revision: int | None = None) -> DataFrame:
    """What would be in force once `booking` were revised: versions of events it does not book, and its own."""
    kept = latest_versions(log, revision).join(booking.select("event_id").distinct(), "event_id", "left_anti")
    return kept.unionByName(booking.select(*kept.columns)).filter("kind <> 'annulled'")


def cut_when(versions: DataFrame, when, keep_tombstones: bool = True) -> DataFrame:
    """Versions up to `when`; only after the latest version is chosen may this be applied."""
    within = at_or_before(F.col("when_rank"), F.col("when_ts"), when)
    return versions.filter(within | (F.col("kind") == "annulled") if keep_tombstones else within)


def revision_delta(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows only in old (`revoked`) and only in new (`added`), by one aggregation instead of two anti-joins."""
    both = old.select(*columns, F.lit(1).alias("_o"), F.lit(0).alias("_n")).union(new.select(*columns, F.lit(0), F.lit(1)))
    d = both.groupBy(*columns).agg(F.sum("_o").alias("_o"), F.sum("_n").alias("_n")).filter("_o <> _n")
    return d.select(*columns, F.when(F.col("_o") > F.col("_n"), "revoked").otherwise("added").alias("change"))


def revision_at(revisions: DataFrame, as_of) -> DataFrame:
    """next_revision for an as-of: how many revisions were booked by then, duplicates included."""
    return revisions.agg(F.count(F.when(F.col("as_of") <= F.lit(as_of).cast("timestamp_ntz"), 1)).cast("int").alias("next_revision"))
