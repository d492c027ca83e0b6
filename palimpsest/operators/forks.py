"""What-if worlds: a base cut at a revision and a time, overlaid with bookings of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .timeline import cut_when, latest_versions


def least_when(a, b):
    """The earlier of two cut-offs ("+inf", "-inf" or timestamps in ISO form)."""
    if a == "+inf":
        return b
    if b == "+inf":
        return a
    return "-inf" if "-inf" in (a, b) else min(a, b)


def fork_versions(base: DataFrame, own: DataFrame, common: int, fork_when, revision: int, when="+inf") -> DataFrame:
    """Versions in force in a fork, tombstones included, before `revision` and up to `when`.

    Up to `common` the fork shows the base's versions, cut at the fork's time. Beyond, its own latest versions come first and the
    base's (at `common`) follow where the fork has not touched the event; a tombstone of the fork hides the base's version.
    """
    inherited = cut_when(latest_versions(base, min(revision, common)), least_when(when, fork_when))
    if revision <= common:
        return inherited
    mine = latest_versions(own, revision)
    inherited = inherited.join(mine.select("event_id").distinct(), "event_id", "left_anti").select(*base.columns)
    return inherited.unionByName(cut_when(mine, when).select(*base.columns))


def fork_in_force(base: DataFrame, own: DataFrame, common: int, fork_when, revision: int, when="+inf") -> DataFrame:
    return fork_versions(base, own, common, fork_when, revision, when).filter("kind <> 'annulled'")
