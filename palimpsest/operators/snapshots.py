"""A snapshot store: item states recorded at keys, in store revisions; what counts is each key's latest recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .typing import of_type


class SnapshotStore:
    """snapshot(item_id, item_class, key, store_revision, state; null state: annihilated) and time_revision(key, store_revision).

    Both only grow. `record` stages the states of one key, `annul` records nothing for a key, and so retracts what it had;
    `build` makes the next store revision; the old store stays valid.
    """

    def __init__(self, snapshot: DataFrame, time_revision: DataFrame, revision: int = 0, upto=None) -> None:
        self.snapshot, self.time_revision, self.revision, self.upto = snapshot, time_revision, revision, upto
        self._staged: list[tuple] = []

    def open_revision(self) -> SnapshotStore:
        return SnapshotStore(self.snapshot, self.time_revision, self.revision, self.upto)

    def record(self, key, states: dict) -> SnapshotStore:
        """states: {(item_id, item_class): state or None}. A key may be recorded once in a revision."""
        if any(k == key for k, _ in self._staged):
            raise ValueError(f"{key} is recorded already")
        self._staged.append((key, states))
        return self

    def annul(self, key) -> SnapshotStore:
        return self.record(key, {})

    def build(self) -> SnapshotStore:
        spark, r = self.snapshot.sparkSession, self.revision + 1
        times = spark.createDataFrame([(k, r) for k, _ in self._staged], self.time_revision.schema)
        rows = [(i, c, k, r, s) for k, states in self._staged for (i, c), s in states.items()]
        blobs = spark.createDataFrame(rows, self.snapshot.schema)
        return SnapshotStore(self.snapshot.union(blobs), self.time_revision.union(times), r, self.upto)

    def retain_up_to(self, when) -> SnapshotStore:
        return SnapshotStore(self.snapshot, self.time_revision, self.revision, when if self.upto is None else min(when, self.upto))

    def time_slice(self, when, inclusive: bool = True) -> DataFrame:
        if self.upto is not None and when > self.upto:
            when, inclusive = self.upto, True
        return as_of(self.snapshot, self.time_revision, when, inclusive)


def as_of(snapshot: DataFrame, time_revision: DataFrame, when, inclusive: bool = True) -> DataFrame:
    """(item_id, item_class, state) alive at `when`: the latest valid snapshot of each, annihilated ones left out.

    A snapshot is valid if its store revision is the last one recorded for its key.
    """
    key = F.col("key")
    upto = key <= when if inclusive else key < when
    last = time_revision.filter(upto).groupBy("key").agg(F.max("store_revision").alias("store_revision"))
    valid = snapshot.filter(upto).join(last, ["key", "store_revision"])
    found = valid.groupBy("item_id", "item_class").agg(F.max_by(F.struct("state"), "key").alias("s"))
    return found.select("item_id", "item_class", "s.state").filter("state is not null")


def of_class(slice_: DataFrame, closure: DataFrame, wanted: str, item_id=None) -> DataFrame:
    """Items of a slice (item_id, item_class, state) whose class is `wanted` or a subtype, all or those of one id."""
    return of_type(slice_ if item_id is None else slice_.filter(F.col("item_id") == item_id), closure, wanted)


def not_unique(slice_: DataFrame, closure: DataFrame, wanted: str) -> DataFrame:
    """(item_id, n): ids by which `wanted` finds more than one item; a query for a single item must refuse these."""
    return of_class(slice_, closure, wanted).groupBy("item_id").agg(F.count("*").alias("n")).filter("n > 1")


def _seen(rows: DataFrame, path: list[tuple]) -> DataFrame:
    """rows(lineage, key, store_revision, ...) that a path of lineages shows, with `place`, the place of their lineage in it."""
    place = F.lit(None).cast("int")
    for i, (lineage, revision, upto) in enumerate(path):
        here = F.col("lineage") == lineage
        if revision is not None:
            here &= F.col("store_revision") <= revision
        if upto is not None:
            here &= F.col("key") <= upto
        place = F.when(here, i).otherwise(place)
    return rows.withColumn("place", place).filter("place is not null")


def lineage_as_of(snapshot: DataFrame, time_revision: DataFrame, path: list[tuple], when, inclusive: bool = True) -> DataFrame:
    """(item_id, item_class, state) alive at `when` in a forked store.

    path: (lineage, last store revision or None, last key or None) of each store that it descends from, the oldest first, and its own. A key's
    valid recording is the last one of the newest lineage that recorded it; of an item's valid snapshots the latest counts.
    """
    upto = F.col("key") <= when if inclusive else F.col("key") < when
    last = _seen(time_revision, path).filter(upto).groupBy("key").agg(F.max(F.struct("place", "store_revision")).alias("v"))
    last = last.select("key", "v.place", "v.store_revision")
    valid = _seen(snapshot, path).filter(upto).join(last, ["key", "place", "store_revision"])
    found = valid.groupBy("item_id", "item_class").agg(F.max_by(F.struct("state"), "key").alias("s"))
    return found.select("item_id", "item_class", "s.state").filter("state is not null")


class StoredSnapshots:
    """Snapshots in Parquet tables under one folder, partitioned by lineage, which a fork shares with its base.

    SnapshotStore's rules hold within a lineage. A fork sees its base at the revision and up to the key that it was made at, and lays its own
    recordings over it; neither sees what the other records later.
    """

    SNAPSHOT = "item_id string, item_class string, key bigint, store_revision int, state string, lineage string"
    TIMES = "key bigint, store_revision int, lineage string"

    def __init__(self, spark, folder: str, path: tuple = (("main", None, None),), revision: int = 0) -> None:
        self.spark, self.folder, self.path, self.revision = spark, folder.rstrip("/"), path, revision

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def build(self, snapshots: DataFrame, keys: DataFrame) -> StoredSnapshots:
        """The store after one more revision: it records `snapshots`(item_id, item_class, key, state) for `keys`(key), and retracts
        what a key had. Keys are written last, so a recording that fails half-way shows nothing."""
        lineage, r = self.path[-1][0], self.revision + 1
        if (self._table("times", self.TIMES).filter(F.col("lineage") == lineage).agg(F.max("store_revision")).first()[0] or 0) >= r:
            raise ValueError(f"revision {r} of {lineage} is recorded; an older store can only be forked")
        mine = [F.lit(r).alias("store_revision"), F.lit(lineage).alias("lineage")]
        snapshots.select("item_id", "item_class", F.col("key").cast("bigint"), "state", *mine).write.mode("append").partitionBy("lineage").parquet(f"{self.folder}/snapshot")
        keys.select(F.col("key").cast("bigint"), *mine).distinct().write.mode("append").partitionBy("lineage").parquet(f"{self.folder}/times")
        return StoredSnapshots(self.spark, self.folder, (*self.path[:-1], (lineage, r, None)), r)

    def fork(self, name: str, upto=None) -> StoredSnapshots:
        """A store of its own over what this one holds now, up to the key `upto`."""
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        seen = [(x, self.revision if i == len(self.path) - 1 else r, least(u, upto)) for i, (x, r, u) in enumerate(self.path)]
        return StoredSnapshots(self.spark, self.folder, (*seen, (name, 0, None)), 0)

    def time_slice(self, when, inclusive: bool = True) -> DataFrame:
        path = [(x, self.revision if i == len(self.path) - 1 else r, u) for i, (x, r, u) in enumerate(self.path)]
        return lineage_as_of(self._table("snapshot", self.SNAPSHOT), self._table("times", self.TIMES), path, when, inclusive)
