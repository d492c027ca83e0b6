"""Event logs as tables: schemas, a Parquet store with compare-and-append commits, readers of the test tables."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_LOG = (
    "world_id string, revision int, tb int, event_id string, kind string, when_rank tinyint, when_ts timestamp_ntz, intra int, "
    "item_id string, item_class string, method string, args array<struct<lit: string, ref: struct<item_id: string, item_class: string>>>"
)
REVISION = "world_id string, revision int, as_of timestamp_ntz"


class ConcurrentRevision(RuntimeError):
    """Another booking took the revision number first; nothing was written."""


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that spark.checkpoint.dir names; our own only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


class ParquetStore:
    """An append-only store under one folder, on a file system whose renames are atomic and refuse a name that is taken (HDFS; a local one
    for a single writer). Object stores have no such rename.

    A revision's rows are written to a folder of their own; the revision exists once its commit file, written whole under another name, is
    renamed, which the file system does for one writer only. Commit files never change, so each is read once. Readers see the folders of committed revisions, so a reader never sees half a booking.
    log/ is partitioned by world and by revision, which prunes the cut by revision to whole folders.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._p("commits"))
        self.read: dict[str, dict] = {}

    def _p(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def commits(self, world: str) -> list[dict]:
        """Commits of a world in the order of revisions: revision, as_of, folder."""
        here = self._p("commits", world)
        if not self.fs.exists(here):
            return []
        out = []
        for status in self.fs.listStatus(here):
            name = f"{world}/{status.getPath().getName()}"
            if name not in self.read:
                stream = self.fs.open(status.getPath())
                self.read[name] = json.loads(bytes(stream.readAllBytes()).decode())
                stream.close()
            out.append(self.read[name])
        return sorted(out, key=lambda c: c["revision"])

    def append(self, world: str, revision: int, as_of: str, rows: DataFrame, tag: str | None = None) -> None:
        """Books rows as `revision`, if no one else has. `tag` names the booking, for those that may be tried again."""
        folder = f"log/{world}/{revision:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        text = json.dumps({"revision": revision, "as_of": as_of, "folder": folder, "tag": tag}).encode()
        pending, commit = self._p("pending", uuid.uuid4().hex), self._p("commits", world, f"{revision:010d}.json")
        out = self.fs.create(pending, False)
        out.write(bytearray(text))
        out.close()
        self.fs.mkdirs(commit.getParent())
        try:
            self._rename(pending, commit)
        except Py4JJavaError as failed:
            self.fs.delete(pending, False)
            if "AlreadyExists" not in failed.java_exception.getClass().getName():
                raise
            self.fs.delete(self._p(folder), True)
            raise ConcurrentRevision(f"revision {revision} of {world} exists") from failed

    def _rename(self, a, b) -> None:
        """Unlike FileSystem.rename, FileContext's fails where b exists, on every file system."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(a, b, options)

    def log(self, world: str, before: int | None = None) -> DataFrame:
        folders = [f"{self.path}/{c['folder']}" for c in self.commits(world) if before is None or c["revision"] < before]
        if not folders:
            return self.spark.createDataFrame([], EVENT_LOG)
        return self.spark.read.schema(EVENT_LOG).parquet(*folders)


class MemoryStore:
    """The same, held by the session; for tests and what-if work."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.booked = spark, {}

    def commits(self, world: str) -> list[dict]:
        return [{"revision": r, "as_of": a, "tag": t} for r, a, _, t in self.booked.get(world, [])]

    def append(self, world: str, revision: int, as_of: str, rows: DataFrame, tag: str | None = None) -> None:
        mine = self.booked.setdefault(world, [])
        if len(mine) and mine[-1][0] >= revision:
            raise ConcurrentRevision(f"revision {revision} of {world} exists")
        mine.append((revision, as_of, [tuple(r) for r in rows.collect()], tag))

    def log(self, world: str, before: int | None = None) -> DataFrame:
        rows = [x for r, _, booked, _ in self.booked.get(world, []) if before is None or r < before for x in booked]
        return self.spark.createDataFrame(rows, EVENT_LOG)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A bitemporal log derived from the test events: corrections, annulments, annihilations, measurements, back-dating.
DERIVED = {
    "seq": "event_id",
    "revision": "CAST(floor(event_id/10) AS INT)",
    "tb": "CAST(event_id%10 AS INT)",
    "event_key": "CASE WHEN event_id%10=7 AND event_id>=20 THEN event_id-17 ELSE event_id END",
    "kind": "CASE WHEN event_id%20=7 THEN 'annulled' WHEN event_type='error' AND event_id%4=0 THEN 'annihilation' WHEN event_id%3=0 THEN 'measurement' ELSE 'change' END",
    "item_id": "user_id",
    "item_class": "CASE WHEN user_id%4=0 THEN CASE WHEN event_id%5=0 THEN 'Premium' ELSE 'Account' END WHEN user_id%4=1 THEN CASE WHEN event_id%2=0 THEN 'Package' ELSE 'Account' END WHEN user_id%4=2 THEN CASE WHEN event_id%11=0 THEN 'Entity' ELSE 'Package' END ELSE CASE WHEN event_id%17=0 THEN 'Entity' WHEN event_id%2=0 THEN 'Account' ELSE 'Package' END END",
    "method": "event_type",
    "value": "value",
    "ref_id": "CASE WHEN event_type='purchase' THEN user_id+1+event_id%3 END",
    "when_ts": "CASE WHEN event_id%3=1 THEN ts - (event_id%7) * INTERVAL '1' HOUR ELSE ts END",
}
DERIVED_TYPES = {"Entity": None, "Account": "Entity", "Premium": "Account", "Package": "Entity"}


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log with the kernel's columns; when_rank and intra are constants."""
    rows = table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in DERIVED.items()])
    rows = rows.withColumnRenamed("event_key", "event_id")
    return rows.withColumn("when_rank", F.lit(0)).withColumn("intra", F.lit(0))
