"""Shared, skew-safe building blocks: written tables, joins, prefix sums, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.references import local_forest

#: A key is hot when it holds at least one HOT-th of all rows: there are at most HOT such keys.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset and all runs on one machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark, "_palimpsest_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="palimpsest-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._palimpsest_dir = own
    return "file://" + own


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and no lost executor takes rows with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_safe_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """left LEFT JOIN right, right having one row per key and the key's number of left rows in `size`.

    Keys that hold total/HOT rows or more are at most HOT, so they are broadcast: their rows do not move.
    All other keys meet in a shuffle, in which rows of hot keys are spread by a hash of the row that matches nothing
    (a hash, not a random number: a task that runs again deals its rows out as before).
    `right` should be a written table (it is read twice). Key columns of both sides have the same names and types.
    """
    values = [c for c in right.columns if c not in keys]
    least = max(2, -(-total // HOT))
    hot = right.filter(F.col(size) >= least)
    cold = right.filter(F.col(size) < least)
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*values).alias("_hot"))
    on = [left[k] == hot[f"_h_{k}"] for k in keys]
    first = left.join(F.broadcast(hot), on, "left").drop(*[f"_h_{k}" for k in keys])
    first = first.withColumn("_spread", F.when(F.col("_hot").isNotNull(), F.xxhash64(*left.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("bigint"))
    cold = cold.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.lit(0).cast("bigint").alias("_none"), F.struct(*values).alias("_cold"))
    on = [first[k] == cold[f"_c_{k}"] for k in keys] + [first["_spread"] == cold["_none"]]
    both = first.join(cold, on, "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return both.select(*left.columns, *[got[v].alias(v) for v in values])


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds `start` (long): the sum of `value` over earlier rows of the same group, in `order`.

    Rows are range-partitioned by (group, order) and each partition sums its own; only one total for each
    (partition, group) reaches the driver, at most partitions + groups rows. Rows are unique in (group, order).
    Groups compare by code point, null last. The result is a written table.
    """
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField("_local", LongType()), StructField("_pid", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(b.schema.names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            groups = b.column(b.schema.names.index(group)).to_pylist()
            starts = np.zeros(len(sizes), np.int64)
            at = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for lo, hi in zip(at, at[1:], strict=False):
                if groups[lo] != last:
                    last, total = groups[lo], 0
                sums = np.cumsum(sizes[lo:hi])
                starts[lo:hi] = sums - sizes[lo:hi] + total
                total += int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts), pa.array(np.full(len(sizes), pid, np.int32))], names=[*b.schema.names, "_local", "_pid"])

    keys = [F.col(group).asc_nulls_last(), *order]
    local = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
    local = written(local)
    sums = local.groupBy("_pid", group).agg(F.sum(value).alias("n")).collect()
    offsets, totals = [], {}
    for r in sorted(sums, key=lambda r: r["_pid"]):
        offsets.append((r["_pid"], r[group], totals.get(r[group], 0)))
        totals[r[group]] = totals.get(r[group], 0) + (r["n"] or 0)
    table = spark.createDataFrame(offsets, f"_p int, _g {df.schema[group].dataType.simpleString()}, _before bigint")
    on = (local["_pid"] == table["_p"]) & local[group].eqNullSafe(table["_g"])
    return local.join(F.broadcast(table), on).select(*df.columns, (F.col("_local") + F.col("_before")).alias("start"))


def odd_ids(docs: DataFrame) -> bool:
    """Whether doc_id fails to name the rows of docs: it repeats or is null somewhere."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty()


def ranked(docs: DataFrame, nulls_first: bool) -> DataFrame:
    """(row bigint, data struct of docs' columns): docs(doc_id, text, ...) numbered from 0 by doc_id, then by a hash of the text.

    Rows that agree in both are numbered in any order, once and for all.
    """
    missing = F.lit(-(1 << 63) if nulls_first else (1 << 63) - 1)
    data = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("data")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), missing).alias("id"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("at"), F.lit(0).alias("all"), F.lit(1).cast("bigint").alias("one"), data)
    return prefix_sums(rows, "all", ["id", "tie", "at"], "one").select(F.col("start").alias("row"), "data")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (a, b), the smallest node that its links reach.

    Each task first turns its own edges into stars. Then alternates the large-star and small-star steps on tables until no edge changes; the number of
    rounds grows with the logarithm of the longest path. Nothing but a count reaches the driver.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            arcs = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            arcs = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        arcs = written(arcs)
        least = written(arcs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a")))
        joined = hot_safe_join(arcs, least, ["a"], "n", arcs.count())
        if large:
            new = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        return written(new.filter("a <> b").distinct())

    e = edges.filter("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    e = written(e.mapInArrow(local_forest, "a bigint, b bigint").distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while True:
        e = star(star(e, True), False)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int):
    """crc32 of a value written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def per_batch(f: Callable[[dict], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one on dicts of columns: Arrow arrays in, arrays or lists out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f({n: b.column(i) for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))

    return run
