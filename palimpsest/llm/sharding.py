"""Sharding along a Hilbert curve: quantised metadata, one order, runs of equal length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, hot_safe_join, prefix_sums, written


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with `bits` bits in each of axes.shape[1] dimensions.

    Skilling's transform (2004), over whole arrays: undo the excess work from the top bit down, Gray-encode,
    then interleave. dimensions * bits is 62 at most.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            is_set = (x[i] & bit) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flips
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve(columns: list[Column], bits: int) -> Column:
    """hilbert_index of int columns, each from 0 to 2**bits - 1."""

    @F.pandas_udf("bigint")
    def index(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(points.to_numpy(dtype=np.int64), bits))

    return index(F.struct(*[c.cast("int").alias(f"d{i}") for i, c in enumerate(columns)]))


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 10) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row of docs(doc_id, text, lang, source).

    Law `rows`: shard sizes in rows differ by one at most. Dimensions of the curve are source, lang (both by a
    hash's top bits; null is a value of its own) and the logarithm of the size. All rows with equal texts take
    the metadata of the one with the smallest doc_id, so they lie side by side and only a cut can part them.
    A shard is a run of the curve; a slot is the row's place in it. Files written by shard, with slots in order, have
    narrow ranges in every dimension. Rows that repeat a doc_id are told apart by their metadata; rows that
    repeat as a whole take neighbouring slots in any order. Extra columns are not read.

    No global sort or single-task window: rows are range-partitioned, each partition counts its own, and one count per
    partition reaches the driver.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"), "source", "lang",
    )
    groups = written(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "lang")).alias("first"), F.count("*").alias("n")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    rows = hot_safe_join(rows, groups, ["digest"], "n", total)
    top = (1 << bits) - 1
    category = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(c, F.lit("")), c.isNull()), 64 - bits)
    level = F.least(F.lit(top), F.floor(F.log2(F.col("size")) * (top / 40)))
    rows = rows.select("doc_id", "size", "text_crc32", "digest", curve([category(F.col("first.source")), category(F.col("first.lang")), level], bits).alias("curve"), F.lit(1).cast("bigint").alias("one"), F.lit(0).alias("all"), F.xxhash64("source", "lang").alias("tie"))
    rows = prefix_sums(rows, "all", ["curve", "digest", "doc_id", "tie"], "one")
    # Shard s holds ranks ceil(s * n / k) to ceil((s + 1) * n / k) - 1.
    n = max(total, 1)
    rows = rows.withColumn("shard", F.expr(f"cast(start * {shards} div {n} as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
