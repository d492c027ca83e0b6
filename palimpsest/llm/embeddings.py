"""Embedding near-deduplication: cross-polytope hashing after Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_safe_join, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, by butterflies; the row length is a power of two."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def cross_polytope(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Buckets (vectors, tables, 1 + probes): each vector's own bucket, then the next likely ones.

    A hash is the nearest of the 2d signed unit vectors after three rounds of random signs and Hadamard rotation; a bucket
    is `hashes` of them. A probe swaps one hash for the runner-up; those with the smallest loss of height come first.
    """
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    if (2 * d) ** hashes >= 1 << 31:
        raise ValueError("buckets of vectors as long as these need fewer hashes")
    rng = np.random.default_rng(seed)
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    out = np.empty((n, tables, 1 + probes), np.int32)
    row = np.arange(n)
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            height = np.abs(y)
            a = height.argmax(axis=1)
            top = height[row, a].copy()
            height[row, a] = -1
            b = height.argmax(axis=1)
            first.append(2 * a + (y[row, a] < 0))
            second.append(2 * b + (y[row, b] < 0))
            loss.append(top - height[row, b])
        code = np.zeros(n, np.int64)
        for a in first:
            code = code * (2 * d) + a
        out[:, t, 0] = code
        order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
        for p in range(probes):
            swap = order[:, p]
            code = np.zeros(n, np.int64)
            for k in range(hashes):
                code = code * (2 * d) + np.where(swap == k, second[k], first[k])
            out[:, t, 1 + p] = code
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Batches sorted by their first `keys` columns as (columns, first row of each group), every group whole.

    A list column x comes as x, its values in a row, and x_at, where each row's begin, with the end of the last.
    """

    def columns(table: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name, c in zip(table.schema.names, table.columns, strict=True):
            if pa.types.is_list(c.type):
                at = c.offsets.to_numpy().astype(np.int64)
                out[name], out[f"{name}_at"] = c.flatten().to_numpy(zero_copy_only=False), at - at[0]
            else:
                out[name] = c.to_numpy(zero_copy_only=False)
        return out

    def firsts(table: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in table.columns[:keys]:
            x = c.to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        held = pa.concat_batches([held, b]) if held is not None else b
        starts = firsts(held)
        if len(starts) > 1:
            yield columns(held.slice(0, starts[-1])), starts[:-1]
            held = held.slice(starts[-1])
    if held is not None:
        yield columns(held), np.zeros(1, np.int64)


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the first row that the links (a, b) reach from it."""
    first = np.arange(n)
    while True:
        low = np.minimum(first[a], first[b])
        new = first.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def units(x: np.ndarray) -> np.ndarray:
    """Vectors along the last axis, scaled to length 1 in double precision."""
    x = x.astype(np.float64) + 0.0
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def count_links(rows: dict[str, np.ndarray], starts: np.ndarray, least: float, wide: int, most: int = 2_000_000) -> pa.RecordBatch:
    """(no, n, null): a row's links that are counted here; (no, null, other): what connects the linked rows.

    Groups of one size are multiplied together, `most` products at a time. A pair is counted where it meets first: in the first
    table, and there in the own bucket of the one with the smaller number if each looks into the other's.
    """
    no, own, tab, mine, copies = rows["no"], rows["own"].astype(bool), rows["tab"], rows["mine"], rows["copies"]
    sizes = np.diff(np.append(starts, len(no)))
    dims = np.diff(rows["vector_at"])[starts]
    code = rows["buckets"].reshape(len(no), -1, wide)
    links, a_all, b_all = np.zeros(len(no), np.int64), [], []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        for lo in range(0, len(a), 20_000):
            x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
            cx, cy, t = code[x], code[y], tab[x]
            x_sees, y_sees = (cx == cy[:, :, :1]).any(axis=2), (cy == cx[:, :, :1]).any(axis=2)
            at = np.arange(len(x))
            both = x_sees[at, t] & y_sees[at, t]
            here = np.where(no[x] < no[y], own[x], own[y])
            earlier = ((x_sees | y_sees) & (np.arange(code.shape[1]) < t[:, None])).any(axis=1)
            good = (~both | here) & ~earlier
            x, y = x[good], y[good]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            a_all.append(x)
            b_all.append(y)

    for n, d in set(zip(sizes.tolist(), dims.tolist(), strict=True)):
        if n < 2:
            continue
        group = starts[(sizes == n) & (dims == d)]
        each = max(1, most // (n * max(n, d)))
        for lo in range(0, len(group), each):
            at = group[lo : lo + each, None] + np.arange(n)
            u = units(rows["vector"][rows["vector_at"][at][:, :, None] + np.arange(d)])
            near = np.matmul(u, u.transpose(0, 2, 1)) >= least
            near &= own[at][:, :, None] | own[at][:, None, :]
            # Two blocks' rows meet across; those of one block meet in its own group.
            apart = (rows["p"] != rows["q"])[at[:, 0]][:, None, None]
            near &= ~apart | (mine[at][:, :, None] != mine[at][:, None, :])
            g, i, j = np.nonzero(np.triu(near, 1))
            take(at[g, i], at[g, j])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
    first = _stars(a, b, len(no))
    some, tied = np.flatnonzero(links), np.flatnonzero(first != np.arange(len(no)))
    gap_n, gap_other = [None] * len(tied), [None] * len(some)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([no[some], no[tied]])),
            pa.array([*links[some].tolist(), *gap_n], pa.int64()),
            pa.array([*gap_other, *no[first[tied]].tolist()], pa.int64()),
        ],
        names=["no", "n", "other"],
    )


def near_vectors(vectors: DataFrame, least: float = 0.93, tables: int = 12, hashes: int = 2, probes: int = 2, block: int = 512, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors of one label (not null) are linked when their cosine, in double precision, is `least` or more. A vector that is
    null, empty, zero or has null or non-finite components is linked with nothing, nor are vectors of different lengths. n_links counts the other vectors linked
    directly, component_id is the smallest vec_id that links reach. Extra columns are not read; rows that repeat a
    vec_id are vectors of their own that share a number.

    1. Equal vectors of a label are one class, which counts as many links as it has rows.
    2. Every class goes to its own bucket in each table and looks into `probes` more (probes <= hashes). Only ids are dealt out; buckets
       without two classes end here, and classes left in none never move their vectors.
    3. Each bucket is cut into blocks of about `block` rows, and each two blocks meet in one group, which is multiplied; a task takes
       its many small groups together. Vectors travel as they are given and are scaled in double precision where they meet. A pair is
       counted in the first table that brings it together, found from both sides' bucket numbers, so no list of pairs is made: a
       task gives a number for each row and the links that connect it.
    """

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            label = b.column(2)
            keys, buckets = [None] * b.num_rows, [None] * b.num_rows
            by_dim: dict[int, list] = {}
            for i, v in enumerate(b.column(1)):
                if not v.is_valid or not label[i].is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    keys[i] = hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest()
                    by_dim.setdefault(len(x), []).append((i, x))
            for group in by_dim.values():
                codes = cross_polytope(units(np.stack([x for _, x in group])), tables, hashes, probes, seed).reshape(len(group), -1)
                for (i, _), c in zip(group, codes, strict=True):
                    buckets[i] = c
            yield pa.RecordBatch.from_arrays([b.column(0), label, pa.array(keys, pa.binary()), b.column(1), pa.array(buckets, pa.list_(pa.int32()))], names=["vec_id", "label", "key", "vector", "buckets"])

    kind, given = vectors.schema["label"].dataType.simpleString(), vectors.schema["embedding"].dataType.simpleString()
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    ready = vectors.mapInArrow(prepare, f"vec_id bigint, label {kind}, key binary, vector {given}, buckets array<int>")
    ready = written(ready)
    classes = ready.filter("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("buckets").alias("buckets"))
    # Class numbers are their own: vec_id may repeat.
    classes = written(classes.withColumn("no", F.monotonically_increasing_id()).withColumn("space", F.xxhash64("label", F.size("vector"))))
    wide = 1 + probes
    placed = classes.select("no", "space", F.posexplode("buckets").alias("at", "code"))
    placed = placed.select("no", F.xxhash64("space", F.floor(F.col("at") / wide), "code").alias("bucket"), F.floor(F.col("at") / wide).cast("int").alias("tab"), (F.col("at") % wide == 0).alias("own"))
    placed = placed.groupBy("bucket", "tab", "no").agg(F.max("own").alias("own"))
    placed = written(placed)
    counts = written(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 and any_own").drop("any_own"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = hot_safe_join(placed, counts, ["bucket"], "n", total).filter("n is not null")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.select("bucket", "tab", "no", "own", blocks.alias("blocks"), F.pmod(F.xxhash64("no"), blocks).cast("int").alias("mine"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("bucket", "tab", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "no", "own")
    rows = rows.join(classes.select(F.col("no").alias("_no"), "space", "copies", "vector", "buckets"), F.col("no") == F.col("_no")).drop("_no")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, starts in whole_groups(batches, 5):
            yield count_links(rows_, starts, least, wide)

    order = ["bucket", "tab", "p", "q", "space"]
    dealt = rows.select(*order, "mine", "no", "own", "copies", "vector", "buckets").repartition("bucket", "tab", "p", "q").sortWithinPartitions(*order, "no")
    met = written(dealt.mapInArrow(compare, "no bigint, n bigint, other bigint"))
    links = met.filter("other is null").groupBy(F.col("no").alias("l_no")).agg(F.sum("n").alias("linked"))
    found = components(met.filter("other is not null").select(F.col("no").alias("a"), F.col("other").alias("b")))
    known = classes.select("label", "key", "no", "class_id", "copies").join(links, F.col("no") == F.col("l_no"), "left")
    known = known.join(found, F.col("no") == F.col("node"), "left").withColumn("component", F.coalesce("component", "no"))
    known = written(known.select("label", "key", "class_id", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"))
    named = written(known.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")))
    facts = known.agg(F.count("*"), F.sum("copies")).first()
    known = written(hot_safe_join(known, named, ["component"], "n", facts[0]).select("label", "key", "copies", "n_links", "component_id"))
    out = hot_safe_join(ready.select("vec_id", "label", "key"), known, ["label", "key"], "copies", facts[1] or 0)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
