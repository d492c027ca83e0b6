"""References between items: dereferencing, ghosts, closures, components."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def related(references: DataFrame, states: DataFrame) -> DataFrame:
    """References (item_id, ref_id, ref_lifecycle) with the state of the item they lead to; null where it is not alive."""
    target = states.select(F.col("item_id").alias("_id"), F.col("lifecycle").alias("_life"), *[F.col(c).alias(f"ref_{c}") for c in states.columns if c not in ("item_id", "lifecycle")])
    on = (F.col("ref_id") == F.col("_id")) & (F.col("ref_lifecycle") == F.col("_life"))
    return references.join(target, on, "left").withColumn("is_ghost", F.col("_id").isNull()).drop("_id", "_life")


def reference_lifecycles(references: DataFrame, in_force: DataFrame) -> DataFrame:
    """Adds ref_lifecycle: annihilations of the referred item before the reference was made (or at its very key).

    A union of references and annihilations by referred id, and one running sum: no range join.
    """
    from pyspark.sql import Window as W

    from ..functions.keys import ORDER

    refs = references.select(F.col("ref_id").alias("_on"), *ORDER, F.lit(0).alias("_end"), F.struct(*references.columns).alias("_row"))
    kind = refs.schema["_row"].dataType
    ends = in_force.filter("kind = 'annihilation'").select(F.col("item_id").alias("_on"), *ORDER, F.lit(1).alias("_end"), F.lit(None).cast(kind).alias("_row"))
    w = W.partitionBy("_on").orderBy(*ORDER, F.col("_end").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = refs.unionByName(ends).withColumn("ref_lifecycle", F.sum("_end").over(w).cast("bigint"))
    return out.filter("_row is not null").select("_row.*", "ref_lifecycle")


def transitive_closure(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(src, dst): which nodes edges (src, dst) reach.

    There may be as many pairs as the square of the nodes, so pairs are neither shuffled nor stored. A graph of up to `most` distinct edges goes to each
    task, which closes the paths of some sources and writes their pairs. Of a larger graph a task gets whole components; only a component of more than
    `most` edges, which no task is to hold, is closed by doubling paths.
    """
    spark, kinds = edges.sparkSession, edges.select("src", "dst").schema
    kind = edges.select("src").union(edges.select("dst")).schema[0].dataType
    links = _cut(spark, edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct())
    schema = StructType([StructField(f.name, kind) for f in kinds])
    if (n := links.count()) <= most:
        graph = packed(links.withColumn("mine", F.lit(True)).toArrow())
        blocks, sent = -(-len(graph[1]) // BLOCK), spark.sparkContext.broadcast(graph)
        numbers = spark.range(0, blocks, 1, max(1, min(blocks, 1000)))
        pairs = numbers.mapInArrow(lambda batches: closed((b for batch in batches for b in batch.column(0).to_pylist()), *sent.value), schema)
    else:
        pairs = by_component(links, n, most, schema)
    return pairs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])


def by_component(links: DataFrame, n: int, most: int, schema: StructType) -> DataFrame:
    """transitive_closure of n distinct edges, a task for some components of up to `most` edges. A component of many edges goes to several tasks, each for its share of the sources."""
    spark = links.sparkSession
    named = links.select("src", "dst", F.coalesce("src", "dst").alias("node"), F.xxhash64("src", "dst").alias("edge"))
    labels = connected(named.filter("node is not null").select(F.col("node").alias("a"), F.coalesce("dst", "node").alias("b")))
    edges = _cut(spark, attached(named, labels.withColumnRenamed("item_id", "node"), "node", "edge"))
    edges = _cut(spark, attached(edges, edges.groupBy("component").agg(F.count("*").alias("n")), "component", "edge"))
    shares = F.ceil(F.col("n") / max(1, most // 32))
    held = edges.filter(F.col("n") <= most).withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    dealt = held.withColumn("mine", F.pmod(F.xxhash64("src"), "shares") == F.col("share")).repartition(-(-8 * n // most), "component", "share")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            graph = packed(pa.Table.from_batches(got))
            yield from closed(range(-(-len(graph[1]) // BLOCK)), *graph)

    pairs = dealt.select("src", "dst", "mine").mapInArrow(alone, schema).union(links.filter("src is null and dst is null"))
    large = edges.filter(F.col("n") > most).select("src", "dst")
    if not large.isEmpty():
        pairs = pairs.union(doubled(large))
    if links.filter("src is null").isEmpty() or links.filter("dst is null").isEmpty():
        return pairs
    # Only this pair may be of several components.
    return pairs.filter("src is not null or dst is not null").union(pairs.filter("src is null and dst is null").limit(1))


#: Sources that one search of a task starts from, bytes of the sets of sources that it holds, and pairs of a batch at most.
BLOCK, HELD, BATCH = 1024, 1 << 26, 1 << 19


def packed(edges: pa.Table) -> tuple[pa.Array, array, array, array]:
    """Of edges (src, dst, mine): the ids of all nodes, the numbers of the sources of `mine`, and the edges by number: those of v lead to ends[starts[v] : starts[v + 1]]."""
    src, dst = (edges.column(c).combine_chunks() for c in ("src", "dst"))
    ids = pa.concat_arrays([src, dst]).unique().drop_null()
    ids, n = ids.take(pc.sort_indices(ids)), len(ids)
    # A null equals no other: as a source it is a node that none leads to, as a destination one that leads nowhere.
    a, b = (pc.index_in(x, value_set=ids).fill_null(n + k).to_numpy() for k, x in enumerate((src, dst)))
    mine = edges.column("mine").to_numpy().astype(bool)
    numbers = (np.unique(a[mine]), np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n + 2))]), b[np.argsort(a, kind="stable")])
    return pa.concat_arrays([ids, pa.nulls(2, ids.type)]), *(array("i", x.astype(np.int32).tobytes()) for x in numbers)


def closed(blocks: Iterable[int], ids: pa.Array, sources: array, starts: array, ends: array) -> Iterator[pa.RecordBatch]:
    """The pairs (src, dst) of some blocks of sources.

    The sources that reach a node are the bits of a number, which its edges hand on in an order where no edge leads back but inside a cycle.
    """
    for b in blocks:
        block = sources[b * BLOCK : (b + 1) * BLOCK]
        order, at, parts = downstream(block, starts, ends)
        width = BLOCK
        while width > 64 and width // 8 * parts > HELD:
            width //= 2
        for first in range(0, len(block), width):
            some = block[first : first + width]
            own = {v: 1 << i for i, v in enumerate(some)}
            by, nodes, sets = [0] * (parts + 1), [], []
            for v, bit in own.items():
                by[at[v]] |= bit
            for v in reversed(order):
                if held := by[c := at[v]]:
                    back = False
                    for w in ends[starts[v] : starts[v + 1]]:
                        if (d := at[w]) == c:
                            back = True
                        else:
                            by[d] |= held
                    if back or (held := held ^ own.get(v, 0)):
                        nodes.append(v)
                        sets.append(held.to_bytes(width // 8, "little"))
                        if len(nodes) * width >= BATCH:
                            yield paired(ids, some, nodes, sets, width)
                            nodes, sets = [], []
            if nodes:
                yield paired(ids, some, nodes, sets, width)


def downstream(block: array, starts: array, ends: array) -> tuple[list[int], array, int]:
    """All nodes that a block reaches, itself included; the component (from 1) of each, which nodes on a cycle share; how many there are.

    Tarjan's search: components come after all that they lead to. The lists of the search are its own, as paths may be as long as the graph.
    """
    met, low, at = (array("i", bytes(4 * (len(starts) - 1))) for _ in range(3))
    todo, order, path, held, seen, parts = starts[:], [], [], [], 0, 0
    for root in block:
        v = root
        while not at[root]:
            if not met[v]:
                seen += 1
                met[v] = low[v] = seen
                path.append(v)
                held.append(v)
            if (i := todo[v]) < starts[v + 1]:
                todo[v] = i + 1
                w = ends[i]
                if not met[w]:
                    v = w
                elif not at[w] and met[w] < low[v]:
                    low[v] = met[w]
                continue
            path.pop()
            if low[v] == met[v]:
                parts += 1
                w = -1
                while w != v:
                    w = held.pop()
                    at[w] = parts
                    order.append(w)
            if path:
                if low[v] < low[path[-1]]:
                    low[path[-1]] = low[v]
                v = path[-1]
    return order, at, parts


def paired(ids: pa.Array, block: array, nodes: list[int], sets: list[bytes], width: int) -> pa.RecordBatch:
    """Nodes and the sets of sources that reach them, as pairs."""
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(sets), np.uint8), bitorder="little").view(bool))
    src, dst = (ids.take(pa.array(x, pa.int32())) for x in (block, nodes))
    return pa.RecordBatch.from_arrays([src.take(pa.array(bits & (width - 1))), dst.take(pa.array(bits >> (width.bit_length() - 1)))], names=["src", "dst"])


def doubled(edges: DataFrame) -> DataFrame:
    """transitive_closure by doubling paths: log2(longest shortest path) rounds of one equi-join.

    A pair that is k + 1 to 2k steps apart has a node at exactly k steps on a shortest path, so only pairs at that distance are
    prolonged: a pair is made about as often as its source has nodes at k steps, not once for each node between.
    """
    spark = edges.sparkSession
    reach = edges.select("src", "dst").distinct().withColumn("n", F.lit(1).cast("bigint"))
    k, before, reached = 1, -1, 0
    while reached != before:
        before = reached
        a, b = reach.filter(F.col("n") == k).alias("a"), reach.alias("b")
        more = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"), (F.col("a.n") + F.col("b.n")).alias("n"))
        reach = _cut(spark, reach.union(more).groupBy("src", "dst").agg(F.min("n").alias("n")))
        reached = reach.count()
        k *= 2
    return reach.select("src", "dst")


def local_forest(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of a task as stars (node, smallest node it reaches here), `most` nodes at a time."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > most:
            yield stars(kind)
            parent.clear()
    if parent:
        yield stars(kind)


def connected(edges: DataFrame) -> DataFrame:
    """(item_id, component): the smallest id that edges (a, b) connect each node with; ids may be of any type that has an order.

    Each task first turns its own edges into stars, so what is shuffled is at most a row for each node and task. Then rounds of the neighbours'
    smallest label and of the label's own label, until none changes.
    """
    spark = edges.sparkSession
    edges = edges.select("a", F.col("b").cast(edges.schema["a"].dataType).alias("b"))
    lone = edges.filter("a = b").select("a").distinct()
    stars = edges.filter("a <> b").mapInArrow(local_forest, edges.schema)
    both = _cut(spark, stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _cut(spark, both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")))
    while True:
        near = attached(both, labels.withColumnRenamed("a", "b"), "b", "a").groupBy("a").agg(F.min("component").alias("c"))
        nearer = _cut(spark, labels.join(near, "a").select("a", F.col("component").alias("old"), F.least("component", "c").alias("component")))
        jump = nearer.select(F.col("a").alias("component"), F.col("component").alias("c"))
        jumped = _cut(spark, attached(nearer, jump, "component", "a").select("a", "old", F.least("component", "c").alias("component")))
        labels = jumped.select("a", "component")
        if jumped.filter("component <> old").isEmpty():
            alone = lone.join(labels, "a", "left_anti").select("a", F.col("a").alias("component"))
            return labels.union(alone).withColumnRenamed("a", "item_id")


def attached(rows: DataFrame, side: DataFrame, key: str, by: str, parts: int = 64) -> DataFrame:
    """rows joined by key with side, which has one row for each key; the rows of a key are dealt over parts by a hash of `by`."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)))
    sides = dealt.select(key, "_part").distinct().join(side, key)
    # Dealt out by name: where Spark broadcasts dealt, the joined rows stay where sides are, which else lie by key alone.
    return dealt.repartition(key, "_part").join(sides.repartition(key, "_part"), [key, "_part"]).drop("_part")


def _cut(spark, df: DataFrame) -> DataFrame:
    """df with its lineage cut, by a checkpoint in the shared folder."""
    from ..sources.tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return df.checkpoint()
