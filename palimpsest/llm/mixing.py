"""Mixing sources to target weights: blocks, multinomial counts for each output shard, permuted block indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; no source gives more than MOST times its size.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """total shared by weight, none above most * size; what is cut off is shared again by weight among the others."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: int, seed: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at `index`: a Feistel network on the next even number of bits, walked
    until the value is below n again."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(rounds):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
            mix = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
            mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mix ^ (mix >> np.uint64(32))) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def draw_counts(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) in each output shard (row): multinomial, by what each source still has to give.

    Shards take equal numbers of blocks (one apart at most). Drawing from what is left, a multivariate urn, keeps every
    shard near the weights and makes the columns add up to `blocks` exactly.
    """
    rng = np.random.Generator(np.random.Philox(seed))
    left = np.array(blocks, dtype=np.int64)
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    for s in range(shards):
        room = -(-int(left.sum()) // (shards - s))
        while room:
            drawn = np.minimum(rng.multinomial(room, left / left.sum()), left)
            out[s] += drawn
            left -= drawn
            room -= int(drawn.sum())
    return out


class Mixture:
    """A plan for docs(doc_id, text, source, ...) and the tables that follow from it.

    sizes: (doc_id, tie, source_no, size, start, source_size, target) of every row, start being the words before it in its source,
    in the order of doc_id and of tie, a hash of the text. slots: (source_no, block, pass, shard, slot), a row for each block in the mix.
    """

    def __init__(self, docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 1, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> None:
        self.spark, self.block = docs.sparkSession, block
        size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
        rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("tie"))
        sizes = prefix_sums(rows, "source", ["doc_id", "tie"], "size")
        per_source = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}  # a row for each source
        self.sources = sorted(per_source, key=lambda s: (s is None, s or ""))
        self.size = [per_source[s] for s in self.sources]
        total = sum(self.size)
        self.target = targets(self.size, [weights[i % len(weights)] for i in range(len(self.sources))], total, most)
        n = [-(-s // block) for s in self.size]
        # A short last block makes the mean block shorter: draw so many that the words, not the blocks, meet the target.
        draws = [min(int(most * b), round(t * b / s)) if s else 0 for t, b, s in zip(self.target, n, self.size, strict=True)]
        counts = draw_counts(draws, min(shards, max(1, sum(draws))), seed) if sum(draws) else np.zeros((0, len(n)), np.int64)
        first = np.cumsum(counts, axis=0) - counts
        base = np.cumsum(counts, axis=1) - counts
        plan = [(s, i, int(counts[s, i]), int(first[s, i]), int(base[s, i]), n[i], seed * 1_000_003 + i) for s in range(len(counts)) for i in range(len(n)) if counts[s, i]]
        table = [(i, s, self.size[i], self.target[i]) for i, s in enumerate(self.sources)]
        self.table = self.spark.createDataFrame(table, "source_no int, source string, source_size bigint, target double")
        on = sizes["source"].eqNullSafe(self.table["source"])
        self.sizes = sizes.join(F.broadcast(self.table), on).drop(self.table["source"])  # as many rows as sources

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, i, count, j0, at, n_blocks, key in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    for lo in range(0, count, 1 << 20):
                        j = np.arange(j0 + lo, j0 + min(count, lo + (1 << 20)), dtype=np.int64)
                        slot, turn = at + j - j0, j // n_blocks
                        index = np.empty_like(j)
                        for t in np.unique(turn):
                            index[turn == t] = permuted(j[turn == t] % n_blocks, n_blocks, key + 7919 * int(t))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(index), pa.array(turn.astype(np.int32)), pa.array(np.full(len(j), shard, np.int32)), pa.array(slot)], names=["source_no", "block", "pass", "shard", "slot"])

        schema = "shard int, source_no int, count bigint, first bigint, base bigint, n bigint, key bigint"
        made = "source_no int, block bigint, pass int, shard int, slot bigint"
        plan_table = self.spark.createDataFrame(plan, schema).repartition(partitions(self.spark))
        self.slots = plan_table.mapInArrow(slots, made)

    def pieces(self) -> DataFrame:
        """(source_no, start, block, words, skip): the documents' parts in blocks; skip: the document's words before the part.

        (source_no, start) names a document that has words.
        """
        b = self.block
        parts = self.sizes.filter("size > 0").select("source_no", "start", "size", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"))
        lo, hi = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return parts.select("source_no", "start", "block", (hi - lo).alias("words"), (lo - F.col("start")).alias("skip"))

    def taken(self) -> DataFrame:
        """(source_no, start, taken): words of each document in the mix, repeats counted."""
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        used = self.pieces().join(times.hint("merge"), ["source_no", "block"])  # Spark takes the slots for as few as the plan's rows
        return used.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))

    def parts(self) -> DataFrame:
        """(doc_id, tie, pass, parts): what each pass takes of each document, as an array of (skip, words)."""
        used = self.pieces().join(self.slots.select("source_no", "block", "pass").hint("merge"), ["source_no", "block"])
        used = used.groupBy("source_no", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("parts"))
        return used.join(self.sizes.filter("size > 0").select("source_no", "start", "doc_id", "tie", "size").hint("merge"), ["source_no", "start"])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, text, source, ...).

    Sizes are words (runs without space, tab, LF, VT, FF, CR); a null text has none, and a document without words is never taken.
    Sources go by code point, null last as a source of its own. Each source's words lie in the order of doc_id and are
    packed into blocks of 64 words; a source's number of block draws is its target over its mean block, so its words come
    within a block of the target for each pass, and as no block is drawn more than three times neither is any document. Rows that
    repeat, wholly or by doc_id, are documents of their own. Extra columns are not read. Reruns agree: everything follows
    from the rows and the seed.
    """
    mix = Mixture(docs, **options)
    rows = mix.sizes.join(mix.taken().hint("merge"), ["source_no", "start"], "left")
    taken = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass, each document cut to the words that the pass takes of it, with docs' columns.

    A document that a pass takes as a whole keeps its text as it is; of others the taken stretches of the text are joined by line
    feeds. n_chars, where it is a column, is counted anew. A document taken in several passes gives a row for each; one
    that is not taken gives none. Of rows that agree in doc_id and text one is cut for all of them. Columns may have any names; null
    sources are a source, documents without words are in no mix, an empty table gives an empty mix.
    """
    import re

    mix = Mixture(docs, **options)
    word = re.compile(WORD)

    @F.pandas_udf("string")
    def cut(text: pd.Series, parts: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for t, p, n in zip(text, parts, size, strict=True):
            if sum(x["words"] for x in p) == n:
                out.append(t)
                continue
            spans = [m.span() for m in word.finditer(t)]
            runs: list[list[int]] = []
            for x in p:
                if runs and runs[-1][1] == x["skip"]:
                    runs[-1][1] += x["words"]
                else:
                    runs.append([x["skip"], x["skip"] + x["words"]])
            out.append("\n".join(t[spans[a][0] : spans[b - 1][1]] for a, b in runs))
        return pd.Series(out)

    parts = mix.parts().select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "parts", "size")
    one = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("data"))
    one = one.dropDuplicates(["_id", "_tie"])
    rows = one.join(parts.hint("merge"), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t")))
    rows = rows.select("data", cut("data.text", "parts", "size").alias("cut"))
    made = {"text": F.col("cut"), "n_chars": F.length("cut")}
    return rows.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(f"data.`{c}`").alias(c) for c in docs.columns])


def mix_shards(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, doc_id, skip, words, text): the mix as the output shards hold it, a row for each document's part of each slot.

    A slot holds a block; in it, parts go by doc_id and, where that repeats, by a hash of the text. text is the stretch from the first to the
    last of the part's `words` words, which come after `skip` words of the document. Rows that agree in doc_id and text are cut alike.
    """
    import re

    mix = Mixture(docs, **options)
    word = re.compile(WORD)

    @F.pandas_udf("array<struct<shard int, slot bigint, skip bigint, words bigint, text string>>")
    def cut(text: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, parts, strict=True):
            spans = [m.span() for m in word.finditer(t)]
            out.append([{**x, "text": t[spans[x["skip"]][0] : spans[x["skip"] + x["words"] - 1][1]]} for x in p])
        return pd.Series(out)

    used = mix.pieces().join(mix.slots.select("source_no", "block", "shard", "slot").hint("merge"), ["source_no", "block"])
    used = used.groupBy("source_no", "start").agg(F.collect_list(F.struct("shard", "slot", "skip", "words")).alias("parts"))
    parts = used.join(mix.sizes.filter("size > 0").select("source_no", "start", "doc_id", "tie").hint("merge"), ["source_no", "start"])
    parts = parts.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "parts")
    one = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).dropDuplicates(["doc_id", "_tie"])
    rows = one.join(parts.hint("merge"), one.doc_id.eqNullSafe(parts._d) & (one._tie == parts._t))
    return rows.select("doc_id", F.explode(cut("text", "parts")).alias("p")).select("p.shard", "p.slot", "doc_id", "p.skip", "p.words", "p.text")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))
