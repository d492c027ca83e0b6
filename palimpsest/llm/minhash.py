"""MinHash near-deduplication with BagMinHash signatures of word-shingle multisets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, hot_safe_join, odd_ids, partitions, ranked, written

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_bags(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count), sorted, of the multisets of `words` consecutive words in lower case.

    Words are what white space up to U+0020 parts. A text with fewer words (one at least) has one shingle, all of them.
    """
    data = np.frombuffer("\n".join([t.lower() for t in texts]).encode() + b"\n", np.uint8)
    with np.errstate(over="ignore"):
        gap = data <= 32
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        # Words' polynomial hashes from prefix sums, by powers of an odd number and its inverse.
        m = 0x9E3779B97F4A7C15
        n = len(data) + 1
        power = np.full(n, m, _U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n, pow(m, -1, 1 << 64), _U)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power[:-1], dtype=_U)])
        word = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
        lengths = np.array([len(t.encode()) for t in [x.lower() for x in texts]], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
        first = np.searchsorted(starts, bounds)  # words before each text
        per_text = np.diff(first)
        spare = np.full(words, 0, _U)
        padded = np.concatenate([word, spare])
        total = np.zeros(len(word), _U)
        for i in range(words):
            total = total * _U(0xD1342543DE82EF95) + padded[i : i + len(word)]
        owner = np.repeat(np.arange(len(texts)), per_text)
        place = np.arange(len(word)) - first[:-1][owner]
        whole = place + words <= per_text[owner]
        short = (per_text < words) & (per_text > 0)
        if short.any():
            for i in np.flatnonzero(short):
                at = first[i]
                h = _U(per_text[i])
                for w in word[at : at + per_text[i]]:
                    h = h * _U(0xD1342543DE82EF95) + w
                total[at] = h
                whole[at] = True
        owner, shingle = owner[whole], _mix(total[whole])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return owner[at], shingle[at], np.diff(np.append(at, len(owner)))


def bag_signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures (texts, size) of multisets; two agree in a component with their weighted Jaccard similarity.

    Weights are counts, discretised at the integers and split into the intervals [0, 1), [1, 2), [2, 4), [4, 8), ... Each
    interval of each element has a Poisson process whose rate is the interval's length; each point has a time, a signature component
    and a level in the interval, all from a hash of (element, interval, number of the point). Points at levels the weight
    does not reach are passed over, which for an interval that the weight covers in part is the hierarchical halving of the process.
    A component is the hash of its earliest point. A process stops once its time is past all of its text's components.
    """
    best = np.full(texts * size, np.inf)
    sign = np.zeros(texts * size, _U)
    with np.errstate(over="ignore", divide="ignore"):
        level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1  # intervals that the count touches
        who = np.repeat(np.arange(len(owner)), level)
        j = np.arange(len(who)) - np.repeat(np.cumsum(level) - level, level)
        low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0))
        rate = np.where(j == 0, 1, low)
        doc, weight = owner[who], count[who]
        seed = _mix(shingle[who] + j.astype(_U) * _U(0x9E3779B97F4A7C15))
        time = np.zeros(len(who))
        limit = np.full(texts, np.inf)
        step = 0
        while len(seed):
            step += 1
            a = _mix(seed + _U(step) * _U(0xA0761D6478BD642F))
            b = _mix(a ^ _U(0xE7037ED1A0B428DB))
            time = time - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            live = time < limit[doc]
            if not live.all():
                seed, time, doc, weight, low, rate, b = seed[live], time[live], doc[live], weight[live], low[live], rate[live], b[live]
                if not len(seed):
                    break
            reach = low + (b >> _U(40)).astype(np.int64) % rate < weight
            slot = doc * size + (b & _U(0xFFFFFFFF)).astype(np.int64) % size
            slot, t, h = slot[reach], time[reach], b[reach]
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            sign[slot[won]] = h[won]
            limit = best.reshape(texts, size).max(axis=1)
    return sign.reshape(texts, size)


def weighted_jaccard(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Of two multisets as sorted hashes and counts; 0 for two empty ones."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = float(np.minimum(na[i], nb[j]).sum()) if len(both) else 0.0
    total = float(na.sum() + nb.sum()) - least
    return least / total if total else 0.0


_BAG = "doc_id bigint, bag array<bigint>, n array<int>"


def _lists(owner: np.ndarray, values: np.ndarray, texts: int, kind: pa.DataType) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _parts(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches of (doc_id, text) in parts of 500 rows and about `most` bytes of text; a longer text is a part of its own."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
        lo = held = 0
        for i, n in enumerate(sizes):
            if i > lo and (i - lo == 500 or held + n > most):
                yield b.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < b.num_rows:
            yield b.slice(lo)


def _bags(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            owner, shingle, count = shingle_bags([t.as_py() or "" for t in part.column(1)], words)
            k = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(owner, shingle.view(np.int64), k, pa.int64()), _lists(owner, count.astype(np.int32), k, pa.int32())], names=["doc_id", "bag", "n"])

    return run


def _signatures(words: int, size: int, rows: int):
    """Arrow batches of (doc_id, text) to (doc_id, digest of the multiset, signature, band keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            k = part.num_rows
            owner, shingle, count = shingle_bags([t.as_py() or "" for t in part.column(1)], words)
            sign = bag_signatures(owner, shingle, count, k, size)
            full = np.diff(np.searchsorted(owner, np.arange(k + 1))) > 0
            with np.errstate(over="ignore"):
                each = [_mix(shingle * _U(c) + count.astype(_U)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                digest = [np.zeros(k, _U), np.zeros(k, _U)]
                for d, e in zip(digest, each, strict=True):
                    np.add.at(d, owner, e)
                bands = np.zeros((k, size // rows), _U)
                for r in range(rows):
                    bands = _mix(bands + sign[:, r::rows] * _U(0x9E3779B97F4A7C15) + _U(r + 1))
            m = size // rows
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(full), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                    _lists(np.repeat(np.arange(k), size), (sign & _U(0x7FFF)).astype(np.int16).ravel(), k, pa.int16()),
                    _lists(np.repeat(np.arange(k), m), bands.view(np.int64).ravel(), k, pa.int64()),
                ],
                names=["doc_id", "full", "d0", "d1", "sign", "bands"],
            )

    return run


def _likely_among(docs: DataFrame, wanted: DataFrame, words: int = 1 << 18) -> DataFrame:
    """docs without most rows whose doc_id is not in wanted(doc_id); none that is in it goes.

    A bit set of words * 64 hashed places, broadcast as a table of `words` rows at most whatever the size of `wanted`, so that few
    other texts move in the join that follows. Where the set fills up, more rows pass and that join does the rest.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(words * 64))
    word, bit = F.shiftright(spot, 6), (spot % 64).cast("int")
    held = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits"))
    return docs.join(F.broadcast(held), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def near_dedup(docs: DataFrame, words: int = 5, least: float = 0.8, size: int = 64, rows: int = 4, block: int = 512) -> DataFrame:
    """(doc_id, component_id, group_size, kept) for every row of docs(doc_id, text, ...).

    Two documents are linked when the weighted Jaccard similarity of their multisets of `words`-word shingles is `least` or more;
    component_id is the smallest doc_id that links reach, and one row of it is kept. Texts of fewer words are one shingle; empty, blank and
    null texts have none and are linked with nothing. Rows that repeat a doc_id, or have none, are documents of their own (without a
    doc_id they come last; component_id is null where no row of a component has one). Rows with equal multisets are one class from the
    start and are not compared. Very long texts are read whole, in a part of their own. Extra columns are not read; an empty table gives
    an empty result.

    1. One pass makes BagMinHash signatures of `size` components and size / rows band keys.
    2. Each band's bucket has a leader, its smallest class; all others whose signatures agree with its in half of the components are
       compared with it, on their full multisets.
    3. Links give components. Buckets that still hold several components are cut into blocks of `block` rows, and each two blocks
       meet in a task: first with signatures alone, to find the rows that agree with one of another component in half of them and meets it in no earlier band, then
       those rows with their multisets, which are compared unless they are connected by then. So every pair that shares a bucket is
       linked, connected already, or compared (a pair of similarity 0.8 has too few equal components with probability 1e-7).
    Hot leaders and buckets are spread over tasks; no task gathers a bucket.
    A pair of similarity 0.8 shares no bucket with probability (1 - 0.8^4)^16, about 0.0002.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if odd_ids(docs):
        numbered = ranked(docs, nulls_first=False)
        found = near_dedup(numbered.select(F.col("row").alias("doc_id"), "data.text"), words, least, size, rows, block)
        found = written(found.withColumnRenamed("doc_id", "row"))
        first = numbered.select(F.col("row").alias("component_id"), F.col("data.doc_id").alias("first_id"))
        first = written(first.join(found.filter("kept").select("component_id", "group_size"), "component_id"))
        found = hot_safe_join(found.drop("group_size"), first, ["component_id"], "group_size", found.count())
        return found.join(numbered.select("row", "data.doc_id"), "row").select("doc_id", F.col("first_id").alias("component_id"), "group_size", "kept")
    schema = "doc_id bigint, full boolean, d0 bigint, d1 bigint, sign array<smallint>, bands array<bigint>"
    signed = written(docs.mapInArrow(_signatures(words, size, rows), schema))
    classes = written(signed.filter("full").groupBy("d0", "d1").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("sign").alias("sign"), F.first("bands").alias("bands")))
    # Buckets with two classes or more.
    placed = classes.select("class_id", F.posexplode("bands").alias("band", "key")).withColumn("key", F.xxhash64("band", "key")).select("class_id", "key", "band")
    buckets = written(placed.groupBy("key").agg(F.min("class_id").alias("leader"), F.count("*").alias("n")).filter("n > 1"))
    n_placed = buckets.agg(F.sum("n")).first()[0] or 0
    members = written(hot_safe_join(placed, buckets, ["key"], "n", n_placed).filter("leader is not null"))
    stars = written(members.filter("class_id <> leader").select("leader", F.col("class_id").alias("member")).distinct())
    # Multisets of the classes that some bucket compares: their first documents' texts are read again.
    wanted = written(members.select(F.col("class_id").alias("doc_id")).distinct())
    texts = _likely_among(docs, wanted).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text"))
    bags = written(texts.mapInArrow(_bags(words), _BAG))
    leaders = written(stars.groupBy("leader").agg(F.count("*").alias("n")))
    n_stars = leaders.agg(F.sum("n")).first()[0] or 0
    dealt = hot_safe_join(stars, leaders, ["leader"], "n", n_stars)
    deal = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / (block // 2))).cast("int").alias("deal")
    dealt = dealt.select("leader", "member", deal)

    def meet(pairs: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
        """pairs (leader, member, deal) with the columns of both, the leader's under l_; table (_id, ...) has a row for each class."""
        heads = pairs.select("leader", "deal").distinct().join(table, F.col("leader") == F.col("_id"))
        heads = heads.select(F.col("leader").alias("_l"), F.col("deal").alias("_d"), *[F.col(x).alias(f"l_{x}") for x in names])
        both = pairs.join(table, F.col("member") == F.col("_id")).drop("_id")
        return both.join(heads, (F.col("leader") == F.col("_l")) & (F.col("deal") == F.col("_d"))).drop("_l", "_d")

    signs = classes.select(F.col("class_id").alias("_id"), "sign", "bands")
    likely = size // 2
    hopeful = meet(dealt, signs.drop("bands"), ["sign"]).filter(f"size(filter(zip_with(sign, l_sign, (x, y) -> x = y), same -> same)) >= {likely}")
    hopeful = written(hopeful.select("leader", "member", "deal"))
    pairs = meet(hopeful, bags.withColumnRenamed("doc_id", "_id"), ["bag", "n"]).select("leader", "member", "l_bag", "l_n", "bag", "n")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in b.columns[2:]]
            keep = []
            for i in range(b.num_rows):
                x = [v[o[i] : o[i + 1]] for v, o in lists]
                keep.append(weighted_jaccard(*x) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(pairs.mapInArrow(verify, "a bigint, b bigint"))
    found = written(components(links))
    # What the leaders left apart.
    named = members.join(found, members.class_id == found.node, "left").select("key", "band", "class_id", F.coalesce("component", "class_id").alias("component"))
    named = written(named)
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
    mixed = written(mixed)
    n_mixed = mixed.agg(F.sum("n")).first()[0] or 0
    rest = hot_safe_join(named, mixed, ["key"], "n", n_mixed).filter("n is not null")
    rest = written(rest)

    def blocked(rows_: DataFrame) -> DataFrame:
        """rows_ with n, the rows of their key: each block of a key meets each other in a group (key, p, q)."""
        blocks = F.ceil(F.col("n") / block).cast("int")
        out = rows_.select("key", "band", "class_id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("class_id"), blocks).cast("int").alias("own"))
        out = out.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        return out.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "band", "own", "class_id", "component")

    def candidates(key: tuple, rows_: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of one block, the rows of the other (or later ones) in another component with a signature that is likely
        enough, where this bucket is the first that the two share."""
        p, q, band = key[1], key[2], rows_["band"].iloc[0]
        comp, own, sign, bands = rows_["component"].to_numpy(), rows_["own"].to_numpy(), np.stack(rows_["sign"].to_numpy()), np.stack(rows_["bands"].to_numpy())
        place = np.arange(len(rows_))
        for i in np.flatnonzero(own == p):
            at = np.flatnonzero((comp != comp[i]) & ((own == q) if p != q else (place > i)))
            at = at[(sign[at] == sign[i]).sum(axis=1) >= likely]
            at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
            if len(at):
                yield i, at

    def flag(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        found_ = np.zeros(len(rows_), bool)
        for i, at in candidates(key, rows_):
            found_[i] = True
            found_[at] = True
        return rows_.loc[found_, ["key", "band", "class_id", "component"]]

    flagged = blocked(rest).join(signs, F.col("class_id") == F.col("_id")).drop("_id")
    # Dealt to all partitions: these are few bytes and much work, which Spark would gather in a few tasks.
    flagged = flagged.repartition(partitions(docs.sparkSession), "key", "p", "q").groupBy("key", "p", "q").applyInPandas(flag, "key bigint, band int, class_id bigint, component bigint")
    flagged = written(flagged.distinct())
    counted = written(flagged.groupBy("key").agg(F.count("*").alias("n")))
    flagged = hot_safe_join(flagged, counted, ["key"], "n", counted.agg(F.sum("n")).first()[0] or 0)
    full = bags.join(signs, F.col("doc_id") == F.col("_id")).select("_id", "bag", F.col("n").alias("counts"), "sign", "bands")
    rest = blocked(flagged).join(full, F.col("class_id") == F.col("_id")).drop("_id")

    def compare(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        rows_ = rows_.sort_values("class_id").reset_index(drop=True)
        comp, bag, n = rows_["component"].to_numpy(), rows_["bag"].to_numpy(), rows_["counts"].to_numpy()
        parent: dict = {}
        out = []

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for i, at in candidates(key, rows_):
            for j in at:
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a != b and weighted_jaccard(bag[i], n[i], bag[j], n[j]) >= least:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(comp[i]), int(comp[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rest = rest.repartition(partitions(docs.sparkSession), "key", "p", "q")
    more = written(rest.groupBy("key", "p", "q").applyInPandas(compare, "a bigint, b bigint"))
    # The new links are between components: theirs are found apart, and the two steps composed.
    steps = components(more).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    steps = written(steps.join(found.groupBy("component").agg(F.count("*").alias("n")), "component", "left").fillna(1, ["n"]))
    moved = hot_safe_join(found, steps, ["component"], "n", found.count())
    heads = steps.select(F.col("component").alias("node"), F.col("joined").alias("component")).join(found.select("node"), "node", "left_anti")
    found = moved.select("node", F.coalesce("joined", "component").alias("component")).union(heads.select("node", "component"))
    by_class = classes.select("d0", "d1", "class_id", "copies").join(found, F.col("class_id") == found.node, "left")
    by_class = written(by_class.select("d0", "d1", "copies", F.coalesce("component", "class_id").alias("component_id")))
    sizes = written(by_class.groupBy("component_id").agg(F.sum("copies").alias("group_size"), F.count("*").alias("n_classes")))
    n_classes = by_class.count()
    by_class = written(hot_safe_join(by_class, sizes, ["component_id"], "n_classes", n_classes).drop("n_classes"))
    total = by_class.agg(F.sum("copies")).first()[0] or 0
    keyed = signed.select("doc_id", "full", F.when(F.col("full"), F.col("d0")).otherwise(F.xxhash64("doc_id")).alias("d0"), F.when(F.col("full"), F.col("d1")).otherwise(F.lit(0)).alias("d1"))
    out = hot_safe_join(keyed, by_class, ["d0", "d1"], "copies", total)
    linked = F.col("full") & F.col("component_id").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", component.alias("component_id"), F.when(linked, F.col("group_size")).otherwise(F.lit(1)).cast("bigint").alias("group_size"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
