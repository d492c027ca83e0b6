"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exceptions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents, written

#: Characters that look like Latin letters, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("авеѕіјкмнорстухԁӏɡαβεικνορτυχωøłđıſ", "abesijkmhopctyxdlgabeikvoptuxwoldis", strict=True))
SUBSTITUTES = dict(zip("0134578@$|", "oieastbasi", strict=True))
#: Weighted general terms to begin with; learning reweighs them and adds to them.
SEED = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "scum": 4.0, "loser": 3.0, "pathetic": 3.0, "worthless": 3.0, "disgusting": 3.0}
#: Phrases in which terms do not count.
EXCEPTIONS = ("scum of the pond", "pond scum", "trash can", "trash bin", "sore loser rule", "clown fish", "not stupid", "no idiot")


def _table() -> dict[int, str]:
    out = {}
    for c in map(chr, range(0x250)):
        base = unicodedata.normalize("NFKD", c.lower())
        base = "".join(x for x in base if not unicodedata.combining(x))
        out[ord(c)] = base if base.isalnum() else " "
    for start in (0x370, 0x400, 0x480, 0x500):
        for c in map(chr, range(start, start + 0x80)):
            out[ord(c)] = c.lower()
    for kind in (HOMOGLYPHS, SUBSTITUTES):
        for a, b in kind.items():
            out[ord(a)] = out[ord(a.upper() if len(a.upper()) == 1 else a)] = b
    for c in range(0xFF01, 0xFF5F):  # full-width forms
        out[c] = out[c - 0xFEE0]
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible
        out[c] = ""
    for c in (*range(0x300, 0x370),):  # combining marks
        out[c] = ""
    return out


_FOLD = _table()
_GAPS = re.compile(r"[^\w]+|_+")


def fold(text: str) -> str:
    """Lower case without accents, homoglyphs as Latin letters, digits and signs as the letters they stand for,
    invisible characters gone; words are parted by one space each, with a space at either end."""
    text = text.translate(_FOLD)
    if not text.isascii():
        text = _GAPS.sub(" ", text)
    return f" {' '.join(text.split())} "


@dataclass
class Lexicon:
    """terms: folded patterns with a leading space (word starts; with a trailing space too: whole words) and weights.

    A word's hit is its heaviest term's weight; a hit that lies in an exception phrase counts nothing. The score is a
    logistic of log(hits' weight by the length in words), `steep` and `middle` being fitted: 0.7 at `middle`.
    """

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    middle: float = math.log(0.01)
    steep: float = 4.0
    _automaton: object = field(default=None, repr=False)

    def hits(self, folded: str) -> float:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(fold(phrase), (len(fold(phrase)), None))
            self._automaton.make_automaton()
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not len(self._automaton):
            return 0.0
        for end, (n, weight) in self._automaton.iter(folded):
            start = end - n + 1
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(found.get(start, 0.0), weight)
        if spared:  # one may lie in another, so the furthest end of those begun so far counts
            spared.sort()
            at, reach = 0, 0
            for start in sorted(found):
                while at < len(spared) and spared[at][0] <= start:
                    reach = max(reach, spared[at][1])
                    at += 1
                if start < reach:
                    found[start] = 0.0
        return sum(found.values())

    def density(self, text: str | None) -> float:
        """Weight of hits for each word; long texts need as many hits for a word as short ones."""
        folded = fold(text or "")
        total = self.hits(folded)
        return total / max(8, folded.count(" ") - 1) if total else 0.0

    def score(self, density: float) -> float:
        x = self.steep * (math.log(density + 1e-6) - self.middle) + math.log(0.7 / 0.3)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _features(text: str, prefix: tuple[int, int]) -> Counter:
    """How often the text holds each word and word start, at most twice; under "" one text."""
    out = Counter()
    words = Counter(fold(text).split())
    for w, n in words.items():
        if len(w) > 2:
            out[f" {w} "] += n
            for k in range(prefix[0], min(prefix[1], len(w) - 1) + 1):
                out[f" {w[:k]}"] += n
    out = Counter({t: min(n, 2) for t, n in out.items()})  # one text that repeats itself is no evidence
    out[""] = 1
    return out


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 20_000, prefix: tuple[int, int] = (4, 9), least: float = 2.0) -> Lexicon:
    """A Lexicon from docs(doc_id, text) and labels(doc_id, toxic 0/1; others are passed over).

    `sample` bounds the labelled rows that are looked at: half of them toxic, chosen by a hash of doc_id. Terms are
    whole words and word starts of prefix[0] to prefix[1] letters that occur in the toxic texts at least once for every 250 of
    them (3 times at least); a term's weight is the log-ratio of its rates for each text between the classes, less one
    standard error, and must reach `least`. Copies of a text count once. The sample bounds what the driver holds: terms that so many of its
    texts have. With no toxic label, or no other, the seed terms and scale remain.
    """
    spark = docs.sparkSession
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = {y: min(1.0, sample / 2 / max(1, n)) for y, n in counts.items()}
    seed = Lexicon({f" {w} ": x for w, x in SEED.items()})
    if set(counts) != {0, 1}:
        return seed
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = labels.filter(hashed < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # `sample` bounds the picked labels, so they are broadcast and only the picked texts move.
    chosen = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")
    chosen = written(chosen.withColumn("same", F.xxhash64("text")).groupBy("same", "toxic").agg(F.first("text").alias("text")))

    def count(rows: DataFrame, among: frozenset | None) -> dict[str, tuple[int, int]]:
        wanted = spark.sparkContext.broadcast(among)  # terms that 1 in 250 of the sample's toxic texts have

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, keep = Counter(), wanted.value
            for b in batches:
                for t in b.column(0):
                    f = _features(t.as_py(), prefix)
                    found.update(f if keep is None else {k: f[k] for k in f.keys() & keep})
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        totals = rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        if among is None:
            least_n = max(3, 0.004 * share[1] * counts[1])
            totals = totals.filter(F.col("n") >= least_n)
        return {r["term"]: r["n"] for r in totals.collect()}

    bad = count(chosen.filter("toxic = 1"), None)
    good = count(chosen.filter("toxic = 0"), frozenset(bad) | frozenset(seed.terms) | {""})
    n_bad, n_good = bad.pop("", 0), good.pop("", 0)
    if not n_bad or not n_good:
        return seed

    def odds(t: str) -> float:
        a, b = bad.get(t, 0) + 0.5, good.get(t, 0) + 0.5
        return math.log(a / n_bad) - math.log(b / n_good) - math.sqrt(1 / a + 1 / b)

    terms: dict[str, float] = {}
    for t in sorted(bad, key=len):
        if odds(t) >= least and not any(t[:n] in terms and terms[t[:n]] >= odds(t) - 1 for n in range(2, len(t))):
            terms[t] = odds(t)
    for t, w in seed.terms.items():  # a seed term that clean texts use as much is dropped
        if t not in terms and good.get(t, 0) / n_good <= (bad.get(t, 0) + 1) / n_bad:
            terms[t] = w
    lexicon = Lexicon(terms)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.density(t.as_py()) for t in b.column(1)], pa.float64())], names=["toxic", "x"])

    seen = chosen.select(F.col("toxic").cast("int"), "text").mapInArrow(densities, "toxic int, x double").toPandas()  # at most `sample` numbers
    x, y = np.log(seen["x"].to_numpy() + 1e-6), seen["toxic"].to_numpy()
    order = np.argsort(-x, kind="stable")
    x, y = x[order], y[order]
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])  # the sample's classes count as they do in all labels
    hit, taken = np.cumsum(weight * y), np.cumsum(weight)
    f1 = 2 * hit / (taken + weight[y == 1].sum())
    f1[:-1][x[:-1] == x[1:]] = 0
    best = int(np.argmax(f1))
    below = x[best + 1] if best + 1 < len(x) else x[best] - 2
    lexicon.middle = float(x[best] - min(0.7, (x[best] - below) / 2))
    lexicon._automaton = None
    return lexicon


def score_udf(lexicon: Lexicon):
    """The score of a text column, as a pandas UDF."""
    plain = Lexicon(lexicon.terms, lexicon.exceptions, lexicon.middle, lexicon.steep)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([plain.score(plain.density(t)) for t in text], dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text, ...): the whole text's score from 0 to 1.

    Null and empty texts have no hits and score lowest. Very long texts are scored whole, their hits counting by the word. Repeated rows
    are scored each for itself; extra columns are not read; an empty table gives an empty result. One pass, no shuffle.
    """
    plain = Lexicon(lexicon.terms, lexicon.exceptions, lexicon.middle, lexicon.steep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [plain.score(plain.density(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def train_fold(spark, docs: DataFrame, sf_dir: str) -> Lexicon:
    """The lexicon learnt from the labels outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 3) != 1)
    return learn_lexicon(docs, labels)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity_scores(docs, train_fold(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
