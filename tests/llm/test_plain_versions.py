"""Matching, pooling and sharding against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from palimpsest.llm import language_id, sharding, toxicity


def plain_hits(text, terms, exceptions):
    total = 0.0
    spared = [m.span(1) for p in exceptions for m in re.finditer(f"(?=({re.escape(toxicity.fold(p))}))", text)]
    for at in range(len(text)):
        heaviest = max((w for t, w in terms.items() if text.startswith(t, at)), default=0.0)
        total += 0.0 if any(a <= at < b - 1 for a, b in spared) else heaviest
    return total


def test_hits_are_those_of_a_plain_search():
    rng = random.Random(6)
    terms = {" scum ": 3.0, " scu": 1.0, " idi": 2.0, " idiot ": 4.0, " sore": 0.5, " pond scum": 2.5}
    exceptions = ("pond scum", "scum of the pond", "the old pond scum is sore", "old pond", "is", "idiot of the old a", "of the")
    words = ["scum", "5cum", "idiot", "idiotic", "pond", "of", "the", "old", "is", "sore", "Sсum", "a", "the old pond scum is sore", "idiot of the old a"]
    lexicon = toxicity.Lexicon(terms, exceptions)
    for n in (0, 1, 3, 8, 30, 30, 30, 2000):
        for _ in range(1 if n == 2000 else 60):
            folded = toxicity.fold(rng.choice([" ", "-"]).join(rng.choices(words, k=n)))
            assert lexicon.hits(folded) == pytest.approx(plain_hits(folded, terms, exceptions))


def test_toxicity_of_repeated_and_long_rows(spark):
    lexicon = toxicity.Lexicon({" idiot ": 4.0})
    long_ = "idiot " + "word " * 200_000
    rows = [(1, "idiot", 9), (1, "idiot", 9), (None, "idiot", 9), (2, long_, 9), (3, "\x00 ퟿", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted int")
    got = toxicity.toxicity_scores(docs, lexicon).collect()
    plain = lambda t: lexicon.score(plain_hits(toxicity.fold(t), lexicon.terms, ()) / max(8, len(toxicity.fold(t).split())))
    want = [(i, plain(t), int(plain(t) >= 0.7)) for i, t, _ in rows if t is not long_] + [(2, lexicon.score(4 / 200_001), 0)]
    key = lambda r: (r[0] or 0, r[1])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1]) and g[2] == w[2]


def plain_states(gru, data, d):
    h, emb, u = gru.hidden, gru.w[f"emb_{d}"], gru.w[f"u_{d}"]
    logistic = lambda x: 1 / (1 + math.exp(-x))
    s, out = [0.0] * h, {}
    for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
        e = emb[data[t]]
        g = [sum(s[i] * u[i, k] for i in range(h)) for k in range(3 * h)]
        r = [logistic(e[k] + g[k]) for k in range(h)]
        z = [logistic(e[h + k] + g[h + k]) for k in range(h)]
        n = [math.tanh(e[2 * h + k] + r[k] * g[2 * h + k]) for k in range(h)]
        out[t] = s = [(1 - z[k]) * n[k] + z[k] * s[k] for k in range(h)]
    return out


def test_pooled_probabilities_are_those_of_a_plain_loop():
    gru, stretch = language_id.ByteGru(["a", "b", "c"], hidden=3, seed=4), 8
    texts = [b"", b"x", b"plain wo", b"plain words", "ñé漢😀 and more than two stretches".encode()]
    got = gru.pooled(texts, stretch=stretch, columns=3)
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for lo in range(0, len(text), stretch):
            # The last stretch is padded at its end: what reads backwards starts in the padding.
            part = list(text[lo : lo + stretch])
            padded = part + [256] * (stretch - len(part))
            f, b = plain_states(gru, padded, "f"), plain_states(gru, padded, "b")
            for t in range(len(part)):
                o = [sum(x * gru.w["out"][i, k] for i, x in enumerate(f[t] + b[t])) + gru.w["bias"][k] for k in range(3)]
                e = [math.exp(x) for x in o]
                total += [x / sum(e) for x in e]
        assert row == pytest.approx(total / max(1, len(text)), abs=1e-4)


def test_shards_are_runs_of_the_order_by_curve(spark):
    rng = random.Random(9)
    texts = [None, "", "same", "é" * 9, *[" ".join(rng.choices(["a", "bb", "ccc"], k=rng.randint(1, 400))) for _ in range(60)], "long " * 50_000]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "en", "fr"]), rng.choice([None, "web", "book"])) for i in rng.sample(range(500), 130)]
    got = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), shards=7, bits=6).collect()

    def category(value):  # the top bits of Spark's xxhash64 of the value and of whether it is null
        first = xxhash.xxh64_intdigest((value or "").encode(), 42)
        return xxhash.xxh64_intdigest((1 if value is None else 0).to_bytes(4, "little"), first) >> 58

    size = lambda t: len((t or "").encode()) + 16
    first = {}
    for i, t, lang, source in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", (category(source), category(lang), min(63, math.floor(math.log2(size(t)) * (63 / 40)))))
    at = {t: int(sharding.hilbert_index(np.array([p]), 6)[0]) for t, p in first.items()}
    order = sorted(rows, key=lambda r: (at[r[1] or ""], hashlib.sha256((r[1] or "").encode()).digest(), r[0]))
    want = []
    for rank, (i, t, *_) in enumerate(order):
        shard = rank * 7 // len(rows)
        start = -(-shard * len(rows) // 7)
        want.append((i, size(t), zlib.crc32((t or "").encode()), "rows", shard, rank - start, None, at[t or ""]))
    assert sorted(tuple(r)[:6] + (None, r.curve) for r in got) == sorted(want)
