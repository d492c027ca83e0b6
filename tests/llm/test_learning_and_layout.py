"""Toxicity, language ID, mixing, sharding and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import language_id, mixing, sharding, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def test_folding_hits_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " scum ": 3.0})
    for t in ("idiot", "ID1OT!", "іdіоt", "ídïôt", "id​iot", "ｉｄｉｏｔ"):
        assert lexicon.hits(toxicity.fold(f"such an {t}, he")) == 4.0
    assert lexicon.hits(toxicity.fold("the pond scum and idiotic")) == 0.0
    assert lexicon.hits(toxicity.fold("pond scum, scum")) == 3.0
    assert lexicon.density(None) == lexicon.density("") == 0.0
    assert lexicon.density("idiot " + "word " * 99) == pytest.approx(0.04)


def test_toxicity_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = toxicity.op1_toxicity(spark, SF).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 80 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93
    assert sum(r.predicted for r in held if not labels[r.doc_id]) <= 2


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "what an idiot you are", None, None, 1, "s"), (2, None, None, None, 0, "s"), (3, "", None, None, 0, "s")], SCHEMA)
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    lexicon = toxicity.learn_lexicon(docs, empty)
    rows = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, lexicon).collect()}
    assert rows[1] > 0.7 > rows[2] == rows[3] >= 0
    assert toxicity.toxicity_scores(docs.limit(0), lexicon).count() == 0


def test_gru_gradients():
    rng = np.random.default_rng(0)
    gru = language_id.ByteGru(["a", "b", "c"], hidden=3)
    gru.w = {k: v.astype(np.float64) for k, v in gru.w.items()}
    gru.states = lambda x, d, keep=False, f=gru.states: f(x, d, keep)
    x, y = rng.integers(97, 103, (7, 4)), np.array([0, 1, 2, 1])
    x[5:, 0] = 256
    _, grads = gru.gradients(x, y)
    for name in ("out", "bias", "u_f", "u_b", "emb_f", "emb_b"):
        w = gru.w[name]
        at = tuple(98 if name.startswith("emb") and i == 0 else rng.integers(s) for i, s in enumerate(w.shape))
        old, eps = w[at], 1e-2
        w[at] = old + eps
        up = gru.gradients(x, y)[0]
        w[at] = old - eps
        down = gru.gradients(x, y)[0]
        w[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grads[name][at], rel=0.02, abs=2e-5)


def test_language_id_on_held_out_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.op10_language_id(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and len(held) > 150
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.96
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", None, 0, ""), (2, "12 !?", "x", None, 0, ""), (3, "é", None, None, 0, ""), (3, "plain words " * 3000, "x", None, 0, "")], SCHEMA)
    model = language_id.learn_languages(docs, steps=3)
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.predict_languages(docs, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "x"), (3, "x")]
    assert language_id.learn_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict_languages(docs, None).collect()} == {"und"}


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 5], [5, 2], 5) == [0.0, 5.0]


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9)) == list(range(n))


def mixable(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " \n".join(f"w{i}.{k}" for k in range(rng.integers(0, 300))), "en", [None, "a", "b", "c", "É"][rng.integers(5)], 7, "s") for i in range(150)]
    rows += [(3, "again", "en", "a", 7, "s"), (3, "again", "en", "a", 7, "s"), (500, None, "en", "a", 7, "s"), (501, "", "en", "z", 0, "s"), (502, "x", "en", "tiny", 1, "s")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_mixing_meets_targets_and_limits(spark):
    docs, rows = mixable(spark)
    got = [tuple(r) for r in mixing.mix_report(docs).collect()]
    assert sorted(got) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    count = lambda t: len(re.findall(mixing.WORD, t or ""))
    assert sorted((i, n) for i, n, *_ in got) == sorted((r[0], count(r[1])) for r in rows)
    size = collections.Counter()
    for r in rows:
        size[r[3]] += count(r[1])
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(size.values())), strict=True))
    taken = collections.Counter()
    for i, n, source_size, target, t in got:
        assert 0 <= t <= 3 * n and source_size in size.values()
        taken[source_size, round(target, 6)] += t
    for s, t in want.items():
        assert abs(taken[size[s], round(t, 6)] - t) <= 3 * 64
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mixed_documents_hold_the_words_of_the_report(spark):
    docs, _ = mixable(spark)
    docs = docs.dropDuplicates(["doc_id"])
    words = collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(re.findall(mixing.WORD, r.text))
    assert words == collections.Counter({r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.taken})


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        at = sharding.hilbert_index(grid, bits)
        assert sorted(at) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark):
    docs, rows = mixable(spark)
    got = sharding.hilbert_shards(docs, shards=7).collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sorted(per) == list(range(7)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    text = {r[0]: r[1] or "" for r in rows if r[0] != 3}
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got if r.doc_id != 3)
    assert sharding.hilbert_shards(docs.limit(0)).count() == 0
    few = sharding.hilbert_shards(docs.limit(3), shards=40).collect()
    assert len({r.shard for r in few}) == 3
