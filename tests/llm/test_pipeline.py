"""Each stage of the pipeline against a plain version, on odd rows: null and repeated ids, null, empty and long texts, clashing columns."""

import collections
import hashlib
import random
import re

import corpus_pipeline as p
import pytest
from test_dedup import bag
from test_dedup import components as plain_components

from palimpsest.llm import mixing, toxicity
from palimpsest.llm.byte_bpe import tokenizer_file

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, parts string, _d string, row string, data string, kept string"


def rows_of(seed):
    rng = random.Random(seed)
    long_ = [" ".join(f"{n}{i}" for i in range(k)) for n, k in (("a", 60), ("b", 90), ("c", 3000))]
    texts = ["same", "Same", "other", None, "", " ", "É", "é", "an idiot, a moron and scum", *long_, *[t + " end" for t in long_], long_[0].upper()]
    return [(rng.choice([None, 3, 7, 7, *range(20, 60)]), rng.choice(texts), "en", rng.choice([None, "a", "b", "É"]), 5, *rng.choices("xyz", k=6)) for _ in range(70)]


@pytest.fixture(scope="module")
def given(spark):
    rows = [*rows_of(1), (7, "same", "en", "a", 5, *"uvwxyz"), (7, "same", "en", "a", 5, *"uvwxyz"), (9, "Same", "en", "a", 5, *"uvwxyz")]
    return spark.createDataFrame(rows, COLUMNS), rows


def counted(df):
    return collections.Counter(map(tuple, df.collect()))


def test_toxicity_stage(spark, given):
    docs, rows = given
    got = p.toxicity(spark, docs, SF)
    lexicon = toxicity.train_fold(spark, docs, SF)
    want = collections.Counter(r for r in rows if lexicon.score(lexicon.density(r[1])) < 0.7)
    assert counted(got) == want and got.columns == docs.columns
    assert 0 < len(want) and not any("idiot" in (r[1] or "") for r in want)


def test_exact_copies_stage(spark, given):
    docs, rows = given
    got = p.exact_copies(spark, docs, SF)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")].append(r)
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == len(groups) and not collections.Counter(kept) - collections.Counter(rows)
    for r in kept:
        group = groups[re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")]
        assert r[0] == max((g[0] for g in group if g[0] is not None), default=None)


def test_near_copies_stage(spark, given):
    docs, rows = given
    got = p.near_copies(spark, docs, SF)
    bags, links = [bag(r[1]) for r in rows], []
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            both = sum((a & b).values())
            if a and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                links.append((i, j))
    root = plain_components(range(len(rows)), links)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i]].append(r)
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and not collections.Counter(kept) - collections.Counter(rows)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    assert collections.Counter(r[0] for r in kept) == collections.Counter(least(r[0] for r in g) for g in groups.values())
    assert sum(not bag(r[1]) for r in kept) == sum(not bag(r[1]) for r in rows)


def test_mixing_stage(spark, given):
    docs, rows = given
    got = p.mixing(spark, docs, SF)
    assert got.columns == docs.columns
    words = lambda t: re.findall(mixing.WORD, t or "")
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    mixed = [tuple(r) for r in got.collect()]
    whole = collections.defaultdict(set)
    for r in rows:
        whole[r[0]].add(" ".join(words(r[1])))
    for r in mixed:
        taken[r[3]] += len(words(r[1]))
        assert r[4] == len(r[1])
        assert any(all(piece in t for piece in (" ".join(words(x)) for x in r[1].split("\n"))) for t in whole[r[0]])
    names = sorted(s for s in size if s is not None) + [None]
    for s, t in zip(names, mixing.targets([size[s] for s in names], [5, 2, 1, 5], sum(size.values())), strict=True):
        assert abs(taken[s] - t) <= 3 * 64


def test_tokens_stage(spark, given):
    from tokenizers import Tokenizer

    docs, rows = given
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert counted(p.tokens(spark, docs, SF)) == want


def test_empty_tables(spark, given):
    docs = given[0].limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_applies_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for name, stage in p.STAGES[:4]:
        step = p.written(stage(spark, step, SF))
        assert step.columns == docs.columns, name
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "bpe"]
    assert counted(p.run(spark, SF)) == counted(p.tokens(spark, step, SF))
