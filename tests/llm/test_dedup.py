"""The four deduplicators against brute force."""

import collections
import hashlib
import random

import numpy as np

from palimpsest.llm import embeddings, exact_dedup, minhash

DOCS = "doc_id bigint, text string, keep_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], DOCS)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_exact_dedup_even_where_digests_clash(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "A", "a", "B", "É", "é", "c" * 5000, f"u{i}"])) for i in range(150)] + [(7, "A"), (7, "A")]
    for chars in (64, 1):
        got = exact_dedup.exact_dedup(table(spark, rows), salts=4, route_chars=chars).collect()
        fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[fold(t)].append(i)
        want = [(i, max(groups[fold(t)]), len(groups[fold(t)]), i == max(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows]
        assert sorted(map(tuple, got)) == sorted(want)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def near_texts():
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(400)]
    base = [[rng.choice(voc) for _ in range(rng.choice([30, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(140):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(voc)
        rows.append((1000 - i, " ".join(w * rng.choice([1, 1, 1, 2])) + rng.choice(["", "\n"])))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "one two"), (2004, "ONE two"), (2005, "one"), (100, rows[1][1])]


def bag(t):
    w = (t or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_near_dedup_links_what_brute_force_links(spark):
    rows = near_texts()
    bags = [(i, bag(t)) for i, t in rows]
    links = []
    for x, (i, a) in enumerate(bags):
        for j, b in bags[:x]:
            both = sum((a & b).values())
            if a and both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                links.append((i, j))
    want = components({i for i, _ in rows}, links)
    got = minhash.near_dedup(table(spark, rows), block=16, size=128).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_dedup(table(spark, [])).count() == 0


def test_bag_signatures_are_unbiased():
    for n in (40, 300):
        a = [f"a{i}" for i in range(n)] * 2 + [f"a{i}" for i in range(n // 2)]
        b = list(a)
        for at in range(0, len(b), len(b) // 6):
            b[at] = "z"
        owner, shingle, count = minhash.shingle_bags([" ".join(a), " ".join(b)], 5)
        sign = minhash.bag_signatures(owner, shingle, count, 2, 8192)
        k = owner == 0
        true = minhash.weighted_jaccard(shingle[k], count[k], shingle[~k], count[~k])
        assert abs((sign[0] == sign[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 8192) and 0.3 < true < 1


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 24))
    rows = []
    for i in range(240):
        v = centres[rng.integers(8)] + rng.normal(size=24) * rng.choice([0.1, 0.25, 2.0])
        rows.append((500 - i, [float(x) for x in v], int(rng.integers(2))))
    rows += [(900, rows[0][1], rows[0][2]), (901, [3.0 * x for x in rows[0][1]], rows[0][2]), (902, None, 0), (903, [0.0] * 24, 0), (904, [float("nan")] * 24, 0), (905, rows[0][1], None), (906, [], 0), (907, [1.0, None], 1), (900, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "e") for r in rows], "vec_id bigint, embedding array<double>, label int, no string")
    ok = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    n, links = collections.Counter(), []
    for x, a in enumerate(ok):
        for y, b in enumerate(ok):
            if x != y and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93:
                n[x] += 1
                links.append((a[0], b[0]))
    by_id = collections.defaultdict(list)
    for x, a in enumerate(ok):
        by_id[a[0]].append(n[x])
    want = components({r[0] for r in rows}, links)
    got = embeddings.near_vectors(df, block=16, tables=24).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= max(by_id.get(r.vec_id, [0])) for r in got)
    assert found >= 0.97 * len(links)
    assert sum(r.component_id == want[r.vec_id] for r in got) >= 0.97 * len(got)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_near_dedup_of_repeated_and_missing_ids(spark):
    long_ = " ".join(f"v{i}" for i in range(60))
    rows = [(7, long_), (7, long_ + " x"), (7, "quite another text of seven words"), (None, long_), (3, long_ + " y"), (None, "alone with no number"), (None, "alone with no number"), (8, None), (8, None)]
    got = collections.Counter(tuple(r) for r in minhash.near_dedup(table(spark, rows)).collect())
    want = [(3, 3, 4, True), (7, 3, 4, False), (7, 3, 4, False), (None, 3, 4, False), (7, 7, 1, True), (None, None, 2, True), (None, None, 2, False), (8, 8, 1, True), (8, 8, 1, True)]
    assert got == collections.Counter(want)
