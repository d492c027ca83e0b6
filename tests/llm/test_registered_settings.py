"""Recall of the near-duplicate operators with the parameters that the queries register."""

import collections
import random

import numpy as np
from test_dedup import bag, components, near_texts, table

from palimpsest.llm import embeddings, minhash


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def test_recall_of_near_dedup_as_registered(spark):
    rng, rows, pairs = random.Random(11), [], []
    for i in range(1200):  # pairs near the limit, of words of their own
        w = [f"p{i}.{k}" for k in range(120)]
        v = list(w)
        for at in rng.sample(range(10, 110, 10), 2):  # a changed word changes five shingles
            v[at] = "z"
        v += [f"q{i}.{k}" for k in range(rng.randrange(0, 8))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append(similar(bag(rows[-2][1]), bag(rows[-1][1])))
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(table(spark, rows)).collect()}
    near = [i for i, s in enumerate(pairs) if s >= 0.8]
    found = sum(got[2 * i + 1] == 2 * i for i in near)
    print(f"op5: {found} of {len(near)} pairs found, similarity {min(pairs[i] for i in near):.3f} to {max(pairs):.3f}")
    assert len(near) > 500 and found >= 0.995 * len(near)
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in ({2 * i, 2 * i + 1} if s >= 0.8 else {2 * i + 1}) for i, s in enumerate(pairs))


def test_near_dedup_as_registered_links_what_brute_force_links(spark):
    rows = near_texts()
    bags = [(i, bag(t)) for i, t in rows]
    want = components({i for i, _ in rows}, [(i, j) for x, (i, a) in enumerate(bags) for j, b in bags[:x] if similar(a, b) >= 0.8])
    got = minhash.near_dedup(table(spark, rows)).collect()
    right = sum(r.component_id == want[r.doc_id] for r in got)
    print(f"op5: {right} of {len(rows)} rows in the component of brute force")
    assert len(got) == len(rows) and right >= 0.99 * len(rows)


def test_recall_of_near_vectors_as_registered(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 64))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=64) * (0.1, 0.2, 0.25)[i % 3]], i % 2) for i in range(1200)]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    found = collections.Counter({r.vec_id: r.n_links for r in got})
    print(f"op2: {sum(found.values())} of {links.sum()} directed links found")
    assert all(found[i] <= links[i].sum() for i in range(len(rows)))
    assert sum(found.values()) >= 0.97 * links.sum() > 1000
