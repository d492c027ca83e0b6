"""Substring deduplication against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from test_dedup import table

from palimpsest.llm import substring_dedup


def age(row):
    """The order of documents: null doc_id first, then by doc_id; rows that repeat one by a hash of the text."""
    i, t = row
    tie = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), seed=42)
    return (i is not None, i or 0, tie - (1 << 64) if tie >> 63 else tie)


def removed(rows, length):
    first, out = set(), []
    for i, t in sorted(rows, key=age):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in first:
                cover[s : s + length] = True
            first.add(b[s : s + length])
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    return sorted(out, key=str)


def passages(rng, length):
    return ["".join(rng.choices("abcé \n\x00", k=rng.choice([length - 1, length + 1, 160, 4 * length]))) for _ in range(6)]


@pytest.mark.parametrize(("length", "sizes"), [(100, {}), (400, {}), (100, {"hot_bytes": 500, "family_bytes": 3000, "batch_bytes": 700})])
def test_substring_dedup(spark, length, sizes):
    """The last sizes are small: families of several levels, and anchors whose strings travel one by one."""
    rng = random.Random(9)
    some = passages(rng, length)
    rows = [(i, "".join(rng.choice([rng.choice(some), "".join(rng.choices("xyz ñ", k=rng.randint(0, 80)))]) for _ in range(rng.randint(0, 5)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "a" * 5 * length), (203, "ab" * 3 * length), (204, "a" * (length - 1)), (205, rows[3][1] * 40)]
    got = substring_dedup.substring_dedup(table(spark, rows), length, **sizes).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, length)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(10)
    some = passages(rng, 100)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(some) + rng.choice(some) + str(rng.randrange(3))) for _ in range(40)] + [(None, None), (1, None), (7, "a" * 300), (7, "a" * 300)]
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 100)
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_long_texts_and_kept_bytes(spark):
    rng = random.Random(11)
    long_ = "".join(rng.choices("abcdef ", k=300_000))
    rows = [(1, long_), (2, long_[1000:250_000] + "!"), (3, "z" * 50_000)]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in substring_dedup.substring_dedup(table(spark, rows), digest=False).collect()}
    assert got == {1: (0, long_.encode()), 2: (249_000, b"!"), 3: (49_999, b"z")}


def test_gram_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(table(spark, [(1, "a")]), gram=48)


def test_hashes_only_route(monkeypatch):
    """Texts that the hash of snippets takes for one are told apart by their bytes."""
    same = substring_dedup._BYTES.copy()
    same[ord("Y")] = same[ord("X")]
    monkeypatch.setattr(substring_dedup, "_BYTES", same)
    text = "".join(random.Random(2).choices("abcdefgh ", k=300))
    texts = [text[:150] + c + text[151:] for c in "XYX"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int64()), pa.array(texts)], names=["doc", "text"])
    rows = [r for b in substring_dedup._snippets(100, 32)(iter([batch])) for r in b.to_pylist()]
    gone = np.zeros((3, 300), bool)
    for r in rows:
        if r["kind"] == substring_dedup.GONE:
            gone[r["doc"], r["lo"] : r["hi"]] = True
    assert not gone[0].any() and gone[2].all() and gone[1].any() and not gone[1, 150]


@pytest.mark.parametrize("length", [6, 20])
def test_suffix_family_matches_brute_force(length):
    rng = random.Random(1)
    strings = ["".join(rng.choices("ab\x00", k=rng.randint(0, 60))).encode() for _ in range(80)]
    family, seen = substring_dedup.SuffixFamily(length), set()
    for lo in range(0, 80, 5):
        for s, hit in zip(strings[lo : lo + 5], family.add(strings[lo : lo + 5]), strict=True):
            for i, h in enumerate(hit):
                assert h == (s[i : i + length] in seen)
                seen.add(s[i : i + length])
        assert len({level.rank for level in family.levels}) == len(family.levels)
    assert sum(len(level.at) for level in family.levels) == len(seen)
    for level in family.levels:
        own = [level.data[a : a + length].tobytes() for a in level.at]
        assert own == sorted(own)


def test_every_row_of_a_shared_anchor_goes_on():
    rng = np.random.default_rng(4)
    h = np.sort(rng.choice([1, 2, 3, 50, 51, 99], 400, p=[0.6, 0.2, 0.19, 0.004, 0.003, 0.003]))
    rows = [(int(x), i, 0, 120, substring_dedup.MEETS) for i, x in enumerate(h)]
    names = ["h", "doc", "lo", "hi", "kind"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 37], strict=True), kinds, strict=True)], names=names) for a in range(0, 400, 37)]
    out = [r for b in substring_dedup._shared(10_000)(iter(batches)) for r in b.to_pylist()]
    count = {int(x): int((h == x).sum()) for x in set(h)}
    assert sorted(r["doc"] for r in out) == [i for i, x in enumerate(h) if count[x] > 1 or count[x] * 120 > 10_000]
    for x, n in count.items():
        assert {r["kind"] for r in out if r["h"] == x} <= {substring_dedup.SINGLES if n * 120 > 10_000 else substring_dedup.MEETS}
