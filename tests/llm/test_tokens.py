"""BPE and piece counts against the libraries themselves."""

import hashlib
import random

import pytest

from palimpsest.llm.byte_bpe import ByteBpe, bpe_decode, bpe_digests, bpe_encode, tokenizer_file
from palimpsest.llm.piece_count import PieceCounter, token_counts

BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts():
    rng = random.Random(3)
    some = list("abcde  \n\t'sdt!?1234é漢　 \x1c\x85\x00▁😀ñ<|>") + ["<|endoftext|>", "the ", "ing", "   ", "<s>", "'ll"]
    out = ["", " ", "a", "▁", "<|endoftext|>", "  a  b ", "'ll", "\n\n x"]
    out += ["".join(rng.choices(some, k=rng.randint(0, 60))) for _ in range(600)]
    for k in (90, 3000, 20000):
        out += ["".join(rng.choices(x, k=k)) for x in ("abcdeist", "ñ漢é😀", "etaoinshrdlu", "!?")] + ["a" * k, "ab" * k, " " * k + "x", "\n" * k, "the" * k]
    return out


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(BYTE)), sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE))


@pytest.mark.parametrize("leaf", [8, 48, 512])
def test_tree_concatenation_gives_the_librarys_ids(libraries, leaf):
    bpe = ByteBpe(tokenizer_file(BYTE), leaf)
    for t in texts():
        ids = libraries[0].encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == libraries[0].decode(ids, skip_special_tokens=False)
    assert bpe.joins > 50 and bpe.windows > bpe.joins


def test_ordinary_documents_are_joined_from_halves(libraries):
    """All documents of sf0.01, against the library."""
    import pyarrow.parquet as pq

    bpe = ByteBpe(tokenizer_file(BYTE))
    given = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    for t, e in zip(given, libraries[0].encode_batch(given, add_special_tokens=False), strict=True):
        assert bpe.encode(t) == e.ids
    assert bpe.joins >= len(given)


def test_cuts_at_every_place_of_odd_texts(libraries):
    """Both halves of every cut, joined, are what the library gives for the whole."""
    bpe = ByteBpe(tokenizer_file(BYTE), 8)
    for t in ["we're 'sad'' they'll!! don't'", "a  \n \n\n b\t\t c   ", "12３４五 ½x² ١٢", "x\x1c\x85 y\u3000\u3000z\u200b", "ñ漢é😀😀 '😀'", "!?!?'s'!? ...'re"]:
        data = t.encode()
        for m in range(1, len(data)):
            if data[m] & 0xC0 != 0x80:
                left, right = (bpe.core.encode_ordinary(x.decode()) for x in (data[:m], data[m:]))
                assert bpe.join(data, 0, m, left, len(data), right)[2] == libraries[0].encode(t, add_special_tokens=False).ids


def test_decode_of_any_ids(libraries):
    bpe, rng = ByteBpe(tokenizer_file(BYTE)), random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 8))]
        assert bpe.decode(ids) == libraries[0].decode(ids, skip_special_tokens=False)


def test_counts_are_the_librarys(libraries):
    counter = PieceCounter(tokenizer_file(PIECE))
    for t in texts():
        assert counter.count(t) == len(libraries[1].encode(t))


def test_tables(spark, libraries):
    rows = [(1, "some text", "x"), (2, None, "x"), (3, "", "x"), (4, "some text", "x"), (4, "some text", "x"), (None, "<|endoftext|> " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, bpe_digests(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = libraries[0].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert all(r.decoded == (r.text or "") for r in bpe_decode(bpe_encode(docs)).collect())
    got = sorted(map(tuple, token_counts(docs).collect()), key=str)
    counts = [(i, len((t or "").encode()), len(libraries[1].encode(t or ""))) for i, t, _ in rows]
    assert got == sorted([(*c, c[2] > 4096) for c in counts], key=str)
    assert bpe_digests(docs.limit(0)).count() == token_counts(docs.limit(0)).count() == 0
