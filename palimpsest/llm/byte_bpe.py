"""Byte-level BPE: encoding by tree concatenation, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Fixed values of byte-level BPE vocabularies: the split pattern, and the bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = (range(33, 127), range(161, 173), range(174, 256))


def _byte_of() -> dict[str, int]:
    """Which byte each character of a vocabulary entry stands for: printed bytes themselves, the others from 256 up, in order."""
    own = [b for r in PRINTED for b in r]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(c: str) -> str | None:
    """Of which kind of piece of the split pattern a character is; None where that is not clear from it alone."""
    if c.isalpha():
        return "letter"
    if c in " \t\r\n":
        return "space"
    group = unicodedata.category(c)[0]
    return {"N": "number", "P": "other", "S": "other", "M": "other"}.get(group) if c != "'" else None


class ByteBpe:
    """The encoder and decoder of a tokenizers .json file with byte-level BPE, without prefix space.

    Special tokens in a text are taken first, leftmost and longest, as the tokenizers library does by default. The text between
    them is encoded by tree concatenation, see `concatenated`, whatever its length: parts of `leaf` bytes at most by `tiktoken`, with
    the vocabulary of the file, and everything longer by joining halves.
    """

    def __init__(self, path: str, leaf: int = 512, threads: int = 2) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        vocab = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if all(c in byte_of for c in piece)}
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only added tokens that are matched as they stand can be encoded")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in vocab.items() if v not in self.special.values()}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        order = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile("(" + "|".join(map(re.escape, order)) + ")") if order else None
        self.leaf, self.pool = max(8, leaf), ThreadPoolExecutor(threads)
        self.joins = self.windows = 0

    def concatenated(self, data: bytes) -> list[int]:
        """The tokens of a text without special tokens (UTF-8), by halves.

        The text is halved until a part has `leaf` bytes at most; parts are encoded each for itself, those of long texts in
        parallel, and joined pairwise, up the tree.
        """
        cuts = self._leaves(data, 0, len(data))
        parts = [(a, b, ids) for (a, b), ids in zip(cuts, self._encoded([data[a:b].decode() for a, b in cuts]), strict=True)]
        while len(parts) > 1:
            joined = [self.join(data, *parts[i], *parts[i + 1][1:]) for i in range(0, len(parts) - 1, 2)]
            parts = [*joined, *parts[len(parts) - len(parts) % 2 :]]
        return parts[0][2] if parts else []

    def _encoded(self, parts: list[str]) -> Iterator[list[int]]:
        return self.pool.map(self.core.encode_ordinary, parts) if len(parts) > 256 else map(self.core.encode_ordinary, parts)

    def _leaves(self, data: bytes, a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= self.leaf:
            return [(a, b)] if b > a else []
        m = (a + b) // 2
        while data[m] & 0xC0 == 0x80:  # not within a character
            m -= 1
        return self._leaves(data, a, m) + self._leaves(data, m, b)

    def join(self, data: bytes, a: int, m: int, left: list[int], b: int, right: list[int]) -> tuple[int, int, list[int]]:
        """(a, b, the tokens of data[a:b]) from those of data[a:m] and of data[m:b].

        A window around m is encoded anew, from a token start k tokens before m to a token end k tokens behind it, k = 2, 4, 8, ...
        until its ends are fit to be ends (see `_fit`), its first token is the left side's there and its last token is the right side's.

        The split pattern then cuts the window as it cuts the whole, as far as that matters: at a fit end a piece begins whatever
        stands before it, or the end lies within a piece that reaches as far with or without what is beyond the end. And within a piece, a
        sequence of tokens is the encoding of its bytes exactly when each two neighbouring tokens are the encoding of theirs; the
        neighbours inside either side and inside the window are, and those at the window's ends are the old ones, as both sides
        agree there. A window that reaches both ends is the whole encoding.
        """
        self.joins += 1
        size, k = self.bytes_of, 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            lo, hi = m - sum([len(size[t]) for t in left[i:]]), m + sum([len(size[t]) for t in right[:j]])
            if (lo == a or self._fit(data, lo)) and (hi == b or self._fit(data, hi)):
                self.windows += 1
                window = self.core.encode_ordinary(data[lo:hi].decode())
                if (lo == a or window[0] == left[i]) and (hi == b or window[-1] == right[j - 1]):
                    return a, b, left[:i] + window + right[j:]
            k *= 2

    @staticmethod
    def _fit(data: bytes, at: int) -> bool:
        """Whether a window may end at `at`: before a space that a letter, digit or sign follows, for there a piece always begins; or
        between two characters of one kind, away from apostrophes, which begin pieces of their own."""
        if data[at] & 0xC0 == 0x80:
            return False
        near = data[max(0, at - 4) : at + 8]
        if data[at] == 0x20 and at + 1 < len(data) and 32 < data[at + 1] < 127:
            return True
        before = data[max(0, at - 4) : at].decode(errors="ignore")[-1:]
        behind = data[at : at + 4].decode(errors="ignore")[:1]
        return b"'" not in near and bool(before and behind) and _kind(before) == _kind(behind) is not None

    # Texts

    def _runs(self, text: str) -> Iterator[tuple[str, bool]]:
        parts = self.find_special.split(text) if self.find_special and any(s in text for s in self.special) else [text]
        for i, part in enumerate(parts):
            if part:
                yield part, i % 2 == 1

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self._runs(text):
            ids += [self.special[part]] if special else self.concatenated(part.encode())
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 give U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, SHA-256 of the ids as decimals with commas, SHA-256 of the decoded text)."""
        ids, decimal = self.encode(text), self.decimal
        joined = ",".join([decimal[i] for i in ids])
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_digests(docs: DataFrame, name: str = "byte_bpe_50k.json", leaf: int = 512) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs(doc_id, text, ...).

    The whole text is encoded and its ids decoded; null is the empty text (no tokens, digests of the empty
    string). Rows that repeat are encoded each for itself. Very long texts are encoded whole, as all others by halves. Extra columns are
    not read; an empty table gives an empty result. One pass, no shuffle; a task holds one Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches:
            bpe = bpe or ByteBpe(tokenizer_file(name), leaf)
            out = [bpe.digests(t.as_py() or "") for t in b.column(1)]
            n, ids, decoded = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, name: str = "byte_bpe_50k.json", leaf: int = 512) -> DataFrame:
    """docs with a column ids array<int> (replacing one of that name): the tokens of the whole text; null is the empty text."""
    encode = _udf("array<int>", name, leaf, lambda bpe, t: bpe.encode(t or ""))
    return docs.withColumn("ids", encode(F.col("text")))


def bpe_decode(rows: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """rows with a column decoded string: the text of ids (null ids: the empty text)."""
    decode = _udf("string", name, 512, lambda bpe, ids: bpe.decode(list(ids) if ids is not None else []))
    return rows.withColumn("decoded", decode(F.col("ids")))


def _udf(kind: str, name: str, leaf: int, f):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = ByteBpe(tokenizer_file(name), leaf)
        for column in batches:
            yield column.map(lambda x: f(bpe, x))

    return run


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))
