"""Token counts of a sentencepiece BPE model by heap-and-linked-list merging, with no ids emitted."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_bpe import tokenizer_file
from .common import documents
from .segments import Cache, segments

SPACE = "▁"  # stands for a space in pieces


class PieceCounter:
    """Counts what SentencePieceProcessor.encode gives, for a BPE model with byte fallback and a dummy prefix.

    The model is read for its pieces and their ranks; merging is done here. No piece joins a visible character to a
    space behind it (checked on loading), so a text is cut at lone spaces and the counts of segments are remembered.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a space behind another character")
        self.normalize = model.normalize
        plain = "a éﬁ　​\t\n  b"
        if self.normalize(plain) != SPACE + plain.replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are can be counted")
        self.cache = Cache(lambda s: self.count_symbols(SPACE + s.replace(" ", SPACE)))

    def count_symbols(self, text: str) -> int:
        """Initial symbols less merges. A character outside the vocabulary counts as its UTF-8 bytes.

        Symbols are a doubly linked list of string slots; a heap holds adjacent pairs that form a piece, by rank and then from the
        left. A popped pair whose symbols have since changed is passed over.
        """
        rank = self.rank
        if text in rank and len(text) <= 2:
            return 1
        symbol: list[str] = list(text)
        n = len(symbol)
        total = n
        for c in symbol:
            if c not in rank:
                total += len(c.encode()) - 1
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := symbol[i] + symbol[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j >= n or len(symbol[i]) + len(symbol[j]) != len(piece) or symbol[i] + symbol[j] != piece:
                continue
            symbol[i], symbol[j] = piece, ""
            total -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbol[k]) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbol[h] + piece) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        cache = self.cache
        return sum([cache[s] for s in segments(text, lone=True)])  # the dummy prefix is the first one's space


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text, ...).

    Whole texts, null as empty (0 bytes, 0 tokens). Special strings inside a text are ordinary text, as sentencepiece has it. Rows
    that repeat are counted each for itself; extra columns are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or PieceCounter(tokenizer_file(name))
            texts = [t.as_py() or "" for t in b.column(1)]
            n = [counter.count(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
