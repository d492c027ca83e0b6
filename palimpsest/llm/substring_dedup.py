"""Exact substring deduplication: strings meet by content-defined anchors in a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, odd_ids, partitions, ranked, written

_U = np.uint64
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_BYTES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class SuffixArray:
    """Places `at` in `data`, sorted by the `length` bytes that begin there; no two of these strings are equal.

    keys holds the strings themselves in that order, as rows of 8-byte words with a last byte that is not zero.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, keys: np.ndarray, rank: int = 0) -> None:
        self.data, self.at, self.keys, self.rank = data, at, keys, rank

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
        """The array of the first place of each different string among `starts` (rising), and for each start its string's number in the
        array and whether an earlier start has the same string."""
        rows = np.ones((len(starts), -(-(length + 1) // 8) * 8), np.uint8)
        if len(starts):
            rows[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
        keys = rows.view(np.uint64)
        order = _order(keys)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        again = np.ones(len(keys), bool)
        again[order[new]] = False
        return cls(data, starts[order[new]], keys[new]), number, again

    def scan(self, new: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One merge of the two sorted runs: the merged strings, their order (ours first among equal ones), and for each of new's
        strings whether it is one of ours."""
        keys = np.concatenate([self.keys, new.keys])
        order = _order(keys)  # two sorted runs: Timsort merges them in one pass
        theirs = np.flatnonzero(order >= len(self.at))
        hit = np.zeros(len(new.at), bool)
        hit[order[theirs] - len(self.at)] = (theirs > 0) & (keys[order[theirs]] == keys[order[theirs - 1]]).all(axis=1)
        return keys, order, hit

    def merged(self, new: SuffixArray) -> SuffixArray:
        """Both arrays as one of the next level; they share no string."""
        keys, order, _ = self.scan(new)
        at = np.concatenate([self.at, new.at + len(self.data)])[order]
        return SuffixArray(np.concatenate([self.data, new.data]), at, keys[order], max(self.rank, new.rank) + 1)

    def only(self, wanted: np.ndarray, ends: np.ndarray) -> SuffixArray:
        """The array of some of its strings, without the texts (that end at `ends` in the data) that hold none of them."""
        at = self.at[wanted]
        text = np.searchsorted(ends, at, side="right")
        held = np.zeros(len(ends), bool)
        held[text] = True
        sizes = np.diff(ends, prepend=0)
        moved = np.cumsum(np.where(held, sizes, 0)) - np.where(held, sizes, 0) - (ends - sizes)
        return SuffixArray(self.data[np.repeat(held, sizes)], at + moved[text], self.keys[wanted], self.rank)


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by their bytes."""
    return np.argsort(keys.reshape(-1).view(f"S{8 * keys.shape[1]}"), kind="stable")


class SuffixFamily:
    """A logarithmic family of suffix arrays: levels of rank 0, 1, 2, ..., each at most once, that share no string."""

    def __init__(self, length: int) -> None:
        self.length, self.levels = length, []

    def add(self, strings: list[bytes]) -> list[np.ndarray]:
        """For each string of a new batch, which of its starts have `length` bytes that begin earlier: in a string added before, in
        an earlier string of the batch, or earlier in the string. What is new of the batch then joins the family."""
        ends = np.cumsum([len(s) for s in strings]) if strings else np.zeros(0, np.int64)
        again = self.found(np.frombuffer(b"".join(strings), np.uint8), ends)[1]
        counts = [max(0, len(s) - self.length + 1) for s in strings]
        return np.split(again, np.cumsum(counts)[:-1]) if counts else []

    def found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """add() of texts that end at `ends` in data: the starts of all strings, and whether each begins earlier."""
        sizes = np.diff(ends, prepend=0)
        counts = np.maximum(0, sizes - self.length + 1)
        starts = np.repeat(ends - sizes - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        new, number, again = SuffixArray.of(data, starts, self.length)
        known = np.zeros(len(new.at), bool)
        for level in self.levels:
            known |= level.scan(new)[2]
        again |= known[number]
        if not known.all():
            carry = new.only(~known, ends)
            while self.levels and self.levels[-1].rank == carry.rank:
                carry = self.levels.pop().merged(carry)
            self.levels.append(carry)
        return starts, again


def anchors(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchored snippets of texts: columns text, lo, hi, h, sh, and base, where the text begins in all of them together.

    Each start of a `length`-byte string goes to its anchor, the place of the least hash among the `gram`-byte strings in it,
    leftmost first. Starts lo..hi of a text that share an anchor make one snippet, the bytes lo to hi + length. Equal
    strings have equal anchors: they are found among snippets that agree in h, the anchor's hash. sh is a hash of the snippet's bytes.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    n = len(data)
    if not (lengths >= length).any():
        return {k: np.zeros(0, np.int64) for k in ("text", "lo", "hi", "base")} | {k: np.zeros(0, _U) for k in ("h", "sh")}
    with np.errstate(over="ignore"):
        value = _BYTES[data]
        h, m, width = value, _U(_M), 1
        while width < gram:  # gram is a power of two
            h = h[: len(h) - width] * m + h[width:]
            m, width = m * m, 2 * width
        h = _mix(h)
        key = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
        span, reach = length - gram + 1, 1
        low = key
        while reach * 2 <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        low = (low & _U(0xFFFFFFFF)).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        long_ = lengths >= length
        np.add.at(valid, begin[:-1][long_], 1)
        np.add.at(valid, (begin[1:] - length + 1)[long_], -1)
        start = np.flatnonzero(np.cumsum(valid)[: len(low)])
        at = low[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        lo, hi, anchor = start[first], start[last], at[first]
        power = np.full(n, _M, _U)
        power[0] = 1
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(value * np.multiply.accumulate(power), dtype=_U)])
        inverse = np.full(n, _INVERSE, _U)
        inverse[0] = 1
        sh = _mix((sums[hi + length] - sums[lo]) * np.multiply.accumulate(inverse)[lo]) + (hi - lo).astype(_U)
    text = np.searchsorted(begin, lo, side="right") - 1
    return {"text": text, "lo": lo - begin[text], "hi": hi - begin[text], "base": begin[text], "h": h[anchor], "sh": sh}


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer text is a range of its own."""
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _runs(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by (text, lo) with those that touch or overlap joined; hi rises with lo within a text."""
    if not len(lo):
        return text, lo, hi
    new = np.ones(len(lo), bool)
    new[1:] = (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    return text[first], lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether the `sizes` bytes (length to 2 * length of them) at a and at b are equal."""
    windows, out = np.lib.stride_tricks.sliding_window_view(data, length), np.ones(len(a), bool)
    for lo in range(0, len(a), 4096):
        x, y, z = a[lo : lo + 4096], b[lo : lo + 4096], (sizes - length)[lo : lo + 4096]
        out[lo : lo + 4096] = (windows[x] == windows[y]).all(axis=1) & (windows[x + z] == windows[y + z]).all(axis=1)
    return out


#: What a row says of its span of a text: it goes, it meets others of its anchor, it does so one start at a time.
GONE, MEETS, SINGLES = 0, 1, 2
_SPANS = "h bigint, doc bigint, lo bigint, hi bigint, kind tinyint"


def _spans(h, doc, lo, hi, kind) -> pa.RecordBatch:
    columns = [pa.array(h.view(np.int64)), pa.array(doc), pa.array(lo), pa.array(hi), pa.array(np.broadcast_to(np.int8(kind), len(doc)))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "doc", "lo", "hi", "kind"])


def _snippets(length: int, gram: int, group: int = 1 << 19, window: int = 1 << 23):
    """Arrow batches of (doc, text) to (h, doc, lo, hi, kind), lo to hi being a snippet's bytes.

    Texts are read in windows of about `window` bytes, each in groups of about `group`. Of a window's snippets that are equal byte by
    byte the oldest meets those of other windows; the others' bytes go, and their rows are spread over all partitions.
    """

    def work(docs: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns, base = [], 0
        for at, end in _groups([len(t) for t in texts], group):
            a = anchors(texts[at:end], length, gram)
            columns.append([a["h"], a["sh"], a["text"] + at, a["lo"], a["hi"] + length, a["base"] + base])
            base += sum(map(len, texts[at:end]))
        h, sh, text, lo, hi, base = [np.concatenate(c) for c in zip(*columns, strict=True)]
        if not len(h):
            return
        doc = docs[text]
        order = np.lexsort((lo, doc, sh, h))
        h, sh, text, doc, lo, hi, base = [c[order] for c in (h, sh, text, doc, lo, hi, base)]
        like = np.zeros(len(h), bool)
        like[1:] = (h[1:] == h[:-1]) & (sh[1:] == sh[:-1]) & ((hi - lo)[1:] == (hi - lo)[:-1])
        oldest = np.maximum.accumulate(np.where(like, 0, np.arange(len(h))))
        some = np.flatnonzero(like)
        place = base + lo
        data = np.frombuffer(b"".join(texts), np.uint8)
        like[some] = _same(data, place[some], place[oldest[some]], (hi - lo)[some], length)
        yield _spans(h[~like], doc[~like], lo[~like], hi[~like], MEETS)
        if like.any():
            by = np.lexsort((lo[like], text[like]))
            text, lo, hi = _runs(text[like][by], lo[like][by], hi[like][by])
            yield _spans(_mix(docs[text].astype(_U)), docs[text], lo, hi, GONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            for at, end in _groups([len(t) for t in texts], window):
                yield from work(docs[at:end], texts[at:end])

    return run


def _shared(hot_bytes: int):
    """Rows of `_snippets` sorted by h to those that go and those whose h has another row; the latter are SINGLES where the snippets of an h
    have more than hot_bytes together. At most hot_bytes' worth of rows is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for b in batches:
            columns = [b.column(0).to_numpy().view(_U), *[b.column(i).to_numpy() for i in (1, 2, 3)]]
            gone = b.column(4).to_numpy() == GONE
            if gone.any():
                yield _spans(*[c[gone] for c in columns], GONE)
                columns = [c[~gone] for c in columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            h, doc, lo, hi = columns
            if not len(h):
                continue
            if hot is not None:
                known = h == hot
                if known.any():
                    yield _spans(h[known], doc[known], lo[known], hi[known], SINGLES)
                    h, doc, lo, hi = [c[~known] for c in (h, doc, lo, hi)]
                    if not len(h):
                        held = None
                        continue
                hot = None
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.add.reduceat(hi - lo, first)
            rows = np.diff(np.append(first, len(h)))
            kind = np.where(size > hot_bytes, SINGLES, np.where(rows > 1, MEETS, -1))
            kind[-1] = SINGLES if size[-1] > hot_bytes else -1  # the last h may go on
            each = np.repeat(kind, rows)
            for k in (MEETS, SINGLES):
                if (each == k).any():
                    yield _spans(h[each == k], doc[each == k], lo[each == k], hi[each == k], k)
            if kind[-1] == SINGLES:
                hot, held = h[-1], None
            else:
                held = [c[first[-1] :] for c in (h, doc, lo, hi)]
        if held is not None and len(held[0]) > 1:
            yield _spans(*held, MEETS)

    return run


_PARTS = "h bigint, doc bigint, lo bigint, part binary"


def _cut_parts(length: int):
    """Arrow batches of (doc, text, wanted) to the wanted parts. SINGLES become their strings one by one, under a hash of their bytes;
    of equal ones of a batch the oldest stands for all, and the others' bytes go: part is null and h is their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, singles = [], []
            for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode()
                for w in wanted:
                    if w["kind"] == MEETS:
                        out.append((w["h"], doc, w["lo"], data[w["lo"] : w["hi"]]))
                    else:
                        singles += [(doc, lo, data[lo : lo + length]) for lo in range(w["lo"], w["hi"] - length + 1)]
            seen: set[bytes] = set()
            gone = []
            for doc, lo, part in sorted(singles, key=lambda s: s[:2]):
                if part in seen:
                    gone.append((doc, lo))
                    continue
                seen.add(part)
                out.append((int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), doc, lo, part))
            if gone:
                doc, lo = np.array(gone, np.int64).T
                out += [(e, d, s, None) for d, s, e in zip(*[x.tolist() for x in _runs(doc, lo, lo + length)], strict=True)]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "doc", "lo", "part"])

    return run


def _met(length: int, batch_bytes: int):
    """Rows (family, doc, lo, part), sorted, to spans (doc, lo, hi) of bytes whose strings are in an older part of the family. Parts go
    through the family in batches of about `batch_bytes`, oldest first; it keeps what no older part has."""

    def work(family: SuffixFamily, rows: pa.RecordBatch) -> pa.RecordBatch:
        part = rows.column(3)
        bounds = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        ends = bounds[1:] - bounds[0]
        starts, again = family.found(data, ends)
        starts = starts[again]
        text = np.searchsorted(ends, starts, side="right")
        text, lo, hi = _runs(text, starts, starts + length)
        shift = rows.column(2).to_numpy()[text] - (bounds[:-1] - bounds[0])[text]
        return pa.RecordBatch.from_arrays([pa.array(rows.column(1).to_numpy()[text]), pa.array(lo + shift), pa.array(hi + shift)], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, number, held, size = SuffixFamily(length), None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield work(family, pa.concat_batches(held))

        for b in batches:
            numbers = b.column(0).to_numpy()
            sizes = np.diff(np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset : b.column(3).offset + b.num_rows + 1])
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if numbers[lo] != number:
                    yield from flush()
                    family, number, held, size = SuffixFamily(length), numbers[lo], [], 0
                for at, end in _groups(sizes[lo:hi].tolist(), batch_bytes):
                    if held and size + int(sizes[lo + at : lo + end].sum()) > batch_bytes:
                        yield from flush()
                        held, size = [], 0
                    held.append(b.slice(lo + at, end - at))
                    size += int(sizes[lo + at : lo + end].sum())
        yield from flush()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            kept, at, removed, runs = [], 0, 0, 0
            for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if s[0] > at or not runs:
                    kept.append(data[at : s[0]])
                    runs += 1
                    at = s[0]
                removed += max(0, s[1] - at)
                at = max(at, s[1])
            kept.append(data[at:])
            rows.append((len(data), removed, runs, b"".join(kept)))
        n, r, k, rest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(rest, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _remove(batches):
        digest = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column(4)], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], digest], names=[*b.schema.names[:4], "kept_sha256"])


def removed_spans(keyed: DataFrame, length: int = 100, gram: int = 32, hot_bytes: int = 1 << 20, family_bytes: int = 1 << 20, batch_bytes: int = 1 << 18) -> DataFrame:
    """(doc, lo, hi): byte spans, overlapping ones too, of keyed(doc bigint, unique, text) whose strings start earlier."""
    if gram & (gram - 1) or not 1 <= gram <= length:
        raise ValueError("gram is a power of two and at most length")
    n = partitions(keyed.sparkSession)
    made = keyed.mapInArrow(_snippets(length, gram), _SPANS)
    met = written(made.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_shared(hot_bytes), _SPANS))
    wanted = met.filter(F.col("kind") != GONE)
    strings = F.col("hi") - F.col("lo") - (length - 1)
    size = wanted.agg(F.sum(F.when(F.col("kind") == MEETS, F.col("hi") - F.col("lo")).otherwise(strings * length))).first()[0] or 0
    check = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "hi", "kind")).alias("wanted"))
    parts = keyed.join(check, "doc").select("doc", "text", "wanted").mapInArrow(_cut_parts(length), _PARTS)
    # Equal strings are in parts of one h, so each family is whole. There are at least as many as partitions, of family_bytes at most on the average.
    family = F.pmod(F.xxhash64("h", F.col("part").isNull()), F.lit(max(n, -(-size // family_bytes)))).alias("family")
    parts = parts.select(family, "doc", "lo", "part", F.when(F.col("part").isNull(), F.col("h")).alias("end"))
    dealt = parts.repartition(n, "family").sortWithinPartitions("family", "doc", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []

        def open_(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_:
                gone = b.column(4).is_valid()
                rows = b.filter(gone)
                if rows.num_rows:
                    done.append(pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), rows.column(4)], names=["doc", "lo", "hi"]))
                if rows.num_rows < b.num_rows:
                    yield (b if not rows.num_rows else b.filter(pc.invert(gone))).select([0, 1, 2, 3])

        for out in _met(length, batch_bytes)(open_(batches)):
            yield out
            yield from done
            done.clear()
        yield from done

    spans = dealt.mapInArrow(run, "doc bigint, lo bigint, hi bigint")
    return met.filter(F.col("kind") == GONE).select("doc", "lo", "hi").union(spans)


def substring_dedup(docs: DataFrame, length: int = 100, gram: int = 32, digest: bool = True, **sizes) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text, ...); with digest=False `kept`, the
    bytes that are left, instead of their SHA-256.

    Texts are UTF-8 bytes, null as empty. Every byte covered by a `length`-byte string that also starts earlier goes: in a document
    of smaller doc_id, or earlier in the same one. Matches do not cross documents; overlapping ones count; all is judged on the
    input. Texts shorter than `length` lose nothing. Rows that repeat a doc_id (or have none: those come first) are documents of their own,
    in the order of a hash of the text. Extra columns are not read.

    1. Every string is assigned to an anchor (see `anchors`); runs of starts with one anchor are snippets, about 3% as many as bytes.
       Snippets of a window of texts that are equal byte by byte are combined at once, so a passage that very many documents hold leaves a
       window once; the others' places are known to go. The rest meets by anchor hash, and snippets that are alone with theirs are done.
    2. All others go, with their bytes, through families of suffix arrays (`SuffixFamily`), those of one anchor through the same: batch by
       batch in the order of age, each batch is sorted, merge-scanned against the levels for matches of `length` bytes, and what is
       new of it is merged into them. Hashes only route; bytes decide. Where the snippets of one anchor exceed `hot_bytes` together,
       their strings travel one by one and are routed by all of their bytes, so that no family holds an anchor that grows with the corpus.
    3. The spans of each document are cut out of its text.
    """
    # keyed.doc is declared never null (which it isn't), so that both joins with it share one exchange of the texts.
    back = ranked(docs.select("doc_id", "text"), nulls_first=True) if odd_ids(docs) else None
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text") if back is None else back.select(F.col("row").alias("doc"), "data.text")
    keyed = keyed.withColumn("doc", F.coalesce("doc", F.lit(0)))
    spans = removed_spans(keyed, length, gram, **sizes).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = keyed.join(spans, "doc", "left").select("doc", "text", "spans")
    last = "kept_sha256 string" if digest else "kept binary"
    out = rows.mapInArrow(_digested if digest else _remove, f"doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")
    if back is None:
        return out.withColumnRenamed("doc", "doc_id")
    return out.join(back.select(F.col("row").alias("doc"), "data.doc_id"), "doc").select("doc_id", "n_bytes", "n_removed", "n_spans", last.split()[0])


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
