"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, documents

UNKNOWN = "und"


class ByteGru:
    """Two gated recurrent units, one from either end, over the bytes of a stretch of text; each position gets class log-odds.

    Weights by direction: emb (257, 3H), the input side of the reset, update and candidate gates for each byte (256: no byte);
    u (H, 3H), the recurrent side. out (2H, K) and bias (K) give the classes from both states.
    """

    def __init__(self, classes: list[str], hidden: int = 8, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        h, k = hidden, len(classes)
        self.w = {"bias": np.zeros(k, np.float32), "out": rng.normal(0, 0.3, (2 * h, k)).astype(np.float32)}
        for d in "fb":
            self.w[f"emb_{d}"] = rng.normal(0, 0.3, (257, 3 * h)).astype(np.float32)
            self.w[f"u_{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States (T, B, H) of direction d over byte ids x (T, B); with keep, what the backward pass needs too."""
        h, (t_max, b) = self.hidden, x.shape
        emb, u = self.w[f"emb_{d}"], self.w[f"u_{d}"]
        out = np.empty((t_max, b, h), np.float32)
        kept = [None] * t_max
        s = np.zeros((b, h), np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            e = emb[x[t]]
            g = s @ u
            rz = e[:, : 2 * h] + g[:, : 2 * h]
            np.tanh(rz * np.float32(0.5), out=rz)
            rz = rz * np.float32(0.5) + np.float32(0.5)
            r, z = rz[:, :h], rz[:, h:]
            gn = g[:, 2 * h :]
            n = np.tanh(e[:, 2 * h :] + r * gn)
            new = n + z * (s - n)
            if keep:
                kept[t] = (s, r, z, n, gn)
            out[t] = s = new
        return (out, kept) if keep else out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """(T, B, K) for byte ids (T, B)."""
        w, h = self.w, self.hidden
        return self.states(x, "f") @ w["out"][:h] + self.states(x, "b") @ w["out"][h:] + w["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of every position's label y (B) and its gradients, by backpropagation through time."""
        w, h = self.w, self.hidden
        mask = (x < 256).astype(np.float32)
        count = max(1.0, float(mask.sum()))
        both = {d: self.states(x, d, keep=True) for d in "fb"}
        o = both["f"][0] @ w["out"][:h] + both["b"][0] @ w["out"][h:] + w["bias"]
        p = np.exp(o - o.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        cols = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, cols, y] + 1e-9) * mask).sum() / count)
        p[:, cols, y] -= 1
        p *= (mask / count)[:, :, None]
        grads = {"bias": p.sum(axis=(0, 1)), "out": np.concatenate([np.einsum("tbh,tbk->hk", both[d][0], p) for d in "fb"])}
        for d, part in (("f", w["out"][:h]), ("b", w["out"][h:])):
            u, kept = w[f"u_{d}"], both[d][1]
            d_out = p @ part.T
            d_emb, d_u = np.zeros_like(w[f"emb_{d}"]), np.zeros_like(u)
            ds = np.zeros((x.shape[1], h), np.float32)
            for t in range(x.shape[0] - 1, -1, -1) if d == "f" else range(x.shape[0]):
                s, r, z, n, gn = kept[t]
                ds = ds + d_out[t]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                d_in = np.concatenate([dr, dz, dn], axis=1)
                d_g = np.concatenate([dr, dz, dn * r], axis=1)
                d_u += s.T @ d_g
                np.add.at(d_emb, x[t], d_in)
                ds = ds * z + d_g @ u.T
            grads[f"emb_{d}"], grads[f"u_{d}"] = d_emb, d_u
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 0.02, seed: int = 0) -> float:
        """Adam on stretches x (N, T) of byte ids with classes y (N); the last loss."""
        rng, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            lr = rate * min(1.0, 4 * (steps - step + 1) / steps)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, texts: list[bytes], stretch: int = 128, columns: int = 4096) -> np.ndarray:
        """(texts, K): the mean over all positions of each text of the class probabilities.

        Every byte of every text is labelled. Texts are cut into stretches of `stretch` bytes, which the network reads side by side;
        at either end of a stretch it starts from rest. The last stretch of a text is padded, and the padding is not pooled.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        cuts = -(-lengths // stretch)
        total = np.zeros((len(texts), len(self.classes)))
        owner = np.repeat(np.arange(len(texts)), cuts)
        first = np.concatenate([[0], np.cumsum(cuts)])
        x = np.full(int(first[-1]) * stretch, 256, np.int16)
        for i, t in enumerate(texts):
            x[first[i] * stretch : first[i] * stretch + len(t)] = np.frombuffer(t, np.uint8)
        x = x.reshape(-1, stretch)
        for lo in range(0, len(x), columns):
            part = np.ascontiguousarray(x[lo : lo + columns].T)
            o = self.log_odds(part)
            o -= o.max(axis=2, keepdims=True)
            np.exp(o, out=o)
            o *= ((part < 256) / o.sum(axis=2))[:, :, None]
            np.add.at(total, owner[lo : lo + columns], o.sum(axis=0))
        return total / np.maximum(lengths, 1)[:, None]


def learn_languages(docs: DataFrame, sample: int = 4096, stretch: int = 128, steps: int = 400, seed: int = 0) -> ByteGru | None:
    """A ByteGru from docs(doc_id, text, lang); rows with null lang or no text are passed over. None if none is left.

    At most `sample` stretches of `stretch` bytes are looked at, shared evenly among the languages (one for each at least), one for each of a language's documents with the smallest hashes of doc_id, from a place that the hash gives.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.2 * each / n) * (1 << 30)))])
    chosen = known.filter(hashed <= below[F.col("lang")])
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - stretch // 2, F.lit(1)))
    chosen = chosen.select("lang", hashed.alias("h"), F.substring(F.col("text"), (at + 1).cast("int"), F.lit(stretch)).alias("part"))
    rows = chosen.orderBy("h", "part").limit(2 * max(sample, len(counts))).collect()
    classes = sorted(counts)
    x, y, taken = [], [], dict.fromkeys(classes, 0)
    for r in rows:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            b = np.frombuffer(r["part"].encode()[:stretch], np.uint8).astype(np.int16)
            x.append(np.concatenate([b, np.full(stretch - len(b), 256, np.int16)]))
            y.append(classes.index(r["lang"]))
    if not x:
        return None
    model = ByteGru(classes, seed=seed)
    model.train(np.stack(x), np.array(y), steps, seed=seed)
    return model


def predict_languages(docs: DataFrame, model: ByteGru | None, group_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text, ...).

    The language with the largest probability, pooled over every byte of the whole text, and that probability. `und`
    with score 0 where the text is null or has no letter, or nothing could be learnt. Repeated rows are predicted each for itself;
    other columns are not read. One pass, no shuffle; texts are read in groups of about `group_bytes`.
    """
    if model is not None:
        classes, hidden, weights = model.classes, model.hidden, model.w

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if model is None:
            return lang, score
        gru = ByteGru(classes, hidden)
        gru.w = weights
        todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        while todo:
            group, size = [], 0
            while todo and (not group or size + len(texts[todo[-1]]) < group_bytes):
                group.append(todo.pop())
                size += len(texts[group[-1]])
            p = gru.pooled([texts[i].encode() for i in group])
            for i, k, s in zip(group, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[i], score[i] = classes[k], float(min(1.0, s))
        return lang, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict([t.as_py() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn_languages(docs.filter(crc_mod("doc_id", 5) != 0))
    out = predict_languages(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
