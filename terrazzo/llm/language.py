"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its letter n-grams (2 to 4, word ends included), hashed to buckets. Embeddings
and softmax are trained by stochastic gradient descent in numpy. A held-back part of the sample
fits the softmax's temperature and the probability below which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, map_batches, map_rows, one_of_each

BUCKETS, WIDTH = 1 << 13, 16
#: The bounds on what a model is fitted to: rows in all, and rows of a language.
SAMPLE_ROWS, LANGUAGE_ROWS = 4_000, 800
UNKNOWN = "und"


@dataclass
class Model:
    names: list[str]
    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.embed @ self.weight + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams by bucket; None if the text has no letter."""
    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return None
    a = np.where(letter, a, np.uint32(32))
    a = np.concatenate([[np.uint32(32)], a[letter | np.concatenate([[True], letter[:-1]])], [np.uint32(32)]])
    inner = a != 32
    out = []
    h = a * np.uint32(0x9E3779B1)
    for n in (2, 3, 4):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1 :] * np.uint32(0xC2B2AE35)
        fine = inner[:m] | inner[1 : m + 1] if n == 2 else np.logical_and.reduce([inner[i : i + m] for i in range(1, n - 1)])
        out.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(19))[fine])
    return np.bincount(np.concatenate(out), minlength=BUCKETS)


def _vector(counts: np.ndarray) -> np.ndarray:
    return (counts / max(1, counts.sum())).astype(np.float32)


def fit(rows: list[tuple[bytes, bytes, str]], epochs: int = 12, rate: float = 40.0) -> Model | None:
    """From (buckets, counts, language) rows; None without any."""
    if not rows:
        return None
    names = sorted({r[2] for r in rows})
    y = np.array([names.index(r[2]) for r in rows])
    rng = np.random.default_rng(7)
    order = rng.permutation(len(rows))
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(rows) >= 50 else (order, order)

    def dense(index: np.ndarray) -> np.ndarray:
        x = np.zeros((len(index), BUCKETS), np.float32)
        for i, k in enumerate(index):
            c = np.frombuffer(rows[k][1], np.uint32)
            x[i, np.frombuffer(rows[k][0], np.uint32)] = c / max(1, c.sum())
        return x

    m = Model(names, rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32), 1.0, 0.0)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 16)):
            x = dense(part)
            hidden = x @ m.embed
            p = m.probabilities(x)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            up = p @ m.weight.T
            m.weight -= 0.02 * step * hidden.T @ p
            m.bias -= 0.002 * step * p.sum(axis=0)
            m.embed -= step * x.T @ up
    z = np.vstack([m.logits(dense(part)) for part in np.array_split(held, 1 + len(held) // 200)])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())
        best = min(best, (loss, float(t)))
    m.temperature = best[1]
    s = np.exp(z / m.temperature - (z / m.temperature).max(axis=1, keepdims=True))
    p = s / s.sum(axis=1, keepdims=True)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
    down = np.argsort(-top)
    good = np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= 0.98
    m.reject_below = float(top[down][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return m


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 5) -> Model | None:
    """Fit to at most LANGUAGE_ROWS documents of a language and `rows` in all, none of fold 0; only gram counts come to the driver.

    The documents are those with the least hashes of their ids. A language's count, taken first, says below which
    hash about twice as many lie as are wanted, so no task ever gets more rows of a language than that.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(n=folds) != 0)).select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    counts = ids.groupBy("lang").agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), "lang").limit(rows)
    near = ids.join(F.broadcast(counts), "lang").where(F.col("_h") / F.lit(2.0**64) + 0.5 <= (2.0 * LANGUAGE_ROWS + 100) / F.col("_all")).dropDuplicates(["lang", "doc_id"])
    order = W.partitionBy("lang").orderBy("_h", "doc_id")
    ids = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= LANGUAGE_ROWS).orderBy("_n", "lang").limit(rows).select("doc_id").distinct()
    sample = one_of_each(docs.select("doc_id", "text", "lang").where("lang is not null").join(F.broadcast(ids), "doc_id"))

    def counts(text, lang):
        c = gram_counts(text)
        at = np.flatnonzero(c) if c is not None else np.empty(0, int)
        return at.astype(np.uint32).tobytes(), c[at].astype(np.uint32).tobytes() if len(at) else b"", lang

    got = map_rows(sample, counts, "buckets binary, counts binary, lang string", ["text", "lang"]).toArrow().to_pydict()
    return fit(sorted(x for x in zip(got["buckets"], got["counts"], got["lang"], strict=True) if x[0]))


def predict(docs: DataFrame, model: Model | None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, one row per input row, from whole texts.

    A text that is null or has no letter, or any text if nothing could be learned, is `und` with score 0, rejected. A null
    doc_id is not held out; repeated rows each give a row; an empty table gives none; other columns
    are ignored. A very long text is read whole, in memory in proportion to it; of equally likely languages the first by name is given. Map-only.
    """

    def run(rows: list[list]):
        for doc_id, held, text in zip(*rows, strict=True):
            c = gram_counts(text) if model else None
            if c is None:
                yield doc_id, held, UNKNOWN, 0.0, True
            else:
                p = model.probabilities(_vector(c))
                k = int(p.argmax())
                yield doc_id, held, model.names[k], min(1.0, float(p[k])), bool(p[k] < model.reject_below)

    out = docs.select("doc_id", F.coalesce(fold(n=folds) == 0, F.lit(False)).alias("held_out"), "text")
    return map_batches(out, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", ["doc_id", "held_out", "text"])
