"""Quality by a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)): all pairwise interactions at a cost
linear in the features. Statistics enter as one-hot bins, so they interact with words and each other.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, fold, labelled_sample, map_batches, map_rows

WORD_BUCKETS, RANK = 1 << 14, 8
#: The bound on labelled rows a model is fitted to.
SAMPLE_ROWS = 6_000
# Upper edges of the bins of each statistic.
EDGES: dict[str, tuple[float, ...]] = {
    "chars": (40, 200, 500, 1000, 2000, 5000, 20000),
    "words": (5, 10, 20, 50, 100, 300, 1000, 5000),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14),
    "symbols": (0.001, 0.01, 0.03, 0.1, 0.3),
    "upper": (0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.3),
    "exclaimed": (0.001, 0.01, 0.03, 0.1, 0.3),
    "variety": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "repeats": (0.001, 0.02, 0.05, 0.1, 0.2, 0.5),
    "lines": (0.01, 0.1, 0.3, 0.6),
    "top_word": (0.02, 0.05, 0.1, 0.2, 0.4),
}
FEATURES = WORD_BUCKETS + sum(len(e) + 1 for e in EDGES.values())


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, (at, x) in enumerate(rows):
            vx = self.v[at] * x[:, None]
            s = vx.sum(axis=0)
            out[i] = self.w0 + self.w[at] @ x + 0.5 * float((s * s).sum() - (vx * vx).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def statistics(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    thirds = len(words) - 2
    return {
        "chars": len(text),
        "words": len(words),
        "word_length": sum(map(len, words)) / n,
        "symbols": sum(map(text.count, "#*$%&|<>")) / n,
        "upper": sum(map(str.isupper, words)) / n,
        "digits": sum(map(text.count, "0123456789")) / chars,
        "exclaimed": sum(map(text.count, "!?")) / n,
        "variety": len(counts) / n,
        "repeats": 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / thirds if thirds > 0 else 0.0,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "top_word": max(counts.values(), default=0) / n,
    }


def featurise(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words weigh log1p(count) over the norm, bins weigh 1/2."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    by: dict[int, int] = {}
    for w, c in counts.items():
        h = hasher(w)
        by[h] = by.get(h, 0) + c
    x = np.log1p(np.fromiter(by.values(), np.float64, len(by)))
    x /= max(1e-9, float(np.sqrt(x @ x)))
    bins, at = [], WORD_BUCKETS
    for (name, edges), value in zip(EDGES.items(), (s := statistics(text, words, counts)).values(), strict=True):
        bins.append(at + int(np.searchsorted(edges, s[name], "right")))
        at += len(edges) + 1
    return np.concatenate([np.fromiter(by, np.int64, len(by)), np.array(bins)]), np.concatenate([x, np.full(len(bins), 0.5)])


def fit(rows: list[tuple[bytes, bytes, int]], epochs: int | None = None, rate: float = 0.08, l2: float = 1e-5) -> Machine:
    """AdaGrad on the logistic loss of (features, values, label) rows; without any, every score is one half."""
    rng = np.random.default_rng(11)
    m = Machine(0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK)))
    if not rows:
        return Machine(0.0, m.w, m.v * 0)
    at = [np.frombuffer(r[0], np.uint32).astype(np.int64) for r in rows]
    x = [np.frombuffer(r[1], np.float32).astype(np.float64) for r in rows]
    y = np.array([r[2] for r in rows], float)
    p = min(0.999, max(0.001, y.mean()))
    m.w0 = float(np.log(p / (1 - p)))
    gw, gv = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2)
    for _ in range(epochs or max(10, min(80, 40_000 // len(rows)))):  # few rows are gone over more often
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            f = np.concatenate([at[i] for i in part])
            xs = np.concatenate([x[i] for i in part])
            size = np.array([len(at[i]) for i in part])
            row = np.repeat(np.arange(len(part)), size)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            vx = m.v[f] * xs[:, None]
            s = np.add.reduceat(vx, start)
            z = m.w0 + np.add.reduceat(m.w[f] * xs, start) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), start))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            m.w0 -= rate * float(g.sum())
            dw, dv = np.zeros(FEATURES), np.zeros((FEATURES, RANK))
            np.add.at(dw, f, g[row] * xs)
            np.add.at(dv, f, (g[row] * xs)[:, None] * (s[row] - vx))
            used = np.unique(f)
            dw, dv = dw[used] + l2 * m.w[used], dv[used] + l2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 3) -> Machine:
    """Fit to at most `rows` labelled documents outside fold 1; only their hashed features come to the driver."""
    hasher = Hasher(WORD_BUCKETS)

    def features(text, label):
        f, x = featurise(text, hasher)
        return f.astype(np.uint32).tobytes(), x.astype(np.float32).tobytes(), label

    sample = labelled_sample(docs, labels.where(fold(n=folds) != 1), "quality", rows)
    got = map_rows(sample, features, "features binary, x binary, label int", ["text", "label"]).toArrow().to_pydict()
    return fit(sorted(zip(got["features"], got["x"], got["label"], strict=True)))


def classify(docs: DataFrame, model: Machine, folds: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row, from whole texts.

    Null and empty texts are scored by their bins alone. A null doc_id is not held out; repeated rows each give
    a row; an empty table gives none; other columns are ignored. A very long text is read whole, in memory in proportion to it; a score of
    exactly one half predicts 1. Map-only; the model's size is fixed.
    """
    hasher = Hasher(WORD_BUCKETS)

    def run(rows: list[list]):
        for doc_id, held, text in zip(*rows, strict=True):
            s = float(model.scores([featurise(text, hasher)])[0])
            yield doc_id, held, s, int(s >= 0.5)

    out = docs.select("doc_id", F.coalesce(fold(n=folds) == 1, F.lit(False)).alias("held_out"), "text")
    return map_batches(out, run, "doc_id long, held_out boolean, score double, predicted int", ["doc_id", "held_out", "text"])
