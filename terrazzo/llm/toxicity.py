"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector w for all thresholds and theta_1 < theta_2 <
theta_3, over sparse counts of hashed words and word beginnings; the score is the expected grade. Labels say only toxic
or not, so grades of the toxic training rows, 1 to 3, are thirds of the margin that models fitted to the
other folds give them. The probability at which a text is rejected is set on held-back labelled rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Hasher, labelled_sample, map_batches, map_rows

BUCKETS = 1 << 20
BEGINNING = 4  # letters of a word beginning
GRADES, FOLDS = 4, 3
#: The bound on labelled rows a model is fitted to.
SAMPLE_ROWS = 8_000
#: A bucket is a feature if so many of the rows fitted to hold it, and its shares in toxic and clean ones differ by so many standard errors.
MIN_ROWS, MIN_Z = 4, 3.0
#: The share of held-back clean rows that may be rejected; with too few such rows to tell, the cut is no lower than CAUTIOUS.
FALSE_RATE, CAUTIOUS = 0.005, 0.25


@dataclass
class Ordinal:
    """weights by bucket, the ordered thresholds, and the P(grade >= 1) from which on a text is rejected."""

    weights: dict[int, float]
    theta: tuple[float, ...]
    cut: float = 0.5

    def at_least(self, z: float) -> list[float]:
        return [float(1 / (1 + np.exp(min(50.0, max(-50.0, t - z))))) for t in self.theta]


NEVER = Ordinal({}, (8.0, 9.0, 10.0))


class Counts:
    """A text's counts by bucket: of each word, and of its beginning if it is longer. With `only`, just those buckets."""

    def __init__(self, only: dict[int, float] | None = None, most: int = 200_000):
        self.hasher, self.only, self.most, self.seen = Hasher(BUCKETS), only, most, {}

    def _buckets(self, word: str) -> tuple[int, ...]:
        keys = (word, "^" + word[:BEGINNING]) if len(word) > BEGINNING else (word,)
        return tuple(h for h in map(self.hasher, keys) if self.only is None or h in self.only)

    def __call__(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        for word, n in Counter(WORD.findall(text.lower())).items() if text else ():
            buckets = self.seen.get(word)
            if buckets is None:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                buckets = self.seen[word] = self._buckets(word)
            for h in buckets:
                out[h] = out.get(h, 0) + n
        return out


@dataclass
class Rows:
    """Sparse rows: the entries of row i are at begin[i] : begin[i + 1]."""

    begin: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Rows:
        size = [len(r[0]) for r in rows]
        return cls(np.concatenate([[0], np.cumsum(size)]).astype(int), np.concatenate([np.asarray(r[0], np.int64) for r in rows]), np.log1p(np.concatenate([np.asarray(r[1], float) for r in rows])))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' places, and for each the place of its row in `rows`."""
        n = self.begin[rows + 1] - self.begin[rows]
        return np.repeat(self.begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(rows)), n)

    def margins(self, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at, row = self.entries(rows)
        return np.bincount(row, weight[self.bucket[at]] * self.value[at], len(rows))


def _telling(x: Rows, toxic: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each bucket is a feature, from `rows`."""
    at, row = x.entries(rows)
    is_toxic, held = toxic[rows] == 1, x.bucket[at]
    n1 = max(1, is_toxic.sum())
    n0 = max(1, len(rows) - n1)
    a, b = np.bincount(held[is_toxic[row]], minlength=BUCKETS), np.bincount(held[~is_toxic[row]], minlength=BUCKETS)
    share = (a + b) / len(rows)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return (a + b >= MIN_ROWS) & (np.abs(z) > MIN_Z)


def _descend(x: Rows, grade: np.ndarray, used: np.ndarray, rows: np.ndarray, grades: int, epochs: int = 12, rate: float = 0.3, l2: float = 1e-6, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by AdaGrad on the ordinal likelihood of `rows`, over the buckets that `used` marks."""
    rng = np.random.default_rng(5)
    w, raw = np.zeros(BUCKETS), np.concatenate([[2.0], np.zeros(grades - 2)])  # theta_1, then logs of the gaps
    gw, gr = np.full(BUCKETS, 1e-2), np.full(grades - 1, 1e-2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // batch)):
            at, row = x.entries(part)
            mine = used[x.bucket[at]]
            at, row = at[mine], row[mine]
            f, v, n = x.bucket[at], x.value[at], len(part)
            theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
            p = 1 / (1 + np.exp(np.clip(theta - np.bincount(row, w[f] * v, n)[:, None], -30, 30)))
            # likelihood of a grade: P(>= g) - P(>= g + 1)
            g, each = grade[part], np.arange(n)
            edge = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
            slope = np.hstack([np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))])
            like = np.maximum(edge[each, g] - edge[each, g + 1], 1e-9)
            up, down = slope[each, g] / like, slope[each, g + 1] / like
            d_margin = (down - up) / n
            d_theta = np.array([(up[g == k].sum() - down[g == k - 1].sum()) / n for k in range(1, grades)])
            d_raw = np.cumsum(d_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
            touched, place = np.unique(f, return_inverse=True)
            dw = np.bincount(place, d_margin[row] * v, len(touched)) + l2 * w[touched]
            gw[touched] += dw * dw
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            gr += d_raw * d_raw
            raw = raw - rate * d_raw / np.sqrt(gr)
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def fit(rows: list[tuple[list[int], list[int], int]]) -> Ordinal:
    """From (buckets, counts, toxic) rows. Without rows of both labels: a model that calls nothing toxic."""
    toxic = np.array([r[2] for r in rows], dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max() or not sum(len(r[0]) for r in rows):
        return NEVER
    x = Rows.of(rows)
    order = np.random.default_rng(3).permutation(len(rows))
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        out, rest = order[k::FOLDS], np.setdiff1d(order, order[k::FOLDS])
        if len(rest):
            margin[out] = x.margins(_descend(x, toxic, _telling(x, toxic, rest), rest, 2)[0], out)
    thirds = np.quantile(margin[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 0, 0, 1 + np.searchsorted(thirds, margin, "right"))
    held, used = (order[::5], np.setdiff1d(order, order[::5])) if len(rows) >= 50 else (order, order)
    features = _telling(x, toxic, used)
    w, theta = _descend(x, grade, features, used, GRADES)
    clean = held[toxic[held] == 0]
    p = np.sort(1 / (1 + np.exp(np.clip(theta[0] - x.margins(w, clean), -50, 50))))[::-1]
    may = int(FALSE_RATE * len(clean))
    cut = min(0.5, max(float(p[may]) if len(p) else 0.5, 0.0 if may else CAUTIOUS) + 1e-9)
    chosen = np.flatnonzero(w)
    return Ordinal(dict(zip(chosen.tolist(), w[chosen].tolist(), strict=True)), tuple(theta.tolist()), cut)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fit to at most `rows` labelled documents; only their hashed counts come to the driver."""
    counts = Counts()

    def features(text: str | None, label: int) -> tuple:
        c = counts(text)
        return list(c), list(c.values()), label

    sample = map_rows(labelled_sample(docs, labels, "toxic", rows), features, "buckets array<int>, counts array<int>, label int", ["text", "label"])
    got = sample.toArrow().to_pydict()
    return fit(sorted(zip(got["buckets"], got["counts"], got["label"], strict=True)))


def margins(texts: list[str | None], model: Ordinal, counts: Counts) -> np.ndarray:
    """w.x of each text; `counts` is of the model's buckets only."""
    found = [counts(t) for t in texts]
    w = np.fromiter((model.weights[h] for c in found for h in c), float)
    n = np.fromiter((k for c in found for k in c.values()), float)
    return np.bincount(np.repeat(np.arange(len(found)), [len(c) for c in found]), w * np.log1p(n), len(found)) if len(found) else np.zeros(0)


def score_toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (0 to 3), grade (the most likely), p_toxic (P(grade >= 1)), rejected, one row per input row, from whole texts.

    Null and empty texts score as a text without words. A null doc_id stays null; repeated rows each give
    a row; an empty table gives none; other columns are ignored. A very long text is read whole, in memory in proportion to it; of equally
    likely grades the lower one is given. Map-only; the model has at most BUCKETS weights.
    """
    counts = Counts(model.weights)

    def run(rows: list[list]):
        for doc_id, z in zip(rows[0], margins(rows[1], model, counts).tolist(), strict=True):
            p = model.at_least(z)
            yield doc_id, sum(p), int(np.argmax([1 - p[0], p[0] - p[1], p[1] - p[2], p[2]])), p[0], p[0] >= model.cut

    return map_batches(docs, run, "doc_id long, severity double, grade int, p_toxic double, rejected boolean", ["doc_id", "text"])


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of `docs` that the model doesn't reject, all columns as they were, whatever they are called. Nulls, empty and long texts, repeated rows and an empty table as in score_toxicity()."""
    counts = Counts(model.weights)

    @F.pandas_udf("boolean")
    def fine(s: pd.Series) -> pd.Series:
        return pd.Series([model.at_least(z)[0] < model.cut for z in margins(s.tolist(), model, counts).tolist()], dtype=bool)

    return docs.where(fine("text"))
