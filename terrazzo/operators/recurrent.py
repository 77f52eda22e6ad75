"""Recurrent forecasters in numpy, trained by backpropagation through time: plain, gated, LSTM, and an LSTM whose gates are
convolutions along a cdf's columns. A task trains one key's network; weights are tables, so they can be kept and gone on with.

A network reads windows of `lag` rows scaled to 0..1 and predicts how the next row differs from the last. What it reads is
(rows, columns, features): for the fully connected kinds one column with all values as features, for the convolutional one a
column for each value, with those at its sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

HIDDEN = {"rnn": 16, "gru": 16, "lstm": 16, "convlstm": 12}
GATES = {"rnn": 1, "gru": 3, "lstm": 4, "convlstm": 4}
Weights = dict[str, np.ndarray]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -50, 50)))


def _around(m: np.ndarray) -> np.ndarray:
    """Features of each column and of the ones beside it; the outermost columns are repeated."""
    padded = np.concatenate([m[:, :1], m, m[:, -1:]], axis=1)
    return np.concatenate([padded[:, :-2], padded[:, 1:-1], padded[:, 2:]], axis=2)


def _around_back(d: np.ndarray) -> np.ndarray:
    """The gradient of m from that of _around(m)."""
    left, mid, right = np.split(d, 3, axis=2)
    out = mid.copy()
    out[:, :-1] += left[:, 1:]
    out[:, 0] += left[:, 0]
    out[:, 1:] += right[:, :-1]
    out[:, -1] += right[:, -1]
    return out


def fresh(kind: str, wide: int, seed: int = 3) -> Weights:
    """Weights to begin with."""
    rng, h = np.random.default_rng(seed), HIDDEN[kind]
    features, out = (3, 1) if kind == "convlstm" else (wide, wide)
    size = features + (3 * h if kind == "convlstm" else h)
    w = {"w": rng.normal(0, 1 / np.sqrt(size), (size, GATES[kind] * h)), "b": np.zeros(GATES[kind] * h), "v": rng.normal(0, 0.1 / np.sqrt(h), (h, out)), "c": np.zeros(out)}
    if kind in ("lstm", "convlstm"):
        w["b"][h : 2 * h] = 1.0  # the gate that remembers
    return w


def loss_and_gradient(w: Weights, x: np.ndarray, y: np.ndarray, kind: str) -> tuple[float, Weights, np.ndarray]:
    """Mean squared error of the predictions for windows x (n, lag, wide) against rows y (n, wide), its gradient by weight, and the predictions."""
    conv, hid = kind == "convlstm", HIDDEN[kind]
    n, lag, wide = x.shape
    columns = wide if conv else 1
    rows = [x[:, t, :, None] if conv else x[:, t, None, :] for t in range(lag)]
    spread, back = (_around, _around_back) if conv else ((lambda m: m), (lambda d: d))
    h = c = np.zeros((n, columns, hid))
    kept = []
    for r in rows:
        u = spread(np.concatenate([r, h], axis=2))
        if kind == "gru":
            a = u @ w["w"][:, : 2 * hid] + w["b"][: 2 * hid]
            z, reset = _sigmoid(a[..., :hid]), _sigmoid(a[..., hid:])
            u2 = np.concatenate([r, reset * h], axis=2)
            new = np.tanh(u2 @ w["w"][:, 2 * hid :] + w["b"][2 * hid :])
            kept.append((u, u2, h, z, reset, new))
            h = (1 - z) * new + z * h
        elif kind == "rnn":
            kept.append((u,))
            h = np.tanh(u @ w["w"] + w["b"])
            kept[-1] += (h,)
        else:
            a = u @ w["w"] + w["b"]
            i, f, o, g = _sigmoid(a[..., :hid]), _sigmoid(a[..., hid : 2 * hid]), _sigmoid(a[..., 2 * hid : 3 * hid]), np.tanh(a[..., 3 * hid :])
            before, c = c, f * c + i * g
            kept.append((u, i, f, o, g, before, np.tanh(c)))
            h = o * kept[-1][-1]
    guess = x[:, -1] + (h @ w["v"] + w["c"]).reshape(n, wide)
    e = guess - y
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    d = (2 * e / e.size).reshape(n, columns, -1)
    grad["v"] = np.einsum("nch,nco->ho", h, d)
    grad["c"] = d.sum(axis=(0, 1))
    dh, dc = d @ w["v"].T, np.zeros_like(h)
    for t in reversed(range(lag)):
        size = rows[t].shape[2]
        if kind == "gru":
            u, u2, old, z, reset, new = kept[t]
            dn = dh * (1 - z) * (1 - new * new)
            du2 = dn @ w["w"][:, 2 * hid :].T
            dr = du2[..., size:] * old * reset * (1 - reset)
            dz = dh * (old - new) * z * (1 - z)
            da = np.concatenate([dz, dr], axis=2)
            grad["w"][:, 2 * hid :] += np.einsum("ncf,ncg->fg", u2, dn)
            grad["b"][2 * hid :] += dn.sum(axis=(0, 1))
            grad["w"][:, : 2 * hid] += np.einsum("ncf,ncg->fg", u, da)
            grad["b"][: 2 * hid] += da.sum(axis=(0, 1))
            dh = dh * z + du2[..., size:] * reset + (da @ w["w"][:, : 2 * hid].T)[..., size:]
            continue
        if kind == "rnn":
            u, out = kept[t]
            da = dh * (1 - out * out)
        else:
            u, i, f, o, g, before, th = kept[t]
            dc = dc + dh * o * (1 - th * th)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dc = dc * f
        grad["w"] += np.einsum("ncf,ncg->fg", u, da)
        grad["b"] += da.sum(axis=(0, 1))
        dh = back(da @ w["w"].T)[..., size:]
    return float((e * e).mean()), grad, guess


def _scaled(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = y.min(axis=0), y.max(axis=0)
    span = np.where(high > low, high - low, 1.0)
    return (y - low) / span, low, span


def train(y: np.ndarray, lag: int, kind: str, epochs: int = 150, rate: float = 0.01, patience: int = 20, start: Weights | None = None, seed: int = 3) -> Weights:
    """Adam on all windows of a (time, column) array but the last fifth, whose error says when to stop and which weights to keep."""
    u, _, _ = _scaled(y)
    x = np.stack([u[i : i + lag] for i in range(len(u) - lag)])
    target = u[lag:]
    held = max(1, len(x) // 5)
    w = {k: v.copy() for k, v in (start or fresh(kind, y.shape[1], seed)).items()}
    m, s = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    best, kept, since = np.inf, w, 0
    for t in range(1, epochs + 1):
        error = loss_and_gradient(w, x[-held:], target[-held:], kind)[0]
        if error < best - 1e-9:
            best, kept, since = error, {k: v.copy() for k, v in w.items()}, 0
        elif (since := since + 1) > patience:
            break
        _, grad, _ = loss_and_gradient(w, x[:-held] if len(x) > held else x, target[:-held] if len(x) > held else target, kind)
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-9)
    return kept


def roll(w: Weights, y: np.ndarray, lag: int, steps: int, kind: str) -> np.ndarray:
    """The rows after y, each from those before it."""
    u, low, span = _scaled(y)
    hist = list(u)
    for _ in range(steps):
        x = np.array(hist[-lag:])[None]
        hist.append(loss_and_gradient(w, x, x[:, -1], kind)[2][0])
    return np.array(hist[len(u) :]) * span + low


def forecaster(kind: str):
    """As in series.FORECASTERS: trained on what it is given, then rolled ahead; a series too short to train on repeats its last row."""

    def ahead(y: np.ndarray, lag: int, steps: int) -> np.ndarray:
        if len(y) <= lag + 2:
            return np.repeat(y[-1:], steps, axis=0)
        return roll(train(y, lag, kind), y, lag, steps, kind)

    return ahead


def _flat(w: Weights) -> list[float]:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).tolist()


def _shaped(flat, kind: str, wide: int) -> Weights:
    out, at = {}, 0
    for k, v in sorted(fresh(kind, wide).items()):
        out[k] = np.array(flat[at : at + v.size]).reshape(v.shape)
        at += v.size
    return out


def trained_networks(series: DataFrame, key: str, lag: int, kind: str, warm: DataFrame | None = None, epochs: int = 150) -> DataFrame:
    """(key, kind, weights) of a network of each key's cdfs (time_id, cdf); with `warm`, an earlier such table, from those weights on. Keys with too short a series get none."""
    name = series.schema[key].dataType.simpleString()
    rows = series.select(key, "time_id", "cdf")
    if warm is not None:
        rows = rows.join(warm.select(key, "weights"), key, "left")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time_id")
        y = np.vstack(g.cdf.to_list()).astype(float)
        if len(y) <= lag + 2:
            return pd.DataFrame({key: g[key].iloc[:0], "kind": pd.Series([], dtype=object), "weights": pd.Series([], dtype=object)})
        old = g.weights.iloc[0] if "weights" in g and g.weights.iloc[0] is not None else None
        w = train(y, lag, kind, epochs, start=None if old is None else _shaped(old, kind, y.shape[1]))
        return pd.DataFrame({key: [g[key].iloc[0]], "kind": [kind], "weights": [_flat(w)]})

    return rows.groupBy(key).applyInPandas(fit, f"{key} {name}, kind string, weights array<double>")


def network_forecasts(series: DataFrame, networks: DataFrame, key: str, lag: int, steps: int) -> DataFrame:
    """(key, time_id, cdf) for the `steps` intervals after each key's series, by networks as trained_networks() gives them."""
    name = series.schema[key].dataType.simpleString()
    rows = series.select(key, "time_id", "cdf").join(networks.select(key, "kind", "weights"), key)

    def ahead(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time_id")
        y, kind = np.vstack(g.cdf.to_list()).astype(float), g.kind.iloc[0]
        out = roll(_shaped(g.weights.iloc[0], kind, y.shape[1]), y, lag, steps, kind)
        return pd.DataFrame({key: [g[key].iloc[0]] * steps, "time_id": int(g.time_id.iloc[-1]) + 1 + np.arange(steps), "cdf": list(out)})

    return rows.groupBy(key).applyInPandas(ahead, f"{key} {name}, time_id long, cdf array<double>")
