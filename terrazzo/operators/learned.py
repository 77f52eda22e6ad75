"""Learned positions: a model per leaf predicts a key's place, and error bounds over all its rows make the search exact.

The default model is least squares by built-in aggregates. A one-hidden-layer network, fitted in numpy to one
leaf at a time, is the alternative; either gives the same answers, since bounds are taken over all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import numbered, numbered_within

MODEL_ROWS = 4096  # rows of a leaf that a network is fitted to, evenly spaced
HELD_ROWS = 1 << 17  # rows of leaves that a task holds to fit them together, about
TRAINED_ROWS = 1 << 13  # of them that one call trains on
MOST_NODES = 1 << 14  # of an inner stage of a recursive index
SLACK = 1e-6
PAGE_ITEMS = 146  # items of 28 bytes on a page of 4096


def leaf_positions(rows: DataFrame) -> DataFrame:
    """`rows` (leaf, z, id, ...) with `pos`, the place in the leaf in order of z, id, from 0. A leaf may be of any size."""
    return numbered_within(rows, "leaf", ["z", "id"])


def routed(rows: DataFrame, leaves: int) -> DataFrame:
    """Recursive-model routing: a linear model of all rows' ranks by code picks one of `leaves` leaves.

    The first stage is least squares on rank, which needs no global sort: ranks come from value ranges.
    """
    ranked = numbered(rows, ["z", "id"], name="_rank")
    m = ranked.agg(F.regr_slope(F.col("_rank").cast("double"), F.col("z").cast("double")).alias("a"), F.regr_intercept(F.col("_rank").cast("double"), F.col("z").cast("double")).alias("b"), F.count("*").alias("n")).first()
    return with_leaf(rows, (m.a or 0.0, m.b or 0.0, m.n), leaves)


def with_leaf(rows: DataFrame, stage: tuple[float, float, int], leaves: int) -> DataFrame:
    a, b, n = stage
    place = F.floor((F.lit(a) * F.col("z") + F.lit(b)) * F.lit(leaves / max(1, n))).cast("long")
    return rows.withColumn("leaf", F.greatest(F.lit(0).cast("long"), F.least(place, F.lit(leaves - 1).cast("long"))))


def _in_stage(place: Column, nodes: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(place).cast("long"), F.lit(nodes - 1).cast("long")))


def stage_models(rows: DataFrame, stages: list[int]) -> tuple[list[DataFrame], int]:
    """Models of a recursive index with stages[i] nodes at stage i (stages[0] is 1), and the rows' number.

    Each inner stage is a table (leaf, z0, a, b): lines of the rows' overall places by code, for the rows that the stage
    before sends to a node. A node without rows has the line of the one before it, or, at the start, after it. Inner
    stages have MOST_NODES nodes at most, which makes them small enough to broadcast; the last one is bound by nothing.
    """
    if stages[0] != 1 or max(stages[:-1]) > MOST_NODES:
        raise ValueError(f"the first stage has one node, inner ones {MOST_NODES} at most")
    ranked = numbered(rows, ["z", "id"], name="_rank").checkpoint()
    n = ranked.count()
    models: list[DataFrame] = []
    for i, nodes in enumerate(stages[:-1]):
        at = sent_through(ranked, models, stages[: i + 1], n)
        base = at.groupBy("leaf").agg(F.min("z").alias("z0"))
        near = at.join(F.broadcast(base), "leaf").withColumn("_u", (F.col("z") - F.col("z0")).cast("double"))  # base: a row for each node
        y = F.col("_rank").cast("double")
        fit = near.groupBy("leaf", "z0").agg(F.regr_slope(y, F.col("_u")).alias("a"), F.regr_intercept(y, F.col("_u")).alias("b"), F.avg(y).alias("_m"))
        fit = fit.select("leaf", F.struct("z0", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", "_m").alias("b")).alias("_line"))
        every = rows.sparkSession.range(nodes).withColumnRenamed("id", "leaf").join(fit, "leaf", "left")
        by = W.orderBy("leaf")  # over a stage's nodes
        line = F.coalesce(F.last("_line", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.first("_line", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing)))
        models.append(every.withColumn("_line", line).select("leaf", "_line.*").checkpoint())
    return models, n


def sent_through(rows: DataFrame, models: list[DataFrame], stages: list[int], n: int) -> DataFrame:
    """`rows` (z, ...) with `leaf`, the node of the last of `stages` that the models of those before send their codes to. Rows and probes with one code take one way."""
    at = rows.withColumn("leaf", F.lit(0).cast("long"))
    for m, nodes in zip(models, stages[1:]):
        guess = F.col("a") * (F.col("z") - F.col("z0")).cast("double") + F.col("b")
        at = at.join(F.broadcast(m), "leaf").select(*rows.columns, _in_stage(guess * F.lit(nodes / max(1, n)), nodes).alias("leaf"))
    return at


def with_edges(entries: DataFrame) -> DataFrame:
    """(leaf, z, pos) to fit models to: a leaf's rows, and one beyond each end, the last code before the leaf at -1 and the
    first code after it at its size. Fits that take them in meet their neighbours' instead of bending away at the borders."""
    ends = entries.groupBy("leaf").agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"), F.count("*").alias("_n"))
    at = numbered(ends, ["_lo", "leaf"], name="_i")
    before = at.select("leaf", "_i").join(at.select((F.col("_i") + 1).alias("_i"), F.col("_hi").alias("z")), "_i").select("leaf", "z", F.lit(-1).cast("long").alias("pos"))
    after = at.select("leaf", "_i", "_n").join(at.select((F.col("_i") - 1).alias("_i"), F.col("_lo").alias("z")), "_i").select("leaf", "z", F.col("_n").alias("pos"))
    return entries.select("leaf", "z", "pos").unionByName(before).unionByName(after)


def linear_models(entries: DataFrame) -> DataFrame:
    """(leaf, n, z0, a, b) by least squares of pos on z - z0; z0 is the leaf's first code."""
    base = entries.groupBy("leaf").agg(F.min("z").alias("z0"))
    near = entries.join(base, "leaf").withColumn("_u", (F.col("z") - F.col("z0")).cast("double"))
    y = F.col("pos").cast("double")
    fit = near.groupBy("leaf", "z0").agg(F.count("*").alias("n"), F.regr_slope(y, F.col("_u")).alias("a"), F.regr_intercept(y, F.col("_u")).alias("b"), F.avg(y).alias("_m"))
    return fit.select("leaf", "n", "z0", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", "_m").alias("b"))


def predicted() -> Column:
    return F.col("a") * (F.col("z") - F.col("z0")).cast("double") + F.col("b")


def with_bounds(entries: DataFrame, models: DataFrame, guess: Column | None = None) -> DataFrame:
    """`models` with min_err, max_err: every row's guess - pos lies between them, by SLACK at least, so that rounding in another engine or build of the model leaves them valid."""
    err = (predicted() if guess is None else guess) - F.col("pos")
    bounds = entries.join(models, "leaf").groupBy("leaf").agg(F.floor(F.min(err) - SLACK).cast("long").alias("min_err"), F.ceil(F.max(err) + SLACK).cast("long").alias("max_err"))
    return models.join(bounds, "leaf")


def learned_lookup(entries: DataFrame, models: DataFrame, probes: DataFrame) -> DataFrame:
    """(qid, id, slots) for probes (qid, qx, qy, z, leaf): rows at the probe's place within the model's search interval."""
    p = probes.join(models, "leaf").withColumn("_g", predicted())
    p = p.select("leaf", "qid", "qx", "qy", F.ceil(F.col("_g") - F.col("max_err")).alias("lo"), F.floor(F.col("_g") - F.col("min_err")).alias("hi"))
    e = entries.select("leaf", "x", "y", "id", "pos")
    hit = e.join(p, (e.leaf == p.leaf) & F.col("pos").between(F.col("lo"), F.col("hi")) & (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy")))
    return hit.select("qid", "id", (F.col("hi") - F.col("lo") + 1).alias("slots"))


def lookup_pages(models: DataFrame) -> DataFrame:
    """(leaf, slots, pages) of a lookup's search interval."""
    slots = F.col("max_err") - F.col("min_err") + 1
    return models.select("leaf", slots.alias("slots"), F.ceil(slots / PAGE_ITEMS).cast("long").alias("pages"))


def violations(entries: DataFrame, models: DataFrame, guess: Column | None = None) -> DataFrame:
    """(leaf, n, outside): rows that the bounds miss; zero unless models are stale."""
    err = (predicted() if guess is None else guess) - F.col("pos")
    out = (err < F.col("min_err")) | (err > F.col("max_err"))
    rows = entries.join(models.drop("n"), "leaf")
    return rows.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if(out).alias("outside"))


def relu(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def elu(v: Column) -> Column:
    return F.when(v > 0, v).otherwise(F.exp(v) - 1)


def scaled(v: Column, low: Column, high: Column) -> Column:
    """Into 0..1; a constant column becomes its difference from it."""
    return F.when(high == low, v - low).otherwise((v - low) / (high - low))


def unscaled(v: Column, low: Column, high: Column) -> Column:
    """Back from 0..1, clamped."""
    return F.when(high == low, low).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (high - low) + low)


def network_guess(units: int | None = None) -> Column:
    """The network's place for z, from columns w0, b0, w1 (arrays), b1, in_min, in_max, out_max.

    units: what networks have at most; the sum is then written out, which Spark compiles, and adds up in the same order, so to the same.
    """
    u = scaled(F.col("z").cast("double"), F.col("in_min"), F.col("in_max"))
    if units is None:
        hidden = F.zip_with("w0", "b0", lambda w, b: relu(w * u + b))
        out = F.aggregate(F.zip_with(hidden, F.col("w1"), lambda h, w: h * w), F.col("b1"), lambda a, v: a + v)
    else:
        of = lambda name, k: F.coalesce(F.get(name, F.lit(k)), F.lit(0.0))
        out = F.col("b1")
        for k in range(units):
            out = out + relu(of("w0", k) * u + of("b0", k)) * of("w1", k)
    return F.round(unscaled(out, F.lit(0.0), F.col("out_max"))).cast("double")


def most_units(models: DataFrame) -> int:
    """What the networks of `models` have at most, for network_guess()."""
    return models.agg(F.max(F.size("w0"))).first()[0] or 0


def fresh_network(hidden: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights to begin with: hinges spread over the input."""
    w1 = np.random.default_rng(seed).normal(0, 0.1, hidden)
    w1[0] = 1.0
    return np.ones(hidden), -np.linspace(0, 1, hidden, endpoint=False), w1, 0.0


def _flat(net: tuple, hidden: int) -> np.ndarray:
    """(w0, b0, w1, b1) as one row; units beyond the network's own are zero, which changes neither its values nor its training."""
    w0, b0, w1 = (np.pad(np.array(v, float, ndmin=1), (0, hidden - len(v))) for v in net[:3])
    return np.concatenate([w0, b0, w1, np.array(net[3], float, ndmin=1)])


def train_networks(u: np.ndarray, y: np.ndarray, sizes: np.ndarray, start: np.ndarray, steps: int = 300, rate: float = 0.02, patience: int = 50, last: bool = False) -> np.ndarray:
    """Adam on the squared errors of 1-hidden-1 networks with ReLU, all at once: row i of `start`, (w0, b0, w1, b1) in one, goes with the first sizes[i] of u[i], y[i]; the others are 0.

    A network stops when its loss hasn't become less for `patience` steps. The best weights met by each, or with `last` the last ones.
    """
    k, width = u.shape
    hid = start.shape[1] // 3
    real = (np.arange(width) < sizes[:, None]).astype(float)
    x = np.stack([u, real], axis=1)  # (k, 2, width): padding has no constant, so it switches no unit on
    xt = x.transpose(0, 2, 1)
    p = start.copy()
    m, v = np.zeros_like(p), np.zeros_like(p)
    best, kept, since, active = np.full(k, np.inf), p.copy(), np.zeros(k, int), np.ones(k, bool)
    for t in range(1, steps + 1):
        h = p[:, : 2 * hid].reshape(k, 2, hid).transpose(0, 2, 1) @ x
        np.maximum(h, 0, out=h)
        w1 = p[:, 2 * hid : 3 * hid]
        e = (w1[:, None, :] @ h)[:, 0] + p[:, -1:] * real - y
        loss = np.einsum("km,km->k", e, e) / sizes
        better = active & (loss < best - 1e-9)
        best, kept, since = np.where(better, loss, best), np.where(better[:, None], p, kept), np.where(better, 0, since + 1)
        active &= since <= patience
        if not active.any():
            break
        g = 2 * e / sizes[:, None]
        out = (h @ g[:, :, None])[:, :, 0]
        back = (((h > 0) * g[:, None, :]) @ xt).transpose(0, 2, 1) * w1[:, None, :]
        d = np.concatenate([back.reshape(k, 2 * hid), out, g.sum(axis=1, keepdims=True)], axis=1)
        m = 0.9 * m + 0.1 * d
        v = 0.999 * v + 0.001 * d * d
        p = np.where(active[:, None], p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9), p)
    return p if last else kept


def train_network(u: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 300, start: tuple | None = None, rate: float = 0.02, patience: int = 50, seed: int = 1, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """train_networks() of one. `start`: weights to go on from."""
    net = start or fresh_network(hidden, seed)
    p = train_networks(u[None], y[None], np.array([len(u)]), _flat(net, len(net[0]))[None], steps, rate, patience, last)[0]
    w0, b0, w1 = p[:-1].reshape(3, -1)
    return w0, b0, w1, float(p[-1])


def _rows_of(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy()


def _fitted(t: pa.Table, hidden: int, steps: int, threshold: float | None, tries: int, last: bool) -> pa.RecordBatch:
    """Networks of whole leaves: for each its head (pos -1, n, in_min, in_max, old), then its rows."""
    heads = np.flatnonzero(_rows_of(t, "pos") < 0)
    sizes = np.diff(np.append(heads, t.num_rows)) - 1
    at = t.take(pa.array(heads))
    leaf, n, lo, hi = (_rows_of(at, c) for c in ("leaf", "n", "in_min", "in_max"))
    old = [None if w is None else tuple(json.loads(w)[c] for c in ("w0", "b0", "w1", "b1")) for w in at["old"].to_pylist()]
    hidden = max([hidden, *(len(w[0]) for w in old if w)])
    first = _flat(fresh_network(hidden), hidden)
    start = np.array([first if w is None else _flat(w, hidden) for w in old])
    z, pos = pc.fill_null(t["z"], 0).to_numpy().astype(float), _rows_of(t, "pos").astype(float)
    wide, top = np.where(hi == lo, 1.0, hi - lo), np.maximum(1, n - 1).astype(float)
    nets = np.empty_like(start)
    by_size = np.argsort(sizes, kind="stable")
    while len(by_size):
        # as many leaves, from the largest, as fill about TRAINED_ROWS with their padding
        width = sizes[by_size[-1]]
        many = min(len(by_size), max(1, TRAINED_ROWS // width))
        by_size, some = np.split(by_size, [len(by_size) - many])
        real = np.arange(width) < sizes[some, None]
        of = np.where(real, heads[some, None] + 1 + np.arange(width), 0)
        u = np.where(real, (z[of] - lo[some, None]) / wide[some, None], 0.0)
        place = np.where(real, pos[of], 0.0)
        y = place / top[some, None]

        def error(p: np.ndarray, of: np.ndarray) -> np.ndarray:
            """The widths of the error intervals over these rows."""
            w0, b0, w1 = (p[:, i * hidden : (i + 1) * hidden, None] for i in range(3))
            guess = (np.maximum(u[of, None, :] * w0 + b0, 0) * w1).sum(axis=1) + p[:, -1:]
            e = np.round(np.clip(guess, 0, 1) * top[some[of], None]) - place[of]
            return np.where(real[of], e, -np.inf).max(axis=1) - np.where(real[of], e, np.inf).min(axis=1)

        best = train_networks(u, y, sizes[some], start[some], steps, last=last)
        if threshold is not None and tries > 1:
            least = error(best, np.arange(len(some)))
            open_ = np.flatnonzero(least > threshold)  # those whose latest try was too wide
            for k in range(1, tries):
                if not len(open_):
                    break
                again = _flat(fresh_network(hidden, 1 + k), hidden)
                p = train_networks(u[open_], y[open_], sizes[some[open_]], np.repeat(again[None], len(open_), axis=0), steps, last=last)
                found = error(p, open_)
                won = found < least[open_]
                best[open_[won]], least[open_[won]] = p[won], found[won]
                open_ = open_[found > threshold]
        nets[some] = best
    arrays = [pa.array(list(nets[:, i * hidden : (i + 1) * hidden]), pa.list_(pa.float64())) for i in range(3)]
    return pa.record_batch([pa.array(leaf), pa.array(n), *arrays, pa.array(nets[:, -1]), pa.array(lo), pa.array(hi), pa.array(top)], names=["leaf", "n", "w0", "b0", "w1", "b1", "in_min", "in_max", "out_max"])


def network_models(entries: DataFrame, hidden: int = 16, steps: int = 300, warm: DataFrame | None = None, threshold: float | None = None, tries: int = 1, last: bool = False, spans: DataFrame | None = None) -> DataFrame:
    """(leaf, n, w0, b0, w1, b1, in_min, in_max, out_max): a network per leaf, fitted to MODEL_ROWS evenly spaced rows of it at most.

    spans: (leaf, in_min, in_max), the codes that the networks take for 0 and 1; default: the leaf's first and last.
    warm: earlier models to go on from. With a threshold, a leaf whose error interval over those rows is wider is fitted
    again from other weights, `tries` times in all at most, and keeps the narrowest. last: see train_networks().

    What a leaf has once, sizes and old weights, comes as one row before its rows. A task reads its leaves in order and fits
    those of HELD_ROWS rows together, so neither its memory nor its calls grow with them.
    """
    sizes = entries.groupBy("leaf").agg(F.count("*").alias("n"), F.min("z").cast("double").alias("in_min"), F.max("z").cast("double").alias("in_max"))
    if spans is not None:
        sizes = sizes.select("leaf", "n").join(spans, "leaf")
    rows = entries.join(sizes.select("leaf", "n"), "leaf").where((F.col("pos") % F.greatest(F.lit(1), F.expr(f"(n + {MODEL_ROWS - 1}) div {MODEL_ROWS}"))) == 0)
    # as text, for Spark takes 15 times as long to hand over rows without weights where these are arrays
    if warm is not None:
        heads = sizes.join(warm.select("leaf", F.to_json(F.struct("w0", "b0", "w1", "b1")).alias("old")), "leaf", "left")
    else:
        heads = sizes.withColumn("old", F.lit(None).cast("string"))
    none = {c: F.lit(None).cast(k) for c, k in (("n", "long"), ("in_min", "double"), ("in_max", "double"), ("old", "string"))}
    both = heads.select("leaf", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("z"), "n", "in_min", "in_max", "old")
    both = both.unionByName(rows.select("leaf", "pos", "z").withColumns(none))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                leaf = _rows_of(t, "leaf")
                whole = int(np.searchsorted(leaf, leaf[-1]))  # the last one may go on
                if whole:
                    yield _fitted(t.slice(0, whole), hidden, steps, threshold, tries, last)
                held = pa.Table.from_batches(t.slice(whole).to_batches()).to_batches()
        if held and sum(b.num_rows for b in held):
            yield _fitted(pa.Table.from_batches(held).combine_chunks(), hidden, steps, threshold, tries, last)

    kind = "leaf long, n long, w0 array<double>, b0 array<double>, w1 array<double>, b1 double, in_min double, in_max double, out_max double"
    # by a hash, not by the leaf: that exchange Spark may drop as done by the joins before, whose partitions it coalesces and splits as it likes
    return both.repartition(F.xxhash64("leaf")).sortWithinPartitions("leaf", "pos").mapInArrow(fit, kind)


def network_part(w0: np.ndarray, b0: np.ndarray, w1: np.ndarray, b1: float, first: float, end: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The network that equals the given one from input `first` to `end`, over inputs of its own 0..1 and outputs scaled to 0..1; the given one for 0 to 1."""
    if (first, end) == (0.0, 1.0):
        return w0, b0, w1, b1
    value = lambda u: float(np.maximum(w0 * u + b0, 0) @ w1 + b1)
    low = value(first)
    span = (value(end) - low) or 1.0
    return w0 * (end - first), w0 * first + b0, w1 / span, (b1 - low) / span


def quartered_network(w0: np.ndarray, b0: np.ndarray, w1: np.ndarray, b1: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Four networks, each the given one on a quarter of its input."""
    return [network_part(w0, b0, w1, b1, k / 4, (k + 1) / 4) for k in range(4)]


def quartered_models(entries: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, models) of leaves that are each cut into quarters of their codes' span; leaf k's are 4 * k to 4 * k + 3.

    A quarter's network is its parent's on that part of the span, not a new fit; with_bounds() makes it exact.
    """
    span = F.col("in_max") - F.col("in_min")
    quarter = F.when(span > 0, F.least(F.lit(3), F.floor(F.lit(4.0) * (F.col("z").cast("double") - F.col("in_min")) / span))).otherwise(F.lit(0)).cast("long")
    rows = entries.join(models.select("leaf", "in_min", "in_max"), "leaf").withColumn("leaf", 4 * F.col("leaf") + quarter)
    rows = leaf_positions(rows.select(*[c for c in entries.columns if c != "pos"]))

    def split(batches):
        for g in batches:
            out = []
            for m in g.itertuples(index=False):
                quarters = quartered_network(np.array(m.w0), np.array(m.b0), np.array(m.w1), m.b1)
                step = (m.in_max - m.in_min) / 4
                out += [(4 * m.leaf + k, *net, m.in_min + k * step, m.in_min + (k + 1) * step) for k, net in enumerate(quarters)]
            yield pd.DataFrame(out, columns=["leaf", "w0", "b0", "w1", "b1", "in_min", "in_max"])

    parts = models.select("leaf", "w0", "b0", "w1", "b1", "in_min", "in_max").mapInPandas(split, "leaf long, w0 array<double>, b0 array<double>, w1 array<double>, b1 double, in_min double, in_max double")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.count("*") - 1).cast("double").alias("out_max"))
    return rows, parts.join(sizes, "leaf")


def stale(old: DataFrame, new: DataFrame, factor: float) -> DataFrame:
    """(leaf) whose error interval grew beyond `factor` times what it was."""
    width = lambda: F.col("max_err") - F.col("min_err")
    a, b = old.select("leaf", width().alias("_old")), new.select("leaf", width().alias("_new"))
    return b.join(a, "leaf").where(F.col("_new") > F.lit(factor) * F.col("_old")).select("leaf")
