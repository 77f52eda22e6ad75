"""Codes, geometry and series functions against plain Python."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrazzo.functions import geometry as G
from terrazzo.functions import zorder as Z
from terrazzo.functions.region import UNIT, Region
from terrazzo.operators import learned, recurrent, series


CITY = Region(45.41, 45.67, 9.05, 9.34)


def bits_of(x, y, bits):
    return sum(((x >> i) & 1) << 2 * i | ((y >> i) & 1) << (2 * i + 1) for i in range(bits))


def test_bits_and_depth():
    assert CITY.bits(6) == 22 and UNIT.bits(8) == 30 and CITY.max_depth(6) == 18 and UNIT.max_depth(8) == 27
    assert [q.left for q in UNIT.quarters()] == [0, 0.5, 0, 0.5] and [q.bottom for q in UNIT.quarters()] == [0, 0, 0.5, 0.5]
    assert UNIT.shrunk(3).right == pytest.approx(0.9999) and UNIT.grown(3).up == pytest.approx(1.0001)


def test_codes(spark):
    rng = np.random.default_rng(3)
    pts = [(float(x), float(y)) for x, y in zip(rng.uniform(CITY.left, CITY.right, 300), rng.uniform(CITY.bottom, CITY.up, 300), strict=True)]
    pts += [(CITY.left, CITY.bottom), (CITY.right, CITY.up)]
    df = spark.createDataFrame(pts, "x double, y double")
    b, n = 22, 1 << 22
    dx, dy = Z.decode(Z.encode(F.col("x"), F.col("y"), CITY, b), CITY, b, 6)
    out = df.select("x", "y", Z.encode(F.col("x"), F.col("y"), CITY, b).alias("z"), Z.encode(F.col("x"), F.col("y"), CITY, b, True).alias("t"), dx.alias("dx"), dy.alias("dy")).collect()
    for r in out:
        sx, sy = (r.x - CITY.left) * n / CITY.width, (r.y - CITY.bottom) * n / CITY.height
        clamp = lambda v: max(0, min(n - 1, int(v)))
        assert r.z == bits_of(clamp(round(sx)), clamp(round(sy)), b) and r.t == bits_of(clamp(math.floor(sx)), clamp(math.floor(sy)), b)
        assert abs(r.dx - r.x) < 1e-6 and abs(r.dy - r.y) < 1e-6


def test_neighbours_and_prefixes(spark):
    df = spark.createDataFrame([(bits_of(0, 0, 4),), (bits_of(5, 7, 4),), (bits_of(15, 15, 4),)], "c long")
    got = [r[0] for r in df.select(Z.neighbours(F.col("c"), 4)).collect()]
    assert got[0] == [bits_of(x, y, 4) for y in (0, 1) for x in (0, 1)] and len(got[2]) == 4
    assert got[1] == [bits_of(5 + i, 7 + j, 4) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    one = spark.range(1)
    same = lambda a, da, b, db: one.select(Z.compatible(F.lit(a).cast("long"), F.lit(da), F.lit(b).cast("long"), F.lit(db))).first()[0]
    assert same(0b1101, 2, 0b11, 1) and not same(0b1101, 2, 0b10, 1)


def test_geohash32(spark):
    df = spark.createDataFrame([(-5.6, 42.6), (112.5584, 37.8324), (-0.1257, 51.5085)], "lng double, lat double")
    h = df.select("lng", "lat", Z.geohash32(F.col("lng"), F.col("lat")).alias("h"))
    got = h.collect()
    assert got[0].h.startswith("ezs42") and got[1].h.startswith("ww8p1r4t8") and got[2].h.startswith("gcpvj0")
    d = h.select("lng", "lat", *[c.alias(n) for c, n in zip(Z.geohash32_decode(F.col("h")), "abcd", strict=True)]).collect()
    assert all(abs(r.a - r.lng) <= r.c * 1.01 and abs(r.b - r.lat) <= r.d * 1.01 for r in d)


BOX = st.tuples(*[st.integers(0, 6)] * 4).map(lambda t: (min(t[0], t[1]), max(t[0], t[1]), min(t[2], t[3]), max(t[2], t[3])))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(BOX, BOX, st.integers(-1, 7), st.integers(-1, 7)), min_size=30, max_size=60))
def test_geometry(spark, cases):
    flat = [(*map(float, a), *map(float, b), float(x), float(y)) for a, b, x, y in cases]
    names = [p + n for p in ("a_", "b_") for n in ("bottom", "up", "left", "right")] + ["x", "y"]
    df = spark.createDataFrame(flat, [*names])
    a, b, x, y = G.Box.of("a_"), G.Box.of("b_"), F.col("x"), F.col("y")
    s = G.shared(a, b)
    out = df.select(G.relation(a, b), G.nearest2(a, x, y), G.farthest2(a, x, y), G.contains(a, x, y), G.contains_half_open(a, x, y), s.bottom, s.up).collect()
    for (p, q, px, py), r in zip(cases, out, strict=True):
        inside = lambda o, i: o[0] <= i[0] and o[1] >= i[1] and o[2] <= i[2] and o[3] >= i[3]
        meet = p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]
        assert r[0] == (0 if not meet else 2 if inside(p, q) else 3 if inside(q, p) else 1)
        cx, cy = min(max(px, p[2]), p[3]), min(max(py, p[0]), p[1])
        assert r[1] == (px - cx) ** 2 + (py - cy) ** 2
        assert r[2] == max((px - u) ** 2 + (py - v) ** 2 for u in p[2:] for v in p[:2])
        assert r[3] == (p[0] <= py <= p[1] and p[2] <= px <= p[3]) and r[4] == (p[0] <= py < p[1] and p[2] <= px < p[3])


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    v = F.lit(0.5)
    assert value(learned.sigmoid(v)) == pytest.approx(1 / (1 + math.exp(-0.5))) and value(learned.elu(F.lit(-0.5))) == pytest.approx(math.exp(-0.5) - 1) and value(learned.elu(v)) == 0.5
    assert value(G.same_integer_part(F.lit(1.2), F.lit(-0.5), F.lit(1.9), F.lit(0.5))) and not value(G.same_integer_part(F.lit(1.2), F.lit(0.5), F.lit(2.0), F.lit(0.5)))
    box = G.Box.region(Region(0.0, 1.0, 0.0, 1.0))
    assert value(G.within(box, F.lit(4.0), F.lit(5.0), F.lit(5.0))) and not value(G.within(box, F.lit(4.0), F.lit(5.0), F.lit(4.9)))
    assert value(Z.first_of(F.lit(3).cast("long"), 4, 2)) == 48
    for x, y in ((0.0, 0.0), (1.0, 1.0), (0.3, 0.7)):
        assert Z.code_of(x, y, UNIT, 20) == value(Z.encode(F.lit(x), F.lit(y), UNIT, 20))


def test_warm_started_networks_are_no_worse(spark):
    rows = spark.range(300).select((F.col("id") % 2).alias("leaf"), (F.col("id") * F.col("id")).alias("z"), F.expr("id div 2").alias("pos"))
    first = learned.network_models(rows, steps=40).checkpoint()
    again = learned.network_models(rows, steps=40, warm=first)
    width = lambda m: {r.leaf: r.max_err - r.min_err for r in learned.with_bounds(rows, m, learned.network_guess()).collect()}
    a, b = width(first), width(again)
    assert set(a) == set(b) == {0, 1} and sum(b.values()) <= 1.5 * sum(a.values())


def test_low_line_quirk(spark):
    df = spark.createDataFrame([(9.0, 0.2), (0.1, 7.0), (0.2, 0.3), (0.4, 0.3)], "x double, y double")
    b = G.Box.region(Region(0.2, 0.5, 0.1, 0.4))
    assert [r[0] for r in df.select(G.contains_or_on_low_line(b, F.col("x"), F.col("y"))).collect()] == [True, True, True, False]


def test_corrected_cdf(spark):
    """Below zero and above one, a fall after a rise, a start above the least value, constants in and out of range."""
    given = [[-0.5, 1.0, 0.25, 1.5, 1.5], [0.6, 0.2, 1.0], [2.0, 2.0], [0.3, 0.3]]
    want = [[0.0, 0.75, 0.75, 1.0, 1.0], [0.0, 0.0, 1.0], [1.0, 1.0], [0.3, 0.3]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "i int, c array<double>")
    got = [r.c for r in df.select("i", series.corrected_cdf(F.col("c")).alias("c")).orderBy("i").collect()]
    assert all(g == pytest.approx(w) for g, w in zip(got, want, strict=True))


def test_right_closed_groups(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 10, 11, 20, 21)], "t long")
    assert [r[0] for r in df.select(series.right_closed_group(F.col("t"), 0, 10)).collect()] == [0, 0, 0, 1, 1, 2]


def test_forecasters_follow_a_season():
    t = np.arange(70)
    y = (10 + 0.1 * t + 5 * np.sin(2 * np.pi * t / 7))[:, None]
    want = (10 + 0.1 * (70 + np.arange(3)) + 5 * np.sin(2 * np.pi * (70 + np.arange(3)) / 7))[:, None]
    for name in ("es", "sarima", "var", "gru", "rnn", "convlstm"):
        assert np.abs(series.FORECASTERS[name](y, 7, 3) - want).max() < 1.5, name
    for f in series.FORECASTERS.values():
        assert f(y[:5], 7, 3).shape == (3, 1)


def test_quartered_network_is_the_same_function():
    rng = np.random.default_rng(4)
    net = (rng.normal(size=8), rng.normal(size=8), rng.normal(size=8), 0.3)
    value = lambda n, u: float(np.maximum(n[0] * u + n[1], 0) @ n[2] + n[3])
    for k, part in enumerate(learned.quartered_network(*net)):
        low, high = value(net, k / 4), value(net, (k + 1) / 4)
        for u in (0, 0.3, 1):
            assert value(part, u) * (high - low) + low == pytest.approx(value(net, (k + u) / 4))


def test_network_learns_and_goes_on():
    u = np.linspace(0, 1, 200)
    y = u**2
    first = learned.train_network(u, y, steps=200)
    loss = lambda p: float(((np.maximum(u[:, None] * p[0] + p[1], 0) @ p[2] + p[3] - y) ** 2).mean())
    assert loss(first) < 1e-3 and loss(learned.train_network(u, y, steps=50, start=first)) <= loss(first)


def test_last_weights_and_retries(spark):
    u = np.linspace(0, 1, 60)
    y = np.sqrt(u)
    value = lambda p: np.maximum(u[:, None] * p[0] + p[1], 0) @ p[2] + p[3]
    best, last = learned.train_network(u, y, steps=30, rate=0.4), learned.train_network(u, y, steps=30, rate=0.4, last=True)
    assert ((value(best) - y) ** 2).mean() < ((value(last) - y) ** 2).mean()
    rows = spark.range(400).select((F.col("id") * F.col("id")).alias("z"), F.lit(1).cast("long").alias("leaf"), F.col("id").alias("pos"))
    width = lambda **how: learned.with_bounds(rows, learned.network_models(rows, 8, 40, **how), learned.network_guess()).select(F.col("max_err") - F.col("min_err")).first()[0]
    assert width(threshold=0.0, tries=4) <= width() == width(threshold=1e9, tries=4)


def test_networks_of_many_leaves_are_fitted_together(spark, monkeypatch):
    """As each by itself, wherever a task cuts its leaves' rows, with old weights of another width for some and with retries; few calls, not one a leaf."""
    rows = spark.range(900).select((F.col("id") * F.col("id")).alias("z"), F.expr("CAST(sqrt(id) AS BIGINT)").alias("leaf"), F.expr("id - CAST(pow(CAST(sqrt(id) AS BIGINT), 2) AS BIGINT)").alias("pos")).checkpoint()
    warm = learned.network_models(rows.where("leaf % 3 = 0"), 5, 20).checkpoint()
    of, old = {}, {r.leaf: (r.w0, r.b0, r.w1, r.b1) for r in warm.collect()}
    for r in rows.orderBy("leaf", "pos").collect():
        of.setdefault(r.leaf, []).append(float(r.z))
    flat = lambda net: np.concatenate([*net[:3], [net[3]]])
    for held, trained in ((1 << 17, 1 << 13), (150, 100)):
        monkeypatch.setattr(learned, "TRAINED_ROWS", trained)
        monkeypatch.setattr(learned, "HELD_ROWS", held)
        found = {r.leaf: (r.w0, r.b0, r.w1, r.b1) for r in learned.network_models(rows, 5, 30, warm=warm).collect()}
        assert set(found) == set(range(30)) == set(of)
        for leaf, z in of.items():
            u, y = (np.array(z) - z[0]) / ((z[-1] - z[0]) or 1.0), np.arange(len(z)) / max(1, len(z) - 1)
            assert flat(found[leaf]) == pytest.approx(flat(learned.train_network(u, y, 5, 30, old.get(leaf))), abs=1e-9)
    assert {len(r.w0) for r in learned.network_models(rows, 7, 5, warm=warm).collect()} == {7}
    calls = []
    monkeypatch.setattr(learned, "TRAINED_ROWS", 1 << 13)
    train = learned.train_networks
    monkeypatch.setattr(learned, "train_networks", lambda *a, **k: calls.append(len(a[0])) or train(*a, **k))
    head = [{"leaf": i, "pos": j, "z": None if j < 0 else j, "n": 5 if j < 0 else None, "in_min": 0.0, "in_max": 4.0, "old": None} for i in range(40) for j in range(-1, 5)]
    assert learned._fitted(pa.Table.from_pylist(head), 4, 10, None, 1, False).num_rows == 40 and calls == [40]
    widths = [learned.with_bounds(rows, warm, learned.network_guess(n)).select("leaf", "min_err", "max_err").orderBy("leaf").collect() for n in (None, learned.most_units(warm), 9)]
    assert learned.most_units(warm) == 5 and widths[0] == widths[1] == widths[2]


def test_digits_of_geohashes(spark):
    df = spark.createDataFrame([("ezs42e",), ("s00000",), ("u4pruy",)], "h string")
    lng, lat = Z.geohash32_digits(F.col("h"), 6)
    got = [tuple(r) for r in df.select(lng, lat).collect()]
    for (h,), (a, b) in zip([("ezs42e",), ("s00000",), ("u4pruy",)], got, strict=True):
        code = "".join(f"{Z.BASE32.index(c):05b}" for c in h)
        x, y = int(code[::2], 2), int(code[1::2], 2)
        want = [f"{(k + 0.5) / (1 << 15) * side - side / 2:.{places}f}".rstrip("0") for k, side, places in ((x, 360, 1), (y, 180, 2))]
        assert [a, b] == want


@pytest.mark.parametrize("kind", ["rnn", "gru", "lstm", "convlstm"])
def test_gradients_are_the_differences(kind):
    rng = np.random.default_rng(1)
    x, y, w = rng.random((3, 4, 5)), rng.random((3, 5)), recurrent.fresh(kind, 5)
    _, grad, _ = recurrent.loss_and_gradient(w, x, y, kind)
    for name, value in w.items():
        for at in rng.choice(value.size, min(8, value.size), replace=False):
            both = []
            for d in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name].ravel()[at] += d
                both.append(recurrent.loss_and_gradient(moved, x, y, kind)[0])
            assert grad[name].ravel()[at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-4, abs=1e-8)


@pytest.mark.parametrize("kind", ["rnn", "gru", "lstm", "convlstm"])
def test_training_lowers_the_error_of_a_held_out_horizon(kind):
    t = np.arange(120)
    y = np.stack([np.sin(2 * np.pi * (t + c) / 7) * (10 + c) + 20 for c in range(4)], axis=1)
    past, want = y[:110], y[110:114]
    error = lambda w: np.abs(recurrent.roll(w, past, 7, 4, kind) - want).mean()
    assert error(recurrent.train(past, 7, kind)) < 0.5 * error(recurrent.fresh(kind, 4))


def test_networks_are_kept_and_gone_on_with(spark):
    rows = [(k, t, [0.5 + 0.4 * float(np.sin(2 * np.pi * (t + c) / 7)) for c in range(3)]) for k in ("a", "b") for t in range(40)] + [("short", t, [0.1, 0.2, 0.3]) for t in range(5)]
    past = spark.createDataFrame(rows, "key string, time_id long, cdf array<double>").cache()
    nets = recurrent.trained_networks(past, "key", 7, "gru", epochs=40).cache()
    assert {r.key for r in nets.collect()} == {"a", "b"}
    got = {(r.key, r.time_id): r.cdf for r in recurrent.network_forecasts(past, nets, "key", 7, 2).collect()}
    y = np.array([r[2] for r in rows if r[0] == "a"])
    assert np.allclose([got["a", 40], got["a", 41]], recurrent.roll(recurrent.train(y, 7, "gru", 40), y, 7, 2, "gru"))
    more = recurrent.trained_networks(past, "key", 7, "gru", warm=nets, epochs=1).collect()
    old = {r.key: r.weights for r in nets.collect()}
    assert all(np.abs(np.array(r.weights) - old[r.key]).max() < 0.05 for r in more)


def test_arma_finds_its_parameters():
    rng = np.random.default_rng(3)
    e, d = rng.normal(size=4000), np.zeros(4000)
    for t in range(7, 4000):
        d[t] = 0.6 * d[t - 1] + 0.2 * d[t - 7] + e[t] + 0.4 * e[t - 1] - 0.3 * e[t - 7]
    mean, ar, sar, ma, sma = series.fit_arma(d + 5, 7)
    assert abs(mean - 5) < 0.5 and np.allclose([ar, sar, ma, sma], [0.6, 0.2, 0.4, -0.3], atol=0.07)
    assert np.allclose(series.fit_arma(d + 5, 7), series.fit_arma(d + 5, 7, rounds=200), atol=1e-3)


def test_shocks_help_where_they_linger():
    rng = np.random.default_rng(0)
    e, y = rng.normal(size=(400, 2)), np.zeros((400, 2))
    for i in range(2, 400):
        y[i] = 0.5 * y[i - 1] + e[i] + 0.6 * e[i - 1]
    error = lambda name: np.mean([np.abs(series.FORECASTERS[name](y[:k], 7, 1) - y[k]).mean() for k in range(200, 399, 3)])
    assert error("varma") < 0.9 * error("last") and error("varma") < 1.02 * error("var")
