"""Time buckets, distribution series per leaf, and their forecasts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import recurrent


def time_id(t: Column, start: int, interval: int) -> Column:
    return F.floor((t - F.lit(start)) / F.lit(interval)).cast("long")


def right_closed_group(t: Column, start: int, interval: int) -> Column:
    """The group of (start + i * interval, start + (i + 1) * interval]; what lies before is in the first."""
    return F.greatest(F.lit(0).cast("long"), F.ceil((t - F.lit(start)) / F.lit(interval)).cast("long") - 1)


def calendar(counts: DataFrame, key: str, last: int) -> DataFrame:
    """All (key, time_id), 0 to `last`, for the keys of `counts`."""
    return counts.select(key).distinct().withColumn("time_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))


def bucket_counts(rows: DataFrame, key: str, last: int) -> DataFrame:
    """(key, time_id, n, max_key) with the empty intervals; max_key is n - 1, and 0 for an empty one."""
    n = rows.groupBy(key, "time_id").agg(F.count("*").alias("n"))
    out = calendar(n, key, last).join(n, [key, "time_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("max_key", F.greatest(F.col("n") - 1, F.lit(0)))


def step_counts(rows: DataFrame, key: str, low: str, high: str, width: int) -> DataFrame:
    """(key, time_id, step, n): rows by the least i, 0 to `width`, for which z is at most low + (high - low) * i / width."""
    step = F.ceil((F.col("z") - F.col(low)) * F.lit(float(width)) / (F.col(high) - F.col(low)).cast("double")).cast("int")
    step = F.greatest(F.lit(0), F.least(step, F.lit(width)))
    return rows.groupBy(key, "time_id", step.alias("step")).agg(F.count("*").alias("n"))


def cdf_of_steps(counts: DataFrame, key: str, width: int) -> DataFrame:
    """(key, time_id, n, cdf) of step_counts(): running sums over the `width` + 1 steps."""
    sums = counts.groupBy(key, "time_id").agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col("step") <= i, F.col("n")).otherwise(0)).alias(f"_c{i}") for i in range(width)])
    return sums.select(key, "time_id", F.col("_all").alias("n"), F.array(*[F.col(f"_c{i}") / F.col("_all") for i in range(width)]).alias("cdf"))


def cdf_series(rows: DataFrame, key: str, low: str, high: str, width: int) -> DataFrame:
    """(key, time_id, n, cdf): the share of z up to low + (high - low) * i / width, for i from 0 to width - 1. A row is counted once."""
    return cdf_of_steps(step_counts(rows, key, low, high, width), key, width)


def filled_series(series: DataFrame, key: str, last: int) -> DataFrame:
    """(key, time_id, n, cdf) from each key's first interval on; an empty one has n 0 and the cdf before it."""
    grid = calendar(series, key, last).join(series, [key, "time_id"], "left")
    before = W.partitionBy(key).orderBy("time_id").rowsBetween(W.unboundedPreceding, 0)
    out = grid.withColumn("cdf", F.last("cdf", ignorenulls=True).over(before))
    return out.where(F.col("cdf").isNotNull()).withColumn("n", F.coalesce("n", F.lit(0)))


def corrected_cdf(cdf: Column) -> Column:
    """Scaled to 0..1, zero up to the first least value, never falling after it, one from the first greatest value on. A constant one stays as it is, clamped."""
    low, high = F.array_min(cdf), F.array_max(cdf)
    unit = F.transform(cdf, lambda v: (v - low) / (high - low))
    first0 = F.array_position(cdf, low)
    rising = F.aggregate(
        F.transform(unit, lambda v, i: F.when(i + 1 <= first0, F.lit(0.0)).otherwise(v)),
        F.array().cast("array<double>"),
        lambda acc, v: F.concat(acc, F.array(F.greatest(v, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))))),
    )
    return F.when(high == low, F.transform(cdf, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))).otherwise(rising)


def corrected_max_key(v: Column) -> Column:
    return F.greatest(v.cast("long"), F.lit(0).cast("long"))


def predicted_bucket(z: Column, low: Column, high: Column, cdf: Column, max_key: Column, width: int) -> Column:
    """A key's bucket by linear interpolation in a predicted cdf; the last one from the cdf's last step on."""
    pos = (z - low).cast("double") / (high - low).cast("double") * F.lit(float(width))
    i = F.floor(pos).cast("int")
    left, right = F.get(cdf, i), F.get(cdf, i + 1)
    return F.when(pos >= width - 1, max_key).otherwise(((left + (right - left) * (pos - i)) * max_key).cast("long"))


def _lagged(y: np.ndarray, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    m = max(lags)
    x = np.hstack([np.ones((len(y) - m, 1)), *[y[m - k : len(y) - k] for k in lags]])
    return x, y[m:]


def repeat_last(y: np.ndarray, lag: int, steps: int) -> np.ndarray:
    return np.repeat(y[-1:], steps, axis=0)


def holt_winters(y: np.ndarray, lag: int, steps: int) -> np.ndarray:
    """Additive trend and season of period `lag`; smoothing by the least one-step error on a grid."""
    if len(y) < 2 * lag:
        return repeat_last(y, lag, steps)
    best: tuple[float, np.ndarray | None] = (np.inf, None)
    for a in (0.1, 0.3, 0.6, 0.9):
        for b in (0.0, 0.1, 0.3):
            for c in (0.05, 0.3, 0.6):
                level, trend = y[:lag].mean(axis=0), (y[lag : 2 * lag].mean(axis=0) - y[:lag].mean(axis=0)) / lag
                season, err = [v - level for v in y[:lag]], 0.0
                for v in y[lag:]:
                    s = season[-lag]
                    err += float(((v - level - trend - s) ** 2).sum())
                    up = a * (v - s) + (1 - a) * (level + trend)
                    trend = b * (up - level) + (1 - b) * trend
                    level = up
                    season.append(c * (v - level) + (1 - c) * s)
                if err < best[0]:
                    best = (err, np.array([level + (k + 1) * trend + season[len(season) - lag + k % lag] for k in range(steps)]))
    return best[1]


def _autoregression(y: np.ndarray, lags: list[int], steps: int, ridge: float) -> np.ndarray:
    x, t = _lagged(y, lags)
    coef = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ t)
    hist = list(y)
    for _ in range(steps):
        hist.append(np.concatenate([[1.0], *[hist[-k] for k in lags]]) @ coef)
    return np.array(hist[len(y) :])


def arma_residuals(d: np.ndarray, params: np.ndarray, lag: int) -> np.ndarray:
    """(set, time) shocks of a series for sets of (mean, ar, seasonal ar, ma, seasonal ma): what a row leaves of the rows and shocks one step
    and one season before it. Shocks before the first row that has both are zero."""
    mean, ar, sar, ma, sma = params.T
    c = d[None, :] - mean[:, None]
    e = np.zeros_like(c)
    for t in range(lag, c.shape[1]):
        e[:, t] = c[:, t] - ar * c[:, t - 1] - sar * c[:, t - lag] - ma * e[:, t - 1] - sma * e[:, t - lag]
    return e


def fit_arma(d: np.ndarray, lag: int, rounds: int = 60) -> np.ndarray:
    """Parameters of arma_residuals() with the least sum of squared shocks, by damped Gauss-Newton steps; all but the mean stay within -0.98 to 0.98. lag 1 has no season."""
    p = np.array([d.mean(), 0.1, 0.0, 0.1, 0.0])
    free = [0, 1, 3] if lag == 1 else [0, 1, 2, 3, 4]
    damp, e = 1e-2, arma_residuals(d, p[None], lag)[0]
    for _ in range(rounds):
        step = np.zeros((len(free), 5))
        step[np.arange(len(free)), free] = 1e-6
        slope = (arma_residuals(d, p + step, lag) - e) / 1e-6
        a = slope @ slope.T
        new = p.copy()
        new[free] -= np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), slope @ e)
        new[1:] = np.clip(new[1:], -0.98, 0.98)
        after = arma_residuals(d, new[None], lag)[0]
        if after @ after < e @ e:
            done = e @ e - after @ after < 1e-10 * (e @ e)
            p, e, damp = new, after, damp / 3
            if done:
                break
        elif (damp := damp * 5) > 1e8:
            break
    return p


def seasonal_arima(y: np.ndarray, lag: int, steps: int) -> np.ndarray:
    """Differences of one season as an ARMA with one step and one season of each, by conditional sums of squares; shocks to come are zero. Each column by itself."""
    if len(y) <= 3 * lag + 3:
        return repeat_last(y, lag, steps)
    out = []
    for column in y.T:
        d = column[lag:] - column[:-lag]
        mean, ar, sar, ma, sma = p = fit_arma(d, lag)
        shocks, c, hist = list(arma_residuals(d, p[None], lag)[0]), list(d - mean), list(column)
        for _ in range(steps):
            c.append(ar * c[-1] + sar * c[-lag] + ma * shocks[-1] + sma * shocks[-lag])
            shocks.append(0.0)
            hist.append(hist[-lag] + c[-1] + mean)
        out.append(hist[len(column) :])
    return np.array(out).T


def vector_ar(y: np.ndarray, lag: int, steps: int) -> np.ndarray:
    """All columns on the last `lag` rows, ridge least squares with a constant."""
    return _autoregression(y, list(range(1, lag + 1)), steps, 1e-2) if len(y) > lag + 1 else repeat_last(y, lag, steps)


def vector_arma(y: np.ndarray, lag: int, steps: int) -> np.ndarray:
    """Two steps back and two shocks back, in two regressions: the shocks are what a longer autoregression leaves. Shocks to come are zero."""
    if len(y) <= lag + 6:
        return repeat_last(y, lag, steps)
    x, t = _lagged(y, list(range(1, lag + 1)))
    shock = np.zeros_like(y)
    shock[lag:] = t - x @ np.linalg.solve(x.T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ t)
    both = lambda v, e: np.concatenate([[1.0], v[-1], v[-2], e[-1], e[-2]])
    rows = np.array([both(y[i - 2 : i], shock[i - 2 : i]) for i in range(lag + 2, len(y))])
    coef = np.linalg.solve(rows.T @ rows + 1e-2 * np.eye(rows.shape[1]), rows.T @ y[lag + 2 :])
    hist, left = list(y), list(shock)
    for _ in range(steps):
        hist.append(both(hist, left) @ coef)
        left.append(np.zeros(y.shape[1]))
    return np.array(hist[len(y) :])


#: Forecasters by name: of a (time, column) array, the season's length and the steps ahead.
FORECASTERS: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {
    "last": repeat_last,
    "es": holt_winters,
    "sarima": seasonal_arima,
    "var": vector_ar,
    "varma": vector_arma,
    **{kind: recurrent.forecaster(kind) for kind in ("rnn", "gru", "lstm", "convlstm")},
}


def forecast(series: DataFrame, key: str, lag: int, steps: int, cdf_model: str = "var", count_model: str = "es") -> DataFrame:
    """(key, time_id, cdf, max_key) for the `steps` intervals after each key's series (time_id, cdf, max_key).

    A series of up to lag + steps intervals repeats its last one. Cdfs and max_keys are corrected. A group is one
    key's series, as long as the time axis.
    """
    by_cdf, by_count = FORECASTERS[cdf_model], FORECASTERS[count_model]
    kind = series.schema[key].dataType.simpleString()

    def ahead(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time_id")
        cdf, n = np.vstack(g.cdf.to_list()).astype(float), g.max_key.to_numpy(float)[:, None]
        few = len(g) <= lag + steps
        return pd.DataFrame({
            key: [g[key].iloc[0]] * steps,
            "time_id": int(g.time_id.iloc[-1]) + 1 + np.arange(steps),
            "cdf": list((repeat_last if few else by_cdf)(cdf, lag, steps)),
            "max_key": (repeat_last if few else by_count)(n, lag, steps)[:, 0],
        })

    out = series.select(key, "time_id", "cdf", "max_key").groupBy(key).applyInPandas(ahead, f"{key} {kind}, time_id long, cdf array<double>, max_key double")
    return out.select(key, "time_id", corrected_cdf(F.col("cdf")).alias("cdf"), corrected_max_key(F.col("max_key")).alias("max_key"))


def empty_forecast(keys: DataFrame, key: str, first: int, steps: int, width: int) -> DataFrame:
    """What keys without a history get: zeros."""
    zeros = F.array(*[F.lit(0.0)] * width)
    return keys.select(key).distinct().withColumn("time_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + steps - 1).cast("long")))).select(key, "time_id", zeros.alias("cdf"), F.lit(0).cast("long").alias("max_key"))


def forecast_error(predicted: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, cdf_mae, max_key_mae) over the intervals that both have."""
    p = predicted.select(key, "time_id", F.col("cdf").alias("_p"), F.col("max_key").alias("_pk"))
    both = actual.join(p, [key, "time_id"])
    each = F.aggregate(F.zip_with("cdf", "_p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("cdf")
    return both.groupBy(key).agg(F.avg(each).alias("cdf_mae"), F.avg(F.abs(F.col("max_key") - F.col("_pk"))).alias("max_key_mae"))


def search_forecasters(series: DataFrame, actual: DataFrame, key: str, steps: int, grid: list[tuple[str, int]]) -> DataFrame:
    """(name, lag, cdf_mae, max_key_mae) of each (forecaster, lag) of the grid over all keys, best first. One pass: a task
    fits one key's series with one entry of the grid."""
    kind = series.schema[key].dataType.simpleString()
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lag).alias("lag")) for n, lag in grid])
    rows = series.select(key, "time_id", "cdf", "max_key", F.explode(entries).alias("_e")).select(key, "time_id", "cdf", "max_key", "_e.*")

    def ahead(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time_id")
        name, lag = g.name.iloc[0], int(g.lag.iloc[0])
        by = FORECASTERS["last" if len(g) <= lag + steps else name]
        out = pd.DataFrame({key: [g[key].iloc[0]] * steps, "name": name, "lag": lag, "time_id": int(g.time_id.iloc[-1]) + 1 + np.arange(steps)})
        out["cdf"] = list(by(np.vstack(g.cdf.to_list()).astype(float), lag, steps))
        out["max_key"] = by(g.max_key.to_numpy(float)[:, None], lag, steps)[:, 0]
        return out

    found = rows.groupBy(key, "name", "lag").applyInPandas(ahead, f"{key} {kind}, name string, lag int, time_id long, cdf array<double>, max_key double")
    found = found.select("name", "lag", key, "time_id", corrected_cdf(F.col("cdf")).alias("_p"), corrected_max_key(F.col("max_key")).alias("_pk"))
    each = F.aggregate(F.zip_with("cdf", "_p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("cdf")
    errors = actual.join(found, [key, "time_id"]).groupBy("name", "lag", key).agg(F.avg(each).alias("c"), F.avg(F.abs(F.col("max_key") - F.col("_pk"))).alias("k"))
    return errors.groupBy("name", "lag").agg(F.avg("c").alias("cdf_mae"), F.avg("k").alias("max_key_mae")).orderBy("cdf_mae", "name", "lag")


def due_for_refit(errors: DataFrame, before: DataFrame, key: str, factor: float) -> DataFrame:
    """Keys of `errors` (as forecast_error() gives them) whose cdf or count error is beyond `factor` times what it was, or that had none."""
    b = before.select(key, F.col("cdf_mae").alias("_c"), F.col("max_key_mae").alias("_k"))
    worse = F.col("_c").isNull() | (F.col("cdf_mae") > F.col("_c") * factor) | (F.col("max_key_mae") > F.col("_k") * factor)
    return errors.join(b, key, "left").where(worse).select(key)


def next_horizon(series: DataFrame, used: DataFrame, due: DataFrame, key: str, lag: int, steps: int, cdf_model: str = "var", count_model: str = "es") -> DataFrame:
    """(key, time_id, cdf, max_key) for the intervals after `used`, the forecasts that time has consumed: keys of `due`
    are fitted to their whole series, the others' forecasts go on unchanged, one horizon later."""
    due = due.select(key).distinct()
    again = forecast(series.join(due, key, "left_semi"), key, lag, steps, cdf_model, count_model)
    kept = used.join(due, key, "left_anti").select(key, (F.col("time_id") + steps).alias("time_id"), "cdf", "max_key")
    return kept.unionByName(again)
