"""Robust trends, drought indices and recovery fits.

What SQL can say (slopes, test statistics) is a self-join of each series; the
fits run as grouped pandas functions, one series at a time. A series is some
hundreds of steps: pairs grow with the square of one series, not of the table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.functions.sizes import running

_NORMAL = NormalDist()


def pairs(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """(keys, dt, dv) of all pairs of a series' valid points, later less earlier."""
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"))
    a, b = v.withColumnsRenamed({"_t": "_ta", "_v": "_va"}), v.withColumnsRenamed({"_t": "_tb", "_v": "_vb"})
    return a.join(b, list(keys)).where("_tb > _ta").select(*keys, (F.col("_tb") - F.col("_ta")).alias("dt"), (F.col("_vb") - F.col("_va")).alias("dv"))


def theil_sen(df: DataFrame, keys: Sequence[str], time: str, value: str, scale: float = 1.0, least: int = 10) -> DataFrame:
    """(keys, n, slope, intercept): median of the pairs' slopes, times scale; the
    intercept is in the series' own units. NULL for fewer than `least` points."""
    slope = pairs(df, keys, time, value).groupBy(*keys).agg(F.percentile(F.col("dv") / F.col("dt"), F.lit(0.5)).alias("m"))
    base = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("mv"), F.median(time).alias("mt"))
    out = base.join(slope, list(keys), "left")
    ok = F.col("n") >= least
    return out.select(*keys, "n", F.when(ok, F.col("m") * scale).alias("slope"), F.when(ok, F.col("mv") - F.col("m") * F.col("mt")).alias("intercept"))


def mann_kendall(df: DataFrame, keys: Sequence[str], time: str, value: str, least: int = 10) -> DataFrame:
    """(keys, n, s, tau, variance, z): the statistic, tie-corrected and with continuity correction."""
    s = pairs(df, keys, time, value).groupBy(*keys).agg(F.sum(F.signum("dv")).alias("s"))
    ties = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    c = F.col("count")
    ties = ties.groupBy(*keys).agg(F.sum("count").alias("n"), F.sum(c * (c - 1) * (2 * c + 5)).alias("ties"))
    n = F.col("n")
    out = ties.join(s, list(keys), "left").withColumn("variance", (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18.0)
    z = F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")).otherwise(0.0)
    return out.where(n >= least).select(*keys, "n", "s", (F.col("s") / (n * (n - 1) / 2)).alias("tau"), "variance", z.alias("z"))


def fdr(df: DataFrame, p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """df with q, the Benjamini-Hochberg value of each p (NULL for NULL), for
    each of `keys`. Ranges of the distinct p run up instead of one window a key."""
    own = [f"_k{i}" for i in range(len(keys))]
    known = df.where(F.col(p).isNotNull()).groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    upto = running(known, F.col("_p"), "sum", "_n", "_upto", "fdr", own)
    m = known.groupBy(*[F.col(o).alias(f"_of{o}") for o in own]).agg(F.sum("_n").alias("_m"))
    every = upto.join(m, reduce(and_, [F.col(o).eqNullSafe(F.col(f"_of{o}")) for o in own])) if own else upto.crossJoin(F.broadcast(m))
    raw = every.select(*own, "_p", (F.col("_p") * F.col("_m") / F.col("_upto")).alias("_raw"))
    q = running(raw, F.desc("_p"), "min", "_raw", "_q", "fdr", own).select(*own, "_p", F.least("_q", F.lit(1.0)).alias("q"))
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)]
    return df.join(q, reduce(and_, same, F.col(p) == F.col("_p")), "left").drop("_p", *own)


# Grouped fits: plain functions of arrays, and the DataFrame calls around them.


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    end = np.cumsum(count)
    return (end - (count - 1) / 2)[inverse]


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def mk_test(y: np.ndarray, corrected: bool = False) -> dict:
    """Mann-Kendall; with Hamed and Rao's variance inflation if corrected."""
    out = dict.fromkeys(("tau", "p", "z", "variance_inflation"))
    y = y[np.isfinite(y)]
    n = len(y)
    if n < 10:
        return out
    i, j = np.triu_indices(n, 1)
    s = float(np.sign(y[j] - y[i]).sum())
    _, t = np.unique(y, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - float((t * (t - 1) * (2 * t + 5)).sum())) / 18
    factor = 1.0
    if corrected and n >= 15 and var > 0:
        x = np.arange(n)
        r = ranks(y - np.median((y[j] - y[i]) / (j - i)) * x)
        r = r - r.mean()
        total = float((r * r).sum())
        add = 0.0
        for k in range(1, n - 2):
            rho = float((r[:-k] * r[k:]).sum()) / total if total else 0.0
            if abs(rho) > 1.96 * math.sqrt(n - k - 1) / (n - k):
                add += (n - k) * (n - k - 1) * (n - k - 2) * rho
        factor = max(1.0, 1 + 2 / (n * (n - 1) * (n - 2)) * add)
    if var <= 0:
        return {"tau": 0.0, "p": 1.0, "z": 0.0, "variance_inflation": factor}
    z = (s - np.sign(s)) / math.sqrt(var * factor)
    return {"tau": s / (n * (n - 1) / 2), "p": two_sided(z), "z": float(z), "variance_inflation": factor}


def sen_test(x: np.ndarray, y: np.ndarray, scale: float = 1.0) -> dict:
    """Theil-Sen slope with its 95 % interval, by the ranks of the slopes."""
    good = np.isfinite(x) & np.isfinite(y)
    x, y = x[good], y[good]
    n = len(y)
    out = {"n": n} | dict.fromkeys(("slope", "lo", "hi", "intercept"))
    if n < 10:
        return out
    i, j = np.triu_indices(n, 1)
    dx = x[j] - x[i]
    slopes = np.sort((y[j] - y[i])[dx > 0] / dx[dx > 0])
    if not len(slopes):
        return out
    slope = float(np.median(slopes))
    tied = sum(float((k * (k - 1) * (2 * k + 5)).sum()) for k in (np.unique(x, return_counts=True)[1], np.unique(y, return_counts=True)[1]))
    sigma = math.sqrt(max((n * (n - 1) * (2 * n + 5) - tied) / 18, 0.0))
    z = _NORMAL.inv_cdf(0.025)
    hi = min(round((len(slopes) - z * sigma) / 2), len(slopes) - 1)
    lo = max(round((len(slopes) + z * sigma) / 2) - 1, 0)
    return out | {"slope": slope * scale, "lo": float(slopes[lo]) * scale, "hi": float(slopes[hi]) * scale, "intercept": float(np.median(y) - slope * np.median(x))}


def _grouped(df: DataFrame, keys: Sequence[str], fields: str, f: Callable[[pd.DataFrame], list[dict]]) -> DataFrame:
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + fields
    names = [x.split()[0] for x in schema.replace("`", "").split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key)) | r for r in f(pdf)], columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def trend_table(df: DataFrame, keys: Sequence[str], time: str, value: str, scale: float = 1.0) -> DataFrame:
    """Slope, interval, raw and autocorrelation-corrected p of each series; for
    the cells of a stack, `keys` are the cell's."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values(time)
        x, y = pdf[time].to_numpy(float), pdf[value].to_numpy(float)
        raw, fixed = mk_test(y), mk_test(y, True)
        p = fixed["p"]
        return [sen_test(x, y, scale) | {"tau": raw["tau"], "p_raw": raw["p"], "p_corrected": p, "variance_inflation": fixed["variance_inflation"], "significant": None if p is None else p < 0.05}]

    return _grouped(df.select(*keys, time, value), keys, "n int, slope double, lo double, hi double, intercept double, tau double, p_raw double, p_corrected double, variance_inflation double, significant boolean", fit)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def gamma_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the gamma distribution of greatest likelihood."""
    s = math.log(x.mean()) - float(np.log(x).mean())
    if s <= 0:
        return 1e6, float(x.mean()) / 1e6
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        h = 1e-5 * k
        g = math.log(k) - digamma(k) - s
        slope = 1 / k - (digamma(k + h) - digamma(k - h)) / (2 * h)
        new = k - g / slope
        new = new if new > 0 else k / 2
        if abs(new - k) < 1e-10 * k:
            k = new
            break
        k = new
    return k, float(x.mean()) / k


def gamma_cdf(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, element by element: a series
    for x < k + 1, a continued fraction beyond."""
    x, k = np.broadcast_arrays(np.asarray(x, float), np.asarray(k, float))
    out = np.zeros(x.shape)
    shapes, which = np.unique(k, return_inverse=True)
    front = np.exp(k * np.log(np.maximum(x, 1e-300)) - x - np.array([math.lgamma(v) for v in shapes])[which].reshape(k.shape))
    low, high = (x > 0) & (x < k + 1), (x > 0) & (x >= k + 1)
    if low.any():
        v, a = x[low], k[low].copy()
        term = total = 1 / a
        for _ in range(10_000):
            a = a + 1
            term = term * v / a
            total = total + term
            if (np.abs(term) <= 1e-15 * np.abs(total)).all():
                break
        out[low] = total * front[low]
    if high.any():
        v, shape = x[high], k[high]
        b = v + 1 - shape
        c, d = np.full(len(v), 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            a = -i * (i - shape)
            b = b + 2
            d = a * d + b
            d = 1 / np.where(d == 0, 1e-300, d)
            c = b + a / c
            c = np.where(c == 0, 1e-300, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = 1 - front[high] * h
    return out


def _z(p: np.ndarray) -> list[float | None]:
    return [None if math.isnan(v) else _NORMAL.inv_cdf(v) for v in np.clip(p, 1e-6, 1 - 1e-6).tolist()]


def spi_probability(x: np.ndarray, base: np.ndarray, month: np.ndarray) -> np.ndarray:
    """Probabilities under each calendar month's fit; base marks the calibration
    years. NaN where there are too few of them."""
    zero, shape, scale = (np.full(len(x), np.nan) for _ in range(3))
    valid = np.isfinite(x)
    for m in np.unique(month):
        own = month == m
        cal = x[own & valid & base]
        if len(cal) >= 15 and (cal > 0).sum() >= 10:
            zero[own] = float((cal == 0).mean())
            shape[own], scale[own] = gamma_fit(cal[cal > 0])
    out = np.full(len(x), np.nan)
    use = valid & np.isfinite(zero)
    q, v = zero[use], x[use]
    out[use] = np.where(v <= 0, q / 2, q + (1 - q) * gamma_cdf(np.maximum(v, 0) / scale[use], shape[use]))
    return out


def spei_probability(x: np.ndarray, base: np.ndarray, month: np.ndarray) -> np.ndarray:
    """The same of balances, by log-logistic fits of L-moments."""
    out, valid = np.full(len(x), np.nan), np.isfinite(x)
    for m in np.unique(month):
        own = (month == m) & valid
        cal = np.sort(x[own & base])
        n = len(cal)
        if n < 15 or cal[0] == cal[-1]:
            continue
        f = (np.arange(1, n + 1) - 0.35) / n
        w0, w1, w2 = cal.mean(), float((cal * (1 - f)).mean()), float((cal * (1 - f) ** 2).mean())
        bottom = 6 * w1 - w0 - 6 * w2
        beta = (2 * w1 - w0) / bottom if bottom else math.nan
        if not math.isfinite(beta) or abs(beta) <= 1:
            beta = math.copysign(1.0001, beta) if math.isfinite(beta) else 1.0001
        g = math.gamma(1 + 1 / beta) * math.gamma(1 - 1 / beta)
        alpha = (w0 - 2 * w1) * beta / g
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            ratio = alpha / (x[own] - (w0 - alpha * g))
            inside = 1 / (1 + np.where(ratio > 0, ratio, 1.0) ** beta)
        out[own] = np.where(np.isinf(ratio), 0.0 if beta > 0 else 1.0, np.where(ratio > 0, inside, 0.0 if beta > 0 else 1.0))
    return out


def _drought(df: DataFrame, keys: Sequence[str], month: str, value, scale: int, calibration: tuple[int, int] | None, fit) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(month).rowsBetween(-(scale - 1), 0)
    v = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_v", v).withColumn("_x", F.when(F.count("_v").over(w) == scale, F.sum("_v").over(w)))
    base = F.lit(True) if calibration is None else F.year(month).between(*calibration)
    d = d.select(*keys, month, F.month(month).alias("_m"), "_x", base.alias("_b"))
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = _z(fit(pdf["_x"].to_numpy(float), pdf["_b"].to_numpy(bool), pdf["_m"].to_numpy()))
        return pdf[[*keys, month]].assign(z=pd.array(z, dtype="Float64"))

    return d.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, month)) + ", z double")


def spi(df: DataFrame, keys: Sequence[str], month: str, value: str, scale: int = 3, calibration: tuple[int, int] | None = None) -> DataFrame:
    """(keys, month, z): standardised precipitation of `scale` months."""
    return _drought(df, keys, month, value, scale, calibration, spi_probability)


def spei(df: DataFrame, keys: Sequence[str], month: str, precipitation: str, demand: str, scale: int = 3, calibration: tuple[int, int] | None = None) -> DataFrame:
    """(keys, month, z): the same of precipitation less evaporative demand."""
    return _drought(df, keys, month, F.col(precipitation) - F.col(demand), scale, calibration, spei_probability)


def recovery_curve(t: np.ndarray, y: np.ndarray) -> dict:
    """A - (A - y0) exp(-r t), A >= 0, 1e-4 <= r <= 5. For a fixed r the curve is
    linear in A and y0, so the fit is a search for r alone. Standard errors are
    those of the linearised model, NULL where it doesn't tell the parameters apart."""
    good = np.isfinite(t) & np.isfinite(y)
    t, y = t[good], y[good]
    out = {"n": len(y), "converged": False} | dict.fromkeys(("a", "rate", "start", "half_life", "r2", "a_se", "rate_se", "start_se"))
    if len(y) < 4 or len(np.unique(t)) < 3:
        return out
    t = t - t[0]

    def linear(log_r: float) -> tuple[float, np.ndarray]:
        e = np.exp(-math.exp(log_r) * t)
        x = np.stack([1 - e, e], axis=1)
        p = np.linalg.lstsq(x, y, rcond=None)[0]
        if p[0] < 0:
            p = np.array([0.0, float(e @ y) / float(e @ e)])
        return float(((y - x @ p) ** 2).sum()), p

    lo, hi = math.log(1e-4), math.log(5)
    grid = np.linspace(lo, hi, 60)
    at = int(np.argmin([linear(g)[0] for g in grid]))
    a, b = grid[max(at - 1, 0)], grid[min(at + 1, 59)]
    phi = (math.sqrt(5) - 1) / 2
    c, d = b - phi * (b - a), a + phi * (b - a)
    for _ in range(80):
        if linear(c)[0] < linear(d)[0]:
            b, d = d, c
            c = b - phi * (b - a)
        else:
            a, c = c, d
            d = a + phi * (b - a)
    best = (a + b) / 2
    loss, p = linear(best)
    rate, total = math.exp(best), float(((y - y.mean()) ** 2).sum())
    e = np.exp(-rate * t)
    j = np.stack([1 - e, (p[0] - p[1]) * t * e, e], axis=1)
    if np.linalg.matrix_rank(j) == 3:
        se = np.sqrt(np.diag(np.linalg.inv(j.T @ j)) * loss / (len(y) - 3))
        out |= dict(zip(("a_se", "rate_se", "start_se"), se.tolist()))
    return out | {"converged": True, "a": float(p[0]), "rate": rate, "start": float(p[1]), "half_life": math.log(2) / rate, "r2": 1 - loss / total if total > 0 else None}


def recovery_fit(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """The curve of each group's series."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values(year)
        return [recovery_curve(pdf[year].to_numpy(float), pdf[value].to_numpy(float))]

    return _grouped(df.select(*keys, year, value), keys, "n int, converged boolean, a double, rate double, start double, half_life double, r2 double, a_se double, rate_se double, start_se double", fit)
