"""The control forecaster: bounded nonlinear hyperbolic fits, many series at once.

For given b and di the model is linear in qi, so each fit is a search in di alone: sums over time
on a (b, di) grid are matrix products over all series of a batch, the best cells are refined by
golden section, and qi follows in closed form.  The search is global, so a series with several
minima may get a lower error than a local search from a fixed start would find.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import each, pack, reported

WINDOW = 36
KEEP = 0.75
UPTIME = 24
QI_MOST = 1e8
REFINED = 4  # exponents of a series whose best cell is refined
B = np.round(0.3 + 0.05 * np.arange(21), 2)
DI = np.concatenate([[0.0], np.logspace(-5, 0, 160)])
T = np.arange(WINDOW, dtype=float)

_TABLE: list[np.ndarray] = []


def _table() -> np.ndarray:
    """(1 + b di t)^(-1/b) as a matrix: time by (b, di) cells."""
    if not _TABLE:
        g = (1 + B[:, None, None] * DI[None, :, None] * T) ** (-1 / B[:, None, None])
        _TABLE.extend([g.reshape(-1, WINDOW).T.copy(), (g * g).reshape(-1, WINDOW).T.copy()])
    return _TABLE


def _error(num, den, qq):
    """Least squared error and qi for sums w*q*g, w*g*g and w*q*q."""
    qi = np.clip(num / np.maximum(den, 1e-300), 0, QI_MOST)
    return qq - 2 * qi * num + qi * qi * den, qi


def fit_batch(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qi, di, b) per row of q (series by WINDOW) under weights w (0: no row)."""
    g, g2 = _table()
    wq = w * q
    qq = (wq * q).sum(axis=1)
    sse, _ = _error(wq @ g, w @ g2, qq[:, None])
    sse = sse.reshape(len(q), len(B), len(DI))
    cell = sse.argmin(axis=2)
    tops = np.argsort(sse.min(axis=2), axis=1, kind="stable")[:, :REFINED]
    tops.sort(axis=1)
    rows = np.arange(len(q))[:, None]
    b, at = B[tops], cell[rows, tops]
    lo, hi = DI[np.maximum(at - 1, 0)], DI[np.minimum(at + 1, len(DI) - 1)]

    def error(di):
        x = (1 + (b * di)[:, :, None] * T) ** (-1 / b[:, :, None])
        return _error((wq[:, None, :] * x).sum(axis=2), (w[:, None, :] * x * x).sum(axis=2), qq[:, None])

    golden = (np.sqrt(5) - 1) / 2
    x1, x2 = hi - golden * (hi - lo), lo + golden * (hi - lo)
    f1, f2 = error(x1)[0], error(x2)[0]
    for _ in range(32):
        left = f1 < f2
        lo, hi = np.where(left, lo, x1), np.where(left, x2, hi)
        x1n, x2n = hi - golden * (hi - lo), lo + golden * (hi - lo)
        fresh = error(np.where(left, x1n, x2n))[0]
        f1, f2 = np.where(left, fresh, f2), np.where(left, f1, fresh)
        x1, x2 = x1n, x2n
    options = np.stack([(lo + hi) / 2, DI[at], np.zeros_like(lo), np.ones_like(lo)])
    scored = [error(d) for d in options]
    errors = np.stack([s[0] for s in scored])
    pick = errors.argmin(axis=0)
    flat = lambda a: np.take_along_axis(a, pick[None], axis=0)[0]
    di, qi, best = flat(options), flat(np.stack([s[1] for s in scored])), flat(errors)
    win = best.argmin(axis=1)
    r = np.arange(len(q))
    return qi[r, win], di[r, win], b[r, win]


def _curve(qi, di, b, t):
    return qi[:, None] / (1 + (b * di)[:, None] * t) ** (1 / b[:, None])


def control_batch(series: list[np.ndarray], horizon: int) -> np.ndarray:
    """Forecasts (series by horizon) of reported volumes without gaps."""
    out = np.array([np.mean(s[-3:]) if len(s) else 0.0 for s in series])[:, None].repeat(horizon, axis=1)
    q, n = np.zeros((len(series), WINDOW)), np.zeros(len(series), int)
    for k, s in enumerate(series):
        if len(s) >= 3:
            part = s[int(np.argmax(s)) :][-WINDOW:]
            q[k, : len(part)], n[k] = part, len(part)
    on = np.flatnonzero((n > 0) & (q[:, 1:].sum(axis=1) > 0))
    if not len(on):
        return out
    q, n = q[on], n[on]
    there = T < n[:, None]
    qi, di, b = fit_batch(q, there.astype(float))
    keep = there & (q > 0) & (q >= KEEP * _curve(qi, di, b, T))
    again = np.flatnonzero((keep.sum(axis=1) >= 3) & ((q * keep).sum(axis=1) - q[np.arange(len(q)), keep.argmax(axis=1)] > 0))
    if len(again):
        w = np.where(keep[again], 1 / np.where(keep[again], q[again], 1) ** 2, 0)
        # Time is measured from the window's start; struck months have no weight.
        qi[again], di[again], b[again] = fit_batch(q[again], w)
    cap = _curve(qi, di, b, T)
    tail = there & (T >= (n - UPTIME)[:, None]) & (cap > 0)
    ratio = np.where(tail, q / np.where(tail, cap, 1), 0).sum(axis=1) / np.maximum(tail.sum(axis=1), 1)
    uptime = np.where(tail.any(axis=1), np.clip(ratio, 0, 1), 1)
    out[on] = _curve(qi, di, b, n[:, None] + np.arange(horizon)) * uptime[:, None]
    return out


def forecast_packed(series: DataFrame, horizon: int, keys: list[str] | None = None) -> DataFrame:
    """keys, v (volumes of h = 1 ..) of packed series."""
    closed = series.withColumn("q", reported())
    return each(closed, keys or ["well_id", "phase"], "v array<double>", lambda batch: [{"v": control_batch(batch, horizon)}])


def forecast(rows: DataFrame, horizon: int) -> DataFrame:
    """well_id, phase, h, volume; rows: well_id, phase, t, q."""
    out = forecast_packed(pack(rows), horizon)
    return out.select("well_id", "phase", F.posexplode("v").alias("h", "volume")).withColumn("h", (F.col("h") + 1).cast("int"))
