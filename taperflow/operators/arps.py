"""Decline-curve arms.

An arm is a row of a small table (exponent cap, window, uptime, guard, lag skip).  Each series is
packed into one row (the only shuffle) and an Arrow kernel fits all arms of a batch of series at
once: every exponent of the grid is a closed-form regression over the window, first plain, then
weighted over the months that weren't down, and the exponent of least squared error is taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TINY, hyperbolic
from .packed import each, line, median, pack, padded, reported, windows

DOWNTIME = 0.75
UPTIME_MONTHS = 24
#: name, largest exponent, window (None: all), uptime, guard, skip
ARMS = [
    ("bounded", 1.3, 36, True, False, 0),
    ("window_24", 1.3, 24, True, False, 0),
    ("window_48", 1.3, 48, True, False, 0),
    ("all_post_peak", 1.3, None, True, False, 0),
    ("no_uptime", 1.3, 36, False, False, 0),
    ("recent_low_guard", 1.3, 36, True, True, 0),
    ("b_cap_1p0", 1.0, 36, True, False, 0),
    ("lag_skip_2", 1.3, 36, True, False, 2),
    ("lag_skip_3", 1.3, 36, True, False, 3),
    ("lag_skip_2_b_cap_1p0", 1.0, 36, True, False, 2),
]
KEY = ["well_id", "phase", "arm"]
B = np.array([k / 100 for k in range(30, 131, 5)])


def arms_table(spark, names: list[str] | None = None) -> DataFrame:
    rows = [a for a in ARMS if names is None or a[0] in names]
    return spark.createDataFrame(rows, "arm string, b_max double, win int, use_uptime boolean, guard boolean, skip int")


def _curve(t: np.ndarray, qi: np.ndarray, di: np.ndarray, b: np.ndarray) -> np.ndarray:
    return qi / (1 + b * di * t) ** (1 / b)


def _best(x: np.ndarray, on: np.ndarray, b: np.ndarray, weighted: bool) -> np.ndarray:
    """(qi, di, b) of least error for each row, NaN without one; the smallest b of equal ones."""
    t = np.arange(x.shape[1], dtype=float)
    pos = (on & (x > 0))[:, :, None]
    with np.errstate(all="ignore"):
        z = np.where(pos, np.maximum(x, TINY)[:, :, None] ** -b, 0.0)
        if weighted:
            w = 1 / np.maximum(z, TINY)
            rel = w / median(w, np.broadcast_to(pos, z.shape))[:, None]
            w = np.where(pos, np.clip(rel, 0.1, 10) ** 2, 0)
            tt = t[:, None]
            s0, st, sz, stt, stz = (v.sum(axis=1) for v in (w, w * tt, w * z, w * tt * tt, w * tt * z))
            det = s0 * stt - st * st
            c = np.where(det != 0, (s0 * stz - st * sz) / det, np.nan)
            a = (sz - c * st) / s0
        else:
            c, a = line(t[None, :, None], z, np.broadcast_to(pos, z.shape))
        low = np.maximum(c, 0)
        qi, di = a ** (-1 / b), low / (a * b)
        good = (a > 0) & ~np.isnan(c) & (di <= 1)
        r = _curve(t[:, None], qi[:, None], di[:, None], b) - x[:, :, None]
        if weighted:
            r = r / x[:, :, None]
        sse = np.where(on[:, :, None], r * r, 0).sum(axis=1)
        sse = np.where(good & ~np.isnan(sse), sse, np.inf)
    pick = sse.argmin(axis=1)
    rows = np.arange(len(x))
    out = np.stack([qi[rows, pick], di[rows, pick], b[pick]])
    return np.where(np.isfinite(sse[rows, pick]), out, np.nan)


def _fit_arm(x: np.ndarray, n: np.ndarray, peak: np.ndarray, arm: tuple) -> dict[str, np.ndarray]:
    """One arm for all series (rows of x, lengths n): qi, di, b, uptime, len; tail: reported over
    fitted volumes, newest first, NaN where there is none."""
    _, b_max, win, use_uptime, guard, skip = arm
    start = np.maximum(peak, n - (n if win is None else win))
    length = np.where(n >= 3, n - start, 0)
    size = np.where((skip > 0) & (length > skip + 2), length - skip, length)
    q, on = windows(x, start, size)
    grid = B[b_max + 1e-9 >= B]
    t = np.arange(q.shape[1], dtype=float)
    p1 = _best(q, on, grid, False)
    with np.errstate(all="ignore"):
        trend = _curve(t, *p1[:, :, None])
        keep = on & (q >= DOWNTIME * trend) & (q > 0)
        low = on & ((q <= 0) | (q < DOWNTIME * trend))
        enough = keep.sum(axis=1) >= 3
        p2 = _best(q, keep & enough[:, None], grid, True)
        p = np.where(enough & ~np.isnan(p2[0]) & ~np.isnan(p1[0]), p2, p1)
        cap = _curve(t, *p[:, :, None])
        near = on & (t >= (size - UPTIME_MONTHS)[:, None]) & (cap > 0)
        uptime = np.where(near, q / cap, 0).sum(axis=1) / near.sum(axis=1)
        uptime = np.where(use_uptime & near.any(axis=1), np.clip(uptime, 0, 1), 1.0)
        depressed = guard & ((low & (t >= (size - 2)[:, None])).sum(axis=1) == 2)
        back = size[:, None] - 1 - np.arange(q.shape[1])
        at = np.maximum(back, 0)
        tail = np.where((back >= 0) & (np.take_along_axis(cap, at, axis=1) > 0), np.take_along_axis(q, at, axis=1) / np.take_along_axis(cap, at, axis=1), np.nan)
    none = np.isnan(p[0]) | depressed
    gone = lambda v: np.where(none, np.nan, v)
    return {"qi": gone(p[0]), "di": gone(p[1]), "b": gone(p[2]), "uptime": gone(uptime), "len": gone(length.astype(float)), "tail": tail}


FIELDS = "arm string, qi double, di double, b double, uptime double, len double, level double, tail array<double>"


def fit_packed(packed: DataFrame, arms: DataFrame | list[tuple], keys: list[str] | None = None, tail: int = 0) -> DataFrame:
    """keys, arm, qi, di, b (null: no fit), uptime, len, level of packed series; tail: the newest
    ratios of reported to fitted volumes."""
    specs = arms if isinstance(arms, list) else [tuple(r) for r in arms.collect()]  # a row an arm

    def kernel(series: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        x, n = padded(series)
        peak = np.where(np.arange(x.shape[1]) < n[:, None], x, -np.inf).argmax(axis=1)
        level = np.array([s[-3:].mean() if len(s) else 0.0 for s in series])
        out = []
        for arm in specs:
            got = _fit_arm(x, n, peak, arm)
            got["tail"] = [r[:tail] for r in got["tail"]]
            out.append(got | {"arm": [arm[0]] * len(n), "level": level})
        return out

    keys = keys or KEY[:2]
    closed = packed.withColumn("q", reported())
    got = each(closed, keys, FIELDS, kernel)
    return got.withColumn("len", F.col("len").cast("int"))


def fit(series: DataFrame, arms: DataFrame) -> DataFrame:
    """KEY, qi, di, b (null: no fit), uptime, len, level."""
    return fit_packed(pack(series), arms).drop("tail")


def forecast(fits: DataFrame, horizon: int) -> DataFrame:
    """KEY, h (from 1), volume."""
    x = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    curve = hyperbolic(F.col("len") + F.col("h") - 1, F.col("qi"), F.col("di"), F.col("b")) * F.col("uptime")
    return x.select(*KEY, "h", F.when(F.col("qi").isNotNull(), curve).otherwise(F.col("level")).alias("volume"))


def capacity_ratios(series: DataFrame, months_back: int = 6) -> DataFrame:
    """well_id, phase, offset (months before the cutoff), ratio of reported to fitted capacity."""
    fits = fit_packed(pack(series), arms_table(series.sparkSession, ["bounded"]), tail=months_back).filter("qi IS NOT NULL")
    x = fits.select("well_id", "phase", F.posexplode("tail").alias("offset", "ratio"))
    return x.filter("ratio IS NOT NULL AND NOT isnan(ratio)").withColumn("offset", (F.col("offset") + 1).cast("int"))


def inner_score(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, score of actual against forecast volumes; rows: by, actual, volume."""
    ok = F.col("actual").isNotNull() & F.col("volume").isNotNull()
    e = F.when(ok & (F.col("actual") > 0) & (F.col("volume") > 0), F.ln(F.col("volume") / F.col("actual")))
    ape = F.avg(F.when(ok & (F.col("actual") != 0), F.abs((F.col("volume") - F.col("actual")) / F.col("actual"))))
    mae = F.avg(F.when(ok, F.abs(F.col("volume") - F.col("actual")))) / (F.avg(F.when(ok, F.abs("actual"))) + 1)
    score = F.when(F.count(e) >= 2, F.lit(2 / 3) * F.abs(F.median(e)) + F.lit(1 / 3) * F.stddev_pop(e)).otherwise(F.coalesce(ape, mae))
    return pairs.groupBy(*by).agg(score.alias("score"))


ROUTED = ["bounded", "window_24", "window_48", "no_uptime", "recent_low_guard", "b_cap_1p0", "lag_skip_2", "lag_skip_3", "lag_skip_2_b_cap_1p0"]


def routed(series: DataFrame, horizon: int) -> DataFrame:
    """The arm that does best on each series' own last months, refitted on all of them.

    Every arm is fitted on the whole series and on the part before its own hold-out in one pass over
    the packed series; the scores are one aggregation."""
    spark = series.sparkSession
    names = [a[0] for a in ARMS if a[0] in ROUTED]
    arms = [a for a in ARMS if a[0] in ROUTED]
    x = pack(series).withColumn("q", reported()).withColumn("n", F.size("q")).withColumn("ih", F.least(F.lit(6), F.floor(F.col("n") / 5)).cast("int"))
    able = x.filter("ih >= 3 AND n - ih >= 18")
    inner = able.select("well_id", "phase", F.slice("q", 1, F.col("n") - F.col("ih")).alias("q"))
    held = able.select("well_id", "phase", F.posexplode(F.slice("q", F.col("n") - F.col("ih") + 1, F.col("ih"))).alias("h", "actual")).withColumn("h", F.col("h") + 1)
    scored = inner_score(forecast(fit_packed(inner, arms), 6).join(held, ["well_id", "phase", "h"]), KEY)
    order = F.create_map(*[F.lit(v) for k, n in enumerate(names) for v in (n, k)])
    best = scored.filter("score IS NOT NULL").groupBy("well_id", "phase").agg(F.min_by("arm", F.struct(F.round("score", 9), order[F.col("arm")])).alias("chosen"))
    whole = fit_packed(x, arms).join(best, ["well_id", "phase"], "left").filter(F.col("arm") == F.coalesce("chosen", F.lit("bounded")))
    return forecast(whole.drop("chosen", "tail"), horizon)
