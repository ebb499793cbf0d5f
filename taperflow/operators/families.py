"""Candidate families: exponential, hyperbolic and stretched exponential on the calendar axis.

Series are packed into one row each over all calendar months (a month without a row counts as
missing, not as absent), and an Arrow kernel fits all candidates of a batch of series: every shape of
a family's grid is a closed-form regression; downtime rows are struck and the family fitted again on
the rest.  Backtest origins are slices of the packed series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import each, line, median, pack, padded, windows
from .sequence import TERMINAL

#: name, family, window, skip
CANDIDATES = [
    ("exp_18", "exponential", 18, 0),
    ("exp_36", "exponential", 36, 0),
    ("hyper_18", "hyperbolic", 18, 0),
    ("hyper_36", "hyperbolic", 36, 0),
    ("hyper_48", "hyperbolic", 48, 0),
    ("recovery_skip3", "hyperbolic", 36, 3),
    ("stretched_24", "stretched", 24, 0),
]
# Shape grids of the families.
HYPERBOLIC_B = (0.35, 0.50, 0.65, 0.80, 0.95, 1.10, 1.25)
STRETCHED_N = (0.45, 0.60, 0.75, 0.90, 1.05)
SHAPES = {"exponential": (0.0,), "hyperbolic": HYPERBOLIC_B, "stretched": STRETCHED_N}
KEY = ["well_id", "phase", "name"]
STRIKE, LEAST, UPTIME_MONTHS = 0.65, 5, 24


def candidates(spark, names: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([c for c in CANDIDATES if names is None or c[0] in names], "name string, family string, window int, skip int")


def curve(family, shape, a, c, t) -> F.Column:
    """Volume at t from the regression's intercept a and slope c."""
    hyper = F.pow(a, -1 / shape) / F.pow(1 + F.greatest(c, F.lit(0.0)) / a * t, 1 / shape)
    return F.when(family == "exponential", F.exp(a + F.least(c, F.lit(-1e-6)) * t)).when(family == "hyperbolic", hyper).otherwise(F.exp(a + c * F.pow(F.greatest(t, F.lit(0.0)), shape)))


def curve_values(family: str, shape, a, c, t) -> np.ndarray:
    """The same for arrays."""
    if family == "exponential":
        return np.exp(a + np.minimum(c, -1e-6) * t)
    if family == "hyperbolic":
        return a ** (-1 / shape) / (1 + np.maximum(c, 0) / a * t) ** (1 / shape)
    return np.exp(a + c * np.maximum(t, 0) ** shape)


def _best(q: np.ndarray, on: np.ndarray, family: str) -> np.ndarray:
    """(shape, a, c) of least median |error| + deviation / 4 over the places ``on``; NaN if none."""
    shape = np.array(SHAPES[family])
    t = np.arange(q.shape[1], dtype=float)[None, :, None]
    on = np.broadcast_to(on[:, :, None], (*q.shape, len(shape)))
    q = np.where(on, q[:, :, None], 1.0)
    with np.errstate(all="ignore"):
        y = np.maximum(q, 1e-9) ** -shape if family == "hyperbolic" else np.log(q)
        at = t**shape if family == "stretched" else t
        c, a = line(np.broadcast_to(at, on.shape), np.broadcast_to(y, on.shape), on)
        ok = ~np.isnan(c)
        if family == "hyperbolic":
            ok &= (a > 0) & (c >= 0) & (c / (a * shape) <= 1.5)
        elif family == "stretched":
            ok &= c < 0
        e = np.log(np.maximum(curve_values(family, shape, a[:, None], c[:, None], t), 1e-9) / q)
        n = on.sum(axis=1)
        mean = np.where(on, e, 0).sum(axis=1) / n
        spread = np.sqrt(np.where(on, (e - mean[:, None]) ** 2, 0).sum(axis=1) / n)
        loss = np.round(median(np.abs(e), on) + 0.25 * spread, 12)
    loss = np.where(ok & ~np.isnan(loss), loss, np.inf)
    pick, rows = loss.argmin(axis=1), np.arange(len(q))
    return np.where(np.isfinite(loss[rows, pick]), np.stack([shape[pick], a[rows, pick], c[rows, pick]]), np.nan)


def _fit_one(x: np.ndarray, n: np.ndarray, spec: tuple) -> dict[str, np.ndarray]:
    """One candidate for all series: shape, a, c (NaN: no fit), origin, uptime."""
    _, family, window, skip = spec
    end = np.maximum(n - skip, 0)
    there = np.arange(x.shape[1]) < end[:, None]
    peak = np.where(there & ~np.isnan(x), x, -np.inf).argmax(axis=1)
    start = np.maximum(peak, end - window)
    size = end - start
    q, on = windows(x, start, np.maximum(size, 0))
    with np.errstate(all="ignore"):
        pos = on & (q > 0)
        many = pos.sum(axis=1)
        t = np.arange(q.shape[1], dtype=float)
        p1 = _best(q, pos & (many >= LEAST)[:, None], family)
        kept = pos & (q >= STRIKE * curve_values(family, *(p1[k][:, None] for k in range(3)), t))
        again = (kept.sum(axis=1) >= LEAST) & (kept.sum(axis=1) < many)
        p2 = _best(q, kept & again[:, None], family)
        p = np.where(again & ~np.isnan(p2[0]), p2, p1)
        cap = curve_values(family, *(p[k][:, None] for k in range(3)), t)
        near = on & (t >= (size - UPTIME_MONTHS)[:, None]) & ~np.isnan(q) & (cap > 0)
        uptime = np.where(near, np.clip(q / cap, 0, 1), 0).sum(axis=1) / near.sum(axis=1)
    return {"shape": p[0], "a": p[1], "c": p[2], "origin": (n - start).astype(float), "uptime": np.where(near.any(axis=1), uptime, 1.0)}


def _specs(specs: DataFrame | list[tuple]) -> list[tuple]:
    return specs if isinstance(specs, list) else [tuple(r) for r in specs.collect()]  # a row a candidate


def fit_packed(packed: DataFrame, specs: DataFrame | list[tuple], keys: list[str] | None = None) -> DataFrame:
    """keys, name, family, shape, a, c, origin, uptime; candidates with under five positive months
    have no row."""
    specs = _specs(specs)

    def kernel(series: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        x, n = padded(series)
        return [_fit_one(x, n, s) | {"name": [s[0]] * len(n), "family": [s[1]] * len(n)} for s in specs]

    got = each(packed, keys or KEY[:2], "name string, family string, shape double, a double, c double, origin double, uptime double", kernel)
    return got.filter("a IS NOT NULL").withColumn("origin", F.col("origin").cast("int"))


def fit(rows: DataFrame, specs: DataFrame | list[tuple]) -> DataFrame:
    """KEY, family, shape, a, c, origin, uptime of long rows."""
    return fit_packed(pack(rows), specs)


def terminal(volumes: np.ndarray, monthly: float = TERMINAL) -> np.ndarray:
    """Rows of volumes never rising, and from the first month whose decline is slower than the
    terminal one, that exponential."""
    q = np.minimum.accumulate(np.maximum(np.nan_to_num(volumes, nan=0.0, posinf=np.inf), 0), axis=1)
    slow = np.log(np.maximum(q[:, :-1], 1e-9) / np.maximum(q[:, 1:], 1e-9)) < monthly
    at = np.where(slow.any(axis=1), slow.argmax(axis=1), q.shape[1])
    t = np.arange(q.shape[1])
    start = np.take_along_axis(q, np.minimum(at, q.shape[1] - 1)[:, None], axis=1)
    return np.where((q[:, :1] > 0) & (t > at[:, None]), start * np.exp(-monthly * (t - at[:, None])), q)


def forecast_packed(packed: DataFrame, specs: DataFrame | list[tuple], horizon: int, terminal_decline: bool, keys: list[str] | None = None) -> DataFrame:
    """keys, name, v (the volumes of h = 1 ..) of the candidates that can be fitted."""
    specs = _specs(specs)

    def kernel(series: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        x, n = padded(series)
        out = []
        for s in specs:
            f = _fit_one(x, n, s)
            with np.errstate(all="ignore"):
                v = np.maximum(curve_values(s[1], *(f[k][:, None] for k in ("shape", "a", "c")), f["origin"][:, None] + np.arange(horizon)) * f["uptime"][:, None], 0)
                v = terminal(v) if terminal_decline else v
            out.append({"name": [s[0]] * len(n), "a": f["a"], "v": v})
        return out

    return each(packed, keys or KEY[:2], "name string, a double, v array<double>", kernel).filter("a IS NOT NULL").drop("a")


def forecast(fits: DataFrame, horizon: int, terminal: bool = False) -> DataFrame:
    """KEY, h, volume."""
    from .sequence import terminal_decline

    x = fits.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    v = F.greatest(curve(F.col("family"), F.col("shape"), F.col("a"), F.col("c"), (F.col("origin") + F.col("h") - 1).cast("double")) * F.col("uptime"), F.lit(0.0))
    x = x.select(*KEY, "h", v.alias("volume"))
    if terminal:
        y = terminal_decline(x.select("well_id", F.concat_ws("|", "phase", "name").alias("phase"), F.col("h").alias("t"), F.col("volume").alias("q")))
        x = y.select("well_id", F.split("phase", "[|]")[0].alias("phase"), F.split("phase", "[|]")[1].alias("name"), F.col("t").alias("h"), F.col("q").alias("volume"))
    return x


def backtest_origins(packed: DataFrame, horizons: tuple[int, ...] = (3, 6), most: int = 2, least: int = 5) -> DataFrame:
    """well_id, phase, rank (0 the newest), horizon, train and held (arrays) of the rolling origins
    whose held-out months have enough positive volumes."""
    grid = [(h, r) for h in horizons for r in range(most)]
    x = packed.withColumn("n", F.size("q"))
    x = x.withColumn("o", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(r).alias("rank"), (F.col("n") - h * (r + 1)).alias("cutoff")) for h, r in grid))))
    x = x.select("well_id", "phase", "q", "o.*").filter(F.col("cutoff") >= F.greatest(F.col("horizon") + least, F.lit(8)))
    x = x.select("well_id", "phase", "horizon", "rank", F.slice("q", 1, F.col("cutoff")).alias("q"), F.slice("q", F.col("cutoff") + 1, F.col("horizon")).alias("held"))
    enough = F.size(F.filter("held", lambda v: v > 0)) >= F.greatest(F.lit(2), F.floor(F.col("horizon") / 2))
    return x.filter(enough)


def backtest_scores(origins: DataFrame, volumes: DataFrame, by: list[str]) -> DataFrame:
    """by, score: routing losses of the origins, newer ones weighing more.  volumes: well_id, phase,
    horizon, rank, held, v and what else ``by`` names."""
    from .metrics import routing_loss

    one = ["horizon", "rank"]
    pairs = volumes.select(*by, *one, F.posexplode(F.arrays_zip("held", F.slice("v", 1, F.col("horizon")).alias("v"))).alias("p", "z"))
    loss = routing_loss(pairs.select(*by, *one, F.col("z.held").alias("actual"), F.col("z.v").alias("forecast")), [*by, *one])
    w = 1 / (1 + F.col("rank"))
    return loss.groupBy(*by).agg((F.sum(F.col("loss") * w) / F.sum(w)).alias("score"))


def backtest_packed(packed: DataFrame, specs: DataFrame | list[tuple], terminal: bool = True) -> DataFrame:
    """KEY, score of packed series."""
    o = backtest_origins(packed)
    return backtest_scores(o, forecast_packed(o, specs, 6, terminal, ["well_id", "phase", "horizon", "rank", "held"]), KEY)


def backtest(rows: DataFrame, specs: DataFrame | list[tuple], terminal: bool = True) -> DataFrame:
    """KEY, score of long rows."""
    return backtest_packed(pack(rows), specs, terminal)


def winners(scores: DataFrame) -> DataFrame:
    """well_id, phase, name of the least score, ties by name."""
    return scores.groupBy("well_id", "phase").agg(F.min_by("name", F.struct(F.round("score", 9), "name")).alias("name"), F.min("score").alias("score"))
