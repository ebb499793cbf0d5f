"""Forecast scores as grouped aggregates.  Rows: the keys, actual, forecast (null: missing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY, pool_score


def _a() -> Column:
    return F.col("actual")


def _p() -> Column:
    return F.col("forecast")


def mape() -> Column:
    return F.avg(F.when(_a().isNotNull() & (_a() != 0) & _p().isNotNull(), F.abs((_p() - _a()) / _a()) * 100))


def bias() -> Column:
    return F.avg(F.when(_a().isNotNull() & (_a() != 0) & _p().isNotNull(), (_p() - _a()) / _a() * 100))


def spee_score() -> Column:
    """Pool score of the monthly log errors of positive pairs."""
    e = F.when((_a() > 0) & (_p() > 0), F.ln(_p() / _a()))
    return pool_score(e)


#: Aggregates by name, over (actual, forecast).
METRICS = {"mape": mape, "bias": bias, "spee_score": spee_score}


def log_errors(rows: DataFrame, by: list[str], policy: str = "epsilon", floor: float = 1e-6) -> DataFrame:
    """Adds e = ln(forecast / actual) over positive actuals.  _a() forecast of zero or less is
    dropped (e null), set to a floor (a share of the median actual) or an error, by policy;
    a missing forecast of a positive actual is an error."""
    eps = F.greatest(F.lit(TINY), floor * F.greatest(F.coalesce(F.median(F.when(_a() > 0, _a())).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(TINY)))
    x = rows.withColumn("epsilon", eps)
    low = {"drop": F.lit(None).cast("double"), "epsilon": F.ln(F.col("epsilon") / _a()), "error": F.raise_error(F.lit("forecast of zero or less")).cast("double")}[policy]
    e = F.when(_a() > 0, F.when(_p().isNull(), F.raise_error(F.lit("missing forecast")).cast("double")).when(_p() > 0, F.ln(_p() / _a())).otherwise(low))
    return x.withColumn("e", e)


def audit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counters of what the log errors used."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(_a().isNull()).alias("missing_actual"), F.count_if(_a() <= 0).alias("nonpositive_actual"), F.count_if((_a() > 0) & (_p() <= 0)).alias("zero_forecast"), F.count_if(_a() > 0).alias("scored"))


def merge_audits(audits: DataFrame, by: list[str]) -> DataFrame:
    """Audits (and their median epsilon, if they have one) summed up."""
    counts = [c for c in ("rows", "missing_actual", "nonpositive_actual", "zero_forecast", "scored") if c in audits.columns]
    more = [F.median("epsilon").alias("epsilon")] if "epsilon" in audits.columns else []
    sums = [F.sum(c).alias(c) for c in counts]
    return (audits.groupBy(*by) if by else audits.groupBy()).agg(*sums, *more)


def _unusable(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def cumulative(rows: DataFrame, by: list[str], floor: float = 1e-6, zero: str = "epsilon") -> DataFrame:
    """by, e: ln of total forecast over total actual in months with an actual.  Null if any forecast
    of the unit is missing or not finite, or the total actual isn't positive; a total forecast of zero
    is set to a share of the actual, dropped (null) or an error, by policy."""
    a = F.sum(F.when(_a().isNotNull(), F.greatest(_a(), F.lit(0.0))))
    f = F.sum(F.when(_a().isNotNull(), F.greatest(_p(), F.lit(0.0))))
    x = rows.groupBy(*by).agg(a.alias("a"), f.alias("f"), F.count_if(_unusable(_p())).alias("bad"))
    low = {"epsilon": F.ln(F.greatest(F.col("f"), floor * F.col("a")) / F.col("a")), "drop": F.lit(None).cast("double"), "error": F.raise_error(F.lit("total forecast of zero")).cast("double")}[zero]
    return x.select(*by, F.when((F.col("a") > 0) & (F.col("bad") == 0), F.when((F.col("f") > 0) & (F.col("f") >= floor * F.col("a")), F.ln(F.col("f") / F.col("a"))).otherwise(low)).alias("e"))


def monthly_mean(rows: DataFrame, by: list[str], floor: float = 1e-4) -> DataFrame:
    """by, e, status, actual_positive, forecast_floored: mean log error of months with a positive
    actual; forecasts of zero or less at a floor.  Null with a status if fewer than two actuals are
    positive or a forecast of them is missing or not finite."""
    w = Window.partitionBy(*by)
    pos = _a() > 0
    eps = F.greatest(F.lit(1e-9), floor * F.median(F.when(pos, _a())).over(w))
    x = rows.withColumn("_eps", eps)
    e = F.when(pos & ~_unusable(_p()), F.ln(F.when(_p() > 0, _p()).otherwise(F.col("_eps")) / _a()))
    x = x.groupBy(*by).agg(F.avg(e).alias("m"), F.count_if(pos).alias("actual_positive"), F.count_if(pos & (_p() <= 0)).alias("forecast_floored"), F.count_if(pos & _unusable(_p())).alias("bad"))
    status = F.when(F.col("actual_positive") < 2, "insufficient_actual_positive").when(F.col("bad") > 0, "nonfinite_forecast").otherwise("ok")
    return x.select(*by, F.when(status == "ok", F.col("m")).alias("e"), status.alias("status"), "actual_positive", "forecast_floored")


def ablation_mean(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, e: mean log error of months that both vectors have and whose actual is positive (two at
    least); a forecast that isn't finite or positive counts as 1e-9.  Months beyond the shorter vector
    have no row."""
    pos = _a() > 0
    e = F.when(pos, F.ln(F.when(_unusable(_p()) | (_p() <= 0), F.lit(1e-9)).otherwise(_p()) / _a()))
    return rows.groupBy(*by).agg(F.when(F.count_if(pos) >= 2, F.avg(e)).alias("e"))


def arm_summary(errors: DataFrame, by: list[str]) -> DataFrame:
    """``decomposition`` with mean and median of |e|."""
    more = errors.groupBy(*by).agg(F.median(F.abs("e")).alias("median_abs"))
    return decomposition(errors, by).join(more, by)


def available_mean(errors: DataFrame, by: list[str]) -> DataFrame:
    """by, e: the mean of the errors that there are (of a well's phases, say)."""
    return errors.groupBy(*by).agg(F.avg("e").alias("e"))


def decomposition(errors: DataFrame, by: list[str]) -> DataFrame:
    """Bias and spread parts of the pool score over one error per unit; null under two."""
    m, s = F.lit(2 / 3) * F.abs(F.median("e")), F.lit(1 / 3) * F.stddev_pop("e")
    aggs = [F.count("e").alias("n"), F.median("e").alias("median"), m.alias("bias_part"), s.alias("spread_part"), F.avg(F.abs("e")).alias("mean_abs")]
    x = (errors.groupBy(*by) if by else errors.groupBy()).agg(*aggs)
    score = F.when(F.col("n") >= 2, F.col("bias_part") + F.col("spread_part"))
    share = F.when(F.col("n") >= 2, F.when(score > 0, F.col("bias_part") / score).otherwise(0.0))
    return x.select(*by, "n", "median", "bias_part", "spread_part", "mean_abs", score.alias("score"), share.alias("bias_share"))


def tails(errors: DataFrame, by: list[str]) -> DataFrame:
    """p90, p95, p99, largest |e| and the share beyond a factor of two."""
    x = F.abs("e")
    p = F.percentile(x, F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    out = errors.groupBy(*by).agg(p.alias("p"), F.max(x).alias("largest"), F.avg((x > F.ln(F.lit(2.0))).cast("double")).alias("catastrophic"))
    return out.select(*by, F.col("p")[0].alias("p90"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "largest", "catastrophic")


def provider_benchmark(actual: DataFrame, forecasts: DataFrame, metric: str = "mape") -> DataFrame:
    """phase, scored, unavailable, missing (units), median and mean of the metric over scored units.
    actual: well_id, phase, h, actual, available; forecasts: well_id, phase, h, volume.  A phase that a
    well hasn't is unavailable; an available unit without a forecast is missing, loudly."""
    unit = ["well_id", "phase"]
    there = forecasts.select(*unit).distinct().withColumn("_there", F.lit(True))
    pairs = actual.join(forecasts.withColumnRenamed("volume", "forecast"), [*unit, "h"], "left")
    x = pairs.groupBy(*unit).agg(F.first("available").alias("available"), METRICS[metric]().alias("m")).join(there, unit, "left")
    status = F.when(~F.col("available"), "unavailable").when(F.col("_there").isNull(), "missing").otherwise("scored")
    x = x.withColumn("status", status).withColumn("m", F.when(status == "scored", F.col("m")))
    return x.groupBy("phase").agg(*(F.count_if(F.col("status") == k).alias(k) for k in ("scored", "unavailable", "missing")), F.median("m").alias("median"), F.avg("m").alias("mean"))


def pad_streams(rows: DataFrame, pads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, pad, phase, h, actual, forecast: the wells of a pad summed up.  pads: well_id, pad."""
    return rows.join(pads, "well_id").groupBy(*by, "pad", "phase", "h").agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"))


def routing_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, loss: log part, relative part and share of forecasts where nothing was produced; 9 if
    forecasts are missing or fewer than two actuals are positive."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("scale", F.greatest(F.coalesce(F.median(F.when(_a() > 0, _a())).over(w), F.lit(1.0)), F.lit(1.0)))
    eps = F.greatest(F.lit(1e-9), 1e-4 * F.col("scale"))
    x = x.withColumn("e", F.when(_a() > 0, F.ln(F.when(_p() > 0, _p()).otherwise(eps) / _a())))
    rel = F.avg(F.when(_a().isNotNull(), F.abs(F.greatest(_p(), F.lit(0.0)) - F.greatest(_a(), F.lit(0.0))))) / F.first("scale")
    zero = F.avg(F.when(_a().isNotNull(), ((_a() <= 0) & (_p() > 0.05 * F.col("scale"))).cast("double")))
    loss = 0.7 * (F.lit(2 / 3) * F.abs(F.median("e")) + F.lit(1 / 3) * F.stddev_pop("e")) + 0.2 * rel + 0.1 * zero
    return x.groupBy(*by).agg(F.when((F.count("e") >= 2) & (F.count_if(_p().isNull()) == 0), loss).otherwise(9.0).alias("loss"))


def relative_delta(challenger: Column, base: Column) -> Column:
    return (challenger - base) / F.nullif(F.abs(base), F.lit(0.0))
