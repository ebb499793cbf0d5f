"""Allocation-noise classifier, endpoint bands and scenario tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import trailing

# Limits of the classifier.
LIMITS = {"residual_mad": 0.16, "reversal_rate": 0.33, "jump_rate": 0.35, "second_difference": 0.24}


def phase_noise(rows: DataFrame) -> DataFrame:
    """well_id, phase and the four features over the last 36 positive months (10 at least)."""
    by = Window.partitionBy("well_id", "phase")
    x = trailing(rows, 36, True).withColumn("m", F.count("*").over(by)).filter("m >= 10").withColumn("y", F.ln("q"))
    tt = F.col("t").cast("double")
    x = x.withColumns({"c": F.regr_slope("y", tt).over(by), "a": F.regr_intercept("y", tt).over(by)}).withColumn("r", F.col("y") - F.col("a") - F.col("c") * F.col("t"))
    o = by.orderBy("t")
    x = x.withColumns({"rm": F.median("r").over(by), "d1": F.col("y") - F.lag("y").over(o)})
    x = x.withColumn("d0", F.lag("d1").over(o))
    turn = (F.col("d0") * F.col("d1") < 0) & (F.least(F.abs("d0"), F.abs("d1")) > 0.08)
    return x.groupBy("well_id", "phase").agg((1.4826 * F.median(F.abs(F.col("r") - F.col("rm")))).alias("residual_mad"), F.avg(F.when(F.col("d0").isNotNull(), turn.cast("double"))).alias("reversal_rate"), F.avg(F.when(F.col("d1").isNotNull(), (F.abs("d1") > 0.20).cast("double"))).alias("jump_rate"), F.median(F.abs(F.col("d1") - F.col("d0"))).alias("second_difference"))


def allocation_noise(rows: DataFrame) -> DataFrame:
    """well_id, medians over phases, score (0 to 1), flagged: three checks at least, with frequent
    reversals and jumps among them."""
    x = phase_noise(rows).groupBy("well_id").agg(*(F.median(c).alias(c) for c in LIMITS), F.count("*").alias("phases"))
    checks = {c: F.col(c) >= v for c, v in LIMITS.items()}
    many = sum((k.cast("int") for k in checks.values()), F.lit(0)) >= 3
    score = sum((F.least(F.col(c) / v, F.lit(2.0)) for c, v in LIMITS.items()), F.lit(0.0)) / 8
    every = rows.select("well_id").distinct().join(x, "well_id", "left")
    flag = many & checks["reversal_rate"] & checks["jump_rate"]
    return every.select("well_id", *LIMITS, F.coalesce("phases", F.lit(0)).alias("phases"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce(flag, F.lit(False)).alias("flagged"))


def endpoint_bands(rows: DataFrame) -> DataFrame:
    """well_id, phase, band of the newest volume against the three before."""
    x = trailing(rows, 6, True)
    o = Window.partitionBy("well_id", "phase").orderBy("t")
    x = x.withColumn("d", F.ln("q") - F.lag(F.ln("q")).over(o))
    g = x.groupBy("well_id", "phase").agg(F.count("*").alias("n"), (F.max(F.when(F.col("back") == 1, F.col("q"))) / F.median(F.when(F.col("back").between(2, 4), F.col("q")))).alias("ratio"), F.stddev_pop("d").alias("sd"))
    band = F.when(F.col("n") < 4, "sparse").when(F.col("ratio") < 0.60, "low").when(F.col("ratio") > 1.60, "high").when(F.col("sd") > 0.45, "volatile").otherwise("normal")
    return g.select("well_id", "phase", band.alias("band"), "ratio")


def seed_spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, seeds, rate and spread (mean and population deviation over seeds) of the share flagged.
    rows: seed, flagged and ``by``."""
    one = rows.groupBy("seed", *by).agg(F.avg(F.col("flagged").cast("double")).alias("rate"))
    return one.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("rate").alias("rate"), F.stddev_pop("rate").alias("spread"))


def routing_counts(diagnostics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by (route), n, weight (mean): which routes a profile's units took."""
    return diagnostics.groupBy(*(by or ["route"])).agg(F.count("*").alias("n"), F.avg("weight").alias("weight"))


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, tn, precision, recall, fpr; rows: flagged, truth."""
    f, t = F.col("flagged"), F.col("truth")
    x = rows.groupBy(*by).agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn"))
    div = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return x.select("*", div("tp", "fp").alias("precision"), div("tp", "fn").alias("recall"), div("fp", "tn").alias("fpr"))
