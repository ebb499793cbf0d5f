"""Peer-group shapes and phase ratios, relationally.

Profiles are built once over the pool by two aggregations (center, then deviation about it), and
used by equi-joins on (group, phase, age).  The profile table is bounded by groups * phases *
361 ages, so it is small next to the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import TERMINAL, first_peak, positive, trailing

GLOBAL = "__global__"
MOST_AGE = 360


def aged(rows: DataFrame) -> DataFrame:
    """well_id, phase, t, age (months since the peak), ratio to the peak, n (positive months)."""
    pos = rows.filter(positive())
    x = pos.join(first_peak(pos), ["well_id", "phase"])
    n = F.count("*").over(Window.partitionBy("well_id", "phase"))
    return x.select("well_id", "phase", "t", "q", (F.col("t") - F.col("peak")).alias("age"), (F.col("q") / F.col("peak_q")).alias("ratio"), n.alias("n"))


def profiles(rows: DataFrame, groups: DataFrame, min_wells: int = 5) -> DataFrame:
    """grp, phase, age, value, n, log_mad, support: median shapes by age, interpolated over ages
    without enough wells and never rising.  groups: well_id, grp; wells also count in the global
    group, once."""
    x = aged(rows).filter((F.col("n") >= 6) & F.col("age").between(0, MOST_AGE) & (F.col("ratio") > 0) & (F.col("ratio") <= 2))
    x = x.join(groups, "well_id", "left").withColumn("grp", F.explode(F.array_distinct(F.array(F.coalesce("grp", F.lit(GLOBAL)), F.lit(GLOBAL))))).withColumn("lr", F.ln("ratio"))
    support = x.groupBy("grp", "phase").agg(F.count_distinct("well_id").alias("support"), F.max("age").alias("max_age"))
    center = x.groupBy("grp", "phase", "age").agg(F.median("lr").alias("c"), F.count("*").alias("n"))
    mad = x.join(center, ["grp", "phase", "age"]).groupBy("grp", "phase", "age").agg((1.4826 * F.median(F.abs(F.col("lr") - F.col("c")))).alias("log_mad"))
    ages = support.select("grp", "phase", "support", F.explode(F.sequence(F.lit(0), F.col("max_age").cast("int"))).alias("age"))
    enough = F.col("n") >= max(2, min_wells // 2)
    y = ages.join(center, ["grp", "phase", "age"], "left").join(mad, ["grp", "phase", "age"], "left")
    y = y.select("grp", "phase", "age", "support", F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, F.exp("c")).alias("v"), F.when(enough, F.col("log_mad")).alias("log_mad"))
    w = Window.partitionBy("grp", "phase").orderBy("age")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.col("age"))
    y = y.withColumns({"v0": F.last("v", True).over(back), "a0": F.last(at, True).over(back), "v1": F.first("v", True).over(ahead), "a1": F.first(at, True).over(ahead), "known": F.count("v").over(Window.partitionBy("grp", "phase"))})
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("age") - F.col("a0")) / F.nullif(F.col("a1") - F.col("a0"), F.lit(0))
    y = y.filter("known >= 3").withColumn("value", F.greatest(F.coalesce("v", line, "v0", "v1"), F.lit(0.0)))
    return y.select("grp", "phase", "age", F.min("value").over(back).alias("value"), "n", "log_mad", "support")


def cohort_forecast(rows: DataFrame, groups: DataFrame, shape: DataFrame, horizon: int, min_wells: int = 5, full: int = 20, thin: int = 18, most: float = 0.65, use_global: bool = True, annual: float | None = TERMINAL) -> DataFrame:
    """well_id, phase, h, volume, weight, grp (the group used, own or, if use_global, the global one;
    without it a well without a group has no rows)."""
    x = aged(rows)
    last = rows.groupBy("well_id", "phase").agg(F.max("t").alias("last"))
    tops = shape.groupBy("grp", "phase").agg(F.first("support").alias("support"), F.max("age").alias("top")).filter(F.col("support") >= min_wells)
    wells = x.groupBy("well_id", "phase").agg(F.first("n").alias("n"), F.first(F.col("t") - F.col("age")).alias("peak")).filter("n >= 2")
    wells = wells.join(last, ["well_id", "phase"]).join(groups, "well_id", "left").withColumn("own", F.coalesce("grp", F.lit(GLOBAL if use_global else None))).drop("grp")
    own = tops.select(F.col("grp").alias("own"), "phase", F.lit(True).alias("_own"))
    wells = wells.join(own, ["own", "phase"], "left")
    wells = wells.withColumn("grp", F.when(F.col("_own"), F.col("own")).when(F.lit(use_global), F.lit(GLOBAL)))
    wells = wells.join(tops, ["grp", "phase"])
    value = shape.select("grp", "phase", F.col("age").alias("at"), "value")
    three = trailing(rows, 3, True).join(wells.select("well_id", "phase", "grp", "peak", "top"), ["well_id", "phase"])
    three = three.withColumn("at", F.least(F.greatest(F.col("t") - F.col("peak"), F.lit(0)), F.col("top"))).join(value, ["grp", "phase", "at"])
    scale = three.groupBy("well_id", "phase").agg(F.median(F.col("q") / F.greatest("value", F.lit(1e-9))).alias("scale"))
    f = wells.join(scale, ["well_id", "phase"]).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    age = F.col("last") - F.col("peak") + F.col("h")
    f = f.withColumns({"age": age, "at": F.least(age, F.col("top"))}).join(value, ["grp", "phase", "at"])
    beyond = F.exp(-(annual or 0.0) * F.greatest(F.col("age") - F.col("top"), F.lit(0)))
    weight = F.least(F.greatest((F.lit(thin) - F.col("n")) / thin, F.lit(0.0)), F.lit(most)) * F.least(F.greatest((F.col("support") - min_wells + 1) / max(1, full - min_wells), F.lit(0.0)), F.lit(1.0))
    return f.select("well_id", "phase", "h", (F.col("value") * beyond * F.col("scale")).alias("volume"), weight.alias("weight"), "grp")


def ratio_rows(rows: DataFrame, last: int = 18) -> DataFrame:
    """well_id, rel, t, lr (ln of the ratio), back: the last months in which both phases are
    positive.  rows: wide.  The denominator is the primary phase."""
    from .calendar import primary_phase

    x = rows.join(primary_phase(rows), "well_id")
    oil = F.col("primary_phase") == "oil"
    den = F.when(oil, F.col("oil")).otherwise(F.col("gas"))
    pairs = F.array(F.struct(F.when(oil, "gor").otherwise("cgr").alias("rel"), F.when(oil, F.col("gas")).otherwise(F.col("oil")).alias("num")), F.struct(F.when(oil, "wor").otherwise("wgr").alias("rel"), F.col("water").alias("num")))
    y = x.select("well_id", "t", den.alias("den"), F.explode(pairs).alias("p")).filter("den > 0 AND p.num > 0")
    y = y.select("well_id", F.col("p.rel").alias("rel"), "t", F.ln(F.col("p.num") / F.col("den")).alias("lr"))
    return y.withColumn("back", F.row_number().over(Window.partitionBy("well_id", "rel").orderBy(F.desc("t")))).filter(F.col("back") <= last)


def ratio_slopes(rows: DataFrame, cap: float = 0.025) -> DataFrame:
    """well_id, rel, slope (clipped; null under four months), level, n, volatile."""
    x = ratio_rows(rows)
    slope = F.when(F.count("*") >= 4, F.least(F.greatest(F.regr_slope("lr", F.col("t").cast("double")), F.lit(-cap)), F.lit(cap)))
    level = F.median(F.when(F.col("back") <= 6, F.exp("lr")))
    return x.groupBy("well_id", "rel").agg(slope.alias("slope"), level.alias("level"), F.count("*").alias("n"), (F.stddev_pop("lr") > 0.30).alias("volatile"))


def ratio_priors(slopes: DataFrame, groups: DataFrame) -> DataFrame:
    """grp, rel, prior (median slope), n."""
    x = slopes.filter("slope IS NOT NULL").join(groups, "well_id", "left").withColumn("grp", F.explode(F.array_distinct(F.array(F.coalesce("grp", F.lit(GLOBAL)), F.lit(GLOBAL)))))
    return x.groupBy("grp", "rel").agg(F.median("slope").alias("prior"), F.count("*").alias("n"))


def ratio_forecast(slopes: DataFrame, priors: DataFrame, groups: DataFrame, primary: DataFrame, min_wells: int = 5, cap: float = 0.025, use_global: bool = True) -> DataFrame:
    """well_id, rel, h, volume of the secondary phase.  primary: well_id, h, volume."""
    x = slopes.filter("n >= 3").join(groups, "well_id", "left").withColumn("grp", F.coalesce("grp", F.lit(GLOBAL if use_global else None)))
    own = priors.select("grp", "rel", F.col("prior").alias("own"), F.col("n").alias("own_n"))
    every = priors.filter(F.col("grp") == GLOBAL).select("rel", F.col("prior").alias("every"))
    x = x.join(own, ["grp", "rel"], "left").join(every, "rel", "left")
    sparse = F.col("own").isNull() | (F.col("own_n") < min_wells)
    prior = F.coalesce(F.when(sparse & F.lit(use_global), F.col("every")).otherwise(F.col("own")), F.lit(0.0))
    shrink = F.least(F.greatest(F.col("n") / 24, F.lit(0.20)), F.lit(0.65))
    slope = shrink * F.coalesce("slope", prior) + (1 - shrink) * prior
    x = x.withColumn("s", F.least(F.greatest(slope, F.lit(-cap)), F.lit(cap))).join(primary, "well_id")
    return x.select("well_id", "rel", "h", F.greatest(F.col("volume") * F.col("level") * F.exp(F.col("s") * F.col("h")), F.lit(0.0)).alias("volume"))


def blend(own: F.Column, cohort: F.Column, weight: F.Column, space: str = "linear") -> F.Column:
    """Weighted mean of two forecasts, of volumes or of their logarithms."""
    if space == "linear":
        return weight * cohort + (1 - weight) * own
    tiny = F.lit(1e-9)
    mixed = F.exp(weight * F.ln(F.greatest(cohort, tiny)) + (1 - weight) * F.ln(F.greatest(own, tiny)))
    return F.when((own <= 0) & (cohort <= 0), 0.0).otherwise(mixed)


def diverging(pairs: DataFrame, monthly_cap: float, total_cap: float, months: int = 12) -> DataFrame:
    """Caps a cohort vector to the anchor times e^(+-cap) if any early month differs by more, and
    shrinks its weight by cap / divergence where totals differ by more.  pairs: well_id, phase,
    h, anchor, volume, weight."""
    w = Window.partitionBy("well_id", "phase")
    step = F.abs(F.ln(F.greatest("volume", F.lit(1e-9)) / F.greatest("anchor", F.lit(1e-9))))
    x = pairs.withColumn("_far", F.max(F.when(F.col("h") <= months, step)).over(w) > monthly_cap)
    lo, hi = F.col("anchor") * F.exp(F.lit(-monthly_cap)), F.col("anchor") * F.exp(F.lit(monthly_cap))
    x = x.withColumn("volume", F.when(F.col("_far"), F.least(F.greatest("volume", lo), hi)).otherwise(F.col("volume")))
    d = F.abs(F.ln(F.greatest(F.sum("volume").over(w), F.lit(1e-9)) / F.greatest(F.sum("anchor").over(w), F.lit(1e-9))))
    return x.withColumn("weight", F.when(d > total_cap, F.col("weight") * total_cap / d).otherwise(F.col("weight"))).drop("_far")
