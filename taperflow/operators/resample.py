"""Paired resampling and influence.  Rows: unit (0 .. n-1), a, b (log errors of two arms).

A unit may have several rows (the phases of a well): it is drawn with all of them, which makes the
bootstrap one by clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pool_score
from .ordering import numbered

#: Units of which the table (some 50 MB) is sent to every task of a resampling join; beyond, both are shuffled.
BROADCAST_UNITS = 1_000_000
#: Draws of a task, and draws that are numbered at once.
TASK = 250_000
BLOCK = 4096


def draws(units: int, reps: int, seed: int, spark) -> DataFrame:
    """rep, unit: independent draws with replacement, each from the MD5 of (seed, rep, k): the same
    in any engine.  A replicate's draws are in one partition.

    The k are made block by block: a sequence over all units would be a constant, which the driver
    holds and sends with its tasks."""
    last = F.lit(units - 1).cast("long")
    x = spark.range(reps if units else 0).withColumnRenamed("id", "rep").repartition(max(1, min(reps, -(-units * reps // TASK))), "rep")
    x = x.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK)))).withColumn("_at", F.col("_at") * BLOCK)
    x = x.withColumn("k", F.explode(F.sequence("_at", F.least(F.col("_at") + BLOCK - 1, last))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "rep", "k")), 1, 13), 16, 10).cast("long")
    return x.select("rep", F.coalesce(h % units, F.lit(0).cast("long")).alias("unit"))  # never null, said so that joins needn't test it


def resampled(rows: DataFrame, units: int, reps: int, seed: int, value: Column) -> DataFrame:
    """rep, value: an aggregate of each resample of the units."""
    return all_resampled(rows, units, reps, seed, [value.alias("value")])


def all_resampled(rows: DataFrame, units: int, reps: int, seed: int, values: list[Column]) -> DataFrame:
    """rep and the values (named aggregates) of each resample of the units.

    The join names its kind: Spark takes the draws for as few rows as there are replicates and would
    send them all through the driver."""
    d = draws(units, reps, seed, rows.sparkSession)
    return d.join(F.broadcast(rows) if units <= BROADCAST_UNITS else rows.hint("merge"), "unit").groupBy("rep").agg(*values)


def interval(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, low, high (2.5 and 97.5 %) and p_better (the share below 0) of finite values."""
    x = values.filter("value IS NOT NULL AND NOT isnan(value)")
    p = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return x.groupBy(*(by or [])).agg(p.alias("p"), F.avg((F.col("value") < 0).cast("double")).alias("p_better")).select(*(by or []), F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "p_better")


def bootstrap(pairs: DataFrame, units: int, reps: int, seed: int = 17) -> DataFrame:
    """low, high and p_better of score(a) - score(b) over paired resamples; nulls under two units.
    The draws table has units * reps rows, spread over tasks by replicate."""
    if units < 2:
        return pairs.sparkSession.createDataFrame([(None, None, None)], "low double, high double, p_better double")
    return interval(resampled(pairs, units, reps, seed, pool_score(F.col("a")) - pool_score(F.col("b"))))


def clustered(rows: DataFrame, cluster: str, reps: int, seed: int = 17) -> DataFrame:
    """``bootstrap`` of rows (cluster, a, b), drawing whole clusters."""
    index = numbered(rows.select(cluster).distinct(), [cluster], "unit")
    return bootstrap(rows.join(index, cluster).select("unit", "a", "b"), index.count(), reps, seed)


def mean_interval(values: DataFrame, units: int, reps: int, seed: int = 17) -> DataFrame:
    """low, high of the mean of x over resamples; rows: unit, x (a mean of each seed, say)."""
    return interval(resampled(values, units, reps, seed, F.avg("x"))).select("low", "high")


def verdict(low: Column, high: Column) -> Column:
    return F.when(high < 0, "BETTER").when(low > 0, "WORSE").otherwise("inconclusive")


def leave_one_out(errors: DataFrame) -> DataFrame:
    """unit, influence: score without the unit minus the score of all.

    Medians without a unit follow from three order statistics and deviations from sums: one sort by
    ranges, no pairing of units with units.  Rows: unit, e (two or more units besides).
    """
    x = numbered(errors.select("unit", "e"), ["e", "unit"], "r")
    n, s1, s2, med, sd = x.agg(F.count("*"), F.sum("e"), F.sum(F.col("e") * F.col("e")), F.median("e"), F.stddev_pop("e")).first()
    h = n // 2
    at = {r["r"]: r["e"] for r in x.filter(F.col("r").isin(h - 1, h, h + 1)).collect()}  # three rows
    lo, mid, up = (F.lit(at.get(k)).cast("double") for k in (h - 1, h, h + 1))
    even = F.when(F.col("r") < h, mid).otherwise(lo)  # n even: n-1 odd
    odd = F.when(F.col("r") < h, (mid + up) / 2).when(F.col("r") == h, (lo + up) / 2).otherwise((lo + mid) / 2)
    m = (F.lit(s1) - F.col("e")) / (n - 1)
    out_sd = F.sqrt(F.greatest((F.lit(s2) - F.col("e") * F.col("e")) / (n - 1) - m * m, F.lit(0.0)))
    score = lambda a, b: F.lit(2 / 3) * F.abs(a) + F.lit(1 / 3) * b
    return x.select("unit", (score(even if n % 2 == 0 else odd, out_sd) - score(F.lit(med), F.lit(sd))).alias("influence"))


def without_top(errors: DataFrame, share: float = 0.01) -> DataFrame:
    """n, removed, score, without_one, without_share: the pool score of all units, without the one of
    largest |e|, and without that share of them (rounded up)."""
    x = numbered(errors.select("unit", "e", (-F.abs("e")).alias("far")), ["far", "unit"], "r")
    n = x.count()
    k = -int(-n * share // 1)
    kept = lambda m: pool_score(F.when(F.col("r") >= m, F.col("e")))
    return x.agg(F.count("*").alias("n"), F.lit(k).alias("removed"), kept(0).alias("score"), kept(1).alias("without_one"), kept(k).alias("without_share"))


def win_rate(pairs: DataFrame) -> DataFrame:
    d = F.abs("a") - F.abs("b")
    return pairs.agg(F.avg((d < 0).cast("double")).alias("win_rate"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"))
