"""Arms scored on the same held-out months: retrospective hold-outs, boards, ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PHASES, pool_score
from . import calendar, metrics, resample
from .lineage import cut
from .ordering import numbered
from .profiles import Profile
from .providers import Registry

UNIT = ["well_id", "phase"]


def unpivoted(wide: DataFrame, *more: str) -> DataFrame:
    return wide.unpivot(["well_id", *more, "t"], list(PHASES), "phase", "q")


def retrospective(wide: DataFrame, cutoff: int, horizon: int, arms: Registry, least_history: int = 12, zero: str = "epsilon") -> tuple[DataFrame, DataFrame]:
    """(errors, failures) of arms on the months after a cutoff.

    Wells with too few months after the cutoff or under ``least_history`` before it are left out.
    Arms see training months only, so cohorts that they build come from truncated histories.  A unit
    (well, phase) that some arm doesn't forecast whole is a failure row (arm, well_id, phase, reason)
    and no arm is scored on it.  errors: arm, well_id, phase, e (cumulative log error), s (pool score
    of the months).
    """
    split = cut(calendar.split_at(calendar.fill_gaps(wide).drop("inserted"), cutoff, horizon))
    able = split.filter("split = 'train'").groupBy("well_id").count().filter(F.col("count") >= least_history).select("well_id")
    split = split.join(able, "well_id", "left_semi")
    train = cut(unpivoted(split.filter("split = 'train'")))
    known = train.groupBy(*UNIT).agg(F.count("q").alias("n")).filter("n > 0").select(*UNIT)
    train = train.join(known, UNIT, "left_semi")
    actual = unpivoted(split.filter("split = 'holdout'"), "h").select(*UNIT, "h", F.col("q").alias("actual")).join(known, UNIT, "left_semi")
    return scored(cut(actual), cut(arms.forecast(train, horizon)), list(arms.providers), horizon, zero)


def scored(actual: DataFrame, forecasts: DataFrame, arms: list[str], horizon: int, zero: str = "epsilon") -> tuple[DataFrame, DataFrame]:
    """(errors, failures) of forecasts (arm, UNIT, h, volume) against actual (UNIT, h, actual)."""
    spark = actual.sparkSession
    names = spark.createDataFrame([(a,) for a in arms], "arm string")
    units = actual.select(*UNIT).distinct().join(F.broadcast(names))  # arms are few
    bad = F.col("volume").isNull() | F.isnan("volume") | (F.abs("volume") == float("inf")) | (F.col("volume") < 0)
    seen = forecasts.groupBy("arm", *UNIT).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    x = units.join(seen, ["arm", *UNIT], "left")
    reason = F.when(F.col("n").isNull(), "forecast_missing").when(F.col("n") != horizon, F.concat(F.lit("length_mismatch:"), F.col("n").cast("string"))).when(F.col("bad") > 0, "nonfinite_or_negative_forecast")
    failures = cut(x.withColumn("reason", reason).filter("reason IS NOT NULL").select("arm", *UNIT, "reason"))
    pairs = actual.join(failures.select(*UNIT).distinct(), UNIT, "left_anti").join(forecasts, [*UNIT, "h"]).withColumnRenamed("volume", "forecast")
    by = ["arm", *UNIT]
    e = metrics.cumulative(pairs, by, zero=zero).filter("e IS NOT NULL")
    return cut(e), failures


def summary(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by (arm), n, median, bias_part, spread_part, mean_abs, median_abs, score, bias_share."""
    return metrics.arm_summary(errors, by or ["arm"])


def paired(errors: DataFrame, challenger: str, base: str) -> DataFrame:
    """UNIT, a (the challenger's error), b (the base's) of units that both have."""
    of = lambda arm, c: errors.filter(F.col("arm") == arm).select(*UNIT, F.col("e").alias(c))
    return of(challenger, "a").join(of(base, "b"), UNIT)


def comparison(errors: DataFrame, challenger: str, base: str, reps: int = 2000, seed: int = 20260728) -> DataFrame:
    """One row: units, delta, relative, mean and median of |a| - |b|, win_rate, and low and high of a
    bootstrap of units (well and phase)."""
    p = cut(numbered(paired(errors, challenger, base), UNIT, "unit"))
    one = p.agg(F.count("*").alias("units"), pool_score(F.col("a")).alias("sa"), pool_score(F.col("b")).alias("sb"))
    one = one.select("units", (F.col("sa") - F.col("sb")).alias("delta"), metrics.relative_delta(F.col("sa"), F.col("sb")).alias("relative"))
    return one.join(resample.win_rate(p)).join(resample.bootstrap(p, p.count(), reps, seed).drop("p_better"))  # one row each


def segments(pairs: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n, delta (score of a minus that of b) by label; labels: well_id and the fields."""
    x = pairs.join(labels, "well_id")
    x = x.select("a", "b", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("s"))
    return x.groupBy("s.field", "s.value").agg(F.count("*").alias("n"), (pool_score(F.col("a")) - pool_score(F.col("b"))).alias("delta"))


def evidence(pairs: DataFrame, labels: DataFrame, fields: list[str], cumulative: DataFrame | None = None, failures: int = 0, mismatches: int | None = None, runtime_ratio: float | None = None, reps: int = 1000, seed: int = 20260729) -> DataFrame:
    """One row of what the promotion gates ask: pairs (UNIT, a, b) of a challenger and the control,
    cumulative the same of cumulative errors.  Intervals draw whole wells."""
    far = lambda c: F.avg((F.abs(c) > F.ln(F.lit(2.0))).cast("double"))
    p95 = lambda c: F.percentile(F.abs(c), F.lit(0.95))
    p = cut(pairs)
    x = p.agg(F.count_distinct("well_id").alias("wells"), pool_score(F.col("a")).alias("sa"), pool_score(F.col("b")).alias("sb"), (far("a") - far("b")).alias("catastrophic_delta"), (p95("a") - p95("b")).alias("p95_delta"))
    x = x.select("wells", (F.col("sa") - F.col("sb")).alias("delta"), metrics.relative_delta(F.col("sa"), F.col("sb")).alias("relative"), "catastrophic_delta", "p95_delta")
    ci = resample.clustered(p, "well_id", reps, seed).select(F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), "p_better")
    seg = segments(p, labels, fields)
    worst = lambda n: F.coalesce(F.max(F.when(F.col("n") >= n, F.col("delta"))), F.lit(0.0)).alias(f"worst_segment_{n}")  # noqa: E731  no segment of that size: none is worse
    out = x.join(ci).join(seg.agg(worst(10), worst(20)))  # one row each
    if cumulative is not None:
        out = out.join(cumulative.agg((pool_score(F.col("a")) - pool_score(F.col("b"))).alias("cumulative_delta")))
    given = {"failures": F.lit(failures), "mismatches": F.lit(mismatches).cast("int"), "runtime_ratio": F.lit(runtime_ratio).cast("double")}
    return out.withColumns(given)


def ablations() -> dict[str, Profile]:
    """The ablation matrix over the control anchor: what each part of the full profile adds."""
    full = Profile()
    from dataclasses import replace

    # The published names and settings of the matrix.
    return {
        "C0_candidates_only": Profile(anchor="none", recovery=False, cohort=False, ratios=False),
        "C1_scipy_anchor": full,
        "C2_no_anchor": replace(full, anchor="none"),
        "C3_no_cohort": replace(full, cohort=False),
        "C4_no_recovery": replace(full, recovery=False),
        "C5_no_ratio": replace(full, ratios=False),
        "C6_default_w05": replace(full, default_weight=0.5),
        "C_v11_baseline": replace(full, anchor="linear"),
    }


def ablation_board(wide: DataFrame, groups: DataFrame, actual: DataFrame, horizon: int, names: list[str] | None = None, reps: int = 500, seed: int = 0) -> DataFrame:
    """arm, n, median, spread, score, p95, largest, diff, low, high, p_better, verdict.

    Each well's primary phase is forecast by the control (A_scipy), the linear arm (B_linearized) and
    the ablations, scored on the wells that all arms have, and held against the control by a
    bootstrap of wells.  actual: well_id, phase, h, actual.
    """
    from . import arps, control, routing

    primary = cut(calendar.primary_phase(wide).select("well_id", F.col("primary_phase").alias("phase")))
    rows = cut(unpivoted(calendar.fill_gaps(wide).drop("inserted")).join(primary, UNIT, "left_semi"))
    linear = arps.forecast(arps.fit(rows, arps.arms_table(rows.sparkSession, ["bounded"])), horizon).drop("arm")
    arms = {"A_scipy": control.forecast(rows, horizon), "B_linearized": linear}
    memo: dict = {}
    for name, profile in ablations().items():
        if names is None or name in names:
            arms[name] = routing.forecast_wells(wide, groups, horizon, profile, memo=memo)[0]
    held = actual.join(primary, UNIT, "left_semi")
    every = None
    for name, fc in arms.items():
        e = metrics.ablation_mean(held.join(fc, [*UNIT, "h"]).withColumnRenamed("volume", "forecast"), ["well_id"]).select(F.lit(name).alias("arm"), "well_id", "e")
        every = e if every is None else every.unionByName(e)
    every = cut(every.filter("e IS NOT NULL"))
    common = cut(every.groupBy("well_id").count().filter(F.col("count") == len(arms)).select("well_id"))
    every = cut(every.join(common, "well_id", "left_semi"))
    stats = metrics.decomposition(every, ["arm"]).join(metrics.tails(every, ["arm"]).select("arm", "p95", "largest"), "arm")
    stats = stats.select("arm", "n", "median", (3 * F.col("spread_part")).alias("spread"), "score", "p95", "largest")
    index = cut(numbered(common, ["well_id"], "unit"))
    of = cut(every.join(index, "well_id").groupBy("unit").pivot("arm", list(arms)).agg(F.first("e")))  # a row a well
    drawn = resample.all_resampled(of, index.count(), reps, seed, [pool_score(F.col(a)).alias(a) for a in arms])
    scores = cut(drawn.unpivot(["rep"], list(arms), "arm", "s"))
    base = scores.filter("arm = 'A_scipy'").select("rep", F.col("s").alias("base"))
    deltas = scores.filter("arm <> 'A_scipy'").join(base, "rep").select("arm", (F.col("s") - F.col("base")).alias("value"))
    against = resample.interval(deltas, ["arm"])
    control_score = stats.filter("arm = 'A_scipy'").select(F.col("score").alias("base"))
    out = stats.join(control_score).join(against, "arm", "left")  # one row of the control
    return out.withColumn("diff", F.when(F.col("arm") != "A_scipy", F.col("score") - F.col("base"))).withColumn("verdict", F.when(F.col("low").isNotNull(), resample.verdict(F.col("low"), F.col("high")))).drop("base")
