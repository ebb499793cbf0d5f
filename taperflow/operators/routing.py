"""The routed forecaster: candidates, anchor, recovery, cohorts and ratios in one relational plan.

Series are packed once; fits, backtests and the anchor are Arrow kernels over the packed rows, and
backtest origins are slices of them.  Lineage is cut after the series, the fits and the backtests.
Branches that a profile can't take are never planned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHASES, hyperbolic
from . import arps, calendar, cohort, control, families, sequence
from .lineage import cut
from .packed import each, pack, padded
from .profiles import Profile

KEY = ["well_id", "phase"]


def anchor_volumes(packed: DataFrame, horizon: int, p: Profile, keys: list[str] = KEY) -> DataFrame:
    """keys, v (volumes of h = 1 ..) of the profile's anchor."""
    if p.anchor == "control":
        return control.forecast_packed(packed, horizon, keys)
    arms = [a for a in arps.ARMS if a[0] == "bounded"]
    at = lambda h: F.when(F.col("qi").isNotNull(), hyperbolic(F.col("len") + h - 1, F.col("qi"), F.col("di"), F.col("b")) * F.col("uptime")).otherwise(F.col("level"))
    return arps.fit_packed(packed, arms, keys).select(*keys, F.transform(F.sequence(F.lit(1), F.lit(horizon)), at).alias("v"))


def _long(volumes: DataFrame) -> DataFrame:
    return volumes.select(*KEY, F.posexplode("v").alias("h", "volume")).withColumn("h", (F.col("h") + 1).cast("int"))


def anchor(packed: DataFrame, horizon: int, p: Profile) -> DataFrame:
    """KEY, h, volume of the profile's anchor."""
    return _long(anchor_volumes(packed, horizon, p))


def finalize(fc: DataFrame, p: Profile) -> DataFrame:
    x = fc.select(*KEY, F.col("h").alias("t"), F.col("volume").alias("q"))
    y = sequence.terminal_decline(x) if p.terminal else sequence.sanitize(x)
    return y.select(*KEY, F.col("t").alias("h"), F.col("q").alias("volume"))


def final_volumes(volumes: DataFrame, p: Profile, keys: list[str]) -> DataFrame:
    """``finalize`` for arrays of equal length without gaps."""
    last = families.terminal if p.terminal else lambda v: np.maximum(v, 0)
    return each(volumes, keys, "v array<double>", lambda batch: [{"v": last(padded(batch)[0])}], "v")


def anchor_backtest(packed: DataFrame, p: Profile) -> DataFrame:
    """KEY, anchor_score: on the origins and weights of the candidates' backtest."""
    keys = [*KEY, "horizon", "rank", "held"]
    o = families.backtest_origins(packed)
    got = families.backtest_scores(o, final_volumes(anchor_volumes(o, 6, p, keys), p, keys), KEY)
    return got.withColumnRenamed("score", "anchor_score")


def disruption(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """KEY, streak, low: trailing zeros, and a newest level far below the fit or the months before.
    The fit is compared month by month."""
    streak, jump = sequence.zero_streak(rows), sequence.level_break(rows)
    by = Window.partitionBy(*KEY)
    x = rows.withColumns({"pos": F.row_number().over(by.orderBy("t")) - 1, "n": F.count("*").over(by)}).filter("pos >= n - 3").join(fits, KEY)
    cap = families.curve(F.col("family"), F.col("shape"), F.col("a"), F.col("c"), (F.col("pos") - F.col("n") + F.col("origin")).cast("double")) * F.col("uptime")
    near = x.groupBy(*KEY).agg((F.median(F.when(cap > 0, F.col("q") / cap)) < 0.40).alias("_fit"), F.lit(True).alias("_fitted"))
    out = streak.join(jump, KEY, "left").join(near, KEY, "left")
    low = F.when(F.col("_fitted"), F.coalesce("_fit", F.lit(False)) | F.coalesce(F.col("ratio") < 0.40, F.lit(False))).otherwise(F.col("streak") > 0)
    return out.select(*KEY, "streak", low.alias("low"))


def _keeper(memo: dict | None):
    """Makes and cuts a table once for each key."""
    memo = {} if memo is None else memo

    def once(key, make):
        if key not in memo:
            memo[key] = cut(make())
        return memo[key]

    return once


def phase_forecasts(rows: DataFrame, horizon: int, p: Profile, memo: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(KEY, h, volume) and diagnostics (KEY, model, route, weight, scores, flags, review).  rows: one
    a calendar month of each series; memo: keeps what other profiles on the same rows can use."""
    once = _keeper(memo)
    packed = once("packed", lambda: pack(rows))
    keys = rows.groupBy(*KEY).agg(F.count_if(F.col("q") > 0).alias("positive"), F.count("*").alias("history"))
    thin = F.col("positive") < p.thin_months
    if p.anchor_alone:
        steps = sequence.log_steps(sequence.trailing(rows, 6, True).drop("back")).groupBy(*KEY).agg(F.stddev_pop("d1").alias("sd"), F.count("*").alias("m"))
        d = keys.join(steps, KEY, "left").withColumn("volatile", F.coalesce((F.col("m") >= 4) & (F.col("sd") > 0.35), F.lit(False)))
        flags = F.filter(F.array(F.when(thin, "thin_history"), F.when(F.col("volatile"), "volatile_tail")), lambda f: f.isNotNull())
        review = F.least(F.lit(100), F.when(thin, 35).otherwise(0) + F.when(F.col("volatile"), 25).otherwise(0))
        return finalize(anchor(packed, horizon, p), p), d.select(*KEY, F.lit(f"{p.anchor}_anchor").alias("model"), F.lit("anchor_only_fast_path").alias("route"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("anchor_score"), flags.alias("flags"), review.alias("review"))

    specs = families.CANDIDATES
    scored = once(("scored", p.terminal), lambda: families.backtest_packed(packed, specs, p.terminal))
    win = keys.select(*KEY).join(families.winners(scored), KEY, "left").select(*KEY, F.coalesce("name", F.lit("hyper_36")).alias("name"), "score")
    fits = once(("fits", p.terminal), lambda: families.fit_packed(packed, specs).join(win.select(*KEY, "name"), families.KEY, "left_semi"))
    back = sequence.fallback(rows, horizon, sequence.TERMINAL if p.terminal else None).withColumnRenamed("volume", "flat")
    own = families.forecast(fits, horizon, p.terminal)
    mixed = back.join(own, [*KEY, "h"], "left").select(*KEY, "h", F.coalesce("volume", "flat").alias("own"))
    state = disruption(rows, fits)
    if p.recovery:
        skips = [(f"skip{k}", "hyperbolic", 36, k) for k in (1, 2, 3)]
        upset = state.filter("low OR streak > 0").join(sequence.past_recovery(rows), KEY)
        upset = upset.withColumn("name", F.concat(F.lit("skip"), F.least(F.lit(3), F.greatest(F.lit(1), F.col("streak"))).cast("string")))
        again = families.forecast(families.fit_packed(packed.join(upset.select(*KEY), KEY, "left_semi"), skips), horizon, p.terminal).join(upset, families.KEY)
        r, s = F.col("recovered"), F.col("streak")
        w = F.when((s >= 3) & ~r, 0.20).when(s >= 2, F.when(r, 0.65).otherwise(0.45)).when(s == 1, F.when(r, 0.85).otherwise(0.72)).otherwise(F.when(r, 0.92).otherwise(0.86))
        by = Window.partitionBy(*KEY)
        three = rows.withColumns({"pos": F.row_number().over(by.orderBy("t")), "n": F.count("*").over(by)}).filter("pos > n - 3").groupBy(*KEY).agg(F.greatest(F.coalesce(F.median("q"), F.lit(0.0)), F.lit(0.0)).alias("level"))
        again = again.join(three, KEY).select(*KEY, "h", (w * F.col("volume") + (1 - w) * F.when(s >= 2, 0.0).otherwise(F.col("level"))).alias("volume"))
        again = finalize(again, p).withColumnRenamed("volume", "again")
        mixed = mixed.join(again, [*KEY, "h"], "left").select(*KEY, "h", F.coalesce("again", "own").alias("own"))
    facts = keys.join(win, KEY).join(state, KEY, "left")
    if p.anchor == "none":
        facts = facts.withColumns({"anchor_score": F.lit(None).cast("double"), "route": F.lit("no_anchor"), "weight": F.lit(1.0)})
        out = mixed.withColumnRenamed("own", "volume")
    else:
        facts = facts.join(once(("anchor_backtest", p.anchor, p.terminal), lambda: anchor_backtest(packed, p)), KEY, "left")
        routes = [("terminal_streak", F.col("streak") >= 2, p.streak_weight), ("depressed_cutoff", F.col("low"), p.depressed_weight), ("anchor_hindcast_better", F.col("anchor_score") < p.anchor_better_ratio * F.col("score"), p.anchor_better_weight), ("candidate_hindcast_better", F.col("score") < p.candidate_better_ratio * F.col("anchor_score"), p.candidate_better_weight), ("thin_history", thin, p.thin_weight)]
        route, weight = F, F
        for name, when, value in routes:
            route, weight = route.when(when, F.lit(name)), weight.when(when, F.lit(value))
        facts = facts.withColumns({"route": route.otherwise("default_anchor"), "weight": weight.otherwise(p.default_weight)})
        both = mixed.join(once(("anchor", p.anchor, horizon), lambda: anchor(packed, horizon, p)).withColumnRenamed("volume", "base"), [*KEY, "h"]).join(facts.select(*KEY, "weight"), KEY)
        out = finalize(both.select(*KEY, "h", (F.col("weight") * F.col("own") + (1 - F.col("weight")) * F.col("base")).alias("volume")), p)
    six = sequence.trailing(rows, 6).groupBy(*KEY).agg(F.count("*").alias("m"), (F.stddev_pop("q") / F.nullif(F.median(F.abs("q")), F.lit(0.0))).alias("cv"))
    d = facts.join(six, KEY, "left").withColumn("volatile", F.coalesce((F.col("m") >= 6) & (F.col("cv") > 0.55), F.lit(False)))
    flags = F.filter(F.array(F.when(thin, "thin_history"), F.when(F.col("volatile"), "volatile_tail"), F.when(F.col("streak") > 0, F.concat(F.lit("terminal_zero_streak_"), F.col("streak").cast("string"))), F.when(F.col("low"), "terminal_low")), lambda f: f.isNotNull())
    points = F.when(thin, 35).otherwise(0) + F.when(F.col("volatile"), 25).otherwise(0) + F.when(F.col("low"), 30).otherwise(0) + F.least(F.lit(30), F.coalesce("streak", F.lit(0)) * 10) + F.least(F.lit(30), F.coalesce(F.round(F.col("score") * 20), F.lit(0)).cast("int"))
    return out, d.select(*KEY, F.col("name").alias("model"), "route", "weight", "score", "anchor_score", flags.alias("flags"), F.least(F.lit(100), points).alias("review"))


def grouped(rows: DataFrame, groups: DataFrame, p: Profile) -> DataFrame:
    """The groups (well_id, grp) of the wells in rows.  Where the profile needs groups, a well without
    one is an error, named."""
    x = rows.select("well_id").distinct().join(groups, "well_id", "left")
    if p.need_group and (p.cohort or p.ratios):
        told = F.raise_error(F.concat(F.lit("no group is known of well "), F.col("well_id").cast("string"))).cast("string")
        x = x.withColumn("grp", F.when(F.trim("grp") != "", F.col("grp")).otherwise(told))
    return x.select("well_id", "grp")


def forecast_wells(wide: DataFrame, groups: DataFrame, horizon: int, p: Profile, pool: DataFrame | None = None, memo: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """All phases of all wells: routed phases, then cohort shapes, then ratio coupling.

    wide: well_id, t, oil, gas, water (months between a well's first and last without a row count as
    missing); groups: well_id, grp; pool: the wells that make cohorts (the same ones by default);
    memo: a dict to share between profiles on the same wells, groups and pool.
    """
    memo = {} if memo is None else memo
    once, given = _keeper(memo), wide

    def seen() -> DataFrame:
        rows = wide.unpivot(["well_id", "t"], list(PHASES), "phase", "q")
        return rows.join(rows.groupBy(*KEY).agg(F.count("q").alias("c")).filter("c > 0").select(*KEY), KEY, "left_semi")

    wide = once("wide", lambda: calendar.fill_gaps(given.select("well_id", "t", *PHASES)).drop("inserted"))
    rows = once("rows", seen)
    every, groups = groups, once(("groups", p.need_group and (p.cohort or p.ratios)), lambda: grouped(wide, groups, p))
    fc, diagnostics = phase_forecasts(rows, horizon, p, memo)
    pool = wide if pool is None else pool
    if p.cohort or p.ratios:
        fc, diagnostics = cut(fc), cut(diagnostics)
    if p.cohort:
        long = pool.unpivot(["well_id", "t"], list(PHASES), "phase", "q")
        peer = (p.min_wells, p.full_wells, p.thin_months, p.cohort_most, p.use_global, p.terminal)
        shape = once(("shape", p.min_wells), lambda: cohort.profiles(long, every, p.min_wells))
        allow = once(("peers", horizon, *peer), lambda: cohort.cohort_forecast(rows, groups, shape, horizon, p.min_wells, p.full_wells, p.thin_months, p.cohort_most, p.use_global, sequence.TERMINAL if p.terminal else None))
        routes = rows.select(*KEY).distinct().join(groups, "well_id", "left").join(calendar.primary_phase(wide), "well_id", "left")
        routes = routes.join(allow.select(*KEY).distinct().withColumn("_peers", F.lit(True)), KEY, "left").withColumn("grp", F.coalesce("grp", F.lit(cohort.GLOBAL)))
        reason = F.when(F.lit(bool(p.primary_phases)) & ~F.col("primary_phase").isin(*p.primary_phases or ("",)), "primary_phase_not_allowed")
        reason = reason.when(F.lit(bool(p.groups)) & ~F.col("grp").isin(*p.groups or ("",)), "group_not_allowed")
        reason = reason.when(F.lit(bool(p.phases)) & ~F.col("phase").isin(*p.phases or ("",)), "phase_not_allowed")
        routes = cut(routes.select(*KEY, reason.when(F.col("_peers"), "allowed").otherwise("no_profile").alias("cohort_reason")))
        diagnostics = diagnostics.join(routes, KEY, "left")
        allow = allow.join(routes.filter("cohort_reason = 'allowed'"), KEY, "left_semi")
        gate = gates(rows, groups, shape, horizon, p)
        upset = diagnostics.filter("exists(flags, f -> f like 'terminal%')").select(*KEY)
        allow = allow.join(gate, KEY, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor").join(upset, KEY, "left_anti")
        pairs = fc.withColumnRenamed("volume", "anchor").join(allow, [*KEY, "h"], "left").withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "volume": F.coalesce("volume", "anchor")})
        if p.max_month_divergence is not None:
            pairs = cohort.diverging(pairs, p.max_month_divergence, p.max_total_divergence, p.support_months)
        fc = pairs.select(*KEY, "h", F.when(F.col("weight") > 0, cohort.blend(F.col("anchor"), F.col("volume"), F.col("weight"), p.blend_space)).otherwise(F.col("anchor")).alias("volume"))
    if p.ratios:
        primary = calendar.primary_phase(wide)
        fc = cut(fc)
        base = fc.join(primary, "well_id").filter("phase = primary_phase").select("well_id", "h", "volume")
        slopes = once("slopes", lambda: cohort.ratio_slopes(wide))
        ratio = cohort.ratio_forecast(slopes, cohort.ratio_priors(slopes if pool is wide else cohort.ratio_slopes(pool), every), groups, base, p.min_wells, use_global=p.use_global)
        phase = F.when(F.col("rel").isin("wor", "wgr"), "water").when(F.col("rel") == "gor", "gas").otherwise("oil")
        beta = F.when(F.col("volatile"), 0.985).otherwise(p.own_ratio_blend)
        ratio = ratio.join(slopes.select("well_id", "rel", "volatile"), ["well_id", "rel"]).select("well_id", phase.alias("phase"), "h", F.col("volume").alias("ratio"), beta.alias("beta"), "volatile")
        low = diagnostics.filter(F.array_contains("flags", "terminal_low")).select(*KEY)
        ratio = ratio.join(low, KEY, "left_anti")
        wild = ratio.filter("volatile").select(*KEY, F.lit(20).alias("more")).distinct()
        diagnostics = diagnostics.join(wild, KEY, "left").withColumn("review", F.least(F.lit(100), F.col("review") + F.coalesce("more", F.lit(0)))).drop("more")
        fc = fc.join(ratio, [*KEY, "h"], "left").select(*KEY, "h", F.when(F.col("ratio").isNotNull(), F.col("beta") * F.col("volume") + (1 - F.col("beta")) * F.col("ratio")).otherwise(F.col("volume")).alias("volume"))
    return fc, diagnostics


def gates(rows: DataFrame, groups: DataFrame, shape: DataFrame, horizon: int, p: Profile) -> DataFrame:
    """KEY, factor (0: the gate is shut): age support, dispersion, endpoint and similarity."""
    x = cohort.aged(rows)
    last = rows.groupBy(*KEY).agg(F.max("t").alias("last"))
    wells = x.groupBy(*KEY).agg(F.first(F.col("t") - F.col("age")).alias("peak")).join(last, KEY).join(groups, "well_id", "left").withColumn("grp", F.coalesce("grp", F.lit(cohort.GLOBAL)))
    ahead = wells.withColumn("age", F.explode(F.sequence(F.col("last") - F.col("peak") + 1, F.col("last") - F.col("peak") + min(horizon, p.support_months))))
    ahead = ahead.join(shape.select("grp", "phase", "age", "n", "log_mad"), ["grp", "phase", "age"], "left")
    sup = ahead.groupBy(*KEY).agg(F.min(F.coalesce("n", F.lit(0))).alias("support"), F.median("log_mad").alias("mad"))
    back = x.join(wells.select(*KEY, "grp"), KEY).filter("age >= 0").join(shape.select("grp", "phase", "age", "value"), ["grp", "phase", "age"])
    back = back.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("age")))).filter(F.col("k") <= 12)
    like = back.groupBy(*KEY).agg(F.when(F.count("*") >= 3, F.median(F.abs(F.ln(F.greatest("ratio", F.lit(1e-9))) - F.ln(F.greatest("value", F.lit(1e-9)))))).alias("unlike"))
    tail = sequence.trailing(rows, 6, True)
    ends = tail.groupBy(*KEY).agg((F.max(F.when(F.col("back") == 1, F.col("q"))) / F.median(F.when(F.col("back").between(2, 4), F.col("q")))).alias("end"), F.count("*").alias("m"))
    wild = sequence.log_steps(tail.drop("back")).groupBy(*KEY).agg(F.stddev_pop("d1").alias("wild"))
    g = sup.join(like, KEY, "left").join(ends, KEY, "left").join(wild, KEY, "left")
    f = F.lit(1.0)
    taper = lambda v, cap: F.when(v.isNull() | (v > cap), 0.0).otherwise(F.greatest(F.lit(0.25), 1 - 0.5 * v / cap))
    if p.min_age_support:
        f = f * F.when(F.col("support") < p.min_age_support, 0.0).otherwise(F.least(F.col("support") / p.full_wells, F.lit(1.0)))
    if p.max_log_mad:
        f = f * taper(F.col("mad"), p.max_log_mad)
    if p.endpoint:
        f = f * F.when((F.col("m") >= 4) & ~F.col("end").between(*p.endpoint), 0.0).otherwise(1.0)
    if p.endpoint_volatility:
        f = f * F.when((F.col("m") >= 4) & (F.col("wild") > p.endpoint_volatility), 0.0).otherwise(1.0)
    if p.max_history_error:
        f = f * taper(F.col("unlike"), p.max_history_error)
    return g.select(*KEY, f.alias("factor"))
