"""Composed studies: retrospective hold-outs, boards, ablations, providers, promotion, throughput."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import arps, board, calendar, cohort, control, diagnostics, holdout, profiles, providers, routing, sequence, synth
from ..operators.lineage import cut
from ..sources import bridge, files
from ..sources.bridge import CUT, DECLINE_LONG_SQL, DECLINE_SQL, WELLS_SQL, table
from .evaluate import PAIRS, POOL, _pairs, draws_sql
from .forecast import ACTUAL_SQL, TRAIN_SQL, arms_sql
from .prepare import ROUGH, _rough
from .registry import query, r6

KEY = ["well_id", "phase"]


def _groups(spark, sf):
    return bridge.wells(spark, sf).select("well_id", F.col("play").alias("grp"))


# Retrospective hold-out.

#: Wells with all twelve months after the cut, their forecasts and cumulative errors by two arms.
HOLD = f"""WITH ok AS (SELECT well_id FROM (SELECT well_id, min(t) AS lo, max(t) AS hi FROM ({DECLINE_SQL}) GROUP BY ALL) WHERE hi >= {CUT + 12} AND lo <= {CUT}),
{arms_sql(["bounded", "window_24"], TRAIN_SQL + " AND well_id IN (SELECT well_id FROM ok)")}, act AS ({ACTUAL_SQL}),
he AS (SELECT arm, well_id, phase, ln(greatest(sum(greatest(volume, 0)), 1e-6 * sum(actual)) / sum(actual)) AS e FROM fc JOIN act USING (well_id, phase, h) GROUP BY ALL)"""


def _retrospective(spark, sf):
    arms = providers.Registry({a: providers.arm(a) for a in ("bounded", "window_24")})
    return holdout.retrospective(bridge.decline(spark, sf), CUT, 12, arms)


@query("met_16_retrospective_summary", HOLD + " SELECT arm, count(*) AS n, round(median(e), 6) AS median, round(2e0 / 3 * abs(median(e)) + 1e0 / 3 * stddev_pop(e), 6) AS score, round(avg(abs(e)), 6) AS mean_abs, round(median(abs(e)), 6) AS median_abs FROM he GROUP BY ALL")
def met_16(spark, sf):
    """Two arms on identical held-out months."""
    return holdout.summary(_retrospective(spark, sf)[0]).select("arm", "n", *(r6(c) for c in ("median", "score", "mean_abs", "median_abs")))


@query("inf_02_retrospective_comparison", HOLD + f""", un AS (SELECT row_number() OVER (ORDER BY x.well_id, x.phase) - 1 AS unit, x.e AS a, y.e AS b FROM he x JOIN he y ON x.well_id = y.well_id AND x.phase = y.phase AND x.arm = 'window_24' AND y.arm = 'bounded'),
n AS (SELECT count(*) AS n FROM un), {draws_sql(200, 20260728)}, s AS (SELECT rep, {POOL.format(x='a')} - {POOL.format(x='b')} AS delta FROM u JOIN un USING (unit) GROUP BY ALL)
SELECT count(*) AS units, round({POOL.format(x='a')} - {POOL.format(x='b')}, 6) AS delta, round(({POOL.format(x='a')} - {POOL.format(x='b')}) / abs({POOL.format(x='b')}), 6) AS relative, round(avg((abs(a) < abs(b))::INT), 6) AS win_rate, round(avg(abs(a) - abs(b)), 6) AS mean_delta, round(median(abs(a) - abs(b)), 6) AS median_delta,
  (SELECT round(quantile_cont(delta, 0.025), 6) FROM s) AS low, (SELECT round(quantile_cont(delta, 0.975), 6) FROM s) AS high FROM un""")
def inf_02(spark, sf):
    """Paired statistics and a bootstrap of units of the hold-out."""
    x = holdout.comparison(_retrospective(spark, sf)[0], "window_24", "bounded", 200)
    return x.select("units", *(r6(c) for c in ("delta", "relative", "win_rate", "mean_delta", "median_delta", "low", "high")))


@query("met_16_failures", f"""WITH d AS ({DECLINE_SQL}), ok AS (SELECT well_id FROM (SELECT well_id, min(t) AS lo, max(t) AS hi FROM d GROUP BY ALL) WHERE hi >= {CUT + 12} AND lo <= {CUT}), u AS (SELECT well_id, unnest(['oil', 'gas', 'water']) AS phase FROM ok)
SELECT 'stored' AS arm, well_id, phase, CASE WHEN well_id % 4 = 1 THEN 'forecast_missing' WHEN well_id % 4 = 2 THEN 'length_mismatch:11' ELSE 'nonfinite_or_negative_forecast' END AS reason FROM u WHERE well_id % 4 <> 0""")
def met_16f(spark, sf):
    """Units that an arm doesn't forecast whole are reported, and no arm is scored on them."""
    w = bridge.wells(spark, sf).select("well_id")
    v = w.select("well_id", F.explode(F.array(*map(F.lit, ("oil", "gas", "water")))).alias("phase")).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("h"))
    v = v.filter("well_id % 4 <> 1 AND NOT (well_id % 4 = 2 AND h = 7)").withColumn("volume", F.when((F.col("well_id") % 4 == 3) & (F.col("h") == 3), -1.0).otherwise(5.0))
    return holdout.retrospective(bridge.decline(spark, sf), CUT, 12, providers.Registry({"stored": lambda rows, h: v}))[1]


# Providers.


@query("udf_02_model_function", f"""WITH l AS (SELECT well_id, phase, avg(q) AS v, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS k FROM ({TRAIN_SQL}) WHERE well_id % 6 <> 5) WHERE k <= 6 GROUP BY ALL)
SELECT well_id, phase, h::INT AS h, round(v * power(0.98e0, h), 6) AS volume FROM l CROSS JOIN range(1, 13) r(h)""")
def udf_02(spark, sf):
    """A model function: the mean of the last six reports, falling; a well it refuses has no rows."""

    def falling(q: np.ndarray):
        return (lambda n: q[-6:].mean() * 0.98 ** np.arange(1, n + 1)) if len(q) else None

    rows = bridge.longer(bridge.decline(spark, sf).filter(F.col("t") <= CUT))
    rows = rows.withColumn("q", F.when(F.col("well_id") % 6 != 5, F.col("q")))
    return providers.from_model(falling)(rows, 12).select(*KEY, "h", r6("volume"))


@query("udf_07_extra_arm", f"""WITH tr AS ({TRAIN_SQL}), g AS ({WELLS_SQL}), m AS (SELECT play, phase, median(q) AS m FROM tr JOIN g USING (well_id) GROUP BY ALL) SELECT arm, phase, count(*) AS n, round(sum(CASE arm WHEN 'play' THEN m ELSE 1e0 END), 4) AS volume
FROM (SELECT DISTINCT well_id, phase FROM tr) JOIN g USING (well_id) JOIN m USING (play, phase) CROSS JOIN (VALUES ('play'), ('one')) a(arm) CROSS JOIN range(12) r(h) GROUP BY ALL""")
def udf_07(spark, sf):
    """An arm made from the training wells and their metadata, beside a plain one."""

    def by_play(pool, metadata):
        level = pool.join(metadata, "well_id").groupBy("play", "phase").agg(F.median("q").alias("m"))
        return lambda rows, horizon: rows.select(*KEY).distinct().join(metadata, "well_id").join(level, ["play", "phase"]).select(*KEY, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), F.col("m").alias("volume"))

    rows = bridge.longer(bridge.decline(spark, sf).filter(F.col("t") <= CUT))
    arms = providers.Registry({"one": lambda rows, n: rows.select(*KEY).distinct().select(*KEY, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("h"), F.lit(1.0).alias("volume"))})
    arms.add_factory("play", by_play, rows, bridge.wells(spark, sf).select("well_id", "play"))
    return arms.forecast(rows, 12).groupBy("arm", "phase").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"))


@query("gen_06_one_on_one", f"""WITH {arms_sql(["bounded"], TRAIN_SQL)}, act AS (SELECT * FROM ({ACTUAL_SQL}) WHERE h <= 12), gx AS (SELECT a.*, volume, actual * 1.05e0 AS stored FROM act a JOIN fc USING (well_id, phase, h)),
gm AS (SELECT well_id, phase, avg(abs((volume - actual) / actual) * 100) AS o, avg(abs((stored - actual) / actual) * 100) AS s FROM gx GROUP BY ALL)
SELECT 'official' AS arm, phase, count(*) AS scored, 0::BIGINT AS missing, round(median(o), 6) AS median, round(avg(o), 6) AS mean FROM gm GROUP BY ALL
UNION ALL SELECT 'stored', phase, count(*) FILTER (WHERE well_id % 3 <> 0), count(*) FILTER (WHERE well_id % 3 = 0), round(median(s) FILTER (WHERE well_id % 3 <> 0), 6), round(avg(s) FILTER (WHERE well_id % 3 <> 0), 6) FROM gm GROUP BY ALL""")
def gen_06(spark, sf):
    """The official arm against stored vectors, which lack some wells."""
    from ..operators import metrics

    d = bridge.decline(spark, sf)
    rows = bridge.longer(d.filter(F.col("t") <= CUT))
    actual = cut(bridge.longer(d.filter((F.col("t") > CUT) & (F.col("t") <= CUT + 12))).select(*KEY, (F.col("t") - CUT).alias("h"), F.col("q").alias("actual"), F.lit(True).alias("available")))
    arms = {"official": providers.arm("bounded")(rows, 12), "stored": actual.filter("well_id % 3 <> 0").select(*KEY, "h", (F.col("actual") * 1.05).alias("volume"))}
    out = None
    for name, fc in arms.items():
        part = metrics.provider_benchmark(actual, fc).select(F.lit(name).alias("arm"), "phase", "scored", "missing", r6("median"), r6("mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query("gen_05_pad_arm_board", f"""WITH {arms_sql([a[0] for a in arps.ARMS], TRAIN_SQL)}, act AS ({ACTUAL_SQL}), pw AS ({WELLS_SQL}),
pv AS (SELECT arm, pad, phase, h, sum(volume) AS v, sum(actual) AS a FROM fc JOIN act USING (well_id, phase, h) JOIN pw USING (well_id) GROUP BY ALL), pm AS (SELECT arm, pad, phase, avg(abs((v - a) / a) * 100) AS mape FROM pv GROUP BY ALL)
SELECT arm, phase, count(*) AS pads, round(median(mape), 6) AS median, round(avg(mape), 6) AS mean FROM pm GROUP BY ALL""")
def gen_05(spark, sf):
    """All ten arms on the summed streams of pads."""
    from ..operators import metrics

    d = bridge.decline(spark, sf)
    fc = arps.forecast(arps.fit(bridge.longer(d.filter(F.col("t") <= CUT)), arps.arms_table(spark)), 12)
    act = bridge.longer(d.filter(F.col("t") > CUT)).select(*KEY, (F.col("t") - CUT).alias("h"), F.col("q").alias("actual"))
    rows = fc.join(act, [*KEY, "h"]).withColumnRenamed("volume", "forecast")
    x = metrics.pad_streams(rows, bridge.wells(spark, sf).select("well_id", "pad"), ("arm",))
    m = x.groupBy("arm", "pad", "phase").agg(metrics.mape().alias("m"))
    return m.groupBy("arm", "phase").agg(F.count("*").alias("pads"), r6(F.median("m"), "median"), r6(F.avg("m"), "mean"))


# Routed wells, by profile.


def _routed(spark, sf, name, horizon=12):
    return routing.forecast_wells(bridge.decline(spark, sf).filter(F.col("t") <= CUT), _groups(spark, sf), horizon, profiles.profile(name))


@query("rt_12_v12_fixed")
def rt_12(spark, sf):
    """Candidates, recovery, anchor, cohorts and ratios: every layer."""
    fc, d = _routed(spark, sf, "v12_fixed")
    return fc.join(d.select(*KEY, "route", "review"), KEY).select(*KEY, "h", r6("volume"), "route", "review")


@query("rt_12_gated_cohort_v1")
def rt_12g(spark, sf):
    """Cohorts behind the gates of age support, dispersion, similarity and endpoints."""
    fc, d = _routed(spark, sf, "gated_cohort_v1")
    return fc.join(d.select(*KEY, "cohort_reason"), KEY).select(*KEY, "h", r6("volume"), "cohort_reason")


@query("coh_11_route_reasons", f"""WITH d AS (SELECT * FROM ({DECLINE_SQL}) WHERE t <= {CUT}), pp AS (SELECT well_id, CASE WHEN sum(oil) >= sum(gas) / 6 THEN 'oil' ELSE 'gas' END AS pp FROM d GROUP BY ALL), g AS ({WELLS_SQL})
SELECT CASE WHEN pp <> 'oil' THEN 'primary_phase_not_allowed' WHEN play NOT IN ('dj', 'eagle_ford', 'delaware') THEN 'group_not_allowed' WHEN phase <> 'oil' THEN 'phase_not_allowed' ELSE 'allowed' END AS cohort_reason, count(*) AS n FROM (SELECT well_id, unnest(['oil', 'gas', 'water']) AS phase FROM pp) u JOIN pp USING (well_id) JOIN (SELECT well_id, CASE WHEN well_id % 3 = 0 THEN 'dj' ELSE play END AS play FROM g) USING (well_id) GROUP BY ALL""")
def coh_11(spark, sf):
    """Why a unit may or may not be blended with its cohort: oil wells of three groups only, oil only."""
    from dataclasses import replace

    p = replace(profiles.profile("selective_cohort_v1"), min_wells=1)
    groups = _groups(spark, sf).withColumn("grp", F.when(F.col("well_id") % 3 == 0, "dj").otherwise(F.col("grp")))
    d = routing.forecast_wells(bridge.decline(spark, sf).filter(F.col("t") <= CUT), groups, 12, p)[1]
    return d.groupBy("cohort_reason").agg(F.count("*").alias("n"))


@query("agg_18_routing_counts")
def agg_18(spark, sf):
    """Which routes the units of the full profile took, and with what weight."""
    return diagnostics.routing_counts(_routed(spark, sf, "v12_fixed")[1]).select("route", "n", r6("weight"))


@query("agg_18_counts_by_reason", "SELECT o_orderstatus AS route, o_orderpriority AS model, count(*) AS n, round(avg(o_totalprice), 4) AS weight FROM orders GROUP BY ALL")
def agg_18r(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("route"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("weight"))
    return diagnostics.routing_counts(o, ["route", "model"]).select("route", "model", "n", F.round("weight", 4).alias("weight"))


@query("rt_06_disruption", f"""WITH {ROUGH}, z AS (SELECT well_id, phase, count(*) FILTER (WHERE q <= 0 AND (p IS NULL OR t > p)) AS streak FROM (SELECT *, max(CASE WHEN q > 0 THEN t END) OVER (PARTITION BY well_id, phase) AS p FROM rough) GROUP BY ALL)
SELECT well_id, phase, streak, streak > 0 AS low FROM z""")
def rt_06(spark, sf):
    """Without fits a trailing streak of zeros is what tells a disruption."""
    none = spark.createDataFrame([], "well_id long, phase string, family string, shape double, a double, c double, origin int, uptime double")
    return routing.disruption(_rough(spark, sf), none)


#: The anchor and a cohort vector from the held-out months.
VECTORS = f"v AS (SELECT well_id, phase, h, b AS anchor, b * (0.6e0 + 0.1e0 * (well_id % 9)) * (1 + 0.02e0 * h) AS volume, 0.1e0 * (1 + well_id % 6) AS weight FROM pr WHERE h <= 12)"


def _vectors(spark, sf):
    k = F.col("well_id")
    return _pairs(spark, sf).filter("h <= 12").select(*KEY, "h", F.col("b").alias("anchor"), (F.col("b") * (0.6 + 0.1 * (k % 9)) * (1 + 0.02 * F.col("h"))).alias("volume"), (0.1 * (1 + k % 6)).alias("weight"))


@query("coh_13_divergence", f"""WITH {PAIRS}, {VECTORS}, f AS (SELECT *, max(CASE WHEN h <= 6 THEN abs(ln(volume / anchor)) END) OVER w > ln(1.35e0) AS far FROM v WINDOW w AS (PARTITION BY well_id, phase)),
c AS (SELECT *, CASE WHEN far THEN least(greatest(volume, anchor / 1.35e0), anchor * 1.35e0) ELSE volume END AS capped FROM f), t AS (SELECT *, abs(ln(sum(capped) OVER (PARTITION BY well_id, phase) / sum(anchor) OVER (PARTITION BY well_id, phase))) AS d FROM c)
SELECT well_id, phase, h::INT AS h, round(capped, 6) AS volume, round(CASE WHEN d > ln(1.18e0) THEN weight * ln(1.18e0) / d ELSE weight END, 6) AS weight FROM t""")
def coh_13(spark, sf):
    """A cohort vector too far from the anchor is clipped, and counts less if totals differ."""
    x = cohort.diverging(_vectors(spark, sf), float(np.log(1.35)), float(np.log(1.18)), 6)
    return x.select(*KEY, "h", r6("volume"), r6("weight"))


@query("coh_14_blend", f"WITH {PAIRS}, {VECTORS} SELECT well_id, phase, h::INT AS h, round(weight * volume + (1 - weight) * anchor, 6) AS linear, round(exp(weight * ln(greatest(volume, 1e-9)) + (1 - weight) * ln(greatest(anchor, 1e-9))), 6) AS logarithmic FROM v")
def coh_14(spark, sf):
    v = _vectors(spark, sf)
    mixed = lambda space: cohort.blend(F.col("anchor"), F.col("volume"), F.col("weight"), space)
    return v.select(*KEY, "h", r6(mixed("linear"), "linear"), r6(mixed("log"), "logarithmic"))


@query("coh_09_endpoint_gate", f"""WITH {ROUGH}, b AS (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS back FROM rough WHERE q > 0), k AS (SELECT *, ln(q) - lag(ln(q)) OVER (PARTITION BY well_id, phase ORDER BY t) AS d FROM b WHERE back <= 6),
g AS (SELECT well_id, phase, count(*) AS m, max(q) FILTER (WHERE back = 1) / median(q) FILTER (WHERE back BETWEEN 2 AND 4) AS x, stddev_pop(d) AS sd FROM k GROUP BY ALL)
SELECT well_id, phase, CASE WHEN m >= 4 AND (x NOT BETWEEN 0.6e0 AND 1.6e0 OR sd > 0.45e0) THEN 0e0 ELSE 1e0 END AS factor FROM g""")
def coh_09(spark, sf):
    """The endpoint gates alone of the gated profile."""
    from dataclasses import replace

    g = profiles.profile("gated_cohort_v1")
    p = replace(g, min_age_support=0, max_log_mad=None, max_history_error=None)
    rows = _rough(spark, sf)
    return routing.gates(rows, _groups(spark, sf), cut(cohort.profiles(rows, _groups(spark, sf))), 12, p).select(*KEY, "factor")


@query("coh_16_ratio_forecast", f"""WITH dw AS MATERIALIZED (SELECT * FROM ({DECLINE_SQL}) WHERE t <= {CUT}), g AS (SELECT well_id, play AS grp FROM ({WELLS_SQL})), pp AS (SELECT well_id, CASE WHEN sum(oil) >= sum(gas) / 6 THEN 'oil' ELSE 'gas' END AS pp FROM dw GROUP BY ALL),
rr AS (SELECT well_id, CASE WHEN pp = 'oil' THEN 'gor' ELSE 'cgr' END AS rel, t, ln(CASE WHEN pp = 'oil' THEN gas / oil ELSE oil / gas END) AS lr FROM dw JOIN pp USING (well_id) UNION ALL SELECT well_id, CASE WHEN pp = 'oil' THEN 'wor' ELSE 'wgr' END, t, ln(CASE WHEN pp = 'oil' THEN water / oil ELSE water / gas END) FROM dw JOIN pp USING (well_id)),
rs AS (SELECT well_id, rel, least(greatest(regr_slope(lr, t), -0.025e0), 0.025e0) AS slope, median(exp(lr)) FILTER (WHERE back <= 6) AS level, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY well_id, rel ORDER BY t DESC) AS back FROM rr) WHERE back <= 18 GROUP BY ALL),
pr AS (SELECT grp, rel, median(slope) AS prior, count(*) AS n FROM rs JOIN g USING (well_id) GROUP BY ALL), ev AS (SELECT rel, median(slope) AS every FROM rs GROUP BY ALL),
s AS (SELECT rs.*, CASE WHEN coalesce(pr.n, 0) < 5 THEN every ELSE prior END AS prior, least(greatest(rs.n / 24e0, 0.2e0), 0.65e0) AS k FROM rs JOIN g USING (well_id) JOIN ev USING (rel) LEFT JOIN pr USING (grp, rel))
SELECT well_id, rel, h::INT AS h, round(100e0 * level * exp(least(greatest(k * slope + (1 - k) * prior, -0.025e0), 0.025e0) * h), 6) AS volume FROM s CROSS JOIN range(1, 7) r(h)""")
def coh_16(spark, sf):
    """Secondary phases from a flat primary forecast of 100 a month."""
    wide, groups = bridge.decline(spark, sf).filter(F.col("t") <= CUT), _groups(spark, sf)
    slopes = cohort.ratio_slopes(wide)
    base = groups.select("well_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("h"), F.lit(100.0).alias("volume"))
    return cohort.ratio_forecast(slopes, cohort.ratio_priors(slopes, groups), groups, base).select("well_id", "rel", "h", r6("volume"))


@query("gate_08_ablations")
def gate_08(spark, sf):
    """The ablation matrix on the held-out year: score, interval against the control and verdict."""
    d = bridge.decline(spark, sf)
    actual = bridge.longer(d.filter((F.col("t") > CUT) & (F.col("t") <= CUT + 12))).select(*KEY, (F.col("t") - CUT).alias("h"), F.col("q").alias("actual"))
    x = holdout.ablation_board(d.filter(F.col("t") <= CUT), _groups(spark, sf), actual, 12, reps=200)
    return x.select("arm", "n", *(r6(c) for c in ("median", "spread", "score", "p95", "largest", "diff", "low", "high", "p_better")), "verdict")


@query("gen_04_throughput", f"SELECT 'scipy_control' AS profile, count(*) // 3 AS wells, 360 AS horizon, 3 AS phases, count(*) * 360 AS forecast_values, 0::BIGINT AS failures, true AS passed FROM (SELECT DISTINCT well_id, phase FROM ({DECLINE_LONG_SQL}) WHERE t <= {CUT})")
def gen_04(spark, sf):
    """Thirty years of every well and phase by the control: how many values are finite and not
    negative, and how many units fail."""
    fc = _routed(spark, sf, "scipy_control", 360)[0]
    good = F.col("volume").isNotNull() & ~F.isnan("volume") & (F.col("volume") >= 0) & (F.col("volume") < float("inf"))
    units = fc.groupBy(*KEY).agg(F.count_if(good).alias("n"))
    x = units.agg(F.count_distinct("well_id").alias("wells"), F.sum(F.when(F.col("n") == 360, F.col("n")).otherwise(0)).alias("forecast_values"), F.count_if(F.col("n") != 360).alias("failures"))
    return x.select(F.lit("scipy_control").alias("profile"), "wells", F.lit(360).alias("horizon"), F.lit(3).alias("phases"), "forecast_values", "failures", (F.col("failures") == 0).alias("passed"))


@query("gen_03_paired_board")
def gen_03(spark, sf):
    """Control and linear arm on the same synthetic wells: paired deltas with intervals, by scenario."""
    x = synth.stress(spark, [1, 2]).unpivot(["seed", "well_id", "scenario", "split", "t"], ["oil", "gas", "water"], "phase", "q")
    x = cut(x.join(x.filter("split = 'train' AND q IS NOT NULL").select(*KEY).distinct(), KEY, "left_semi"))
    train = x.filter("split = 'train'").select(*KEY, "t", "q")
    held = x.filter("split = 'holdout'").join(train.groupBy("well_id").agg((F.max("t") + 1).alias("o")), "well_id")
    actual = held.select(*KEY, (F.col("t") - F.col("o") + 1).alias("h"), F.col("q").alias("actual"))
    arms = providers.Registry({"control": control.forecast, "linear": providers.arm("bounded")})
    e, failures = holdout.scored(cut(actual), cut(arms.forecast(train, 12)), ["control", "linear"], 12)
    of = x.select("well_id", "scenario").distinct()
    p = holdout.paired(e, "control", "linear")
    by = p.join(of, "well_id").groupBy("scenario").agg(F.count("*").alias("units"), (holdout.pool_score(F.col("a")) - holdout.pool_score(F.col("b"))).alias("delta"))
    every = holdout.comparison(e, "control", "linear", 100, 17).select(F.lit("(all)").alias("scenario"), "units", "delta", "low", "high")
    out = by.select("scenario", "units", "delta", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")).unionByName(every)
    return out.select("scenario", "units", r6("delta"), r6("low"), r6("high"))


# Boards.

#: A series of whole numbers, so that both engines write it alike.
COUNTS = "bs AS (SELECT l_suppkey AS well_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, count(*)::DOUBLE AS oil, sum(l_linenumber)::DOUBLE AS gas FROM lineitem GROUP BY ALL)"


def _counts(spark, sf):
    from ..functions.columns import month_number

    li = table(spark, sf, "lineitem")
    t = (month_number(F.col("l_shipdate")) - bridge.FIRST_MONTH).alias("t")
    return li.groupBy(F.col("l_suppkey").alias("well_id"), t).agg(F.count("*").cast("double").alias("oil"), F.sum("l_linenumber").cast("double").alias("gas"), F.lit(None).cast("double").alias("water"))


@query("brd_07_split_hashes", f"WITH {COUNTS}, l AS (SELECT well_id, t, t || ',' || oil || ',' || gas || ',' AS x FROM bs) SELECT well_id, sha256(string_agg(x, ';' ORDER BY t)) AS full_hash, sha256(string_agg(x, ';' ORDER BY t) FILTER (WHERE t <= {CUT})) AS train_hash FROM l GROUP BY ALL")
def brd_07(spark, sf):
    return board.split_hashes(_counts(spark, sf), CUT).select("well_id", "full_hash", "train_hash")


@query("brd_08_well_keys", f"SELECT well_id, play || '|' || CASE WHEN well_id % 2 = 0 THEN 'b1' ELSE 'b2' END || '|' || substr(md5(well_id || '|board'), 1, 10) AS well_key FROM ({WELLS_SQL})")
def brd_08(spark, sf):
    w = bridge.wells(spark, sf)
    return w.select("well_id", board.well_key(F.col("play"), F.when(F.col("well_id") % 2 == 0, "b1").otherwise("b2"), board.hash_order("well_id", "board")).alias("well_key"))


FRACTIONS = f"fr AS (SELECT well_id, play, CASE WHEN well_id % 5 < 2 THEN 'eval' WHEN well_id % 5 < 4 THEN 'dev' ELSE 'cohort' END AS role, least(1e0, (well_id % 4) / 3e0) AS tf, CASE WHEN well_id % 7 = 0 THEN 0.5e0 ELSE 1e0 END AS hf FROM ({WELLS_SQL}))"


@query("agg_11_provenance_by_role_and_play", f"""WITH {FRACTIONS}, x AS (SELECT 'role' AS label, role AS value, tf, hf FROM fr UNION ALL SELECT 'play', play, tf, hf FROM fr)
SELECT label, value, count(*) AS n, round(avg(tf), 6) AS train_reported, round(avg(hf), 6) AS holdout_reported, count(*) FILTER (WHERE hf >= 1) AS all_holdout, count(*) FILTER (WHERE hf >= 1 AND tf >= 1) AS all_full FROM x GROUP BY ALL""")
def agg_11(spark, sf):
    k = F.col("well_id")
    w = bridge.wells(spark, sf).withColumns({"role": F.when(k % 5 < 2, "eval").when(k % 5 < 4, "dev").otherwise("cohort"), "train_fraction": F.least(F.lit(1.0), (k % 4) / 3), "holdout_fraction": F.when(k % 7 == 0, 0.5).otherwise(1.0)})
    return board.provenance_summary(w).select("label", "value", "n", r6("train_reported"), r6("holdout_reported"), "all_holdout", "all_full")


@query("agg_13_seed_spread", "WITH s AS (SELECT user_id % 50 AS seed, event_type AS scenario, avg((value > 50)::INT) AS r FROM events GROUP BY ALL) SELECT scenario, count(*) AS seeds, round(avg(r), 6) AS rate, round(stddev_pop(r), 6) AS spread FROM s GROUP BY ALL")
def agg_13s(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("seed"), F.col("event_type").alias("scenario"), (F.col("value") > 50).alias("flagged"))
    return diagnostics.seed_spread(e, ["scenario"]).select("scenario", "seeds", r6("rate"), r6("spread"))


@query("agg_20_available_phases", f"SELECT count(DISTINCT well_id) AS wells, count(DISTINCT CASE WHEN well_id % 3 <> 0 THEN well_id END) AS oil, count(DISTINCT CASE WHEN well_id % 4 <> 0 OR t > 40 THEN well_id END) AS gas, 0::BIGINT AS water FROM ({DECLINE_SQL})")
def agg_20(spark, sf):
    k = F.col("well_id")
    d = bridge.decline(spark, sf).withColumns({"oil": F.when(k % 3 != 0, F.col("oil")), "gas": F.when((k % 4 != 0) | (F.col("t") > 40), F.col("gas")), "water": F.lit(None).cast("double")})
    return calendar.availability_counts(d)


@query("set_03_n_ary", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 350000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def set_03n(spark, sf):
    """Keys that all of several arms have."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    arms = [c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), o.filter("o_totalprice > 350000").select(F.col("o_custkey").alias("k")), o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))]
    return sequence.common_keys(arms, ["k"])


# Models' answers.


@query("ext_03_promotion", f"""WITH w AS ({WELLS_SQL}), r AS (SELECT DISTINCT pad, well_id, dense_rank() OVER (ORDER BY pad) % 5 AS k FROM w)
SELECT pad AS pad_id, well_id::VARCHAR AS well_id, phase, h::INT AS h, (well_id % 100 + h)::DOUBLE AS volume FROM r CROSS JOIN (VALUES ('oil'), ('gas')) p(phase) CROSS JOIN range(1, 4) q(h) WHERE k NOT IN (1, 2)""")
def ext_03(spark, sf):
    """Whole pads or none: some answers lack a well, some have a negative volume."""
    return _promoted(spark, sf)[0]


@query("ext_03_refusals", f"WITH w AS ({WELLS_SQL}), r AS (SELECT DISTINCT pad, dense_rank() OVER (ORDER BY pad) % 5 AS k FROM w) SELECT pad AS pad_id, k = 1 AS short FROM r WHERE k IN (1, 2)")
def ext_03r(spark, sf):
    return _promoted(spark, sf)[1].select("pad_id", (F.col("problem").startswith("missing wells")).alias("short"))


def _promoted(spark, sf):
    from pyspark.sql import Window

    w = bridge.wells(spark, sf).select(F.col("pad").alias("pad_id"), F.col("well_id").alias("key"), F.col("well_id").cast("string").alias("well_id"))
    ranks = w.select("pad_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("pad_id")) % 5)  # nations
    v = lambda bad: F.array(*((F.col("key") % 100 + h).cast("double") if not (bad and h == 2) else F.lit(-1.0) for h in (1, 2, 3)))
    phases = F.create_map(F.lit("oil"), v(False), F.lit("gas"), F.when(F.col("k") == 2, v(True)).otherwise(v(False)))
    x = w.join(ranks, "pad_id").groupBy("pad_id", "k").agg(F.collect_list(F.struct("well_id", phases.alias("p"))).alias("all"))
    some = F.when(F.col("k") == 1, F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1)))).otherwise(F.col("all"))
    some = F.when((F.col("k") == 1) & (F.size("all") == 1), F.expr("filter(all, x -> false)")).otherwise(some)
    text = F.concat(F.lit("Here {as asked}:\n```json\n{\"note\": \"a } brace\", \"forecasts\": "), F.to_json(F.map_from_entries(some)), F.when(F.col("k") == 4, "}").otherwise("}\n```\n"))
    return files.promote_responses(x.select("pad_id", text.alias("text")), w.select("pad_id", "well_id"), 3)
