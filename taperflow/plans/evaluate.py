"""Metric, resampling, board, provenance, cohort, family and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import pool_score
from ..operators import board, cohort, control, diagnostics, families, gates, holdout, metrics, ordering, profiles, resample, routing, submission, synth
from ..sources import bridge, sinks
from ..sources.bridge import DECLINE_LONG_SQL, DECLINE_SQL, WELLS_SQL, table
from .prepare import ROUGH, _rough
from .registry import query, r6

CUT = bridge.CUT
#: Actuals are the decline series after the cut; two arms are simple functions of it.
PAIRS = f"""pr AS MATERIALIZED (SELECT well_id, phase, t - {CUT} AS h, CASE WHEN (t + well_id) % 9 = 0 THEN NULL WHEN (t + well_id) % 13 = 0 THEN 0e0 ELSE q END AS actual,
  CASE WHEN (t + well_id) % 10 = 1 THEN 0e0 ELSE q * (1 + 0.02e0 * ((well_id * 7 + t) % 11 - 5)) END AS a, q * (1 + 0.03e0 * ((well_id * 5 + t * 3) % 13 - 6)) AS b FROM ({DECLINE_LONG_SQL}) WHERE t > {CUT})"""


def _pairs(spark, sf):
    x = bridge.longer(bridge.decline(spark, sf)).filter(F.col("t") > CUT)
    k, q = F.col("t") + F.col("well_id"), F.col("q")
    actual = F.when(k % 9 == 0, F.lit(None).cast("double")).when(k % 13 == 0, 0.0).otherwise(q)
    a = F.when(k % 10 == 1, 0.0).otherwise(q * (1 + 0.02 * ((F.col("well_id") * 7 + F.col("t")) % 11 - 5)))
    b = q * (1 + 0.03 * ((F.col("well_id") * 5 + F.col("t") * 3) % 13 - 6))
    return x.select("well_id", "phase", (F.col("t") - CUT).alias("h"), actual.alias("actual"), a.alias("a"), b.alias("b"))


def _arm(spark, sf, arm="a"):
    return _pairs(spark, sf).withColumnRenamed(arm, "forecast")


KEY = ["well_id", "phase"]


@query("met_01_02_mape_bias", f"WITH {PAIRS} SELECT phase, round(avg(abs((a - actual) / actual) * 100) FILTER (WHERE actual <> 0), 6) AS mape, round(avg((a - actual) / actual * 100) FILTER (WHERE actual <> 0), 6) AS bias, round(2e0 / 3 * abs(median(ln(a / actual)) FILTER (WHERE a > 0 AND actual > 0)) + 1e0 / 3 * stddev_pop(ln(a / actual)) FILTER (WHERE a > 0 AND actual > 0), 6) AS spee_score FROM pr GROUP BY ALL")
def met_01(spark, sf):
    return _arm(spark, sf).groupBy("phase").agg(*(r6(f(), n) for n, f in metrics.METRICS.items()))


LOGE = f"""{PAIRS}, m AS (SELECT well_id, phase, median(actual) FILTER (WHERE actual > 0) AS med FROM pr GROUP BY ALL),
le AS (SELECT pr.*, CASE WHEN actual > 0 THEN ln(CASE WHEN a > 0 THEN a ELSE greatest(1e-12, 1e-6 * greatest(coalesce(med, 0), 1e-12)) END / actual) END AS e FROM pr JOIN m USING (well_id, phase))"""


@query("met_03_log_errors_epsilon", f"WITH {LOGE} SELECT well_id, phase, h::INT AS h, round(e, 6) AS e FROM le")
def met_03(spark, sf):
    return metrics.log_errors(_arm(spark, sf), KEY).select(*KEY, "h", r6("e"))


@query("met_03_log_errors_drop", f"WITH {PAIRS} SELECT well_id, phase, h::INT AS h, round(CASE WHEN actual > 0 AND a > 0 THEN ln(a / actual) END, 6) AS e FROM pr")
def met_03d(spark, sf):
    return metrics.log_errors(_arm(spark, sf), KEY, "drop").select(*KEY, "h", r6("e"))


@query("met_03_audit", f"WITH {PAIRS} SELECT phase, count(*) AS rows, count(*) FILTER (WHERE actual IS NULL) AS missing_actual, count(*) FILTER (WHERE actual <= 0) AS nonpositive_actual, count(*) FILTER (WHERE actual > 0 AND a <= 0) AS zero_forecast, count(*) FILTER (WHERE actual > 0) AS scored FROM pr GROUP BY ALL")
def met_03a(spark, sf):
    return metrics.audit(_arm(spark, sf), ["phase"])


CUME = f"""{PAIRS}, cu AS (SELECT well_id, phase, ln(greatest(sum(greatest(a, 0)) FILTER (WHERE actual IS NOT NULL), 1e-6 * sum(actual)) / nullif(sum(actual), 0)) AS e,
  ln(greatest(sum(greatest(b, 0)) FILTER (WHERE actual IS NOT NULL), 1e-6 * sum(actual)) / nullif(sum(actual), 0)) AS eb FROM pr GROUP BY ALL)"""


@query("met_05_cumulative", f"WITH {CUME} SELECT well_id, phase, round(e, 6) AS e FROM cu")
def met_05(spark, sf):
    return metrics.cumulative(_arm(spark, sf), KEY).select(*KEY, r6("e"))


@query("met_09_missing_forecasts", f"WITH {CUME} SELECT well_id, phase, round(CASE WHEN well_id % 5 <> 2 THEN e END, 6) AS e FROM cu")
def met_09(spark, sf):
    """A unit with a month that isn't forecast has no error, however good the rest is.  The month is a
    row even if the unit reported nothing in it."""
    x = _arm(spark, sf).select(*KEY, "h", "actual", "forecast").filter((F.col("well_id") % 5 != 2) | (F.col("h") != 4))
    none = F.lit(None).cast("double")
    late = _arm(spark, sf).filter("well_id % 5 = 2").select(*KEY, F.lit(4).alias("h")).distinct().select("*", none.alias("actual"), none.alias("forecast"))
    return metrics.cumulative(x.unionByName(late), KEY).select(*KEY, r6("e"))


@query("met_05_zero_totals_dropped", f"WITH {CUME} SELECT well_id, phase, round(CASE WHEN well_id % 7 <> 3 THEN e END, 6) AS e FROM cu")
def met_05z(spark, sf):
    x = _arm(spark, sf).withColumn("forecast", F.when(F.col("well_id") % 7 == 3, 0.0).otherwise(F.col("forecast")))
    return metrics.cumulative(x, KEY, zero="drop").select(*KEY, r6("e"))


@query("met_10_ablation_mean", f"WITH {PAIRS} SELECT well_id, phase, round(CASE WHEN count(*) FILTER (WHERE actual > 0) >= 2 THEN avg(ln(CASE WHEN a > 0 THEN a ELSE 1e-9 END / actual)) FILTER (WHERE actual > 0) END, 6) AS e FROM pr GROUP BY ALL")
def met_10(spark, sf):
    return metrics.ablation_mean(_arm(spark, sf), KEY).select(*KEY, r6("e"))


@query("met_17_arm_summary", f"""WITH {CUME}, x AS (SELECT 'a' AS arm, e FROM cu UNION ALL SELECT 'b', eb FROM cu)
SELECT arm, count(e) AS n, round(median(e), 6) AS median, round(2e0 / 3 * abs(median(e)) + 1e0 / 3 * stddev_pop(e), 6) AS score, round(avg(abs(e)), 6) AS mean_abs, round(median(abs(e)), 6) AS median_abs FROM x GROUP BY ALL""")
def met_17(spark, sf):
    e = metrics.cumulative(_arm(spark, sf), KEY).withColumn("arm", F.lit("a")).unionByName(metrics.cumulative(_arm(spark, sf, "b"), KEY).withColumn("arm", F.lit("b")))
    return metrics.arm_summary(e, ["arm"]).select("arm", "n", *(r6(c) for c in ("median", "score", "mean_abs", "median_abs")))


@query("agg_21_all_phase_means", f"WITH {CUME} SELECT well_id, round(avg(CASE WHEN phase <> 'gas' OR well_id % 4 <> 1 THEN e END), 6) AS e FROM cu GROUP BY ALL")
def agg_21(spark, sf):
    e = metrics.cumulative(_arm(spark, sf), KEY).withColumn("e", F.when((F.col("phase") != "gas") | (F.col("well_id") % 4 != 1), F.col("e")))
    return metrics.available_mean(e, ["well_id"]).select("well_id", r6("e"))


@query("agg_16_merged_audits", f"WITH {PAIRS} SELECT well_id % 3 AS part, count(*) AS rows, count(*) FILTER (WHERE actual IS NULL) AS missing_actual, count(*) FILTER (WHERE actual <= 0) AS nonpositive_actual, count(*) FILTER (WHERE actual > 0 AND a <= 0) AS zero_forecast, count(*) FILTER (WHERE actual > 0) AS scored FROM pr GROUP BY ALL")
def agg_16(spark, sf):
    return metrics.merge_audits(metrics.audit(_arm(spark, sf), KEY).withColumn("part", F.col("well_id") % 3), ["part"])


@query("met_06_decomposition", f"""WITH {CUME}, s AS (SELECT phase, count(e) AS n, median(e) AS median, 2e0 / 3 * abs(median(e)) AS bp, 1e0 / 3 * stddev_pop(e) AS sp, avg(abs(e)) AS ma FROM cu GROUP BY ALL)
SELECT phase, n, round(median, 6) AS median, round(bp, 6) AS bias_part, round(sp, 6) AS spread_part, round(ma, 6) AS mean_abs, round(bp + sp, 6) AS score, round(bp / (bp + sp), 6) AS bias_share FROM s""")
def met_06(spark, sf):
    x = metrics.decomposition(metrics.cumulative(_arm(spark, sf), KEY), ["phase"])
    return x.select("phase", "n", *(r6(c) for c in ("median", "bias_part", "spread_part", "mean_abs", "score", "bias_share")))


@query("met_08_monthly_mean", f"""WITH {LOGE.replace('1e-6 * greatest', '1e-4 * greatest').replace('greatest(1e-12, 1e-4', 'greatest(1e-9, 1e-4')}
SELECT well_id, phase, round(CASE WHEN count(e) >= 2 THEN avg(e) END, 6) AS e, CASE WHEN count(e) >= 2 THEN 'ok' ELSE 'insufficient_actual_positive' END AS status, count(e) AS actual_positive, count(*) FILTER (WHERE actual > 0 AND a <= 0) AS forecast_floored FROM le GROUP BY ALL""")
def met_08(spark, sf):
    return metrics.monthly_mean(_arm(spark, sf), KEY).select(*KEY, r6("e"), "status", "actual_positive", "forecast_floored")


@query("met_12_13_tails", f"WITH {CUME} SELECT phase, round(quantile_cont(abs(e), 0.9), 6) AS p90, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(quantile_cont(abs(e), 0.99), 6) AS p99, round(max(abs(e)), 6) AS largest, round(avg((abs(e) > ln(2e0))::INT), 6) AS catastrophic FROM cu GROUP BY ALL")
def met_12(spark, sf):
    x = metrics.tails(metrics.cumulative(_arm(spark, sf), KEY), ["phase"])
    return x.select("phase", *(r6(c) for c in ("p90", "p95", "p99", "largest", "catastrophic")))


@query("met_14_provider_benchmark", f"""WITH {PAIRS}, v AS (SELECT *, well_id % 6 = 5 AND phase = 'water' AS off, well_id % 5 = 3 AS gone FROM pr),
s AS (SELECT well_id, phase, any_value(off) AS off, any_value(gone) AS gone, avg(abs((a - actual) / actual) * 100) FILTER (WHERE actual <> 0) AS mape FROM v GROUP BY ALL)
SELECT phase, count(*) FILTER (WHERE NOT off AND NOT gone) AS scored, count(*) FILTER (WHERE off) AS unavailable, count(*) FILTER (WHERE gone AND NOT off) AS missing, round(median(mape) FILTER (WHERE NOT off AND NOT gone), 6) AS mape_median, round(avg(mape) FILTER (WHERE NOT off AND NOT gone), 6) AS mape_mean FROM s GROUP BY ALL""")
def met_14(spark, sf):
    p = _pairs(spark, sf)
    actual = p.select(*KEY, "h", "actual").withColumn("available", (F.col("well_id") % 6 != 5) | (F.col("phase") != "water"))
    x = metrics.provider_benchmark(actual, p.filter("well_id % 5 <> 3").select(*KEY, "h", F.col("a").alias("volume")), "mape")
    return x.select("phase", "scored", "unavailable", "missing", r6("median", "mape_median"), r6("mean", "mape_mean"))


@query("met_15_pad_benchmark", f"""WITH {PAIRS}, w AS ({WELLS_SQL}), p AS (SELECT pad, phase, h, sum(actual) AS actual, sum(a) AS a FROM pr JOIN w USING (well_id) GROUP BY ALL)
SELECT pad, phase, round(avg(abs((a - actual) / actual) * 100) FILTER (WHERE actual <> 0), 6) AS mape, round(ln(sum(a) FILTER (WHERE actual IS NOT NULL) / nullif(sum(actual), 0)), 6) AS e FROM p GROUP BY ALL""")
def met_15(spark, sf):
    """Streams of a pad are summed, then scored."""
    x = metrics.pad_streams(_arm(spark, sf), bridge.wells(spark, sf).select("well_id", "pad"))
    m = x.groupBy("pad", "phase").agg(r6(metrics.mape(), "mape"))
    return m.join(metrics.cumulative(x, ["pad", "phase"]).select("pad", "phase", r6("e")), ["pad", "phase"])


@query("rt_05_routing_loss", f"""WITH {PAIRS}, m AS (SELECT well_id, phase, greatest(coalesce(median(actual) FILTER (WHERE actual > 0), 1), 1) AS scale FROM pr GROUP BY ALL),
x AS (SELECT pr.*, scale, CASE WHEN actual > 0 THEN ln(CASE WHEN a > 0 THEN a ELSE greatest(1e-9, 1e-4 * scale) END / actual) END AS e FROM pr JOIN m USING (well_id, phase))
SELECT well_id, phase, round(CASE WHEN count(e) >= 2 THEN 0.7e0 * (2e0 / 3 * abs(median(e)) + 1e0 / 3 * stddev_pop(e)) + 0.2e0 * avg(abs(greatest(a, 0) - greatest(actual, 0))) FILTER (WHERE actual IS NOT NULL) / any_value(scale)
  + 0.1e0 * avg((actual <= 0 AND a > 0.05e0 * scale)::INT) FILTER (WHERE actual IS NOT NULL) ELSE 9e0 END, 6) AS loss FROM x GROUP BY ALL""")
def rt_05(spark, sf):
    return metrics.routing_loss(_arm(spark, sf), KEY).select(*KEY, r6("loss"))


# Resampling.

UNITS = f"{CUME}, un AS (SELECT row_number() OVER (ORDER BY well_id, phase) - 1 AS unit, well_id, phase, e AS a, eb AS b FROM cu WHERE e IS NOT NULL)"


def _errors(spark, sf):
    a = metrics.cumulative(_arm(spark, sf), KEY).select(*KEY, F.col("e").alias("a"))
    b = metrics.cumulative(_arm(spark, sf, "b"), KEY).select(*KEY, F.col("e").alias("b"))
    return a.join(b, KEY).filter("a IS NOT NULL")


def _units(spark, sf):
    return ordering.numbered(_errors(spark, sf), KEY, "unit")


def draws_sql(reps: int, seed: int, n: str = "n") -> str:
    """CTE u (rep, unit): the hashed draws over a relation n with the column n."""
    return f"u AS (SELECT rep, ('0x' || substr(md5('{seed}|' || rep || '|' || k), 1, 13))::BIGINT % n AS unit FROM {n}, range({reps}) a(rep), range(0, (SELECT n FROM {n})) b(k))"


POOL = "(2e0 / 3 * abs(median({x})) + 1e0 / 3 * stddev_pop({x}))"
DELTA = f"{POOL.format(x='a')} - {POOL.format(x='b')}"


@query("inf_01_paired_bootstrap", f"""WITH {UNITS}, n AS (SELECT count(*) AS n FROM un), {draws_sql(500, 17)},
s AS (SELECT rep, {DELTA} AS delta FROM u JOIN un USING (unit) GROUP BY ALL)
SELECT round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg((delta < 0)::INT), 6) AS p_better FROM s""")
def inf_01(spark, sf):
    u = _units(spark, sf)
    return resample.bootstrap(u, u.count(), 500).select(r6("low"), r6("high"), r6("p_better"))


CLUSTERED = f"""cl AS (SELECT well_id, row_number() OVER (ORDER BY well_id) - 1 AS unit FROM (SELECT DISTINCT well_id FROM un)), cn AS (SELECT count(*) AS n FROM cl),
{draws_sql(300, 20260729, 'cn')}, bs AS (SELECT rep, {DELTA} AS delta FROM u JOIN cl USING (unit) JOIN un USING (well_id) GROUP BY ALL),
ci AS (SELECT quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high, avg((delta < 0)::INT) AS p_better FROM bs)""".replace("JOIN un USING (well_id)", "JOIN (SELECT well_id, a, b FROM un) x USING (well_id)")


@query("inf_03_clustered_bootstrap", f"WITH {UNITS}, {CLUSTERED} SELECT round(low, 6) AS low, round(high, 6) AS high, round(p_better, 6) AS p_better, CASE WHEN high < 0 THEN 'BETTER' WHEN low > 0 THEN 'WORSE' ELSE 'inconclusive' END AS verdict FROM ci")
def inf_03(spark, sf):
    """Wells are drawn with all their phases."""
    ci = resample.clustered(_errors(spark, sf), "well_id", 300, 20260729)
    return ci.select(r6("low"), r6("high"), r6("p_better"), resample.verdict(F.col("low"), F.col("high")).alias("verdict"))


@query("inf_04_seed_means", f"""WITH {UNITS}, sd AS (SELECT well_id % 20 AS seed, avg(a) AS x FROM un GROUP BY ALL), sn AS (SELECT count(*) AS n FROM sd), si AS (SELECT row_number() OVER (ORDER BY seed) - 1 AS unit, x FROM sd), {draws_sql(400, 1307, 'sn')},
m AS (SELECT rep, avg(x) AS v FROM u JOIN si USING (unit) GROUP BY ALL) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM m""")
def inf_04(spark, sf):
    """The interval of a mean over seeds."""
    seeds = _errors(spark, sf).groupBy((F.col("well_id") % 20).alias("seed")).agg(F.avg("a").alias("x"))
    x = ordering.numbered(seeds, ["seed"], "unit")
    return resample.mean_interval(x, x.count(), 400, 1307).select(r6("low"), r6("high"))


@query("inf_05_leave_one_out", f"""WITH {UNITS}, s AS (SELECT {POOL.format(x='a')} AS s FROM un)
SELECT x.unit, round({POOL.format(x='y.a')} - any_value(s), 6) AS influence FROM un x JOIN un y ON x.unit <> y.unit CROSS JOIN s GROUP BY ALL""")
def inf_05(spark, sf):
    return resample.leave_one_out(_units(spark, sf).select("unit", F.col("a").alias("e"))).select(F.col("unit").cast("long").alias("unit"), r6("influence"))


@query("inf_06_win_rate", f"WITH {UNITS} SELECT round(avg((abs(a) < abs(b))::INT), 6) AS win_rate, round(avg(abs(a) - abs(b)), 6) AS mean_delta, round(median(abs(a) - abs(b)), 6) AS median_delta FROM un")
def inf_06(spark, sf):
    return resample.win_rate(_units(spark, sf)).select(r6("win_rate"), r6("mean_delta"), r6("median_delta"))


@query("srt_04_without_top", f"""WITH {UNITS}, k AS (SELECT *, row_number() OVER (ORDER BY -abs(a), unit) AS r, ceil(0.01e0 * count(*) OVER ())::BIGINT AS top FROM un)
SELECT count(*) AS n, any_value(top)::INT AS removed, round({POOL.format(x='a')}, 6) AS score, round({POOL.format(x='CASE WHEN r > 1 THEN a END')}, 6) AS without_one, round({POOL.format(x='CASE WHEN r > top THEN a END')}, 6) AS without_share FROM k""")
def srt_04t(spark, sf):
    """The score without the most extreme unit, and without the top hundredth."""
    x = resample.without_top(_units(spark, sf).select("unit", F.col("a").alias("e")))
    return x.select("n", "removed", *(r6(c) for c in ("score", "without_one", "without_share")))


# Cohorts and ratios.

SHAPE = f"""dec AS MATERIALIZED ({DECLINE_LONG_SQL}), g AS (SELECT well_id, play AS grp FROM ({WELLS_SQL})), pk AS (SELECT well_id, phase, min(t) AS peak, any_value(q) AS pq, any_value(n) AS n FROM (SELECT *, max(q) OVER (PARTITION BY well_id, phase) AS m, count(*) OVER (PARTITION BY well_id, phase) AS n FROM dec WHERE t <= {CUT}) WHERE q = m GROUP BY ALL),
ag AS (SELECT d.well_id, d.phase, d.t - peak AS age, ln(q / pq) AS lr FROM dec d JOIN pk USING (well_id, phase) WHERE d.t <= {CUT} AND d.t >= peak AND n >= 6 AND q > 0),
al AS (SELECT a.*, grp FROM ag a JOIN g USING (well_id) UNION ALL SELECT a.*, '__global__' FROM ag a),
c AS (SELECT grp, phase, age, median(lr) AS c, count(*) AS n FROM al GROUP BY ALL), md AS (SELECT grp, phase, age, 1.4826e0 * median(abs(lr - c)) AS log_mad FROM al JOIN c USING (grp, phase, age) GROUP BY ALL),
su AS (SELECT grp, phase, count(DISTINCT well_id) AS support, max(age) AS top FROM al GROUP BY ALL),
y AS (SELECT a.grp, a.phase, a.age, support, coalesce(n, 0) AS n, CASE WHEN n >= 2 THEN exp(c) END AS v, CASE WHEN n >= 2 THEN log_mad END AS log_mad FROM (SELECT grp, phase, support, unnest(range(0, top + 1)) AS age FROM su) a LEFT JOIN c USING (grp, phase, age) LEFT JOIN md USING (grp, phase, age)),
z AS (SELECT *, last_value(v IGNORE NULLS) OVER ba AS v0, last_value(CASE WHEN v IS NOT NULL THEN age END IGNORE NULLS) OVER ba AS a0, first_value(v IGNORE NULLS) OVER ah AS v1, first_value(CASE WHEN v IS NOT NULL THEN age END IGNORE NULLS) OVER ah AS a1, count(v) OVER (PARTITION BY grp, phase) AS known FROM y
  WINDOW ba AS (PARTITION BY grp, phase ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ah AS (PARTITION BY grp, phase ORDER BY age ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
shp AS (SELECT grp, phase, age, min(coalesce(v, v0 + (v1 - v0) * (age - a0) / nullif(a1 - a0, 0), v0, v1)) OVER (PARTITION BY grp, phase ORDER BY age) AS value, n, log_mad, support FROM z WHERE known >= 3)"""


def _shape(spark, sf):
    rows = bridge.longer(bridge.decline(spark, sf)).filter(F.col("t") <= CUT)
    groups = bridge.wells(spark, sf).select("well_id", F.col("play").alias("grp"))
    return rows, groups, cohort.profiles(rows, groups)


@query("coh_01_02_profiles", f"WITH {SHAPE} SELECT grp, phase, age::INT AS age, round(value, 6) AS value, n, round(log_mad, 6) AS log_mad, support FROM shp")
def coh_02(spark, sf):
    return _shape(spark, sf)[2].select("grp", "phase", "age", r6("value"), "n", r6("log_mad"), "support")


@query("coh_05_06_forecast", f"""WITH {SHAPE}, tp AS (SELECT grp, phase, any_value(support) AS support, max(age) AS top FROM shp GROUP BY ALL HAVING any_value(support) >= 5),
la AS (SELECT well_id, phase, max(t) AS last FROM dec WHERE t <= {CUT} GROUP BY ALL),
w AS (SELECT p.well_id, p.phase, p.peak, p.n, last, CASE WHEN o.grp IS NOT NULL THEN g.grp ELSE '__global__' END AS grp FROM pk p JOIN la USING (well_id, phase) JOIN g USING (well_id) LEFT JOIN tp o ON o.grp = g.grp AND o.phase = p.phase),
x AS (SELECT w.*, support, top FROM w JOIN tp USING (grp, phase)),
r AS (SELECT well_id, phase, t, q, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS back FROM dec WHERE t <= {CUT} AND q > 0),
sc AS (SELECT x.well_id, x.phase, median(r.q / greatest(value, 1e-9)) AS scale FROM x JOIN r USING (well_id, phase) JOIN shp s ON s.grp = x.grp AND s.phase = x.phase AND s.age = least(greatest(r.t - x.peak, 0), top) WHERE back <= 3 GROUP BY ALL)
SELECT x.well_id, x.phase, h::INT AS h, round(s.value * exp(-(-ln(1 - 0.06e0) / 12) * greatest(last - peak + h - top, 0)) * scale, 6) AS volume, round(least(greatest((18 - x.n) / 18e0, 0), 0.65e0) * least(greatest((x.support - 4) / 15e0, 0), 1), 6) AS weight, x.grp
FROM x JOIN sc USING (well_id, phase) CROSS JOIN range(1, 13) q(h) JOIN shp s ON s.grp = x.grp AND s.phase = x.phase AND s.age = least(last - peak + h, top)""")
def coh_05(spark, sf):
    rows, groups, shape = _shape(spark, sf)
    return cohort.cohort_forecast(rows, groups, shape, 12).select("well_id", "phase", "h", r6("volume"), r6("weight"), "grp")


RATIO = f"""dw AS MATERIALIZED (SELECT * FROM ({DECLINE_SQL}) WHERE t <= {CUT}), pp AS (SELECT well_id, CASE WHEN sum(oil) >= sum(gas) / 6 THEN 'oil' ELSE 'gas' END AS pp FROM dw GROUP BY ALL),
rr AS (SELECT well_id, CASE WHEN pp = 'oil' THEN 'gor' ELSE 'cgr' END AS rel, t, ln(CASE WHEN pp = 'oil' THEN gas / oil ELSE oil / gas END) AS lr FROM dw JOIN pp USING (well_id) UNION ALL SELECT well_id, CASE WHEN pp = 'oil' THEN 'wor' ELSE 'wgr' END, t, ln(CASE WHEN pp = 'oil' THEN water / oil ELSE water / gas END) FROM dw JOIN pp USING (well_id)),
rb AS (SELECT *, row_number() OVER (PARTITION BY well_id, rel ORDER BY t DESC) AS back FROM rr),
rs AS (SELECT well_id, rel, CASE WHEN count(*) >= 4 THEN least(greatest(regr_slope(lr, t), -0.025e0), 0.025e0) END AS slope, median(exp(lr)) FILTER (WHERE back <= 6) AS level, count(*) AS n, stddev_pop(lr) > 0.30e0 AS volatile FROM rb WHERE back <= 18 GROUP BY ALL)"""


@query("coh_04_ratio_slopes", f"WITH {RATIO} SELECT well_id, rel, round(slope, 6) AS slope, round(level, 6) AS level, n, volatile FROM rs")
def coh_04(spark, sf):
    return cohort.ratio_slopes(bridge.decline(spark, sf).filter(F.col("t") <= CUT)).select("well_id", "rel", r6("slope"), r6("level"), "n", "volatile")


@query("coh_03_15_ratio_priors", f"WITH {RATIO}, g AS (SELECT well_id, play AS grp FROM ({WELLS_SQL})), e AS (SELECT grp, rel, slope FROM rs JOIN g USING (well_id) UNION ALL SELECT '__global__', rel, slope FROM rs) SELECT grp, rel, round(median(slope), 6) AS prior, count(*) AS n FROM e WHERE slope IS NOT NULL GROUP BY ALL")
def coh_15(spark, sf):
    groups = bridge.wells(spark, sf).select("well_id", F.col("play").alias("grp"))
    return cohort.ratio_priors(cohort.ratio_slopes(bridge.decline(spark, sf).filter(F.col("t") <= CUT)), groups).select("grp", "rel", r6("prior"), "n")


# Boards and provenance.


@query("brd_01_duplicates", """WITH RECURSIVE n AS (SELECT s_suppkey AS well_id, s_suppkey AS ord, CASE WHEN s_suppkey % 4 <> 0 THEN (s_suppkey // 3)::VARCHAR END AS api, 'h' || (s_suppkey % 17 + 20 * (s_suppkey // 50)) AS hs FROM supplier),
ed AS (SELECT a.well_id AS u, b.well_id AS v FROM n a JOIN n b ON a.api = b.api OR a.hs = b.hs), r(u, v) AS (SELECT u, v FROM ed UNION SELECT r.u, ed.v FROM r JOIN ed ON r.v = ed.u)
SELECT u AS well_id, min(v) AS cluster, u = min(v) AS keep FROM r GROUP BY u""")
def brd_01(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    w = s.select(k.alias("well_id"), k.alias("ord"), F.when(k % 4 != 0, F.floor(k / 3).cast("string")).alias("api"), F.concat(F.lit("h"), (k % 17 + 20 * F.floor(k / 50)).cast("string")).alias("series_hash"))
    return board.collapse_duplicates(w)


def roles_sql() -> str:
    """Each role takes the wells of least (rank in the cell, cell) among those left."""
    left = "w0 AS (SELECT *, CASE WHEN well_id % 2 = 0 THEN 'b1' ELSE 'b2' END AS bucket, md5(well_id || '|roles') AS ord FROM w), n AS (SELECT greatest(1, count(*) // 8) AS n FROM w)"
    took = []
    for k, role in enumerate(board.ROLES):
        left += f", r{k} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY k, play, bucket) AS place FROM (SELECT well_id, play, bucket, ord, row_number() OVER (PARTITION BY play, bucket ORDER BY ord) AS k FROM w{k})) WHERE place <= (SELECT n FROM n)), w{k + 1} AS (SELECT * FROM w{k} WHERE well_id NOT IN (SELECT well_id FROM r{k}))"
        took.append(f"SELECT well_id, play, bucket, '{role}' AS role FROM r{k}")
    return f"WITH w AS ({WELLS_SQL}), {left} " + " UNION ALL ".join([*took, f"SELECT well_id, play, bucket, 'unused' FROM w{len(board.ROLES)}"])


@query("brd_03_roles", roles_sql())
def brd_03(spark, sf):
    """Roles by round-robin over cells, restarting at the first cell for each."""
    w = bridge.wells(spark, sf).withColumns({"bucket": F.when(F.col("well_id") % 2 == 0, "b1").otherwise("b2"), "ord": board.hash_order("well_id", "roles")})
    n = w.count()
    return board.assign_roles(w, {r: max(1, n // 8) for r in board.ROLES}).select("well_id", "play", "bucket", "role")


@query("brd_06_partition", f"WITH w AS ({WELLS_SQL}), o AS (SELECT well_id, row_number() OVER (PARTITION BY play ORDER BY sha256('tune|' || well_id)) - 1 AS k, play FROM w) SELECT well_id, CASE WHEN k % 3 = 0 THEN 'confirm' ELSE 'tune' END AS part FROM o")
def brd_06(spark, sf):
    return board.partition(bridge.wells(spark, sf), "tune", ("play",)).select("well_id", "part")


METHODS = "ev AS (SELECT user_id AS well_id, ts::DATE AS month, CASE event_type WHEN 'purchase' THEN 'Reported ' WHEN 'click' THEN 'REPORTED' WHEN 'view' THEN 'dca' WHEN 'signup' THEN NULL ELSE 'Test' END AS method FROM events), mc AS (SELECT well_id, month, list_distinct(list(upper(trim(method))) FILTER (WHERE method IS NOT NULL)) AS s FROM ev GROUP BY ALL), cl AS (SELECT well_id, month, CASE WHEN coalesce(len(s), 0) = 0 THEN 'UNKNOWN' WHEN len(s) = 1 THEN s[1] ELSE 'MIXED' END AS method FROM mc)"


def _methods(spark, sf):
    e = table(spark, sf, "events")
    m = F.when(F.col("event_type") == "purchase", "Reported ").when(F.col("event_type") == "click", "REPORTED").when(F.col("event_type") == "view", "dca").when(F.col("event_type") == "signup", F.lit(None)).otherwise("Test")
    return board.month_class(e.select(F.col("user_id").alias("well_id"), F.to_date("ts").alias("month"), m.alias("method")), ["well_id", "month"])


@query("prv_02_month_class", f"WITH {METHODS} SELECT * FROM cl")
def prv_02(spark, sf):
    return _methods(spark, sf)


@query("prv_03_well_gate", f"WITH {METHODS}, f AS (SELECT well_id, avg((method = 'REPORTED')::INT) FILTER (WHERE month <= DATE '2024-01-20') AS tr, avg((method = 'REPORTED')::INT) FILTER (WHERE month > DATE '2024-01-20') AS ho FROM cl GROUP BY ALL) SELECT well_id, coalesce(ho >= 0.1 AND tr >= 0.1, false) AS accepted FROM f")
def prv_03(spark, sf):
    m = _methods(spark, sf)
    rep, train = (F.col("method") == "REPORTED").cast("double"), F.col("month") <= F.lit("2024-01-20").cast("date")
    f = m.groupBy("well_id").agg(F.avg(F.when(train, rep)).alias("tr"), F.avg(F.when(~train, rep)).alias("ho"))
    return f.select("well_id", F.coalesce(board.accepts(F.col("tr"), F.col("ho"), "reported_threshold", 0.1, 0.1), F.lit(False)).alias("accepted"))


@query("prv_04_report", f"WITH {METHODS} SELECT well_id % 10 AS grp, count(*) AS months, count(*) FILTER (WHERE method = 'REPORTED') AS reported, count(*) FILTER (WHERE method = 'DCA') AS dca, count(*) FILTER (WHERE method = 'MIXED') AS mixed, count(*) FILTER (WHERE method = 'UNKNOWN') AS unknown, 0::BIGINT AS missing, count(*) FILTER (WHERE method = 'TEST') AS other, round(avg((method = 'REPORTED')::INT), 6) AS reported_fraction, round(avg((method = 'DCA')::INT), 6) AS dca_fraction FROM cl GROUP BY ALL")
def prv_04(spark, sf):
    x = board.provenance(_methods(spark, sf).withColumn("grp", F.col("well_id") % 10), ["grp"])
    return x.select("grp", "months", "reported", "dca", "mixed", "unknown", "missing", "other", r6("reported_fraction"), r6("dca_fraction"))


@query("prv_05_day_classes", "WITH d AS (SELECT l_returnflag AS method, l_shipdate::DATE AS month, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 31 ELSE l_linenumber * 4 END AS days FROM lineitem) SELECT method, count(*) FILTER (WHERE days = 0) AS zero_days, count(*) FILTER (WHERE days > 0 AND days < day(last_day(month))) AS partial_days, count(*) FILTER (WHERE days >= day(last_day(month))) AS full_days FROM d GROUP BY ALL")
def prv_05(spark, sf):
    n = F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_shipdate").alias("month"), F.when(n == 1, 0).when(n == 2, 31).otherwise(n * 4).alias("days"))
    return board.day_classes(li)


# Validation, diagnostics, gates.


@query("val_03_failures", f"""WITH {PAIRS}, u AS (SELECT DISTINCT well_id, phase, well_id % 11 <> 4 AS available, CASE WHEN well_id % 13 = 6 THEN -2 WHEN well_id % 13 = 7 THEN 3 ELSE 0 END AS gap, CASE WHEN well_id % 17 = 5 THEN 'no fit' END AS problem FROM pr),
f AS (SELECT well_id, phase, h - gap AS h, CASE WHEN well_id % 7 = 3 AND h = 2 THEN -1e0 ELSE a END AS v, gap FROM pr JOIN u USING (well_id, phase) WHERE h <= 12 AND well_id % 9 <> 2 AND NOT (well_id % 5 = 1 AND h > 10)),
s AS (SELECT well_id, phase, count(*) FILTER (WHERE h >= 1 AND (gap = 0 OR h <= 12)) AS n, count(*) FILTER (WHERE h >= 1 AND (gap = 0 OR h <= 12) AND v < 0) AS bad FROM f GROUP BY ALL)
SELECT well_id, phase, CASE WHEN gap < 0 THEN 'date_error: the start is before the well''s next month' WHEN NOT available THEN 'phase_unavailable' WHEN problem IS NOT NULL THEN 'provider_error: ' || problem WHEN n IS NULL THEN 'forecast_missing' WHEN n <> 12 THEN 'length_mismatch:' || n ELSE 'nonfinite_or_negative_forecast' END AS reason
FROM u LEFT JOIN s USING (well_id, phase) WHERE gap < 0 OR NOT available OR problem IS NOT NULL OR n IS NULL OR n <> 12 OR bad > 0""")
def val_03(spark, sf):
    """Every reason that a unit can fail for."""
    p, k = _pairs(spark, sf), F.col("well_id")
    units = p.select(*KEY).distinct().withColumns({"available": k % 11 != 4, "gap": F.when(k % 13 == 6, -2).when(k % 13 == 7, 3).otherwise(0), "problem": F.when(k % 17 == 5, "no fit")})
    f = p.filter("h <= 12 AND well_id % 9 <> 2 AND NOT (well_id % 5 = 1 AND h > 10)").select(*KEY, "h", F.when((F.col("well_id") % 7 == 3) & (F.col("h") == 2), -1.0).otherwise(F.col("a")).alias("volume"))
    return submission.generate(units, f, 12)[1]


@query("val_01_input", f"WITH {PAIRS}, d AS ({DECLINE_SQL}) SELECT count(DISTINCT well_id) AS wells, count(DISTINCT CASE WHEN well_id % 3 <> 0 THEN well_id END) AS oil, count(DISTINCT well_id) AS gas, 0::BIGINT AS water, (SELECT count(*) FROM supplier) AS metadata_rows FROM d")
def val_01(spark, sf):
    """Wells, metadata rows and available phases (AGG-20)."""
    d = bridge.decline(spark, sf).withColumns({"oil": F.when(F.col("well_id") % 3 != 0, F.col("oil")), "water": F.lit(None).cast("double")})
    return submission.validate_input(d, bridge.wells(spark, sf)).select("wells", "oil", "gas", "water", "metadata_rows")


@query("snk_03_failure_counts", f"WITH {PAIRS} SELECT CASE WHEN well_id % 3 = 0 THEN 'a' ELSE 'b' END AS reason, count(*) AS count FROM (SELECT DISTINCT well_id, phase FROM pr) GROUP BY ALL")
def snk_03(spark, sf):
    x = _pairs(spark, sf).select(*KEY).distinct().withColumn("reason", F.when(F.col("well_id") % 3 == 0, "a").otherwise("b"))
    return sinks.failure_counts(x)


@query("val_02_problems", f"WITH {PAIRS.replace('WHERE t >', 'WHERE t <= 82 AND t >')} SELECT 'wrong_horizon' AS problem, well_id, phase FROM pr GROUP BY well_id, phase HAVING count(*) FILTER (WHERE well_id % 4 <> 1 OR h < 12) <> 12 UNION ALL SELECT 'bad_volume', well_id, phase FROM pr WHERE actual IS NULL AND (well_id % 4 <> 1 OR h < 12)")
def val_02(spark, sf):
    return submission.problems(_pairs(spark, sf).filter("well_id % 4 <> 1 OR h < 12").withColumn("volume", F.col("actual")), 12)


NOISE = f"""{ROUGH}, b AS (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS back FROM rough WHERE q > 0), k AS (SELECT well_id, phase, t, ln(q) AS y, count(*) OVER (PARTITION BY well_id, phase) AS m FROM b WHERE back <= 36),
l AS (SELECT well_id, phase, regr_slope(y, t) AS c, regr_intercept(y, t) AS a FROM k WHERE m >= 10 GROUP BY ALL), r AS (SELECT k.*, y - a - c * t AS r FROM k JOIN l USING (well_id, phase)),
d AS (SELECT *, median(r) OVER (PARTITION BY well_id, phase) AS rm, y - lag(y) OVER (PARTITION BY well_id, phase ORDER BY t) AS d1 FROM r), e AS (SELECT *, lag(d1) OVER (PARTITION BY well_id, phase ORDER BY t) AS d0 FROM d),
f AS (SELECT well_id, phase, 1.4826e0 * median(abs(r - rm)) AS residual_mad, avg((d0 * d1 < 0 AND least(abs(d0), abs(d1)) > 0.08e0)::INT) FILTER (WHERE d0 IS NOT NULL) AS reversal_rate, avg((abs(d1) > 0.20e0)::INT) FILTER (WHERE d1 IS NOT NULL) AS jump_rate, median(abs(d1 - d0)) AS second_difference FROM e GROUP BY ALL)"""


@query("val_05_allocation_noise", f"""WITH {NOISE}, w AS (SELECT well_id, median(residual_mad) AS rm, median(reversal_rate) AS rr, median(jump_rate) AS jr, median(second_difference) AS sd, count(*) AS phases FROM f GROUP BY ALL)
SELECT well_id, round(rm, 6) AS residual_mad, round(rr, 6) AS reversal_rate, round(jr, 6) AS jump_rate, round(sd, 6) AS second_difference, phases, round((least(rm / 0.16e0, 2) + least(rr / 0.33e0, 2) + least(jr / 0.35e0, 2) + least(sd / 0.24e0, 2)) / 8, 6) AS score,
  (rm >= 0.16e0)::INT + (rr >= 0.33e0)::INT + (jr >= 0.35e0)::INT + (sd >= 0.24e0)::INT >= 3 AND rr >= 0.33e0 AND jr >= 0.35e0 AS flagged FROM w""")
def val_05(spark, sf):
    x = diagnostics.allocation_noise(_rough(spark, sf))
    return x.select("well_id", *(r6(c) for c in diagnostics.LIMITS), "phases", r6("score"), "flagged")


@query("val_06_endpoint_bands", f"""WITH {ROUGH}, b AS (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS back FROM rough WHERE q > 0), k AS (SELECT *, ln(q) - lag(ln(q)) OVER (PARTITION BY well_id, phase ORDER BY t) AS d FROM b WHERE back <= 6),
g AS (SELECT well_id, phase, count(*) AS n, max(q) FILTER (WHERE back = 1) / median(q) FILTER (WHERE back BETWEEN 2 AND 4) AS ratio, stddev_pop(d) AS sd FROM k GROUP BY ALL)
SELECT well_id, phase, CASE WHEN n < 4 THEN 'sparse' WHEN ratio < 0.60e0 THEN 'low' WHEN ratio > 1.60e0 THEN 'high' WHEN sd > 0.45e0 THEN 'volatile' ELSE 'normal' END AS band, round(ratio, 6) AS ratio FROM g""")
def val_06(spark, sf):
    return diagnostics.endpoint_bands(_rough(spark, sf)).select(*KEY, "band", r6("ratio"))


@query("agg_13_confusion", f"WITH {PAIRS}, x AS (SELECT phase, a > b AS flagged, well_id % 3 = 0 AS truth FROM pr), c AS (SELECT phase, count(*) FILTER (WHERE flagged AND truth) AS tp, count(*) FILTER (WHERE flagged AND NOT truth) AS fp, count(*) FILTER (WHERE NOT flagged AND truth) AS fn, count(*) FILTER (WHERE NOT flagged AND NOT truth) AS tn FROM x GROUP BY ALL) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c")
def agg_13(spark, sf):
    x = diagnostics.confusion(_pairs(spark, sf).select("phase", (F.col("a") > F.col("b")).alias("flagged"), (F.col("well_id") % 3 == 0).alias("truth")), ["phase"])
    return x.select("phase", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("fpr"))


EVIDENCE = f"""{UNITS}, {CLUSTERED}, lb AS ({WELLS_SQL}), sg AS (SELECT play, count(*) AS n, {DELTA} AS delta FROM un JOIN lb USING (well_id) GROUP BY ALL),
ev AS (SELECT count(DISTINCT well_id) AS wells, {DELTA} AS delta, ({DELTA}) / abs({POOL.format(x='b')}) AS relative, avg((abs(a) > ln(2e0))::INT) - avg((abs(b) > ln(2e0))::INT) AS catastrophic, quantile_cont(abs(a), 0.95) - quantile_cont(abs(b), 0.95) AS p95,
  (SELECT high FROM ci) AS high, (SELECT p_better FROM ci) AS p_better, (SELECT coalesce(max(delta) FILTER (WHERE n >= 10), 0) FROM sg) AS worst10, (SELECT coalesce(max(delta) FILTER (WHERE n >= 20), 0) FROM sg) AS worst20 FROM un)"""
GATE_SQL = {
    "no_mismatch": ("0e0", "true"), "no_failures": ("0e0", "true"), "better": ("delta", "delta < 0"), "interval": ("high", "high < 0"), "catastrophic_1": ("catastrophic", "catastrophic <= 0.01e0"), "catastrophic_05": ("catastrophic", "catastrophic <= 0.005e0"),
    "relative_2": ("relative", "relative <= -0.02e0"), "relative_1": ("relative", "relative <= -0.01e0"), "segments_10": ("worst10", "worst10 <= 0.05e0"), "segments_20": ("worst20", "worst20 <= 0.03e0"), "wells_30": ("wells", "wells >= 30"), "wells_100": ("wells", "wells >= 100"),
    "cumulative_2": ("delta", "delta <= 0.02e0"), "cumulative_1": ("delta", "delta <= 0.01e0"), "probability": ("p_better", "p_better >= 0.95e0"), "p95": ("p95", "p95 <= 0.02e0"), "runtime": ("1.5e0", "true"),
}


def gates_sql(names: list[str]) -> str:
    plain = lambda n: n.rstrip("0123456789").rstrip("_") if n != "p95" else n
    return f"WITH {EVIDENCE} " + " UNION ALL ".join(f"SELECT '{plain(n)}' AS gate, round(({GATE_SQL[n][0]})::DOUBLE, 6) AS value, {GATE_SQL[n][1]} AS passed FROM ev" for n in names)


def _evidence(spark, sf):
    p = _errors(spark, sf).select(*KEY, "a", "b")
    return holdout.evidence(p, bridge.wells(spark, sf), ["play"], p, 0, 0, 1.5, 300)


@query("gate_01_promotion", gates_sql(["no_mismatch", "no_failures", "better", "interval", "relative_2", "catastrophic_1", "segments_10"]))
def gate_01(spark, sf):
    return gates.evaluate(_evidence(spark, sf), "selection").select("gate", r6("value"), "passed")


@query("gate_02_confirmation", gates_sql(["wells_30", "no_failures", "better", "interval", "relative_2", "catastrophic_1", "cumulative_2", "segments_10"]))
def gate_02(spark, sf):
    return gates.evaluate(_evidence(spark, sf), "confirmation").select("gate", r6("value"), "passed")


@query("gate_03_04_strict", gates_sql(["no_mismatch", "wells_100", "no_failures", "relative_1", "probability", "catastrophic_05", "p95", "cumulative_1", "segments_20", "runtime"]))
def gate_03(spark, sf):
    return gates.evaluate(_evidence(spark, sf), "strict").select("gate", r6("value"), "passed")


@query("gate_01_recommendation", f"WITH {EVIDENCE} SELECT p AS promoted, CASE WHEN p THEN 'a' ELSE 'scipy_control' END AS recommendation FROM (SELECT delta < 0 AND high < 0 AND relative <= -0.02e0 AND catastrophic <= 0.01e0 AND worst10 <= 0.05e0 AS p FROM ev)")
def gate_01r(spark, sf):
    return gates.promote(_evidence(spark, sf), "selection", "a")


@query("gate_06_seeds", """WITH s AS (SELECT user_id % 30 AS seed, avg(value) / 100 - 0.52 AS delta FROM events GROUP BY ALL) SELECT 'better' AS gate, round(avg(delta), 6) AS value, avg(delta) < 0 AS passed FROM s
UNION ALL SELECT 'win_rate', round(avg((delta < 0)::INT), 6), avg((delta < 0)::INT) >= 0.70 FROM s UNION ALL SELECT 'clean', round(min(delta), 6), min(delta) <= 0.05 FROM s UNION ALL SELECT 'worst', round(max(delta), 6), max(delta) <= 0.25 FROM s""")
def gate_06(spark, sf):
    """A challenger over seeds: mean delta, share of seeds won, the clean and the worst scenario."""
    s = table(spark, sf, "events").groupBy((F.col("user_id") % 30).alias("seed")).agg((F.avg("value") / 100 - 0.52).alias("delta"))
    ev = s.agg(F.avg("delta").alias("delta"), F.avg((F.col("delta") < 0).cast("double")).alias("win_rate"), F.min("delta").alias("clean_relative"), F.max("delta").alias("worst_scenario"))
    return gates.evaluate(ev, "seeds").select("gate", r6("value"), "passed")


@query("gate_07_classifier", f"""WITH {PAIRS}, c AS (SELECT count(*) FILTER (WHERE a > b AND well_id % 3 = 0) AS tp, count(*) FILTER (WHERE a > b AND well_id % 3 <> 0) AS fp, count(*) FILTER (WHERE a <= b AND well_id % 3 <> 0) AS tn FROM pr)
SELECT 'precision' AS gate, round(tp / (tp + fp), 6) AS value, tp / (tp + fp) >= 0.9 AS passed FROM c UNION ALL SELECT 'clean_fpr', round(fp / (fp + tn), 6), fp / (fp + tn) <= 0.05 FROM c""")
def gate_07(spark, sf):
    x = diagnostics.confusion(_pairs(spark, sf).select((F.col("a") > F.col("b")).alias("flagged"), (F.col("well_id") % 3 == 0).alias("truth")), [])
    return gates.evaluate(x.select("precision", F.col("fpr").alias("clean_fpr")), "classifier").select("gate", r6("value"), "passed")


@query("gate_10_fail_closed", f"WITH {PAIRS}, u AS (SELECT well_id, phase, h, median(actual) OVER (PARTITION BY well_id, phase) AS m FROM pr) SELECT u.well_id, u.phase, u.h::INT AS h, round(CASE WHEN u.well_id % 4 = 1 THEN greatest(1e-9, 1e-4 * m) ELSE b END, 6) AS volume FROM u JOIN pr USING (well_id, phase, h)")
def gate_10(spark, sf):
    from pyspark.sql import Window

    p = _pairs(spark, sf)
    units = p.select(*KEY, "h", F.median("actual").over(Window.partitionBy(*KEY)).alias("median_actual"))
    return gates.fail_closed(p.filter("well_id % 4 <> 1").select(*KEY, "h", F.col("b").alias("volume")), units).select(*KEY, "h", r6("volume"))


# Families and routing.


def exponential_sql(source: str, window: int) -> str:
    """Two-pass exponential fits of the window on the calendar; the last CTE is f8."""
    return f"""sr AS ({source}), en AS (SELECT well_id, phase, min(t) AS t0, max(t) + 1 AS e FROM sr GROUP BY ALL),
p AS (SELECT well_id, phase, min(t) AS pk FROM (SELECT *, max(q) OVER (PARTITION BY well_id, phase) AS m FROM sr) WHERE q = m GROUP BY ALL),
x AS (SELECT d.well_id, d.phase, (t - greatest(pk, e - {window}, t0))::DOUBLE AS tt, q, e - greatest(pk, e - {window}, t0) AS origin FROM sr d JOIN p USING (well_id, phase) JOIN en USING (well_id, phase) WHERE t >= greatest(pk, e - {window})),
c1 AS (SELECT well_id, phase, regr_slope(ln(q), tt) AS c, regr_intercept(ln(q), tt) AS a, count(*) AS n FROM x WHERE q > 0 GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT x.*, n, count(*) OVER (PARTITION BY x.well_id, x.phase) AS kn FROM x JOIN c1 USING (well_id, phase) WHERE q > 0 AND q >= 0.65e0 * exp(a + least(c, -1e-6) * tt)),
c2 AS (SELECT well_id, phase, regr_slope(ln(q), tt) AS c, regr_intercept(ln(q), tt) AS a FROM k WHERE kn >= 5 AND kn < n GROUP BY ALL),
f AS (SELECT c1.well_id, c1.phase, coalesce(c2.c, c1.c) AS c, coalesce(c2.a, c1.a) AS a FROM c1 LEFT JOIN c2 USING (well_id, phase)),
u AS (SELECT x.well_id, x.phase, any_value(a) AS a, any_value(c) AS c, any_value(origin) AS origin, coalesce(avg(least(q / exp(a + least(c, -1e-6) * tt), 1)) FILTER (WHERE tt >= origin - 24 AND q IS NOT NULL), 1) AS uptime FROM x JOIN f USING (well_id, phase) GROUP BY ALL),
f8 AS (SELECT well_id, phase, h::INT AS h, round(exp(a + least(c, -1e-6) * (origin + h - 1)) * uptime, 6) AS volume FROM u CROSS JOIN range(1, 7) r(h))"""


@query("fit_08_exponential", f"WITH {exponential_sql(f'SELECT * FROM ({DECLINE_LONG_SQL}) WHERE t <= {CUT}', 18)} SELECT * FROM f8")
def fit_08(spark, sf):
    rows = bridge.longer(bridge.decline(spark, sf)).filter(F.col("t") <= CUT)
    return families.forecast(families.fit(rows, families.candidates(spark, ["exp_18"])), 6).select("well_id", "phase", "h", r6("volume"))


GAPPED = f"SELECT * FROM ({DECLINE_LONG_SQL}) WHERE t <= {CUT} AND (t * 7 + well_id * 3) % 10 > 2"


@query("fit_11_calendar_gaps", f"WITH {exponential_sql(GAPPED, 36)} SELECT * FROM f8")
def fit_11(spark, sf):
    """Three months in ten have no row: fits go by calendar months, not by the place of a row."""
    rows = bridge.longer(bridge.decline(spark, sf)).filter(F.col("t") <= CUT).filter("(t * 7 + well_id * 3) % 10 > 2")
    return families.forecast(families.fit(rows, families.candidates(spark, ["exp_36"])), 6).select("well_id", "phase", "h", r6("volume"))


@query("rt_01_03_candidate_board")
def rt_03(spark, sf):
    """Seven candidates over rolling origins; tests hold the fits against plain regressions."""
    rows = bridge.longer(bridge.decline(spark, sf)).filter(F.col("t") <= CUT)
    return families.winners(families.backtest(rows, families.candidates(spark))).select("well_id", "phase", "name", r6("score"))


@query("fc_13_control")
def fc_13(spark, sf):
    """The bounded nonlinear control; tests hold its error against a dense grid."""
    rows = bridge.longer(bridge.decline(spark, sf)).filter(F.col("t") <= CUT)
    return control.forecast(rows, 12).select("well_id", "phase", "h", r6("volume"))


@query("rt_12_13_routed_wells")
def rt_13(spark, sf):
    """The profile with gated cohorts over the control."""
    wide = bridge.decline(spark, sf).filter(F.col("t") <= CUT)
    groups = bridge.wells(spark, sf).select("well_id", F.col("play").alias("grp"))
    return routing.forecast_wells(wide, groups, 12, profiles.profile("cohort_conservative"))[0].select("well_id", "phase", "h", r6("volume"))


@query("gen_02_stress_cases")
def gen_02(spark, sf):
    """Synthetic wells by scenario: months and missing months."""
    x = synth.stress(spark, [1, 2, 3])
    return x.groupBy("seed", "scenario", "split").agg(F.count("*").alias("months"), F.count_if(F.col("oil").isNull()).alias("missing"), F.count_if(F.col("oil") == 0).alias("zeros"))


@query("gen_03_stress_board")
def gen_03(spark, sf):
    """The control and the linear arm on the same synthetic wells, by scenario."""
    from ..operators import arps

    x = calendar_free(synth.stress(spark, [1, 2]))
    train = x.filter("split = 'train'").select("well_id", "phase", "t", "q")
    act = x.filter("split = 'holdout'").join(train.groupBy("well_id").agg((F.max("t") + 1).alias("o")), "well_id").select("well_id", "phase", "scenario", (F.col("t") - F.col("o") + 1).alias("h"), F.col("q").alias("actual"))
    lin = arps.forecast(arps.fit(train, arps.arms_table(spark, ["bounded"])), 12).select("well_id", "phase", F.lit("linear").alias("arm"), "h", "volume")
    both = control.forecast(train, 12).select("well_id", "phase", F.lit("control").alias("arm"), "h", "volume").unionByName(lin)
    e = metrics.cumulative(both.join(act, ["well_id", "phase", "h"]).withColumnRenamed("volume", "forecast"), ["arm", "scenario", "well_id", "phase"])
    return e.groupBy("arm", "scenario").agg(F.count("*").alias("units"), r6(pool_score(F.col("e")), "score"))


def calendar_free(x):
    return x.unpivot(["well_id", "scenario", "split", "t"], ["oil", "gas", "water"], "phase", "q")


