"""Fit and forecast queries over the decline series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import pool_score
from ..operators import arps, calendar, metrics, sequence
from ..sources import bridge
from .registry import query, r6

CUT, H = bridge.CUT, 12


def _train(spark, sf, phases=("oil", "gas", "water")):
    return bridge.longer(bridge.decline(spark, sf).filter(F.col("t") <= CUT), phases)


def _actual(spark, sf, phases=("oil", "gas", "water")):
    x = bridge.longer(bridge.decline(spark, sf).filter(F.col("t") > CUT), phases)
    return x.select("well_id", "phase", (F.col("t") - CUT).alias("h"), F.col("q").alias("actual"))


def arms_sql(names: list[str], series: str) -> str:
    """CTEs of an arms plan; the last ones are fits and fc."""
    null = lambda v: "NULL" if v is None else str(v).lower()
    rows = ", ".join(f"('{a[0]}', {a[1]}e0, {null(a[2])}, {null(a[3])}, {null(a[4])}, {a[5]})" for a in arps.ARMS if a[0] in names)
    k = "well_id, phase, arm"
    return f"""
src AS ({series}), arms(arm, b_max, win, use_uptime, guard, skip) AS (VALUES {rows}),
grid AS (SELECT (30 + 5 * i) / 100e0 AS b FROM range(21) r(i)),
rep0 AS (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY well_id, phase) AS n FROM src WHERE q IS NOT NULL),
pk AS (SELECT well_id, phase, min(idx) AS peak FROM (SELECT *, max(q) OVER (PARTITION BY well_id, phase) AS mq FROM rep0) WHERE q = mq GROUP BY ALL),
lev AS (SELECT well_id, phase, avg(q) FILTER (WHERE idx >= n - 3) AS level FROM rep0 GROUP BY ALL),
wnd0 AS (SELECT r.*, a.*, greatest(peak, n - coalesce(win, n)) AS start FROM rep0 r JOIN pk USING (well_id, phase) CROSS JOIN arms a WHERE n >= 3),
wnd AS (SELECT *, idx - start AS tt, n - start AS len, CASE WHEN skip > 0 AND n - start > skip + 2 THEN n - start - skip ELSE n - start END AS fit_len FROM wnd0 WHERE idx >= start),
x AS (SELECT {k}, tt, q, len, fit_len, b_max, use_uptime, guard FROM wnd WHERE tt < fit_len),
c1 AS (SELECT {k}, b, regr_slope(power(greatest(q, 1e-12), -b), tt) AS c, regr_intercept(power(greatest(q, 1e-12), -b), tt) AS a FROM x JOIN grid ON b <= b_max + 1e-9 WHERE q > 0 GROUP BY ALL),
p1 AS (SELECT {k}, b, power(a, -1 / b) AS qi, greatest(c, 0e0) / (a * b) AS di FROM c1 WHERE a > 0 AND c IS NOT NULL AND greatest(c, 0e0) / (a * b) <= 1),
s1 AS (SELECT {k}, b, qi, di, sum(power(qi / power(1 + b * di * tt, 1 / b) - q, 2)) AS sse FROM x JOIN p1 USING ({k}) GROUP BY ALL),
f1 AS (SELECT {k}, qi, di, b FROM s1 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY sse, b) = 1),
m AS (SELECT x.*, f1.qi, f1.di, f1.b, qi / power(1 + b * di * tt, 1 / b) AS trend FROM x JOIN f1 USING ({k})),
kept AS (SELECT {k}, tt, q, b_max FROM (SELECT *, count(*) OVER (PARTITION BY {k}) AS nk FROM m WHERE q >= 0.75e0 * trend AND q > 0) WHERE nk >= 3),
w0 AS (SELECT {k}, tt, q, grid.b, power(greatest(q, 1e-12), -grid.b) AS z FROM kept JOIN grid ON grid.b <= b_max + 1e-9),
w1 AS (SELECT *, (1 / greatest(z, 1e-12)) / median(1 / greatest(z, 1e-12)) OVER (PARTITION BY {k}, b) AS rel FROM w0),
w2 AS (SELECT *, power(least(greatest(rel, 0.1e0), 10e0), 2) AS w FROM w1),
w3 AS (SELECT {k}, b, sum(w) AS s0, sum(w * tt) AS st, sum(w * z) AS sz, sum(w * tt * tt) AS stt, sum(w * tt * z) AS stz FROM w2 GROUP BY ALL),
w4 AS (SELECT {k}, b, (s0 * stz - st * sz) / nullif(s0 * stt - st * st, 0) AS c, s0, st, sz FROM w3),
w5 AS (SELECT {k}, b, c, (sz - c * st) / s0 AS a FROM w4),
p2 AS (SELECT {k}, b, power(a, -1 / b) AS qi, greatest(c, 0e0) / (a * b) AS di FROM w5 WHERE a > 0 AND c IS NOT NULL AND greatest(c, 0e0) / (a * b) <= 1),
s2 AS (SELECT {k}, b, qi, di, sum(power((qi / power(1 + b * di * tt, 1 / b) - q) / q, 2)) AS sse FROM kept JOIN p2 USING ({k}) GROUP BY ALL),
f2 AS (SELECT {k}, qi, di, b FROM s2 QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY sse, b) = 1),
par AS (SELECT f1.well_id, f1.phase, f1.arm, coalesce(f2.qi, f1.qi) AS qi, coalesce(f2.di, f1.di) AS di, coalesce(f2.b, f1.b) AS b FROM f1 LEFT JOIN f2 USING ({k})),
cap AS (SELECT m.* EXCLUDE (qi, di, b), par.qi, par.di, par.b, par.qi / power(1 + par.b * par.di * tt, 1 / par.b) AS capacity FROM m JOIN par USING ({k})),
fit0 AS (SELECT {k}, any_value(qi) AS qi, any_value(di) AS di, any_value(b) AS b, any_value(len) AS len,
  CASE WHEN any_value(use_uptime) THEN least(greatest(coalesce(avg(q / capacity) FILTER (WHERE tt >= fit_len - 24 AND capacity > 0), 1e0), 0e0), 1e0) ELSE 1e0 END AS uptime,
  any_value(guard) AND count(*) FILTER (WHERE tt >= fit_len - 2 AND (q <= 0 OR q < 0.75e0 * trend)) = 2 AS low FROM cap GROUP BY {k}),
fits AS (SELECT e.well_id, e.phase, e.arm, qi, di, b, uptime, len, coalesce(level, 0e0) AS level
  FROM (SELECT DISTINCT well_id, phase, arm FROM src CROSS JOIN arms) e LEFT JOIN lev USING (well_id, phase) LEFT JOIN (SELECT * FROM fit0 WHERE NOT low) f USING ({k})),
fc AS (SELECT {k}, h::INT AS h, CASE WHEN qi IS NOT NULL THEN qi / power(1 + b * di * (len + h - 1), 1 / b) * uptime ELSE level END AS volume FROM fits CROSS JOIN range(1, {H + 1}) r(h))"""


TRAIN_SQL = f"SELECT * FROM ({bridge.DECLINE_LONG_SQL}) WHERE t <= {CUT}"
ACTUAL_SQL = f"SELECT well_id, phase, t - {CUT} AS h, q AS actual FROM ({bridge.DECLINE_LONG_SQL}) WHERE t > {CUT}"
EVERY = [a[0] for a in arps.ARMS]


def _one_arm(key: str, arm: str) -> None:
    sql = f"WITH {arms_sql([arm], TRAIN_SQL)} SELECT well_id, phase, h, round(volume, 6) AS volume FROM fc"

    @query(key, sql)
    def _(spark, sf):
        fc = arps.forecast(arps.fit(_train(spark, sf), arps.arms_table(spark, [arm])), H)
        return fc.select("well_id", "phase", "h", r6("volume"))


for _k, _arm in enumerate(EVERY):
    _one_arm(f"fc_{_k + 1:02d}_{_arm}", _arm)


@query("fc_arm_board", f"""WITH {arms_sql(EVERY, TRAIN_SQL)}, act AS ({ACTUAL_SQL}),
e AS (SELECT arm, phase, well_id, ln(sum(greatest(volume, 0)) / sum(actual)) AS e FROM fc JOIN act USING (well_id, phase, h) GROUP BY ALL)
SELECT arm, phase, count(*) AS wells, round(2e0 / 3 * abs(median(e)) + 1e0 / 3 * stddev_pop(e), 6) AS score FROM e GROUP BY ALL""")
def fc_arm_board(spark, sf):
    """All ten arms on the same wells and phases: pool score of cumulative log errors."""
    fc = arps.forecast(arps.fit(_train(spark, sf), arps.arms_table(spark)), H).join(_actual(spark, sf), ["well_id", "phase", "h"])
    e = metrics.cumulative(fc.withColumnRenamed("volume", "forecast"), ["arm", "phase", "well_id"])
    return e.groupBy("arm", "phase").agg(F.count("*").alias("wells"), r6(pool_score(F.col("e")), "score"))


def _headline(spark, sf):
    """Split, official arm, twelve months, cumulative log error of each phase, pool score by play."""
    fc = arps.forecast(arps.fit(_train(spark, sf), arps.arms_table(spark, ["bounded"])), H)
    pairs = fc.join(_actual(spark, sf), ["well_id", "phase", "h"]).withColumnRenamed("volume", "forecast")
    e = metrics.cumulative(pairs, ["well_id", "phase"]).join(bridge.wells(spark, sf), "well_id", "left")
    return e.groupBy("play").agg(F.count("*").alias("units"), r6(pool_score(F.col("e")), "score"))


query("headline_score_by_play", f"""WITH {arms_sql(["bounded"], TRAIN_SQL)}, act AS ({ACTUAL_SQL}), w AS ({bridge.WELLS_SQL}),
e AS (SELECT well_id, phase, ln(sum(greatest(volume, 0)) / sum(actual)) AS e FROM fc JOIN act USING (well_id, phase, h) GROUP BY ALL)
SELECT play, count(*) AS units, round(CASE WHEN count(e) >= 2 THEN 2e0 / 3 * abs(median(e)) + 1e0 / 3 * stddev_pop(e) END, 6) AS score FROM e LEFT JOIN w USING (well_id) GROUP BY ALL""")(_headline)


@query("fc_12_inner_score", f"""WITH {arms_sql(["bounded", "window_24"], TRAIN_SQL)}, act AS ({ACTUAL_SQL})
SELECT arm, phase, well_id, round(2e0 / 3 * abs(median(ln(volume / actual))) + 1e0 / 3 * stddev_pop(ln(volume / actual)), 6) AS score FROM fc JOIN act USING (well_id, phase, h) GROUP BY ALL""")
def fc_12(spark, sf):
    fc = arps.forecast(arps.fit(_train(spark, sf), arps.arms_table(spark, ["bounded", "window_24"])), H)
    return arps.inner_score(fc.join(_actual(spark, sf), ["well_id", "phase", "h"]), arps.KEY).select("arm", "phase", "well_id", r6("score"))


_INNER = [n for n in EVERY if n in arps.ROUTED]


@query("fc_11_routed", f"""WITH tr AS (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t) AS rn, count(*) OVER (PARTITION BY well_id, phase) AS rows FROM ({TRAIN_SQL}) WHERE q IS NOT NULL), chosen AS (
  WITH {arms_sql(_INNER, "SELECT well_id, phase, t, q FROM tr WHERE rn <= rows - 6").replace(f"range(1, {H + 1})", "range(1, 7)")},
  sc AS (SELECT well_id, phase, arm, 2e0 / 3 * abs(median(ln(volume / q))) + 1e0 / 3 * stddev_pop(ln(volume / q)) AS score
    FROM fc JOIN (SELECT well_id, phase, rn - rows + 6 AS h, q FROM tr WHERE rn > rows - 6) a USING (well_id, phase, h) GROUP BY ALL)
  SELECT well_id, phase, arm FROM sc QUALIFY row_number() OVER (PARTITION BY well_id, phase ORDER BY round(score, 9), list_position({_INNER}, arm)) = 1),
{arms_sql(_INNER, "SELECT well_id, phase, t, q FROM tr")}
SELECT well_id, phase, arm, h, round(volume, 6) AS volume FROM fc JOIN chosen USING (well_id, phase, arm)""")
def fc_11(spark, sf):
    """Arms routed by each series' own last six months."""
    return arps.routed(_train(spark, sf).filter(F.col("well_id").isNotNull()), H).select("well_id", "phase", "arm", "h", r6("volume"))


@query("fc_14_capacity_ratios", f"""WITH {arms_sql(["bounded"], TRAIN_SQL)}
SELECT phase, (fit_len - tt)::INT AS "offset", count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.75), 6) AS p75
FROM (SELECT *, q / capacity AS r FROM cap WHERE fit_len - tt <= 6) GROUP BY ALL""")
def fc_14(spark, sf):
    """Reported over fitted capacity before the cutoff: the reporting-lag diagnostic."""
    p = F.percentile("ratio", F.array(F.lit(0.25), F.lit(0.75)))
    x = arps.capacity_ratios(_train(spark, sf)).groupBy("phase", "offset").agg(F.count("*").alias("n"), r6(F.avg("ratio"), "mean"), r6(F.median("ratio"), "median"), p.alias("p"))
    return x.select("phase", "offset", "n", "mean", "median", r6(F.col("p")[0], "p25"), r6(F.col("p")[1], "p75"))


@query("fc_flat_tail_fallback", f"WITH {arms_sql(['bounded'], f'SELECT * FROM (WITH d AS ({bridge.PART_SQL}) ' + bridge.LONG_SQL.replace('({s})', 'd') + ') WHERE t < 4')} SELECT phase, count(*) AS n, count(*) FILTER (WHERE qi IS NULL) AS flat, round(sum(CASE WHEN qi IS NULL THEN level ELSE 0 END), 4) AS level FROM fits GROUP BY ALL")
def fc_flat(spark, sf):
    """Short part histories: many can't be fitted and hold their last mean."""
    f = arps.fit(bridge.longer(bridge.part_series(spark, sf).filter("t < 4")), arps.arms_table(spark, ["bounded"]))
    return f.groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("qi").isNull()).alias("flat"), F.round(F.sum(F.when(F.col("qi").isNull(), F.col("level")).otherwise(0.0)), 4).alias("level"))


FC_SQL = f"WITH {arms_sql(['bounded'], TRAIN_SQL)} SELECT well_id, phase, h AS t, CASE WHEN h % 5 = 3 THEN NULL ELSE volume * (1 + 0.3e0 * (h % 3)) END AS q FROM fc"


def _rough(spark, sf):
    fc = arps.forecast(arps.fit(_train(spark, sf), arps.arms_table(spark, ["bounded"])), H)
    return fc.select("well_id", "phase", F.col("h").alias("t"), F.when(F.col("h") % 5 != 3, F.col("volume") * (1 + 0.3 * (F.col("h") % 3))).alias("q"))


INTERP_SQL = f"""WITH f AS ({FC_SQL}), i AS (SELECT *, last_value(q IGNORE NULLS) OVER a AS q0, last_value(CASE WHEN q IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0,
  first_value(q IGNORE NULLS) OVER z AS q1, first_value(CASE WHEN q IS NOT NULL THEN t END IGNORE NULLS) OVER z AS t1 FROM f
  WINDOW a AS (PARTITION BY well_id, phase ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY well_id, phase ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT well_id, phase, t, greatest(coalesce(q, q0 + (q1 - q0) * (t - t0) / nullif(t1 - t0, 0), q0, q1, 0), 0) AS q FROM i)"""


@query("fit_15_sanitize", f"{INTERP_SQL} SELECT well_id, phase, t::INT AS t, round(q, 6) AS q FROM g")
def fit_15(spark, sf):
    return sequence.sanitize(_rough(spark, sf)).select("well_id", "phase", "t", r6("q"))


@query("fit_14_terminal_decline", f"""{INTERP_SQL}, r AS (SELECT well_id, phase, t, min(q) OVER (PARTITION BY well_id, phase ORDER BY t) AS q FROM g),
s AS (SELECT *, CASE WHEN ln(greatest(q, 1e-9) / greatest(lead(q) OVER (PARTITION BY well_id, phase ORDER BY t), 1e-9)) < {sequence.TERMINAL!r}::DOUBLE THEN t END AS st FROM r),
u AS (SELECT *, min(st) OVER (PARTITION BY well_id, phase) AS s0 FROM s)
SELECT well_id, phase, t::INT AS t, round(CASE WHEN t > s0 THEN max(CASE WHEN t = s0 THEN q END) OVER (PARTITION BY well_id, phase) * exp(-{sequence.TERMINAL!r}::DOUBLE * (t - s0)) ELSE q END, 6) AS q FROM u""")
def fit_14(spark, sf):
    return sequence.terminal_decline(_rough(spark, sf)).select("well_id", "phase", "t", r6("q"))


@query("fit_17_fallback", f"""WITH tr AS ({TRAIN_SQL}), l AS (SELECT well_id, phase, median(q) AS level FROM (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS k FROM tr WHERE q > 0) WHERE k <= 3 GROUP BY ALL)
SELECT well_id, phase, h::INT AS h, round(level * exp(-{sequence.TERMINAL!r}::DOUBLE * h), 6) AS volume FROM l CROSS JOIN range(1, 13) r(h)""")
def fit_17(spark, sf):
    return sequence.fallback(_train(spark, sf), H).select("well_id", "phase", "h", r6("volume"))


@query("prj_12_concat_holdout", f"SELECT well_id, count(*) AS months, min(t)::INT AS first, max(t)::INT AS last FROM ({bridge.DECLINE_SQL}) GROUP BY ALL HAVING max(t) FILTER (WHERE t <= {CUT}) + 1 = min(t) FILTER (WHERE t > {CUT})")
def prj_12(spark, sf):
    d = bridge.decline(spark, sf).select("well_id", "t")
    both = d.groupBy("well_id").agg(F.max(F.when(F.col("t") <= CUT, F.col("t"))).alias("a"), F.min(F.when(F.col("t") > CUT, F.col("t"))).alias("b")).filter("a + 1 = b").select("well_id")
    d = d.join(both, "well_id", "left_semi")
    return calendar.concatenate(d.filter(F.col("t") <= CUT), d.filter(F.col("t") > CUT)).groupBy("well_id").agg(F.count("*").alias("months"), F.min("t").alias("first"), F.max("t").alias("last"))
