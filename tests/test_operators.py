"""Operators against plain calculations, and their invariants."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from taperflow.functions import columns
from taperflow.operators import arps, board, calendar, cohort, control, families, gates, holdout, metrics, ordering, profiles, providers, resample, routing, sequence, submission, synth
from taperflow.sources import files, sinks
from taperflow.streaming.rescore import rescore

T = np.arange(36)


def long(spark, series, phase="oil"):
    rows = [(w, phase, t, None if v is None or np.isnan(v) else float(v)) for w, q in series.items() for t, v in enumerate(q)]
    return spark.createDataFrame(rows, "well_id string, phase string, t int, q double")


def vector(fc, well, phase="oil", **more):
    f = fc.filter((F.col("well_id") == well) & (F.col("phase") == phase))
    for k, v in more.items():
        f = f.filter(F.col(k) == v)
    return np.array([r["volume"] for r in f.orderBy("h").collect()])


def hyper(t, qi=5000, b=0.8, d=0.08):
    return qi / (1 + b * d * t) ** (1 / b)


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["play", "units", "score"] and got.count() > 0


def test_arms_recover_a_clean_curve(spark):
    fits = arps.fit(long(spark, {"a": hyper(T), "short": [4500, 4400], "none": [np.nan] * 4}), arps.arms_table(spark))
    fc = arps.forecast(fits, 12)
    for arm in ("bounded", "lag_skip_2", "no_uptime"):
        assert np.allclose(vector(fc, "a", arm=arm), hyper(36 + np.arange(12)), rtol=1e-6)
    assert np.allclose(vector(fc, "short", arm="bounded"), 4450) and np.allclose(vector(fc, "none", arm="bounded"), 0)
    assert fits.filter("uptime > 1").count() == 0


def test_old_history_has_no_effect(spark):
    tail = hyper(T) * np.where(T % 5 == 0, 0.9, 1)
    a, b = np.concatenate([[9000, 8000], tail]), np.concatenate([[9000, 100], tail])
    fits = arps.forecast(arps.fit(long(spark, {"a": a, "b": b}), arps.arms_table(spark, ["bounded"])), 6)
    assert np.allclose(vector(fits, "a"), vector(fits, "b"))


def test_control_beats_a_dense_grid_and_recovers_curves():
    rng = np.random.default_rng(2)
    q = np.stack([hyper(T, qi=rng.uniform(500, 9000), b=rng.uniform(0.3, 1.3), d=rng.uniform(0.01, 0.3)) * np.exp(rng.normal(0, s, 36)) for s in (0, 0.1, 0.3) for _ in range(8)])
    qi, di, b = control.fit_batch(q, np.ones_like(q))
    mine = ((control._curve(qi, di, b, control.T) - q) ** 2).sum(axis=1)
    for k in range(len(q)):
        best = np.inf
        for bb in control.B:
            g = (1 + bb * np.linspace(0, 1, 2001)[:, None] * control.T) ** (-1 / bb)
            n, d = g @ q[k], (g * g).sum(axis=1)
            best = min(best, (q[k] @ q[k] - n * n / d).min())
        assert mine[k] <= best * (1 + 1e-6) + 1e-6
    fc = control.control_batch([hyper(T, b=0.8), np.array([5.0, 4.0]), np.array([]), np.array([1.0, 2.0, 3.0])], 6)
    assert np.allclose(fc[0], hyper(36 + np.arange(6)), rtol=1e-4) and np.allclose(fc[1], 4.5) and np.allclose(fc[2], 0) and np.allclose(fc[3], 2)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1e5), min_size=3, max_size=60))
def test_control_is_finite_and_not_negative(q):
    fc = control.control_batch([np.array(q)], 9)
    assert fc.shape == (1, 9) and np.isfinite(fc).all() and (fc >= 0).all()


def test_terminal_decline(spark):
    fc = sequence.terminal_decline(long(spark, {"flat": [100.0] * 13, "gap": [1000, 900, np.nan, 800, 700, 600], "none": [np.nan] * 3}))
    get = lambda w: np.array([r["q"] for r in fc.filter(F.col("well_id") == w).orderBy("t").collect()])
    assert abs(get("flat")[12] / get("flat")[0] - 0.94) < 1e-9 and (np.diff(get("flat")) < 0).all()
    assert np.allclose(get("gap"), [1000, 900, 850, 800, 700, 600]) and (get("none") == 0).all()


def test_families_recover_curves(spark):
    exp = 3000 * np.exp(-0.05 * T)
    sepd = 3000 * np.exp(-0.3 * T**0.6)
    fits = families.fit(long(spark, {"e": exp, "s": sepd}), families.candidates(spark))
    fc = families.forecast(fits, 6)
    assert np.allclose(vector(fc, "e", name="exp_36"), 3000 * np.exp(-0.05 * (36 + np.arange(6))))
    best = {r["well_id"]: r["name"] for r in families.winners(families.backtest(long(spark, {"e": exp}), families.candidates(spark))).collect()}
    assert best["e"].startswith("exp")


def test_routed_wells(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(14):
        q = hyper(np.arange(30)) * (0.8 + 0.03 * k) * np.exp(rng.normal(0, 0.05, 30))
        n = 30 if k else 9
        q[-2:] *= 0.05 if k == 13 else 1
        rows += [(f"w{k}", t, float(q[t]), float(q[t] * 2), float(q[t] * 0.4)) for t in range(n)]
    wide = spark.createDataFrame(rows, "well_id string, t int, oil double, gas double, water double")
    groups = wide.select("well_id").distinct().withColumn("grp", F.lit("dj"))
    control_fc = routing.forecast_wells(wide, groups, 6, profiles.profile("scipy_control"))[0]
    picked = routing.forecast_wells(wide, groups, 6, profiles.profile("selective_cohort_v1"))[0]
    full, diag = routing.forecast_wells(wide, groups, 6, profiles.profile("v12_fixed"))
    for fc in (control_fc, picked, full):
        assert fc.count() == 14 * 3 * 6 and fc.filter("volume IS NULL OR volume < 0 OR isnan(volume)").count() == 0
    assert np.allclose(vector(control_fc, "w5", "gas"), vector(picked, "w5", "gas"))  # outside its route
    assert not np.allclose(vector(control_fc, "w0"), vector(picked, "w0"))  # thin: peers count
    d = {(r["well_id"], r["phase"]): r for r in diag.collect()}
    assert "terminal_low" in d["w13", "oil"]["flags"] and d["w13", "oil"]["route"] == "depressed_cutoff"
    assert "thin_history" in d["w0", "oil"]["flags"]
    with pytest.raises(ValueError):
        profiles.profile("unknown")


def test_calendar(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, None, None), ("a", 4, 2.0, None, None), ("a", 4, 3.0, 1.0, None)], "well_id string, t int, oil double, gas double, water double")
    one = calendar.sum_duplicates(rows)
    assert [(r.t, r.oil, r.gas) for r in one.orderBy("t").collect()] == [(1, 1.0, None), (4, 5.0, 1.0)]
    assert [r.oil for r in calendar.fill_gaps(one, "zero").orderBy("t").collect()] == [1.0, 0.0, 0.0, 5.0]
    for bad in (lambda: calendar.fill_gaps(one, "error").collect(), lambda: calendar.sum_duplicates(rows, "error").collect()):
        with pytest.raises(Exception, match="month"):
            bad()
    late = calendar.targets(one, 3, 2).collect()
    assert [(r.gap, r.h) for r in late] == [(-3, None)]
    s = calendar.split_at(spark.createDataFrame([("a", t) for t in range(10)], "well_id string, t int"), 6, 3)
    assert s.filter("split = 'holdout'").agg(F.min("t"), F.max("h")).first()[:] == (7, 3)


def simulate(sizes, wanted):
    cells, at, out = sorted(sizes), dict.fromkeys(sizes, 0), {}
    for role, n in wanted.items():
        out[role] = dict.fromkeys(cells, 0)
        while n:
            for c in cells:
                if n and at[c] < sizes[c]:
                    at[c] += 1
                    out[role][c] += 1
                    n -= 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.lists(st.integers(0, 12), min_size=1, max_size=4))
def test_roles_equal_a_simulation(cells, wanted):
    sizes = {("p", str(k)): n for k, n in enumerate(cells)}
    want = {f"r{k}": n for k, n in enumerate(wanted)}
    if sum(wanted) > sum(cells):
        with pytest.raises(ValueError):
            board.role_counts(sizes, want)
        return
    assert board.role_counts(sizes, want) == simulate(sizes, want)
    fewer = dict(list(want.items())[:-1])
    assert board.role_counts(sizes, fewer) == {k: v for k, v in simulate(sizes, want).items() if k in fewer}


def test_submission_gates_and_reports(spark):
    units = spark.createDataFrame([("a", "oil", True), ("b", "oil", True), ("c", "oil", False), ("d", "oil", True)], "well_id string, phase string, available boolean")
    fc = spark.createDataFrame([("a", "oil", 1, 1.0), ("a", "oil", 2, 2.0), ("b", "oil", 1, 1.0), ("d", "oil", 1, 1.0), ("d", "oil", 2, float("inf"))], "well_id string, phase string, h int, volume double")
    rows, failures = submission.generate(units, fc, 2)
    assert rows.count() == 2 and {r[0]: r[2] for r in failures.collect()} == {"b": "length_mismatch:1", "c": "phase_unavailable", "d": "nonfinite_or_negative_forecast"}
    assert "| length_mismatch:1 | 1 |" in sinks.failure_markdown(failures)
    assert sinks.markdown_table(rows.orderBy("h")).count("\n") == 4
    ev = spark.createDataFrame([(0, 0, -0.1, -0.05, -0.2, 0.0, 0.01)], "mismatches int, failures int, delta double, ci_high double, relative double, catastrophic_delta double, worst_segment_10 double")
    assert all(r["passed"] for r in gates.evaluate(ev, "selection").collect())
    assert not all(r["passed"] for r in gates.evaluate(ev, "strict").collect())  # missing evidence fails


def test_files(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "raw.csv").write_bytes("﻿API14,Production Date,Oil Volume BBL,Gas Volume MCF\n001,2024-01,\"1,200.5\",\n001,02/2024,5,1\n001,2024/03,,2\n001,202404,-1,2\n001,01/15/2024,1,1\n ,2024-01,1,1\n".encode())
    good, bad = files.read_raw(spark, f"{d}/raw.csv")
    assert [(r.well_id, str(r.month), r.oil, r.gas, r.water) for r in good.orderBy("month").collect()] == [("001", "2024-01-01", 1200.5, None, None), ("001", "2024-02-01", 5.0, 1.0, None), ("001", "2024-03-01", None, 2.0, None)]
    assert {r.reason for r in bad.collect()} == {"negative_volume", "bad_month"}
    (tmp_path / "head.csv").write_text("api,pad,play\n001,,DJ Basin\n002,P,x\n")
    assert {r.well_id: r.pad_id for r in files.read_headers(spark, f"{d}/head.csv").collect()} == {"001": "001", "002": "P"}
    (tmp_path / "history.csv").write_text("well_id,month,oil,gas,water\n001,2024-01-01,1,nan,\n")
    assert files.read_input(spark, d).first()["gas"] is None
    assert files.read_metadata(spark, d) is None
    (tmp_path / "wells.csv").write_text("well_id,basin\n001,a\n001,b\n")
    assert files.read_metadata(spark, d).first()["basin"] == "b"
    snap = tmp_path / "snap"
    for side in ("train", "holdout"):
        (snap / side).mkdir(parents=True)
        (snap / side / "p.csv").write_text("well_id,month,oil\n001,2024-01-01,1\n")
    (snap / "pads.json").write_text(json.dumps([{"pad_id": "p", "wells": ["001"]}]))
    assert files.read_snapshot(spark, str(snap))[0].count() == 1
    pre = tmp_path / "pre"
    pre.mkdir()
    (pre / "a.json").write_text(json.dumps({"forecasts": {"001": {"oil": [1, 2], "x": [3]}}}))
    (pre / "b.json").write_text(json.dumps({"002": {"gas": [4, 5]}}))
    assert files.read_precomputed(spark, f"{pre}/*.json").count() == 4
    (pre / "c.json").write_text(json.dumps({"002": {"gas": [4, 5]}}))
    with pytest.raises(ValueError, match="002"):
        files.read_precomputed(spark, f"{pre}/*.json")
    package = {"approver": "x", "approved_at": "2024-05-01T10:00:00Z", "overrides": [{"well_id": "001", "phase": "oil", "reason": "r", "values": [1, 2]}]}
    (tmp_path / "o.json").write_text(json.dumps(package))
    rows, audit = files.read_overrides(spark, f"{d}/o.json", 2)
    assert rows.count() == 2 and audit["count"] == 1
    (tmp_path / "o.json").write_text(json.dumps(package | {"approved_at": "yesterday"}))
    with pytest.raises(ValueError):
        files.read_overrides(spark, f"{d}/o.json", 2)
    sinks.write_text(spark, "hello", f"{d}/out/log.txt")
    assert (tmp_path / "out" / "log.txt").read_text() == "hello"
    assert sinks.manifest(spark, f"{d}/out").filter("path like '%log.txt'").first()["bytes"] == 5
    assert files.seeds("3-5, 1,4") == [1, 3, 4, 5] and files.validated_table("a.b") == "a.b"
    with pytest.raises(ValueError):
        files.validated_table("a.b; drop")


def test_response_parsing():
    good = {"forecasts": {"w": {"oil": [1, 2]}}}
    text = json.dumps(good)
    assert files.parse_response(f"Sure!\n```json\n{text}\n```") == good
    assert files.parse_response(f"so {text} done") == good
    assert files.parse_response(text[:-2]) == good
    assert files.parse_response("none {x}") is None
    odd = {"note": 'a } brace, a { brace and a " quote', "forecasts": {"w": {"oil": [1]}}}
    assert files.parse_response(f"see {json.dumps(odd)} end") == odd
    assert files.parse_response('{"forecasts": {"w": {"oil": [1]}}, "why": "two\nlines"}')["why"] == "two\nlines"


def test_month_and_group_labels(spark):
    rows = spark.createDataFrame([("2024-3", "Lower Eagle-Ford"), ("13/2024", " "), ("202413", "DJ Basin"), ("2024-03-09", "a//b")], "m string, g string")
    got = rows.select(columns.parse_month(F.col("m")).cast("string").alias("m"), columns.group_label(F.col("g")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("2024-03-01", "eagle_ford"), (None, "__global__"), (None, "dj"), ("2024-03-01", "a_b")]


def test_stress_cases_and_rescoring(spark, tmp_path):
    a, b = (sorted(map(tuple, synth.stress(spark, [3], 16, 6).filter("oil IS NOT NULL").collect())) for _ in range(2))
    assert a == b and len({r[2] for r in a}) == 8
    rnd = random.Random(0)
    act = spark.createDataFrame([("w", "oil", h, 10.0 + rnd.random()) for h in range(1, 5)], "well_id string, phase string, h int, actual double")
    act.write.parquet(str(tmp_path / "in"))
    fc = act.withColumn("volume", F.col("actual")).drop("actual")
    rescore(spark.readStream.schema(act.schema).parquet(str(tmp_path / "in")), fc, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert abs(spark.read.parquet(str(tmp_path / "out")).first()["e"]) < 1e-9


def test_resamples_are_independent_draws(spark):
    for n, reps in ((100, 400), (300, 150), (1000, 60)):
        d = resample.draws(n, reps, 17, spark)
        share = d.groupBy("rep").agg((F.count_distinct("unit") / n).alias("s")).agg(F.avg("s")).first()[0]
        assert abs(share - (1 - (1 - 1 / n) ** n)) < 0.01
        x = np.random.default_rng(n).normal(size=n)
        values = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "unit long, x double")
        sd = resample.resampled(values, n, reps, 17, F.avg("x")).agg(F.stddev_pop("value")).first()[0]
        assert 0.75 < sd / (x.std() / np.sqrt(n)) < 1.3
    assert resample.bootstrap(spark.createDataFrame([(0, 1.0, 2.0)], "unit long, a double, b double"), 1, 10).first()[:] == (None, None, None)


@pytest.mark.parametrize("most", [10**6, 10])
def test_draws_never_go_through_the_driver(spark, monkeypatch, most):
    """Units are sent or both sides shuffled; the draws (here 200 of each unit) aren't sent."""
    monkeypatch.setattr(resample, "BROADCAST_UNITS", most)
    rows = spark.range(5000).select(F.col("id").alias("unit"), (F.col("id") % 97 / 9).alias("a"))
    x = resample.resampled(rows, 5000, 200, 17, F.avg("a"))
    plan = x._jdf.queryExecution().executedPlan().toString()
    sent = plan.split("BroadcastExchange")[1:]
    assert "md5" not in "".join(sent) and ("SortMergeJoin" in plan) == (most == 10)
    assert "Exchange" not in plan.split("BroadcastHashJoin")[0] or most == 10  # a replicate is in one task
    assert x.count() == 200


def test_comparison_shuffles_many_units(spark, monkeypatch):
    monkeypatch.setattr(resample, "BROADCAST_UNITS", 10)
    errors = spark.range(300).selectExpr("explode(array('x', 'y')) AS arm", "id AS well_id", "'oil' AS phase", "id % 7 / 9 AS e")
    x = holdout.comparison(errors, "x", "y", 20)
    assert "SortMergeJoin [unit" in x._jdf.queryExecution().executedPlan().toString()
    assert x.first()["delta"] == 0


def test_ablation_board_draws_rows_of_all_arms(spark, monkeypatch):
    """The board's draws are joined with one row a well, as its intervals by hand."""
    asked = []
    whole = resample.all_resampled
    monkeypatch.setattr(resample, "all_resampled", lambda rows, units, *a: asked.append((rows.count(), units)) or whole(rows, units, *a))
    rng = np.random.default_rng(5)
    rows = [(f"w{k}", t, *(float(v) for v in 500 * np.exp(-0.05 * t) * rng.uniform(0.8, 1.2) * np.array([1, 2, 0.4]))) for k in range(6) for t in range(30)]
    wide = spark.createDataFrame(rows, "well_id string, t int, oil double, gas double, water double")
    groups = wide.select("well_id", F.lit("g").alias("grp")).distinct()
    actual = wide.filter("t < 4").selectExpr("well_id", "explode(array('oil', 'gas')) AS phase", "t + 1 AS h", "oil * 0.3 AS actual")
    got = {r["arm"]: r for r in holdout.ablation_board(wide, groups, actual, 4, names=[], reps=30).collect()}
    assert asked == [(6, 6)] and set(got) == {"A_scipy", "B_linearized"}
    assert got["A_scipy"]["low"] is None and got["B_linearized"]["low"] <= got["B_linearized"]["diff"] <= got["B_linearized"]["high"]


def test_clusters_are_drawn_whole(spark):
    rows = [(f"w{k}", p, 0.1 * (k % 7) - 0.3 + 0.01 * p, 0.12 * (k % 5) - 0.2) for k in range(40) for p in range(3)]
    df = spark.createDataFrame(rows, "well_id string, p int, a double, b double")
    got = resample.clustered(df, "well_id", 50, 3).first()
    index = {w: k for k, w in enumerate(sorted({r[0] for r in rows}))}
    own = {k: [r[2:] for r in rows if index[r[0]] == k] for k in range(40)}
    score = lambda v: 2 / 3 * abs(np.median(v)) + np.std(v) / 3
    deltas = []
    for rep in resample.draws(40, 50, 3, spark).groupBy("rep").agg(F.collect_list("unit").alias("u")).collect():
        a, b = np.array([x for u in rep["u"] for x in own[u]]).T
        deltas.append(score(a) - score(b))
    assert np.allclose(got[:2], np.quantile(deltas, [0.025, 0.975])) and np.isclose(got[2], np.mean(np.array(deltas) < 0))


def test_numbers_run_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).withColumn("x", F.xxhash64("id") % 100)
    got = ordering.numbered(rows, ["x", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5000)) and [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)


def test_a_long_chain_is_one_cluster(spark):
    rows = [(f"w{k}", f"{(k * 89) % 240:04d}", f"a{k // 2}", f"h{(k + 1) // 2}") for k in range(240)] + [("x", "9999", "", "hx"), ("y", "9998", None, "hy"), ("z", "9997", " ", "hz")]
    got = {r["well_id"]: r for r in board.collapse_duplicates(spark.createDataFrame(rows, "well_id string, ord string, api string, series_hash string")).collect()}
    assert {got[f"w{k}"]["cluster"] for k in range(240)} == {"0000"} and sum(got[f"w{k}"]["keep"] for k in range(240)) == 1
    assert all(got[w]["keep"] and got[w]["cluster"] == o for w, o, _, _ in rows[240:])


def small_wells(spark, n=12, months=24):
    rows = [(f"w{k}", t, float(hyper(t, 4000 + 100 * k)), float(hyper(t) * 2), float(hyper(t) * 0.4)) for k in range(n) for t in range(months if k else 9)]
    return spark.createDataFrame(rows, "well_id string, t int, oil double, gas double, water double")


def test_wells_without_a_group_are_refused(spark):
    wide = small_wells(spark)
    groups = wide.select("well_id").distinct().withColumn("grp", F.when(F.col("well_id") != "w0", F.lit("dj")))
    with pytest.raises(Exception, match="no group is known of well w0"):
        routing.forecast_wells(wide, groups, 6, profiles.profile("cohort_conservative"))[0].collect()
    rows = wide.unpivot(["well_id", "t"], ["oil", "gas", "water"], "phase", "q")
    shape = cohort.profiles(rows, groups)
    own = cohort.cohort_forecast(rows, groups, shape, 6, use_global=False)
    assert own.filter("well_id = 'w0'").isEmpty() and not cohort.cohort_forecast(rows, groups, shape, 6).filter("well_id = 'w0'").isEmpty()


def test_months_without_a_row_count(spark):
    q = hyper(np.arange(36))
    gaps = np.where(np.arange(36) % 4 == 2, np.nan, q)
    rows = long(spark, {"null": gaps})
    absent = rows.filter("q IS NOT NULL").withColumn("well_id", F.lit("absent"))
    fits = {r["well_id"]: r for r in families.fit(rows.unionByName(absent), families.candidates(spark, ["hyper_36"])).collect()}
    assert fits["null"][3:] == fits["absent"][3:] and fits["null"]["origin"] == 36


def test_terminal_volumes_equal_the_window_form(spark):
    rng = np.random.default_rng(4)
    v = np.abs(rng.normal(0, 50, (30, 9))) * np.exp(-0.1 * np.arange(9))
    v[3], v[4, 5:] = 0, 0
    rows = spark.createDataFrame([(f"w{k}", "oil", t, float(x)) for k, r in enumerate(v) for t, x in enumerate(r)], "well_id string, phase string, t int, q double")
    got = {(r["well_id"], r["t"]): r["q"] for r in sequence.terminal_decline(rows).collect()}
    want = families.terminal(v)
    assert all(np.isclose(got[f"w{k}", t], want[k, t]) for k in range(30) for t in range(9))


def test_providers(spark):
    rows = long(spark, {"a": hyper(T), "none": [np.nan] * 5})
    assert {r["well_id"] for r in providers.from_model(lambda q: (lambda n: np.full(n, q[-1])) if len(q) else None)(rows, 4).collect()} == {"a"}
    with pytest.raises(Exception, match="not 4 months"):
        providers.from_model(lambda q: lambda n: np.zeros(n + 1))(rows, 4).collect()
    vectors = spark.createDataFrame([("a", "oil", h, 1.0) for h in (1, 2, 3)], "well_id string, phase string, h int, volume double")
    assert providers.precomputed(vectors)(rows, 3).count() == 3
    with pytest.raises(Exception, match="3 months, not 4"):
        providers.precomputed(vectors)(rows, 4).collect()
    reg = providers.standard()
    with pytest.raises(ValueError, match="already"):
        reg.add("bounded", providers.arm("bounded"))
    assert reg.forecast(rows.filter("well_id = 'a'"), 3).groupBy("arm").count().count() == len(arps.ARMS) + 1


def test_holdout_scores_only_whole_units(spark):
    wide = small_wells(spark, 6)
    short = providers.arm("window_24")
    arms = providers.Registry({"bounded": providers.arm("bounded"), "short": lambda r, h: short(r, h).filter("well_id <> 'w2' OR h > 1")})
    errors, failures = holdout.retrospective(wide, 17, 6, arms)
    assert {r["well_id"] for r in failures.collect()} == {"w2"} and {r["reason"] for r in failures.collect()} == {"length_mismatch:5"}
    assert {r["well_id"] for r in errors.collect()} == {"w1", "w3", "w4", "w5"}
    assert holdout.comparison(errors, "short", "bounded", 20).first()["units"] == 12


def test_missing_forecasts_have_no_error(spark):
    rows = spark.createDataFrame([("a", 10.0, 10.0), ("a", 10.0, None), ("b", 10.0, 5.0), ("b", None, 7.0), ("c", 0.0, 1.0), ("d", 10.0, 0.0)], "u string, actual double, forecast double")
    e = {r["u"]: r["e"] for r in metrics.cumulative(rows, ["u"]).collect()}
    assert e["a"] is None and np.isclose(e["b"], np.log(0.5)) and e["c"] is None and np.isclose(e["d"], np.log(1e-6))
    assert {r["u"]: r["e"] for r in metrics.cumulative(rows, ["u"], zero="drop").collect()}["d"] is None
    with pytest.raises(Exception, match="zero"):
        metrics.cumulative(rows, ["u"], zero="error").collect()


def test_consent_and_provenance_are_asked_for():
    assert gates.require_consent("dev", False) is None and gates.require_consent("eval", True)["consent"]
    with pytest.raises(PermissionError):
        gates.require_consent("eval", False)
    gates.require_reported({"provenance_gate": {"mode": "reported_full", "min_holdout_reported_fraction": 1.0}})
    for bad in ({}, {"provenance_gate": {"mode": "mixed"}}, {"provenance_gate": {"mode": "reported_holdout", "min_holdout_reported_fraction": 0.9}}):
        with pytest.raises(ValueError):
            gates.require_reported(bad)


def test_promotion_needs_every_gate(spark):
    wells = spark.createDataFrame([(f"w{k}", "p" if k % 2 else "q") for k in range(40)], "well_id string, play string")
    pairs = spark.createDataFrame([(f"w{k}", ph, 0.01 * (k % 5) - 0.02, 0.4 * (k % 5) - 0.6) for k in range(40) for ph in ("oil", "gas")], "well_id string, phase string, a double, b double")
    ev = holdout.evidence(pairs, wells, ["play"], pairs, 0, 0, 1.0, 60)
    assert gates.promote(ev, "selection", "new").first()[:] == (True, "new")
    assert gates.promote(ev.drop("ci_high"), "selection", "new").first()[:] == (False, "scipy_control")
    assert gates.promote(holdout.evidence(pairs, wells, ["play"], pairs, 1, 0, 1.0, 60), "selection", "new").first()["promoted"] is False


def test_input_policies(spark, tmp_path):
    (tmp_path / "history.csv").write_text("well_id,month,oil\n1,2024-01-01,5\n1,2024-03-01,7\n")
    assert [r["oil"] for r in files.read_input(spark, str(tmp_path)).orderBy("t").collect()] == [5.0, None, 7.0]
    (tmp_path / "manifest.json").write_text('{"gap_policy": "zero"}')
    assert [r["oil"] for r in files.read_input(spark, str(tmp_path)).orderBy("t").collect()] == [5.0, 0.0, 7.0]
    for text, told in (("1,2024-01-01,5\n1,2024-03-01,7\n", "missing month"), ("1,2024-01-01,5\n1,2024-01-01,7\n", "duplicate"), ("1,2024-01-01,12x\n", "unreadable")):
        (tmp_path / "history.csv").write_text("well_id,month,oil\n" + text)
        with pytest.raises(Exception, match=told):
            files.read_history(spark, str(tmp_path / "history.csv")).collect()
    (tmp_path / "raw.csv").write_text("API12,Report Month,Oil Prod,Gas Prod\n7,2024-01,12x,1\n8,2024-01,3,1\n")
    good, bad = files.read_raw(spark, str(tmp_path / "raw.csv"))
    assert [(r["well_id"], r["oil"], r["gas"]) for r in good.collect()] == [("8", 3.0, 1.0)] and [r["reason"] for r in bad.collect()] == ["bad_number"]
    with pytest.raises(RuntimeError):
        files.database_url("NO_SUCH_URL")
    (tmp_path / "env").write_text("# x\nNO_SUCH_URL='jdbc:x'\n")
    assert files.database_url("NO_SUCH_URL", str(tmp_path / "env")) == "jdbc:x"


def test_boards_and_reports_are_written(spark, tmp_path):
    w = spark.createDataFrame([("k1", "h1", "eval", "p", 1.0, 1.0), ("k2", "h2", "dev", "p", 0.5, 1.0)], "well_key string, train_hash string, role string, play string, train_fraction double, holdout_fraction double")
    s = spark.createDataFrame([("k2", "2024-01-01", 1.0, None, 2.0, "train"), ("k1", "2024-01-01", 1.0, None, 2.0, "train")], "well_key string, month string, oil double, gas double, water double, split string")
    c = spark.createDataFrame([("a", "a", True), ("b", "a", False)], "well_id string, cluster string, keep boolean")
    made = sinks.write_board(spark, str(tmp_path / "b"), w, s, c, {"cutoff": 3})
    assert files.read_board(spark, str(tmp_path / "b"))[2]["board_id"] == made["board_id"] != board.board_id(w.limit(1), {"cutoff": 3})
    assert json.loads((tmp_path / "b" / "duplicates.json").read_text()) == {"clusters": 1, "dropped": 1, "largest": 2}
    sinks.write_report(spark, str(tmp_path / "r"), "scores", w.select("well_key"), "v12_fixed", gates.require_consent("eval", True))
    assert json.loads((tmp_path / "r" / "receipt.json").read_text())["locked"] and len(json.loads((tmp_path / "r" / "scores.json").read_text())["rows"]) == 2
    with pytest.raises(ValueError):
        submission.render(w, [{"name": "x", "source": "role"}], ["y"])
    with pytest.raises(ValueError):
        submission.problems(w, 3)
    with pytest.raises(Exception, match="repeats"):
        submission.validate_input(small_wells(spark, 2), spark.createDataFrame([("w0",), ("w0",)], "well_id string")).collect()
