"""Connected components by one task and by rounds over all tasks."""

import random

import pytest

from taperflow.llm import simhash


def least(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def edges():
    """Two chains, a star, small random groups and both ends of a long."""
    rnd = random.Random(5)
    out = {(k + 1, k) for k in range(-40, 40)} | {(2000 - k, 1000 + k) for k in range(300)} | {(2001 - k, 1000 + k) for k in range(300)}
    out |= {(5000 + k, 5000) for k in range(1, 200)} | {((1 << 63) - 1, -(1 << 63))}
    for _ in range(300):
        a, b = rnd.sample(range(10_000, 10_600), 2)
        out.add((max(a, b), min(a, b)))
    return sorted(out)


@pytest.mark.parametrize("together", [10**6, 0, 100])
def test_components_equal_union_find(spark, monkeypatch, together):
    monkeypatch.setattr(simhash, "TOGETHER", together)
    pairs = edges()
    got = simhash.components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == least(pairs)


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_edges_cost_few_jobs(spark):
    """Rounds over all tasks start some ten exchanges each, with a driver thread for every one."""
    spark.sparkContext.setJobGroup("few-edges", "components")
    try:
        simhash.components(spark.createDataFrame(edges(), "u long, v long")).collect()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
