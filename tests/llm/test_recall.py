"""Recall of the registered neighbour query against brute force on the given tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taperflow.llm import ann, queries


def brute(ids, v, q, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -9
    return {ids[a]: {ids[b] for b in np.argsort(-row, kind="stable")[:k]} for a, row in zip(q, s, strict=True)}


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(got.get(q, set()) & near) / len(near) for q, near in want.items()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want = brute(ids, v, np.flatnonzero(ids % 50 == 0))
    assert recall(queries.op3_adaptive_scan(spark, f"/root/testdata/{sf}").collect(), want) >= 0.95


def test_every_row_asked_on_shapeless_vectors(spark):
    v = np.random.default_rng(3).standard_normal((2000, 96))  # nearly all of the 22 lists are needed
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = brute(np.arange(2000), v, np.arange(0, 2000, 4))
    assert recall(ann.nearest(df, F.col("vec_id") % 4 == 0).collect(), want) >= 0.93


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((80, 48))
    v = centre[rng.integers(80, size=6000)] + 0.15 * rng.standard_normal((6000, 48))
    lists = ann.Lists(v, 39)
    assert ann.probes_for(v, lists, 5) <= 12
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = brute(np.arange(6000), v, np.arange(0, 6000, 50))
    assert recall(ann.nearest(df, F.col("vec_id") % 50 == 0).collect(), want) >= 0.95


def test_more_lists_than_coarse_centres(monkeypatch, spark):
    monkeypatch.setattr(ann, "COARSE", 6)
    v = np.random.default_rng(6).standard_normal((1500, 24))
    assert len(ann.Lists(v, 19)) == 24
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = brute(np.arange(1500), v, np.arange(0, 1500, 50))
    assert recall(ann.nearest(df, F.col("vec_id") % 50 == 0).collect(), want) >= 0.95
