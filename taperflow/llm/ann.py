"""Nearest neighbours by cosine with adaptive dimension scans over inverted lists.

Index: spherical k-means lists, about half the square root of the number of vectors, fitted on a
bounded sample (``SAMPLE`` distinct vectors of smallest hash), hold every distinct vector.  More lists
than ``COARSE`` are the sums of a coarse centre and a centre of residuals, so that the sample needn't
grow with them.  Equal vectors are one entry that carries its smallest ids, so that copies cost
nothing and none of their links is lost.

Search: a query probes its nearest lists: so many that, on a bounded set of queries held against
brute force over the fitting sample, ``RECALL`` of the true nearest are in them.  The sample is no
denser than the table, so its nearest are no nearer.  The ``FIRST`` nearest lists are searched first;
their k-th best is the bound with which the others are.  Lists are cut into blocks of bounded size,
a hot list into many, and a block's queries into groups of bounded size, so that no task holds an
unbounded list.  In a block the unit vectors are turned by a fixed random rotation and read in blocks
of columns; after each block of columns a hypothesis test compares the distance so far, scaled up to
all dimensions, with the query's k-th best: a candidate whose scaled distance is too large for
chance is abandoned.  The survivors' exact cosines are computed in double precision from the
original vectors.

Defined results: vectors that are null, zero, of another length than the most frequent one, or
that hold null or non-finite components take no part, as query or candidate; rows with a null id
take no part; repeated rows of one id count once; ties go to the smaller id; with fewer than k
candidates found all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SAMPLE = 20_000
COARSE = 1024  # centres fitted on whole vectors
RECALL = 0.98  # of the true nearest in the probed lists, measured at fit time
TRIED = 500  # queries of that measurement
FIRST = 8  # lists that a query probes for its bound, and the fewest it probes
BLOCK = 4096  # vectors of a list in one task's block
GROUP = 2048  # queries of a block's group
COLUMNS = 16
EPSILON = 2.1  # of the test: larger abandons later
SEED = 7


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, e (array<double>): the vectors that take part, once each id and vector."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(e, x -> x != 0)")
    sizes = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("e") == (sizes["n"] if sizes else 0))


def _unit(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=-1, keepdims=True)
    m = m / np.where(scale > 0, scale, 1)
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)


def _rows(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _k_means(v: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = v[rng.permutation(len(v))[:k]].copy()
    for _ in range(rounds):
        of = (v @ c.T - (0 if unit else (c * c).sum(axis=1) / 2)).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, v)
        n = np.bincount(of, minlength=len(c))
        total[n == 0] = v[rng.integers(len(v), size=int((n == 0).sum()))]
        c = (_unit(total) if unit else total / np.maximum(n, 1)[:, None]).astype(np.float32)
    return c


class Lists:
    """The lists' centres: coarse ones, and centres of what they leave over."""

    def __init__(self, sample: np.ndarray, lists: int, rounds: int = 10):
        v = _unit(sample).astype(np.float32)
        self.coarse = _k_means(v, min(lists, COARSE, len(v)), rounds, True)
        fine = -(-lists // COARSE)
        left = v - self.coarse[(v @ self.coarse.T).argmax(axis=1)]
        self.fine = _k_means(left, min(fine, len(v)), rounds, False) if fine > 1 else np.zeros((1, v.shape[1]), np.float32)
        self.centres = _unit((self.coarse[:, None] + self.fine).reshape(-1, v.shape[1])).astype(np.float32)

    def __len__(self) -> int:
        return len(self.centres)

    def of(self, v: np.ndarray) -> np.ndarray:
        """The list that holds each unit vector."""
        c = (v @ self.coarse.T).argmax(axis=1)
        if len(self.fine) == 1:
            return c
        return c * len(self.fine) + ((v - self.coarse[c]) @ self.fine.T - (self.fine * self.fine).sum(axis=1) / 2).argmax(axis=1)

    def ranked(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each unit vector, nearest first."""
        near = -(v @ self.centres.T)
        some = np.argpartition(near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.take_along_axis(near, some, axis=1).argsort(axis=1, kind="stable"), axis=1)


def probes_for(sample: np.ndarray, lists: Lists, k: int, recall: float = RECALL) -> int:
    """How many lists a query must probe so that they hold this share of its k nearest."""
    v = _unit(sample).astype(np.float32)
    of, ranks = lists.of(v), []
    k = min(k, len(v) - 1)
    if k < 1:
        return 1
    tried = np.random.default_rng(SEED).permutation(len(v))[:TRIED]
    for at in np.array_split(tried, max(1, len(tried) // 50)):
        s = v[at] @ v.T
        s[np.arange(len(at)), at] = -np.inf
        near = of[np.argpartition(-s, k - 1, axis=1)[:, :k]]
        place = np.argsort(np.argsort(-(v[at] @ lists.centres.T), axis=1), axis=1)
        ranks.append(np.take_along_axis(place, near, axis=1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks), int(np.ceil(recall * len(ranks)))) - 1]) + 1


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def adaptive_scan(x: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray | None = None, columns: int = COLUMNS, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each row of q places of x that may be among its k nearest (x, q: rotated unit rows).
    bounds: squared distances within which a row's nearest are known to be.

    Each column block's squared distances are summed for all rows that are still in; a row
    leaves if its distance so far * dims / columns so far > best * (1 + epsilon / sqrt(columns so far))^2.
    """
    dims, out = x.shape[1], []
    edges = [*range(columns, dims, columns), dims]
    for row, bound in zip(q, np.full(len(q), np.inf) if bounds is None else bounds, strict=True):
        places, best = np.zeros(0, np.int64), np.zeros(0, np.float32)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            alive, so_far, begin = np.arange(len(part)), np.zeros(len(part), np.float32), 0
            limit = min(bound, np.partition(best, k - 1)[k - 1]) if len(best) >= k else bound
            for end in edges:
                d = part[alive, begin:end] - row[begin:end]
                so_far = so_far + np.einsum("ij,ij->i", d, d)
                if end < dims:
                    keep = so_far * (dims / end) <= limit * (1 + epsilon / np.sqrt(end)) ** 2
                else:
                    keep = so_far <= limit * 1.0001 + 1e-6
                alive, so_far, begin = alive[keep], so_far[keep], end
                if not len(alive):
                    break
            places, best = np.concatenate([places, alive + at]), np.concatenate([best, so_far])
            if len(best) > 4 * k:
                limit = np.partition(best, k - 1)[k - 1]
                keep = best <= limit * 1.0001 + 1e-6
                places, best = places[keep], best[keep]
        if len(best) > k:
            keep = best <= np.partition(best, k - 1)[k - 1] * 1.0001 + 1e-6
            places = places[keep]
        out.append(places)
    return out


def _search(k: int):
    """What one task does: the best of a block for a group of queries."""

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(x) and len(q):
            xu, qu = _unit(_rows(x.column("e"))), _unit(_rows(q.column("vector")))
            turn, ids = rotation(xu.shape[1]), x.column("ids").to_pylist()
            bounds = np.array([np.inf if b is None else b for b in q.column("bound").to_pylist()])
            places = adaptive_scan((xu @ turn).astype(np.float32), (qu @ turn).astype(np.float32), k, bounds)
            for key, unit, at in zip(q.column("asked").to_pylist(), qu, places, strict=True):
                score = np.clip(xu[at] @ unit, -1.0, 1.0)
                best = sorted(zip((-score).tolist(), at.tolist(), strict=True), key=lambda r: (r[0], ids[r[1]][0]))[:k]
                found += [(key, -s, ids[p]) for s, p in best]
        cols = [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table({"key": pa.array(cols[0], pa.int64()), "score": pa.array(cols[1], pa.float64()), "ids": pa.array(cols[2], pa.list_(pa.int64()))})

    return run


def _scan(data: DataFrame, probing: DataFrame, k: int) -> DataFrame:
    """key, score, ids: the best k of each list probed, by tiles of a block and a group of queries.
    data: list, key, e, ids; probing: list, key, e, bound."""
    probing = checkpoint(probing)
    blocks = data.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = probing.groupBy("list").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    plan = blocks.join(groups, "list")  # a row a list
    left = data.join(plan, "list").select("list", F.pmod("key", F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "key", "e", "ids")
    right = probing.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("key", F.col("groups")).cast("int").alias("grp"), F.col("key").alias("asked"), F.col("e").alias("vector"), "bound")
    tile = ["list", "block", "grp"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_search(k), "key long, score double, ids array<long>")


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``is_query`` (a column) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    by = F.xxhash64("e")
    order = Window.partitionBy("e").orderBy("vec_id")
    # Distinct vectors with their k + 1 smallest ids: of these, k are never the query's own.
    few = rows.distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    reps = checkpoint(few.groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", by))
    asked = rows.filter(is_query).select("vec_id", by.alias("key")).distinct()
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in reps.orderBy("key").select("e").limit(SAMPLE).collect()])  # SAMPLE rows at most
    lists = Lists(sample, max(1, round(total**0.5 / 2)))
    probes = min(len(lists), max(FIRST, probes_for(sample, lists, k)))
    held = spark.sparkContext.broadcast(lists)  # as many floats as half the square root of the table's rows

    def place(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.of(_unit(_rows(b.column(1))).astype(np.float32)).astype(np.int32))], names=["key", "list"])

    def probe(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                near = held.value.ranked(_unit(_rows(part.column(1))).astype(np.float32), probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(near), pa.list_(pa.int32()))], names=["key", "lists"])

    listed = reps.select("key", "e").mapInArrow(place, "key long, list int")
    data = checkpoint(reps.join(listed, "key"))
    queries = reps.join(asked.select("key").distinct(), "key", "left_semi").select("key", "e")
    ranked = checkpoint(queries.mapInArrow(probe, "key long, lists array<int>"))
    probing = lambda of, begin, n: of.join(ranked, "key").select("key", "e", "bound", F.explode(F.slice("lists", begin, n)).alias("list"))
    unbound = queries.withColumn("bound", F.lit(None).cast("double"))
    hits = checkpoint(_scan(data, probing(unbound, 1, FIRST), k + 1))
    if probes > FIRST:
        kth = F.get(F.sort_array(F.collect_list("score"), False), k)  # FIRST * (k + 1) at most a block; null: fewer found
        bounds = hits.groupBy("key").agg((2 - 2 * kth + 1e-6).alias("bound"))
        hits = hits.unionByName(_scan(data, probing(queries.join(bounds, "key", "left"), FIRST + 1, probes), k + 1))
    one = hits.select("key", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = one.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    top = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    mine = asked.join(top, "key").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("p", "r")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.s")).alias("score"))
