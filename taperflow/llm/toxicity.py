"""Toxicity by a classifier chain.

Categories are predicted one after another.  The model of each is a logistic regression on
hashed word presence plus the probabilities of the categories before it.  In training these
probabilities are out-of-fold predictions (each fold's rows are scored by a model that has not
seen them), so that later models meet inputs as uncertain as those at prediction time; at
prediction time the chain feeds its own probabilities on.

The chain is fitted on a bounded sample of labelled rows: at most ``PER_CLASS`` rows with and as
many without each category, those of smallest hash.  Word features are the places of a hashed
vocabulary that occur in ``MIN_DOCS`` sample texts at least, weighted by their log-count ratio
(how much more often they occur with the category than without).  Whole texts are read, in
training and in prediction.

Defined results: a null, empty or wordless text has no word features and takes the chain's
intercepts, but is never rejected for it: its probability is set to 0; unlabelled rows and null
labels take no part in training; a doc_id with several labels has a category if one of them says so; a category without both kinds of rows has the probability of
the kind it has; repeated rows give repeated results; extra columns are ignored by ``predict`` and kept by
``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import near_first, slices

DIMS = 1 << 20
PER_CLASS = 4000
MIN_DOCS = 3
FOLDS = 4
L2 = 1e-3
STEPS = 120
THRESHOLD = 0.4

_WORD = re.compile(r"[^\W\d_]{2,}")


def places(text: str | None) -> np.ndarray:
    """Sorted hashed places of the distinct words of the whole text."""
    words: set[str] = set()
    for part in slices(text or ""):
        words.update(_WORD.findall(part.lower()))
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) & np.uint32(DIMS - 1))


@dataclass
class Link:
    """One category's model: weights over hashed places and earlier probabilities."""

    name: str
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def margin(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        if len(self.place):
            for k, r in enumerate(rows):
                at = np.searchsorted(self.place, r)
                at[at == len(self.place)] = 0
                hit = self.place[at] == r
                out[k] += self.weight[at[hit]].sum()
        return out + before @ self.earlier if len(self.earlier) else out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_link(name: str, rows: list[np.ndarray], y: np.ndarray, before: np.ndarray) -> Link:
    """Logistic regression by accelerated gradient steps; classes weigh the same."""
    if not len(y) or y.min() == y.max():
        return Link(name, earlier=np.zeros(before.shape[1]), bias=20.0 if len(y) and y[0] else -20.0)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n >= MIN_DOCS
    new = np.cumsum(keep) - 1
    on = keep[at]
    row, at, place = row[on], new[at[on]], place[keep]
    # Log-count ratios tell which places matter before the first step.
    pos = np.bincount(at, weights=y[row], minlength=len(place)) + 0.25
    neg = np.bincount(at, weights=1 - y[row], minlength=len(place)) + 0.25
    ratio = np.log(pos / (y.sum() + 0.5)) - np.log(neg / ((1 - y).sum() + 0.5))
    value = ratio[at]
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, e, b = np.zeros(len(place)), np.zeros(before.shape[1]), 0.0
    wv, ev, bv, t = w, e, b, 1.0
    norms = np.bincount(row, weights=value**2, minlength=len(rows)) + (before**2).sum(axis=1) + 1
    step = 1 / (0.25 * float((share * norms).sum()) + L2)
    for _ in range(STEPS):
        p = _sigmoid(np.bincount(row, weights=wv[at] * value, minlength=len(rows)) + before @ ev + bv)
        d = share * (p - y)
        w2 = wv - step * (np.bincount(at, weights=d[row] * value, minlength=len(place)) + L2 * wv)
        e2, b2 = ev - step * (before.T @ d + L2 * ev), bv - step * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t2
        wv, ev, bv = w2 + k * (w2 - w), e2 + k * (e2 - e), b2 + k * (b2 - b)
        w, e, b, t = w2, e2, b2, t2
    return Link(name, place.astype(np.uint32), w * ratio, e, b)


@dataclass
class Chain:
    links: list[Link]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """One column per category, each fed to the later ones."""
        out = np.zeros((len(rows), 0))
        for link in self.links:
            out = np.column_stack([out, _sigmoid(link.margin(rows, out))])
        out[[not len(r) for r in rows]] = 0.0
        return out


def fit_chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """The chain in the order of ``labels``; later links see out-of-fold probabilities."""
    before = np.zeros((len(rows), 0))
    fold = np.arange(len(rows)) % folds
    links = []
    for name, y in labels.items():
        links.append(fit_link(name, rows, y, before))
        if name != list(labels)[-1]:
            p = np.zeros(len(rows))
            for f in range(folds):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = fit_link(name, [rows[k] for k in train], y[train], before[train])
                p[test] = _sigmoid(model.margin([rows[k] for k in test], before[test]))
            before = np.column_stack([before, p])
    return Chain(links)


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], per_class: int = PER_CLASS) -> Chain:
    """Fit on labelled rows: per_class rows of each value of each category at most."""
    able = labels.select("doc_id", *(F.col(c).cast("int").alias(c) for c in categories)).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    near = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    kinds = able.agg(*(F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in categories for v in (0, 1))).first()
    chosen = None
    for c in categories:
        order = Window.partitionBy(c).orderBy(near, "doc_id")
        likely = near_first(able, near, c, {v: kinds[f"{c}_{v}"] for v in (0, 1)}, per_class)
        part = likely.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class).drop("_n")
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.distinct()  # at most 2 * per_class * categories rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            got = [places(t.as_py()).astype("<u4").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in categories), pa.array(got, pa.binary())], names=["doc_id", *categories, "places"])

    schema = ", ".join(["doc_id long", *(f"{c} int" for c in categories), "places binary"])
    got = sorted(((r["doc_id"], np.frombuffer(r["places"], "<u4"), tuple(r[c] for c in categories)) for r in sample.select(F.col("doc_id").cast("long"), *categories, "text").mapInArrow(run, schema).toLocalIterator()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    y = np.array([r[2] for r in got], float).reshape(len(got), len(categories))
    return fit_chain([r[1] for r in got], {c: y[:, k] for k, c in enumerate(categories)})


def predict(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability per category (p_<name>), and rejected (the last one's decision)."""
    held = docs.sparkSession.sparkContext.broadcast(chain)  # at most DIMS weights a category
    names = [f"p_{link.name}" for link in chain.links]

    def run(batches):
        for b in batches:
            p = held.value.probabilities([places(t.as_py()) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)], names=["doc_id", *names, "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names), "rejected boolean"]))


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain's last category doesn't reject, with the columns they had."""
    held = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            p = held.value.probabilities([places(t.as_py()) for t in b.column(place)])
            yield b.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
