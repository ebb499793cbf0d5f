"""Language identification by nearest centroids.

A text is a TF-IDF vector of byte n-grams (lengths 1 to 3 of its lower-cased letters, everything
else one space, hashed to ``DIMS`` places), with logarithmic term frequencies, scaled to length
1.  Each language has several centroids (spherical k-means over its training vectors); the
language of the nearest centroid by cosine is predicted.  A prediction is rejected if the cosine
distance to that centroid is larger than almost all distances of the language's own training
texts (a quantile of them, times a margin).

Centroids and distances are fitted on a bounded sample: at most ``PER_LANGUAGE`` training rows a
language and about ``SAMPLE`` rows in all, those of smallest hash, of which ids are chosen first and
texts read after.  Every language of the training rows is learned, however many there are.
Document frequencies are counted over all training rows, and everything else reads all rows and
whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; with
no training rows every text is ``und``; repeated rows give repeated results; extra columns are
ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, doc_crc32, near_first, slices

DIMS = 1 << 13
PER_LANGUAGE = 1500
#: Rows in all; a language has at least LEAST of them, so many languages share fewer each.
SAMPLE, LEAST = 60_000, 20
CENTROIDS = 4
#: A distance counts as too large beyond this quantile of the language's own, times the margin.
QUANTILE, MARGIN = 0.999, 1.25
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_ASCII = bytes(c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)) + bytes(range(128, 256))


def _letters(text: str) -> bytes:
    """Lower-cased UTF-8 in which each run of other characters is one space."""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    return _NOT_LETTER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text."""
    out = np.zeros(DIMS, np.int64)
    for part in slices(text):
        x = np.frombuffer(b" " + _letters(part) + b" ", np.uint8).astype(np.uint32)
        if len(x) <= 2:
            continue
        two = x[:-1] * np.uint32(257) + x[1:]
        three = two[:-1] * np.uint32(65599) + x[2:] * np.uint32(2654435761)
        two = two * np.uint32(2246822519)
        for h in (x * np.uint32(3266489917), two, three):
            out += np.bincount((h ^ h >> np.uint32(15)) % np.uint32(DIMS), minlength=DIMS)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language's place in the list
    reach: np.ndarray  # largest accepted distance, by language

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(c).astype(np.float32) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected)."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        some = [k for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            cos = self.vectors(np.stack([counts(texts[k]) for k in part])) @ self.centroids.T
            best = cos.argmax(axis=1)
            for k, b, c in zip(part, best.tolist(), cos.max(axis=1).tolist(), strict=True):
                lang = self.owner[b]
                out[k] = (self.languages[lang], float(min(1.0, max(0.0, c))), bool(1 - c > self.reach[lang]))
        return out


def _k_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest points."""
    c = [_unit(v.mean(axis=0))]
    while len(c) < min(k, len(v)):
        c.append(v[np.argmin(np.max(v @ np.stack(c).T, axis=1))])
    c = np.stack(c)
    for _ in range(rounds):
        of = (v @ c.T).argmax(axis=1)
        c = np.stack([_unit(v[of == i].mean(axis=0)) if (of == i).any() else c[i] for i in range(len(c))])
    return c


def _weigh(part: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """The vectors of these (place, count) rows, as ``Model.vectors`` makes them, in one matrix."""
    m = np.zeros((len(part), DIMS), np.float32)
    for k, (at, n) in enumerate(part):
        m[k, at] = n
    np.log1p(m, out=m)
    m *= idf
    m /= np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m))[:, None], 1e-12)
    return m


def inverse_frequencies(df: np.ndarray, total: int) -> np.ndarray:
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


def fit_rows(rows: Iterable[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, centroids: int = CENTROIDS) -> Model:
    """From (language, places, counts) of a bounded sample in order of language: the vectors of
    one language are held at a time."""
    languages, parts, reach = [], [], []
    for lang, group in groupby(rows, key=lambda r: r[0]):
        part = [(at, n) for _, at, n in group if len(at)]
        if part:
            v = _weigh(part, idf)
            languages.append(lang)
            parts.append(_k_means(v, centroids))
            reach.append(min(0.98, MARGIN * float(np.quantile(1 - (v @ parts[-1].T).max(axis=1), QUANTILE))))
    model = Model(languages, idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    if languages:
        model.centroids = np.concatenate(parts).astype(np.float32)
        model.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        model.reach = np.array(reach)
    return model


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of docs each place occurs, and how many texts have any: one pass, of
    which DIMS + 1 rows a task are shuffled."""

    def run(batches):
        df = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                hit = counts(t.as_py() or "") > 0
                df[:DIMS] += hit
                df[DIMS] += hit.any()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["place", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for place, n in docs.select(F.col("text").cast("string")).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n")).collect():  # DIMS + 1 rows at most
        df[place] = n
    return df[:DIMS], int(df[DIMS])


def fit(docs: DataFrame, training: F.Column, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Fit on the rows for which ``training`` holds: per_language rows of each language at most for
    the centroids, all for the document frequencies."""
    able = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = {r[0]: r[1] for r in able.groupBy("lang").count().collect()}  # a row a language
    per_language = min(per_language, max(LEAST, sample // max(1, len(langs))))
    near = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary"))
    order = Window.partitionBy("lang").orderBy(near, "doc_id")
    chosen = near_first(able.select("doc_id", "lang"), near, "lang", langs, per_language)
    chosen = chosen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_language)
    ids = chosen.select("doc_id").distinct()  # about SAMPLE rows, or LEAST a language
    some = able.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                c = counts(text.as_py())
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<i2").tobytes()], pa.binary()), pa.array([c[at].astype("<u4").tobytes()], pa.binary())], names=["lang", "at", "n"])

    found = checkpoint(some.mapInArrow(run, "lang string, at binary, n binary")).repartitionByRange("lang").sortWithinPartitions("lang", "at", "n")
    idf = inverse_frequencies(*document_frequencies(able))
    return fit_rows(((r["lang"], np.frombuffer(r["at"], "<i2"), np.frombuffer(r["n"], "<u4")) for r in found.toLocalIterator()), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected, for every row and whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS * DIMS floats a language

    def run(batches):
        for b in batches:
            got = held.value.predict([t.as_py() for t in b.column(1)]) if len(b) else []
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is recognised, with the columns they had."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            got = held.value.predict([t.as_py() for t in b.column(place)])
            yield b.filter(pa.array([not rejected for _, _, rejected in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> F.Column:
    return doc_crc32() % 3 == 1
