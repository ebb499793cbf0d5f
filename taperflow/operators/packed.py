"""Series as one row each, for the Arrow kernels.

A packed series has its key columns, ``first`` (the first month) and ``q``, an array with one value
a calendar month, null where nothing was reported.  Packing is the only shuffle of the months; origins,
hold-outs and windows are slices of the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["well_id", "phase"]
BATCH = 512


def pack(rows: DataFrame) -> DataFrame:
    """KEY, first, q of long rows (well_id, phase, t, q), one row a month.  Months between a series'
    first and last row without a row are null, as are NaN volumes."""
    told = F.col("q").isNotNull() & ~F.isnan("q")
    x = rows.groupBy(*KEY).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.map_from_entries(F.collect_list(F.when(told, F.struct("t", F.col("q").cast("double").alias("q"))))).alias("m"))
    return x.select(*KEY, "first", F.transform(F.sequence("first", "last"), lambda t: F.col("m")[t]).alias("q"))


def reported(q: str | Column = "q") -> Column:
    """The months that were reported, closed up."""
    return F.array_compact(q)


def each(packed: DataFrame, keys: list[str], fields: str, kernel: Callable[[list[np.ndarray]], list[dict[str, np.ndarray]]], q: str = "q") -> DataFrame:
    """keys and ``fields`` for each series: kernel takes a batch of series (NaN: null) and returns
    tables of columns, one row a series each (an array a row for array fields)."""
    types = {c: packed.schema[c].dataType.simpleString() for c in keys}
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                for table in kernel(_series(part.column(q))):
                    cols = [_column(table[n]) for n in names]
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *cols], names=[*keys, *names])

    return packed.select(*keys, q).mapInArrow(run, ", ".join([*(f"{k} {t}" for k, t in types.items()), fields]))


def _series(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten()
    values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0).to_numpy(zero_copy_only=False))
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _column(values) -> pa.Array:
    """A column of numbers (NaN: null), of text, or of a list of arrays."""
    if isinstance(values, list):
        return pa.array(values, pa.string()) if values and isinstance(values[0], str) else pa.array(values, pa.list_(pa.float64()))
    if values.ndim == 2:
        return pa.array(list(values), pa.list_(pa.float64()))
    return pa.array(values, from_pandas=True)


def padded(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The series as rows of a matrix (0 beyond their ends), and their lengths."""
    n = np.array([len(s) for s in series], int)
    out = np.zeros((len(series), max(1, n.max(initial=0))))
    for k, s in enumerate(series):
        out[k, : len(s)] = s
    return out, n


def windows(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row from its start on, and which places belong to its window."""
    width = max(1, int(size.max(initial=0)))
    at = start[:, None] + np.arange(width)
    return np.take_along_axis(x, np.minimum(at, x.shape[1] - 1), axis=1), np.arange(width) < size[:, None]


def line(t: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of least squares along axis 1 over the places ``on``; NaN if the t of a
    row don't differ."""
    with np.errstate(all="ignore"):
        n = on.sum(axis=1)
        tm = np.where(on, t, 0).sum(axis=1) / n
        ym = np.where(on, y, 0).sum(axis=1) / n
        dt = np.where(on, t - np.expand_dims(tm, 1), 0)
        var = (dt * dt).sum(axis=1)
        slope = np.where(var > 0, (dt * np.where(on, y - np.expand_dims(ym, 1), 0)).sum(axis=1) / var, np.nan)
        return slope, ym - slope * tm


def median(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Along axis 1 over the places ``on``; NaN where there are none."""
    s = np.sort(np.where(on, x, np.inf), axis=1)
    n = on.sum(axis=1)
    pick = lambda k: np.take_along_axis(s, np.expand_dims(np.maximum(k, 0), 1), axis=1).squeeze(1)
    return np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan)
