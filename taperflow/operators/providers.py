"""Forecast providers: functions from training months to forecasts, and registries of them.

A provider takes (rows, horizon) with rows well_id, phase, t, q and returns well_id, phase, h (from 1),
volume.  A unit that it can't forecast has no row, which is reported as missing, never as zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arps, control
from .packed import each, pack, reported

Provider = Callable[[DataFrame, int], DataFrame]
KEY = ["well_id", "phase"]


def exploded(volumes: DataFrame) -> DataFrame:
    """KEY, h, volume of KEY, v (an array, null without a forecast)."""
    return volumes.select(*KEY, F.posexplode("v").alias("h", "volume")).withColumn("h", (F.col("h") + 1).cast("int"))


def from_model(fit: Callable[[np.ndarray], Callable[[int], np.ndarray] | None]) -> Provider:
    """A provider of a model function: it takes the reported volumes of a series and returns what
    forecasts n months, or None.  A forecast of another length is an error."""

    def provide(rows: DataFrame, horizon: int) -> DataFrame:
        def one(q: np.ndarray):
            model = fit(q)
            if model is None:
                return None
            v = np.asarray(model(horizon), float)
            if v.shape != (horizon,):
                raise ValueError(f"the model returned {v.shape}, not {horizon} months")
            return v

        packed = pack(rows).withColumn("q", reported())
        return exploded(each(packed, KEY, "v array<double>", lambda batch: [{"v": [one(q) for q in batch]}]))

    return provide


def arm(name: str) -> Provider:
    """A decline-curve arm."""

    def provide(rows: DataFrame, horizon: int) -> DataFrame:
        return arps.forecast(arps.fit(rows, arps.arms_table(rows.sparkSession, [name])), horizon).drop("arm")

    return provide


def precomputed(vectors: DataFrame) -> Provider:
    """A provider of stored vectors (well_id, phase, h, volume).  A vector whose months aren't
    1 .. horizon is an error; a unit without a vector is missing."""

    def provide(rows: DataFrame, horizon: int) -> DataFrame:
        seen = vectors.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("h").alias("d"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        fits = (F.col("n") == horizon) & (F.col("d") == horizon) & (F.col("lo") == 1) & (F.col("hi") == horizon)
        told = F.raise_error(F.format_string(f"the vector of %s, %s has %s months, not {horizon}", F.col("well_id").cast("string"), "phase", F.col("n").cast("string")))
        good = seen.filter(F.when(fits, F.lit(True)).otherwise(told.cast("boolean"))).select(*KEY)
        return vectors.select(*KEY, "h", "volume").join(rows.select(*KEY).distinct(), KEY, "left_semi").join(good, KEY, "left_semi")

    return provide


def with_overrides(base: Provider, approved: DataFrame) -> Provider:
    """Whole approved vectors (well_id, phase, h, volume) in place of the base provider's."""
    from .submission import overrides

    return lambda rows, horizon: overrides(base(rows, horizon).select(*KEY, "h", "volume"), approved)


class Registry:
    """Providers by name; a name can't be taken twice."""

    def __init__(self, providers: dict[str, Provider] | None = None):
        self.providers: dict[str, Provider] = {}
        for name, provider in (providers or {}).items():
            self.add(name, provider)

    def add(self, name: str, provider: Provider) -> None:
        if name in self.providers:
            raise ValueError(f"there is already an arm {name!r}")
        self.providers[name] = provider

    def add_factory(self, name: str, factory: Callable[[DataFrame, DataFrame], Provider], pool: DataFrame, metadata: DataFrame) -> None:
        """An extra arm made from the training wells and their metadata."""
        self.add(name, factory(pool, metadata))

    def forecast(self, rows: DataFrame, horizon: int) -> DataFrame:
        """arm, KEY, h, volume of all providers."""
        out = None
        for name, provider in self.providers.items():
            part = provider(rows, horizon).select(F.lit(name).alias("arm"), *KEY, "h", "volume")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("the registry has no arms")
        return out


def standard() -> Registry:
    """The control and every decline-curve arm."""
    return Registry({"control": control.forecast, **{a[0]: arm(a[0]) for a in arps.ARMS}})
