"""Submissions: forecasts and failures as rows, validation, providers and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import PHASES

KEY = ["well_id", "phase"]


def generate(units: DataFrame, forecasts: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(rows, failures).  units: well_id, phase, available, and optionally gap (months between the
    natural and the asked start; under 0: a date error) and problem (a provider's error); forecasts:
    well_id, phase, h, volume, from each well's natural start.
    A unit either has all months h of the asked window (h from 1), finite and not negative, or one
    failure row with a reason: date_error, phase_unavailable, provider_error, forecast_missing,
    length_mismatch:n or nonfinite_or_negative_forecast."""
    gap = F.coalesce(F.col("gap"), F.lit(0)) if "gap" in units.columns else F.lit(0)
    problem = F.col("problem") if "problem" in units.columns else F.lit(None).cast("string")
    x = units.select(*KEY, "available", gap.alias("gap"), problem.alias("problem"))
    f = forecasts.join(x.select(*KEY, "gap"), KEY).withColumn("h", F.col("h") - F.col("gap")).filter((F.col("h") >= 1) & ((F.col("gap") == 0) | (F.col("h") <= horizon))).drop("gap")
    bad = F.col("volume").isNull() | F.isnan("volume") | (F.abs("volume") == float("inf")) | (F.col("volume") < 0)
    told = forecasts.select(*KEY).distinct().withColumn("_any", F.lit(True))
    seen = f.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    x = x.join(told, KEY, "left").join(seen, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("gap") < 0, "date_error: the start is before the well's next month").when(~F.col("available"), "phase_unavailable")
    reason = reason.when(F.col("problem").isNotNull(), F.concat(F.lit("provider_error: "), F.col("problem"))).when(F.col("_any").isNull(), "forecast_missing")
    reason = reason.when(F.col("n") != horizon, F.concat(F.lit("length_mismatch:"), F.col("n").cast("string"))).when(F.col("bad") > 0, "nonfinite_or_negative_forecast")
    x = x.withColumn("reason", reason)
    good = x.filter("reason IS NULL").select(*KEY)
    return f.join(good, KEY, "left_semi").withColumn("volume", F.round("volume", 6)), x.filter("reason IS NOT NULL").select(*KEY, "reason")


def validate_input(wells: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row: wells, metadata_rows, and wells that have each phase.  No wells, and metadata that names
    a well twice, are errors."""
    from .calendar import availability_counts

    counts = availability_counts(wells)
    counts = counts.filter(F.when(F.col("wells") > 0, True).otherwise(F.raise_error(F.lit("no wells loaded")).cast("boolean")))
    if metadata is None:
        return counts.withColumn("metadata_rows", F.lit(0).cast("long"))
    twice = metadata.groupBy("well_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("metadata_rows"))
    twice = twice.filter(F.when(F.coalesce("most", F.lit(0)) <= 1, True).otherwise(F.raise_error(F.lit("metadata repeats a well_id")).cast("boolean")))
    return counts.join(twice.select(F.coalesce("metadata_rows", F.lit(0)).alias("metadata_rows")))  # one row each


def overrides(base: DataFrame, approved: DataFrame) -> DataFrame:
    """Whole approved vectors replace base vectors (well, phase)."""
    key = approved.select(*KEY).distinct()
    return base.join(key, KEY, "left_anti").unionByName(approved.select(*base.columns))


def coalesce_providers(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first provider's vector where it has one, else the second's: all or nothing."""
    return first.unionByName(second.join(first.select(*KEY).distinct(), KEY, "left_anti"))


def unknown_wells(approved: DataFrame, wells: DataFrame) -> DataFrame:
    return approved.select("well_id").distinct().join(wells.select("well_id"), "well_id", "left_anti")


def problems(rows: DataFrame, horizon: int) -> DataFrame:
    """Violations of a submission: problem, well_id, phase.  Missing columns are an error."""
    missing = [c for c in (*KEY, "volume") if c not in rows.columns]
    if missing:
        raise ValueError(f"the submission has no column {', '.join(missing)}")
    phase = rows.filter(~F.col("phase").isin(*PHASES)).select(F.lit("unknown_phase").alias("problem"), *KEY)
    value = rows.filter(F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") < 0)).select(F.lit("bad_volume").alias("problem"), *KEY)
    count = rows.groupBy(*KEY).count().filter(F.col("count") != horizon).select(F.lit("wrong_horizon").alias("problem"), *KEY)
    return phase.unionByName(value).unionByName(count)


def render(rows: DataFrame, mapping: list[dict], header: list[str] | None = None) -> DataFrame:
    """Columns by a mapping of {"name", "source"} or {"name", "constant"}; names are unique and, with
    a template's header, equal to it."""
    names = [m["name"] for m in mapping]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    if header is not None and names != header:
        raise ValueError(f"the columns {names} aren't the template's {header}")
    for m in mapping:
        if ("source" in m) == ("constant" in m):
            raise ValueError(f"column {m['name']!r} needs either a source or a constant")
    return rows.select(*((F.col(m["source"]) if "source" in m else F.lit(m["constant"])).alias(m["name"]) for m in mapping))
