"""Calendar operators: duplicates, gaps, splits, cutoffs, targets.  Months are integers (t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHASES, span_bucket


def sum_duplicates(rows: DataFrame, policy: str = "sum") -> DataFrame:
    """One row per (well, month): null-aware phase sums, or an error on duplicates."""
    out = rows.groupBy("well_id", "t").agg(*(F.sum(p).alias(p) for p in PHASES), F.count("*").alias("_n"))
    if policy == "error":
        out = out.filter(F.when(F.col("_n") > 1, F.raise_error(F.format_string("duplicate month %s of %s", "t", "well_id"))).otherwise(F.lit(True)))
    return out.drop("_n")


def fill_gaps(rows: DataFrame, policy: str = "missing") -> DataFrame:
    """Every month between a well's first and last: inserted months are null ("missing"), zero
    ("zero") or an error ("error"); reported rows keep their values.  Adds inserted (boolean)."""
    if policy not in ("missing", "zero", "error"):
        raise ValueError(f"unknown gap policy {policy!r}")
    span = rows.groupBy("well_id").agg(F.explode(F.sequence(F.min("t"), F.max("t"))).alias("t"))
    out = span.join(rows.withColumn("_seen", F.lit(True)), ["well_id", "t"], "left").withColumn("inserted", F.col("_seen").isNull()).drop("_seen")
    if policy == "error":
        return out.filter(F.when(F.col("inserted"), F.raise_error(F.format_string("missing month %s of %s", "t", "well_id"))).otherwise(F.lit(True)))
    if policy == "zero":
        out = out.withColumns({p: F.when(F.col("inserted"), 0.0).otherwise(F.col(p)) for p in PHASES})
    return out


def breaks(rows: DataFrame) -> DataFrame:
    """Rows whose month doesn't follow the well's one before: well_id, t, before."""
    w = Window.partitionBy("well_id").orderBy("t")
    return rows.select("well_id", "t", F.lag("t").over(w).alias("before")).filter("before IS NOT NULL AND t <> before + 1")


def split_at(rows: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """Adds split (train, holdout) and h (1-based in the holdout); wells without training rows or
    with too few rows after the cutoff are left out."""
    whole = Window.partitionBy("well_id")
    x = rows.withColumns({"_pos": F.row_number().over(whole.orderBy("t")), "_train": F.sum((F.col("t") <= cutoff).cast("int")).over(whole), "_n": F.count("*").over(whole)})
    x = x.filter((F.col("_train") >= 1) & (F.col("_train") + horizon <= F.col("_n")) & (F.col("_pos") <= F.col("_train") + horizon))
    h = (F.col("_pos") - F.col("_train")).cast("int")
    return x.withColumns({"split": F.when(h <= 0, "train").otherwise("holdout"), "h": F.when(h > 0, h)}).drop("_pos", "_train", "_n")


def skipped(rows: DataFrame, split: DataFrame) -> DataFrame:
    return rows.select("well_id").distinct().join(split.select("well_id").distinct(), "well_id", "left_anti")


def truncate(rows: DataFrame, months: int) -> DataFrame:
    """The first ``months`` rows of each series."""
    w = Window.partitionBy("well_id").orderBy("t")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= months).drop("_n")


def concatenate(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Train and holdout rows; a holdout that doesn't begin a month later is an error."""
    ends = train.groupBy("well_id").agg(F.max("t").alias("_end")).join(holdout.groupBy("well_id").agg(F.min("t").alias("_begin")), "well_id", "full")
    ok = F.coalesce(F.col("_begin") == F.col("_end") + 1, F.lit(False))
    ends = ends.filter(F.when(ok, True).otherwise(F.raise_error(F.format_string("holdout of %s doesn't follow its training months", "well_id").cast("string"))))
    return train.unionByName(holdout).join(ends.select("well_id"), "well_id", "left_semi")


def retrospective_cutoff(rows: DataFrame, horizon: int, lag: int) -> DataFrame:
    return rows.agg((F.max("t") - (horizon + lag)).alias("cutoff"))


def targets(rows: DataFrame, horizon: int, start: int | None = None) -> DataFrame:
    """well_id, h, t of forecast months after each well's last one, or from a common start (gap:
    months between).  A start before a well's next month gives a row with h null."""
    last = rows.groupBy("well_id").agg((F.max("t") + 1).alias("natural"))
    gap = F.lit(start) - F.col("natural") if start is not None else F.lit(0)
    last = last.withColumn("gap", gap.cast("int"))
    out = last.withColumn("h", F.when(F.col("gap") >= 0, F.sequence(F.lit(1), F.lit(horizon))))
    return out.select("well_id", "gap", "natural", F.explode_outer("h").alias("h")).select("well_id", "gap", "h", (F.col("natural") + F.col("gap") + F.col("h") - 1).alias("t"))


def availability(rows: DataFrame) -> DataFrame:
    """well_id, and whether each phase has any reported month."""
    return rows.groupBy("well_id").agg(*((F.count(p) > 0).alias(p) for p in PHASES))


def availability_counts(rows: DataFrame) -> DataFrame:
    """wells, and how many have any reported month of each phase."""
    return availability(rows).agg(F.count("*").alias("wells"), *(F.count_if(p).alias(p) for p in PHASES))


def primary_phase(rows: DataFrame) -> DataFrame:
    """Oil if its total is a sixth of gas's or more."""
    pos = lambda p: F.coalesce(F.sum(F.greatest(F.col(p), F.lit(0.0))), F.lit(0.0))
    return rows.groupBy("well_id").agg(F.when(pos("oil") >= pos("gas") / 6, "oil").otherwise("gas").alias("primary_phase"))


def eligible(rows: DataFrame, cutoff: int, horizon: int = 12, least: int = 7, most: int = 48, reported: int = 11) -> DataFrame:
    """Wells with a span of train months within bounds, enough reported holdout months and some
    positive oil or gas; span, bucket."""
    train, hold = F.col("t") <= cutoff, F.col("t").between(cutoff + 1, cutoff + horizon)
    any_pos = (F.coalesce(F.col("oil"), F.lit(0.0)) > 0) | (F.coalesce(F.col("gas"), F.lit(0.0)) > 0)
    x = rows.groupBy("well_id").agg(F.min(F.when(train & any_pos, F.col("t"))).alias("first"), F.count_if(hold & F.col("oil").isNotNull()).alias("held"))
    x = x.filter("first IS NOT NULL").withColumn("span", F.lit(cutoff) - F.col("first") + 1)
    return x.filter(F.col("span").between(least, most) & (F.col("held") >= reported)).select("well_id", F.col("span").cast("int").alias("span"), F.col("held").cast("int").alias("held"), span_bucket(F.col("span")).alias("bucket"))


def play_case(basin: Column, interval: Column) -> Column:
    """Play by basin and interval, as a chain of conditions."""
    b, i = F.upper(basin), F.upper(interval)
    return F.when(b.contains("EAGLE"), "eagle_ford").when(b.contains("DELAWARE") | i.contains("BONE SPRING"), "delaware").when(b.contains("MIDLAND"), "midland").when(i.rlike("NIOBRARA|CODELL"), "dj").otherwise(F.lower(basin))
