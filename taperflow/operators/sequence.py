"""Sequence idioms over long series (well_id, phase, t, q) as windows: no per-series loops."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = ["well_id", "phase"]
TERMINAL = -log(1 - 0.06) / 12


def _w(order: str = "t"):
    return Window.partitionBy(*BY).orderBy(order)


def positive() -> F.Column:
    return F.col("q").isNotNull() & (F.col("q") > 0)


def first_peak(rows: DataFrame) -> DataFrame:
    """well_id, phase, peak (the earliest month of the largest volume), peak_q."""
    return rows.filter("q IS NOT NULL").groupBy(*BY).agg(F.max_by("t", F.struct("q", -F.col("t"))).alias("peak"), F.max("q").alias("peak_q"))


def trailing(rows: DataFrame, n: int, only_positive: bool = False) -> DataFrame:
    """The last n reported (or positive) rows; back counts from 1 at the newest."""
    x = rows.filter(positive() if only_positive else F.col("q").isNotNull())
    return x.withColumn("back", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("t")))).filter(F.col("back") <= n)


def zero_streak(rows: DataFrame) -> DataFrame:
    """Trailing reported zeros; missing months don't end the streak."""
    last = F.max(F.when(F.col("q") > 0, F.col("t"))).over(Window.partitionBy(*BY))
    x = rows.withColumn("_last", last)
    return x.groupBy(*BY).agg(F.count_if((F.col("q") <= 0) & (F.col("_last").isNull() | (F.col("t") > F.col("_last")))).alias("streak"))


def log_steps(rows: DataFrame) -> DataFrame:
    """First and second differences of ln q over the positive rows."""
    x = rows.filter(positive()).withColumn("d1", F.ln("q") - F.lag(F.ln("q")).over(_w()))
    return x.withColumn("d2", F.col("d1") - F.lag("d1").over(_w()))


def interpolate(rows: DataFrame) -> DataFrame:
    """Missing q by straight lines between neighbours, flat at the ends; 0 if nothing is known."""
    before, after = _w().rowsBetween(Window.unboundedPreceding, 0), _w().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("q").isNotNull(), F.col("t"))
    x = rows.withColumns({"q0": F.last("q", True).over(before), "t0": F.last(at, True).over(before), "q1": F.first("q", True).over(after), "t1": F.first(at, True).over(after)})
    line = F.col("q0") + (F.col("q1") - F.col("q0")) * (F.col("t") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0))
    return x.withColumn("q", F.coalesce("q", line, "q0", "q1", F.lit(0.0))).drop("q0", "t0", "q1", "t1")


def sanitize(rows: DataFrame) -> DataFrame:
    return interpolate(rows).withColumn("q", F.greatest("q", F.lit(0.0)))


def terminal_decline(rows: DataFrame, monthly: float = TERMINAL) -> DataFrame:
    """Never rising, and from the first month whose decline is slower than the terminal one, that
    exponential."""
    x = sanitize(rows).withColumn("q", F.min("q").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    slow = F.ln(F.greatest("q", F.lit(1e-9)) / F.greatest(F.lead("q").over(_w()), F.lit(1e-9))) < monthly
    x = x.withColumn("_s", F.when(slow, F.col("t")))
    whole = Window.partitionBy(*BY)
    x = x.withColumn("_s", F.min("_s").over(whole)).withColumn("_q0", F.max(F.when(F.col("t") == F.col("_s"), F.col("q"))).over(whole))
    start = F.first("q").over(_w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tail = F.col("_q0") * F.exp(-monthly * (F.col("t") - F.col("_s")))
    return x.withColumn("_f", start).withColumn("q", F.when((F.col("_f") > 0) & (F.col("t") > F.col("_s")), tail).otherwise(F.col("q"))).drop("_s", "_q0", "_f")


def level_break(rows: DataFrame, last: int = 2, prior: int = 6) -> DataFrame:
    """Median of the newest positive reports over that of the block before them."""
    x = trailing(rows, last + prior)
    pos = lambda a, b: F.median(F.when(F.col("back").between(a, b) & (F.col("q") > 0), F.col("q")))
    enough = (F.count("*") == last + prior) & (F.count_if((F.col("back") > last) & (F.col("q") > 0)) >= 3)
    return x.groupBy(*BY).agg(F.when(enough, pos(1, last) / pos(last + 1, last + prior)).alias("ratio"))


def past_recovery(rows: DataFrame) -> DataFrame:
    """Whether a deep dip was ever followed, within three months, by twice its volume."""
    recent = trailing(rows, 12, True).groupBy(*BY).agg(F.median("q").alias("_m"))
    many = rows.filter(positive()).groupBy(*BY).agg((F.count("*") >= 6).alias("_many"))
    n = Window.partitionBy(*BY)
    ahead = F.max("q").over(_w().rowsBetween(1, 3))
    x = rows.withColumns({"_next": ahead, "_i": F.row_number().over(_w()) - 1, "_n": F.count("*").over(n)}).join(recent, BY, "left").join(many, BY, "left")
    hit = F.col("_many") & (F.col("q") <= 0.35 * F.col("_m")) & (F.col("_next") > 2 * F.greatest("q", F.lit(1.0))) & F.col("_i").between(1, F.col("_n") - 3)
    return x.groupBy(*BY).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("recovered"))


def origins(rows: DataFrame, horizons: tuple[int, ...] = (3, 6), most: int = 2, least: int = 5) -> DataFrame:
    """Rolling backtest origins: well_id, phase, horizon, rank (0 the newest), cutoff (rows)."""
    n = rows.groupBy(*BY).agg(F.count("*").cast("int").alias("n"))
    grid = rows.sparkSession.createDataFrame([(h, r) for h in horizons for r in range(most)], "horizon int, rank int")
    x = n.crossJoin(F.broadcast(grid)).withColumn("cutoff", F.col("n") - F.col("horizon") * (F.col("rank") + 1))
    return x.filter(F.col("cutoff") >= F.greatest(F.col("horizon") + least, F.lit(8))).select(*BY, "horizon", "rank", "cutoff")


def fallback(rows: DataFrame, horizon: int, monthly: float | None = TERMINAL) -> DataFrame:
    """Median of the last three positive volumes, at terminal decline (or flat); zeros if none."""
    level = trailing(rows, 3, True).groupBy(*BY).agg(F.median("q").alias("level"))
    x = rows.select(*BY).distinct().join(level, BY, "left").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return x.select(*BY, "h", (F.coalesce("level", F.lit(0.0)) * (F.exp(-monthly * F.col("h")) if monthly else 1)).alias("volume"))


def balanced_order(rows: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Round-robin over cells: position (from 1)."""
    from .ordering import numbered

    x = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))
    return numbered(x, ["_r", *cell], "_at").withColumn("position", (F.col("_at") + 1).cast("int")).drop("_r", "_at")


def common_keys(arms: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys that all of several tables have: one aggregation, however many there are."""
    every = None
    for k, arm in enumerate(arms):
        part = arm.select(*keys, F.lit(k).alias("_arm"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*keys).agg(F.count_distinct("_arm").alias("_n")).filter(F.col("_n") == len(arms)).drop("_n")
