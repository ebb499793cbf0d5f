"""Evaluation boards: duplicates, balanced order, roles, partitions, provenance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import method_label
from .lineage import cut

ROLES = ("eval", "cohort", "dev", "confirm", "confirm2", "confirm3")


def hash_order(column: str, salt: str) -> F.Column:
    """A frozen order of ids: MD5 of id and salt."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit("|" + salt)))


def series_hash(rows: DataFrame) -> DataFrame:
    """well_id, series_hash over the rounded months."""
    line = F.concat_ws(",", "t", *(F.coalesce(F.round(c, 3).cast("string"), F.lit("")) for c in ("oil", "gas", "water")))
    return rows.groupBy("well_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("t", line.alias("x"))))["x"], ";"), 256).alias("series_hash"))


def split_hashes(rows: DataFrame, cutoff: int) -> DataFrame:
    """well_id, train_hash, full_hash: of the months up to the cutoff, and of all."""
    train = series_hash(rows.filter(F.col("t") <= cutoff)).withColumnRenamed("series_hash", "train_hash")
    return series_hash(rows).withColumnRenamed("series_hash", "full_hash").join(train, "well_id", "left")


def well_key(play: F.Column, bucket: F.Column, order: F.Column) -> F.Column:
    """play|bucket|the first ten digits of the order's hash."""
    return F.concat_ws("|", play, bucket, F.substring(order, 1, 10))


def board_id(selected: DataFrame, basis: dict) -> str:
    """SHA-256 of the basis and the sorted (well_key, train_hash) of a board's wells as canonical
    JSON.  A board's wells are bounded by its roles."""
    keys = sorted([r["well_key"], r["train_hash"]] for r in selected.select("well_key", "train_hash").collect())
    return hashlib.sha256(json.dumps({**basis, "selected": keys}, sort_keys=True).encode()).hexdigest()


def provenance_summary(wells: DataFrame) -> DataFrame:
    """label, value, n, train_reported, holdout_reported (means), all_holdout, all_full (wells): by role
    and by play.  wells: role, play, train_fraction, holdout_fraction."""
    x = wells.select("train_fraction", "holdout_fraction", F.explode(F.array(F.struct(F.lit("role").alias("label"), F.col("role").alias("value")), F.struct(F.lit("play").alias("label"), F.col("play").alias("value")))).alias("g"))
    whole = F.col("holdout_fraction") >= 1
    finite = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return x.groupBy("g.label", "g.value").agg(F.count("*").alias("n"), finite("train_fraction").alias("train_reported"), finite("holdout_fraction").alias("holdout_reported"), F.count_if(whole).alias("all_holdout"), F.count_if(whole & (F.col("train_fraction") >= 1)).alias("all_full"))


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of undirected edges (u, v; u > v).

    Alternating steps: each node's larger neighbours are linked to the least of its neighbourhood,
    then all but the least neighbour of a node are linked to that one.  Paths shrink by half or so
    each round; rounds are checkpointed and go on until the edges don't change.
    """
    edges, last = cut(edges.filter("u > v").distinct()), None
    while True:
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            break
        last = sign
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def collapse_duplicates(wells: DataFrame) -> DataFrame:
    """well_id, cluster, keep.  Wells with an equal api or an equal series hash are one cluster
    (transitively); blank apis link nothing.  The smallest order (column ord, one a well) is kept.

    Wells are linked to the smallest of each key, so there are no pairs, however common a key is.
    """
    x = cut(wells.select("well_id", "ord", "api", "series_hash"))
    edges = None
    for key, rows in (("api", x.filter("trim(api) <> ''")), ("series_hash", x.filter("series_hash IS NOT NULL"))):
        part = rows.join(rows.groupBy(key).agg(F.min("ord").alias("v")), key).select(F.col("ord").alias("u"), "v")
        edges = part if edges is None else edges.unionByName(part)
    roots = connected(edges)
    y = x.join(roots, x["ord"] == roots["node"], "left").withColumn("cluster", F.coalesce("root", "ord"))
    first = F.row_number().over(Window.partitionBy("cluster").orderBy("ord", "well_id")) == 1
    return y.select("well_id", "cluster", first.alias("keep"))


def role_counts(sizes: dict[tuple, int], wanted: dict[str, int]) -> dict[str, dict[tuple, int]]:
    """Wells of each cell that each role takes, in round-robin over the sorted cells, starting
    from the first cell for every role: levels are filled like water.  A cell table, not wells."""
    left, out = dict(sizes), {}
    for role, n in wanted.items():
        if sum(left.values()) < n:
            raise ValueError(f"not enough wells for role {role}")
        level, taken = 0, {}
        while sum(min(v, level + 1) for v in left.values()) <= n and level < max(left.values(), default=0):
            level += 1
        taken = {c: min(v, level) for c, v in left.items()}
        rest = n - sum(taken.values())
        for c in sorted(left):
            if rest and left[c] > taken[c]:
                taken[c] += 1
                rest -= 1
        left = {c: left[c] - taken[c] for c in left}
        out[role] = taken
    return out


def assign_roles(wells: DataFrame, wanted: dict[str, int], cell: tuple[str, str] = ("play", "bucket"), order: str = "ord") -> DataFrame:
    """Adds role; wells of a cell are taken in their order, the rest is unused."""
    sizes = {(r[0], r[1]): r[2] for r in wells.groupBy(*cell).count().collect()}  # one row a cell
    counts, at, ranges = role_counts(sizes, wanted), dict.fromkeys(sizes, 0), []
    for role in wanted:
        for c, n in counts[role].items():
            if n:
                ranges.append((*c, role, at[c] + 1, at[c] + n))
                at[c] += n
    table = wells.sparkSession.createDataFrame(ranges, f"{cell[0]} string, {cell[1]} string, role string, low int, high int")
    x = wells.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))
    cond = [x[c].eqNullSafe(table[c]) for c in cell] + [x["_n"].between(table["low"], table["high"])]
    joined = x.join(F.broadcast(table), cond, "left")
    return joined.select(*(x[c] for c in wells.columns), F.coalesce("role", F.lit("unused")).alias("role"))


def partition(wells: DataFrame, salt: str, cell: tuple[str, ...] = ("role",)) -> DataFrame:
    """Every third well of a cell's hash order confirms, the others tune.  Where no well or every well
    would confirm, the first two thirds of one order over all wells tune and the rest confirm."""
    from .ordering import numbered

    rank = lambda s: F.sha2(F.concat_ws("|", F.lit(s), F.col("well_id").cast("string")), 256)
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(rank(salt))) - 1
    out = wells.withColumn("part", F.when(n % 3 == 0, "confirm").otherwise("tune"))
    tune, total = out.agg(F.count_if(F.col("part") == "tune"), F.count("*")).first()
    if 0 < tune < total or total < 2:
        return out
    cutoff = max(1, min(total - 1, round(2 * total / 3)))
    x = numbered(wells.withColumn("_rank", rank(salt + "-fallback")), ["_rank"], "_at")
    return x.withColumn("part", F.when(F.col("_at") < cutoff, "tune").otherwise("confirm")).drop("_rank", "_at")


def month_class(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One label per key of the methods reported: the common one, MIXED, or UNKNOWN."""
    s = F.collect_set(method_label(F.col("method")))
    x = rows.groupBy(*keys).agg(F.array_sort(F.array_except(s, F.array(F.lit("UNKNOWN")))).alias("s"))
    return x.select(*keys, F.when(F.size("s") == 0, "UNKNOWN").when(F.size("s") == 1, F.col("s")[0]).otherwise("MIXED").alias("method"))


def provenance(months: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and fractions of method labels."""
    n = F.count("*")
    known = ("REPORTED", "DCA", "MIXED", "UNKNOWN", "MISSING")
    m = F.col("method")
    return months.groupBy(*keys).agg(n.alias("months"), *(F.count_if(m == k).alias(k.lower()) for k in known), F.count_if(~m.isin(*known)).alias("other"), (F.count_if(m == "REPORTED") / n).alias("reported_fraction"), (F.count_if(m == "DCA") / n).alias("dca_fraction"))


def accepts(train: F.Column, hold: F.Column, mode: str, least_train: float = 0.0, least_hold: float = 1.0) -> F.Column:
    """Whole-well gate on reported fractions."""
    if mode == "mixed":
        return F.lit(True)
    if mode == "reported_holdout":
        return hold >= 1.0
    if mode == "reported_full":
        return (hold >= 1.0) & (train >= 1.0)
    if mode == "reported_threshold":
        return (hold >= least_hold) & (train >= least_train)
    raise ValueError(f"unknown provenance mode {mode!r}")


def day_classes(rows: DataFrame) -> DataFrame:
    """Months with no, some or a full month's producing days, by method."""
    d, full = F.col("days"), F.dayofmonth(F.last_day("month"))
    return rows.groupBy("method").agg(F.count_if(d == 0).alias("zero_days"), F.count_if((d > 0) & (d < full)).alias("partial_days"), F.count_if(d >= full).alias("full_days"))
