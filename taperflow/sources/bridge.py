"""Monthly series from the star-schema tables.

Each view has the engine's columns: well_id, t (month number), oil, gas, water.  ``decline`` is
made of supplier months and account balances so that it falls like a producing well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import PHASES, month_number

FIRST_MONTH = 1995 * 12
#: The series run from month 0 to 82; queries that hold months out train up to this one.
CUT = 70


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Volumes of line items by a key and shipping month."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col(key).alias("well_id"), (month_number(F.col("l_shipdate")) - FIRST_MONTH).alias("t"), "l_quantity", "l_extendedprice", "l_discount")
    return rows.groupBy("well_id", "t").agg(F.sum("l_quantity").alias("oil"), (F.sum("l_extendedprice") / 1000).alias("gas"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("water"))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir, "l_suppkey")


def part_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir, "l_partkey")


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, pad (nation), play (region)."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("well_id"), F.col("n_name").alias("pad"), F.col("r_name").alias("play"))


def decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, t, oil, gas, water: all months of all suppliers."""
    m = supplier_series(spark, sf_dir).select("well_id", "t", F.col("oil").alias("x"))
    mean = m.groupBy("well_id").agg(F.avg("x").alias("mean"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well_id"), "s_acctbal")
    rows = m.join(mean, "well_id").join(s, "well_id")
    b, d = 0.3 + 0.05 * (F.col("well_id") % 20), 0.02 + 0.01 * (F.col("well_id") % 7)
    oil = (2000 + F.abs("s_acctbal")) * F.pow(1 + b * d * F.col("t"), -1 / b) * F.pow(F.col("x") / F.col("mean"), 0.25)
    return rows.select("well_id", "t", oil.alias("oil")).select("well_id", "t", "oil", (F.col("oil") * (2 + 0.01 * F.col("t"))).alias("gas"), (F.col("oil") * 0.4 * F.exp(-0.005 * F.col("t"))).alias("water"))


def longer(series: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """well_id, phase, t, q."""
    return series.unpivot(["well_id", "t"], list(phases), "phase", "q")


# The same for DuckDB.
MONTHLY_SQL = """SELECT {key} AS well_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, sum(l_quantity) AS oil,
  sum(l_extendedprice) / 1000e0 AS gas, sum(l_quantity * l_discount) AS water FROM lineitem GROUP BY 1, 2"""
SUPPLIER_SQL = MONTHLY_SQL.format(key="l_suppkey")
PART_SQL = MONTHLY_SQL.format(key="l_partkey")
WELLS_SQL = "SELECT s_suppkey AS well_id, n_name AS pad, r_name AS play FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
DECLINE_SQL = f"""SELECT well_id, t, oil, oil * (2e0 + 0.01e0 * t) AS gas, oil * 0.4e0 * exp(-0.005e0 * t) AS water FROM (
  SELECT m.well_id, m.t, (2000e0 + abs(s_acctbal)) * power(1e0 + (0.3e0 + 0.05e0 * (m.well_id % 20)) * (0.02e0 + 0.01e0 * (m.well_id % 7)) * m.t, -1e0 / (0.3e0 + 0.05e0 * (m.well_id % 20)))
    * power(m.oil / avg(m.oil) OVER (PARTITION BY m.well_id), 0.25e0) AS oil
  FROM ({SUPPLIER_SQL}) m JOIN supplier ON s_suppkey = m.well_id)"""
LONG_SQL = "SELECT well_id, t, 'oil' AS phase, oil AS q FROM ({s}) UNION ALL SELECT well_id, t, 'gas', gas FROM ({s}) UNION ALL SELECT well_id, t, 'water', water FROM ({s})"
DECLINE_LONG_SQL = f"WITH d AS ({DECLINE_SQL}) " + LONG_SQL.replace("({s})", "d")
