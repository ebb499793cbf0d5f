"""Normalisation, calendar, join, aggregation, window, ordering and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import board, calendar, providers, sequence, submission
from ..sources import bridge, sinks
from ..sources.bridge import DECLINE_LONG_SQL, DECLINE_SQL, PART_SQL, SUPPLIER_SQL, WELLS_SQL, table
from .registry import query, r6

PART = f"part AS MATERIALIZED ({PART_SQL})"
SUP = f"sup AS MATERIALIZED ({SUPPLIER_SQL})"
DEC = f"dec AS MATERIALIZED ({DECLINE_SQL})"
LONG = f"lng AS MATERIALIZED ({DECLINE_LONG_SQL})"
W = f"w AS ({WELLS_SQL})"
ROUGH = f"""{LONG}, rough AS (SELECT well_id, phase, t, CASE WHEN (t + well_id) % 11 = 4 THEN NULL WHEN t >= 83 - (well_id % 4) THEN 0e0 WHEN (t + well_id) % 7 = 3 THEN q * 0.2e0 ELSE q END AS q FROM lng)"""


def _long(spark, sf):
    return bridge.longer(bridge.decline(spark, sf))


def _rough(spark, sf):
    """The decline series with missing months, dips and trailing zeros."""
    k = F.col("t") + F.col("well_id")
    q = F.when(k % 11 == 4, F.lit(None).cast("double")).when(F.col("t") >= 83 - F.col("well_id") % 4, 0.0).when(k % 7 == 3, F.col("q") * 0.2).otherwise(F.col("q"))
    return _long(spark, sf).select("well_id", "phase", "t", q.alias("q"))


# Projection and normalisation.


@query("prj_02_month_formats", "SELECT CASE WHEN o_orderkey % 6 < 5 THEN date_trunc('month', o_orderdate)::DATE END AS month, count(*) AS n FROM orders GROUP BY ALL")
def prj_02(spark, sf):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "MM/yyyy")).when(k == 3, F.date_format("o_orderdate", "yyyy/MM")).when(k == 4, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return table(spark, sf, "orders").select(columns.parse_month(text).alias("month")).groupBy("month").agg(F.count("*").alias("n"))


@query("prj_03_volume_parsing", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 3) AS parsed, round(sum(round(l_extendedprice, 2)) FILTER (WHERE l_linenumber <> 3), 2) AS total FROM lineitem GROUP BY ALL")
def prj_03(spark, sf):
    text = F.when(F.col("l_linenumber") != 3, F.concat(F.lit(" "), F.format_number("l_extendedprice", 2))).otherwise("n/a")
    x = table(spark, sf, "lineitem").select("l_returnflag", columns.parse_volume(text).alias("v"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("v").alias("parsed"), F.round(F.sum("v"), 2).alias("total"))


@query("prj_05_pad_default", "SELECT s_suppkey AS well_id, CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey::VARCHAR ELSE 'pad ' || s_nationkey END AS pad_id FROM supplier")
def prj_05(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("well_id"), F.when(F.col("s_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit("pad "), F.col("s_nationkey").cast("string"))).alias("p"))
    return s.select("well_id", columns.pad_or_self(F.col("p"), F.col("well_id")).alias("pad_id"))


@query("prj_06_sum_duplicates", "SELECT l_suppkey AS well_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, round(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END), 4) AS oil, round(sum(l_extendedprice), 2) AS gas, CAST(NULL AS DOUBLE) AS water FROM lineitem GROUP BY 1, 2")
def prj_06(spark, sf):
    li = table(spark, sf, "lineitem")
    x = li.select(F.col("l_suppkey").alias("well_id"), (columns.month_number(F.col("l_shipdate")) - bridge.FIRST_MONTH).alias("t"), F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("oil"), F.col("l_extendedprice").alias("gas"), F.lit(None).cast("double").alias("water"))
    return calendar.sum_duplicates(x).select("well_id", "t", F.round("oil", 4).alias("oil"), F.round("gas", 2).alias("gas"), "water")


FILLED = f"""{PART}, span AS (SELECT well_id, unnest(range(min(t), max(t) + 1))::INT AS t FROM part GROUP BY well_id),
filled AS (SELECT s.well_id, s.t, p.oil, p.gas, p.water, p.t IS NULL AS inserted FROM span s LEFT JOIN part p USING (well_id, t))"""


@query("prj_07_gaps_missing", f"WITH {FILLED} SELECT inserted, count(*) AS n, count(oil) AS reported, round(sum(oil), 4) AS oil FROM filled GROUP BY ALL")
def prj_07(spark, sf):
    return calendar.fill_gaps(bridge.part_series(spark, sf)).groupBy("inserted").agg(F.count("*").alias("n"), F.count("oil").alias("reported"), F.round(F.sum("oil"), 4).alias("oil"))


@query("prj_07_gaps_zero", f"WITH {FILLED} SELECT well_id, count(*) AS months, count(*) FILTER (WHERE inserted) AS zeros, round(avg(coalesce(oil, 0)), 6) AS mean FROM filled GROUP BY ALL")
def prj_07z(spark, sf):
    return calendar.fill_gaps(bridge.part_series(spark, sf), "zero").groupBy("well_id").agg(F.count("*").alias("months"), F.count_if("inserted").alias("zeros"), r6(F.avg("oil"), "mean"))


@query("prj_08_breaks", f"WITH {PART} SELECT well_id, t, before FROM (SELECT well_id, t, lag(t) OVER (PARTITION BY well_id ORDER BY t) AS before FROM part) WHERE t <> before + 1")
def prj_08(spark, sf):
    return calendar.breaks(bridge.part_series(spark, sf))


@query("prj_09_availability", f"WITH {PART} SELECT well_id, count(CASE WHEN well_id % 3 <> 0 THEN oil END) > 0 AS oil, count(gas) > 0 AS gas, false AS water FROM part GROUP BY ALL")
def prj_09(spark, sf):
    x = bridge.part_series(spark, sf).withColumns({"oil": F.when(F.col("well_id") % 3 != 0, F.col("oil")), "water": F.lit(None).cast("double")})
    return calendar.availability(x)


SPLIT = f"""{PART}, n AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY t) AS pos, sum((t <= 40)::INT) OVER (PARTITION BY well_id) AS tr, count(*) OVER (PARTITION BY well_id) AS n FROM part),
sp AS (SELECT well_id, t, CASE WHEN pos <= tr THEN 'train' ELSE 'holdout' END AS split, CASE WHEN pos > tr THEN (pos - tr)::INT END AS h FROM n WHERE tr >= 1 AND tr + 8 <= n AND pos <= tr + 8)"""


@query("prj_11_split", f"WITH {SPLIT} SELECT * FROM sp")
def prj_11(spark, sf):
    return calendar.split_at(bridge.part_series(spark, sf), 40, 8).select("well_id", "t", "split", "h")


@query("prj_11_skipped", f"WITH {SPLIT} SELECT DISTINCT well_id FROM part WHERE well_id NOT IN (SELECT well_id FROM sp)")
def prj_11s(spark, sf):
    p = bridge.part_series(spark, sf)
    return calendar.skipped(p, calendar.split_at(p, 40, 8))


@query("prj_10_truncate", f"WITH {PART} SELECT well_id, count(*) AS n, max(t)::INT AS last FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY t) AS k FROM part) WHERE k <= 6 GROUP BY ALL")
def prj_10(spark, sf):
    return calendar.truncate(bridge.part_series(spark, sf), 6).groupBy("well_id").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query("prj_13_retrospective_cutoff", f"WITH {SUP} SELECT (max(t) - 15)::INT AS cutoff FROM sup")
def prj_13(spark, sf):
    return calendar.retrospective_cutoff(bridge.supplier_series(spark, sf), 12, 3)


@query("prj_14_min_history", f"WITH {PART} SELECT well_id, count(*) AS n FROM part WHERE t <= 40 GROUP BY ALL HAVING count(*) >= 12")
def prj_14(spark, sf):
    return bridge.part_series(spark, sf).filter("t <= 40").groupBy("well_id").agg(F.count("*").alias("n")).filter("n >= 12")


@query("prj_15_play_case", """SELECT CASE WHEN upper(p_type) LIKE '%EAGLE%' THEN 'eagle_ford' WHEN upper(p_type) LIKE '%DELAWARE%' OR upper(p_brand) LIKE '%BONE SPRING%' THEN 'delaware' WHEN upper(p_type) LIKE '%MIDLAND%' THEN 'midland'
  WHEN regexp_matches(upper(p_brand), 'NIOBRARA|CODELL') THEN 'dj' ELSE lower(p_type) END AS play, count(*) AS n FROM part GROUP BY ALL""")
def prj_15(spark, sf):
    return table(spark, sf, "part").groupBy(calendar.play_case(F.col("p_type"), F.col("p_brand")).alias("play")).agg(F.count("*").alias("n"))


@query("prj_16_span_bucket", f"WITH {PART} SELECT CASE WHEN n BETWEEN 7 AND 12 THEN 'b1' WHEN n BETWEEN 13 AND 24 THEN 'b2' WHEN n BETWEEN 25 AND 36 THEN 'b3' ELSE 'b4' END AS bucket, count(*) AS wells FROM (SELECT well_id, count(*) AS n FROM part GROUP BY ALL) GROUP BY ALL")
def prj_16(spark, sf):
    n = bridge.part_series(spark, sf).groupBy("well_id").agg(F.count("*").alias("n"))
    return n.groupBy(columns.span_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("wells"))


ELIGIBLE = f"""{PART}, el AS (SELECT well_id, min(t) FILTER (WHERE t <= 40 AND (oil > 0 OR gas > 0)) AS f, count(*) FILTER (WHERE t BETWEEN 41 AND 52 AND oil IS NOT NULL) AS held FROM part GROUP BY ALL)"""


@query("prj_17_eligible", f"WITH {ELIGIBLE} SELECT well_id, (40 - f + 1)::INT AS span, held::INT AS held, CASE WHEN 41 - f BETWEEN 7 AND 12 THEN 'b1' WHEN 41 - f BETWEEN 13 AND 24 THEN 'b2' WHEN 41 - f BETWEEN 25 AND 36 THEN 'b3' ELSE 'b4' END AS bucket FROM el WHERE 41 - f BETWEEN 7 AND 48 AND held >= 3")
def prj_17(spark, sf):
    return calendar.eligible(bridge.part_series(spark, sf), 40, 12, reported=3)


@query("prj_18_targets", f"""WITH {PART}, l AS (SELECT well_id, max(t) + 1 AS nat FROM part GROUP BY ALL)
SELECT well_id, (80 - nat)::INT AS gap, h::INT AS h, (80 + h - 1)::INT AS t FROM l CROSS JOIN range(1, 7) r(h) WHERE nat <= 80 UNION ALL SELECT well_id, (80 - nat)::INT, NULL, NULL FROM l WHERE nat > 80""")
def prj_18(spark, sf):
    return calendar.targets(bridge.part_series(spark, sf), 6, 80)


@query("prj_20_group_label", f"WITH {W} SELECT well_id, CASE WHEN well_id % 4 = 0 THEN '__global__' WHEN well_id % 4 = 1 THEN 'dj' ELSE replace(lower(play), ' ', '_') END AS grp FROM w")
def prj_20(spark, sf):
    k = F.col("well_id") % 4
    raw = F.when(k == 0, " ").when(k == 1, "Denver - Julesburg/Basin").otherwise(F.col("play"))
    return bridge.wells(spark, sf).select("well_id", columns.group_label(raw).alias("grp"))


# Joins.


@query("jn_01_metadata", f"WITH {SUP}, {W} SELECT coalesce(play, 'none') AS play, count(*) AS months, round(sum(oil), 4) AS oil FROM sup LEFT JOIN (SELECT * FROM w WHERE well_id % 5 <> 0) w USING (well_id) GROUP BY ALL")
def jn_01(spark, sf):
    x = bridge.supplier_series(spark, sf).join(bridge.wells(spark, sf).filter("well_id % 5 <> 0"), "well_id", "left")
    return x.groupBy(F.coalesce("play", F.lit("none")).alias("play")).agg(F.count("*").alias("months"), F.round(F.sum("oil"), 4).alias("oil"))


@query("jn_02_distinct_build", "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey GROUP BY ALL")
def jn_02(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority").distinct()
    return table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


LATE = f"SELECT well_id, phase, t AS h, q AS volume FROM ({DECLINE_LONG_SQL}) WHERE t BETWEEN 1 AND 12"


def _vectors(spark, sf):
    return _long(spark, sf).filter("t between 1 and 12").select("well_id", "phase", F.col("t").alias("h"), F.col("q").alias("volume"))


@query("jn_03_precomputed_missing", f"WITH f AS ({LATE}), s AS (SELECT DISTINCT well_id, phase FROM f) SELECT s.well_id, s.phase, count(h) AS months, count(h) = 0 AS missing FROM s LEFT JOIN (SELECT * FROM f WHERE well_id % 3 <> 1) f USING (well_id, phase) GROUP BY ALL")
def jn_03(spark, sf):
    """Stored vectors as a provider: a unit without one has no months and is missing.  A vector has all
    twelve months, a null one where nothing was reported; reported months count."""
    f = _vectors(spark, sf)
    rows = f.withColumnsRenamed({"h": "t", "volume": "q"})
    whole = f.select("well_id", "phase").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(f, ["well_id", "phase", "h"], "left")
    got = providers.precomputed(whole.filter("well_id % 3 <> 1"))(rows, 12)
    x = f.select("well_id", "phase", F.col("h").alias("told")).join(got.withColumn("told", F.col("h")), ["well_id", "phase", "told"], "left")
    return x.groupBy("well_id", "phase").agg(F.count("h").alias("months"), (F.count("h") == 0).alias("missing"))


@query("jn_04_overrides", f"WITH f AS ({LATE}) SELECT well_id, phase, h::INT AS h, round(CASE WHEN well_id % 4 = 2 AND phase = 'gas' THEN 100e0 + h ELSE volume END, 6) AS volume FROM f")
def jn_04(spark, sf):
    f = _vectors(spark, sf)
    approved = f.filter("well_id % 4 = 2 AND phase = 'gas'").withColumn("volume", (100 + F.col("h")).cast("double"))
    return submission.overrides(f, approved).select("well_id", "phase", "h", r6("volume"))


@query("jn_05_two_providers", f"WITH f AS ({LATE}) SELECT phase, count(*) AS n, round(sum(CASE WHEN well_id % 2 = 0 THEN volume ELSE 1e0 END), 4) AS volume FROM f GROUP BY ALL")
def jn_05(spark, sf):
    f = _vectors(spark, sf)
    both = submission.coalesce_providers(f.filter("well_id % 2 = 0"), f.withColumn("volume", F.lit(1.0)))
    return both.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 4).alias("volume"))


@query("jn_06_unknown_wells", "SELECT DISTINCT c_custkey AS well_id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def jn_06(spark, sf):
    return submission.unknown_wells(table(spark, sf, "customer").select(F.col("c_custkey").alias("well_id")), bridge.wells(spark, sf))


@query("jn_07_one_sided", f"WITH {PART}, a AS (SELECT DISTINCT well_id FROM part WHERE t <= 5), b AS (SELECT DISTINCT well_id FROM part WHERE t > 75) SELECT coalesce(a.well_id, b.well_id) AS well_id, CASE WHEN b.well_id IS NULL THEN 'train' ELSE 'holdout' END AS side FROM a FULL JOIN b ON a.well_id = b.well_id WHERE a.well_id IS NULL OR b.well_id IS NULL")
def jn_07(spark, sf):
    p = bridge.part_series(spark, sf)
    a, b = (p.filter(c).select("well_id").distinct().withColumn(n, F.lit(True)) for c, n in (("t <= 5", "a"), ("t > 75", "b")))
    return a.join(b, "well_id", "full").filter("a IS NULL OR b IS NULL").select("well_id", F.when(F.col("b").isNull(), "train").otherwise("holdout").alias("side"))


@query("jn_08_semi", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL")
def jn_08(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("jn_09_paired_units", f"WITH {LONG}, e AS (SELECT well_id, phase, t % 3 AS arm, q FROM lng WHERE NOT (t % 3 = 1 AND well_id % 2 = 0)) SELECT well_id, phase FROM e GROUP BY ALL HAVING count(DISTINCT arm) = 3")
def jn_09(spark, sf):
    e = _long(spark, sf).withColumn("arm", F.col("t") % 3).filter("NOT (arm = 1 AND well_id % 2 = 0)")
    p = e.groupBy("well_id", "phase").pivot("arm", [0, 1, 2]).agg(F.count("q")).na.drop()
    return p.select("well_id", "phase")


@query("jn_13_key_overlap", f"WITH {W}, a AS (SELECT * FROM w WHERE well_id % 7 <> 0), b AS (SELECT well_id, CASE WHEN well_id % 5 = 0 THEN 'moved' ELSE play END AS play FROM w WHERE well_id % 3 <> 0) SELECT coalesce(a.well_id, b.well_id) AS well_id, CASE WHEN b.well_id IS NULL THEN 'missing' WHEN a.well_id IS NULL THEN 'new' WHEN a.play <> b.play THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.well_id = b.well_id")
def jn_13(spark, sf):
    w = bridge.wells(spark, sf)
    a, b = w.filter("well_id % 7 <> 0").select("well_id", F.col("play").alias("a")), w.filter("well_id % 3 <> 0").select("well_id", F.when(F.col("well_id") % 5 == 0, "moved").otherwise(F.col("play")).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "well_id", "full").select("well_id", state.alias("state"))


@query("jn_14_scaffold", f"WITH {FILLED} SELECT t, count(*) AS wells, count(*) FILTER (WHERE inserted) AS missing FROM filled GROUP BY ALL")
def jn_14(spark, sf):
    return calendar.fill_gaps(bridge.part_series(spark, sf)).groupBy("t").agg(F.count("*").alias("wells"), F.count_if("inserted").alias("missing"))


@query("jn_15_manifest_compare", "WITH a AS (SELECT 'f' || p_partkey AS path, sha256(p_name) AS h FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN sha256('x') ELSE sha256(p_name) END AS h FROM part WHERE p_partkey % 3 <> 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unexpected' ELSE 'mismatched' END AS status FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h")
def jn_15(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    a = p.filter("p_partkey % 5 <> 0").select("path", F.sha2("p_name", 256).alias("sha256"))
    b = p.filter("p_partkey % 3 <> 0").select("path", F.when(F.col("p_partkey") % 4 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("p_name", 256)).alias("sha256"))
    return sinks.compare_manifests(a, b)


# Sources over tables.


@query("src_07_header_query", "SELECT p_partkey AS well_id, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' THEN 'brass' ELSE 'other' END AS play, p_size FROM part WHERE p_size BETWEEN 5 AND 30 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44') AND p_retailprice >= 910 AND p_name IS NOT NULL")
def src_07(spark, sf):
    p = table(spark, sf, "part").filter(F.col("p_size").between(5, 30) & F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33", "Brand#44") & (F.col("p_retailprice") >= 910) & F.col("p_name").isNotNull())
    return p.select(F.col("p_partkey").alias("well_id"), F.when(F.col("p_type").contains("STEEL"), "steel").when(F.col("p_type").contains("BRASS"), "brass").otherwise("other").alias("play"), "p_size")


@query("src_08_production_query", "SELECT l_suppkey AS well_id, date_trunc('month', l_shipdate)::DATE AS month, round(sum(l_quantity), 2) AS liquids FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10) AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY ALL")
def src_08(spark, sf):
    s = table(spark, sf, "supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").alias("l_suppkey"))
    x = table(spark, sf, "lineitem").filter("l_shipdate >= timestamp'1996-01-01' AND l_shipdate < timestamp'1998-01-01'").join(s, "l_suppkey", "left_semi")
    return x.groupBy(F.col("l_suppkey").alias("well_id"), F.trunc("l_shipdate", "MM").alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("liquids"))


@query("src_09_roster", "SELECT l_partkey AS well_id, l_orderkey, round(l_quantity)::BIGINT AS lateral, strftime(l_shipdate, '%Y-%m') AS first FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1")
def src_09(spark, sf):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    x = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return x.select(F.col("l_partkey").alias("well_id"), "l_orderkey", F.round("l_quantity").cast("long").alias("lateral"), F.date_format("l_shipdate", "yyyy-MM").alias("first"))


@query("src_10_monthly_volumes", f"WITH {SUP} SELECT well_id, t, round(oil, 4) AS oil, round(gas + 1e-7, 3) AS gas, round(water + 1e-7, 3) AS water FROM sup")
def src_10(spark, sf):
    return bridge.supplier_series(spark, sf).select("well_id", "t", F.round("oil", 4).alias("oil"), *(F.round(F.col(c) + 1e-7, 3).alias(c) for c in ("gas", "water")))


@query("snk_05_review_queue", f"WITH {LONG} SELECT well_id, phase, (100 - well_id % 7)::INT AS review, CASE WHEN well_id % 2 = 0 THEN 'thin_history;terminal_low' ELSE '' END AS flags FROM (SELECT DISTINCT well_id, phase FROM lng)")
def snk_05(spark, sf):
    d = _long(spark, sf).select("well_id", "phase").distinct().withColumns({"review": (100 - F.col("well_id") % 7).cast("int"), "flags": F.when(F.col("well_id") % 2 == 0, F.array(F.lit("thin_history"), F.lit("terminal_low"))).otherwise(F.array().cast("array<string>"))})
    return sinks.review_queue(d)


@query("snk_08_render", "SELECT s_suppkey AS \"API\", s_name AS \"Name\", 'final' AS \"Kind\" FROM supplier")
def snk_08(spark, sf):
    return submission.render(table(spark, sf, "supplier"), [{"name": "API", "source": "s_suppkey"}, {"name": "Name", "source": "s_name"}, {"name": "Kind", "constant": "final"}])


# Aggregations.


@query("agg_01_pad_streams", f"WITH {DEC}, {W} SELECT pad, t, round(sum(oil), 6) AS oil, round(sum(CASE WHEN well_id % 2 = 0 THEN gas END), 6) AS gas FROM dec JOIN w USING (well_id) GROUP BY ALL")
def agg_01(spark, sf):
    x = bridge.decline(spark, sf).join(bridge.wells(spark, sf), "well_id")
    return x.groupBy("pad", "t").agg(r6(F.sum("oil"), "oil"), r6(F.sum(F.when(F.col("well_id") % 2 == 0, F.col("gas"))), "gas"))


@query("agg_03_max_days_row_count", "SELECT l_partkey AS well_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, max(l_linenumber)::INT AS days, count(*) AS rows FROM lineitem GROUP BY 1, 2")
def agg_03(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("well_id"), (columns.month_number(F.col("l_shipdate")) - bridge.FIRST_MONTH).alias("t")).agg(F.max("l_linenumber").alias("days"), F.count("*").alias("rows"))


@query("agg_05_primary_phase", f"WITH {SUP} SELECT well_id, CASE WHEN sum(greatest(oil * 20, 0)) >= sum(greatest(gas, 0)) / 6 THEN 'oil' ELSE 'gas' END AS primary_phase FROM sup GROUP BY ALL")
def agg_05(spark, sf):
    return calendar.primary_phase(bridge.supplier_series(spark, sf).withColumn("oil", F.col("oil") * 20))


@query("agg_09_segment_scores", f"""WITH {LONG}, {W}, e AS (SELECT well_id, phase, ln(q / first_q) AS e FROM (SELECT *, max(q) OVER (PARTITION BY well_id, phase) AS first_q FROM lng) WHERE t = 40)
SELECT play, phase, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN 2e0 / 3 * abs(median(e)) + 1e0 / 3 * stddev_pop(e) END, 6) AS score FROM e JOIN w USING (well_id) GROUP BY GROUPING SETS ((play), (phase), ())""")
def agg_09(spark, sf):
    """All segments in one pass of grouping sets."""
    x = _long(spark, sf).withColumn("top", F.max("q").over(Window.partitionBy("well_id", "phase"))).filter("t = 40")
    x = x.join(bridge.wells(spark, sf), "well_id").withColumn("e", F.ln(F.col("q") / F.col("top")))
    return x.groupingSets([["play"], ["phase"], []], "play", "phase").agg(F.count("*").alias("n"), r6(columns.pool_score(F.col("e")), "score"))


@query("agg_14_lag_ratio_quantiles", f"WITH {LONG}, r AS (SELECT phase, t, q / lag(q) OVER (PARTITION BY well_id, phase ORDER BY t) AS r FROM lng) SELECT phase, t, count(r) AS n, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.25), 6) AS p25, round(median(r), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75 FROM r WHERE t > 40 GROUP BY ALL")
def agg_14(spark, sf):
    r = _long(spark, sf).withColumn("r", F.col("q") / F.lag("q").over(Window.partitionBy("well_id", "phase").orderBy("t"))).filter("t > 40")
    x = r.groupBy("phase", "t").agg(F.count("r").alias("n"), r6(F.avg("r"), "mean"), F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    return x.select("phase", "t", "n", "mean", r6(F.col("p")[0], "p25"), r6(F.col("p")[1], "p50"), r6(F.col("p")[2], "p75"))


@query("agg_17_two_levels", "WITH s AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) SELECT event_type, count(*) AS seeds, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_pop(m), 6) AS spread, round(avg((m > 50)::INT), 6) AS win_rate, round(max(m), 6) AS largest FROM s GROUP BY ALL")
def agg_17(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return s.groupBy("event_type").agg(F.count("*").alias("seeds"), r6(F.avg("m"), "mean"), r6(F.median("m"), "median"), r6(F.stddev_pop("m"), "spread"), r6(F.avg((F.col("m") > 50).cast("double")), "win_rate"), r6(F.max("m"), "largest"))


@query("agg_19_horizon_check", f"WITH {PART} SELECT well_id, count(*) AS n FROM part GROUP BY ALL HAVING count(*) <> 30")
def agg_19(spark, sf):
    return bridge.part_series(spark, sf).groupBy("well_id").agg(F.count("*").alias("n")).filter("n <> 30")


# Sequence windows.


@query("win_01_first_peak", f"WITH {ROUGH} SELECT well_id, phase, min(t)::INT AS peak, round(any_value(q), 6) AS peak_q FROM (SELECT *, max(q) OVER (PARTITION BY well_id, phase) AS m FROM rough) WHERE q = m GROUP BY ALL")
def win_01(spark, sf):
    return sequence.first_peak(_rough(spark, sf)).select("well_id", "phase", "peak", r6("peak_q"))


@query("win_02_trailing", f"WITH {ROUGH} SELECT well_id, phase, t::INT AS t, back::INT AS back, round(q, 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS back FROM rough WHERE q IS NOT NULL) WHERE back <= 3")
def win_02(spark, sf):
    return sequence.trailing(_rough(spark, sf), 3).select("well_id", "phase", "t", "back", r6("q"))


@query("win_04_zero_streak", f"WITH {ROUGH}, l AS (SELECT *, max(CASE WHEN q > 0 THEN t END) OVER (PARTITION BY well_id, phase) AS p FROM rough) SELECT well_id, phase, count(*) FILTER (WHERE q <= 0 AND (p IS NULL OR t > p)) AS streak FROM l GROUP BY ALL")
def win_04(spark, sf):
    return sequence.zero_streak(_rough(spark, sf))


@query("win_05_log_steps", f"WITH {ROUGH}, a AS (SELECT well_id, phase, t, ln(q) - lag(ln(q)) OVER (PARTITION BY well_id, phase ORDER BY t) AS d1 FROM rough WHERE q > 0) SELECT well_id, phase, t::INT AS t, round(d1, 6) AS d1, round(d1 - lag(d1) OVER (PARTITION BY well_id, phase ORDER BY t), 6) AS d2 FROM a")
def win_05(spark, sf):
    return sequence.log_steps(_rough(spark, sf)).select("well_id", "phase", "t", r6("d1"), r6("d2"))


@query("win_09_level_break", f"""WITH {ROUGH}, b AS (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS back FROM rough WHERE q IS NOT NULL)
SELECT well_id, phase, round(CASE WHEN count(*) = 8 AND count(*) FILTER (WHERE back > 2 AND q > 0) >= 3 THEN median(q) FILTER (WHERE back <= 2 AND q > 0) / median(q) FILTER (WHERE back > 2 AND q > 0) END, 6) AS ratio FROM b WHERE back <= 8 GROUP BY ALL""")
def win_09(spark, sf):
    return sequence.level_break(_rough(spark, sf)).select("well_id", "phase", r6("ratio"))


@query("win_10_past_recovery", f"""WITH {ROUGH}, m AS (SELECT well_id, phase, median(q) AS m FROM (SELECT *, row_number() OVER (PARTITION BY well_id, phase ORDER BY t DESC) AS k FROM rough WHERE q > 0) WHERE k <= 12 GROUP BY ALL),
c AS (SELECT well_id, phase, count(*) FILTER (WHERE q > 0) >= 6 AS many FROM rough GROUP BY ALL),
x AS (SELECT *, max(q) OVER (PARTITION BY well_id, phase ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS nx, row_number() OVER (PARTITION BY well_id, phase ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY well_id, phase) AS n FROM rough)
SELECT well_id, phase, coalesce(bool_or(many AND q <= 0.35e0 * m AND nx > 2 * greatest(q, 1) AND i BETWEEN 1 AND n - 3), false) AS recovered FROM x JOIN m USING (well_id, phase) JOIN c USING (well_id, phase) GROUP BY ALL""")
def win_10(spark, sf):
    return sequence.past_recovery(_rough(spark, sf))


@query("win_11_balanced_order", "SELECT s_suppkey, row_number() OVER (ORDER BY r, s_nationkey)::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey || '|board')) AS r FROM supplier)")
def win_11(spark, sf):
    s = table(spark, sf, "supplier").withColumn("ord", board.hash_order("s_suppkey", "board"))
    return sequence.balanced_order(s, ["s_nationkey"], "ord").select("s_suppkey", "position")


@query("win_14_ranking", f"WITH {LONG}, a AS (SELECT phase, well_id, CASE WHEN well_id % 3 <> 0 THEN round(stddev_pop(q), 4) END AS x, avg(q) AS y FROM lng GROUP BY phase, well_id) SELECT phase, well_id, row_number() OVER (PARTITION BY phase ORDER BY x ASC NULLS LAST, y ASC)::INT AS rank FROM a")
def win_14(spark, sf):
    a = _long(spark, sf).groupBy("phase", "well_id").agg(F.when(F.col("well_id") % 3 != 0, F.round(F.stddev_pop("q"), 4)).alias("x"), F.avg("q").alias("y"))
    return a.select("phase", "well_id", F.row_number().over(Window.partitionBy("phase").orderBy(F.asc_nulls_last("x"), "y")).alias("rank"))


@query("win_15_origins", f"WITH {PART}, n AS (SELECT well_id, 'oil' AS phase, count(*) AS n FROM part GROUP BY ALL) SELECT well_id, phase, h::INT AS horizon, k::INT AS rank, (n - h * (k + 1))::INT AS cutoff FROM n CROSS JOIN (VALUES (3), (6)) a(h) CROSS JOIN (VALUES (0), (1)) b(k) WHERE n - h * (k + 1) >= greatest(h + 5, 8)")
def win_15(spark, sf):
    return sequence.origins(bridge.longer(bridge.part_series(spark, sf), ("oil",)))


# Ordering and sets.


@query("srt_02_argmin_ties", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount, l_orderkey, l_linenumber) = 1")
def srt_02(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min(F.struct("l_discount", "l_orderkey", "l_linenumber")).alias("m"))
    return x.select("l_suppkey", "m.l_orderkey", "m.l_linenumber")


@query("srt_04_top_influence", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def srt_04(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("srt_06_hash_order", "SELECT s_suppkey, md5(s_suppkey || '|salt') AS a, sha256('board|' || s_suppkey) AS b FROM supplier")
def srt_06(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", board.hash_order("s_suppkey", "salt").alias("a"), F.sha2(F.concat(F.lit("board|"), F.col("s_suppkey").cast("string")), 256).alias("b"))


SETS = "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 {op} SELECT o_custkey FROM orders WHERE o_totalprice > 350000"
for _n, _op, _f in (("set_01_union", "UNION", lambda a, b: a.union(b).distinct()), ("set_02_difference", "EXCEPT", lambda a, b: a.subtract(b)), ("set_03_intersection", "INTERSECT", lambda a, b: a.intersect(b))):

    @query(_n, SETS.format(op=_op))
    def _(spark, sf, f=_f):
        return f(table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("k")))


@query("set_04_symmetric_difference", f"(({SETS.format(op='EXCEPT')}) UNION ALL (SELECT o_custkey FROM orders WHERE o_totalprice > 350000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def set_04(spark, sf):
    a, b = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).union(b.subtract(a))


@query("set_05_concatenation", f"WITH {PART}, {SUP} SELECT src, count(*) AS n, round(sum(oil), 4) AS oil FROM (SELECT 'part' AS src, oil FROM part UNION ALL SELECT 'supplier', oil FROM sup) GROUP BY ALL")
def set_05(spark, sf):
    x = bridge.part_series(spark, sf).select(F.lit("part").alias("src"), "oil").unionByName(bridge.supplier_series(spark, sf).select(F.lit("supplier").alias("src"), "oil"))
    return x.groupBy("src").agg(F.count("*").alias("n"), F.round(F.sum("oil"), 4).alias("oil"))


@query("set_06_extend_headers", "SELECT c_custkey AS well_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def set_06(spark, sf):
    h = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("well_id"), F.col("c_name").alias("name"))
    more = table(spark, sf, "orders").select(F.col("o_custkey").alias("well_id")).distinct().join(h, "well_id", "left_anti")
    return h.unionByName(more.withColumn("name", F.lit(None).cast("string")))
