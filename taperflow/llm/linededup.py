"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A gram is the shortest run of lines from a line on that holds ``GRAM`` words; its hash is that of
its line hashes.  Each span of ``REPEAT - GRAM`` words selects the least gram hash that begins in
it (winnowing, with spans in words instead of places).  A run of ``REPEAT`` words or more that
two places share has all grams of such a span in common, so both select the same one: it is
certain to be found.  Each selected gram is joined to the first place of its hash (order: doc_id,
place), the match is extended both ways along its diagonal while line hashes agree, and the later
run is deleted.  That place may hold less of the run than another one, so the ends are found by
windows: in documents with a match, the shortest run of ``REPEAT`` words or more from each line on,
and that up to each line, are joined to the first place of their hash.  The windows inside a
repeated run cover it to both ends, and each has its earlier place: every line of every repeated
run of ``REPEAT`` words is deleted.  A deleted line always has an equal line at an earlier place;
by induction the first place of each line stays.

Only selected grams, and lines and windows of documents with a match, are joined; a hash with very
many places meets one row (its first place), never its other places.

Defined results: a null text stays null, an empty one empty; a document whose lines are all
deleted keeps its row with an empty text; repeated rows (same doc_id and text) are one document
and are treated alike; a null doc_id comes first in order; empty tables give no rows; extra
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

GRAM = 32
REPEAT = 50

_FIRST = -(2**63)


def hash60(x: Column) -> Column:
    """60 bits of MD5 as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def _keys() -> tuple[Column, Column]:
    """The document's place in the order, and the hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)), hash60(F.col("text"))


def lines(docs: DataFrame) -> DataFrame:
    """d, t (hash of the text), pos, h (hash of the line), w (words: 1 + spaces)."""
    x = F.transform(F.split("text", "\n", -1), lambda s: F.struct(hash60(s).alias("h"), (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1).cast("long").alias("w")))
    d, t = _keys()
    rows = docs.filter(F.col("text").isNotNull()).select(d.alias("d"), t.alias("t"), F.posexplode(x).alias("pos", "x"))
    return rows.select("d", "t", F.col("pos").cast("long").alias("pos"), "x.h", "x.w").dropDuplicates(["d", "t", "pos"])


def fingerprints(rows: DataFrame, gram: int = GRAM, repeat: int = REPEAT) -> DataFrame:
    """d, t, pos, g: the selected grams."""
    doc = Window.partitionBy("d", "t")
    at = doc.orderBy("cum")
    rows = rows.withColumn("cum", F.coalesce(F.sum("w").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    held = at.rangeBetween(0, gram - 1)
    rows = rows.withColumns({"g": F.collect_list("h").over(held), "n": F.sum("w").over(held)})
    rows = rows.withColumn("g", F.when(F.col("n") >= gram, hash60(F.array_join(F.col("g").cast("array<string>"), ","))))
    rows = rows.withColumn("m", F.min("g").over(at.rangeBetween(0, repeat - gram)))
    rows = rows.withColumn("m", F.max("m").over(at.rangeBetween(gram - repeat, 0)))
    return rows.filter("g = m").select("d", "t", "pos", "g")


def repeated_windows(rows: DataFrame, prints: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """d, t, begin, end: shortest runs of ``repeat`` words from a line on or up to it that repeat an
    earlier place, in documents that share a selected gram with another place."""
    doc = Window.partitionBy("d", "t")
    shared = prints.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g")
    rows = rows.join(prints.join(shared, "g").select("d", "t").distinct(), ["d", "t"])
    rows = rows.withColumn("upto", F.sum("w").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("cum", F.col("upto") - F.col("w"))
    on, back = doc.orderBy("cum").rangeBetween(0, repeat - 1), doc.orderBy("upto").rangeBetween(1 - repeat, 0)
    rows = rows.withColumns({"n": F.sum("w").over(on), "a": F.collect_list("h").over(on), "m": F.sum("w").over(back), "b": F.collect_list("h").over(back)})
    ahead = F.when(F.col("n") >= repeat, F.struct(F.xxhash64("a").alias("key"), F.col("pos").alias("begin"), (F.col("pos") + F.size("a") - 1).alias("end")))
    # One that stays long enough without its last line only; the others are windows from a line on.
    behind = F.when(F.col("m") - F.col("w") >= repeat, F.struct(F.xxhash64("b").alias("key"), (F.col("pos") - F.size("b") + 1).alias("begin"), F.col("pos").alias("end")))
    found = rows.select("d", "t", F.explode(F.array_compact(F.array(ahead, behind))).alias("x")).select("d", "t", "x.*")
    first = found.groupBy("key").agg(F.min(F.struct("d", "t", "begin")).alias("f"), F.max(F.struct("d", "t", "begin")).alias("last")).filter("f < last").select("key", "f")
    return found.join(first, "key").filter(F.struct("d", "t", "begin") > F.col("f")).select("d", "t", "begin", "end")


def repeated_runs(rows: DataFrame, gram: int = GRAM, repeat: int = REPEAT) -> DataFrame:
    """d, t, begin, end: runs of lines that repeat an earlier place."""
    prints = written(fingerprints(rows, gram, repeat), "prints")
    first = prints.groupBy("g").agg(F.min(F.struct("d", "t", "pos")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("g", "f")
    found = prints.join(first, "g").filter(F.struct("d", "t", "pos") > F.col("f"))
    found = found.select("d", "t", F.col("f.d").alias("d0"), F.col("f.t").alias("t0"), (F.col("pos") - F.col("f.pos")).alias("shift"), "pos")
    diagonal = ["d", "t", "d0", "t0", "shift"]
    starts = found.groupBy(*diagonal).agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    mine = starts.join(rows.select("d", "t", "pos", "h"), ["d", "t"]).withColumn("pos0", F.col("pos") - F.col("shift"))
    theirs = rows.select(F.col("d").alias("d0"), F.col("t").alias("t0"), F.col("pos").alias("pos0"), F.col("h").alias("h0"))
    same = mine.join(theirs, ["d0", "t0", "pos0"]).filter("h = h0")
    island = (F.col("pos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("pos"))).alias("island")
    runs = same.select(*diagonal, "pos", "starts", island).groupBy(*diagonal, "island").agg(F.min("pos").alias("begin"), F.max("pos").alias("end"), F.first("starts").alias("starts"))
    runs = runs.filter("exists(starts, s -> s between begin and end)").select("d", "t", "begin", "end")
    return runs.unionByName(repeated_windows(rows, prints, repeat)).distinct()


def dedup_lines(docs: DataFrame, gram: int = GRAM, repeat: int = REPEAT) -> DataFrame:
    """docs with the repeated runs deleted from ``text``, and lines_removed (long), which replaces
    a column of that name."""
    docs = docs.drop("lines_removed")
    rows = written(lines(docs), "lines")
    d, t, runs, left = fresh(docs, "_d", "_t", "_runs", "_left")
    found = repeated_runs(rows, gram, repeat).groupBy(F.col("d").alias(d), F.col("t").alias(t)).agg(F.collect_list(F.struct("begin", "end")).alias(runs))
    keyed = docs.withColumns(dict(zip((d, t), _keys(), strict=True))).join(found, [d, t], "left")
    parts = F.split("text", "\n", -1)
    stay = F.filter(parts, lambda _, i: ~F.exists(runs, lambda r: i.between(r["begin"], r["end"])))
    keyed = keyed.withColumn(left, F.when(F.col(runs).isNotNull(), stay))
    removed = F.when(F.col(left).isNotNull(), F.size(parts) - F.size(left)).otherwise(0).cast("long")
    text = F.when(F.col(left).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    return keyed.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), removed.alias("lines_removed"))


#: The same for DuckDB; columns doc_id, text, lines_removed.
ORACLE = f"""
WITH l AS (
  SELECT DISTINCT doc_id AS d, ('0x' || substr(md5(text), 1, 15))::BIGINT AS t, pos::BIGINT AS pos,
    ('0x' || substr(md5(x), 1, 15))::BIGINT AS h, (length(x) - length(replace(x, ' ', '')) + 1)::BIGINT AS w
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)
), c AS (
  SELECT *, coalesce(sum(w) OVER (PARTITION BY d, t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM l
), g1 AS (
  SELECT *, list(h) OVER f AS hs, sum(w) OVER f AS n FROM c
  WINDOW f AS (PARTITION BY d, t ORDER BY cum RANGE BETWEEN CURRENT ROW AND {GRAM - 1} FOLLOWING)
), g2 AS (
  SELECT d, t, pos, cum, CASE WHEN n >= {GRAM} THEN ('0x' || substr(md5(array_to_string(hs, ',')), 1, 15))::BIGINT END AS g FROM g1
), g3 AS (
  SELECT *, min(g) OVER (PARTITION BY d, t ORDER BY cum RANGE BETWEEN CURRENT ROW AND {REPEAT - GRAM} FOLLOWING) AS m FROM g2
), g4 AS (
  SELECT *, max(m) OVER (PARTITION BY d, t ORDER BY cum RANGE BETWEEN {REPEAT - GRAM} PRECEDING AND CURRENT ROW) AS mm FROM g3
), p AS (SELECT d, t, pos, g FROM g4 WHERE g = mm),
first AS (SELECT g, min(row(d, t, pos)) AS f FROM p GROUP BY g),
m AS (
  SELECT DISTINCT p.d, p.t, f[1] AS d0, f[2] AS t0, p.pos - f[3] AS shift, p.pos FROM p JOIN first USING (g) WHERE row(p.d, p.t, p.pos) > f
), diag AS (SELECT DISTINCT d, t, d0, t0, shift FROM m),
same AS (
  SELECT diag.*, a.pos, a.pos - row_number() OVER (PARTITION BY diag.d, diag.t, diag.d0, diag.t0, diag.shift ORDER BY a.pos) AS island
  FROM diag JOIN l a ON a.d = diag.d AND a.t = diag.t JOIN l b ON b.d = diag.d0 AND b.t = diag.t0 AND b.pos = a.pos - diag.shift AND b.h = a.h
), hit AS (
  SELECT DISTINCT same.d, same.t, same.d0, same.t0, same.shift, same.island FROM same JOIN m USING (d, t, d0, t0, shift, pos)
), wr AS (
  SELECT c.*, cum + w AS upto FROM c JOIN (SELECT DISTINCT d, t FROM p JOIN (SELECT g FROM p GROUP BY g HAVING count(*) > 1) USING (g)) USING (d, t)
), wn AS (
  SELECT *, list(h) OVER f AS a, sum(w) OVER f AS n, list(h) OVER b AS z, sum(w) OVER b AS m FROM wr
  WINDOW f AS (PARTITION BY d, t ORDER BY cum RANGE BETWEEN CURRENT ROW AND {REPEAT - 1} FOLLOWING),
    b AS (PARTITION BY d, t ORDER BY upto RANGE BETWEEN {REPEAT - 1} PRECEDING AND CURRENT ROW)
), wf AS (
  SELECT d, t, array_to_string(a, ',') AS key, pos AS s, pos + len(a) - 1 AS e FROM wn WHERE n >= {REPEAT}
  UNION ALL SELECT d, t, array_to_string(z, ','), pos - len(z) + 1, pos FROM wn WHERE m - w >= {REPEAT}
), wd AS (
  SELECT d, t, unnest(range(s, e + 1)) AS pos FROM wf JOIN (SELECT key, min(row(d, t, s)) AS f FROM wf GROUP BY key) USING (key) WHERE row(d, t, s) > f
), dead AS (SELECT DISTINCT same.d, same.t, same.pos FROM same JOIN hit USING (d, t, d0, t0, shift, island) UNION SELECT d, t, pos FROM wd),
kept AS (
  SELECT d.doc_id, d.t, string_agg(d.x, chr(10) ORDER BY d.pos) FILTER (WHERE dead.pos IS NULL) AS text, count(dead.pos) AS n
  FROM (SELECT doc_id, ('0x' || substr(md5(text), 1, 15))::BIGINT AS t, unnest(string_split(text, chr(10))) AS x,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL) d
  LEFT JOIN dead ON dead.d = d.doc_id AND dead.t = d.t AND dead.pos = d.pos GROUP BY d.doc_id, d.t
)
SELECT doc_id, coalesce(text, '') AS text, n::BIGINT AS lines_removed FROM kept
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""
