"""Sinks: submissions, failures, reports, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import PHASES
from ..operators import board

SUBMISSION = ["submission_type", "model_name", "well_id", "pad_id", "phase", "forecast_month", "forecast_volume"]
FAILURES = ["well_id", "pad_id", "phase", "reason"]


def write_csv(rows: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """A folder of CSV parts with ``columns``, sorted by all of them in that order (over the parts, or
    in one if asked)."""
    out = rows.select(*columns)
    out = out.coalesce(1).sortWithinPartitions(*columns) if single else out.orderBy(*columns)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_submission(rows: DataFrame, path: str) -> None:
    write_csv(rows.withColumn("forecast_volume", F.round("forecast_volume", 6)), path, SUBMISSION)


def write_failures(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, FAILURES)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report as one file, through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason").count().orderBy(F.desc("count"), "reason")


def failure_markdown(failures: DataFrame) -> str:
    rows = failure_counts(failures).collect()  # a row a reason
    head = "# Failures\n\n| reason | count |\n|---|---:|\n"
    return head + "".join(f"| {r[0]} | {r[1]} |\n" for r in rows) if rows else "# Failures\n\nnone\n"


def markdown_table(rows: DataFrame, most: int = 100) -> str:
    """A report table of at most ``most`` rows."""
    got = rows.limit(most).collect()
    cells = lambda r: "| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |"
    return "\n".join([cells(rows.columns), "|" + "---|" * len(rows.columns), *map(cells, got)]) + "\n"


def run_log(spark: SparkSession, path: str, counters: dict, **more) -> None:
    write_text(spark, json.dumps({"schema_version": 1, **counters, **more}, indent=2, sort_keys=True), path)


def review_queue(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics by falling review score; flags joined by semicolons."""
    return diagnostics.withColumn("flags", F.array_join("flags", ";")).orderBy(F.desc("review"), "well_id", "phase")


def diagnostics_json(diagnostics: DataFrame) -> DataFrame:
    """well_id, json: each well's phases as one JSON value."""
    cols = [c for c in diagnostics.columns if c != "well_id"]
    return diagnostics.groupBy("well_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("phase", *(c for c in cols if c != "phase"))))).alias("json"))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small report as one JSON file; NaN and infinite numbers are an error."""
    write_text(spark, json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n", path)


def write_report(spark: SparkSession, directory: str, name: str, scores: DataFrame, profile: str | None = None, receipt: dict | None = None, most: int = 1000) -> None:
    """A scored report <name>.json (a small table, an error beyond ``most`` rows), with the profile to
    deploy in profile.json and the receipt of a locked evaluation in receipt.json, if there are."""
    rows = scores.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    write_json(spark, {"schema_version": 1, "rows": [r.asDict(recursive=True) for r in rows]}, f"{directory}/{name}.json")
    if profile:
        write_json(spark, {"schema_version": 1, "profile": profile}, f"{directory}/profile.json")
    if receipt:
        write_json(spark, {"schema_version": 1, **receipt}, f"{directory}/receipt.json")


def write_package(spark: SparkSession, rows: DataFrame, rejects: DataFrame, wells: DataFrame, directory: str, gap_policy: str = "nan") -> dict:
    """A canonical package: history, wells, and manifest.json with counters and the files' SHA-256.
    Returns the manifest."""
    write_csv(rows.withColumn("month", F.date_format("month", "yyyy-MM-dd")), f"{directory}/history.csv", ["well_id", "month", "oil", "gas", "water"])
    write_csv(wells, f"{directory}/wells.csv", wells.columns)
    counts = rows.agg(F.count("*").alias("rows"), F.count_distinct("well_id").alias("wells")).first()
    files = {r["path"].rsplit(directory.split(":")[-1].rstrip("/"), 1)[-1].lstrip("/"): {"bytes": r["bytes"], "sha256": r["sha256"]} for r in manifest(spark, directory).filter("path NOT LIKE '%.crc' AND path NOT LIKE '%_SUCCESS'").collect()}  # a row a file
    got = {"schema_version": 1, "gap_policy": gap_policy, "rows": counts["rows"], "wells": counts["wells"], "rejected": rejects.count(), "files": files}
    write_json(spark, got, f"{directory}/manifest.json")
    return got


def write_board(spark: SparkSession, directory: str, wells: DataFrame, series: DataFrame, clusters: DataFrame, basis: dict) -> dict:
    """A board's files: wells and series, the summaries of duplicates and provenance, and manifest.json
    with the board's id.  wells: well_key, train_hash, role, play, bucket and the reported fractions;
    clusters: well_id, cluster, keep.  Returns the manifest."""
    write_csv(wells, f"{directory}/wells.csv", ["well_key", *(c for c in wells.columns if c != "well_key")])
    write_csv(series.withColumn("month", F.col("month").cast("string")), f"{directory}/series.csv", ["well_key", "month", *PHASES, "split"])
    size = clusters.groupBy("cluster").count()
    dup = size.agg(F.count_if(F.col("count") > 1).alias("clusters"), F.sum(F.col("count") - 1).alias("dropped"), F.max("count").alias("largest")).first()
    write_json(spark, {"clusters": dup["clusters"], "dropped": dup["dropped"] or 0, "largest": dup["largest"] or 0}, f"{directory}/duplicates.json")
    write_json(spark, {"groups": [r.asDict() for r in board.provenance_summary(wells).orderBy("label", "value").collect()]}, f"{directory}/provenance.json")  # a row a role or play
    roles = {r["role"]: r["count"] for r in wells.groupBy("role").count().collect()}
    got = {"schema_version": 1, "board_id": board.board_id(wells, basis), "roles": roles, **basis}
    write_json(spark, got, f"{directory}/manifest.json")
    return got


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status: missing, unexpected or mismatched; equal files have no row."""
    x = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "mismatched")
    return x.select("path", status.alias("status")).filter("status IS NOT NULL")


#: What a model is asked to answer with.
CONTRACT = """
# Output

Answer with one JSON object {"forecasts": {"<well_id>": {"oil": [...], "gas": [...], "water": [...]}}} that holds
every well of the pad and no other, and for each phase %d numbers of zero or more: the months after the last one.
"""


def prompts(rows: DataFrame, pads: DataFrame, horizon: int = 12, metadata: DataFrame | None = None) -> DataFrame:
    """pad_id, prompt: a pad's metadata, its wells and months as a Markdown table, and the form of the
    answer.  metadata: well_id and what is known of it."""
    num = lambda c: F.coalesce(F.round(c, 1).cast("string"), F.lit(""))
    line = F.format_string("| %s | %s | %s | %s | %s |", "well_id", F.col("t").cast("string"), num("oil"), num("gas"), num("water"))
    x = rows.join(pads, "well_id").groupBy("pad_id").agg(F.array_sort(F.collect_list(F.struct("well_id", "t", line.alias("l"))))["l"].alias("lines"))
    about = F.lit("")
    if metadata is not None:
        facts = F.concat_ws(", ", *(F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in metadata.columns if c != "well_id"))
        known = metadata.join(pads, "well_id").groupBy("pad_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- **"), F.col("well_id").cast("string"), F.lit("** "), facts))), "\n").alias("facts"))
        x = x.join(known, "pad_id", "left")
        about = F.concat(F.coalesce("facts", F.lit("")), F.lit("\n\n"))
    return x.select("pad_id", F.concat(F.lit("# Pad "), "pad_id", F.lit("\n\n"), about, F.lit("| well | month | oil | gas | water |\n|---|---|---|---|---|\n"), F.array_join("lines", "\n"), F.lit("\n" + CONTRACT % horizon)).alias("prompt"))
