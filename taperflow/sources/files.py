"""File sources: canonical and raw histories, metadata, snapshots, forecasts, boards, overrides.

Identifiers are text throughout; volumes that are blank, NaN or infinite are null.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import PHASES, month_number, pad_or_self, parse_month, parse_volume, unreadable_volume
from ..operators import calendar
from ..operators.lineage import cut

# Header aliases, first hit wins.
ALIASES = {
    "well_id": ("well_id", "api", "api10", "api12", "api14", "uwi", "well", "wellid", "entity_id", "well_number"),
    "month": ("month", "prod_month", "production_month", "date", "prod_date", "report_month", "production_date"),
    "oil": ("oil", "oil_bbl", "oil_volume", "oil_volume_bbl", "oil_prod", "oil_production", "monthly_oil"),
    "gas": ("gas", "gas_mcf", "gas_volume", "gas_volume_mcf", "gas_prod", "gas_production", "monthly_gas"),
    "water": ("water", "water_bbl", "water_volume", "water_volume_bbl", "water_prod", "water_production", "monthly_water"),
    "pad_id": ("pad_id", "pad", "pad_name", "lease", "lease_id", "facility_id"),
    "operator": ("operator", "operator_name", "current_operator"),
    "basin": ("basin", "play", "formation", "reservoir", "sub_basin"),
    "well_name": ("well_name", "name"),
    "lateral_length_ft": ("lateral_length_ft", "lateral_ft", "lateral_length", "perf_length_ft", "completed_length_ft"),
    "latitude": ("latitude", "lat", "surface_latitude", "bottom_latitude"),
    "longitude": ("longitude", "lon", "lng", "surface_longitude", "bottom_longitude"),
    "first_prod_date": ("first_prod_date", "first_production_date", "first_prod_month"),
}


def read_csv(spark: SparkSession, path) -> DataFrame:
    """All columns as text; a byte order mark before the header is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})


def resolve_headers(df: DataFrame) -> DataFrame:
    """Columns by their canonical names."""
    plain = {re.sub(r"[ \-/]", "_", c.strip().lower()): c for c in df.columns}
    return df.withColumnsRenamed({plain[next(a for a in names if a in plain)]: name for name, names in ALIASES.items() if any(a in plain for a in names)})


def exists(spark: SparkSession, path: str) -> bool:
    """Also on file systems that only Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def read_history(spark: SparkSession, path, gaps: str = "error", duplicates: str = "error") -> DataFrame:
    """well_id, month, t, oil, gas, water of a canonical history.  Repeated months are an error or
    summed ("sum"); months missing between a well's first and last are an error, null ("missing") or
    zero ("zero"); unreadable numbers are an error, blank and NaN ones null."""
    df = read_csv(spark, path)
    for c in ("well_id", "month"):
        if c not in df.columns:
            raise ValueError(f"the history has no column {c}")
    month = F.col("month").cast("date")
    told = lambda p: F.raise_error(F.concat(F.lit(f"unreadable {p} volume: "), F.col(p))).cast("double")
    volume = lambda p: F.when(unreadable_volume(F.col(p)), told(p)).otherwise(parse_volume(F.col(p)))
    rows = df.select("well_id", month_number(month).alias("t"), *((volume(p) if p in df.columns else F.lit(None).cast("double")).alias(p) for p in PHASES))
    rows = calendar.fill_gaps(calendar.sum_duplicates(rows, duplicates), gaps).drop("inserted")
    first = F.make_date(F.floor(F.col("t") / 12).cast("int"), (F.col("t") % 12 + 1).cast("int"), F.lit(1))
    return rows.select("well_id", first.alias("month"), "t", *PHASES)


def read_metadata(spark: SparkSession, directory: str) -> DataFrame | None:
    """wells.csv, one row a well (the last of the file wins); None without a file."""
    path = f"{directory}/wells.csv"
    if not exists(spark, path):
        return None
    df = read_csv(spark, path).withColumn("_n", F.monotonically_increasing_id())
    cols = [c for c in df.columns if c not in ("well_id", "_n")]
    return df.groupBy("well_id").agg(*(F.max_by(c, "_n").alias(c) for c in cols))


def read_raw(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a raw monthly file: aliases, four month formats, thousands commas.
    Rows without a well id are skipped; unreadable months, unreadable numbers and negative volumes
    are rejects with a reason."""
    df = resolve_headers(read_csv(spark, path)).filter("trim(well_id) <> ''")
    have = [p for p in PHASES if p in df.columns]
    bad = F.lit(False)
    for p in have:
        bad = bad | unreadable_volume(F.col(p))
    x = df.select(F.trim("well_id").alias("well_id"), F.col("month").alias("raw_month"), parse_month(F.col("month")).alias("month"), *((parse_volume(F.col(p)) if p in have else F.lit(None).cast("double")).alias(p) for p in PHASES), bad.alias("unreadable"))
    negative = F.lit(False)
    for p in PHASES:
        negative = negative | F.coalesce(F.col(p) < 0, F.lit(False))
    x = x.withColumn("reason", F.when(F.col("month").isNull(), "bad_month").when(F.col("unreadable"), "bad_number").when(negative, "negative_volume"))
    good = x.filter("reason IS NULL").select("well_id", "month", month_number(F.col("month")).alias("t"), *PHASES)
    return good, x.filter("reason IS NOT NULL").select("well_id", "raw_month", "reason")


def read_headers(spark: SparkSession, path) -> DataFrame:
    """Well metadata of a raw file; a blank pad is the well itself."""
    df = resolve_headers(read_csv(spark, path)).filter("trim(well_id) <> ''")
    pad = F.col("pad_id") if "pad_id" in df.columns else F.lit(None).cast("string")
    keep = [c for c in ALIASES if c in df.columns and c not in ("well_id", "pad_id", "month", *PHASES)]
    return df.select(F.trim("well_id").alias("well_id"), pad_or_self(pad, F.trim("well_id")).alias("pad_id"), *keep)


#: Gap policies of a manifest by the name that it has there.
GAPS = {"nan": "missing", "missing": "missing", "zero": "zero", "error": "error"}


def read_input(spark: SparkSession, directory: str, gaps: str | None = None) -> DataFrame:
    """history.csv, or the training side of a snapshot (pads.json, train/*.csv).  The gap policy is
    the one given, else the manifest's, else missing months are null."""
    if gaps is None and exists(spark, f"{directory}/manifest.json"):
        gaps = json.loads(read_text(spark, f"{directory}/manifest.json")).get("gap_policy")
    gaps = gaps or "nan"
    if gaps not in GAPS:
        raise ValueError(f"unknown gap policy {gaps!r}")
    if exists(spark, f"{directory}/history.csv"):
        return read_history(spark, f"{directory}/history.csv", GAPS[gaps])
    if exists(spark, f"{directory}/pads.json"):
        return read_history(spark, f"{directory}/train/*.csv", GAPS[gaps])
    raise FileNotFoundError(f"neither history.csv nor pads.json in {directory}")


def read_snapshot(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pads, train, holdout); both sides must hold the same wells."""
    pads = spark.createDataFrame([(p["pad_id"], w if isinstance(w, str) else w["well_id"]) for p in json.loads(read_text(spark, f"{directory}/pads.json")) for w in p["wells"]], "pad_id string, well_id string")
    train, hold = (read_history(spark, f"{directory}/{side}/*.csv", "missing") for side in ("train", "holdout"))
    one = train.select("well_id").distinct().withColumn("a", F.lit(1)).join(hold.select("well_id").distinct().withColumn("b", F.lit(1)), "well_id", "full").filter("a IS NULL OR b IS NULL")
    missing = [r[0] for r in one.orderBy("well_id").limit(5).collect()]
    if missing:
        raise ValueError(f"wells on one side only: {missing}")
    return pads, train, hold


def read_precomputed(spark: SparkSession, path: str) -> DataFrame:
    """well_id, phase, h, volume of JSON forecasts (wrapped or bare); unknown phases are ignored,
    a well in two files is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = "map<string,map<string,array<double>>>"
    wrapped = F.from_json("value", f"forecasts {kind}")["forecasts"]
    told = F.raise_error(F.concat(F.lit("no forecasts can be read in "), F.col("file"))).cast(kind)
    m = raw.select("file", F.coalesce(wrapped, F.from_json("value", kind), told).alias("m"))
    wells = m.select("file", F.explode("m").alias("well_id", "p"))
    twice = [r[0] for r in wells.groupBy("well_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"wells in several files: {twice}")
    x = wells.select("well_id", F.explode("p").alias("phase", "v")).filter(F.col("phase").isin(*PHASES))
    return x.select("well_id", "phase", F.posexplode("v").alias("h", "volume")).withColumn("h", (F.col("h") + 1).cast("int"))


def read_board(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame, dict]:
    """(wells, series, manifest); a repeated (well, split, month) is an error."""
    wells = read_csv(spark, f"{directory}/wells.csv")
    s = read_csv(spark, f"{directory}/series.csv")
    series = s.select("well_key", F.col("month").cast("date").alias("month"), *(parse_volume(F.col(p)).alias(p) for p in PHASES), "split")
    if not series.groupBy("well_key", "split", "month").count().filter("count > 1").isEmpty():
        raise ValueError("the board repeats months")
    return wells, series, json.loads(read_text(spark, f"{directory}/manifest.json"))


def read_overrides(spark: SparkSession, path: str, horizon: int) -> tuple[DataFrame, dict]:
    """(well_id, phase, h, volume) and the audit of an approved package; strict."""
    got = json.loads(read_text(spark, path))
    for k in ("approver", "approved_at"):
        if not str(got.get(k) or "").strip():
            raise ValueError(f"overrides need {k}")
    if not re.match(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$", got["approved_at"]):
        raise ValueError("approved_at isn't an ISO-8601 time")
    rows, seen = [], set()
    for o in got.get("overrides", []):
        key, v = (o.get("well_id"), o.get("phase")), o.get("values", [])
        if not all(key) or key[1] not in PHASES or key in seen or not str(o.get("reason") or "").strip() or len(v) != horizon or not all(isinstance(x, (int, float)) and 0 <= x < float("inf") for x in v):
            raise ValueError(f"bad override {key}")
        seen.add(key)
        rows += [(*key, h, float(x)) for h, x in enumerate(v, 1)]
    audit = {"approver": got["approver"], "approved_at": got["approved_at"], "source": PurePosixPath(path).name, "count": len(seen)}
    return spark.createDataFrame(rows, "well_id string, phase string, h int, volume double"), audit


def _object_end(text: str, begin: int) -> int | None:
    """Behind the brace that closes the one at ``begin``; braces within strings don't count."""
    depth, quoted, escaped = 0, False, False
    for at in range(begin, len(text)):
        c = text[at]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
            continue
        quoted = c == '"'
        depth += {"{": 1, "}": -1}.get(c, 0)
        if not depth:
            return at + 1
    return None


def parse_response(text: str) -> dict | None:
    """Forecasts in a model's answer: fenced JSON, else the balanced object that holds
    "forecasts", else with up to three closing braces added; None if none can be read."""
    tries = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for m in re.finditer(r"\{", text):
        end = _object_end(text, m.start())
        tries += [text[m.start() : end]] if end else [text[m.start() :].rstrip() + "}" * k for k in (1, 2, 3)]
        if '"forecasts"' in text[m.start() : end]:
            break
    for t in tries:
        try:
            got = json.loads(t, strict=False)
        except ValueError:
            continue
        if isinstance(got, dict) and "forecasts" in got:
            return got
    return None


RESPONSE = "pad_id string, problem string, forecasts array<struct<well_id:string,phase:string,v:array<double>>>"


def promote_responses(responses: DataFrame, roster: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(forecasts, failures) of models' answers (pad_id, text).  A pad is taken whole or not at all:
    all wells of the roster (pad_id, well_id), no others, vectors of ``horizon`` numbers of zero or
    more.  forecasts: pad_id, well_id, phase, h, volume; failures: pad_id, problem."""
    expected = roster.groupBy("pad_id").agg(F.collect_set("well_id").alias("wells"))  # a pad's wells
    asked = expected.join(responses.select("pad_id", "text"), "pad_id", "left").select("pad_id", "wells", "text")

    def judged(text: str | None, wells: set[str]) -> tuple[str | None, list]:
        got = parse_response(text or "")
        if got is None or not isinstance(got["forecasts"], dict):
            return "no forecasts can be read", []
        found = got["forecasts"]
        if wells - set(found):
            return f"missing wells {sorted(wells - set(found))}", []
        out = []
        for well, phases in found.items():
            if well not in wells:
                return f"unknown well {well}", []
            if not isinstance(phases, dict):
                return f"{well}: no phases", []
            for phase, v in phases.items():
                if not isinstance(v, list) or len(v) != horizon:
                    return f"{well}/{phase}: {len(v) if isinstance(v, list) else 0} months, want {horizon}", []
                if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x < float("inf") for x in v):
                    return f"{well}/{phase}: non-numeric or negative value", []
                out.append({"well_id": well, "phase": phase, "v": [float(x) for x in v]})
        return None, out

    def run(batches):
        kind = pa.list_(pa.struct([("well_id", pa.string()), ("phase", pa.string()), ("v", pa.list_(pa.float64()))]))
        for b in batches:
            got = [judged(t, set(w)) for w, t in zip(b.column("wells").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("pad_id"), pa.array([p for p, _ in got], pa.string()), pa.array([f for _, f in got], kind)], names=["pad_id", "problem", "forecasts"])

    x = cut(asked.mapInArrow(run, RESPONSE))
    good = x.filter("problem IS NULL").select("pad_id", F.explode("forecasts").alias("f"))
    good = good.select("pad_id", "f.well_id", "f.phase", F.posexplode("f.v").alias("h", "volume")).withColumn("h", (F.col("h") + 1).cast("int"))
    return good, x.filter("problem IS NOT NULL").select("pad_id", "problem")


def database_url(name: str = "DATABASE_URL", env_file: str | None = None) -> str:
    """A database's address from the environment, else from a file of NAME=value lines."""
    got = os.environ.get(name)
    if not got and env_file and os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                key, _, value = line.strip().partition("=")
                if key.strip() == name and not line.lstrip().startswith("#"):
                    got = value.strip().strip("'\"")
    if not got:
        raise RuntimeError(f"{name} isn't set")
    return got


def provenance_rows(spark: SparkSession, url: str, table: str, wells: list[str]) -> DataFrame:
    """Months with their reporting method and producing days of a frozen board's wells, by a read-only
    query whose filters go to the database.  wells: the board's keys, letters, digits, - and _ only."""
    if not wells or any(not re.fullmatch(r"[\w-]+", w) for w in wells):
        raise ValueError("well keys must be plain")
    listed = ", ".join(f"'{w}'" for w in sorted(set(wells)))
    return read_jdbc(spark, url, f"SELECT well_id, month, method, days FROM {validated_table(table)} WHERE well_id IN ({listed})")


def validated_table(name: str) -> str:
    """A plain schema.table name, safe for spark.table."""
    if not re.fullmatch(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000) -> DataFrame:
    """A read-only query of a database; filters and columns are pushed down by Spark."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=fetch).load()


def seeds(text: str) -> list[int]:
    """"1-30,101" as sorted distinct numbers."""
    out = set()
    for part in filter(None, map(str.strip, text.split(","))):
        a, _, b = part.partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return sorted(out)
