"""Helpers shared by the training-data operators.

Lineage is cut only in the folder that the cluster names in ``spark.checkpoint.dir``
(shared by driver and executors).  A folder of our own is used only where that setting
is absent and everything runs in one process, as in unit tests; on a cluster its absence is
an error.  Written intermediates are deleted as soon as nothing reads them, the rest when the
driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space, spelled out: Python's own ``\s`` also takes U+001C..U+001F.
WS = "\t-\r \x85\xa0  -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="taperflow-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back (columns can then be pruned)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/taperflow-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _WRITTEN[path] = spark
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        _delete(df.written_path)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def doc_crc32() -> F.Column:
    """crc32 of doc_id written as text; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def near_first(rows: DataFrame, near: F.Column, group: str, counts: dict, n: int) -> DataFrame:
    """The rows of which ``near``, an even hash of 32 bits, is among about the 2 * n smallest of
    their group (counts: rows by group).  Before a window that picks the n smallest, this keeps
    what one task reads within a bound that doesn't grow with the input."""
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    most = [(value, min(2**32, -(-(2 * n << 32) // max(1, c)))) for value, c in counts.items()]
    key, limit = fresh(rows, "_group", "_limit")
    limits = spark.createDataFrame(most, f"{key} {kind}, {limit} long")  # a row a group
    return rows.join(F.broadcast(limits), F.col(group) == F.col(key)).filter(near < F.col(limit)).drop(key, limit)


_CUT = {ascii: re.compile(rf"(?<=[^{c}])(?=[{c}])") for ascii, c in ((False, WS), (True, "\t-\r "))}


def slices(text: str, size: int = 1 << 20, ascii_spaces: bool = False):
    """Cut a text between a non-space and a following space, into parts of about ``size``
    characters, so that one huge text never becomes one huge list of words."""
    at = 0
    while len(text) - at > size:
        m = _CUT[ascii_spaces].search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text
