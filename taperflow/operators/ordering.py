"""Running numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of these columns (which should tell all rows apart).

    Rows are sorted by ranges; a row's number is its place in its range plus the rows of the ranges
    before, of which one count each comes to the driver."""
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    x = cut(x.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    before, at = [], 0
    for r in x.groupBy("_range").count().orderBy("_range").collect():  # a row a range
        before.append((r["_range"], at))
        at += r["count"]
    starts = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_place")) - 1
    return x.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_place", "_own", "_before")
