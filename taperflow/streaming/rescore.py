"""An extension: rescoring of forecasts as actual months arrive, by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics


def rescore(actuals: DataFrame, forecasts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch of actuals (well_id, phase, h, actual) appends cumulative log errors of
    the wells in it to a Parquet table."""

    def each(batch: DataFrame, number: int) -> None:
        pairs = batch.join(forecasts.withColumnRenamed("volume", "forecast"), ["well_id", "phase", "h"])
        metrics.cumulative(pairs, ["well_id", "phase"]).write.mode("append").parquet(path)

    return actuals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
