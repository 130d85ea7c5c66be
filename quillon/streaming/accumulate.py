"""Statistics of a stream under fixed parameters: they are sums, so each micro-batch adds its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.statistics import long_form, merge
from quillon.plans.model import Params


def follow(rows: DataFrame, p: Params, d: int, path: str, checkpoint: str, kl: bool = False, **trigger) -> StreamingQuery:
    """Write every batch's sums (long form) to a folder of its own under path; a batch that is run again replaces its own."""
    def add(batch: DataFrame, number: int) -> None:
        long_form(batch, p, d, kl=kl).na.fill(0.0, ["v"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def total(spark, path: str) -> DataFrame:
    """The sums of all batches so far."""
    return merge(spark.read.parquet(path))


def windowed(events: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """Count and moments of a value by event-time window; rows later than `late` are left out by the watermark."""
    x = F.col(value)
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
