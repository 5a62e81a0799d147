"""Landing of market payloads as a stream.

Our own extension: what is done in batches elsewhere, done as data arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import freshness


def landed(stream: DataFrame, key: list[str], moment: str, late: str = "1 day") -> DataFrame:
    """Rows of a stream without repeats of a key within the watermark; later ones are dropped."""
    return stream.withWatermark(moment, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, group: str, moment: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, least, greatest and mean value of each group and window of time."""
    return stream.withWatermark(moment, late).groupBy(F.window(moment, width), group).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")).select("window.start", "window.end", group, "n", "low", "high", "mean")


def classified(batch: DataFrame, as_of: str, present: str) -> DataFrame:
    """A micro-batch with the freshness of each row at the batch's own latest moment."""
    last = batch.agg(F.max(as_of).alias("__last"))
    return batch.join(F.broadcast(last)).withColumn("status", freshness.market_status(F.col(present).isNotNull(), F.col(as_of), F.col("__last"))).drop("__last")
