"""Windows over streams: coordinate windows of arriving reads, and time windows of events with late rows.

The batch operators that need no state run on streams as they are; what is counted is kept by Spark's state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.joins import windowed_reads


def window_objects(reads: DataFrame, width: int = 201, shifts: int = 3) -> DataFrame:
    """(wstart, wseq, weight): different reads of every coordinate window and their number, of a stream of placed reads.

    Without a watermark, as coordinates don't pass like time: the state holds the different reads of all windows, and the
    output mode is update or complete."""
    return windowed_reads(reads, width, shifts).groupBy("wstart", "wseq").agg(F.count(F.lit(1)).alias("weight"))


def event_windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, end, key, n, total) of time windows; rows more than ``late`` behind the latest time seen are dropped, and a
    window is final (append mode) once the watermark has passed its end."""
    w = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    counted = events.withWatermark(time, late).groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")


def write_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived and stop: a restart from the same checkpoint goes on after it, each row once."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
