"""Usage rows as a stream: windowed cost per script, with late rows up to a watermark. (An extension: batch rollups are in operators.usage.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_usage(events: DataFrame, ts: str = "ts", by: str = "event_type", measure: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, by, calls and total of each window; state is dropped once the watermark has passed it."""
    return (
        events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by)
        .agg(F.count("*").alias("calls"), F.sum(measure).alias("total"))
        .select(F.col("w.start").alias("start"), by, "calls", "total")
    )
