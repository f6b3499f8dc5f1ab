"""Fitted transforms on streams, and windowed profiles of events. An extension beyond batch analysis.

Transforms that were fitted on a batch are projections, so they run on a stream unchanged; the
operators with state bound it by a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions.nulls import unify_nans


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


def apply_fitted(stream: DataFrame, *transforms) -> DataFrame:
    """Unifies missing values, then applies fitted transforms (anything with ``apply``) in order."""
    out = unify_nans(stream)
    for t in transforms:
        out = t.apply(out)
    return out


def first_deliveries(stream: DataFrame, id_col: str, time_col: str, delay: str = "7 days") -> DataFrame:
    """Each identifier's first delivery; state older than the watermark is forgotten, later repeats than that come through."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def windowed_profile(stream: DataFrame, time_col: str, keys: Sequence[str], x: str, width: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Count, missing share, mean and spread of x per window of event time and key; windows close after ``delay``."""
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    g = stream.withWatermark(time_col, delay).groupBy(w.alias("w"), *keys)
    agg = g.agg(F.count("*").alias("n"), F.avg(F.col(x).isNull().cast("double")).alias("nan_freq"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "nan_freq", "mean", "sd")


def write_stream(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream over what is there and stops; started again, it goes on where it stopped."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start()
