"""Job events as a stream: the same answers as the batch forms, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "tile_id STRING, source STRING, status STRING, seq LONG, ts TIMESTAMP, seconds DOUBLE"


def read(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Events that are appended as Parquet files to a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """Last status of each (tile_id, source) by seq, in update or complete mode; late events change nothing that is newer."""
    return events.groupBy("tile_id", "source").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def throughput(events: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Finished and failed tiles for each window of time, later events than the watermark dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "source")
    return w.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed")).select(F.col("window.start").alias("start"), "source", "ok", "failed")


def heartbeats(events: DataFrame, gap: str = "90 seconds", late: str = "5 minutes") -> DataFrame:
    """Sessions of sources: one ends when nothing is heard for ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "source")
    return s.agg(F.count("*").alias("beats")).select("source", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats")
