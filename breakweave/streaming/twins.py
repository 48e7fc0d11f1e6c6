"""Streaming forms: extraction and evaluation filters are stateless and run on streams as they are; gap clustering of
time-like positions is a session window, where a gap equal to the window stays in the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract


def stream_signals(records: DataFrame, min_size: int = 50) -> DataFrame:
    """Signals of a stream of alignment records."""
    return extract.extract_signals(records, min_size)


def stream_extra(records: DataFrame, min_clip: int = 50) -> DataFrame:
    """Extra evidence of a stream of alignment records."""
    return extract.extract_extra(records, min_clip)


def session_clusters(signals: DataFrame, window: int = 500, lateness: int = 5000) -> DataFrame:
    """Gap clusters of signals that arrive roughly in order of position, as session windows over position as seconds.

    Rows that arrive more than ``lateness`` behind the furthest position are left out, as in any stream with a watermark.
    """
    timed = signals.withColumn("at", F.timestamp_seconds("event_pos")).withWatermark("at", f"{lateness} seconds")
    return timed.groupBy("chrom", "svtype", F.session_window("at", f"{window} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("support"), F.min("event_pos").alias("first_pos"), F.max("event_pos").alias("last_pos"), F.round(F.avg("svlen"), 4).alias("mean_size")
    )
