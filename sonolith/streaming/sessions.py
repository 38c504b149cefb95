"""Streaming forms of the span operators: keyed sessions under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_spans(frames: DataFrame, recording: str, time: str, gap: str, delay: str, aggs: list[Column] | None = None) -> DataFrame:
    """Spans of events of a recording that follow one another within ``gap``; on a stream closed once ``delay`` has passed.

    The same function gives the batch result on a batch DataFrame. Where a span's end is to be that of its last frame,
    subtract the gap.
    """
    f = frames.withColumn(time, F.col(time).cast("timestamp"))
    if f.isStreaming:
        f = f.withWatermark(time, delay)
    s = f.groupBy(F.col(recording).alias("recording"), F.session_window(time, gap)).agg(F.count("*").alias("n"), *(aggs or []))
    return s.select("recording", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in s.columns if c not in ("recording", "session_window")])


def pooled_levels(events: DataFrame, recording: str, time: str, value: str, size: str, delay: str) -> DataFrame:
    """Tumbling frames of a recording: mean level in dB and count."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, delay)
    f = e.groupBy(F.window(time, size), F.col(recording).alias("recording")).agg((20 * F.log10(F.avg(F.abs(value)) + 1e-12)).alias("level"), F.count("*").alias("n"))
    return f.select("recording", F.col("window.start").alias("start"), "level", "n")
