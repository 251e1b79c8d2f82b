"""Scores over streams: scorers hold no state, so only the windowed monitor needs a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.names import unused


def timed(df: DataFrame, time: str, late: str) -> tuple[str, DataFrame]:
    """df with its time as a timestamp that has a watermark, and that column's name. The time may lack a zone: it is read in
    the session's."""
    [at] = unused(df.columns, "_at")
    return at, df.withColumn(at, F.col(time).cast("timestamp")).withWatermark(at, late)


def windowed_scores(scored: DataFrame, score: str, time: str = "ts", window: str = "1 day", late: str = "1 day", by: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Mean score and count by time window (and other columns), for batches and streams; rows later than ``late`` are
    dropped from a stream. With ``slide``, windows overlap: one begins each ``slide``."""
    at, df = timed(scored, time, late)
    grouped = df.groupBy(F.window(at, window, slide), *by).agg(F.avg(score).alias("score"), F.count(score).alias("n"))
    return grouped.select(F.col("window.start").alias("start"), *by, "score", "n")
