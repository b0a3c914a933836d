"""Counting operators on streams: an extension, as the word table grows by appended batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import word_tokens


def word_counts(stream: DataFrame, time: str, text: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Words by window; rows later than ``late`` are dropped by the watermark, which bounds the state."""
    words = stream.withWatermark(time, late).select(time, F.explode(word_tokens(F.lower(text))).alias("word"))
    return words.groupBy(F.window(time, window).alias("window"), "word").agg(F.count(F.lit(1)).alias("n"))


def event_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), kind).agg(F.count(F.lit(1)).alias("n"))
