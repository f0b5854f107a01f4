"""Token counts over a stream of lines, beyond what the batch reports need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import tokens as T


def windowed_counts(lines: DataFrame, time: str = "ts", text: str = "text", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, token, n) for each tumbling window; lines later than ``late`` are let go with their window's state."""
    rows = lines.withWatermark(time, late).select(time, F.explode(T.plain_tokens(F.col(text))).alias("token"))
    return rows.groupBy(F.window(time, width), "token").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "token", "n")
