"""Writers of corpora, reports and tables."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str, version: str = "unknown") -> None:
    """Parsed lines (file, n and the canonical columns) as Parquet, written by the executors, with ``line_ord`` in order of file and line.

    A file's number is its place among the files' names, of which the driver
    sees a count; lines are numbered below 2**32 in each file.
    """
    files = rows.select("file").distinct()
    number = F.row_number().over(Window.orderBy("file")) - 1  # a row for each file
    ranked = rows.join(files.withColumn("_file", number.cast("bigint")), "file")
    own = ranked.withColumn("line_ord", F.shiftleft("_file", 32) + F.col("n")).drop("_file", "file", "n").withColumn("transcription_version", F.lit(version))
    own.write.mode("overwrite").parquet(path)


def finite(value):
    """``value`` with non-finite numbers, which JSON lacks, as null."""
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_report(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(finite(report), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def write_table(df: DataFrame, path: str) -> None:
    """A result as CSV with a header; arrays are joined by blanks."""
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)
