"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.shared import stored as stash

__all__ = ["KEY", "bounded", "row_key", "stash"]

#: Bytes of an Arrow batch on its way to Python. Spark's own limit of 64 MB is held
#: several times over in the JVM and in Python, for each of an executor's tasks.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in whose session Arrow batches are kept to ``BATCH_BYTES``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: The type of ``row_key``.
KEY = "struct<a:bigint,b:bigint>"


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by the given columns; only rows equal in them share a key."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))
