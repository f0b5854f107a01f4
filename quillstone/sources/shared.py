"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}

#: How intermediate tables are written: codes repeat, and a large enough dictionary of a column chunk writes them in a third of their bytes.
WRITTEN = {"compression": "zstd", "parquet.dictionary.page.size": 8 << 20, "parquet.block.size": 64 << 20}
#: Lets the files of a write's shuffles go when it is done, instead of when the driver next collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a temporary folder in local mode, as in tests, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillstone-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage behind it, survives lost executors and is
    computed once, however often it is read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.options(**WRITTEN).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)
