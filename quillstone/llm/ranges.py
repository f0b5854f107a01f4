"""Cutting a table into ranges of any sort key, so that no task's rows grow with one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillstone.operators.order import below

#: Sampled keys for each range, and characters of a key that a bound keeps.
KEYS_A_RANGE, BOUND_CHARS = 100, 200


def sampled_bounds(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """One row with ``_bounds``: at most ``parts`` - 1 values of ``key`` (a struct), sorted, that cut ``df`` into about equal ranges.

    They are taken from a sample of ``KEYS_A_RANGE`` rows a range, so the
    driver sees a number of keys that depends on ``parts`` alone. Where the
    cuts are makes no difference to any result.
    """
    spark = df.sparkSession
    keys = df.select(key.alias("k"))
    wanted = KEYS_A_RANGE * parts
    share = min(1.0, wanted / max(1, keys.count()))
    found = sorted((r["k"] for r in keys.sample(share, 11).limit(2 * wanted).collect())) if parts > 1 else []
    cuts = [found[len(found) * j // parts] for j in range(1, parts)] if found else []
    kept = [c for j, c in enumerate(cuts) if not j or cuts[j - 1] != c]
    return spark.createDataFrame([(kept,)], f"_bounds {ArrayType(keys.schema['k'].dataType).simpleString()}")


def range_of(key: Column, bounds: Column, parts: int) -> Column:
    """The number of the range that ``key`` is in, from 0 to ``parts`` - 1."""
    return below(bounds, parts.bit_length(), key, True)


def dealt(df: DataFrame, parts: int, *order: str | Column) -> DataFrame:
    """Each range (``_part``) of ``df`` in a task of its own, in ``order``."""
    return df.repartitionById(parts, "_part").sortWithinPartitions("_part", *order)
