"""Neighbours in a global order, and exact shares of rows, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def below(bounds: Column, steps: int, key: Column, inclusive: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``key`` (or not above it), by binary search."""
    def step(s, _):
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        at = F.get(bounds, mid)
        up = (s.lo < s.hi) & ((at <= key) if inclusive else (at < key))
        return F.struct(F.when(up, mid + 1).otherwise(s.lo).alias("lo"), F.when((s.lo < s.hi) & ~up, mid).otherwise(s.hi).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, steps))), start, step, lambda s: s.lo)


def numbered_ranges(df: DataFrame, key: str, parts: int, tie: Column | None = None) -> DataFrame:
    """Adds ``_part``: the number, from 0 to below ``parts``, of the range of ``key`` (a number without nulls) that a row is in.

    The ranges hold about as many rows each; approximate bounds only decide
    where they are cut. Rows of one key share a range, unless ``tie``, a
    number from 0 up to 1 that orders them, lets a frequent key have several.
    The bounds are a table of one row, so the plan does not grow with them.
    """
    bounds = sorted(int(b) for b in df.approxQuantile(key, [k / parts for k in range(1, parts)], 0.2 / parts)) if parts > 1 else []
    if not bounds:
        return df.withColumn("_part", F.lit(0))
    if tie is None:
        bounds = sorted(set(bounds))
    table = df.sparkSession.createDataFrame([(bounds,)], "_bounds array<bigint>")
    with_bounds = df.crossJoin(F.broadcast(table))  # one row
    steps = len(bounds).bit_length()
    part = below(F.col("_bounds"), steps, F.col(key), True)
    if tie is not None:
        low = below(F.col("_bounds"), steps, F.col(key), False)
        part = F.least(part, low + F.floor(tie * (part - low + 1)).cast("int"))
    return with_bounds.withColumn("_part", part).drop("_bounds")


def with_next(df: DataFrame, key: str, value: str, parts: int | None = None) -> DataFrame:
    """Adds ``following``: ``value`` of the next row by ``key`` (a number, unique), null at the last.

    Rows are cut into ranges of the key; within a range a window looks ahead,
    and a table with a row for each range gives what comes after its last row.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = numbered_ranges(df, key, parts)
    heads = cut.groupBy("_part").agg(F.min_by(value, key).alias("_head"))
    # a row for each range
    ahead = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_ahead"))
    inside = Window.partitionBy("_part").orderBy(key)
    last = F.lead(key).over(inside).isNull()
    out = cut.withColumn("_last", last).withColumn("_next", F.lead(value).over(inside)).join(F.broadcast(ahead), "_part")
    return out.withColumn("following", F.when(F.col("_last"), F.col("_ahead")).otherwise(F.col("_next"))).drop("_part", "_last", "_next", "_ahead")


def hashed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def smallest_by_hash(df: DataFrame, key: str, share: float, seed: int) -> Column:
    """A condition that holds for exactly max(1, int(n * share)) of the n rows, those whose keys hash smallest.

    Found from counts of leading digits: only the slot in which the number is
    reached is looked at row by row.
    """
    h = hashed(F.col(key), seed)
    slots = df.groupBy(F.substring(h, 1, 4).alias("slot")).agg(F.count("*").alias("n")).orderBy("slot").collect()  # 65536 at most
    wanted, before = max(1, int(sum(r["n"] for r in slots) * share)), 0
    for r in slots:
        if before + r["n"] >= wanted:
            own = df.filter(F.substring(h, 1, 4) == r["slot"]).select(h.alias("h")).orderBy("h").limit(wanted - before)
            return h <= F.lit(own.agg(F.max("h")).first()[0])
        before += r["n"]
    return F.lit(False)
