"""The slot grammar over a vocabulary: each type is validated once and weighted by its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import tokens as T

#: The share of valid tokens from which the grammar counts as supported.
SUPPORTED = 0.70


def validated(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with the fields of ``validate``; other columns are kept."""
    # a column for each state, so that each pattern is tried once for a type
    out = vocabulary.withColumn("_s0", T.segmented(F.col("token")))
    for k in range(len(T.SLOTS)):
        out = out.withColumn(f"_s{k + 1}", T.after_slot(F.col(f"_s{k}"), k))
    states = [F.col(f"_s{k}") for k in range(len(T.SLOTS) + 1)]
    return out.withColumn("v", T.validate(F.col("token"), states)).select(*vocabulary.columns, "v.*")


def coverage(checked: DataFrame, by: list[str] = (), threshold: float = SUPPORTED) -> DataFrame:
    share = F.coalesce(F.try_divide(F.sum(F.when(F.col("is_valid"), F.col("n")).otherwise(0)), F.sum("n")), F.lit(0.0))
    doubt = T.has_uncertainty(F.col("token")) | (F.col("token") == "")
    return checked.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("is_valid"), F.col("n")).otherwise(0)), F.lit(0)).alias("n_valid"),
        F.round(share, 6).alias("coverage"), (share >= threshold).alias("supported"), F.coalesce(F.sum(F.when(doubt, F.col("n")).otherwise(0)), F.lit(0)).alias("n_uncertain"),
    )


def usage(checked: DataFrame) -> DataFrame:
    """How many valid tokens use each slot, repeats within a token once."""
    return checked.filter("is_valid").select("n", F.explode("matched_slots").alias("slot")).groupBy("slot").agg(F.sum("n").alias("n"))


def failures(checked: DataFrame) -> DataFrame:
    bad = checked.filter("NOT is_valid").groupBy("failure_category").agg(F.sum("n").alias("n"))
    total = bad.agg(F.sum("n").alias("t"))
    return bad.crossJoin(F.broadcast(total)).select("failure_category", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row


def most_invalid(checked: DataFrame, k: int = 30) -> DataFrame:
    return checked.filter("NOT is_valid").orderBy(F.desc("n"), "first").limit(k).select("token", "n", "failure_category")
