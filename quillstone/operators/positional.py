"""Where tokens and characters stand: ends of lines, sections, places in lines and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import tokens as T


def top(df: DataFrame, k: int, by: list[str], count: str = "n", first: str = "first") -> DataFrame:
    """The k most frequent rows of each group, ties to the first seen."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), first))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def edge_rows(lines: DataFrame, final: bool = False) -> DataFrame:
    """Of the long table of ``lines``, the rows of first (or last) tokens: a row for each line that has any."""
    kept = [c for c in ("line_ord", "line_start") if c in lines.columns]
    size = F.size("tokens")
    return lines.filter(size > 0).select(*kept, (size - 1 if final else F.lit(0)).alias("pos"), F.element_at("tokens", -1 if final else 1).alias("token"), size.alias("size"))


def most_at_edge(rows: DataFrame, final: bool = False, k: int = 30) -> DataFrame:
    """(token, at_edge, first) of the k tokens most often first (or last) on a line; only rows at that edge are counted."""
    here = rows.filter(F.col("pos") == (F.col("size") - 1 if final else 0))
    return here.groupBy("token").agg(F.count("*").alias("at_edge"), F.min(T.place_in(rows)).alias("first")).orderBy(F.desc("at_edge"), "first").limit(k)


def edge_rates(rows: DataFrame, final: bool = False, k: int = 30, totals: DataFrame | None = None) -> DataFrame:
    """The k tokens most often first (or last) on a line, and the share of their occurrences that are.

    Occurrences are counted for those k alone, or looked up in ``totals``
    (token, total) of the whole corpus; then ``rows`` may be ``edge_rows``.
    """
    best = most_at_edge(rows, final, k).withColumnRenamed("token", "_token")  # k rows
    found = (rows if totals is None else totals).join(F.broadcast(best), F.col("token").eqNullSafe(F.col("_token")))
    if totals is None:
        found = found.groupBy("token", "at_edge", "first").agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("at_edge"), "first").select("token", "at_edge", "total", F.round(F.col("at_edge") / F.col("total"), 4).alias("rate"))


def biased(rates: DataFrame, least_rate: float = 0.4, least_count: int = 10) -> DataFrame:
    """Of the listed tokens, those with a high rate and enough occurrences."""
    return rates.filter((F.col("rate") >= least_rate) & (F.col("total") >= least_count))


def section_profiles(rows: DataFrame, k: int = 20) -> DataFrame:
    counts = rows.groupBy("section", "token").agg(F.count("*").alias("n"), F.min(T.place_in(rows)).alias("first"))
    return top(counts, k, ["section"]).select("section", "rank", "token", "n")


def word_position_profiles(rows: DataFrame, places: int = 5, k: int = 10) -> DataFrame:
    counts = rows.filter(F.col("pos") < places).groupBy("pos", "token").agg(F.count("*").alias("n"), F.min(T.place_in(rows)).alias("first"))
    return top(counts, k, ["pos"]).select((F.col("pos") + 1).alias("place"), "rank", "token", "n")


def character_position_profiles(vocabulary: DataFrame, places: int = 8) -> DataFrame:
    """Counts of characters at the first places of tokens, from types weighted by their tokens."""
    c = vocabulary.select("n", F.posexplode(F.split("token", "")).alias("p", "character")).filter((F.col("p") < places) & (F.col("character") != ""))
    return c.groupBy((F.col("p") + 1).alias("place"), "character").agg(F.sum("n").alias("n"))


def jaccard_of_edges(rows: DataFrame, k: int = 20, last: DataFrame | None = None) -> DataFrame:
    """How much the lists of the most frequent first and last tokens share; 1 where both are empty. ``last``: rows to find the last tokens in, if others."""
    sets = [most_at_edge(own, final, k).agg(F.collect_set("token").alias(name)) for own, final, name in ((rows, False, "a"), (rows if last is None else last, True, "b"))]
    both = sets[0].crossJoin(sets[1])  # one row each
    union = F.size(F.array_union("a", "b"))
    return both.select(F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union), 6).alias("jaccard"))
