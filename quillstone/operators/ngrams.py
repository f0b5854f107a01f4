"""Sequences of tokens within lines, and the mutual information of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.operators.entropy import entropy_of


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a line; a shorter line has none."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, made).otherwise(F.slice(made, 1, 0))


def counted(lines: DataFrame, n: int) -> DataFrame:
    """(gram, n, first) over all lines; tokens may be words or their codes."""
    kept = [c for c in ("line_ord", "line_start") if c in lines.columns]
    # columns of their own are grouped by without an array for each occurrence
    names = [f"g{k}" for k in range(n)]
    places = lines.filter(F.size("tokens") >= n).select(*kept, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - n)).alias("pos"))
    rows = places.select(*kept, "pos", *(F.get("tokens", F.col("pos") + k).alias(c) for k, c in enumerate(names)))
    counts = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min(T.place_in(rows)).alias("first"))
    return counts.select(F.array(*names).alias("gram"), "n", "first")


def most_common(counts: DataFrame, k: int = 30) -> DataFrame:
    return counts.orderBy(F.desc("n"), "first").limit(k).select(F.array_join("gram", " ").alias("gram"), "n")


def pair_entropy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(entropy_of(), 6).alias("bigram_entropy"))


def mutual_information(pairs: DataFrame, vocabulary: DataFrame, least: int = 5) -> DataFrame:
    """(w1, w2, n, pmi, first) of the pairs seen at least ``least`` times.

    A pair's probability is its share of the occurrences of such pairs; a
    token's is its share of all tokens.
    """
    kept = pairs.filter(F.col("n") >= least).select(F.col("gram")[0].alias("w1"), F.col("gram")[1].alias("w2"), "n", "first")
    sums = kept.agg(F.sum("n").alias("np")).crossJoin(vocabulary.agg(F.sum("n").alias("nt")))  # one row
    own = vocabulary.select("token", F.col("n").alias("c"))
    joined = kept.join(own.toDF("w1", "c1"), "w1").join(own.toDF("w2", "c2"), "w2").crossJoin(F.broadcast(sums))
    p12, p1, p2 = F.col("n") / F.col("np"), F.col("c1") / F.col("nt"), F.col("c2") / F.col("nt")
    return joined.select("w1", "w2", "n", F.log2(p12 / (p1 * p2)).alias("pmi"), "first")


def strongest(pmi: DataFrame, k: int = 30, low: bool = False) -> DataFrame:
    """The k pairs of highest (or lowest) mutual information, then those above (below) zero; compared to nine places."""
    order = F.round("pmi", 9)
    best = pmi.orderBy(order.asc() if low else order.desc(), F.col("first").desc() if low else F.col("first").asc()).limit(k)
    return best.filter(order < 0 if low else order > 0).select("w1", "w2", "n", F.round("pmi", 6).alias("pmi"))


def totals(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences of tokens, pairs and triples, and types."""
    size = F.size("tokens")
    sums = lines.agg(F.sum(size).alias("n_tokens"), F.sum(F.greatest(size - 1, F.lit(0))).alias("n_bigrams"), F.sum(F.greatest(size - 2, F.lit(0))).alias("n_trigrams"))
    return sums.crossJoin(vocabulary.agg(F.count("*").alias("n_types")))  # one row each
