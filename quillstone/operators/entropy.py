"""Entropy of tokens and characters, and the rank-frequency fit."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.draws import PRIME, folded
from quillstone.operators.order import with_next
from quillstone.sources.shared import stored

#: Fewer types than this have no rank-frequency fit.
LEAST_TYPES = 5
#: Ranks that one row of the fit's work covers before it is exploded.
RANKS = 10_000


def entropy_of(count: str = "n") -> Column:
    """Shannon's entropy in bits over a group of counts, 0 where there are none."""
    c = F.col(count)
    return F.greatest(F.lit(0.0), F.coalesce(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c), F.lit(0.0)))


def _across(lines: DataFrame, head: Column, tail: Column) -> DataFrame:
    """(a, b): what each line but the last ends with, and what the next begins with."""
    # a row for each line, written once for the passes that order them
    ends = stored(lines.select("line_ord", head.alias("head"), tail.alias("a")), "line-ends")
    return with_next(ends, "line_ord", "head").filter("following IS NOT NULL").select("a", F.col("following").alias("b"))


def flat_pairs(lines: DataFrame, tokens: Column) -> DataFrame:
    """(a, b, n) of neighbours in the flat sequence of all tokens, across lines: those within lines, and those at their ends."""
    own = lines.select("line_ord", tokens.alias("t")).filter(F.size("t") > 0)
    places = own.filter(F.size("t") > 1).select("t", F.explode(F.sequence(F.lit(0), F.size("t") - 2)).alias("i"))
    inner = places.select(F.get("t", F.col("i")).alias("a"), F.get("t", F.col("i") + 1).alias("b"))
    return inner.union(_across(own, F.element_at("t", 1), F.element_at("t", -1))).groupBy("a", "b").agg(F.count("*").alias("n"))


def flat_character_pairs(lines: DataFrame, tokens: Column) -> DataFrame:
    """(a, b, n): the last and the first characters of neighbours in the flat sequence of all tokens that are not empty, across lines."""
    own = lines.select("line_ord", F.filter(tokens, lambda t: t != "").alias("t")).filter(F.size("t") > 0)
    ends = F.arrays_zip(F.transform("t", lambda t: F.right(t, F.lit(1))).alias("a"), F.transform(F.slice("t", 2, F.size("t")), lambda t: F.left(t, F.lit(1))).alias("b"))
    inner = own.filter(F.size("t") > 1).select(F.explode(ends).alias("p")).select("p.a", "p.b").filter("b IS NOT NULL")
    outer = _across(own, F.left(F.element_at("t", 1), F.lit(1)), F.right(F.element_at("t", -1), F.lit(1)))
    return inner.union(outer).groupBy("a", "b").agg(F.count("*").alias("n"))


def joined_pairs(pairs: DataFrame, barred: Column, named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(n) of pairs of codes, for ``conditional_entropy``: only pairs with a bar in a token have to be written out to see which are alike."""
    pairs = stored(pairs, "pairs")
    plain = pairs.filter(~barred).select("n")
    alike = named(pairs.filter(barred)).groupBy(F.concat_ws("|", "a", "b")).agg(F.sum("n").alias("n")).select("n")
    return plain.union(alike)


def conditional_entropy(pairs: DataFrame, vocabulary: DataFrame, by: list[str] = ()) -> DataFrame:
    """max(0, H(pairs) - H(tokens)); pairs (a, b, n) are keyed by their joined text, so a bar within tokens can make two alike; (n) alone is taken as it is."""
    keyed = pairs.groupBy(*by, F.concat_ws("|", "a", "b").alias("p")).agg(F.sum("n").alias("n")) if "a" in pairs.columns else pairs
    joined = keyed.groupBy(*by).agg(entropy_of().alias("h2"))
    single = vocabulary.groupBy(*by).agg(entropy_of().alias("h1"))
    both = joined.join(single, list(by)) if by else joined.crossJoin(single)  # one row each
    return both.select(*by, F.greatest(F.lit(0.0), F.col("h2") - F.col("h1")).alias("conditional_entropy"))


def analyse(vocabulary: DataFrame, by: list[str] = ()) -> DataFrame:
    """Tokens, types, their ratio, entropy, its share of the greatest possible, and redundancy."""
    top = F.when(F.count("*") > 1, F.log2(F.count("*").cast("double"))).otherwise(1.0)
    return vocabulary.groupBy(*by).agg(
        F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), F.round(F.count("*") / F.sum("n"), 6).alias("type_token_ratio"), F.round(entropy_of(), 6).alias("entropy"),
        F.round(entropy_of() / top, 6).alias("normalised"), F.round(1 - entropy_of() / top, 6).alias("redundancy"),
    )


def character_counts(vocabulary: DataFrame) -> DataFrame:
    """(token, n): here characters, counted over types and weighted by their tokens."""
    return character_runs(vocabulary).groupBy(F.left("run", F.lit(1)).alias("token")).agg(F.sum("n").alias("n"))


def character_runs(vocabulary: DataFrame) -> DataFrame:
    """(run, n): each character of each type with the one after it, alone at the end; weighted by the types' tokens."""
    places = vocabulary.filter("token <> ''").select("token", "n", F.explode(F.sequence(F.lit(1), F.char_length("token"))).alias("i"))
    return places.groupBy(F.substring("token", F.col("i"), F.lit(2)).alias("run")).agg(F.sum("n").alias("n"))


def character_pairs(vocabulary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Neighbouring characters: those within types, and those of ``flat_character_pairs``, where tokens meet."""
    inner = character_runs(vocabulary).filter(F.char_length("run") == 2).select(F.left("run", F.lit(1)).alias("a"), F.right("run", F.lit(1)).alias("b"), "n")
    return inner.union(pairs.select("a", "b", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def ranked(vocabulary: DataFrame) -> DataFrame:
    """(rank, n): frequencies by rank. Types are never sorted: equal frequencies take neighbouring ranks.

    The table of distinct frequencies is small (at most about the square root
    of twice the number of tokens); its ranks are exploded in pieces.
    """
    sizes = vocabulary.groupBy("n").agg(F.count("*").alias("types"))
    start = F.sum("types").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    pieces = sizes.withColumn("start", F.coalesce(start, F.lit(0))).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("types") - 1) / RANKS))))
    low = F.col("start") + F.col("k") * RANKS + 1
    return pieces.select("n", F.explode(F.sequence(low, F.least(low + RANKS - 1, F.col("start") + F.col("types")))).alias("rank")).select("rank", "n")


def zipf_fit(vocabulary: DataFrame) -> DataFrame:
    """Least squares of log frequency on log rank: alpha and r_squared (0 for constant frequencies), null below five types."""
    r, f = F.log("rank"), F.log("n")
    fit = ranked(vocabulary).agg(F.count("*").alias("n_types"), F.regr_slope(f, r).alias("s"), F.regr_r2(f, r).alias("r2"), F.min("n").alias("low"), F.max("n").alias("high"))
    enough = F.col("n_types") >= LEAST_TYPES
    # adding 0 turns a negative zero into a plain one
    return fit.select(
        "n_types", F.when(enough, F.round(-F.col("s"), 6) + 0.0).alias("alpha"),
        F.when(enough, F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.round("r2", 6))).alias("r_squared"),
    )


#: The spread of random tokens' lengths.
SPREAD = 1.5


def random_tokens(spark, characters: DataFrame, length: float, n: int, seed: int = 42) -> DataFrame:
    """(token, n) of ``n`` random tokens: lengths about ``length``, characters by their frequency.

    Each number is drawn from the seed and its place, so the tokens do not
    depend on partitioning. ``characters`` is an alphabet and is collected.
    """
    rows = characters.orderBy(F.desc("n"), "token").collect()
    ends = np.cumsum([r["n"] for r in rows])
    spelled = [r["token"].encode() for r in rows]
    width, least = np.array([len(s) for s in spelled], np.int64), min(map(len, spelled), default=1)
    table = np.frombuffer(b"".join(s.ljust(4, b"\0") for s in spelled), np.uint8).reshape(-1, 4)

    def make(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            at = folded(seed, ids)  # a draw's parts are folded in one after another, so this one is shared
            radius = np.sqrt(-2 * np.log(np.maximum(folded(at, 1) / float(PRIME), 1e-300)))
            sizes = np.maximum(1, np.trunc(length + SPREAD * (radius * np.cos(2 * math.pi * (folded(at, 2) / float(PRIME))))).astype(np.int64))
            stops = np.cumsum(sizes)
            place = np.arange(int(stops[-1])) - np.repeat(stops - sizes, sizes)
            x = np.floor(folded(np.repeat(at, sizes), place + 11) / float(PRIME) * int(ends[-1])).astype(np.int64)
            char = np.searchsorted(ends, x, "right")
            if width.max() == least:
                text, cuts = table[char, :least], stops * least
            else:
                own = width[char]
                text, cuts = table[char][np.arange(4) < own[:, None]], np.cumsum(own)[stops - 1]
            offsets = np.append(0, cuts).astype(np.int32)
            tokens = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
            yield pa.RecordBatch.from_arrays([tokens], ["token"])

    return spark.range(n if rows else 0).mapInArrow(make, "token string").groupBy("token").agg(F.count("*").alias("n"))
