"""Look-ups in user-supplied tables: exact, fuzzy and by keyword."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.keywords import first_keywords
from quillstone.sources.shared import stored

#: Words of each query that are compared before all others.
FIRST = 64


def exact(queries: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """The rows of ``table`` whose key is the trimmed, lower-cased query."""
    return queries.withColumn(key, F.lower(F.trim("query"))).join(table, key)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, computing the value once within a function of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def longest_block(pair: Column) -> Column:
    """(k, i, j) of the longest block that ``pair`` (a, b) has in common: its length and its first places, from 1, in a and then in b."""
    def block(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.char_length(pair.a) - i + 1)
        k = F.size(F.filter(lengths, lambda n: F.contains(pair.b, F.substring(pair.a, i, n))))  # what has a longer block has the shorter ones
        return F.struct(k.alias("k"), (-i).alias("i"))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.char_length(pair.a)), block))
    return once(best, lambda m: F.struct(m.k.alias("k"), (-m.i).alias("i"), F.position(F.substring(pair.a, -m.i, m.k), pair.b).alias("j")))


def similarity(first: Column, second: Column) -> Column:
    """The ratio of matching blocks of two words, which depends on their order: twice the characters in blocks over all characters.

    The longest block in common is taken, then those of what is left of it in
    both words, and of what is right of it, and so on. All open pairs are
    worked on at once, so there are at most as many steps as characters.
    """
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole = lambda pairs: F.filter(pairs, lambda p: (p.a != "") & (p.b != ""))

    def sides(p: Column, m: Column) -> Column:
        return F.array(
            pair(F.substring(p.a, F.lit(1), m.i - 1), F.substring(p.b, F.lit(1), m.j - 1)),
            pair(F.substring(p.a, m.i + m.k, F.char_length(p.a)), F.substring(p.b, m.j + m.k, F.char_length(p.b))),
        )

    def step(s: Column, _: Column) -> Column:
        blocks = F.filter(F.transform(s.open, lambda p: F.struct(p.alias("p"), longest_block(p).alias("m"))), lambda x: x.m.k > 0)
        return once(blocks, lambda found: F.struct(
            whole(F.flatten(F.transform(found, lambda x: sides(x.p, x.m)))).alias("open"), F.aggregate(found, s.same, lambda n, x: n + x.m.k).alias("same"),
        ))

    start = F.struct(whole(F.array(pair(first, second))).alias("open"), F.lit(0).alias("same"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.char_length(first), F.char_length(second))))
    return F.aggregate(steps, start, step, lambda s: F.try_divide(2.0 * s.same, F.char_length(first) + F.char_length(second)))


def common_letters(first: Column, second: Column) -> Column:
    """How many characters of ``first`` occur in ``second`` at all."""
    return F.char_length(first) - F.char_length(F.call_function("translate", first, second, F.lit("")))


def most_similar(first: Column, second: Column) -> Column:
    """What ``similarity`` of two words cannot exceed: no block has a character that the other word lacks."""
    same = F.least(common_letters(first, second), common_letters(second, first))
    return F.try_divide(2.0 * same, F.char_length(first) + F.char_length(second))


def fuzzy(queries: DataFrame, words: DataFrame, k: int = 5, cutoff: float = 0.3) -> DataFrame:
    """(query, rank, word, similarity): the k words most like each query by matching blocks.

    Words are ranked with the query as second sequence; the similarity given
    has it first. Ties go to the larger word. Every word is set against the
    queries of a caller. The similarity of the ``FIRST`` words of each query
    whose letters allow the most tells what the k best reach at least; then
    matching blocks, which Spark's own functions find, are looked for in every
    word whose letters allow as much, and ``cutoff``: no other can be listed.
    Words are compared whole, however long; the work for a pair grows with the
    cube of its words' lengths. Spark sends the queries to the words'
    partitions where they are few enough, and else pairs partitions.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is kept: the work is in pairs, not in bytes
    asked = queries.select(F.lower(F.trim("query")).alias("query")).distinct()
    own = words.select("word").filter("word IS NOT NULL").repartition(tasks, "word").distinct()
    one, two = F.char_length("word"), F.char_length("query")
    long_enough = F.try_divide(2.0 * F.least(one, two), one + two) >= cutoff
    pairs = lambda asked: own.crossJoin(asked).filter(long_enough).withColumn("most", most_similar(F.col("word"), F.col("query")))
    score = similarity(F.col("word"), F.col("query"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "word"))
    first = pairs(asked).withColumn("nth", nth).filter(F.col("nth") <= max(k, FIRST)).withColumn("score", score)
    reached = first.groupBy("query").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(max(k, 1) - 1)).alias("reached"))
    # a row for each query, written so that its size is known
    known = stored(asked.join(reached, "query", "left").select("query", F.greatest(F.lit(cutoff), "reached").alias("reached")), "reached")
    scored = pairs(known).filter("most >= reached").withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("word")))
    best = scored.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("score") >= cutoff))  # after the ranks, so that no score is computed twice
    return best.select("query", "rank", "word", F.round(similarity(F.col("query"), F.col("word")), 3).alias("similarity"))


def dispatch(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """``queries`` (id, query) with the key and answer of the first keyword (by key_order) that each contains, or null; repeated ids stay apart."""
    return first_keywords(queries.select("id", "query"), keywords).select("id", "key", "answer")
