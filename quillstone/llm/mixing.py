"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the wanted rows over the
rows it has. Each document's number of copies is a Poisson variate with that
mean, found by inverting the distribution at a uniform number hashed from the
seed and the document's key, so that the draw does not depend on how the rows
are partitioned. A large mean is drawn as a sum of Poisson variates of equal
smaller means, each with a hash of its own. Copies are exploded and shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "op6_poisson_mixing"
SEED = "mix-1"
#: Weight of a source: its rows to this power. 1 keeps the shares, 0 makes them equal.
TEMPERATURE = 0.5
#: The probabilities that the SQL sums up for a mean; and the largest mean that one
#: inversion draws, larger ones being drawn in parts.
MOST_COPIES, MOST_MEAN = 160, 64.0
#: A table of sources with at most so many rows (a name and a rate each) is broadcast.
BROADCAST_SOURCES = 20_000
SALTS = 32


def uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 over ``parts`` as a number from 0 up to, but not, 1."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(source, n_source, rate): the mean number of copies of each source's documents.

    ``weights`` (source, weight) are the targets; without them a source weighs
    its rows to the power ``TEMPERATURE``. ``rows`` is the wanted size, by
    default that of ``docs``. Sources without a weight get none; weights of
    absent sources are left out of the sum.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_source"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_source").cast("double"), F.lit(TEMPERATURE)))
    else:
        own = weights.select(F.coalesce("source", F.lit("")).alias("source"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(own, "source", "left").fillna(0.0, ["weight"])
    w, n = sizes.agg(F.sum("weight"), F.sum("n_source")).first()
    wanted = float(rows if rows is not None else n or 0)
    rate = F.coalesce(F.try_divide(F.lit(wanted) * F.col("weight"), F.lit(float(w or 0)) * F.col("n_source")), F.lit(0.0))
    return sizes.select("source", "n_source", rate.alias("rate"))


def copies(rate: Column, u: Column) -> Column:
    """The Poisson quantile of ``u`` at a mean up to ``MOST_MEAN``: how many of the cumulative probabilities it exceeds."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.when(u > F.exp(-rate), 1).otherwise(0).alias("n"))

    def step(s, k):
        p = s.p * rate / k.cast("double")
        return F.struct(p.alias("p"), (s.c + p).alias("c"), (s.n + F.when(u > s.c + p, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate * 2).cast("int") + 32), start, step, lambda s: s.n)


def drawn(rate: Column, seed: str, key: Column) -> Column:
    """A Poisson variate of any mean: at a mean above ``MOST_MEAN`` the sum of variates of equal parts of it, each part with a draw of its own."""
    parts = F.ceil(rate / MOST_MEAN)
    draws = F.transform(F.sequence(F.lit(1).cast("bigint"), parts), lambda k: uniform(seed, key, k))
    return F.when(parts <= 1, copies(rate, uniform(seed, key))).otherwise(F.aggregate(draws, F.lit(0), lambda n, u: n + copies(rate / parts, u)))


def mix(docs: DataFrame, weights: DataFrame | None = None, rows: int | None = None, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """``docs`` with each row repeated 0 or more times, in random order; adds ``copy_no`` (from 0) and ``shuffle_key``.

    The order is that of ``shuffle_key``, by range over the partitions and
    sorted within each. A null source is the source "" and keeps its null; a
    null key draws as "". Repeated rows draw the same number. Columns of
    ``docs`` named like the added ones are replaced. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy_no", "shuffle_key", "_source", "_rate", "_salt")
    table = rates(docs, weights, rows)
    n = table.count()
    small = table.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    left = docs.withColumn("_source", F.coalesce("source", F.lit("")))
    if n <= BROADCAST_SOURCES:
        joined = left.join(F.broadcast(small), "_source")
    else:  # salted, as one source may hold a third of all rows
        left = left.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        joined = left.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["_source", "_salt"])
    repeated = joined.withColumn("_n", drawn(F.col("_rate"), seed, F.col(key))).filter("_n > 0")
    many = repeated.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    many = many.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy_no").cast("string"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the keys are uniform, so hashing their leading digits deals rows out evenly without a sampling pass
    slot = (F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint") * parts / F.lit(1 << 32)).cast("int")
    return many.withColumn("_slot", slot).repartitionById(parts, "_slot").sortWithinPartitions("shuffle_key").drop("_source", "_rate", "_salt", "_n", "_slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy_no", "shuffle_key", "text")


ORACLE = f"""
WITH s AS (SELECT coalesce(source, '') AS src, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
t AS (SELECT sum(w) AS tw, sum(n) AS tn FROM s),
r AS (SELECT src, tn::DOUBLE * w / (tw * n) AS rate FROM s, t),
d AS (SELECT d.*, rate, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d JOIN r ON coalesce(d.source, '') = r.src),
k AS (SELECT rate, range AS k, exp(-rate + range * ln(rate) - lgamma(range + 1)) AS p FROM (SELECT DISTINCT rate FROM r), range({MOST_COPIES})),
c AS (SELECT rate, k, sum(p) OVER (PARTITION BY rate ORDER BY k) AS cdf FROM k),
n AS (SELECT d.doc_id, d.source, d.text, d.u, count(*) FILTER (WHERE d.u > c.cdf) AS n FROM d JOIN c ON d.rate = c.rate AND c.k < 60 GROUP BY ALL)
SELECT doc_id, source, copy_no::INTEGER AS copy_no, md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS shuffle_key, text
FROM (SELECT *, unnest(range(n)) AS copy_no FROM n WHERE n > 0)
"""
