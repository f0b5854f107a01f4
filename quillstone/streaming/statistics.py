"""Statistics of a stream of lines that are kept up to date without counting anew.

Tokens are dealt to buckets by hash. A bucket keeps the count of each of its
tokens as state, entry by entry, and running sums; a new token changes its own
entry and the sums. Every batch gives a row for each bucket that it touched;
the latest row of each bucket makes up the statistics of all that was read.
State is in the checkpoint, so a stream that is started again goes on where it
was, and lines that come late count like any other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions import tokens as T

#: Buckets of tokens, and tokens of a bucket that are reported.
BUCKETS, TOP = 64, 20
ROW = "bucket bigint, version bigint, n bigint, types bigint, n_log_n double, top array<struct<token:string,n:bigint>>"
#: What Spark needs to keep state entry by entry.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _term(n: int) -> float:
    return n * math.log2(n) if n else 0.0


class _Counts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "token string", "n bigint")
        self.sums = handle.getValueState("sums", "version bigint, n bigint, types bigint, n_log_n double")
        self.top = handle.getMapState("top", "token string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        version, n, types, logs = self.sums.get() if self.sums.exists() else (0, 0, 0, 0.0)
        best = {k[0]: v[0] for k, v in self.top.iterator()}
        fresh: dict[str, int] = {}
        for frame in rows:
            for token, more in frame.groupby("token", sort=False)["n"].sum().items():
                fresh[token] = fresh.get(token, 0) + int(more)
        for token, more in fresh.items():
            known = self.counts.getValue((token,))
            before = known[0] if known else 0
            self.counts.updateValue((token,), (before + more,))
            n, types, logs = n + more, types + (not before), logs + _term(before + more) - _term(before)
            best[token] = before + more
        # a token that is not among the first cannot come to be so without a new occurrence
        kept = dict(heapq.nsmallest(TOP, best.items(), key=lambda e: (-e[1], e[0])))
        for token in best.keys() - kept.keys():
            if self.top.containsKey((token,)):
                self.top.removeKey((token,))
        for token, count in kept.items():
            self.top.updateValue((token,), (count,))
        self.sums.update((version + 1, n, types, logs))
        shown = [{"token": t, "n": c} for t, c in kept.items()]
        yield pd.DataFrame({"bucket": [key[0]], "version": [version + 1], "n": [n], "types": [types], "n_log_n": [logs], "top": [shown]})

    def close(self) -> None:
        pass


def running_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """``ROW`` for each bucket that a batch touches; to be written in append or update mode, keeping all rows or the latest of each bucket.

    ``lines`` is a stream with a column of text; nulls and lines without
    tokens add nothing. The session needs the state store ``STORE``.
    """
    token = F.explode(T.plain_tokens(F.col(text))).alias("token")
    rows = lines.select(token).select(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).alias("bucket"), "token", F.lit(1).cast("bigint").alias("n"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Counts(), ROW, "Update", "None")


def statistics(rows: DataFrame) -> DataFrame:
    """(n_tokens, n_types, entropy) of what ``running_counts`` has written so far: one row, zeros where there is nothing."""
    sums = latest(rows).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.sum("n_log_n").alias("s"))
    entropy = F.greatest(F.lit(0.0), F.coalesce(F.log2(F.nullif(F.col("n"), F.lit(0))) - F.col("s") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)))
    return sums.select(F.col("n").alias("n_tokens"), F.col("types").alias("n_types"), F.round(entropy, 6).alias("entropy"))


def top_tokens(rows: DataFrame, k: int = TOP) -> DataFrame:
    """(token, n): the ``k`` most frequent tokens so far, ``TOP`` at most, ties by name."""
    return latest(rows).select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "token").limit(min(k, TOP))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each bucket; a batch that was written twice makes no difference."""
    newest = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("version")))
    return rows.withColumn("_nth", newest).filter("_nth = 1").drop("_nth")


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with the state store that this module needs."""
    spark.conf.set(*STORE)
    return spark
