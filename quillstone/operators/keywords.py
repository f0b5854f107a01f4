"""Many keywords at once.

An automaton of Aho and Corasick follows all keywords through a text together:
its tables give for each state and byte the next state, and for each state the
best keyword that ends there. Lists too large for one table in every worker
are joined with the texts by each keyword's rarest gram instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.shared import stored

#: Keywords, and bytes of them, up to which every worker has an automaton: its table takes a few hundred bytes for each byte.
MOST_KEYWORDS, MOST_BYTES = 50_000, 1 << 17
#: Characters of a gram.
GRAM = 4
#: Texts that are walked beside each other at most.
LANES = 4096
NONE = np.iinfo(np.int64).max


class Automaton:
    """The tables of some keywords: next states by byte class, and the smallest order of a keyword that ends at each state."""

    def __init__(self, keys: list[bytes], orders: list[int]):
        used = np.zeros(256, bool)
        for k in keys:
            used[list(k)] = True
        # bytes of no keyword share class 0
        self.classes = np.where(used, np.cumsum(used), 0).astype(np.int64)
        width = int(used.sum()) + 1
        children: list[dict[int, int]] = [{}]
        best = [NONE]
        for key, order in zip(keys, orders, strict=True):
            at = 0
            for b in self.classes[list(key)].tolist():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    best.append(NONE)
                at = children[at][b]
            best[at] = min(best[at], order)
        self.next = np.zeros((len(children), width), np.int32)
        self.best = np.array(best)
        level, fail = [0], np.zeros(len(children), np.int64)
        while level:  # by depth: what follows a state is what follows its longest proper end, but for its own children
            following = []
            for s in level:
                if s:
                    self.next[s] = self.next[fail[s]]
                    self.best[s] = min(self.best[s], self.best[fail[s]])
                for b, child in children[s].items():
                    fail[child] = self.next[fail[s]][b] if s else 0
                    self.next[s, b] = child
                    following.append(child)
            level = following

    def first(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text laid end to end, the smallest order of a keyword within it, ``NONE`` without one; texts advance side by side."""
        n = len(offsets) - 1
        out = np.full(n, self.best[0])
        sizes = np.diff(offsets)
        by = np.argsort(-sizes, kind="stable")
        for a in range(0, n, LANES):
            rows = by[a : a + LANES]
            left, start = sizes[rows], offsets[rows]
            state, found = np.zeros(len(rows), np.int64), np.full(len(rows), self.best[0])
            for t in range(int(left[0]) if len(left) else 0):
                lanes = int(np.searchsorted(-left, -t, "left"))
                if lanes < WALKED:
                    break
                state[:lanes] = self.next[state[:lanes], self.classes[data[start[:lanes] + t]]]
                np.minimum(found[:lanes], self.best[state[:lanes]], out=found[:lanes])
            else:
                t = int(left[0]) if len(left) else 0
            for k in range(len(rows)):  # the few texts that are longer than the rest, one after another
                if left[k] <= t:
                    break
                found[k] = min(found[k], self._walk(data[start[k] + t : start[k] + left[k]], int(state[k])))
            out[rows] = found
        return out

    def _walk(self, data: np.ndarray, state: int) -> int:
        low = NONE
        step, best = self.next, self.best
        for c in self.classes[data].tolist():
            state = step[state, c]
            if best[state] < low:
                low = best[state]
        return int(low)


#: Texts beside each other from which they advance together.
WALKED = 8


def first_keywords(texts: DataFrame, keywords: DataFrame, text: str = "query") -> DataFrame:
    """``texts`` with ``key`` and ``answer``: the first keyword by ``key_order`` (a whole number) that the lower-cased text contains, or nulls.

    ``keywords`` has key_order, key and answer. Rows without a key or an order
    are left out; of those with one order the smallest key counts. The empty
    key is in every text that is not null. A null text contains nothing.
    Repeated rows stay; columns of ``texts`` named key or answer are replaced.
    """
    keep = Window.partitionBy("key_order").orderBy("key", "answer")
    able = keywords.filter("key IS NOT NULL AND key_order IS NOT NULL").withColumn("_nth", F.row_number().over(keep)).filter("_nth = 1")
    table = stored(able.select(F.col("key_order").cast("bigint").alias("key_order"), "key", "answer"), "keywords")
    asked = texts.drop("key", "answer").withColumn("_row", F.monotonically_increasing_id())
    # written, so that a row's number stays its own
    asked = stored(asked, "asked")
    rows = asked.select("_row", F.lower(text).alias("_low")).filter("_low IS NOT NULL")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    found = by_automaton(rows, table) if n <= MOST_KEYWORDS and size <= MOST_BYTES else by_grams(rows, table)
    best = found.groupBy("_row").agg(F.min("key_order").alias("key_order")).join(table, "key_order").select("_row", "key", "answer")
    return asked.join(best, "_row", "left").drop("_row")


def by_automaton(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(_row, key_order): the smallest order of a keyword in each text (_row, _low) that has one. The table's size has been checked; its automaton is built once in each worker."""
    entries = [(bytes(r["key"]), r["key_order"]) for r in table.select(F.col("key").cast("binary").alias("key"), "key_order").collect()]  # MOST_BYTES at most
    shared = rows.sparkSession.sparkContext.broadcast(entries)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Automaton([k for k, _ in shared.value], [o for _, o in shared.value])
        for batch in batches:
            low = batch.column("_low").cast(pa.large_string())
            _, ends, data = low.buffers()
            offsets = np.frombuffer(ends, np.int64)[low.offset : low.offset + len(low) + 1]
            order = tables.first(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets)
            hit = pa.array(order < NONE)
            yield pa.RecordBatch.from_arrays([batch.column("_row").filter(hit), pa.array(order).filter(hit)], ["_row", "key_order"])

    return rows.mapInArrow(walk, "_row bigint, key_order bigint")


def _grams(text: Column, length: int) -> Column:
    """The different substrings of a length."""
    last = F.char_length(text) - length
    made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(length)))
    return F.when(last >= 0, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def by_grams(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(_row, key_order) of every text (_row, _low) and every keyword in it, for lists of any size.

    A keyword of ``GRAM`` characters or more stands in texts that have all its
    grams; it is joined by the one that the fewest texts have, so that common
    grams draw no candidates. What a gram brings together is confirmed.
    Shorter keywords are grams themselves.
    """
    lengths = sorted({min(GRAM, r["n"]) for r in table.select(F.least(F.char_length("key"), F.lit(GRAM)).alias("n")).distinct().collect()})  # GRAM + 1 at most
    of_text = F.flatten(F.array(*[_grams(F.col("_low"), k) for k in lengths if k])) if any(lengths) else F.array().cast("array<string>")
    held = stored(rows.select("_row", F.explode(of_text).alias("gram")), "grams")
    own = F.when(F.char_length("key") >= GRAM, _grams(F.col("key"), GRAM)).otherwise(F.array("key"))
    of_key = table.filter("key <> ''").select("key_order", "key", F.explode(own).alias("gram"))
    known = of_key.join(held.groupBy("gram").agg(F.count("*").alias("texts")), "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = known.groupBy("key_order", "key").agg(F.min(F.struct("texts", "gram")).alias("g")).select("key_order", "key", "g.gram")
    near = held.join(rarest, "gram").select("_row", "key_order", "key")
    sure = near.join(rows, "_row").filter(F.contains("_low", F.col("key"))).select("_row", "key_order")
    empty = table.filter("key = ''").agg(F.min("key_order").alias("key_order")).filter("key_order IS NOT NULL")
    return sure.union(rows.crossJoin(F.broadcast(empty)).select("_row", "key_order"))  # one row
