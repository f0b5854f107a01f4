"""How five document filters act on each other, in every order.

A finite-state machine reads the bytes of a text once. Its tables give for
each byte a class, and for the state (the class of the byte before) and a class
whether a word starts or ends there and which counts go up. The machine's state
is only ever the class just read, so a piece of text is run as one look-up in
the table of class pairs. Words go into a hash table that compares the words
themselves wherever their hashes are equal. What is kept of a document is five
bits; the orders are worked out from counts of their patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.storage import KEY, bounded, row_key

NAME = "op13_filter_audit"
FILTERS = "ABCDE"
#: Fixed values of the filters' conditions.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"

# -- the byte machine ---------------------------------------------------------------

#: Classes of bytes, which are also the states; a text begins and ends in WHITE.
WHITE, PLAIN, CAPITAL, SYMBOL, INNER = range(5)
CLASS = np.full(256, PLAIN, np.uint8)
CLASS[0x80:0xC0] = INNER  # a later byte of a code point
CLASS[[0x20, *range(0x09, 0x0E)]] = WHITE
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
#: What the machine puts out on reading a class in a state.
START, END, POINT, UPPER, MARK = (1 << k for k in range(5))
OUTPUT = np.zeros((5, 5), np.uint8)
OUTPUT[WHITE, 1:] |= START
OUTPUT[1:, WHITE] |= END
OUTPUT[:, [WHITE, PLAIN, CAPITAL, SYMBOL]] |= POINT
OUTPUT[:, CAPITAL] |= UPPER
OUTPUT[:, SYMBOL] |= MARK
OUTPUT = OUTPUT.ravel()
#: Bytes that the machine reads at a time.
PIECE = 1 << 20
#: Bytes of words that are compared for all pairs of words together.
SHORT = 24


def transduce(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The output at each byte of ``data``, read from ``state``, and the state after it."""
    if not len(data):
        return np.zeros(0, np.uint8), state
    read = CLASS[data]
    pairs = read.copy()
    pairs[1:] += 5 * read[:-1]
    pairs[0] += 5 * state
    return OUTPUT[pairs], int(read[-1])


class WordTable:
    """The different words of each row: a hash table with linear probing over spans of ``data``.

    A slot holds the number of a word. Two words are the same if they are of
    one row, of one length and alike byte by byte; a hash only says where to
    look, so words that share one stay apart.
    """

    def __init__(self, data: np.ndarray, hashes=K.span_hashes):
        self.data, self.hashes = data, hashes
        self.slots = np.full(1 << 12, -1, np.int64)
        self.starts = self.ends = self.rows = np.zeros(0, np.int64)
        self.marks = np.zeros(0, np.uint64)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words numbered ``a`` and ``b`` are equal, pair by pair."""
        size = self.ends[a] - self.starts[a]
        alike = (self.rows[a] == self.rows[b]) & (size == self.ends[b] - self.starts[b])
        left = np.flatnonzero(alike)
        for k in range(SHORT):  # a byte of every pair at a time; those that are over or differ fall out
            left = left[size[left] > k]
            if not len(left):
                return alike
            differ = self.data[self.starts[a[left]] + k] != self.data[self.starts[b[left]] + k]
            alike[left[differ]] = False
            left = left[~differ]
        for i in left[size[left] > SHORT].tolist():
            x, y, n = self.starts[a[i]], self.starts[b[i]], size[i]
            alike[i] = bool((self.data[x : x + n] == self.data[y : y + n]).all())
        return alike

    def insert(self, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, base: int = 0) -> None:
        """Adds words, given as spans of ``data``; those that are there already are not added."""
        first = len(self.starts)
        marks = self.hashes(self.data[base : int(ends[-1])], starts - base, ends - base) if len(starts) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            marks = K.mix(marks + rows.astype(np.uint64) * K.BASE)
        self.starts, self.ends, self.rows, self.marks = (np.concatenate(x) for x in ((self.starts, starts), (self.ends, ends), (self.rows, rows), (self.marks, marks)))
        if 2 * len(self.starts) > len(self.slots):
            self.slots = np.full(1 << int(4 * len(self.starts)).bit_length(), -1, np.int64)
            self._place(np.arange(first), None)
        fresh = np.zeros(len(starts), bool)
        self._place(np.arange(first, len(self.starts)), fresh)
        kept = np.concatenate([np.arange(first), first + np.flatnonzero(fresh)])
        # the words that were new move up, so their slots are renumbered
        moved = np.full(len(self.starts), -1, np.int64)
        moved[kept] = np.arange(len(kept))
        used = np.flatnonzero(self.slots >= first)
        self.slots[used] = moved[self.slots[used]]
        self.starts, self.ends, self.rows, self.marks = (x[kept] for x in (self.starts, self.ends, self.rows, self.marks))

    def _place(self, words: np.ndarray, fresh: np.ndarray | None) -> None:
        """Puts words into slots, the first of equal ones; ``fresh`` gets which of them were new."""
        size = len(self.slots) - 1
        first = int(words[0]) if len(words) else 0
        at = (self.marks[words] & np.uint64(size)).astype(np.int64)
        while len(words):
            free = self.slots[at] < 0
            # of the words that want a free slot the first has it
            self.slots[at[free][::-1]] = words[free][::-1]
            held = self.slots[at]
            own = held == words
            if fresh is not None:
                fresh[words[own] - first] = True
            known = own.copy()
            like = np.flatnonzero(~own & (self.marks[held] == self.marks[words]))
            known[like] = self.same(held[like], words[like])
            words, at = words[~known], (at[~known] + 1) & size

    def counts(self, n: int) -> np.ndarray:
        """Different words of each of ``n`` rows."""
        return np.bincount(self.rows, minlength=n)


def measured(column: pa.Array) -> np.ndarray:
    """Words, different words, capitals, code points and symbols of each text of a column (a row of five numbers); a null is the empty text.

    Long texts are read in pieces; beside the text, memory holds the arrays of
    a piece and the text's different words.
    """
    data, offsets = K.text_arrays(column)
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    table = WordTable(data)
    row = 0
    while row < n:
        # whole rows up to a piece, or one long row piece by piece
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[stop])
        inside, state = None, WHITE
        for begin in range(low, high, PIECE) if stop == row + 1 else [low]:
            end = min(begin + PIECE, high) if stop == row + 1 else high
            put, state = transduce(data[begin:end], state)
            ends_here = np.flatnonzero(put & END) + begin
            starts_here = np.flatnonzero(put & START) + begin
            if stop > row + 1:  # a row's end is like white space, and so is the byte before its start
                put, starts_here, ends_here = _between(data, offsets[row : stop + 1], put, low)
            elif end == high and state != WHITE:
                ends_here = np.append(ends_here, high)
            if inside is not None:
                starts_here = np.insert(starts_here, 0, inside)
            inside = int(starts_here[-1]) if len(starts_here) > len(ends_here) else None
            starts_here = starts_here[: len(ends_here)]
            rows = np.searchsorted(offsets[row + 1 : stop + 1], starts_here, "right") + row
            for k, bit in ((2, UPPER), (3, POINT), (4, MARK)):
                hits = np.flatnonzero(put & bit) + begin
                out[row:stop, k] += np.diff(np.searchsorted(hits, offsets[row : stop + 1])) if stop > row + 1 else len(hits)
            out[:, 0] += np.bincount(rows, minlength=n)
            if len(starts_here):
                table.insert(starts_here, ends_here, rows, int(starts_here[0]))
        row = stop
    out[:, 1] = table.counts(n)
    return out


def _between(data: np.ndarray, offsets: np.ndarray, put: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The machine's output where each row begins in WHITE anew, and the starts and ends of words, a row's last word ending with it."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    put = put.copy()
    put[heads - low] = OUTPUT[5 * WHITE + CLASS[data[heads]].astype(np.int64)]
    tails = offsets[1:][np.diff(offsets) > 0]
    open_ends = tails[CLASS[data[tails - 1]] != WHITE]
    return put, np.flatnonzero(put & START) + low, np.sort(np.concatenate([np.flatnonzero(put & END) + low, open_ends]))


# -- documents ------------------------------------------------------------------------

FAILS = "doc_id bigint, part string, failed int, text_key " + KEY


def failed_bits(sums: np.ndarray) -> np.ndarray:
    """Filters A to D that each row of ``measured`` fails, a bit each."""
    words, distinct, capitals, points, symbols = sums.T
    tests = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests)).astype(np.int32)


def _fails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text", PIECE):
        failed = pa.array(failed_bits(measured(batch.column("text"))), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), failed, batch.column("text_key")], [f.name for f in _SCHEMA])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("text_key", pa.struct([("a", pa.int64()), ("b", pa.int64())]))])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of each document: its language, and the filters that it fails, a bit each from A.

    A null text is the empty text, a null language the empty string. Texts are
    identical if 128 bits of hashes and their lengths are. Rows with the
    smallest doc_id of a text pass E, be they repeated; a row without doc_id
    passes it too and is no reason for another to fail.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("_n", F.char_length("text"))
    keyed = bounded(rows).select("doc_id", "part", "text", row_key("text", "_n").alias("text_key"))
    read = keyed.mapInArrow(_fails, FAILS)
    first = keyed.filter("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    several = first.filter("_first < _last").select("text_key", "_first")
    again = read.join(several, "text_key", "left")
    e = 1 << FILTERS.index("E")
    return again.select("doc_id", "part", (F.col("failed") + F.when(F.col("doc_id") > F.col("_first"), e).otherwise(0)).alias("failed"))


def patterns(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): documents by what they fail and their labels; a document has a label if any row of ``labels`` gives it."""
    own = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    counted = failed.groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n"))
    joined = counted.join(own, "doc_id", "left")
    no = F.lit(False)
    return joined.groupBy("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, own, earlier): a row for each step of each order of the five filters, with the bits of its filter and of those before it."""
    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, own, earlier))
            earlier |= own
    return spark.createDataFrame(rows, "filter_order string, step int, own int, earlier int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; see the module. An empty table has none.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic;
    other columns are ignored. The orders are set against the table of
    patterns, which has at most 128 rows a part.
    """
    spark = docs.sparkSession
    seen = patterns(failures(docs), labels)
    has = lambda bits: F.col("failed").bitwiseAND(F.col(bits)) != 0
    own, before = has("own"), has("earlier")
    here = own & ~before
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0)).cast("bigint")
    # of the orders, those in which this filter comes first among the k that a document fails are one in k
    turns = F.lit(120) / F.bit_count("failed")
    steps = seen.crossJoin(F.broadcast(orders(spark)))  # 600 rows
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~own & ~before).alias("kept"), total(here).alias("removed"), total(own & before).alias("redundant"), total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"), F.sum(F.when(own, F.col("n") * turns.cast("bigint")).otherwise(0)).cast("bigint").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(docs, labels)


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS failed FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM m LEFT JOIN l USING (doc_id)),
o(filter_order, step, own, earlier) AS (SELECT '', 0, 0, 0
  UNION ALL SELECT filter_order || f, step + 1, bit, earlier | own FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, bit) WHERE (earlier | own) & bit = 0),
p AS (SELECT a.filter_order || substr(z.filter_order, a.step + 1) AS filter_order, a.step, a.own, a.earlier FROM o a JOIN o z ON z.step = 5 AND starts_with(z.filter_order, a.filter_order) WHERE a.step > 0),
r AS (SELECT part, filter_order, step, own, count(*) FILTER (WHERE failed & (own | earlier) = 0) AS kept, count(*) FILTER (WHERE failed & own > 0 AND failed & earlier = 0) AS removed,
  count(*) FILTER (WHERE failed & own > 0 AND failed & earlier > 0) AS redundant, count(*) FILTER (WHERE failed = own) AS unique_fails,
  count(*) FILTER (WHERE failed & own > 0 AND failed & earlier = 0 AND good) AS good_lost, count(*) FILTER (WHERE failed & own > 0 AND failed & earlier = 0 AND toxic) AS toxic_lost FROM d, p GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
