"""Bootstrap intervals, permutation tests and chi-square tests over lines of tokens."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.operators.draws import Draws, added_places, drawn, mean_weight, poisson_weights, scramble
from quillstone.operators.entropy import LEAST_TYPES, entropy_of, zipf_fit
from quillstone.operators.order import numbered_ranges
from quillstone.sources.shared import stored

# The least tokens, types and expectations of the tests.
LEAST_TOKENS, LEAST_SHARED, LEAST_EXPECTED = 30, 5, 0.5
#: The rule engine's own test: tokens of a section at least, and the expectation that a cell must exceed.
RULE_TOKENS, RULE_EXPECTED = 50, 0.0

# -- bootstrap -------------------------------------------------------------------------

#: Occurrences of a token in one batch from which a task sums its weights before it is dealt out, and tokens that a task holds sums of.
HEAVY, HELD = 32, 16384
#: Frequencies below this are counted in a task's table.
SMALL = 1024
#: Rows that are added up before sums are widened.
NARROW = 64
#: Rows times resamples that are weighted at once.
CELLS = 4_000_000


#: Additional draws that are made at once.
CHUNK = 1 << 16


def drawn_lines(lines: DataFrame, resamples: int, seed: int) -> tuple[Draws, DataFrame]:
    """``resamples`` times n of n lines with replacement: the draws, and ``lines`` with ``added`` (``Draws.weights``).

    ``line_ord`` is a line's number; rows of one number are drawn together.
    Lines are numbered from 0 in ranges, what streams add up to is summed in
    tasks, and additional draws meet the lines that they take by number. The
    driver sees a row for each range and for each stream.
    """
    spark = lines.sparkSession
    cut = numbered_ranges(lines.select("line_ord"), "line_ord", int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.dense_rank().over(Window.partitionBy("_part").orderBy("line_ord")) - 1
    placed = stored(cut.withColumn("place", place).dropDuplicates(["_part", "line_ord"]), "places")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    n = sum(sizes.values())
    mean = mean_weight(n)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, step = np.zeros(len(tried), np.int64), max(1, CELLS // len(tried))
        for batch in batches:
            keys = batch.column("line_ord").to_numpy()
            for a in range(0, len(keys), step):
                sums += poisson_weights(seed, keys[a : a + step], tried, mean).sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tried), pa.array(sums)], ["stream", "total"])

    chosen: list[tuple[int, int]] = []  # streams, and how many draws each lacks
    first, more = 0, resamples + 64
    while n and len(chosen) < resamples:
        tried = np.arange(first, first + more)
        rows = placed.select("line_ord").mapInArrow(totals, "stream bigint, total bigint").groupBy("stream").agg(F.sum("total").alias("total")).collect()
        chosen += sorted((r["stream"], n - r["total"]) for r in rows if r["total"] <= n)
        first += more
    chosen = chosen[:resamples] or [(k, 0) for k in range(resamples)]

    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part], before = before, before + sizes[part]
    offsets = spark.createDataFrame(list(starts.items()), "_part int, start bigint")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, stream, start, end in zip(*(batch.column(c).to_pylist() for c in ("rep", "stream", "start", "end")), strict=True):
                places = added_places(seed, stream, start, end, n)
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.full(len(places), rep, np.int32))], ["place", "rep"])

    lacking = spark.createDataFrame([(k, stream, d) for k, (stream, d) in enumerate(chosen) if d], "rep int, stream bigint, lacks bigint")
    chunks = lacking.select("rep", "stream", "lacks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lacks") - 1, F.lit(CHUNK).cast("bigint"))).alias("start"))
    chunks = chunks.select("rep", "stream", "start", F.least(F.col("start") + CHUNK, F.col("lacks")).alias("end")).repartition("rep", "start")
    added = chunks.mapInArrow(take, "place bigint, rep int")
    numbered = placed.join(F.broadcast(offsets), "_part").select("line_ord", (F.col("place") + F.col("start")).alias("place"))
    # never broadcast: a size estimated before the draws are made says nothing of what the driver would hold
    met = numbered.join(added.hint("merge"), "place").groupBy("line_ord").agg(F.collect_list("rep").alias("added"))
    return Draws(seed, mean, np.array([s for s, _ in chosen])), lines.join(met, "line_ord", "left")


#: Tokens of lines that are sent on at once.
SENT = 1 << 16
SPLIT = ["token", "key", "added", "sums"]


def _weighted(draws: Draws):
    least, most = HEAVY, HELD

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens with their line's key and additional draws; for a token that a batch has many of, the sums of its weights in the task from then on.

        So however common a token, a task deals it out a few hundred times at most.
        """
        held: dict = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                kind, k = pa.int64() if isinstance(next(iter(held)), int) else pa.string(), len(held)
                yield pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.nulls(k, pa.int64()), pa.nulls(k, added.type), pa.array([_packed(s) for s in held.values()], pa.binary())], SPLIT)
                held.clear()

        for batch in batches:
            lists, keys, added = (batch.column(c) for c in ("t", "line_ord", "added"))
            keys = keys.to_numpy()
            rows = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            words = lists.flatten().dictionary_encode()
            codes, names = words.indices.to_numpy(), words.dictionary
            common = np.bincount(codes, minlength=len(names)) >= least
            if held:
                common |= pc.is_in(names, value_set=pa.array(list(held), names.type)).to_numpy(zero_copy_only=False)
            rest = np.flatnonzero(~common[codes])
            for a in range(0, len(rest), SENT):
                some = rest[a : a + SENT]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(codes[some])), pa.array(keys[rows[some]]), added.take(pa.array(rows[some])), pa.nulls(len(some), pa.binary())], SPLIT)
            heavy = np.flatnonzero(common[codes])
            heavy = heavy[np.argsort(codes[heavy], kind="stable")]
            for name, sums in zip(*_sums_by_token(draws, keys, added, codes[heavy], rows[heavy], names), strict=True):
                held[name] = held.get(name, 0) + sums
            if len(held) > most:
                yield from flushed()
        yield from flushed()

    return split


def _packed(sums: np.ndarray) -> bytes:
    """Sums in half the bytes where they fit."""
    return (sums.astype(np.uint32) if sums.max(initial=0) < 1 << 32 else sums).tobytes()


def _unpacked(sums: bytes, resamples: int) -> np.ndarray:
    return np.frombuffer(sums, np.uint32 if len(sums) == 4 * resamples else np.int64)


def sums_of_groups(weights: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of ``weights[rows]`` (16-bit) over groups that follow each other, a row for each of ``sizes``.

    Groups are cut into pieces whose sums stay below 16 bits; the longest
    pieces go first, so the j-th rows of all pieces that have so many are
    added to a block of neighbours at once, four numbers in a 64-bit word.
    """
    width = weights.shape[1]
    words = np.zeros((len(weights), -(-width // 4) * 4), np.uint16)
    words[:, :width] = weights
    words = words.view(np.uint64)
    limit = max(1, min(NARROW, 65535 // max(1, int(weights.max(initial=1)))))
    pieces = -(-sizes // limit)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(np.cumsum(sizes) - sizes, pieces) + (np.arange(int(pieces.sum())) - np.repeat(first, pieces)) * limit
    lengths = np.minimum(np.repeat(np.cumsum(sizes), pieces) - start, limit)
    order = np.argsort(-lengths, kind="stable")
    start, longest = start[order], lengths[order]
    total = words[rows[start]]
    for j in range(1, int(longest.max(initial=0))):
        m = int(np.searchsorted(-longest, -j, "left"))  # pieces of more than j rows
        total[:m] += words[rows[start[:m] + j]]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    narrow = total.view(np.uint16)[back, :width]
    if (pieces == 1).all():
        return narrow.astype(np.int64)
    return np.add.reduceat(narrow.astype(np.int64), first, axis=0)


def _sums_by_token(draws: Draws, keys: np.ndarray, added: pa.ListArray, codes: np.ndarray, rows: np.ndarray, names: pa.Array) -> tuple[list, list[np.ndarray]]:
    """Tokens of a batch's occurrences (sorted by code) and their sums of weights, which are made once for each line."""
    if not len(codes):
        return [], []
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.append(first, len(codes)))
    sums, step = 0, max(1, CELLS // len(draws.streams))
    if len(keys) <= step:
        sums = sums_of_groups(draws.narrow(keys, added), rows, sizes)
    else:
        group = np.repeat(np.arange(len(first)), sizes)
        sums = np.zeros((len(first), len(draws.streams)), np.int64)
        for a in range(0, len(keys), step):
            own = np.flatnonzero((rows >= a) & (rows < a + step))
            if len(own):
                found, k = np.unique(group[own], return_counts=True)
                sums[found] += sums_of_groups(draws.narrow(keys[a : a + step], added[a : a + step]), rows[own] - a, k)
    return names.take(pa.array(codes[first])).to_pylist(), list(sums)


def _gathered(draws: Draws, parts: Callable[[int], Parts]):
    """A function over rows sorted by token that adds blocks of counts, a row for each token, to ``parts``."""
    resamples = len(draws.streams)
    step = max(1, CELLS // resamples)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parts(resamples)
        last, held = None, np.zeros((1, resamples), np.int64)  # the token at the end of what has been read
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                token, key = piece.column("token"), piece.column("key")
                summed = key.is_null().to_numpy(zero_copy_only=False)
                other = pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate([[True], other]))
                group = np.cumsum(np.concatenate([[False], other]).astype(np.int64))
                counts = np.zeros((len(first), resamples), np.int64)
                plain = np.flatnonzero(~summed)
                if len(plain):
                    found, k = np.unique(group[plain], return_counts=True)
                    some = pa.array(plain)
                    counts[found] = sums_of_groups(draws.narrow(key.take(some).to_numpy(), piece.column("added").take(some)), np.arange(len(plain)), k)
                for k in np.flatnonzero(summed).tolist():
                    counts[group[k]] += _unpacked(piece.column("sums")[k].as_py(), resamples)
                if token[0].as_py() == last:
                    counts[0] += held[0]
                elif last is not None:
                    counts = np.concatenate([held, counts])
                last, held = token[-1].as_py(), counts[-1:]
                if len(counts) > 1:
                    yield from own.add(counts[:-1])
        if last is not None:
            yield from own.add(held)
        yield from own.close()

    return gather


class Parts:
    """What a task keeps of the counts of its tokens: ``add`` may give rows at once, ``close`` gives the rest."""

    def __init__(self, resamples: int):
        self.resamples = resamples

    def add(self, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def close(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Entropies(Parts):
    """Sums of n and of n log n, a row for each resample and task."""

    def __init__(self, resamples: int):
        super().__init__(resamples)
        self.n, self.logs = np.zeros(resamples, np.int64), np.zeros(resamples)

    def add(self, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.n += counts.sum(axis=0)
        self.logs += (np.log2(np.maximum(counts, 1)) * counts).sum(axis=0)
        yield from ()

    def close(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(self.resamples)), pa.array(self.n), pa.array(self.logs)], ["rep", "n", "nlogn"])


def _entropies(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("nlogn").alias("s")).filter("n > 0")
    return sums.select("rep", F.greatest(F.lit(0.0), F.log2("n") - F.col("s") / F.col("n")).alias("value"))


class _Frequencies(Parts):
    """How many tokens have each frequency, resample by resample: a task's table of those below ``SMALL``, and larger ones as they are met."""

    def __init__(self, resamples: int):
        super().__init__(resamples)
        self.small = SMALL
        self.table = np.zeros(resamples * self.small, np.int64)

    def add(self, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = counts < self.small
        base = np.arange(self.resamples) * self.small
        self.table += np.bincount((counts + base)[low], minlength=len(self.table))
        if not low.all():
            token, rep = np.nonzero(~low)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(counts[token, rep]), pa.array(np.ones(len(rep), np.int64))], ["rep", "n", "types"])

    def close(self) -> Iterator[pa.RecordBatch]:
        keys = np.flatnonzero(self.table)
        keys = keys[keys % self.small > 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys // self.small), pa.array(keys % self.small), pa.array(self.table[keys])], ["rep", "n", "types"])


@cache
def _log_tables(size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    logs = np.log(np.arange(1, size + 1))
    return np.concatenate([[0.0], np.cumsum(logs)]), np.concatenate([[0.0], np.cumsum(logs * logs)])


def log_sums(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of log k and of its square for k from 1 to each n: tables, and beyond them the Euler-Maclaurin formula."""
    one, two = _log_tables()
    top = len(one) - 1
    inside = np.minimum(n, top)

    def tail(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.log(x)
        return x * g - x + g / 2 + 1 / (12 * x), x * g * g - 2 * x * g + 2 * x + g * g / 2 + g / (6 * x)

    far, edge = tail(np.maximum(n, top).astype(float)), tail(np.array([float(top)]))
    return one[inside] + far[0] - edge[0], two[inside] + far[1] - edge[1]


def _log_square_sums(start: pd.Series, end: pd.Series) -> pd.DataFrame:
    a, b = (log_sums(s.to_numpy(np.int64)) for s in (start, end))
    return pd.DataFrame({"x": b[0] - a[0], "xx": b[1] - a[1]})


def _slopes(parts: DataFrame) -> DataFrame:
    """Least squares of log frequency on log rank; equal frequencies have neighbouring ranks, so they go in as sums over these."""
    sizes = parts.groupBy("rep", "n").agg(F.sum("types").alias("types"))
    w = Window.partitionBy("rep").orderBy(F.desc("n"))  # a row for each distinct frequency
    placed = sizes.withColumn("start", F.coalesce(F.sum("types").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = placed.withColumn("s", F.pandas_udf(_log_square_sums, "x double, xx double")("start", F.col("start") + F.col("types"))).withColumn("y", F.log("n"))
    fit = sums.groupBy("rep").agg(
        F.sum("types").alias("v"), F.sum("s.x").alias("x"), F.sum("s.xx").alias("xx"), F.sum(F.col("types") * F.col("y")).alias("y"), F.sum(F.col("s.x") * F.col("y")).alias("xy"),
    )
    slope = (F.col("v") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("v") * F.col("xx") - F.col("x") * F.col("x"))
    return fit.select("rep", F.when(F.col("v") >= LEAST_TYPES, -slope).alias("value"))


@dataclass(frozen=True)
class Statistic:
    """What is resampled: its value for a vocabulary, the parts that a task keeps of its counts, and the values they add up to."""

    point: Callable[[DataFrame], DataFrame]
    parts: Callable[[int], Parts]
    schema: str
    values: Callable[[DataFrame], DataFrame]


ENTROPY = Statistic(lambda v: v.agg(entropy_of().alias("point")), _Entropies, "rep bigint, n bigint, nlogn double", _entropies)
ZIPF = Statistic(lambda v: zipf_fit(v).select(F.col("alpha").alias("point")), _Frequencies, "rep bigint, n bigint, types bigint", _slopes)


def interval(values: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(low, high, resamples): percentiles of a statistic (rep, value), interpolated linearly."""
    tail = (1 - confidence) / 2
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return values.agg(q.alias("q"), F.count("value").alias("resamples")).select(F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"), "resamples")


def _own_tokens(lines: DataFrame) -> DataFrame:
    """(line_ord, t) of lines with tokens: words without braces, or codes as they are."""
    coded = dict(lines.dtypes)["tokens"] == "array<bigint>"
    return lines.select("line_ord", (F.col("tokens") if coded else T.clean_tokens(F.col("tokens"))).alias("t")).filter(F.size("t") > 0)


def bootstrap(lines: DataFrame, statistic: Statistic, resamples: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(point, low, high, resamples) of a statistic of the tokens of ``lines`` (line_ord, tokens), lines being drawn with replacement.

    Each resample has as many draws as there are lines with tokens
    (``drawn_lines``). Tokens are dealt out once. Where they arrive, a token's counts in all
    resamples are sums of its lines' weights; only what a statistic needs of
    them leaves the task.
    """
    clean = _own_tokens(lines)
    kind = dict(clean.dtypes)["t"].removeprefix("array<").removesuffix(">")
    draws, own = drawn_lines(clean, resamples, seed)
    rows = own.mapInArrow(_weighted(draws), f"token {kind}, key bigint, added array<int>, sums binary")
    parts = rows.repartition("token").sortWithinPartitions("token").mapInArrow(_gathered(draws, statistic.parts), statistic.schema)
    vocabulary = clean.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return statistic.point(vocabulary).select(F.round("point", 6).alias("point")).crossJoin(interval(statistic.values(parts), confidence))  # one row each


@dataclass(frozen=True)
class Mergeable:
    """A statistic of the caller's own, for all resamples beside each other.

    ``columns`` are what it needs of a line. ``add`` gets a batch of them and
    the weights of its lines (a row for each line, a column for each resample)
    and gives a state: numbers, a row for each resample, whose sums over
    batches are the state of all lines. ``finish`` turns a state into a value
    for each resample (not a number where there is none).
    """

    columns: dict[str, Column]
    add: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


#: States that are merged at once.
FAN = 32


def bootstrap_of(lines: DataFrame, statistic: Mergeable, resamples: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(point, low, high, resamples) of a mergeable statistic of ``lines`` (line_ord and what it needs), lines being drawn with replacement (``drawn_lines``).

    A task adds up its lines; the tasks' states are merged ``FAN`` at a time,
    level by level, so nothing holds all lines or all states. The point is the
    statistic with a weight of one for each line.
    """
    draws, own = drawn_lines(lines.select("line_ord", *(c.alias(k) for k, c in statistic.columns.items())), resamples, seed)
    added, finished = statistic.add, statistic.finish  # columns stay with the driver

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            step = max(1, CELLS // resamples)
            for a in range(0, batch.num_rows, step):
                piece = batch.slice(a, step)
                w = np.concatenate([np.ones((piece.num_rows, 1), np.int64), draws.weights(piece.column("line_ord").to_numpy(), piece.column("added"))], axis=1)
                more = np.asarray(added(piece, w), float).reshape(resamples + 1, -1)
                state = more if state is None else state + more
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for s in batch.column("state").to_pylist():
                more = np.frombuffer(s, float)
                state = more.copy() if state is None else state + more
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], ["state"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("state").to_pylist():
                values = np.asarray(finished(np.frombuffer(s, float).reshape(resamples + 1, -1)), float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, resamples)), pa.array(values, mask=np.isnan(values))], ["rep", "value"])

    states = stored(own.mapInArrow(add, "state binary"), "states")
    left = states.count()
    while left > 1:
        left = -(-left // FAN)
        states = stored(states.repartition(left).mapInArrow(merge, "state binary"), "states")
    values = stored(states.mapInArrow(finish, "rep bigint, value double"), "states")
    point = values.filter("rep = -1").agg(F.round(F.max("value"), 6).alias("point"))
    return point.crossJoin(interval(values.filter("rep >= 0"), confidence))  # one row each


def initial_rate(tokens: Column, token: str | int) -> Mergeable:
    """The share of a token's occurrences that open a line; 0 without it."""
    own = F.coalesce(F.size(F.filter(tokens, lambda t: t == token)), F.lit(0)).cast("bigint")
    first = F.coalesce((F.get(tokens, F.lit(0)) == token).cast("bigint"), F.lit(0).cast("bigint"))

    def add(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy() @ w for c in ("k", "first")], axis=1)

    return Mergeable({"k": own, "first": first}, add, lambda s: np.where(s[:, 0] > 0, s[:, 1] / np.maximum(s[:, 0], 1), 0.0))


def bootstrap_initial_rate(lines: DataFrame, token: str, resamples: int = 500, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(point, low, high, resamples) of ``initial_rate``; 0 in a resample without the token."""
    own = _own_tokens(lines)
    return bootstrap_of(own, initial_rate(F.col("t"), token), resamples, confidence, seed)


# -- permutations ----------------------------------------------------------------------------

def binomial_quantiles(m: int, p: float, u: np.ndarray) -> np.ndarray:
    """How many of the cumulative probabilities of a binomial variate each number exceeds."""
    if p >= 1:
        return np.full(len(u), m)
    mean, spread = m * p, math.sqrt(m * p * (1 - p))
    low, high = max(0, int(mean - 12 * spread - 30)), min(m, int(mean + 12 * spread + 30))
    j = np.arange(low, high + 1)
    whole = math.lgamma(m + 1)
    logs = np.array([whole - math.lgamma(k + 1) - math.lgamma(m - k + 1) for k in j.tolist()]) + j * math.log(p) + (m - j) * math.log1p(-p)
    sums = np.cumsum(np.exp(logs))
    return low + np.searchsorted(sums, u, "left")


TESTED = "token string, observed_rate double, total bigint, observed bigint, null_mean double, null_std double, p_value double, significant boolean"


def permutation_tests(rows: DataFrame, tokens: list[str], permutations: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Whether each token opens lines more often than by chance; the k-th token of the list draws by ``seed + k``.

    When the tokens of a line are shuffled, the chance that a given one comes
    first is its share of the line, independently of other lines. Lines with
    equal shares are alike, so each permutation draws one binomial number for
    all lines of the same length that have the token equally often. What a
    task gets of a token is a row for each such length and number. A token
    that the corpus lacks has no row.
    """
    seeds = {t: seed + k for k, t in enumerate(tokens)}
    own = rows.filter(F.col("token").isin(tokens)).groupBy("token", "line_ord").agg(F.count("*").alias("k"), F.first("size").alias("size"), F.max((F.col("pos") == 0).cast("int")).alias("first"))
    alike = own.groupBy("token", "k", "size").agg(F.count("*").alias("m"), F.sum("first").alias("first"))

    def test(g: pd.DataFrame) -> pd.DataFrame:
        token = g["token"].iloc[0]
        x, reps = np.zeros(permutations, np.int64), np.arange(permutations)
        for k, size, m in g[["k", "size", "m"]].itertuples(index=False):
            x += binomial_quantiles(int(m), k / size, drawn(seeds[token], reps, int(k), int(size)))
        total, observed = int((g["k"] * g["m"]).sum()), int(g["first"].sum())
        rates, p = x / total, float(np.mean(x >= observed))
        return pd.DataFrame([(token, round(observed / total, 4), total, observed, round(rates.mean(), 4), round(rates.std(), 4), round(p, 4), p < alpha)], columns=[c.split()[0] for c in TESTED.split(", ")])

    kind = dict(rows.dtypes)["token"]  # words or codes
    return alike.groupBy("token").applyInPandas(test, TESTED.replace("token string", f"token {kind}"))


def permutation_test(rows: DataFrame, token: str, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """``permutation_tests`` of one token; one that the corpus lacks is an error."""
    if rows.filter(F.col("token") == token).isEmpty():
        raise ValueError(f"the corpus has no token {token!r}")
    return permutation_tests(rows, [token], permutations, seed)


# -- permutations of places ----------------------------------------------------------------------

#: Rounds of the network that permutes places.
ROUNDS = 6


def permuted(seed: int, lines: np.ndarray, sizes: np.ndarray, places: np.ndarray, reps: int) -> np.ndarray:
    """Where each place of a line goes in each permutation: a row for each place given, a column for each permutation.

    A place is computed and not shuffled: a keyed Feistel network is a
    bijection of the numbers below a power of four; a number at or beyond the
    line's size is sent through it again until it is a place, which makes it a
    bijection of the line's places. Places of one line in one permutation
    never meet.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64) + 1) // 2)[:, None].astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    line = scramble(lines.astype(np.int64).view(np.uint64) + np.uint64(seed % (1 << 32)))[:, None]
    key = scramble(line + scramble(np.arange(reps, dtype=np.uint64))[None, :])
    out = np.broadcast_to(places.astype(np.uint64)[:, None], key.shape).copy()
    half, mask = np.broadcast_to(half, key.shape), np.broadcast_to(mask, key.shape)
    todo = np.ones(key.shape, bool)
    while todo.any():
        x, k, h, m = out[todo], key[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for r in range(ROUNDS):
            with np.errstate(over="ignore"):
                left, right = right, left ^ (scramble(right + scramble(k + np.uint64(r + 1))) & m)
        out[todo] = left << h | right
        todo &= out >= sizes.astype(np.uint64)[:, None]
    return out.astype(np.int64)


#: Scores of a place (0, 1, ...) in a line of some size, for ``place_tests``.
PLACES = {
    "first": lambda place, size: place == 0, "last": lambda place, size: place == size - 1, "mean": lambda place, size: place / np.maximum(size - 1, 1),
}


def place_tests(rows: DataFrame, tokens: list, score: Callable[[np.ndarray, np.ndarray], np.ndarray], permutations: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Whether the mean score of each token's places is higher than by chance, when the tokens of every line are shuffled.

    ``score`` is given places and sizes of lines, as arrays, so any positional
    statistic of a token can be tested. ``rows`` has line_ord, pos, size and
    token. A task sums scores for its own rows; a token that the corpus lacks
    has no row in the result, which is that of ``permutation_tests`` with the
    means of scores for rates and the sum of scores for ``observed``.
    """
    kind = dict(rows.dtypes)["token"]
    own = rows.filter(F.col("token").isin(tokens)).select("token", "line_ord", "pos", "size")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            names = np.array(batch.column("token").to_pylist(), object)
            line, place, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("line_ord", "pos", "size"))
            step = max(1, CELLS // permutations)
            for a in range(0, len(line), step):
                part = slice(a, a + step)
                moved = np.concatenate([place[part, None], permuted(seed, line[part], size[part], place[part], permutations)], axis=1)
                scores = np.asarray(score(moved, size[part, None]), float)
                for t in set(names[part].tolist()):
                    mine = names[part] == t
                    n, total = found.get(t, (0, 0.0))
                    found[t] = (n + int(mine.sum()), total + scores[mine].sum(axis=0))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int64() if kind == "bigint" else pa.string()), pa.array([n for n, _ in found.values()]), pa.array([s.tobytes() for _, s in found.values()], pa.binary())], ["token", "n", "sums"]
            )

    def test(g: pd.DataFrame) -> pd.DataFrame:
        x = np.sum([np.frombuffer(s, float) for s in g["sums"]], axis=0)  # a row for each task
        n = int(g["n"].sum())
        means = np.round(x / n, 12)
        observed, means = means[0], means[1:]
        p = float(np.mean(means >= observed))
        return pd.DataFrame([(g["token"].iloc[0], round(observed, 4), n, round(float(x[0]), 6), round(means.mean(), 4), round(means.std(), 4), round(p, 4), p < alpha)], columns=[c.split()[0] for c in PLACED.split(", ")])

    return own.mapInArrow(sums, f"token {kind}, n bigint, sums binary").groupBy("token").applyInPandas(test, PLACED.replace("token string", f"token {kind}"))


PLACED = TESTED.replace("observed bigint", "observed double")

# -- chi-square ------------------------------------------------------------------------------

def chi_square(rows: DataFrame, known: list[str], least_tokens: int = LEAST_TOKENS, least_expected: float = LEAST_EXPECTED, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(section, n_tokens, n_types, chi_square, df, status) of each known section against the whole corpus."""
    # counts by section, written once for the four places that need them
    own = stored(rows.groupBy("section", "token").agg(F.count("*").alias("n")), "section-counts")
    whole = own.groupBy("token").agg(F.sum("n").alias("c"))
    total = own.agg(F.sum("n").alias("t"))
    tested = own.filter(F.col("section").isin(known))
    sizes = tested.groupBy("section").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"))
    joined = tested.join(whole, "token").join(F.broadcast(sizes), "section").crossJoin(F.broadcast(total))  # a row for each section; one row
    expected = F.col("n_tokens") * F.col("c") / F.col("t")
    cell = F.when(expected > least_expected, F.pow(F.col("n") - expected, F.lit(2.0)) / expected).otherwise(0.0)
    out = joined.groupBy("section", "n_tokens", "n_types").agg(F.sum(cell).alias("x"))
    status = F.when(F.col("n_tokens") < least_tokens, "INSUFFICIENT_DATA").when(F.col("n_types") < least_shared, "INSUFFICIENT_OVERLAP").otherwise("TESTED")
    return out.withColumn("status", status).select(
        "section", "n_tokens", "n_types", F.when(F.col("status") == "TESTED", F.round("x", 4)).alias("chi_square"), F.when(F.col("status") == "TESTED", F.col("n_types") - 1).alias("df"), "status",
    )


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 100_000):
        f = k * (a - k)
        b += 2
        d = 1 / (f * d + b or 1e-300)
        c = b + f / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """The chance of a larger statistic, a value for each section; null without degrees of freedom."""
    return pd.Series([None if pd.isna(v) or pd.isna(k) or k <= 0 else upper_gamma(k / 2, v / 2) for v, k in zip(x, df, strict=True)], dtype="float64")


def _with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", F.pandas_udf(chi_square_p, "double")(F.col("chi_square"), F.col("df").cast("double")))


def significance(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``chi_square`` with p-values and the verdict at a level divided by the number of known sections, tested or not."""
    n = tests.agg(F.greatest(F.count("*"), F.lit(1)).alias("k"))
    judged = _with_p(tests).crossJoin(F.broadcast(n))  # one row
    return judged.withColumn("significant", F.col("p") < alpha / F.col("k")).withColumn("p_value", F.round("p", 6)).drop("p", "k")


def rule_significance(rows: DataFrame, known: list[str], alpha: float = 0.05) -> DataFrame:
    """(n_significant): the rule engine's own count of sections that differ from the corpus.

    It asks more tokens of a section than the full test, counts every cell,
    compares p-values that are rounded already, and divides the level by the
    number of sections with data.
    """
    judged = _with_p(chi_square(rows, known, RULE_TOKENS, RULE_EXPECTED, least_shared=0))
    p = F.coalesce(F.round("p", 6), F.lit(1.0))
    sums = judged.select(p.alias("p")).agg(F.count("*").alias("k"), F.collect_list("p").alias("ps"))  # a number for each section
    return sums.select(F.size(F.filter("ps", lambda p: p < alpha / F.greatest(F.col("k"), F.lit(1)))).cast("bigint").alias("n_significant"))


def analysis(lines: DataFrame, rows: DataFrame, sections: DataFrame, known: list[str], initial: list[str], resamples: int = 500, seed: int = 42) -> dict[str, DataFrame]:
    """The whole significance run: both intervals, the sections, and the permutation tests of the tokens given."""
    return {
        "entropy": bootstrap(lines, ENTROPY, resamples, seed=seed), "zipf_alpha": bootstrap(lines, ZIPF, resamples, seed=seed + 1),
        "sections": significance(chi_square(sections, known)), "permutations": permutation_tests(rows, initial, resamples, seed + 100),
    }
