"""Markov models of several orders, trained and tested on counts from one pass over the lines.

A place of a line gives one row: its token and up to as many tokens before it
as the highest order, packed in a string of bytes. Only these rows are dealt
out, by the last two tokens, and sorted; counts of shorter contexts are sums
over neighbouring rows, and the short heads of lines are rows with fewer
tokens. Smoothed probabilities depend on counts alone, so what leaves a task
are histograms: how many transitions and contexts were seen how often. Single
tokens, and the pairs that are so frequent that they are dealt out by the last
three tokens, are summed up once more. Large corpora are counted in several
passes, each over some of the pairs, so that the rows of one pass alone lie on
disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.draws import scramble
from quillstone.operators.order import smallest_by_hash
from quillstone.sources.encoded import code_of
from quillstone.sources.shared import stored

#: Fewer lines than this are tested on the lines they were trained on.
LEAST_LINES = 10
SEEDS = 8
#: Numbers below these take one, two and three bytes of a window's key, others nine; and what the first byte is at least.
BELOW, LEADS = (0x80, 0x6080, 0x1F6080), (0x80, 0xE0, 0xFF)
#: Windows whose keys are made at once, and tokens of lines that one pass counts.
SENT, PASS_TOKENS = 1 << 17, 1 << 29
#: A pair is dealt out by three tokens if it has this share of a task's rows, as a divisor.
OFTEN = 4
#: Frequent tokens that get small numbers for codes, and the lines (one in so many, by hash) that they are looked for in.
SHORT, LOOKED_AT = 1 << 18, 64


def split_lines(lines: DataFrame, share: float = 0.2, seed: int = 42) -> Column:
    """The condition of a test line: exactly max(1, int(n * share)) lines, whatever the partitioning."""
    return smallest_by_hash(lines, "line_ord", share, seed)


def transitions(lines: DataFrame, order: int) -> DataFrame:
    """(context, token, n): what follows each context of ``order`` tokens (at least one), joined by blanks, within lines."""
    places = lines.filter(F.size("tokens") > order).select("tokens", F.explode(F.sequence(F.lit(order), F.size("tokens") - 1)).alias("i"))
    rows = places.select(*(F.get("tokens", F.col("i") - k).alias(f"t{k}") for k in range(order, -1, -1)))
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return counts.select(F.concat_ws(" ", *rows.columns[:-1]).alias("context"), F.col("t0").alias("token"), "n")


def coded(lines: DataFrame) -> DataFrame:
    """``lines`` with codes for tokens, no two tokens sharing one; lines of codes stay."""
    if dict(lines.dtypes)["tokens"] == "array<bigint>":
        return lines
    words = lines.select(F.explode("tokens").alias("t")).distinct()
    for seed in range(SEEDS):
        if words.groupBy(code_of(F.col("t"), seed)).agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            return lines.withColumn("tokens", F.transform("tokens", lambda t: code_of(t, seed)))  # noqa: B023
    raise ValueError("no seed tells the lines' tokens apart")


def _some(lines: DataFrame) -> DataFrame:
    return lines.filter(F.pmod(F.xxhash64("line_ord"), F.lit(LOOKED_AT)) == 0) if "line_ord" in lines.columns else lines.limit(0)


def frequent(lines: DataFrame) -> np.ndarray:
    """Codes of up to ``SHORT`` tokens that are frequent in some of the lines; which ones changes no result."""
    best = _some(lines).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(SHORT)
    return best.select("t").toArrow().column("t").to_numpy().astype(np.int64)  # a bounded number


def shortened(codes: np.ndarray, top: np.ndarray) -> np.ndarray:
    """``codes`` under a permutation of all 64-bit numbers, which keeps different codes apart: the k-th of ``top`` changes places with k.

    Small numbers are packed well where rows are dealt out. ``top`` holds no
    code below its own length.
    """
    if not len(top):
        return codes
    order = np.argsort(top)
    at = np.minimum(np.searchsorted(top[order], codes), len(top) - 1)
    out = np.where(top[order][at] == codes, order[at], codes)
    small = (codes >= 0) & (codes < len(top))
    out[small] = top[codes[small]]
    return out


def pair_marks(w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token and the one before it (0 at a line's start)."""
    return scramble(scramble(w0.view(np.uint64)) + w1.view(np.uint64))


def frequent_pairs(lines: DataFrame, top: np.ndarray, tokens: int, parts: int) -> np.ndarray:
    """Sorted marks of the pairs that would fill much of a task, judged by some of the lines; which ones changes no result."""
    places = _some(lines).filter(F.size("tokens") > 1).select("tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("i"))
    pairs = places.select(F.get("tokens", F.col("i")).alias("w0"), F.get("tokens", F.col("i") - 1).alias("w1")).groupBy("w0", "w1").agg(F.count("*").alias("n"))
    best = pairs.filter(F.col("n") * LOOKED_AT * OFTEN * parts >= max(tokens, 1)).orderBy(F.desc("n"), "w0", "w1").limit(4 * OFTEN * parts).collect()  # a bounded number
    w0, w1 = (shortened(np.array([r[c] for r in best], np.int64), top) for c in ("w0", "w1"))
    return np.unique(pair_marks(w0, w1))


def _among(marks: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``marks`` are in ``some`` (sorted)."""
    return some[np.minimum(np.searchsorted(some, marks), len(some) - 1)] == marks if len(some) else np.zeros(len(marks), bool)


SUMS = ("c", "n", "cf", "nf")


def _windows(orders: int, top: np.ndarray, passes: int = 1, turn: int = 0):
    """Rows (w0, w1, ..., size, c, n, cf, nf) for the different windows of a batch of lines.

    w0 is a token, w1 the one before it, null beyond the line's start; size is
    the number of tokens. c and n count training and held-out places, cf and
    nf those that another token follows. Of several ``passes``, each has the
    windows of its own pairs.
    """
    names = [f"w{k}" for k in range(orders + 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(codes):
                continue
            codes = shortened(codes, top)
            held = np.repeat(batch.column("held").to_numpy(zero_copy_only=False).astype(bool), sizes)
            ends = np.cumsum(sizes)
            place = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
            followed = place + 1 < np.repeat(sizes, sizes)
            at = np.arange(len(codes))
            if passes > 1:
                marks = pair_marks(codes, np.where(place > 0, codes[at - 1], 0))
                at = np.flatnonzero((marks >> np.uint64(40)) % np.uint64(passes) == turn)
                held, followed, place = held[at], followed[at], place[at]
                if not len(at):
                    continue
            size = np.minimum(place, orders) + 1
            columns = [np.where(size > k, codes[at - k], 0) for k in range(orders + 1)]
            table = np.stack([*columns, size], axis=1)
            # by two tokens, as neighbours that begin alike pack better, and a hash of the window; equal ones are told by all columns
            mark = scramble(size.astype(np.uint64))
            for c in columns:
                mark = scramble(mark + c.view(np.uint64))
            lead = (columns[0] & 0xFFFF) << 16 | (columns[min(1, orders)] & 0xFFFF)
            order = np.argsort(lead.view(np.uint64) << np.uint64(32) | mark >> np.uint64(32))
            table = table[order]
            first = np.flatnonzero(np.concatenate([[True], (table[1:] != table[:-1]).any(axis=1)]))
            sums = [np.add.reduceat((x[order]).astype(np.int64), first) for x in (~held, held, ~held & followed, held & followed)]
            table = table[first]
            arrays = [pa.array(table[:, k], mask=table[:, -1] <= k) for k in range(orders + 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(table[:, -1]), *map(pa.array, sums)], [*names, "size", *SUMS])

    return cut, ", ".join([*(f"{c} bigint" for c in names), "size bigint", *(f"{c} bigint" for c in SUMS)])


def key_bytes(table: np.ndarray) -> np.ndarray:
    """How many bytes each number takes in a key."""
    return np.where((table < 0) | (table >= BELOW[2]), 9, 1 + (table >= BELOW[0]).astype(np.int64) + (table >= BELOW[1]))


def keys_of(table: np.ndarray, size: np.ndarray) -> pa.Array:
    """Windows (a row each, of ``size`` tokens) as strings of bytes, one token after the other.

    No token's bytes begin with another's, so windows that agree in their
    first tokens are neighbours when the strings are sorted.
    """
    lens = np.where(size[:, None] > np.arange(table.shape[1]), key_bytes(table), 0).ravel()
    ends, codes = np.cumsum(lens), table.ravel()
    at = ends - lens
    data = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    for k, (least, lead) in enumerate(zip((0, *BELOW[:-1]), (0, *LEADS[:-1]), strict=True)):
        own = np.flatnonzero(lens == k + 1)
        v = codes[own] - least + (lead << 8 * k)
        for j in range(k + 1):
            data[at[own] + j] = v >> 8 * (k - j) & 255
    own = np.flatnonzero(lens == 9)
    data[at[own][:, None] + np.arange(1, 9)] = codes[own].astype(">i8").view(np.uint8).reshape(-1, 8)
    offsets = np.append(0, ends[table.shape[1] - 1 :: table.shape[1]]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def tokens_of(keys: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows and sizes of ``keys_of``: at most ``most`` tokens each, 0 beyond a window's size."""
    table, size = np.zeros((len(keys), most), np.int64), np.zeros(len(keys), np.int64)
    if not len(keys):
        return table, size
    keys = keys.cast(pa.large_binary())
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.append(np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.zeros(2, np.uint8))
    at, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    for k in range(most):
        own = np.flatnonzero(at < end)
        a = at[own]
        lead = data[a].astype(np.int64)
        lens = 1 + (lead >= LEADS[0]).astype(np.int64) + (lead >= LEADS[1])
        two = lead << 8 | data[a + 1]
        v = np.where(lens == 1, lead, np.where(lens == 2, two - (LEADS[0] << 8) + BELOW[0], (two << 8 | data[a + 2]) - (LEADS[1] << 16) + BELOW[1]))
        long = np.flatnonzero(lead == LEADS[2])
        v[long] = np.ascontiguousarray(data[a[long][:, None] + np.arange(1, 9)]).view(">i8")[:, 0]
        lens[long] = 9
        table[own, k] = v
        size[own] += 1
        at[own] += lens
    return table, size


KEYED = "part int, key binary, m bigint"


def _keyed(orders: int, top: np.ndarray, often: np.ndarray, parts: int, passes: int, turn: int):
    """``_windows`` as rows (part, key, m): the task a window is dealt to, its tokens, and four times a number of places, plus 1 for held-out ones, plus 2 for those that another token follows."""
    cut, _ = _windows(orders, top, passes, turn)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in cut(batches):
            for a in range(0, whole.num_rows, SENT):
                batch = whole.slice(a, SENT)
                table = np.stack([batch.column(f"w{k}").fill_null(0).to_numpy() for k in range(orders + 1)], axis=1)
                marks = pair_marks(np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1]))
                marks = np.where(_among(marks, often), scramble(marks + np.ascontiguousarray(table[:, 2]).view(np.uint64)), marks)
                c, n, cf, nf = (batch.column(x).to_numpy() for x in SUMS)
                places = np.stack([c - cf, n - nf, cf, nf], axis=1)
                row, kind = np.nonzero(places)
                size, m = batch.column("size").to_numpy()[row], places[row, kind] << 2 | kind
                table = table[row]
                # rows with equal lengths and numbers follow each other, so that keys alone differ
                long = np.where(size[:, None] > np.arange(orders + 1), key_bytes(table), 0).sum(axis=1)
                order = np.argsort(np.minimum(m, 255) << 8 | np.minimum(long, 255), kind="stable")
                part = (marks % np.uint64(parts)).astype(np.int32)[row[order]]
                yield pa.RecordBatch.from_arrays([pa.array(part), keys_of(table[order], size[order]), pa.array(m[order])], ["part", "key", "m"])

    return keyed


def parts_of(orders: int) -> str:
    """The columns of ``_levels``; s0, s1, ... are a token's held-out places with 0, 1, ... tokens before them."""
    return "level int, kind int, k bigint, a bigint, b bigint, rows bigint, w0 bigint, w1 bigint, cf bigint, nf bigint, " + ", ".join(f"s{k} bigint" for k in range(orders + 1))


#: What a row of ``parts_of`` stands for: transitions or contexts with k training occurrences, or the counts of one frequent pair or of one token.
TRANSITIONS, CONTEXTS, PAIRS, TOKENS = range(4)


def _histogram(level: int, kind: int, k: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Groups of equal ``k`` with the sums of k and b."""
    if k.max(initial=0) <= 4 * len(k):
        rows = np.bincount(k)
        values = np.flatnonzero(rows)
        rows, sums = rows[values], np.bincount(k, b)[values]
    else:
        values, inverse = np.unique(k, return_inverse=True)
        rows, sums = np.bincount(inverse), np.bincount(inverse, b)
    return {"level": np.full(len(values), level), "kind": np.full(len(values), kind), "k": values, "a": values * rows, "b": sums.round().astype(np.int64), "rows": rows}


def _part(columns: dict[str, np.ndarray], orders: int) -> pa.RecordBatch:
    n = len(columns["level"])
    fields = [f.split() for f in parts_of(orders).split(", ")]
    kinds = {c: pa.int32() if t == "int" else pa.int64() for c, t in fields}
    return pa.RecordBatch.from_pydict({c: pa.nulls(n, kinds[c]) if c not in columns else pa.array(columns[c], kinds[c]) for c, _ in fields})


def _levels(orders: int, often: np.ndarray):
    """From sorted keys: histograms of all levels from pairs on, and the counts of tokens and of the pairs that are in ``often``.

    A level's groups are runs of rows that agree in its first tokens; the run
    that a batch ends in is held until the next one. A pair that is dealt out
    by three tokens is only a part here.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def close(level: int, keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``keys`` and ``sums`` of groups that are whole."""
            own = {"level": np.full(len(keys), level), "w0": keys[:, 0], "a": sums[:, 0], "b": sums[:, 1], "cf": sums[:, 2], "nf": sums[:, 3]}
            if level == 1:
                yield _part(own | {"kind": np.full(len(keys), TOKENS)} | {f"s{k}": sums[:, 4 + k] for k in range(orders + 1)}, orders)
                return
            if level == 2 and len(often):
                part = _among(pair_marks(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])), often)
                if part.any():
                    yield _part({c: v[part] for c, v in own.items()} | {"kind": np.full(part.sum(), PAIRS), "w1": keys[part, 1]}, orders)
                sums = sums[~part]
            yield _part(_histogram(level, TRANSITIONS, sums[:, 0], sums[:, 1]), orders)
            if level <= orders:
                some = sums[:, 2:4].any(axis=1)
                yield _part(_histogram(level + 1, CONTEXTS, sums[some, 2], sums[some, 3]), orders)

        for batch in batches:
            table, size = tokens_of(batch.column("key"), orders + 1)
            m = batch.column("m").to_numpy()
            n, tested, follows = m >> 2, m & 1, m >> 1 & 1
            sums = np.stack([n * (1 - tested), n * tested, n * (1 - tested) * follows, n * tested * follows], axis=1)
            changed = np.logical_or.accumulate(table[1:] != table[:-1], axis=1)
            for level in range(1, orders + 2):
                own = np.flatnonzero(size >= level)
                if not len(own):
                    continue
                # windows of fewer tokens may stand between two groups, not within one
                group = np.append(0, np.cumsum(changed[:, level - 1]))[own]
                some = sums[own]
                if level == 1:
                    some = np.concatenate([some, np.where(size[:, None] - 1 == np.arange(orders + 1), some[:, 1:2], 0)], axis=1)
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                total = np.add.reduceat(some, first, axis=0)
                keys = table[own[first], :level]
                if level in held:
                    last, before = held[level]
                    if (last == keys[0]).all():
                        total[0] += before
                    else:
                        yield from close(level, last[None, :], before[None, :])
                held[level] = (keys[-1], total[-1])
                if len(keys) > 1:
                    yield from close(level, keys[:-1], total[:-1])
        for level, (last, before) in held.items():
            yield from close(level, last[None, :], before[None, :])

    return count


def _counts_of(df: DataFrame, order: int, kind: int, k: str, b: str) -> DataFrame:
    """Rows of ``counted`` from a table of transitions or contexts."""
    return df.groupBy(F.col(k).alias("k")).agg(F.sum(k).alias("a"), F.sum(b).alias("b"), F.count("*").alias("rows")).select(F.lit(order).alias("order"), F.lit(kind).alias("kind"), "k", "a", "b", "rows")


def _unknown(tokens: DataFrame, places: list[Column]) -> DataFrame:
    """Rows of ``counted`` for tokens that no training line has; ``places``: the held-out places of each order."""
    unknown = tokens.filter("a = 0").agg(*(F.coalesce(F.sum(p), F.lit(0)).alias(f"u{k}") for k, p in enumerate(places)))
    rows = F.array(*(F.struct(F.lit(k).alias("order"), F.col(f"u{k}").alias("b")) for k in range(len(places))))
    zero = F.lit(0).cast("bigint")
    return unknown.select(F.explode(rows).alias("r")).select("r.order", F.lit(PAIRS).alias("kind"), zero.alias("k"), zero.alias("a"), "r.b", zero.alias("rows"))


def _counted_pairs(lines: DataFrame, held: Column, orders: int) -> DataFrame:
    """``counted`` for orders up to 1, which need no windows: pairs are counted where they lie and dealt out once."""
    own = lines.select("tokens", held.alias("held")).filter(F.size("tokens") > 0)
    # at a line's start there is no token before; order 0 asks for none
    before = F.get("tokens", F.col("i") - 1) if orders else F.lit(None).cast("bigint")
    places = own.select("tokens", "held", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("i"))
    pairs = places.select(F.get("tokens", F.col("i")).alias("w0"), before.alias("w1"), "held")
    pairs = stored(pairs.groupBy("w0", "w1").agg(F.count_if(~F.col("held")).alias("a"), F.count_if("held").alias("b")), "transitions")
    second = F.sum(F.when(F.col("w1").isNotNull(), F.col("b")).otherwise(0)).alias("s1")
    tokens = stored(pairs.groupBy("w0").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), second), "transitions")
    out = _counts_of(tokens, 0, TRANSITIONS, "a", "b").union(_unknown(tokens, [F.col("b"), F.col("s1")][: orders + 1]))
    if orders:
        real = pairs.filter("w1 IS NOT NULL")
        contexts = real.groupBy("w1").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        out = out.union(_counts_of(real, 1, TRANSITIONS, "a", "b")).union(_counts_of(contexts, 1, CONTEXTS, "a", "b"))
    return out


def counted(lines: DataFrame, held: Column, orders: int) -> DataFrame:
    """(order, kind, k, a, b, rows): of each order's transitions, or contexts, that training lines have k times, how often these and held-out lines have them, and how many there are.

    A third kind, ``PAIRS``, has the held-out places (b) whose token no
    training line has. ``lines`` has codes for tokens; frequent ones are dealt
    out as small numbers (``shortened``).
    """
    if orders < 2:
        return _counted_pairs(lines, held, orders)
    top = frequent(lines)
    top = top[(top < 0) | (top >= len(top))]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = lines.agg(F.sum(F.size("tokens"))).first()[0] or 0
    often, passes = frequent_pairs(lines, top, tokens, parts), max(1, -(-tokens // PASS_TOKENS))
    own, made = lines.select("tokens", held.alias("held")), None
    for turn in range(passes):
        dealt = own.mapInArrow(_keyed(orders, top, often, parts, passes, turn), KEYED).repartitionById(parts, "part").select("key", "m").sortWithinPartitions("key")
        more = stored(dealt.mapInArrow(_levels(orders, often), parts_of(orders)), "transitions")
        made = more if made is None else made.union(more)
    far = made.filter(F.col("kind") < PAIRS).select((F.col("level") - 1).alias("order"), "kind", "k", "a", "b", "rows")
    pairs = made.filter(F.col("kind") == PAIRS).groupBy("w0", "w1").agg(*(F.sum(c).alias(c) for c in ("a", "b", "cf", "nf")))
    tokens = stored(made.filter(F.col("kind") == TOKENS).groupBy("w0").agg(*(F.sum(c).alias(c) for c in ("a", "b", "cf", "nf", *(f"s{k}" for k in range(orders + 1))))), "transitions")
    # how many held-out places of each order a token has: those with as many tokens before them
    places = [sum((F.col(f"s{j}") for j in range(k + 1, orders + 1)), F.col(f"s{k}")) for k in range(orders + 1)]

    of = _counts_of
    out = [far.groupBy("order", "kind", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("rows").alias("rows")), of(tokens, 0, TRANSITIONS, "a", "b")]
    out += [of(pairs, 1, TRANSITIONS, "a", "b"), of(tokens.filter("cf + nf > 0"), 1, CONTEXTS, "cf", "nf"), of(pairs.filter("cf + nf > 0"), 2, CONTEXTS, "cf", "nf")]
    out.append(_unknown(tokens, places))
    whole = out[0]
    for o in out[1:]:
        whole = whole.union(o)
    return whole


def evaluate(counts: DataFrame, smoothing: float = 1.0, in_sample: bool = False) -> DataFrame:
    """A row for each order of ``counted``: perplexities of training and held-out lines, and the sizes behind them.

    Additive smoothing over the training vocabulary: a transition seen k times
    after a context seen m times has the probability (k + s) / (m + s V).
    ``in_sample`` takes the training counts for those of the held-out lines.
    """
    asked = F.col("a" if in_sample else "b")
    is_kind = lambda kind: F.col("kind") == kind
    vocabulary = counts.filter(is_kind(TRANSITIONS) & (F.col("order") == 0) & (F.col("k") > 0)).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("seen"))
    whole = counts.filter(is_kind(TRANSITIONS) & (F.col("order") == 0)).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("m0"), F.coalesce(F.sum(asked), F.lit(0)).alias("n0"))
    s = F.lit(float(smoothing))
    v = F.greatest(F.col("seen"), F.lit(1))
    joined = counts.crossJoin(F.broadcast(vocabulary.crossJoin(whole)))  # one row each
    up, down = F.log2(F.col("k") + s), F.log2(F.col("k") + s * v)
    gain = lambda n: F.sum(F.when(is_kind(TRANSITIONS), n * up).when(is_kind(CONTEXTS), -n * down))
    # the one context of order 0 is the whole
    first = lambda n: F.when(F.col("order") == 0, F.max(n) * F.log2(F.max("m0") + s * F.max(v))).otherwise(0.0)
    total = lambda n: F.sum(F.when(is_kind(TRANSITIONS), n).otherwise(0))
    perplexity = lambda n, n0: F.round(F.pow(F.lit(2.0), -F.try_divide(gain(n) - first(n0), total(n))), 4)
    return joined.groupBy("order").agg(
        perplexity(F.col("a"), "m0").alias("train_perplexity"), perplexity(asked, "n0").alias("perplexity"), total(F.col("a")).alias("n_train_tokens"), total(asked).alias("n_tokens"),
        (F.sum(F.when(is_kind(PAIRS), F.col("b")).otherwise(0)) if not in_sample else F.lit(0).cast("bigint")).alias("n_unknown"), F.max(v).alias("vocab_size"),
        F.when((F.col("order") == 0) & (F.max("m0") > 0), F.lit(1).cast("bigint")).otherwise(F.sum(F.when(is_kind(CONTEXTS) & (F.col("k") > 0), F.col("rows")).otherwise(0))).alias("n_contexts"),
    ).filter("n_tokens > 0 OR n_train_tokens > 0")


def analysis(lines: DataFrame, orders: int = 4, smoothing: float = 1.0, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``evaluate`` for orders 0 to ``orders``, and the share of perplexity that each saves over the one before.

    ``honest`` is false where there are too few lines to hold some out, or
    none are to be: then the held-out perplexity is one of the training lines.
    """
    lines = coded(lines)
    honest = share > 0 and lines.count() >= LEAST_LINES
    held = split_lines(lines, share, seed) if honest else F.lit(False)
    by_order = Window.orderBy("order")  # a row for each order
    saved = lambda c: F.round(F.coalesce(F.try_divide(F.lag(c).over(by_order) - F.col(c), F.lag(c).over(by_order)), F.when(F.col("order") > 0, 0.0)), 6)
    out = evaluate(counted(lines, held, orders), smoothing, not honest)
    return out.select(
        "order", "train_perplexity", "perplexity", "n_train_tokens", "n_tokens", "n_unknown", "vocab_size", "n_contexts", saved("train_perplexity").alias("train_reduction"),
        saved("perplexity").alias("reduction"), F.lit(honest).alias("honest"),
    )


def optimal(results: DataFrame) -> DataFrame:
    """(by_train, by_test): the orders with the smallest finite perplexities, the first of equals."""
    best = lambda c: F.min(F.when(F.col(c).isNotNull() & (F.abs(c) < float("inf")), F.struct(c, "order"))).order
    return results.agg(best("train_perplexity").alias("by_train"), best("perplexity").alias("by_test"))
