"""Random numbers that depend on a seed and on keys alone, not on how rows are partitioned.

``draw`` folds a seed and whole numbers into one number modulo a prime, one
step of multiplying and raising to a power for each. The same steps are
written for Spark, numpy and SQL, so that draws can be checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, FACTOR = (1 << 31) - 1, 48271


def draw(seed: int, *parts: Column) -> Column:
    """A number from 0 up to, but not, 1."""
    def step(x: Column, part: Column) -> Column:
        y = (x * FACTOR + F.pmod(part, F.lit(PRIME)) + 1) % PRIME
        square = y * y % PRIME  # y to the power of 5, which is a permutation modulo this prime
        return square * square % PRIME * y % PRIME

    keys = F.array(*[p.cast("bigint") for p in parts])
    return F.aggregate(keys, F.lit(seed % PRIME).cast("bigint"), step) / F.lit(float(PRIME))


def _residue(x: np.ndarray) -> np.ndarray:
    """``x`` (not negative, below 2**62) modulo ``PRIME``, which is 2**31 - 1: high digits are added to low ones."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def folded(x: np.ndarray | int, *parts: np.ndarray | int) -> np.ndarray:
    """The number that a draw has reached after ``x`` (the seed, or such a number) and more parts."""
    x = np.mod(np.asarray(x, np.int64), PRIME)
    for part in parts:
        y = _residue(x * FACTOR + np.mod(np.asarray(part, np.int64), PRIME) + 1)
        square = _residue(y * y)  # y to the power of 5, which is a permutation modulo this prime
        x = _residue(_residue(square * square) * y)
    return x


def drawn(seed: int, *parts: np.ndarray | int) -> np.ndarray:
    """``draw`` of arrays of whole numbers."""
    return folded(seed % PRIME, *parts) / float(PRIME)


def draw_sql(seed: int | str, *parts: str) -> str:
    """``draw`` in SQL over expressions of whole numbers."""
    p = PRIME
    y = f"((x * {FACTOR} + (v % {p} + {p}) % {p} + 1) % {p})"
    power = f"((({y} * {y}) % {p}) * (({y} * {y}) % {p}) % {p} * {y} % {p})"
    keys = ", ".join(f"({k})::BIGINT" for k in parts)
    return f"(list_reduce([({seed} % {p})::BIGINT, {keys}], lambda x, v: {power}) / {float(p)})"


# -- drawing n of n with replacement ---------------------------------------------------

U = np.uint64
_C1, _C2 = FACTORS = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * _C1
        x = (x ^ (x >> U(33))) * _C2
        return x ^ (x >> U(33))


#: A Poisson variate of mean 1 at most is above this once in 10^17 times.
MOST = 17
#: How many standard deviations the mean of a resample's weights is below the number of its draws.
MARGIN = 3.0


def mean_weight(n: int) -> float:
    """The mean of the Poisson weights of n lines: so far below 1 that they seldom add up to more than n."""
    return max(0.0, 1.0 - MARGIN / np.sqrt(n)) if n else 0.0


@lru_cache(maxsize=8)
def _cuts(mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The cumulative probabilities of a Poisson variate as 64-bit numbers, and its value for each 16 leading bits (255 where a cut lies within)."""
    out, p, run = [], np.exp(-mean), 0.0
    for k in range(MOST + 1):
        run += p
        out.append(min(int(run * 2.0**64), 2**64 - 1))
        p *= mean / (k + 1)
    cuts = np.array(out, U)
    low = np.arange(1 << 16, dtype=U) << U(48)
    first, last = (np.searchsorted(cuts, x, "left") for x in (low, low | U((1 << 48) - 1)))
    return cuts, np.where(first == last, first, 255).astype(np.uint8)


def _hashes(seed: int, streams: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return scramble(streams.astype(U) + U(seed % (1 << 32)) * U(1 << 32)), scramble(keys.astype(np.int64).view(U))


def _mix(line: np.ndarray, rep: np.ndarray, x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``_mixed`` of hashes, in ``x``."""
    np.bitwise_xor(line[:, None], rep[None, :], out=x)
    np.multiply(x, _C1, out=x)
    np.right_shift(x, U(32), out=spare)
    np.bitwise_xor(x, spare, out=x)
    return np.multiply(x, _C2, out=x)


def _mixed(seed: int, streams: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64-bit numbers, a row for each key and a column for each stream."""
    rep, line = _hashes(seed, streams, keys)
    x = np.empty((len(keys), len(streams)), U)
    return _mix(line, rep, x, np.empty_like(x))


#: Cells whose numbers are made at once, so that they stay in a processor's cache.
CACHED = 1 << 15


def poisson_weights(seed: int, keys: np.ndarray, streams: np.ndarray, mean: float = 1.0) -> np.ndarray:
    """Poisson variates of ``mean`` (1 at most), a row for each key and a column for each stream; nothing but the keys is needed."""
    cuts, table = _cuts(float(mean))
    rep, line = _hashes(seed, streams, keys)
    out, step = np.empty((len(keys), len(streams)), np.uint8), max(1, CACHED // max(1, len(streams)))
    x = np.empty((min(step, len(keys)), len(streams)), U)
    lead = np.empty_like(x)
    for a in range(0, len(keys), step):
        some = out[a : a + step]
        n = _mix(line[a : a + step], rep, x[: len(some)], lead[: len(some)])
        np.right_shift(n, U(48), out=lead[: len(some)])
        np.take(table, lead[: len(some)].view(np.int64), out=some, mode="clip")
        odd = np.nonzero(some == 255)
        some[odd] = np.searchsorted(cuts, n[odd], "left")
    return out


#: Streams from here on choose the lines of additional draws.
ADDED = 1 << 31


def added_places(seed: int, stream: int, start: int, end: int, n: int) -> np.ndarray:
    """Which of n lines, from 0, the additional draws ``start`` to below ``end`` of a stream take."""
    x = _mixed(seed, np.array([stream + ADDED]), np.arange(start, end))[:, 0]
    return np.minimum(((x >> U(11)).astype(float) * 2.0**-53 * n).astype(np.int64), n - 1)


@dataclass(frozen=True)
class Draws:
    """Resamples of n of n lines with replacement, as weights of lines.

    A stream gives each line a Poisson weight, from its key alone. Given what
    they add up to, such weights are as many draws with replacement; streams
    where that is more than n are passed over, and in the others draws of
    lines by their number are added until there are n. So each resample has
    exactly n draws, all lines are equally likely in each of them, and few
    draws have to be sent to lines: about three times the square root of n.
    """

    seed: int
    mean: float
    streams: np.ndarray

    def weights(self, keys: np.ndarray, added: pa.ListArray) -> np.ndarray:
        """A row for each line, a column for each resample; ``added`` are the resamples of a line's additional draws."""
        return self.narrow(keys, added).astype(np.int64)

    def narrow(self, keys: np.ndarray, added: pa.ListArray) -> np.ndarray:
        """``weights`` as 16-bit numbers, which no line's weight exceeds."""
        out = poisson_weights(self.seed, keys, self.streams, self.mean).astype(np.uint16)
        sizes = pc.fill_null(pc.list_value_length(added), 0).to_numpy(zero_copy_only=False)
        if sizes.any():
            np.add.at(out, (np.repeat(np.arange(len(keys)), sizes), added.flatten().to_numpy(zero_copy_only=False)), 1)
        return out
