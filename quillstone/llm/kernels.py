"""Numpy kernels over Arrow text columns, shared by the operators.

They look at a slice of a batch as one byte array with row offsets, so their
cost is per byte rather than per row, and their memory is that of the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


BYTES = mix(np.arange(1, 257, dtype=U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 19)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            full = np.full(size, base, U)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends) or ends[0] == ends[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes of ``column``, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_arrays(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    # a worker outlives its task and would hold on to what Arrow no longer needs
    pa.default_memory_pool().release_unused()


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of the runs of true elements; none goes on from one row into the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of the runs without ASCII white space, row by row."""
    return _spans(~WHITE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, by differences of one polynomial prefix sum."""
    return _hashed(BYTES[data], starts, ends)


def _hashed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(values))
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U))


# -- letters --------------------------------------------------------------------

#: Code points whose words are looked at together.
CHUNK = 1 << 20


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter (``str.isalpha``), and its lower-case form where that is one code point."""
    is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for k, c in enumerate(map(chr, range(0x110000))):
        if c.isalpha():
            is_letter[k] = True
            small = c.lower()
            if len(small) == 1:
                lower[k] = ord(small)
    return is_letter, lower


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column and its n + 1 offsets; nulls count as empty."""
    data, offsets = text_arrays(column)
    head = (data & 0xC0) != 0x80
    if head.all():
        return data.astype(np.uint32), offsets
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum(head, out=places[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), places[offsets]


def gram_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span of code points."""
    return _hashed(mix(points.astype(U) + U(1)), starts, ends)


def letter_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, keys and per-row offsets of the runs of letters of texts laid end to end.

    A key depends on the lower-case letters alone. Long texts are worked
    through in chunks that end between words, so the memory beside the code
    points is that of a chunk and of the words found.
    """
    is_letter, lower = letters()
    starts, ends, rows = _spans(is_letter[points], offsets)
    keys, at = [], 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        keys.append(gram_keys(lower[points[low : ends[stop - 1]]], starts[at:stop] - low, ends[at:stop] - low))
        at = stop
    return starts, ends, np.concatenate(keys) if keys else np.zeros(0, U), rows


def word_key(word: str) -> int:
    """The key of one word, as ``letter_words`` gives it, as a signed number."""
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(gram_keys(letters()[1][points], np.array([0]), np.array([len(points)])).astype(np.int64)[0])


def runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each item's group, and its place in it."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
