"""Order MinHash fingerprints: sensitive to edits that keep the set of k-mers.

Every k-mer of a text is numbered by its occurrence. For each of ``SKETCHES``
hash functions the ``TUPLE`` smallest numbered k-mers are selected and put back
into text order; the hash of that tuple is one entry of the fingerprint. Two
fingerprints agree in a share of entries that falls with the edit distance.

A text's neighbour in the order of keys is needed for its edited form. Rows are
cut into ranges of the key; the first row of each range goes to the range
before it as well, so that every range can be worked through alone, in order,
with one row held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.storage import bounded
from quillstone.operators.order import numbered_ranges

NAME = "op1_order_minhash"
ORACLE = None
KMER, TUPLE, SKETCHES = 10, 2, 64
#: Bits of a tuple's hash in the fingerprint.
ENTRY_BITS = 16
#: Numbers handled at once: bounds the memory of long texts.
BLOCK = 1 << 16

_FACTORS = (K.mix(np.arange(1, SKETCHES + 1, dtype=K.U) * K.U(0x51ED)) >> K.U(32)).astype(np.uint32) | np.uint32(1)
_FLIPS = (K.mix(np.arange(1, SKETCHES + 1, dtype=K.U) * K.U(0x2B0F)) >> K.U(32)).astype(np.uint32)


def kmers(points: np.ndarray) -> np.ndarray:
    """A hash of each k-mer; a shorter text is one k-mer of its own."""
    with np.errstate(over="ignore"):
        if len(points) < KMER:
            h = K.U(len(points))
            for c in points:
                h = h * K.BASE + K.U(c) + K.U(1)
            return K.mix(np.array([h], K.U))
        h = np.zeros(len(points) - KMER + 1, K.U)
        for k in range(KMER):
            h *= K.BASE
            h += points[k : k + len(h)]
        return K.mix(h + K.U(KMER))


def numbered(h: np.ndarray) -> np.ndarray:
    """Each k-mer's hash joined with the number of its earlier occurrences, in 32 bits."""
    n = len(h)
    low = n.bit_length()
    keys = ((h >> K.U(low)) << K.U(low)) | np.arange(n, dtype=K.U)
    keys.sort()  # equal k-mers end up together, in text order
    place = (keys & K.U((1 << low) - 1)).astype(np.int64)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(keys[1:] >> K.U(low), keys[:-1] >> K.U(low), out=fresh[1:])
    at = np.arange(n)
    occurrence = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        out[place] = (K.mix(h[place] + occurrence.astype(K.U) * K.BASE) >> K.U(32)).astype(np.uint32)
    return out


def sketch(text: str) -> np.ndarray:
    """The fingerprint's entries; equal texts have equal ones. An empty text has no k-mers and entries of 0."""
    if not text:
        return np.zeros(SKETCHES, np.uint16)
    h = kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(K.U))
    base = numbered(h)
    chosen = np.empty((TUPLE, SKETCHES), np.int64)
    rows = max(1, BLOCK // len(base))
    work = np.empty((min(rows, SKETCHES), len(base)), np.uint32)
    for a in range(0, SKETCHES, rows):
        block = work[: min(rows, SKETCHES - a)]
        np.bitwise_xor(base[None, :], _FLIPS[a : a + rows, None], out=block)
        block *= _FACTORS[a : a + rows, None]
        line = np.arange(len(block))
        for t in range(TUPLE):
            chosen[t, a : a + rows] = at = block.argmin(axis=1)
            block[line, at] = 0xFFFFFFFF
    chosen.sort(axis=0)
    with np.errstate(over="ignore"):
        out = np.full(SKETCHES, 1, K.U)
        for t in range(TUPLE):
            out = K.mix(out * K.BASE + h[chosen[t]])
    return (out >> K.U(64 - ENTRY_BITS)).astype(np.uint16)


def encode(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


def likeness(a: tuple[bool, np.ndarray], b: tuple[bool, np.ndarray]) -> float:
    """The share of equal entries; an empty text is like an empty text only."""
    if a[0] or b[0]:
        return float(a[0] and b[0])
    return float(np.mean(a[1] == b[1]))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` with ``part`` and ``guest``: ranges of the key, each with the first row of the next as a guest.

    After the last range comes the first again. Rows without a doc_id, or with
    one doc_id, take as many ranges as they fill, in the order of ``mark``, a
    hash of their text.
    """
    marked = docs.withColumn("mark", F.xxhash64("text")).withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    cut = numbered_ranges(marked, "_key", parts, F.col("mark") / F.lit(2.0**64) + 0.5).drop("_key").withColumnRenamed("_part", "part")
    heads = cut.groupBy("part").agg(F.min(F.struct("doc_id", "mark")).alias("head"))
    # a row for each range: the range before it, which for the first is the last
    every = Window.orderBy("part")
    hosts = heads.select("part", "head", F.coalesce(F.lag("part").over(every), F.max("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("host"))
    first = cut.join(F.broadcast(hosts), "part").filter(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark")))
    guests = first.groupBy(F.col("host").alias("part")).agg(F.any_value(F.col("head.doc_id")).alias("doc_id"), F.any_value("text").alias("text"), F.any_value("mark").alias("mark"))
    columns = ("doc_id", "text", "mark", "part")
    return cut.select(*columns, F.lit(0).alias("guest")).union(guests.select(*columns, F.lit(1).alias("guest")))


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row before: its range, key, text and fingerprint
    for batch in (p for b in batches for p in K.slices(iter([b]), "text")):
        out = []
        for doc_id, text, part, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
            text = text or ""
            if held and held[0] != part:
                held = None
            if guest and not held:
                continue
            own = (not text, sketch(text))
            if held:
                _, key, before, mark = held
                other = edited(before, text)
                changed = (not other, sketch(other))
                out.append((key, len(before), hashlib.sha256(other.encode()).hexdigest(), encode(mark[1]), encode(changed[1]), likeness(mark, changed), likeness(mark, own)))
            held = None if guest else (part, doc_id, text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out, strict=True))], [x.split()[0] for x in OUT.split(", ")])


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The columns of ``OUT`` for each row of ``docs`` (doc_id, text; other columns are ignored).

    Rows follow each other by ascending doc_id, nulls first, equal ids by the
    hash of their text; a null text is the empty text. The row after the last
    is the first, so a single row follows itself.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = bounded(ranges(docs, parts)).repartitionById(parts, "part").sortWithinPartitions("part", "guest", "doc_id", "mark", "text")
    return dealt.drop("mark").mapInArrow(_walk, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
