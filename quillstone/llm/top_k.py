"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Candidate vectors are cut into shards and queries into blocks. Within a shard
each dimension is a list of the shard's vectors in the order of that component.
A query reads every list from the end that its own component favours, all
lists in step, to a depth that grows from the top. After each stretch a
vector's score is bounded by what has been read of it: what is unread counts
at the value last read in that list (above) and at the list's last value
(below). Vectors whose upper bound is under the k-th largest lower bound are
outsiders; a query stops reading when at most ``FEW`` vectors are not, or the
lists end. The scores of those left are then resolved in integers, and the
shards' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.storage import bounded

NAME = "op5_top_k_search"
K_BEST, EVERY, SCALE = 5, 50, 256
#: Vectors of a shard and queries of a block: bound a task's memory.
SHARD_ROWS, BLOCK_ROWS = 8192, 256
#: The depths, as shares of the lists, at which bounds are compared, and how many vectors may be left when a query stops reading.
DEPTHS, FEW = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1.0), 128


def quantised(vector: Column) -> Column:
    """Each component x as floor(SCALE * x); null where the vector is null or holds a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


BLOCKS = "dim int, block bigint, ids binary, data binary"


def _packed(x: np.ndarray) -> bytes:
    """``x`` in the fewest bytes a number that hold all of them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return next(x.astype(t).tobytes() for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (rows * dim)}").astype(np.int64).reshape(rows, dim)


def _pack(most: int):
    """A function that packs rows (vec_id, v) into blocks of at most ``most`` vectors of one length."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int):
            nonlocal number
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            for a in range(0, len(ids), most):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([ids[a : a + most].tobytes()]), pa.array([_packed(data[a : a + most])])], ["dim", "block", "ids", "data"])
                number += 1

        for batch in batches:
            column = batch.column("v")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == dim)
                held.setdefault(int(dim), []).append((ids[own], flat[starts[own][:, None] + np.arange(dim)]))
                if sum(len(x) for x, _ in held[int(dim)]) >= most:
                    yield from block(int(dim))
        for dim in list(held):
            yield from block(dim)

    return pack


def read_lists(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be among each query's k best, and the share of the lists that each query has read.

    ``own`` (query, vector) leaves pairs out. Bounds are kept in short
    floating-point numbers, all components scaled to at most 1, and compared
    with a margin for their rounding, so that no vector that qualifies is
    lost, however large the components are.
    """
    n, dim = x.shape
    x, q = (v / max(1.0, float(np.abs(v.astype(np.float64)).max(initial=0))) for v in (x, q))
    x, q = x.astype(np.float32), q.astype(np.float32)
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0)
    place = np.empty(order.shape, np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    left, read = ~own, np.ones(len(q))
    margin = 2.0**-24 * (4 * dim + 32) * (np.abs(q) @ np.abs(x).max(axis=0, initial=0))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    active = np.flatnonzero(left.sum(axis=1) > FEW)
    known, depth = np.zeros((len(q), n), np.float32), 0
    for share in DEPTHS:
        before, depth = depth, max(depth, int(n * share))
        if not len(active) or depth == before:
            continue
        # what this stretch adds: from the largest for positive components of a query, from the smallest for negative ones
        high, low = place >= n - depth, place < depth
        known[active] += up[active] @ np.where(high & (place < n - before), x, 0).T + down[active] @ np.where(low & (place >= before), x, 0).T
        unread_high, unread_low = (~high).T.astype(np.float32), (~low).T.astype(np.float32)
        last_high, last_low = ordered[n - depth], ordered[depth - 1]
        upper = known[active] + (up[active] * last_high) @ unread_high + (down[active] * last_low) @ unread_low
        lower = known[active] + (up[active] * ordered[0]) @ unread_high + (down[active] * ordered[-1]) @ unread_low
        lower[own[active]] = -np.inf
        bar = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(active), -np.inf)
        left[active] &= upper >= (bar - 2 * margin[active])[:, None]
        read[active] = depth / n
        active = active[left[active].sum(axis=1) > FEW]
    return left, read


def resolved(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Integer inner products; one that no 64-bit number holds becomes the nearest that one does."""
    largest = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (x, row)]
    if largest[0] * largest[1] * x.shape[1] < 2.0**62:
        return x @ row
    exact = (sum(int(a) * int(b) for a, b in zip(v, row, strict=True)) for v in x)
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best vectors of one shard, without those of its own id."""
    open_, _ = read_lists(x, q, ids[None, :] == query_ids[:, None], k)
    out = []
    for k_query, (qid, row) in enumerate(zip(query_ids, q, strict=True)):
        left = np.flatnonzero(open_[k_query])
        score = resolved(x[left], row)
        if len(left) > k:
            bar = np.partition(score, len(left) - k)[len(left) - k]
            left, score = left[score >= bar], score[score >= bar]
        # descending scores without negating them, as the smallest number has no opposite
        first = np.lexsort((ids[left], ~score))[:k]
        out.append((np.full(len(first), qid), ids[left][first], score[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(batch.num_rows):
                dim, ids, data, query_ids, query = (batch.column(c)[a].as_py() for c in ("dim", "ids", "data", "query_ids", "query"))
                ids, query_ids = (np.frombuffer(b, np.int64) for b in (ids, query_ids))
                found = best_of(ids, _unpacked(data, len(ids), dim), query_ids, _unpacked(query, len(query_ids), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K_BEST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries``, both (vec_id, embedding).

    Score: the integer inner product of the quantised vectors, ties to the
    smaller vec_id. A query meets the vectors of its own length except those
    of its own id. Null ids, and vectors null, empty or holding null or
    non-finite components take no part. Repeated rows are each a candidate;
    of several query rows with one id the smallest vector counts. A component
    or score that no 64-bit number holds counts as the nearest one that it
    does. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")

    # no more slots than about the shards fill, as each of them gets all queries
    slots = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * -(-vectors.count() // SHARD_ROWS)))
    shards = clean(vectors).mapInArrow(_pack(SHARD_ROWS), BLOCKS).withColumn("slot", F.pmod(F.hash("block"), F.lit(slots)))
    asked = clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    # blocks of the stated query set visit every slot that holds shards
    blocks = asked.mapInArrow(_pack(BLOCK_ROWS), BLOCKS).select("dim", F.col("ids").alias("query_ids"), F.col("data").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    # never broadcast: a size estimated before the blocks are multiplied says nothing of what the driver would hold
    found = bounded(shards).join(blocks.hint("merge"), ["dim", "slot"]).select("dim", "ids", "data", "query_ids", "query").mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K_BEST}
"""
