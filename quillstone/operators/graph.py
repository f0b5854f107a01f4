"""Graphs of tokens: size, density, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.shared import stored


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b, once each."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct()


def metrics(edges: DataFrame) -> DataFrame:
    own = undirected(edges)
    nodes = own.select(F.explode(F.array("a", "b")).alias("v")).agg(F.countDistinct("v").alias("n_nodes"))
    both = nodes.crossJoin(own.agg(F.count("*").alias("n_edges")))  # one row each
    density = F.try_divide(2 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1))
    return both.withColumn("density", F.round(F.coalesce(density, F.lit(0.0)), 3))


#: Links that a task contracts together, which bounds its memory: about 110 MB above an idle worker's, however many links there are.
BLOCK = 1 << 18


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the smallest that links (a, b) connect each with: hooks to smaller parents, and jumps to parents' parents, in turn."""
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        low = np.minimum(x, y)
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
    return parent


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of a partition as a spanning forest of stars, block by block: each node but the smallest of its component, with that smallest."""
    held: list[pa.RecordBatch] = []

    def forest() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        both = pa.concat_arrays([table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.column(c).type) for c in ("u", "v")])
        words = both.dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[words.indices.to_numpy()]
        parent = roots(len(order), codes[: len(codes) // 2], codes[len(codes) // 2 :])
        some = np.flatnonzero(parent != np.arange(len(parent)))
        names = words.dictionary.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(parent[some]))], ["u", "v"])

    for batch in batches:
        held.append(batch.select(["u", "v"]))
        if sum(b.num_rows for b in held) >= BLOCK:
            yield from forest()
            held = []
    if held:
        yield from forest()


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that has a link to another: the smallest node it is connected with.

    Links are first contracted where they lie, so that what is dealt out is at
    most a link for each node and task. Then, round by round, each node points
    to the smallest of itself and its neighbours, and links are led on to what
    their ends point to, until none is left; at least every node that is no
    smallest among its neighbours goes, so there are few rounds. At last the
    pointers of all rounds are followed from the last to the first. Minima are
    found by map-side aggregation and a hub's links are led on by a join whose
    other side has a row for each node, so no task gets all links of a hub.
    Each round is written to the shared folder. Loops and repeated edges make
    no difference.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    schema = ", ".join(f"{c} {t}" for c, t in links.dtypes)
    # sorted, so that a task that is run again cuts the same blocks
    contracted = lambda df: stored(df.sortWithinPartitions("u", "v").mapInArrow(_contract, schema).distinct(), "links")
    links = contracted(links)
    pointers = []
    while not links.isEmpty():
        ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.col("v").alias("to")))
        least = links.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.min("to").alias("to"))
        # a node's neighbours above it are never its smallest, so links are read in one direction
        pointers.append(stored(least, "pointers"))
        to = pointers[-1]
        led = links.join(to.toDF("u", "x"), "u").join(to.toDF("v", "y"), "v").filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        links = contracted(led.distinct())
    if not pointers:
        return spark.createDataFrame([], schema.replace("u ", "node ").replace("v ", "component "))
    labels = pointers[-1].toDF("node", "component")
    for p in reversed(pointers[:-1]):
        following = labels.toDF("to", "_label")
        labels = p.join(following, "to", "left").select("node", F.coalesce("_label", "to").alias("component"))
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each is connected with."""
    return stars(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count("*").alias("size"))
