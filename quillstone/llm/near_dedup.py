"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

Texts are fingerprinted where they are read: the set of hashes of all 5-word
shingles, its minima under ``BANDS * ROWS`` hash functions, a key for each
band of minima, and a signature of the low ``BITS`` bits of ``SIGNED`` minima.
Documents with equal sets become one node. Nodes that share a band are
candidates; the collision-corrected estimate from the signatures drops the
hopeless ones and what remains is confirmed on the full sets.

A bucket's members are never paired with each other outright. They are first
linked with leaders of their buckets (as many pairs as members); what then is
in one component needs no further look, so only members of a bucket that lie
in different components are paired. At a similarity of 0.75 a pair shares
none of the bands with probability (1 - 0.75**5)**45, about 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.components import components
from quillstone.llm.storage import KEY, bounded, row_key, stash

NAME = "op4_minhash_near_dedup"
SHINGLE = 5
BANDS, ROWS = 45, 5
BITS, SIGNED = 4, 224
#: Bytes of text that a task looks at together.
SLICE = 1 << 19
#: Percent of the union that two linked sets share.
SIMILARITY = 75
#: Pairs whose estimate is below this are not confirmed. The estimate of a pair at
#: 0.75 has a standard deviation of 0.03, so this lies over five of them below.
LEAST_ESTIMATE = 0.58
#: Members of different components are compared outright once these comparisons are at most
#: so many a member; until then, for LEADER_ROUNDS at most, they meet further leaders.
COMPARED, LEADER_ROUNDS = 64, 4
#: Buckets of more members than this are compared block by block, in blocks of at most so
#: many members and shingles.
LARGE, BLOCK_NODES, BLOCK_SHINGLES = 48, 256, 500_000
#: Leaders, the likeliest by their estimates, with which a node is confirmed at first.
BEST = 2

_DRAWN = K.mix(np.arange(1, BANDS * ROWS + 1, dtype=K.U) * K.U(0x9E37))
_FLIPS, _MULTIPLIERS = (_DRAWN & K.U(0xFFFFFFFF)).astype(np.uint32), (_DRAWN >> K.U(32)).astype(np.uint32) | np.uint32(1)
_PLACE = K.mix(np.arange(101, 101 + SHINGLE, dtype=K.U)) | K.U(1)
_ONES = 0x1111111111111111


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's 5-word shingles; of the whole sequence where there are fewer words."""
    data, offsets = K.text_arrays(texts)
    starts, ends, rows = K.words(data, offsets)
    h = K.span_hashes(K.LOWER[data], starts, ends)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - SHINGLE + 1), K.U)
        for k in range(SHINGLE):
            full += h[k : k + len(full)] * _PLACE[k]
        full = K.mix(full)
        found = []
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if b - a >= SHINGLE:
                found.append(np.unique(full[a : b - SHINGLE + 1]))
            elif b > a:
                found.append(K.mix((h[a:b] * _PLACE[: b - a]).sum(dtype=K.U, keepdims=True) + K.U(b - a)))
            else:
                found.append(np.zeros(0, K.U))
    return found


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of non-empty sets under each hash function, as rows of 32-bit numbers.

    A function flips bits, multiplies, folds the high half into the low one
    and multiplies again, so that which shingle is smallest under one function
    tells next to nothing about another.
    """
    low = (np.concatenate(sets) >> K.U(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(_MULTIPLIERS)), np.uint32)
    work, high = np.empty_like(low), np.empty_like(low)
    for k, (flip, m) in enumerate(zip(_FLIPS, _MULTIPLIERS, strict=True)):
        np.bitwise_xor(low, flip, out=work)
        work *= m
        np.right_shift(work, np.uint32(16), out=high)
        work ^= high
        work *= np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=K.U)[None, :] * K.BASE
        for k in range(ROWS):
            key = K.mix(key + m[:, k :: ROWS][:, :BANDS].astype(K.U))
    return key.astype(np.int64)


def signatures(m: np.ndarray) -> np.ndarray:
    """The low bits of the first minima, 16 to a 64-bit number."""
    bits = K.mix(m[:, :SIGNED].astype(K.U)) & K.U((1 << BITS) - 1)
    per = 64 // BITS
    return (bits.reshape(len(m), -1, per) << (np.arange(per, dtype=K.U) * K.U(BITS))).sum(axis=2, dtype=K.U).astype(np.int64)


FINGERPRINT = f"doc_id bigint, rk {KEY}, digest string, n_shingles bigint, signature array<bigint>, bands array<bigint>"


def _lists(rows: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1)))


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches, "text", SLICE):
        sets = shingle_sets(piece.column("text"))
        full = [s for s in sets if len(s)]
        m = np.zeros((len(sets), BANDS * ROWS), np.uint32)
        if full:
            m[[len(s) > 0 for s in sets]] = minima(full)
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"), piece.column("rk"), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else "" for s in sets]),
                pa.array([len(s) for s in sets], pa.int64()), _lists(signatures(m), SIGNED * BITS // 64), _lists(band_keys(m), BANDS),
            ],
            ["doc_id", "rk", "digest", "n_shingles", "signature", "bands"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches, "text", SLICE):
        sets = shingle_sets(piece.column("text"))
        keep = [k for k, (s, d) in enumerate(zip(sets, piece.column("digest").to_pylist(), strict=True)) if len(s) and xxhash.xxh3_128_hexdigest(s.tobytes()) == d]
        if keep:
            ends = np.cumsum([0] + [len(sets[k]) for k in keep]).astype(np.int32)
            values = np.concatenate([sets[k] for k in keep]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("node").take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "hashes"])


def estimate(a: Column, b: Column) -> Column:
    """The similarity estimated from two signatures, corrected for minima that agree in their low bits by chance."""
    def differing(x, y):
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(_ONES)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return (1.0 - apart / F.lit(float(SIGNED)) - chance) / (1.0 - chance)


def hopeful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar enough, with their set sizes na, nb and the estimate ``near``."""
    own = nodes.select("node", "n_shingles", "signature")
    return (
        pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
        .withColumn("near", estimate(F.col("sa"), F.col("sb")))
        .filter((100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")) & (F.col("near") >= LEAST_ESTIMATE))
        .select("a", "b", "na", "nb", "near")
    )


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, and their sizes na, nb) that share enough of their full sets."""
    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.filter(100 * shared >= SIMILARITY * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct()


def _compare(table: pa.Table) -> pa.Table:
    """Links between different components among the nodes of two blocks: one for each two components that any pair links.

    Sizes of intersections are products of the nodes' incidence with the
    shingles that at least two of them have, a stretch of shingles at a time.
    """
    table = table.combine_chunks()
    node, component, size = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    lists = table.column("hashes").combine_chunks()
    row = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())
    _, token, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[token]
    row, token = row[keep], (np.cumsum(shared) - 1)[token[keep]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    both = np.zeros((len(node), len(node)), np.float32)
    for a in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(token, [a, a + 4096]))
        x = np.zeros((len(node), 4096), np.float32)
        x[row[part], token[part] - a] = 1
        both += x @ x.T
    linked = 100 * both >= SIMILARITY * (size[:, None] + size[None, :] - both)
    _, c = np.unique(component, return_inverse=True)
    i, j = np.nonzero(linked & (c[:, None] < c[None, :]))
    _, one = np.unique(c[i] * (len(node) + 1) + c[j], return_index=True)
    return pa.table({"a": pa.array(node[i[one]], pa.int64()), "b": pa.array(node[j[one]], pa.int64())})


def _hopeful_members(table: pa.Table) -> pa.Table:
    """The members of two blocks whose signatures are near that of a member in another component."""
    table = table.combine_chunks()
    component, size = (table.column(c).to_numpy() for c in ("component", "n_shingles"))
    lists = table.column("signature").combine_chunks()
    signs = lists.flatten().to_numpy().astype(K.U).reshape(len(component), -1)
    some = np.zeros(len(component), bool)
    least = SIGNED * (1 - LEAST_ESTIMATE) * (1 - 1 / (1 << BITS))  # the most entries apart
    for k in range(len(component) - 1):
        d = signs[k + 1 :] ^ signs[k]
        d |= d >> K.U(2)
        d |= d >> K.U(1)
        apart = np.bitwise_count(d & K.U(_ONES)).sum(axis=1)
        low, high = np.minimum(size[k + 1 :], size[k]), np.maximum(size[k + 1 :], size[k])
        near = (apart <= least) & (component[k + 1 :] != component[k]) & (100 * low >= SIMILARITY * high)
        some[k] |= near.any()
        some[k + 1 :] |= near
    return table.select(["band", "p", "q", "node", "component", "n_shingles"]).filter(pa.array(some))


def blockwise(members: DataFrame, large: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components within large buckets: ``members`` (band, node, component, n_shingles, signature), ``large`` (band, blocks).

    Every two blocks of a bucket meet in one group, whose size is bounded.
    They meet with their signatures first; the full sets go only to those
    members that have a hopeful partner there. No pair is written unless it
    links two components.
    """
    other = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: k != F.col("i"))
    met = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q")))).otherwise(
        F.transform(other, lambda k: F.struct(F.least(k, F.col("i")).alias("p"), F.greatest(k, F.col("i")).alias("q")))
    )
    dealt = members.join(large, "band").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("m", F.explode(met))
    signed = dealt.select("band", "m.p", "m.q", "node", "component", "n_shingles", "signature")
    hopeful_ = stash(
        signed.groupBy("band", "p", "q").applyInArrow(_hopeful_members, "band bigint, p bigint, q bigint, node bigint, component bigint, n_shingles bigint"), "hopeful"
    )
    full = hopeful_.join(sets, "node")
    return full.groupBy("band", "p", "q").applyInArrow(_compare, "a bigint, b bigint").distinct()


def first_row() -> Column:
    """What rows of a component are ordered by: doc_id, nulls last, then the row's key."""
    return F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "rk")


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links) of ``docs`` (doc_id, text; other columns are ignored).

    rows: doc_id, rk, digest, n_shingles for every row, repeated rows
    included; rk is a key that only rows equal in doc_id and text share.
    classes: digest, component_id, first, size for every distinct non-empty
    set; the component's id is its smallest doc_id (null only where all its
    rows have none), ``first`` the key of its first row by doc_id, nulls last,
    and key. links: pairs (a, b) of the smallest doc_ids of two linked sets that
    were confirmed, a spanning part of all links. A null or text without
    words has an empty set, digest "" and no class.
    """
    docs = bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    docs = docs.withColumn("rk", row_key("doc_id", "text"))  # tells rows apart, equal ones alone excepted
    rows = stash(docs.mapInArrow(_fingerprint, FINGERPRINT), "shingled")
    value = F.any_value
    nodes = stash(
        rows.filter("n_shingles > 0").groupBy("digest")
        .agg(F.min(first_row()).alias("head"), F.count("*").alias("copies"), value("n_shingles").alias("n_shingles"), value("signature").alias("signature"), value("bands").alias("bands"))
        .select("digest", "head", "head.doc_id", "head.rk", "copies", "n_shingles", "signature", "bands")
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    placed = nodes.select("node", F.explode("bands").alias("band"))
    lead = F.min_by("node", F.xxhash64("node", "band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("n"), lead.alias("leader"), F.min("node").alias("lowest")).filter("n > 1").drop("n")
    members = stash(placed.join(shared, "band"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rk", "digest"), "node").withColumnRenamed("rk", "_rk")
    # equal rows share a key; one of them is enough
    texts = docs.join(wanted, docs.rk == F.col("_rk")).groupBy("rk").agg(value("node").alias("node"), value("digest").alias("digest"), value("text").alias("text"))
    sets = stash(texts.select("node", "digest", "text").mapInArrow(_full_sets, "node bigint, hashes array<bigint>"), "sets")
    pairs = members.select(F.explode(F.array("leader", "lowest")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    # of its leaders (one or two a band) a node is confirmed with the likeliest, and with the lowest likely one
    likely = hopeful(pairs, nodes).groupBy("b").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("near", "a", "na", "nb")), asc=False), 1, BEST).alias("best"),
        F.min(F.when(F.col("near") * 100 >= SIMILARITY, F.struct("a", "near", "na", "nb"))).alias("low"),
    )
    low = F.when(F.col("low").isNull(), F.col("best")).otherwise(F.array_append("best", F.struct("low.near", "low.a", "low.na", "low.nb")))
    likely = likely.select("b", F.explode(low).alias("l")).select("l.a", "b", "l.na", "l.nb").distinct()
    links = stash(verify(likely, sets), "links")
    parts = stash(components(links), "components")
    for turn in range(1, LEADER_ROUNDS + 1):
        now = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).select("band", "node", "component")
        tally = now.groupBy("band", "component").agg(F.count("*").alias("c"))
        split = tally.groupBy("band").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("k")).filter("k > 1")
        left, most = split.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.sum("n")).first()
        if not left:
            break
        last = turn == LEADER_ROUNDS or left <= COMPARED * most
        open_ = now.join(split.select("band"), "band")
        if last:
            # estimates are compared within the join, so only hopeful pairs leave it
            full = open_.join(nodes.select("node", "n_shingles", "signature"), "node").select("band", "node", "n_shingles", "component", "signature")
            load = full.groupBy("band").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("t")).filter(F.col("m") > LARGE)
            large = stash(load.select("band", F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("t") / BLOCK_SHINGLES)).alias("blocks")), "large-buckets")
            few = full.join(large, "band", "left_anti")
            x, y = few.toDF("band", "a", "na", "ca", "sa"), few.toDF("band", "b", "nb", "cb", "sb")
            fit = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
            near = x.join(y, (x.band == y.band) & fit & (estimate(F.col("sa"), F.col("sb")) >= LEAST_ESTIMATE))
            found = verify(near.select("a", "b", "na", "nb").distinct(), sets).union(blockwise(full, large, sets))
        else:
            lead = open_.groupBy("band").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("l"))
            pairs = open_.join(lead, "band").filter("l.component <> component").select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
            found = verify(hopeful(pairs, nodes), sets)
        found = stash(found, "links")
        if not found.isEmpty():
            links = links.union(found)
            parts = stash(components(links), "components")
        if last:
            break
    placed = nodes.select("node", "digest", "head", "copies").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("head").alias("_head"), F.sum("copies").alias("size"))
    classes = placed.join(ids, "component").select("digest", F.col("_head.doc_id").alias("component_id"), F.col("_head.rk").alias("first"), "size")
    name = nodes.select("node", "doc_id")
    named = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return rows.select("doc_id", "rk", "digest", "n_shingles"), classes, named


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, rk, chosen for each row of ``docs``; see ``near_groups``.

    ``kept`` says whether the row's doc_id is the component's. ``chosen`` says
    so of rows and not of ids: it holds for one row of each component and the
    rows equal to it, also where ids are repeated; a row without a doc_id is
    kept where it is chosen, which takes a component without any id. A
    document without words is a component of its own.
    """
    rows, classes, _ = near_groups(docs)
    joined = rows.join(classes, "digest", "left")
    alone = F.col("digest") == ""
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    chosen = alone | (F.col("rk") == F.col("first"))
    kept = F.when(F.col("doc_id").isNull(), chosen).otherwise(F.col("doc_id").eqNullSafe(component))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "rk", chosen.alias("chosen"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rk", "chosen")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
r AS (SELECT g, list(doc_id) AS ds FROM x GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.g IN (SELECT g FROM r) GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * i >= 75 * (len(sa.s) + len(sb.s) - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id WHERE c.r < e.b),
m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""
