"""Removal of repeated byte strings: anchors, per-shard suffix arrays, cross-shard merging.

A string of ``LENGTH`` bytes that starts at two places is looked for in three steps.

1. Anchors. In every window of ``LENGTH`` bytes the gram with the smallest hash
   (the rightmost of equals) is its anchor. Which gram that is depends on the
   window's bytes alone, so both copies of a repeated string have the same
   anchor gram at the same place. One anchor serves about 180 windows, and
   only anchor grams that occur twice can belong to a repeated string.
2. Shards. For each anchor the stretch of text that its windows cover is
   compared with the stretches around equal grams. Every different stretch of
   a repeated gram goes once, with the number of its copies, to a shard: a
   suffix array built by Larsson-Sadakane refinement. The common prefixes of
   its neighbours, after Kasai, and the copies tell which strings repeat.
3. Merging. A gram with more different stretches than a shard holds is split
   over several. Each shard cuts the sorted list of its strings around that
   gram into ranges; the lists of one range meet in one place, where each is
   looked up in the merged list by binary search, which tells the strings that
   other shards hold as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import kernels as K
from quillstone.llm.storage import KEY, bounded, row_key, stash

NAME = "op2_suffix_array_dedup"
LENGTH, GRAM = 400, 48
#: Bytes of text of a shard, and distinct stretches around one gram from which it is split.
SHARD_BYTES, SHARD_STRETCHES = 1 << 20, 1500
#: Texts longer than this are searched for anchors a part at a time.
PART = 1 << 23
_PLACES = np.uint64((1 << 24) - 1)


# -- anchors ------------------------------------------------------------------

def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, key) of each anchor in texts laid end to end.

    anchor: the place of its gram; first and last: the first and last start of
    the windows whose anchor it is; key: the gram's hash. No window crosses
    from one text into the next.
    """
    found = []
    for part in range(0, max(1, len(data) - LENGTH + 1), PART):
        piece = data[part : part + PART + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        up, down = K.powers(len(piece))
        n = len(piece) - GRAM + 1
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(piece) + 1, K.U)
            np.cumsum(K.BYTES[piece] * up[:-1], out=prefix[1:])
            key = K.mix((prefix[GRAM:] - prefix[:n]) * down[:n])
        low = (key & ~_PLACES) | (_PLACES - np.arange(n, dtype=K.U))
        span, width = 1, LENGTH - GRAM + 1
        while span * 2 <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        starts = np.arange(part, part + len(low))
        inside = offsets[np.searchsorted(offsets, starts, "right")] if len(offsets) == 2 else np.repeat(offsets[1:], np.diff(offsets))[part : part + len(low)]
        good = starts + LENGTH <= inside
        low, starts = low[good], starts[good]
        if not len(low):
            continue
        fresh = np.append(True, (low[1:] != low[:-1]) | (starts[1:] != starts[:-1] + 1))
        at = np.flatnonzero(fresh)
        place = (_PLACES - (low[at] & _PLACES)).astype(np.int64)
        found.append((place + part, starts[at], starts[np.append(at[1:], len(low)) - 1], key[place]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, K.U),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


ANCHORS = f"key bigint, stretch binary, rk {KEY}, first bigint, starts int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches, "text"):
        data, offsets = K.text_arrays(piece.column("text"))
        place, first, last, key = anchors(data, offsets)
        if not len(place):
            continue
        raw = data.tobytes()
        row = np.searchsorted(offsets, first, "right") - 1
        # a stretch is what the anchor's windows cover, and where in it the anchor stands
        stretch = [xxhash.xxh3_128_digest(raw[a : b + LENGTH], seed=p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key.astype(np.int64)), pa.array(stretch, pa.binary()), piece.column("rk").take(pa.array(row)),
                pa.array(first - offsets[row]), pa.array((last - first + 1).astype(np.int32)),
            ],
            ["key", "stretch", "rk", "first", "starts"],
        )


# -- suffix arrays --------------------------------------------------------------

def suffix_array(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of texts laid end to end, and 7-symbol words for comparing.

    ``codes``: bytes + 1, and 0 at each text's terminator; ``ends``: the place
    of the terminator of each place's text. Terminators are smaller than all
    bytes and in the order of their places. Suffixes are ranked by 7 symbols;
    then only groups that are still tied are sorted again, by the rank of
    what follows, twice as far each time (Larsson and Sadakane).
    """
    n = len(codes)
    left = ends - np.arange(n)
    padded = np.concatenate([codes, np.zeros(7, np.int64)])
    two = (padded[:-1] << 9) | padded[1:]
    words = (((two[:-2] << 18) | two[2:])[:n] << 27) | ((two[:-1] << 9) | padded[2:])[4 : 4 + n]
    at_end = np.flatnonzero(left < 7)  # nothing of the next text belongs to these
    words[at_end] = 0
    for k in range(7):
        words[at_end] = (words[at_end] << 9) | np.where(left[at_end] > k, padded[at_end + k], 0)
    order = np.argsort(words)
    ranked = words[order]
    short = np.flatnonzero(left[order] < 7)  # equal ones are equal to the end, so their places decide
    order[short] = order[short][np.lexsort((order[short], ranked[short]))]
    fresh = np.append(True, (ranked[1:] != ranked[:-1]) | (left[order[1:]] < 7))
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    tied = np.repeat(size > 1, size)
    at = np.flatnonzero(tied)  # where in the array groups are tied
    depth = 7
    while len(at):
        who = order[at]
        key = (rank[who] << 31) | rank[who + depth]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(at)))
        rank[who] = np.repeat(at[head], size)
        at = at[np.repeat(size > 1, size)]
        depth *= 2
    words[at_end] = -1 - at_end
    return order, words


def common_prefixes(order: np.ndarray, words: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = 0) -> np.ndarray:
    """By place: the length shared with the suffix before it in the array (Kasai, all texts in step); 0 where it is under ``least``.

    From one place to the next at most one symbol is lost, so each text is
    worked through with what it has kept; words of 7 symbols are compared
    first, then single ones. For the same reason a place that shares ``least``
    symbols is followed by so many places, less six, that share seven: places
    that are not are left out.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    out = np.zeros(n, np.int64)
    if least > 7:
        near = (words == words[before]) & (before >= 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        starts, sizes = edge[0::2], edge[1::2] - edge[0::2]
        starts, sizes = starts[sizes >= least - 6], sizes[sizes >= least - 6]
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    kept = np.zeros(len(starts), np.int64)
    words = np.append(words, -np.arange(n + 2, n + 10))
    symbol = codes.copy()
    symbol[codes == 0] = -1 - np.flatnonzero(codes == 0)  # terminators differ from each other
    for t in range(int(sizes[0]) if len(sizes) else 0):
        lanes = int(np.searchsorted(-sizes, -t, "left"))
        i = starts[:lanes] + t
        j = before[i]
        length = np.maximum(kept[:lanes] - 1, 0)
        length[j < 0] = 0
        live = np.flatnonzero(j >= 0)
        while len(live):
            live = live[words[i[live] + length[live]] == words[j[live] + length[live]]]
            length[live] += 7
        live = np.flatnonzero(j >= 0)
        while len(live):
            live = live[symbol[i[live] + length[live]] == symbol[j[live] + length[live]]]
            length[live] += 1
        out[i] = kept[:lanes] = length
    out[out < least] = 0
    return out


SHARD = "key bigint, stretch binary, hits array<int>, range int, digests binary, places binary"
_DIGEST = np.dtype([("high", ">u8"), ("low", ">u8")])


def _search_shard(table: pa.Table) -> pa.Table:
    """Of each stretch of a shard: the starts (as intervals) of strings that the corpus is known to hold twice.

    For grams that are split over shards, also one start of each different
    string that no copy of its stretch repeats, with its digest, in order of
    the digests and cut into ranges of them.
    """
    texts = table.column("text").to_pylist()
    copies, ranges = np.array(table.column("c").to_pylist()), np.array(table.column("ranges").to_pylist())
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    body = np.ones(len(codes), bool)
    body[begin + sizes] = False
    codes[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    ends = np.repeat(begin + sizes, sizes + 1)
    order, words = suffix_array(codes, ends)
    shared = common_prefixes(order, words, codes, begin, sizes, LENGTH)
    same = shared[order] >= LENGTH  # with the suffix before it
    repeated = np.repeat(copies > 1, sizes + 1)
    group = np.cumsum(~same) - 1  # suffixes that begin with the same string
    repeated_group = np.bincount(group, repeated[order], int(group[-1]) + 1 if len(group) else 0) > 0
    repeated[order] |= same | np.append(same[1:], False) | repeated_group[group]
    leader = np.zeros(len(codes), bool)
    leader[order] = ~same
    rows = []
    for nth, (a, n, text, parts) in enumerate(zip(begin.tolist(), (sizes - LENGTH + 1).tolist(), texts, ranges.tolist(), strict=True)):
        edge = np.diff(np.concatenate([[0], repeated[a : a + n].astype(np.int8), [0]]))
        hits = np.stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)], axis=1).reshape(-1).astype(np.int32)
        if len(hits):
            rows.append((nth, hits, None, None, None))
        own = np.flatnonzero(leader[a : a + n]) if parts > 1 else ()
        if len(own):
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[k : k + LENGTH]) for k in own.tolist()), _DIGEST)
            by = np.lexsort((digests["low"], digests["high"]))
            digests, own = digests[by], own[by].astype(np.int32)
            cuts = np.searchsorted(digests["high"].astype(K.U), np.arange(1, parts).astype(K.U) * K.U((1 << 64) // parts))
            for part, (d, o) in enumerate(zip(np.split(digests, cuts), np.split(own, cuts), strict=True)):
                if len(d):
                    rows.append((nth, None, part, d.tobytes(), o.tobytes()))
    nth, hits, part, digests, places = zip(*rows, strict=True) if rows else ((),) * 5
    nth = pa.array(nth, pa.int64())
    return pa.table({
        "key": table.column("key").take(nth), "stretch": table.column("stretch").take(nth), "hits": pa.array(hits, pa.list_(pa.int32())),
        "range": pa.array(part, pa.int32()), "digests": pa.array(digests, pa.binary()), "places": pa.array(places, pa.binary()),
    })


def _merge_range(table: pa.Table) -> pa.Table:
    """The strings of one range of digests that more than one shard lists: each sorted list is looked up in all lists merged."""
    lists = [np.frombuffer(d, _DIGEST) for d in table.column("digests").to_pylist()]
    places = [np.frombuffer(p, np.int32) for p in table.column("places").to_pylist()]
    # a digest as two numbers: its rank among the first halves, joined with its second half
    high = np.unique(np.concatenate([d["high"] for d in lists]).astype(K.U))
    ranked = [(np.searchsorted(high, d["high"].astype(K.U)), d["low"].astype(K.U)) for d in lists]
    rank, low = (np.concatenate(c) for c in zip(*ranked, strict=True))
    by = np.lexsort((low, rank))
    fresh = np.append(True, (rank[by][1:] != rank[by][:-1]) | (low[by][1:] != low[by][:-1]))
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(fresh) - 1  # equal digests share a number, in their order
    merged = np.sort(number)
    ends = np.cumsum([len(p) for p in places])
    hits = []
    for own, place in zip(np.split(number, ends[:-1]), places, strict=True):
        found = np.searchsorted(merged, own, "right") - np.searchsorted(merged, own, "left") > 1
        hits.append(np.stack([place[found], place[found] + 1], axis=1).reshape(-1).astype(np.int32))
    return table.select(["key", "stretch"]).append_column("hits", pa.array(hits, pa.list_(pa.int32()))).filter(pa.array([len(h) > 0 for h in hits], pa.bool_()))


# -- the whole -------------------------------------------------------------------

def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for piece in K.slices(batches, "text", 1 << 18):
        rows = []
        for text, wanted in zip(piece.column("text").to_pylist(), piece.column("wanted").to_pylist(), strict=True):
            raw = (text or "").encode()
            rows += [(w["key"], w["stretch"], w["c"], w["d"], raw[w["first"] : w["first"] + w["starts"] + LENGTH - 1]) for w in wanted]
        if rows:
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "stretch", "c", "d", "text"])


def removed_mask(n: int, intervals: list[tuple[int, int]]) -> np.ndarray:
    """The bytes covered by strings whose starts lie in the intervals."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in intervals:
        edge[a] += 1
        edge[min(n, b - 1 + LENGTH)] -= 1
    return np.cumsum(edge[:-1]) > 0


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _remover(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.slices(batches, "text", 1 << 22):
            out = []
            for doc_id, text, spans in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = (text or "").encode()
                own = [(s["a"], s["b"]) for s in spans or ()]
                kept, gone, runs = raw, 0, 0
                if own:
                    mask = removed_mask(len(raw), own)
                    gone, runs = int(mask.sum()), int((np.diff(mask.astype(np.int8), prepend=0) > 0).sum())
                    kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                out.append((doc_id, len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*[c.split()[0] for c in RESULT.split(", ")], *["kept"] * with_text])

    return remove


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """The columns of ``RESULT`` for each row of ``docs`` (doc_id, text; other columns are ignored), and the bytes kept.

    Removed is every byte that lies in a string of ``LENGTH`` bytes which
    starts at another place as well, in the same text or any other. A null
    text is the empty text. Repeated rows are documents of their own, so all
    of such a text is removed, if it is long enough. Bytes may be cut within
    a character, so ``kept`` is binary.
    """
    docs = bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).withColumn("rk", row_key("doc_id", "text"))
    found = stash(docs.mapInArrow(_anchors, ANCHORS), "anchors")
    # written, so that both sides of the join are dealt out plainly and a very common gram's rows can be split
    twice = stash(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated-grams")
    open_ = stash(found.join(twice, "key"), "repeated-anchors")
    kinds = open_.groupBy("key", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("rk", "first", "starts")).alias("one"))
    kinds = stash(kinds.join(kinds.groupBy("key").agg(F.count("*").alias("d")), "key"), "stretches")
    # the stretches of one text, found again by the key of a row that holds it; of equal rows, one is enough
    wanted = (
        kinds.select("one.*", "key", "stretch", "c", "d").groupBy(F.col("rk").alias("_rk"))
        .agg(F.collect_list(F.struct("key", "stretch", "c", "d", "first", "starts")).alias("wanted"))
    )
    texts = docs.join(wanted, docs.rk == F.col("_rk")).groupBy("rk").agg(F.any_value("text").alias("text"), F.any_value("wanted").alias("wanted"))
    cut = stash(texts.select("text", "wanted").mapInArrow(_cut, "key bigint, stretch binary, c bigint, d bigint, text binary"), "cut")
    size = cut.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    # a gram's stretches share a shard, or several where there are more than one holds
    ranges = F.ceil(F.col("d") / F.lit(float(SHARD_STRETCHES)))
    shard = F.when(F.col("ranges") > 1, F.xxhash64("key", F.pmod(F.xxhash64("stretch"), F.col("ranges")))).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards)))
    dealt = cut.withColumn("ranges", ranges).withColumn("shard", shard).select("key", "stretch", "c", "ranges", "text", "shard")
    searched = stash(dealt.groupBy("shard").applyInArrow(_search_shard, SHARD), "searched")
    listed = searched.filter("range IS NOT NULL").select("key", "stretch", "range", "digests", "places")
    merged = listed.groupBy("key", "range").applyInArrow(_merge_range, "key bigint, stretch binary, hits array<int>")
    every = searched.filter("hits IS NOT NULL").select("key", "stretch", "hits").union(merged)
    hits = stash(every.groupBy("key", "stretch").agg(F.flatten(F.collect_list("hits")).alias("hits")), "found-strings")  # written, as above
    spans = (
        open_.join(hits, ["key", "stretch"]).select("rk", "first", "hits").distinct()
        .select("rk", "first", "hits", F.explode(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2))).alias("k"))
        .select(F.col("rk").alias("_rk"), F.struct((F.col("first") + F.expr("hits[k]")).alias("a"), (F.col("first") + F.expr("hits[k + 1]")).alias("b")).alias("s"))
        .groupBy("_rk").agg(F.collect_list("s").alias("spans"))
    )
    joined = docs.join(spans, docs.rk == F.col("_rk"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remover(with_text), RESULT + (", kept binary" if with_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by hashes of every string, as hexadecimal digits; long texts are cut into overlapping parts first.
_STEP = 4096
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT r, c, substr(h, {2 * _STEP} * c + 1, {2 * (_STEP + LENGTH - 1)}) AS x FROM (SELECT r, h, unnest(range(0, (len(h) // 2 - {LENGTH}) // {_STEP} + 1)) AS c FROM d WHERE len(h) >= {2 * LENGTH})),
g AS (SELECT r, unnest(hs) AS k, c * {_STEP} + generate_subscripts(hs, 1) - 1 AS i
      FROM (SELECT r, c, list_transform(range(0, len(x) // 2 - {LENGTH - 1}), lambda i: hash(substr(x, 2 * i + 1, {2 * LENGTH}))) AS hs FROM x)),
p AS (SELECT r, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
q AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS fresh FROM p),
u AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM q) GROUP BY r, run),
v AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM u),
w AS (SELECT d.r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
      FROM v JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN w USING (r)
"""
