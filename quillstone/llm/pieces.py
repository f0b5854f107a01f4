"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a public byte-pair model; its path is a parameter.
Text is cut before runs of spaces, which no piece crosses, and each segment is
merged by an agenda: the candidate of the best score, the leftmost of equals,
is merged next. A candidate is skipped where a hash keyed by the seed, the
row, the segment and its number, and the candidate's place falls under the
dropout rate, so that a seed gives the same pieces wherever a row is encoded.
At rate 0 the pieces are the model's own.

Agendas of many segments run in step, as numpy arrays. Equal segments of a
slice share an agenda only where all its candidates are skipped or kept alike
for each of them. Long segments have an agenda of their own.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from quillstone.llm import kernels as K
from quillstone.llm.storage import bounded

NAME = "op9_sentencepiece_dropout"
ORACLE = None
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 7
#: Segments of more symbols than this have an agenda of their own.
LONG = 48
#: Rows that the decoder spells at once.
DECODED = 256
NO_RANK = np.int64(1) << 40
SPACE = "▁"


@cache
def load(path: str = MODEL) -> dict:
    """The tables of a model: of single characters, of mergeable pairs, and the bytes of each piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = {model.id_to_piece(k): k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    scores = sorted({model.get_score(k) for k in plain.values()}, reverse=True)
    rank_of = {s: r for r, s in enumerate(scores)}
    pairs = {}
    for piece, k in plain.items():
        for cut in range(1, len(piece)):
            a, b = plain.get(piece[:cut]), plain.get(piece[cut:])
            if a is not None and b is not None:
                pairs[a << 20 | b] = (k, rank_of[model.get_score(k)])
    if any(SPACE in piece.lstrip(SPACE) for piece in plain):
        raise ValueError("a piece of the model has a space after another character")
    keys = np.array(sorted(pairs), np.int64)
    chars = {ord(p): k for p, k in plain.items() if len(p) == 1 and p != SPACE}
    bytes_of = [b""] * n
    for p, k in plain.items():
        bytes_of[k] = p.replace(SPACE, " ").encode()
    first_byte = next(k for k in range(n) if model.is_byte(k))
    for b in range(256):
        bytes_of[first_byte + b] = bytes([b])
    points = np.array(sorted(chars), np.int64)
    return {
        "points": points, "chars": np.array([chars[p] for p in points.tolist()], np.int64), "space": plain[SPACE], "first_byte": first_byte, "bytes": bytes_of,
        "keys": keys, "merged": np.array([pairs[k][0] for k in keys.tolist()], np.int64), "ranks": np.array([pairs[k][1] for k in keys.tolist()], np.int64),
    }


class Encoder:
    """Encodes slices of texts under one model, rate and seed."""

    def __init__(self, model: dict, dropout: float, seed: int):
        self.m, self.seed = model, seed
        self.limit = K.U(min(int(dropout * 2**64), 2**64 - 1))
        self.drops = dropout > 0
        self.char = np.full(0x110000, -1, np.int32)
        self.char[model["points"]] = model["chars"]
        self.char[32] = model["space"]
        # an open hash table of the pairs: a few probes, all elements at once
        self.bits = max(4, (4 * len(model["keys"])).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        slot = self._slot(model["keys"])
        left = np.arange(len(slot))
        self.probes = 0
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = free  # of several for one slot, the last stays
            left = left[self.slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(K.U) * K.BASE) >> K.U(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair in the model's tables, or -1."""
        key = (a << 20) | b
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(self.probes):
            at = self.slots[slot[left]]
            full = at >= 0
            left, at = left[full], at[full]
            same = self.m["keys"][at] == key[left]
            out[left[same]] = at[same]
            left = left[~same]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def _skipped(self, keys: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return K.mix(keys + start.astype(K.U) * K.U(0x9E3779B1) + middle.astype(K.U) * K.U(0x85EBCA6B1) + end.astype(K.U) * K.U(0xC2B2AE3D27)) < self.limit

    def _long(self, symbols: list[int], key: np.ndarray) -> list[int]:
        """One segment's pieces by a heap of candidates."""
        n = len(symbols)
        symbols, ends = list(symbols), list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple] = []

        def offer(lefts: list[int]) -> None:
            lefts = [x for x in lefts if x >= 0 and after[x] >= 0]
            if not lefts:
                return
            rights = [after[x] for x in lefts]
            found = self._find(np.array([symbols[x] for x in lefts], np.int64), np.array([symbols[x] for x in rights], np.int64))
            gone = self._skipped(np.full(len(lefts), key, K.U), np.array(lefts), np.array(rights), np.array([ends[x] for x in rights])) if self.drops else found < 0
            for x, y, f, g in zip(lefts, rights, found.tolist(), gone.tolist(), strict=True):
                if f >= 0 and not g:
                    heapq.heappush(heap, (int(self.m["ranks"][f]), x, y, symbols[x], symbols[y], int(self.m["merged"][f])))

        offer(list(range(n - 1)))
        while heap:
            _, x, y, a, b, new = heapq.heappop(heap)
            if symbols[x] != a or symbols[y] != b or after[x] != y:
                continue
            symbols[x], ends[x], symbols[y] = new, ends[y], -2
            after[x] = after[y]
            if after[y] >= 0:
                before[after[y]] = x
            offer([before[x], x])
        out, x = [], 0
        while x >= 0:
            out.append(symbols[x])
            x = after[x]
        return out

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, drops: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The pieces of segments laid end to end, their number in each, and with dropout all candidates: segment, start, middle, end."""
        seg, start = K.runs(sizes)
        seen: list[tuple] = []
        done_seg, done_start, done_sym = [], [], []
        end = start + 1
        sym = symbols

        def rank(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at elements i: rank and place in one number, and the piece they make."""
            out, made = np.full(len(i), NO_RANK, np.int64), np.zeros(len(i), np.int64)
            ok = i + 1 < len(sym)
            ok[ok] = seg[i[ok]] == seg[i[ok] + 1]
            i2 = i[ok]
            found = self._find(sym[i2], sym[i2 + 1])
            good = found >= 0
            if self.drops:
                g = i2[good]
                seen.append((seg[g], start[g], start[g + 1], end[g + 1]))
            if drops:
                good[good] = ~self._skipped(keys[seg[g]], start[g], start[g + 1], end[g + 1])
            at, found = np.flatnonzero(ok)[good], found[good]
            out[at] = (self.m["ranks"][found] << 20) + start[i2[good]]
            made[at] = self.m["merged"][found]
            return out, made

        ranks, into = rank(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(ranks, first)
            open_ = best < NO_RANK
            per = np.diff(np.append(first, len(sym)))
            keep = np.repeat(open_, per)
            if not open_.all():
                shut = np.flatnonzero(~keep)
                done_seg.append(seg[shut])
                done_start.append(start[shut])
                done_sym.append(sym[shut])
                if len(shut) == len(sym):
                    break
            at = np.flatnonzero(ranks == np.repeat(np.where(open_, best, -1), per))  # one in each open segment, as a place occurs once
            sym[at] = into[at]
            end[at] = end[at + 1]
            keep[at + 1] = False
            left = np.flatnonzero(keep)  # closed segments and merged elements go in one step
            moved = np.searchsorted(left, at)
            sym, seg, start, end, ranks, into = (x.take(left) for x in (sym, seg, start, end, ranks, into))
            touched = np.zeros(len(sym), bool)
            touched[moved] = touched[np.maximum(moved - 1, 0)] = True
            changed = np.flatnonzero(touched)
            ranks[changed], into[changed] = rank(changed)
        seg, start, sym = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_seg, done_start, done_sym))
        order = np.lexsort((start, seg))
        return sym[order], np.bincount(seg, minlength=len(sizes)), tuple(np.concatenate(x) for x in zip(*seen, strict=True)) if seen else ()

    def _cut(self, sym: np.ndarray, first: np.ndarray, sizes: np.ndarray, keys: np.ndarray, drops: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """The pieces of segments that begin at ``first``, where those of each start, their number, and the candidates of short ones."""
        long_ = sizes > LONG
        short = np.where(long_, 0, sizes)
        group, place = K.runs(short)
        ids, counts, seen = self._merge(sym[first[group] + place], short, keys, drops)
        starts = np.cumsum(counts) - counts
        if long_.any() and (drops or not self.drops):
            more = {k: np.array(self._long(sym[first[k] : first[k] + sizes[k]].tolist(), keys[k]), np.int64) for k in np.flatnonzero(long_).tolist()}
            at = len(ids)
            for k, v in more.items():
                starts[k], counts[k] = at, len(v)
                at += len(v)
            ids = np.concatenate([ids, *more.values()])
        return ids, starts, counts, seen

    def _dropped(self, sym: np.ndarray, first: np.ndarray, sizes: np.ndarray, content: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of some segments, and where those of each segment start and their number.

        At first equal segments are merged once, without dropout. Those of them
        that skip some candidate are merged once for each set of skipped ones,
        by the key of one; those that differ from it later on, by their own.
        """
        todo, sign = np.arange(len(first)), content
        pool, starts, counts, at = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), 0
        for turn in range(3):
            if not len(todo):
                break
            if turn < 2:
                _, one, inverse = np.unique(sign, return_index=True, return_inverse=True)
            else:
                one = inverse = np.arange(len(todo))
            chosen = todo[one]
            ids, s, c, seen = self._cut(sym, first[chosen], sizes[chosen], key[chosen], turn > 0)
            pool.append(ids)
            starts[todo], counts[todo] = s[inverse] + at, c[inverse]
            at += len(ids)
            if turn == 2:
                break
            other, mark = np.zeros(len(todo), bool), np.zeros(len(todo), K.U)
            if seen:
                order = np.argsort(seen[0], kind="stable")
                of, begin, middle, end = (x[order] for x in seen)
                per = np.bincount(of, minlength=len(chosen))
                expected = self._skipped(key[chosen][of], begin, middle, end) if turn else np.zeros(len(of), bool)
                group, place = K.runs(per[inverse])
                x = (np.cumsum(per) - per)[inverse][group] + place
                skipped = self._skipped(key[todo][group], begin.take(x), middle.take(x), end.take(x))
                other[group[skipped != expected.take(x)]] = True
                some = np.flatnonzero(skipped)
                of_some = x[some]
                with np.errstate(over="ignore"):
                    np.add.at(mark, group[some], K.mix((begin[of_some] << 40 | middle[of_some] << 20 | end[of_some]).astype(K.U)))
            is_long = sizes[todo] > LONG
            if turn == 0:
                other |= is_long
            with np.errstate(over="ignore"):
                sign = np.where(is_long, key[todo], content[todo] + K.mix(mark))[other]
            todo = todo[other]
        return np.concatenate(pool), starts, counts

    def encode(self, texts: list[str], row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts laid end to end, and their number in each. An empty text has none."""
        joined = "".join(" " + t if t else "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not len(points):
            return np.zeros(0, np.int64), lengths
        sym = self.char[points].astype(np.int64)
        sym[sym < 0] = -1 - points[sym < 0].astype(np.int64)  # unknown characters, to be written as bytes
        space = sym == self.m["space"]
        cut = np.zeros(len(sym), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (sym[1:] < 0) | (sym[:-1] < 0)
        offsets = np.cumsum(lengths) - lengths
        cut[offsets[lengths > 0]] = True
        first = np.flatnonzero(cut)
        sizes = np.diff(np.append(first, len(sym)))
        doc = np.searchsorted(offsets[lengths > 0], first, "right") - 1
        ordinal = np.arange(len(first)) - np.searchsorted(first, offsets[lengths > 0])[doc]
        with np.errstate(over="ignore"):
            up, down = K.powers(len(sym))
            prefix = np.zeros(len(sym) + 1, K.U)
            np.cumsum(K.mix((sym + (1 << 32)).astype(K.U)) * up[:-1], out=prefix[1:])
            content = K.mix((prefix[first + sizes] - prefix[first]) * down[first] + sizes.astype(K.U))
            key = content + K.U(self.seed) * K.BASE
            if self.drops:
                key += K.mix(row_keys[lengths > 0][doc] + ordinal.astype(K.U) + K.U(self.seed))
            key = K.mix(key)
        if self.drops:
            ids, starts, per = self._dropped(sym, first, sizes, content, key)
        else:
            _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
            ids, starts, counts, _ = self._cut(sym, first[one], sizes[one], key[one], False)
            starts, per = starts[inverse], counts[inverse]
        group, place = K.runs(per)
        out = ids[starts[group] + place]
        sizes_of = np.zeros(len(texts), np.int64)
        if (out < 0).any():
            out, per = self._as_bytes(out, per)
        np.add.at(sizes_of, np.flatnonzero(lengths > 0)[doc], per)
        return out, sizes_of

    def _as_bytes(self, ids: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with each unknown character replaced by the ids of its UTF-8 bytes."""
        odd = np.flatnonzero(ids < 0)
        spelled = [chr(-1 - int(x)).encode() for x in ids[odd]]
        width = np.ones(len(ids), np.int64)
        width[odd] = [len(s) for s in spelled]
        out = np.repeat(ids, width)
        out[np.repeat(ids < 0, width)] = self.m["first_byte"] + np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
        group = np.repeat(np.arange(len(per)), per)
        return out, np.bincount(group, width, len(per)).astype(np.int64)


def decode(ids, model: dict) -> str:
    """The text that was encoded."""
    return b"".join([model["bytes"][k] for k in ids])[1:].decode()


def decode_table(encoded: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``text`` in place of the column ``ids`` (arrays of pieces); other columns are kept, one named ``text`` is replaced.

    No pieces, or a null, give the empty text. Pieces that the vocabulary
    lacks are an error, as are pieces that spell no UTF-8. Works on a slice of
    a batch at a time, so memory is that of a slice's texts.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary
    kept = [f for f in encoded.schema.fields if f.name not in (ids, "text")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array([*shared.value["bytes"], None], object)[:-1]
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED):
                piece = batch.slice(at, DECODED)
                lists = piece.column(ids)
                codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(codes) and not 0 <= codes.min() <= codes.max() < len(table):
                    raise ValueError("pieces that are not in the vocabulary")
                spelled = table[codes]
                ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                texts = [b"".join(spelled[a:b])[1:].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[piece.column(f.name) for f in kept], pa.array(texts, pa.string())], [*[f.name for f in kept], "text"])

    return bounded(encoded).mapInArrow(apply, StructType([*kept, StructField("text", StringType())]))


def row_key(seed: int, key: object) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "big")


def encode(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (the pieces) and ``lossless`` (whether they decode to the text again).

    A null or empty text has no pieces. Rows with equal ``key`` columns and
    text get equal pieces. Characters that the vocabulary lacks, and the
    character that it writes spaces with, are spelled in bytes. Columns named
    like the added ones are replaced, others kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary
    docs = docs.drop("ids", "lossless")
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder = Encoder(model, dropout, seed)
        table = model["bytes"]
        for piece in K.slices(batches, "text"):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            own = zip(*[piece.column(c).to_pylist() for c in key], strict=True)
            ids, counts = encoder.encode(texts, np.array([row_key(seed, k) for k in own], K.U))
            ends = np.append(0, np.cumsum(counts))
            spelled = [table[k] for k in ids.tolist()]
            good = [b"".join(spelled[a:b])[1:] == t.encode() for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = [piece.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(good)], [*[f.name for f in kept], "ids", "lossless"])

    return bounded(docs).mapInArrow(apply, StructType([*kept, StructField("ids", ArrayType(IntegerType())), StructField("lossless", BooleanType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "lossless")
