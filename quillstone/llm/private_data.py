"""Personal data: patterns, and terms that disclose what the patterns protect.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
Each value found is a protected entity. Words that stand near an entity again
and again, and seldom elsewhere, tell who is meant even when the value itself
is gone. All probabilities are shares of the corpus's documents: those that
hold the entity, those that hold the term, and those in which the term stands
near the entity. From these come the entity's information content
``-log2 p(entity)``, the pointwise mutual information of both, and what the
term leaves unknown, ``-log2 p(entity | term)``, their difference. A term
discloses an entity where it leaves at most ``RESIDUAL`` bits unknown and
tells at least the share ``DISCLOSURE`` of the content, in at least
``SUPPORT`` different contexts. None of these bars moves with the size of the
corpus. Disclosing terms are marked wherever they stand in a document that
holds the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillstone.llm import kernels as K
from quillstone.llm.storage import KEY, bounded, row_key, stash

NAME = "op7_private_data"
ORACLE = None
KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity, across line ends, that count as its context.
WINDOW = 8
#: The bits that a disclosing term leaves unknown of an entity at most, the least share of the entity's information
#: content that it tells, and the least number of different contexts.
RESIDUAL, DISCLOSURE, SUPPORT = 1.0, 0.5, 3
#: Letters of a term at least.
TERM_LETTERS = 3
#: Bits of the table of wanted terms that spares the corpus count most other words: 128 KB, whatever the corpus.
FILTER_BITS = 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number that fails at its first digit fails at its others, so only the first is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches in order of start, then kind, in code points."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def _entity(text: str, a: int, kind: int, b: int) -> int:
    value = text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b])
    return _key(f"{kind}:{value}")


def terms(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and keys of the text's words of letters, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends, keys, _ = K.letter_words(points, np.array([0, len(points)]))
    long_ = ends - starts >= TERM_LETTERS
    return starts[long_], ends[long_], keys[long_].astype(np.int64)


def outside(starts: np.ndarray, ends: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words do not overlap any of the base matches."""
    free = np.ones(len(starts), bool)
    for a, _, b in found:
        free[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = False
    return free


def contexts(text: str, found: list[tuple[int, int, int]]) -> list[dict]:
    """The words near each entity, WINDOW on either side: its key, the word's key, and the key of the context's words."""
    out = []
    starts, ends, keys = terms(text)
    free = outside(starts, ends, found)
    starts, ends, keys = starts[free], ends[free], keys[free]
    for a, kind, b in found:
        before, after = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        near = np.concatenate([keys[max(0, before - WINDOW) : before], keys[after : after + WINDOW]])
        context = int.from_bytes(xxhash.xxh3_64_digest(near.tobytes()), "big", signed=True)
        entity = _entity(text, a, kind, b)
        out += [{"entity": entity, "term": k, "context": context} for k in near.tolist()]
    return out


_OCCURRENCE = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64())])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
FOUND = (
    f"doc_id bigint, tk {KEY}, n_chars bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
    "base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:bigint,term:bigint,context:bigint>>, "
    "entities array<bigint>, held string"  # the text only of rows with an entity
)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in K.slices(batches, "text"):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        found = [spans(t) for t in texts]
        counts = [Counter(k for _, k, _ in f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"), piece.column("tk"), pa.array([len(t) for t in texts], pa.int64()),
                *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)],
                pa.array([hashlib.sha256(written(f).encode()).hexdigest() for f in found]),
                pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in f] for f in found], _SPANS),
                pa.array([contexts(t, f) if f else [] for t, f in zip(texts, found, strict=True)], pa.list_(_OCCURRENCE)),
                pa.array([sorted({_entity(t, *s) for s in f}) for t, f in zip(texts, found, strict=True)], pa.list_(pa.int64())),
                pa.array([t if f else None for t, f in zip(texts, found, strict=True)], pa.string()),
            ],
            ["doc_id", "tk", "n_chars", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near", "entities", "held"],
        )


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each row's terms in its whole text, but for those inside base matches."""
    for piece in K.slices(batches, "held"):
        out = []
        for text, base, wanted in zip(piece.column("held").to_pylist(), piece.column("base").to_pylist(), piece.column("terms").to_pylist(), strict=True):
            starts, ends, keys = terms(text)
            here = np.isin(keys, np.array(wanted, np.int64)) & outside(starts, ends, [(s["start"], s["kind"], s["end"]) for s in base])
            out.append([{"start": a, "kind": len(KINDS) - 1, "end": b} for a, b in zip(starts[here].tolist(), ends[here].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([piece.column("row_no"), pa.array(out, _SPANS)], ["row_no", "extra"])


def _counter(wanted: bytes):
    """A function that counts, for each slice of texts, the rows that hold each word whose key may be wanted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
        mask = K.U((1 << FILTER_BITS) - 1)
        for piece in K.slices(batches, "text"):
            points, offsets = K.code_points(piece.column("text"))
            starts, ends, keys, rows = K.letter_words(points, offsets)
            own = np.flatnonzero(bits[(keys & mask).astype(np.int64)] & (ends - starts >= TERM_LETTERS))
            keys, row = keys[own], (np.searchsorted(rows, own, "right") - 1)
            order = np.lexsort((row, keys))
            keys, row = keys[order], row[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
            found, n = np.unique(keys[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

    return count


def telling_terms(rows: DataFrame, docs: DataFrame, residual: float = RESIDUAL, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term, n_docs, n_entity, n_term, n_both, contexts, content, shared) of the terms that disclose an entity.

    The counts are of documents: all, those with the entity, those with the
    term anywhere, and those with the term near the entity. ``content`` is the
    entity's information content in bits, ``shared`` the pointwise mutual
    information, which never exceeds it.
    """
    near = rows.filter(F.size("near") > 0).select("row_no", F.explode("near").alias("o")).select("row_no", "o.*")
    different = near.groupBy("entity", "term", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
    both = near.select("row_no", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = stash(different.join(both, ["entity", "term"]), "term-pairs")
    slots = pairs.select(F.col("term").bitwiseAND((1 << FILTER_BITS) - 1).alias("slot")).distinct().toArrow().column("slot").to_numpy()  # 2**FILTER_BITS at most
    table = np.zeros(1 << FILTER_BITS, np.uint8)
    table[slots] = 1
    counted = bounded(docs.select("text")).mapInArrow(_counter(np.packbits(table).tobytes()), "term bigint, n bigint")
    n_term = counted.groupBy("term").agg(F.sum("n").alias("n_term"))
    n_entity = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_docs = float(rows.count())
    joined = pairs.join(n_entity, "entity").join(n_term, "term").withColumn("n_docs", F.lit(n_docs))
    content = -F.log2(F.col("n_entity") / F.col("n_docs"))
    shared = F.log2(F.col("n_both") * F.col("n_docs") / (F.col("n_entity") * F.col("n_term")))
    told = joined.withColumn("content", content).withColumn("shared", shared)
    # n_both / n_term is the probability of the entity where the term is; content - shared its surprisal
    return told.filter((F.col("n_both") >= F.col("n_term") * F.lit(2.0**-residual)) & (F.col("shared") >= disclosure * F.col("content")) & (F.col("content") > 0))


def find(docs: DataFrame, residual: float = RESIDUAL, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(rows, extra) of ``docs`` (doc_id, text; other columns are ignored).

    rows: row_no and the columns of ``FOUND`` for each row; extra: row_no, tk
    (the hash of the text) and the spans (start, kind, end) of disclosing
    terms, for rows that have any. A null text is the empty text and has none;
    repeated rows stay apart by row_no, and count as one context.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked = docs.withColumn("tk", row_key("text"))
    rows = stash(bounded(marked).mapInArrow(_find, FOUND).withColumn("row_no", F.monotonically_increasing_id()), "private")
    telling = telling_terms(rows, docs, residual, disclosure, support).select("entity", "term")
    holders = rows.select("row_no", F.explode("entities").alias("entity"))
    own = holders.join(telling, "entity").groupBy("row_no").agg(F.collect_set("term").alias("terms"))
    extra = bounded(rows.select("row_no", "base", "held").join(own, "row_no")).mapInArrow(_mark, "row_no bigint, extra array<struct<start:int,kind:int,end:int>>")
    return rows, extra.filter(F.size("extra") > 0)


def private_spans(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, their digest, and all spans."""
    rows, extra = find(docs)
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    return rows.join(extra, "row_no", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with each span generalised to its kind; of spans that overlap, all are covered by the first's."""
    out, end = [], 0
    for a, k, b in sorted(found):
        if a < end:
            end = max(end, b)
            continue
        out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms generalised in ``text``; ``n_chars`` is that of the new text.

    Other columns are kept; a null text stays null.
    """
    rows, extra = find(docs)
    # a text's terms depend on the text alone, so they are found again by its hash, one row for each text
    own = rows.join(extra, "row_no").select(F.col("tk").alias("_tk"), F.col("extra").alias("_extra")).dropDuplicates(["_tk"])
    joined = docs.join(own, row_key("text") == F.col("_tk"), "left").drop("_tk")
    kinds = StructType([StructField(f.name, f.dataType) for f in docs.schema.fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.slices(batches, "text"):
            new = []
            for t, more in zip(piece.column("text").to_pylist(), piece.column("_extra").to_pylist(), strict=True):
                if t:
                    f = spans(t) + [(s["start"], s["kind"], s["end"]) for s in more or ()]
                    t = redacted(t, f) if f else t
                new.append(t)
            columns = {n: piece.column(n) for n in piece.schema.names if n != "_extra"}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return bounded(joined).mapInArrow(apply, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
