"""Language identification by words first, backing off to character n-grams.

A word that the labelled sample has seen scores by its logarithmic frequency
in each language. An unseen word scores by its longest character n-grams that
the sample has seen: those of five characters, else of four, and so on, at a
penalty for every step. A document's language is that with the largest sum.

Words and n-grams go by 64-bit keys of their lower-case letters, so that the
distinct words of a slice are looked up together, in sorted tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillstone.llm import kernels as K
from quillstone.llm.storage import bounded, stash

NAME = "op10_language_id"
ORACLE = None
#: The model is fitted on at most so many labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 3000
#: Words and n-grams seen less often in the sample are left to shorter n-grams.
LEAST_COUNT = 2
LONGEST = 5
SMOOTHING, PENALTY = 0.5, 1.0
#: Scored words that a task remembers before it starts over.
MEMORY = 200_000
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(3)) == 1


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one size of words at the given places: the word of each, and its key."""
    per = np.maximum(ends - starts - size + 1, 0)
    word, nth = K.runs(per)
    at = starts[word] + nth
    return word, K.gram_keys(points, at, at + size)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, gram, lang, n): words as size 0, n-grams of their characters as sizes 1 to LONGEST."""
    lower = K.letters()[1]
    for piece in K.slices(batches, "text"):
        points, offsets = K.code_points(piece.column("text"))
        starts, ends, keys, rows = K.letter_words(points, offsets)
        if not len(keys):
            continue
        names, code = np.unique(np.array(piece.column("lang").to_pylist(), object), return_inverse=True)
        lang = np.repeat(code, np.diff(rows))
        points = lower[points]
        for size in range(LONGEST + 1):
            word, found = (np.arange(len(keys)), keys) if size == 0 else grams(points, starts, ends, size)
            own = lang[word]
            for k, name in enumerate(names):
                gram, n = np.unique(found[own == k], return_counts=True)
                if len(gram):
                    columns = [pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.astype(np.int64)), pa.array([name] * len(gram)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["size", "gram", "lang", "n"])


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, lang) of at most ``rows`` labelled rows: those with the smallest hashes of id, then of text and language.

    Equal rows count once. Only hashes are sorted, never texts.
    """
    label = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    own = F.struct(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(10)).alias("o"), F.xxhash64("text", "lang").alias("t"))
    label = label.select("text", "lang", own.alias("own"))
    # every distinct row up to the last of the first ``rows`` is among these, so no more than so many are left
    last = label.select("own").orderBy("own").limit(rows).agg(F.max("own").alias("own")).first()[0]
    if last is None:
        return label.limit(0).select("text", "lang")
    bound = F.struct(F.lit(last["o"]).alias("o"), F.lit(last["t"]).alias("t"))
    return label.filter(F.col("own") <= bound).dropDuplicates(["own"]).select("text", "lang")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """The model: languages, and for each size (0: words) the sorted keys of known grams with a row of log frequencies each.

    Learns from text and lang of the rows that are not held out and have
    both. Its size is bounded by that of the sample (``rows`` texts at most),
    whatever the number of rows, ties or repeated ids of ``docs``.
    """
    counts = bounded(sample(docs, rows)).mapInArrow(_count, "size int, gram bigint, lang string, n bigint")
    per = stash(counts.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = per.groupBy("size", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("all"))  # an entry for each language
    kept = totals.filter((F.col("all") >= LEAST_COUNT) | (F.col("size") == 1)).select("size", "gram", F.explode("by").alias("b")).select("size", "gram", "b.lang", "b.n").toArrow()
    mass = {(r["size"], r["lang"]): r["n"] for r in per.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    return model_of(
        sorted({lang for _, lang in mass}), mass, kept.column("size").to_numpy(), kept.column("gram").to_numpy().astype(K.U), kept.column("lang").to_pylist(), kept.column("n").to_numpy()
    )


def model_of(langs: list[str], mass: dict, sizes: np.ndarray, keys: np.ndarray, lang: list[str], n: np.ndarray) -> dict:
    at = {name: k for k, name in enumerate(langs)}
    code = np.array([at[x] for x in lang], np.int64)
    tables = []
    for size in range(LONGEST + 1) if langs else ():
        own = sizes == size
        known, place = np.unique(keys[own], return_inverse=True)
        counted = np.zeros((len(known), len(langs)))
        np.add.at(counted, (place, code[own]), n[own])
        total = np.array([mass.get((size, name), 0) for name in langs], float)
        logs = np.log((counted + SMOOTHING) / (total + SMOOTHING * (len(known) + 1)))
        if len(known):
            logs -= logs.mean(axis=1, keepdims=True)
        tables.append((known, logs.astype(np.float32)))
    return {"langs": langs, "tables": tables}


def look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``known`` has each key, and whether it has it."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return place, known[place] == keys


class Scorer:
    """Scores of words under a model, remembered up to MEMORY words at a time."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        if self.langs:
            self.words, self.rows = model["tables"][0]
            self.grams = model["tables"][1:]
            self.seen, self.scores = self.words, self.rows

    def unseen(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row for each word at the given places of lower-case ``points``, by its longest known n-grams."""
        out = np.zeros((len(starts), len(self.langs)), np.float32)
        todo = np.arange(len(starts))
        for size in range(LONGEST, 0, -1):
            known, logs = self.grams[size - 1]
            word, keys = grams(points, starts[todo], ends[todo], size)
            place, found = look_up(keys, known)
            word, place = word[found], place[found]
            hits, n = np.unique(word, return_counts=True)
            if len(hits):
                sums = np.add.reduceat(logs[place].astype(np.float64), np.cumsum(n) - n, axis=0)
                out[todo[hits]] = sums / (n * (1 + PENALTY * (LONGEST - size)))[:, None]
                todo = np.delete(todo, hits)
            if not len(todo):
                break
        return out

    def batch(self, column: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
        if not self.langs:
            return langs, scores
        if len(self.seen) - len(self.words) > MEMORY:
            self.seen, self.scores = self.words, self.rows
        points, offsets = K.code_points(column)
        starts, ends, keys, rows = K.letter_words(points, offsets)
        some = np.flatnonzero(np.diff(rows))
        if not len(some):
            return langs, scores
        own, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
        _, found = look_up(own, self.seen)
        new = one[~found]
        if len(new):
            size = ends[new] - starts[new]
            word, nth = K.runs(size)
            text = K.letters()[1][points[starts[new][word] + nth]]  # the new words laid end to end
            first = np.cumsum(size) - size
            made = self.unseen(text, first, first + size)
            at = np.searchsorted(self.seen, own[~found])
            self.seen, self.scores = np.insert(self.seen, at, own[~found]), np.insert(self.scores, at, made, axis=0)
        table = self.scores[look_up(own, self.seen)[0]].astype(np.float64)
        sums = np.add.reduceat(table[inverse], rows[some], axis=0)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        for k, best, p in zip(some.tolist(), odds.argmax(axis=1).tolist(), odds.max(axis=1).tolist(), strict=True):
            langs[k], scores[k] = self.langs[best], p
        return langs, scores


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced, others kept.

    A null text, one without a letter, and any text under a model that has
    learned no language is ``und`` with score 0. Ties go to the language that
    sorts first. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    docs = docs.drop("lang_pred", "score")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for piece in K.slices(batches, "text"):
            langs, scores = scorer.batch(piece.column("text"))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(langs), pa.array(scores, pa.float64())], [*piece.schema.names, "lang_pred", "score"])

    return bounded(docs).mapInArrow(apply, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
