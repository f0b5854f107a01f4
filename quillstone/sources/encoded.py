"""Corpora whose tokens are numbers.

Lines are split once. Each token gets a code of 64 bits: a hash, of which it is
checked that no two tokens of the corpus share one (else the next seed is
taken), and a bit that says whether the token has a bar in it. Codes need no
join to make, are the same for equal tokens with and without braces, and are
what operators group, join and count by; the dictionary gives names back to the
rows that a result shows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.sources import lines as L
from quillstone.sources.shared import stored

#: A token with this in it can be taken for two that are joined by it.
BAR = "|"
SEEDS = 8


def code_of(token: Column, seed: int = 0) -> Column:
    return F.shiftleft(F.xxhash64(F.lit(seed), token), 1) + F.when(F.contains(token, F.lit(BAR)), 1).otherwise(0)


def has_bar(code: Column) -> Column:
    return code.bitwiseAND(F.lit(1)) == 1


@dataclass(frozen=True)
class Corpus:
    """A corpus that has been built; see ``build``."""

    #: line_ord, line_start, folio, section, tokens, codes, clean_codes, has_uncertainty.
    text: DataFrame
    #: (token, n, first, code) of tokens as they stand, and without braces.
    words: DataFrame
    clean_words: DataFrame
    seed: int

    def lines(self, clean: bool = False) -> DataFrame:
        """The lines with codes for tokens."""
        kept = [c for c in self.text.columns if c not in ("tokens", "codes", "clean_codes")]
        return self.text.select(*kept, F.col("clean_codes" if clean else "codes").alias("tokens"))

    def rows(self, clean: bool = False) -> DataFrame:
        return L.token_rows(self.lines(clean))

    def vocabulary(self, clean: bool = False) -> DataFrame:
        return self.clean_words if clean else self.words

    def named(self, df: DataFrame, *columns: str, clean: bool = False) -> DataFrame:
        """``df`` with tokens in place of the codes in ``columns``."""
        own = self.vocabulary(clean)
        out = df
        for k, c in enumerate(columns):
            out = out.join(own.select(F.col("code").alias(c), F.col("token").alias(f"_name{k}")), c)
        names = {c: f"_name{k}" for k, c in enumerate(columns)}
        return out.select(*(F.col(names[c]).alias(c) if c in names else F.col(c) for c in df.columns))


def build(lines: DataFrame) -> Corpus:
    """The corpus of ``lines``: canonical columns, with line_ord, or with doc_id and n, from which it is made.

    Lines are written once to the shared folder, with their tokens and codes,
    and so are the dictionaries. First places are whole numbers where the
    numbers of lines and the length of the longest leave room for that; else
    they are decimals, as for lines that are not built.
    """
    for seed in range(SEEDS):
        own = F.transform("tokens", lambda t: code_of(t, seed))  # noqa: B023
        clean = F.transform(T.clean_tokens(F.col("tokens")), lambda t: code_of(t, seed))  # noqa: B023
        key = ("doc_id", "n") if "doc_id" in lines.columns else ("line_ord",)
        coded = lines.select(*key, "folio", "section", "tokens", "has_uncertainty", own.alias("codes"))
        # written only where they differ, and read as the codes elsewhere
        text = stored(coded.withColumn("clean_codes", F.when(F.col("has_uncertainty"), clean)), "corpus-lines").withColumn("clean_codes", F.coalesce("clean_codes", "codes"))
        if "doc_id" in text.columns:
            most, high, low, size = text.agg(F.max("n") + 1, F.max("doc_id"), F.min("doc_id"), F.max(F.size("codes"))).first()
            stride = L.stride_for(most)
            text = text.withColumn("line_ord", L.line_number(stride)).drop("doc_id", "n")
            high, low = ((x or 0) * stride for x in (high, low))
            high += stride
        else:
            high, low, size = text.agg(F.max("line_ord"), F.min("line_ord"), F.max(F.size("codes"))).first()
        room = (size or 1).bit_length()
        if (max(abs(high or 0), abs(low or 0)) + 1) << room < 1 << 63:
            text = text.withColumn("line_start", F.shiftleft("line_ord", room))
        rows = L.token_rows(text)
        words = stored(L.vocabulary(rows).withColumn("code", code_of(F.col("token"), seed)), "corpus-words")
        bare = words.groupBy(T.strip_uncertainty(F.col("token")).alias("token")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        clean_words = stored(bare.withColumn("code", code_of(F.col("token"), seed)), "corpus-clean-words")
        # tokens without braces are in both; all tokens of one code are dealt out together, once
        other = words.filter(F.col("token").rlike("[{}]")).select(T.strip_uncertainty(F.col("token")).alias("token")).distinct()
        names = words.select("code", "token").union(other.select(code_of(F.col("token"), seed), "token")).repartition("code").groupBy("code", "token").agg(F.count("*"))
        if names.groupBy("code").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            return Corpus(text, words, clean_words, seed)
    raise ValueError("no seed tells the corpus's tokens apart")


# -- corpora that are built once --------------------------------------------------------

_BUILT: dict[tuple, Corpus] = {}


def forget() -> None:
    """Lets every corpus that was built be built anew."""
    _BUILT.clear()


def fingerprint(source: DataFrame) -> tuple:
    """Numbers that change with the names, sizes or times of the files behind ``source``."""
    m = "_metadata."
    files = source.select(F.xxhash64(m + "file_path", m + "file_size", m + "file_modification_time").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return tuple(files.agg(F.count("*"), F.sum("n"), F.sum(F.pmod(F.xxhash64("h", "n"), F.lit(1 << 40)))).first())


def of_documents(spark: SparkSession, path: str, marked: bool = False) -> Corpus:
    """The corpus of a Parquet table of documents; one that was built from the same files by this application is taken again."""
    docs = spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path, marked, *fingerprint(docs))
    if key not in _BUILT:
        _BUILT[key] = build(L.document_rows(docs, marked))
    return _BUILT[key]
