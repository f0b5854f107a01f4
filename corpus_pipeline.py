"""From raw documents to training pieces: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import language_id, mixing, near_dedup, pieces, private_data
from quillstone.llm.storage import row_key, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: No SQL expresses the stages; each is tested against a plain version.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; a missing ``lang`` becomes the recognised one."""
    found = language_id.identify(docs.select(*COLUMNS), language_id.fit(docs))
    sure = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates; of repeated rows, one.

    Rows are told apart by doc_id and text, so one stays also where ids are
    repeated or missing.
    """
    docs = docs.select(*COLUMNS).withColumn("_key", row_key("doc_id", "text"))
    kept = near_dedup.near_dedup(docs.select("doc_id", "text")).filter("chosen").select(F.col("rk").alias("_rk"))
    left = docs.join(kept, docs["_key"] == kept["_rk"], "left_semi")
    return left.dropDuplicates(["_key"]).drop("_key")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data, and the terms that disclose it, in every text."""
    return private_data.sanitise(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources approach their target weights, in random order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces: doc_id, lang, source, n_chars, ids, lossless.

    Equal rows are numbered, so that each copy draws its own dropout, and dealt
    out in random order again, as numbering brings them together.
    """
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")
    numbered = docs.select(*COLUMNS, F.row_number().over(same).alias("copy"))
    made = pieces.encode(numbered, key=("doc_id", "copy"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64(F.lit(mixing.SEED), "doc_id", "copy")
    dealt = made.withColumn("_order", order).repartitionById(parts, F.pmod("_order", F.lit(parts)).cast("int")).sortWithinPartitions("_order")
    return dealt.drop("copy", "_order")


STAGES = [
    ("language identification", languages),
    ("MinHash near-duplicates", near_duplicates),
    ("personal data", private),
    ("mixing sources", mixture),
    ("SentencePiece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, "stage-" + name.replace(" ", "-"))
    return docs
