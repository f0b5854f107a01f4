"""Corpora as one JSON document, read and written by many tasks.

The document is ``{"metadata": {...}, "records": [{...}, ...]}``, on one line
or many. To read it, the text is cut at every closing brace, in ranges of
bytes. What a piece means depends on what went before it only through two
things: whether it begins inside a string, and how deep. Both are sums over
the pieces before (of unescaped quotes, and of brackets outside strings), found
from sums over ranges and a window within each range. A closing brace that
leads back to the list of records ends a record.

To write it, records are sorted by ranges of their number and written as parts,
each a piece of the document, which a last step joins in order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import tokens as T
from quillstone.sources.shared import shared_dir, stored

RECORD = "folio STRING, section STRING, line STRING, transcriber STRING, raw_line STRING, tokens ARRAY<STRING>"
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
END = "}"
#: Depth of what stands in the list of records.
WITHIN = 2


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _running(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the pieces of the file before this one."""
    own = Window.partitionBy("file", "_range")
    sums = df.groupBy("file", "_range").agg(F.sum(value).alias("_sum"))  # a row for each range
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(own.orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(sums.select("file", "_range", before.alias("_before")), ["file", "_range"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, _range, _id, piece, depth, after, least): the text up to each closing brace, and how deep it begins and ends, and is at least."""
    rows = spark.read.option("lineSep", END).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("piece"))
    # written, so that ids and sums are of one reading
    rows = stored(rows.withColumn("_quotes", _count(_removed(F.col("piece"), r'\\(?s:.)'), '"')), "pieces")
    started = _running(rows, "_quotes", "_open").withColumn("_within", F.col("_open") % 2 == 1)
    # what is outside of strings; a string that is open at the end takes the closing brace with it
    text = F.when(F.col("_within"), F.concat(F.lit('"'), "piece")).otherwise(F.col("piece"))
    bare = _removed(_removed(text, r'"(?:[^"\\]|\\(?s:.))*+"'), r'(?s)".*\z')
    ended = (F.col("_open") + F.col("_quotes")) % 2 == 0
    opened, closed = _count(F.col("_bare"), "{["), _count(F.col("_bare"), "}]")
    stepped = started.withColumn("_bare", bare).withColumn("_ends", ended).withColumn("_step", opened - closed - F.col("_ends").cast("int"))
    return _running(stepped, "_step", "depth").withColumn("after", F.col("depth") + F.col("_step"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The records of corpus documents: line_ord (their place in the document), the canonical columns.

    Metadata may stand before or after the records, and holds no objects. A
    document without a list of records, and a record that is none, is an
    error. A document is cut at closing braces, so one of any size is read by
    as many tasks as it has ranges; a record has to fit into memory.
    """
    cut = stored(pieces(spark, path), "pieces")
    begins = F.col("depth").between(0, 1) & F.col("_bare").rlike(r"\[")
    # the list of records is the only one at the document's own level: strings are taken out, so its name is looked for in the text
    named = F.regexp_instr("piece", F.lit(r'"records"\s*:\s*\['))
    opens = cut.filter((F.col("depth") <= 1) & begins & (named > 0)).groupBy("file").agg(F.min(F.struct("_range", "_id")).alias("_start"))
    files = cut.select("file").distinct()
    lost = files.join(opens, "file", "left_anti").first()
    if lost:
        raise ValueError(f"{lost['file']} has no list of records")
    here = cut.join(F.broadcast(opens), "file").filter(F.struct("_range", "_id") >= F.col("_start"))  # a row for each file
    first = F.struct("_range", "_id") == F.col("_start")
    text = F.when(first, F.regexp_replace("piece", r'(?s)\A.*?"records"\s*:\s*\[', "")).otherwise(F.col("piece"))
    # a record's pieces share the number of records that ended before them
    done = here.withColumn("_done", (F.col("_ends") & (F.col("after") == WITHIN)).cast("bigint"))
    numbered = _running(done.withColumn("_text", text), "_done", "number")
    grouped = numbered.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("_range", "_id", "_text"))).alias("_parts"), F.max("_done").alias("_whole")).filter("_whole = 1")
    # written, as what follows the last record is none, and must not be parsed wherever filters are moved to
    whole = stored(grouped, "records")
    joined = F.concat(F.array_join(F.transform("_parts", lambda p: p._text), END), F.lit(END))
    record = F.from_json(F.regexp_replace(joined, r"\A[\s,]+", ""), RECORD, {"mode": "FAILFAST"})
    rows = whole.select(F.col("number").alias("line_ord"), record.alias("r")).select("line_ord", "r.*")
    return rows.withColumn("has_uncertainty", T.line_has_uncertainty(F.col("tokens")))


def write_corpus(lines: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A corpus as one JSON document at ``path``, a place that Spark's file systems know.

    Records are sorted by ``line_ord`` in ranges and written by the tasks that
    hold them. Their files are then joined in order by copying bytes, of which
    the driver holds a buffer's worth; no record is read again.
    """
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_dir(spark)}/quillstone/document-{uuid.uuid4().hex}"
    record = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    rows = lines.repartitionByRange(parts, "line_ord").sortWithinPartitions("line_ord").select(F.concat(F.lit(","), record).alias("value"))
    rows.write.text(folder)
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    system, shared = target.getFileSystem(conf), hadoop.fs.Path(folder).getFileSystem(conf)
    found = sorted(str(s.getPath()) for s in shared.globStatus(hadoop.fs.Path(folder + "/part-*")) if s.getLen())
    if target.getParent():
        system.mkdirs(target.getParent())
    out = system.create(target, True)
    head = '{"metadata": ' + json.dumps(metadata, ensure_ascii=False) + ', "records": ['
    out.write(bytearray(head.encode()))
    for k, name in enumerate(found):
        part = shared.open(hadoop.fs.Path(name))
        part.seek(1 if k == 0 else 0)  # no comma before the first record
        hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
    out.write(bytearray(b"]}\n"))
    out.close()
    shared.delete(hadoop.fs.Path(folder), True)
