"""Views of tables and files as ordered lines of tokens.

Canonical columns: line_ord, folio, section, line, transcriber, raw_line,
tokens, has_uncertainty. ``line_ord`` comes from the data's own keys, so the
order of lines does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import tokens as T

#: The numbers of a document's lines are this far from those of the next, or as far as the longest document needs (``stride_of``).
LINES_PER_DOCUMENT = 1_000_000
OPEN, CLOSE, AUTHOR = "<", ">", ";"


def tag_of(line: Column) -> tuple[Column, Column]:
    """(tag, body) of a line.

    A tag in angle brackets at the line's start names folio, section and line,
    parted by the first two points, and after a semicolon the transcriber, who
    may be left out; no other field is empty. The tag is null on a line that
    does not begin with one; the body is what follows it.
    """
    fields = F.split(F.substring(line, 2, 1 << 30), r"\.", 3)
    rest = F.get(fields, F.lit(2))
    last = F.substring_index(rest, CLOSE, 1)
    number = F.substring_index(last, AUTHOR, 1)
    author = F.nullif(F.substring(last, F.char_length(number) + 2, F.lit(1 << 30)), F.lit(""))
    found = line.startswith(OPEN) & (F.size(fields) == 3) & rest.contains(CLOSE) & (fields[0] != "") & (F.get(fields, F.lit(1)) != "") & (number != "")
    tag = F.struct(fields[0].alias("folio"), F.get(fields, F.lit(1)).alias("section"), number.alias("line"), F.coalesce(author, F.lit("unknown")).alias("transcriber"))
    return F.when(found, tag), F.when(found, F.substring(rest, F.char_length(last) + 2, F.lit(1 << 30))).otherwise(line)


def canonical(df: DataFrame, tokens: Column, doubtful: Column | None = None) -> DataFrame:
    """Adds tokens and their flag, which ``doubtful`` gives if it is told by the line itself; lines without a token are left out."""
    flag = T.line_has_uncertainty(F.col("tokens")) if doubtful is None else doubtful
    return df.withColumn("tokens", tokens).filter(F.size("tokens") > 0).withColumn("has_uncertainty", flag)


def stride_for(most: int | None) -> int:
    """How far the numbers of documents' lines lie apart where the longest has ``most`` lines: a power of ten."""
    return max(LINES_PER_DOCUMENT, 10 ** len(str(max((most or 1) - 1, 0))))


def stride_of(docs: DataFrame) -> int:
    """``stride_for`` the documents of a table."""
    return stride_for(docs.agg(F.max(F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1)).first()[0])


def document_rows(docs: DataFrame, marked: bool = False) -> DataFrame:
    """The lines of ``documents`` with doc_id and their number ``n``; with ``marked``, every seventh document's lines begin with a doubtful character."""
    rows = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("n", "raw_line"))
    if marked:
        doubt = F.concat(F.lit("{"), F.substring("raw_line", 1, 1), F.lit("}"), F.expr("substring(raw_line, 2)"))
        rows = rows.withColumn("raw_line", F.when((F.col("doc_id") % 7 == 0) & (F.col("raw_line") != ""), doubt).otherwise(F.col("raw_line")))
    rows = rows.select(
        "doc_id", "n", F.col("doc_id").cast("string").alias("folio"), F.col("lang").alias("section"), F.col("n").cast("string").alias("line"), F.col("source").alias("transcriber"), "raw_line",
    )
    return canonical(rows, T.plain_tokens(F.col("raw_line")), F.contains("raw_line", F.lit("{")) | F.contains("raw_line", F.lit("}")))


def line_number(stride: int) -> Column:
    """``line_ord`` of a document's line; a doc_id too large for it is an error, never a wrong number."""
    return (F.col("doc_id") * F.lit(stride) + F.col("n")).alias("line_ord")


def document_lines(docs: DataFrame, marked: bool = False) -> DataFrame:
    """``document_rows`` with ``line_ord``, in the order of documents and lines, however long documents are."""
    return document_rows(docs, marked).withColumn("line_ord", line_number(stride_of(docs))).drop("doc_id", "n")


def conversation_lines(turns: DataFrame) -> DataFrame:
    rows = turns.select(
        (F.col("conv_id") * stride_for(turns.agg(F.max("turn") + 1).first()[0]) + F.col("turn")).alias("line_ord"), F.col("conv_id").cast("string").alias("folio"), F.col("role").alias("section"),
        F.col("turn").cast("string").alias("line"), F.lit("unknown").alias("transcriber"), F.col("text").alias("raw_line"),
    )
    return canonical(rows, T.plain_tokens(F.col("raw_line")))


#: Lines of a file that one window looks back over.
STRETCH = 1 << 16


def with_last(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null among a line's file's lines (file, n) up to it.

    A file is looked at in stretches of lines; a table with a row for each
    stretch gives what went before it.
    """
    cut = rows.withColumn("_stretch", F.floor(F.col("n") / STRETCH))
    ends = cut.groupBy("file", "_stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("n"))).alias("_end"))
    earlier = Window.partitionBy("file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("file", "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("file", "_stretch").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    seen = cut.withColumn("_seen", F.last(value, ignorenulls=True).over(inside)).join(before, ["file", "_stretch"])
    return seen.withColumn(name, F.coalesce("_seen", "_before")).drop("_stretch", "_seen", "_before")


def parse_tagged(raw: DataFrame) -> DataFrame:
    """Tagged lines (file, n, raw) with inherited tags.

    Blank lines and comments are skipped. A line without a tag takes the last
    tag of its file, as a whole, even one that stood on a line without tokens;
    before the first tag the fields are unknown.
    """
    text = T.trimmed(F.col("raw"))
    rows = raw.select("file", "n", text.alias("raw_line")).filter((F.col("raw_line") != "") & ~F.col("raw_line").startswith("#"))
    own, body = tag_of(F.col("raw_line"))
    rows = with_last(rows.withColumn("own", own).withColumn("body", body), "own", "tag")
    field = lambda k, default: F.coalesce(F.col(f"tag.{k}"), F.lit(default)).alias(k)
    rows = rows.select(
        "file", "n", field("folio", "unknown"), field("section", "unknown"), field("line", "0"), field("transcriber", "unknown"), "raw_line", "body",
    )
    return canonical(rows, T.tokenise(F.col("body"))).drop("body")


def decoded(text: Column, is_utf8: Column) -> Column:
    """Bytes that were read as UTF-8: as they are, or else as Latin-1."""
    return F.when(is_utf8, text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, n, raw) of every line of the text files at ``path``, numbered from 0 in each file.

    Files are cut at byte ranges, and every range is read by a task of its
    own, which takes the lines that begin in it; CR, LF and CRLF end lines. A
    light first pass counts the lines of each range and looks whether a file
    is UTF-8 throughout; a file that is not is Latin-1. A line's number is its
    place in its range and the lines of the ranges before.
    """
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    # rows of a range follow each other in its task, so their ids do
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"))
    ranges = rows.groupBy("file", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"), F.bool_and(F.is_valid_utf8("value")).alias("_valid"))
    # a row for each range
    own = Window.partitionBy("file")
    before = F.coalesce(F.sum("_lines").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.select("file", "_range", "_first", before.alias("_before"), F.bool_and("_valid").over(own).alias("_utf8"))
    return rows.join(placed, ["file", "_range"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("n"), decoded(F.col("value"), F.col("_utf8")).alias("raw"))


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """``numbered_lines`` of every .vtt file below a directory, or of every .txt file where there is none."""
    for pattern in ("*.vtt", "*.txt"):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory).select("path")
        if not files.isEmpty():
            return numbered_lines(spark, directory, recursiveFileLookup=True, pathGlobFilter=pattern)
    raise FileNotFoundError(f"no .vtt or .txt file below {directory}")


def parse_plain(raw: DataFrame) -> DataFrame:
    """Plain lines (file, n, raw): one record for each line that is neither blank nor a comment, numbered over all lines."""
    rows = raw.select("file", "n", T.trimmed(F.col("raw")).alias("raw_line")).filter((F.col("raw_line") != "") & ~F.col("raw_line").startswith("#"))
    unknown = F.lit("unknown")
    rows = rows.select("file", "n", unknown.alias("folio"), unknown.alias("section"), F.col("n").cast("string").alias("line"), unknown.alias("transcriber"), "raw_line")
    return canonical(rows, T.plain_tokens(F.col("raw_line")))


def auto_convert(lines: DataFrame, records: int = 5001, tokens: int = 200, chars: int = 2000) -> DataFrame:
    """Uploaded text (line_ord, raw) as records: the first ``records`` non-blank lines, cut to a number of tokens and characters.

    The limits belong to the converter. Lines are numbered by a window over
    what is left after the limit.
    """
    full = lines.filter(T.trimmed(F.col("raw")) != "").orderBy("line_ord").limit(records)
    number = F.row_number().over(Window.orderBy("line_ord"))
    return full.select(
        "line_ord", F.concat(F.lit("auto_folio_"), number.cast("string")).alias("folio"), F.lit("P").alias("section"), number.cast("string").alias("line"),
        F.substring(T.trimmed(F.col("raw")), 1, chars).alias("raw_line"), F.slice(T.plain_tokens(F.col("raw")), 1, tokens).alias("tokens"),
    )


def read_csv_line(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file's cells as one line (line_ord, raw), row by row; an empty cell reads "nan". The whole file is one string; see ``auto_convert_csv``."""
    return _csv_line(_csv_rows(spark, path))


def auto_convert_csv(spark: SparkSession, path: str, tokens: int = 200, chars: int = 2000) -> DataFrame:
    """``auto_convert`` of a CSV file's line, of which no more rows are put together than the converter's limits leave anything of.

    The converter shows the first ``chars`` characters of the trimmed line
    and takes its first ``tokens`` tokens. So it needs the rows that have a
    token, as many as there can be of both, and no row of white space before
    the first of them or after the last; those between, it needs where they
    are, as each is a blank of the text at least.
    """
    rows = _csv_rows(spark, path).withColumn("_told", F.trim("c", F.lit(T.WHITES)) != "")
    most = max(tokens, chars) + 1
    ends = rows.filter("_told").orderBy("n").limit(most).agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    between = rows.crossJoin(F.broadcast(ends)).filter("n BETWEEN _low AND _high")  # one row
    # a run of more rows of white space than characters are shown pushes all that follows out of sight: a token's place in the text no longer matters there
    run = between.filter("NOT _told").orderBy("n").limit(most).select("n", "c")
    return auto_convert(_csv_line(between.filter("_told").select("n", "c").union(run)), tokens=tokens, chars=chars)


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(n, c): the cells of each row, joined by blanks, numbered in the file's order."""
    table = spark.read.csv(path, header=True)
    cells = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("nan")) for c in table.columns])
    return table.select(F.monotonically_increasing_id().alias("n"), cells.alias("c"))


def _csv_line(rows: DataFrame) -> DataFrame:
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("rows"))
    return ordered.select(F.lit(0).cast("bigint").alias("line_ord"), F.array_join(F.transform("rows", lambda r: r.c), " ").alias("raw"))


def token_rows(lines: DataFrame, clean: bool = False) -> DataFrame:
    """The long table (line_ord, folio, section, pos, token, size), and ``line_start`` where the lines have it."""
    tokens = T.clean_tokens(F.col("tokens")) if clean else F.col("tokens")
    kept = [c for c in ("line_ord", "line_start", "folio", "section") if c in lines.columns]
    return lines.select(*kept, F.posexplode(tokens).alias("pos", "token"), F.size("tokens").alias("size"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(token, n, first): counts, and the first place for breaking ties."""
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.min(T.place_in(rows)).alias("first"))
