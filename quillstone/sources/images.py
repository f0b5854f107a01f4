"""Sizes of images from their headers, by built-in functions over files' bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a JPEG file that are followed at first; where the frame's has not come up, all are.
NEAR = 64
# Modes by PNG's colour types and by the components of a JPEG frame; markers of frames, and those without a length.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
BARE = (0x01, *range(0xD0, 0xD9))
PNG = "89504E470D0A1A0A"


def number(content: Column, at: Column | int, size: int) -> Column:
    """``size`` bytes from the place ``at`` (from 0) as a number, the first the highest; null where the content is too short."""
    part = F.substring(content, F.lit(at) + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def _png(content: Column) -> Column:
    kind, depth = number(content, 25, 1), number(content, 24, 1)
    mode = F.when((kind == 0) & (depth == 1), "1").when((kind == 0) & (depth == 16), "I;16")
    for k, m in PNG_MODES.items():
        mode = mode.when(kind == k, m)
    good = (F.hex(F.substring(content, 1, 8)) == PNG) & (F.substring(content, 13, 4) == F.lit("IHDR").cast("binary"))
    return F.when(good, F.struct(number(content, 16, 4).alias("width"), number(content, 20, 4).alias("height"), mode.alias("mode")))


def _jpeg(content: Column, steps: Column) -> Column:
    """Follows the chain of segments to the frame's: each step goes from a marker to the next."""
    state = F.struct(F.lit(2).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("frame"))

    def step(s: Column, _: Column) -> Column:
        marker = number(content, s.at + 1, 1)
        length = number(content, s.at + 2, 2)
        over = s.frame.isNotNull() | (s.at < 0)
        # at fill bytes one byte is skipped; what is no marker, or is the end or the scan, ends the chain
        after = F.when(number(content, s.at, 1) != 0xFF, -1).when(marker == 0xFF, s.at + 1).when(marker.isin(*BARE), s.at + 2).when(marker.isin(0xD9, 0xDA) | (length < 2), -1).otherwise(s.at + 2 + length)
        frame = F.when(~over & (number(content, s.at, 1) == 0xFF) & marker.isin(*FRAMES), s.at)
        return F.struct(F.when(over, s.at).otherwise(F.coalesce(after, F.lit(-1))).cast("bigint").alias("at"), F.coalesce(s.frame, frame).alias("frame"))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps), state, step)


def header(content: Column) -> Column:
    """STRUCT<width, height, mode> of a PNG or JPEG file; null for any other, and for one that is broken before its size."""
    near = _jpeg(content, F.lit(NEAR).cast("bigint"))
    # a segment takes four bytes at least, a fill byte one
    found = F.when(near.frame.isNotNull() | (near.at < 0), near.frame).otherwise(_jpeg(content, F.octet_length(content).cast("bigint") + 1).frame)
    count = number(content, found + 9, 1)
    mode = F.when(F.lit(False), "")
    for k, m in JPEG_MODES.items():
        mode = mode.when(count == k, m)
    frame = F.struct(number(content, found + 7, 2).alias("width"), number(content, found + 5, 2).alias("height"), mode.alias("mode"))
    jpeg = F.when((F.hex(F.substring(content, 1, 2)) == "FFD8") & found.isNotNull(), frame)
    made = F.coalesce(_png(content), jpeg)
    return F.when((made.width > 0) & (made.height > 0), made)


def image_headers(files: DataFrame, zoom: int = 100) -> DataFrame:
    """(path, width, height, mode, aspect, zoom_width) of files (path, content): aspect is width by height to two places, zoom_width the width at ``zoom`` percent, rounded down.

    A file that is no PNG or JPEG, or is cut off before its size, has nulls.
    Only headers are looked at; no image is decoded.
    """
    h = files.select("path", header(F.col("content")).alias("h"))
    aspect = F.round(F.col("h.width") / F.col("h.height"), 2)
    return h.select("path", "h.width", "h.height", "h.mode", aspect.alias("aspect"), F.floor(F.col("h.width") * zoom / 100).cast("bigint").alias("zoom_width"))


def read_images(spark: SparkSession, directory: str, zoom: int = 100) -> DataFrame:
    """``image_headers`` of the .png, .jpg and .jpeg files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(directory)
    return image_headers(files.select("path", "content"), zoom)
