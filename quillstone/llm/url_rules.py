"""Judging URLs by prefix rules: a sort-merge range join.

The canonical key of a host and path is the host's characters from the last to
the first, a point, and the path. A rule fits the keys that begin with its own
key, which are an interval of the sorted keys. Hosts below the rule's host
come in by asking with each of a URL's parent hosts that has as many labels as
some rule. Keys and rules are sorted together in ranges; each range also gets
the rules whose intervals began before it. One sweep over a range keeps a
stack of the rules whose intervals are open: they are nested, so the top is
the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.ranges import BOUND_CHARS, dealt, range_of, sampled_bounds
from quillstone.llm.storage import bounded, stash

NAME = "op12_url_rules"
#: (verdict, host, path) of the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The verdict on a URL that no rule fits.
OTHERWISE = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (ASCII letters in lower case) after the first ``://``, and the path up to a query or fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    place = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(place, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(place, F.char_length(host) + 1, F.char_length(place)), "^[^?#]*", 0)


def key_of(host: Column, path: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."), path)


def labels(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.translate(host, ".", "")) + 1


def intervals(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict, depth): rules (verdict, host, path) that can fit, each once.

    A rule without host, path or verdict, with a slash in its host or with a
    path that begins with anything but a slash fits nothing. Of one rule given
    with several verdicts the largest by name holds, so block before allow.
    """
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    able = rules.select(host.alias("host"), "path", "verdict").filter(~F.contains("host", F.lit("/")) & ((path == "") | path.startswith("/")) & F.col("verdict").isNotNull())
    return able.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(key_of(F.col("host"), path).alias("key"), "host", "path", "verdict", labels(F.col("host")).alias("depth"))


HIT = "host string, path string, rule_host string, rule_path string, verdict string"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The innermost open rule of each asked key, in rows sorted by range and key, a rule before an equal key."""
    part, open_rules = None, []
    for batch in batches:
        out = []
        for own, key, host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("_part", "key", "host", "path", "verdict")), strict=True):
            if own != part:
                part, open_rules = own, []
            while open_rules and not key.startswith(open_rules[-1][0]):
                open_rules.pop()
            if verdict is not None:
                open_rules.append((key, host, path, verdict))
            elif open_rules:
                out.append((host, path, *open_rules[-1][1:]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], [f.split()[0] for f in HIT.split(", ")])


def range_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``HIT`` for each (host, path) of ``urls`` and each number of labels that some rule has: the longest rule at that number of labels or fewer, where there is one."""
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = stash(intervals(rules), "url-rules")
    depths = sorted(r["depth"] for r in known.select("depth").distinct().collect())  # a host has 127 labels at most
    host = F.col("host")
    asked = F.array(*[F.struct(F.lit(d).alias("d"), F.substring_index(host, ".", -d).alias("suffix")) for d in depths]) if depths else F.array().cast("array<struct<d:int,suffix:string>>")
    probes = urls.select("host", "path", F.explode(F.filter(asked, lambda a: a.d <= labels(host))).alias("a")).select(key_of(F.col("a.suffix"), F.col("path")).alias("key"), "host", "path")
    # one key may be asked by many hosts: a hash of the host parts them
    cut = F.struct(F.substring("key", 1, BOUND_CHARS).alias("key"), F.xxhash64("host", "path").alias("tie"))
    bounds = F.broadcast(sampled_bounds(probes, cut, parts))  # one row
    tied = F.struct("key", F.xxhash64("host", "path").alias("tie"))
    points = probes.crossJoin(bounds).withColumn("_part", range_of(tied, F.col("_bounds"), parts))
    before = F.size(F.filter("_bounds", lambda b: b.key < F.col("key")))
    within = F.size(F.filter("_bounds", lambda b: (b.key < F.col("key")) | b.key.startswith(F.col("key"))))
    columns = ("_part", "key", "host", "path", "verdict")
    # a range begins inside as many rules as are nested there, so a rule's copies stay few
    starts = known.crossJoin(bounds).withColumn("_part", F.explode(F.sequence(before, within)))
    both = points.withColumn("verdict", F.lit(None).cast("string")).select(*columns).union(starts.select(*columns))
    return dealt(bounded(both), parts, "key", F.col("verdict").isNull()).mapInArrow(_sweep, HIT)


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """``pages`` (url and any others) with host, path, rule and verdict.

    A rule fits its host and the hosts below it if the path begins with the
    rule's. The longest rule (host and path together, then the host) decides;
    ``rule`` is its host and path. Without one, or without a URL, ``rule`` is
    null and the verdict is ``otherwise``. Repeated rows stay; columns of
    ``pages`` with the names of the added ones are replaced.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    hits = range_join(named.select("host", "path").distinct(), rules)
    size = F.char_length("rule_host") + F.char_length("rule_path")
    longest = F.max(F.struct(size.alias("size"), F.char_length("rule_host").alias("own"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("_best")
    best = hits.groupBy("host", "path").agg(longest)
    joined = named.join(best, ["host", "path"], "left")
    return joined.select(*named.columns, F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH r(verdict, rh, rp) AS (VALUES {_VALUES}),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT n, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT n, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT n, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(verdict, (length(rh || rp), length(rh))) AS verdict
  FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{OTHERWISE}') AS verdict FROM p LEFT JOIN f USING (n)
"""
