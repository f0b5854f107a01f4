"""Pre-registered pass-or-fail rules over a corpus's measurements, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, severity, measurement, and the condition on it (SQL over the measurements' columns).
RULES = (
    ("F1.1", "CRITICAL", "coverage", "coverage >= 0.70"),
    ("F1.2", "MAJOR", "worst_failure", "worst_failure <= 0.90"),
    ("F1.3", "CRITICAL", "core_usage", "core_usage = most_usage"),
    ("F2.1", "CRITICAL", "entropy", "entropy < baseline_entropy"),
    ("F2.2", "MAJOR", "entropy", "entropy BETWEEN 7.0 AND 13.0"),
    ("F2.3", "CRITICAL", "conditional_entropy", "conditional_entropy < entropy"),
    ("F3.1", "MAJOR", "alpha", "alpha BETWEEN 0.5 AND 1.8"),
    ("F3.2", "MINOR", "r_squared", "r_squared >= 0.85"),
    ("F4.1", "MAJOR", "n_biased", "n_biased >= 5"),
    ("F4.2", "MAJOR", "jaccard", "jaccard < 0.30"),
    ("F5.1", "MAJOR", "perplexity_saved", "perplexity_saved >= 0.10"),
    ("F5.2", "CRITICAL", "perplexity_1", "perplexity_1 < perplexity_0"),
    ("F6.1", "MINOR", "n_significant", "n_significant >= 2"),
)


def evaluate(measured: DataFrame, rules=RULES) -> DataFrame:
    """(rule, severity, measured_value, verdict) from a one-row table of measurements; what is missing is inconclusive."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), F.col(m).cast("double").alias("measured_value"), _verdict(c).alias("verdict")) for i, s, m, c in rules
    ])
    return measured.select(F.explode(rows).alias("r")).select("r.*")


def _verdict(condition: str) -> Column:
    return F.coalesce(F.when(F.expr(condition), "PASS").when(~F.expr(condition), "FAIL"), F.lit("INCONCLUSIVE"))


def overall(tests: DataFrame) -> DataFrame:
    """Counts of failures by severity, and the verdict they lead to."""
    fail = lambda s: F.count_if((F.col("verdict") == "FAIL") & (F.col("severity") == s))
    sums = tests.agg(fail("CRITICAL").alias("critical"), fail("MAJOR").alias("major"), fail("MINOR").alias("minor"), F.count_if(F.col("verdict") == "INCONCLUSIVE").alias("inconclusive"))
    verdict = F.when(F.col("critical") > 0, "NOT_SUPPORTED").when(F.col("major") >= 2, "CONDITIONAL").when(F.col("inconclusive") > 0, "INCONCLUSIVE").otherwise("SUPPORTED")
    return sums.withColumn("verdict", verdict)


def one_row(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out
