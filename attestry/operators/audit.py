"""Audits of stored memories: verdict counts, the unsupported share, rows for a report, and its review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..judges import Judge
from ..policy import Policy
from .metrics import NAN, review_estimate, wilson
from .verify import LABELS, verify


def audit_pairs(rows: DataFrame, policy: Policy | None = None, judge: Judge | None = None) -> DataFrame:
    """``id, memory, source, verdict, support, contradiction, reason, evidence, missing_quantities``; ``reports`` says why in words."""
    d = verify(rows, policy, judge, claim="memory")
    v = F.col("verdict")
    four = lambda c: F.round(c, 4)
    return d.select("id", "memory", "source", v["label"].alias("verdict"), four(v["support"]).alias("support"), four(v["contradiction"]).alias("contradiction"), v["reason"].alias("reason"), F.coalesce(v["evidence"]["text"], F.lit("")).alias("evidence"), v["missing"].alias("missing_quantities"))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of every label, the unsupported share with its interval, and numeric violations, one pass."""
    n = lambda c: F.count(F.when(c, 1))
    flagged = F.col("verdict").isin("contradicted", "not_supported")
    d = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), *[n(F.col("verdict") == k).alias(k) for k in LABELS], n(flagged).alias("flagged"), n(F.col("verdict") != "unjudged").alias("judged"), n(F.size("missing_quantities") > 0).alias("numeric_violations"))
    ci = wilson(F.col("flagged"), F.col("judged"))
    return d.withColumn("unsupported_share", F.when(F.col("judged") > 0, F.col("flagged") / F.col("judged")).otherwise(F.lit(NAN))).withColumns({"lo": ci["lo"], "hi": ci["hi"]})


def review_groups(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``grp, memories, reviewed, not_stated`` from audit rows and ``marks(id, stated)``; unknown ids are an error."""
    group = F.when(F.col("verdict").isin("contradicted", "not_supported"), "flagged").when(F.col("verdict") == "uncertain", "uncertain").when(F.col("verdict") == "supported", "verified")
    known = rows.select("id", group.alias("grp")).filter("grp IS NOT NULL")
    d = known.join(marks, "id", "full")
    d = d.withColumn("grp", F.coalesce("grp", F.raise_error(F.concat(F.lit("not a judged row of this report: "), F.col("id"))).cast("string")))
    return d.groupBy("grp").agg(F.count(F.lit(1)).alias("memories"), F.count("stated").alias("reviewed"), F.count(F.when(~F.col("stated"), 1)).alias("not_stated"))


def summarize_review(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return review_estimate(review_groups(rows, marks))


def worst(rows: DataFrame, n: int = 10) -> DataFrame:
    """The flagged rows with the least support: what a report shows."""
    return rows.filter(F.col("verdict").isin("contradicted", "not_supported")).orderBy("support", "id").limit(n)
