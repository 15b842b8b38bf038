"""Evaluation of verdicts on labelled pairs, and the calibration of thresholds from them.

Rows are labelled pairs with what the verifier made of them: ``id, label`` (S stated, N not stated, C
contradicted), ``lang, verdict`` (a label), ``support`` (what a threshold acts on), ``judged`` (no check refused
it). ``evaluated`` makes them from the output of ``verify``.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import Policy, Thresholds
from ..storage import stage
from . import metrics
from .verify import LABELS

ROW = ("id", "label", "lang", "verdict", "support", "judged")
#: Labelled pairs that a calibration needs.
LEAST_PAIRS = 10


def judged(verdict: str = "verdict") -> Column:
    """False where a deterministic check refused the claim, whatever the thresholds."""
    return F.forall(f"{verdict}.checks", lambda c: c["passed"])


def evaluated(verified: DataFrame) -> DataFrame:
    """Rows for this module, with ``claim`` and ``reason``, from ``verify`` of ``id, label, lang, claim`` and a source."""
    return verified.select("id", "label", "lang", "claim", F.col("verdict.label").alias("verdict"), metrics.score_for_thresholds().alias("support"), judged().alias("judged"), F.col("verdict.reason").alias("reason"))


def rates(rows: DataFrame) -> DataFrame:
    """``label, pairs, supported_rate`` for each of S, N and C; NaN for a label without pairs."""
    labels = rows.sparkSession.createDataFrame([(x,) for x in "SNC"], "label string")
    counted = rows.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("verdict") == "supported").cast("double")).alias("supported_rate"))
    return labels.join(counted, "label", "left").select("label", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("supported_rate", F.lit(metrics.NAN)).alias("supported_rate"))


def errors(rows: DataFrame) -> DataFrame:
    """The pairs whose verdict does not fit their label."""
    return rows.filter((F.col("label") == "S") != (F.col("verdict") == "supported"))


def by_language(rows: DataFrame) -> DataFrame:
    """``lang, pairs, auroc`` for every language that is named: pairs of all labels, AUROC of S against N."""
    named = rows.filter(F.coalesce("lang", F.lit("")) != "")
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("pairs"))
    areas = metrics.auroc(named.filter(F.col("label").isin("S", "N")).withColumn("pos", F.col("label") == "S"), "pos", "support", ["lang"])
    return counts.join(areas.select("lang", "auroc"), "lang", "left").withColumn("auroc", F.coalesce("auroc", F.lit(metrics.NAN)))


def summarise(rounds: DataFrame) -> DataFrame:
    """One row of means over the rounds of ``metrics.held_out``; NaN where there is none, null for C."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(metrics.NAN)).alias(c)
    return rounds.agg(F.count(F.lit(1)).alias("rounds"), mean("true_lost"), mean("unstated_admitted"), F.avg("contradicted_admitted").alias("contradicted_admitted"))


def evaluate_verifier(rows: DataFrame, bootstrap_rounds: int = 1000, held_out_rounds: int = 200, loss: float = 0.08) -> DataFrame:
    """One row: pairs and share supported by label, AUROC of S against N with its interval and against N and C, held-out rates."""
    pos = rows.withColumn("pos", F.col("label") == "S")
    stated = pos.filter(F.col("label") != "C")
    wide = rates(rows).groupBy().pivot("label", list("SNC")).agg(F.first("pairs").alias("pairs"), F.first("supported_rate").alias("supported"))
    area = lambda d, name: metrics.auroc(d, "pos", "support").select(F.col("auroc").alias(name))
    parts = [
        area(stated, "auroc_s_vs_n"),
        metrics.bootstrap_interval(metrics.bootstrap_auroc(stated, "id", "pos", "support", bootstrap_rounds)).select("lo", "hi"),
        area(pos, "auroc_s_vs_nc"),
        summarise(metrics.held_out(rows, "id", "label", "support", "judged", loss, held_out_rounds)).drop("rounds"),
    ]
    for part in parts:  # one row each
        wide = wide.join(F.broadcast(part))
    return wide


def calibrate(rows: DataFrame, policy: Policy, loss: float = 0.08, max_admitted: float | None = None, quarantine_loss: float = 0.02, rounds: int = 200) -> tuple[Thresholds, dict[str, Any]]:
    """Thresholds from labelled pairs, and the held-out rates that speak for them.

    ``support`` loses ``loss`` of the true claims that the judge decides, and ``uncertain`` ``quarantine_loss``
    of them. With ``max_admitted``, ``support`` admits that share of the claims that are not stated, and
    ``uncertain`` stays as it is. Fewer than ``LEAST_PAIRS`` of the pairs that a threshold rests on are an error.
    """
    rows = stage(rows.select("id", "label", "verdict", "support", "judged"), "pairs")  # texts are read once, not for every figure
    true, other = rows.filter((F.col("label") == "S") & F.col("judged")), rows.filter(F.col("label") != "S")
    if true.count() < LEAST_PAIRS:
        raise ValueError(f"calibration needs {LEAST_PAIRS} supported pairs that the judge decides")
    if max_admitted is None:
        support = metrics.threshold_for_loss(true, "support", loss)
        uncertain = metrics.threshold_for_loss(true, "support", quarantine_loss)
    elif other.count() < LEAST_PAIRS:
        raise ValueError(f"a cap on admissions needs {LEAST_PAIRS} pairs that are not stated")
    else:
        support, uncertain = metrics.threshold_for_admission(other, "support", max_admitted), policy.thresholds.uncertain
    new = Thresholds(round(support, 4), round(min(support, uncertain), 4), policy.thresholds.contradiction)
    rate = summarise(metrics.held_out(rows, "id", "label", "support", "judged", loss, rounds, max_admitted)).head()
    four = lambda x: None if x is None or math.isnan(x) else round(x, 4)
    story = {
        "pairs": {r.label: r.pairs for r in rates(rows).collect()},
        "objective": f"lose {loss:.0%} of the true claims that the judge decides" if max_admitted is None else f"admit {max_admitted:.0%} of the claims that are not stated",
        "uncertain": f"lose {quarantine_loss:.0%}" if max_admitted is None else "as before",
        "held_out_true_lost": four(rate.true_lost),
        "held_out_unstated_admitted": four(rate.unstated_admitted),
        "held_out_contradicted_admitted": four(rate.contradicted_admitted),
    }
    return new, story


def window_budget(scored: DataFrame, most: int = 12) -> DataFrame:
    """``id, k, support``: the best score among the first k windows, for each k, from ``id, ord, entailment`` (ord from 0)."""
    best = F.max("entailment").over(Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return scored.filter(F.col("ord") < most).select("id", (F.col("ord") + 1).alias("k"), best.alias("support"))


def composite(windows: Column, scores: Column, m: int) -> Column:
    """The text of the ``m`` best-scored windows that do not ask, put together in the order of the source."""
    pairs = F.arrays_zip(windows.alias("w"), scores.alias("s"))
    ranked = F.slice(F.array_sort(F.transform(pairs, lambda p, i: F.struct((-p["s"]["entailment"]).alias("minus"), i.alias("i"), p["w"].alias("w")))), 1, m)
    return F.array_join(F.transform(F.array_sort(F.transform(ranked, lambda r: F.struct(r["w"]["start"].alias("start"), r["w"]["end"].alias("end"), r["w"]["text"].alias("text")))), lambda w: w["text"]), " ")


def precision(one: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """One row: how two sets of scores ``id, support`` of the same pairs differ, and how many cross the threshold."""
    d = one.join(other.select("id", F.col("support").alias("again")), "id")
    gap = F.abs(F.col("support") - F.col("again"))
    return d.agg(F.count(F.lit(1)).alias("pairs"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.count(F.when((F.col("support") >= threshold) != (F.col("again") >= threshold), 1)).alias("crossed"))


def review_sizes(spark, groups: dict[str, tuple[int, float]], sizes: list[int], trials: int = 200, seed: int = 17) -> DataFrame:
    """``size, width, coverage``: how wide the review interval is, and how often it holds the truth, by simulation.

    ``groups`` gives each group's memories and its true share not stated. A reviewed memory is a hash below
    that share, so that trials run as rows and reruns agree.
    """
    whole = sum(n for n, _ in groups.values())
    truth = sum(n * p for n, p in groups.values()) / whole
    d = spark.createDataFrame([(g, n, p) for g, (n, p) in groups.items()], "grp string, memories long, share double")
    d = d.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    d = d.withColumn("reviewed", F.least("memories", "size").cast("long"))
    draw = metrics._hash01(F.lit(seed), F.col("trial"), F.col("size"), F.col("grp"), F.col("i"))
    seen = d.withColumn("i", F.explode(F.expr("sequence(1, reviewed)"))).groupBy("size", "trial", "grp", "memories", "reviewed").agg(F.count(F.when(draw < F.col("share"), 1)).alias("not_stated"))
    out = metrics.review_estimate(seen, ["size", "trial"])
    return out.groupBy("size").agg(F.avg(F.col("hi") - F.col("lo")).alias("width"), F.avg(((F.col("lo") <= truth) & (F.col("hi") >= truth)).cast("double")).alias("coverage"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    """``verdict, n`` for every label, those without rows too."""
    labels = rows.sparkSession.createDataFrame([(x,) for x in LABELS], "verdict string")
    return labels.join(rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))
