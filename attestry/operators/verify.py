"""Claim verification: pairs of source and claim in, verdicts out, in one pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantities import missing, quantities
from ..functions.sentences import windows
from ..functions.text import language_of, nfkc, nfkc_all, normalize_ws, words
from ..judges import Judge, load_judge
from ..policy import Policy

LABELS = ("supported", "not_supported", "contradicted", "uncertain", "unjudged")
def _two(x: Column) -> Column:
    return F.format_number(x, 2)


def verify(pairs: DataFrame, policy: Policy | None = None, judge: Judge | None = None, source: str = "source", claim: str = "claim", language: str | None = None) -> DataFrame:
    """``pairs`` with a ``verdict`` struct: label, support, contradiction, evidence, checks, judge, policy, language, reason.

    The first that holds decides: no window; a missing quantity; a contradiction; support that the windows
    around it do not share; support; weak support; none. A blank source leaves a claim unjudged, a blank
    claim is an error.
    """
    policy = policy or Policy()
    judge = judge or load_judge(policy.judge)
    text = normalize_ws(F.coalesce(F.col(claim), F.lit("")))
    d = pairs.withColumn("_claim", F.when(text == "", F.raise_error(F.lit("a claim is empty")).cast("string")).otherwise(text))
    blank = F.coalesce(normalize_ws(F.col(source)) == "", F.lit(True))
    d = d.withColumns({"_blank": blank, "_premise": nfkc(F.coalesce(F.col(source), F.lit(""))), "_hypothesis": nfkc(F.col("_claim"))})
    d = d.withColumn("_own", language_of(words(F.col("_hypothesis"), normal=True)))
    tongue = F.lit(language) if language else F.when(F.col("_own") == "und", language_of(words(F.col("_premise"), normal=True))).otherwise(F.col("_own"))
    d = d.withColumn("_lang", F.when(F.col("_blank"), "und").otherwise(tongue))
    d = d.withColumn("_w", windows(F.col(source), F.col("_claim"), policy.window_sizes, policy.full_source_max_chars, policy.max_windows))
    lacks = missing(F.col("_stated_c"), F.col("_stated_s")) if policy.numeric_check else F.array().cast("array<string>")
    d = d.withColumns({"_stated_c": quantities(F.col("_claim"), F.col("_own") == "it"), "_stated_s": quantities(F.col(source))})
    d = d.withColumns({"_missing": F.when(F.col("_blank"), F.array().cast("array<string>")).otherwise(lacks), "_texts": nfkc_all(F.transform("_w", lambda w: w["text"]))})
    d = d.withColumn("_s", judge.scores(F.col("_texts"), F.col("_hypothesis")))
    return decide(d, policy, judge.id).drop("_claim", "_blank", "_premise", "_hypothesis", "_own", "_lang", "_w", "_stated_c", "_stated_s", "_missing", "_texts", "_s")


def decide(d: DataFrame, policy: Policy, judge_id: str) -> DataFrame:
    """Verdicts from windows ``_w``, scores ``_s``, missing quantities ``_missing``, ``_blank`` and ``_lang``."""
    support = F.transform("_s", lambda s: s["entailment"])
    against = F.transform("_s", lambda s: s["contradiction"])
    d = d.withColumns({"_best": F.array_max(support), "_worst": F.array_max(against)})
    first = F.array_position(support, F.col("_best")).cast("int")
    last = (F.size("_s") - F.array_position(F.reverse(against), F.col("_worst")) + 1).cast("int")
    d = d.withColumns({"_i": F.when(F.col("_best").isNotNull(), first), "_j": F.when(F.col("_worst").isNotNull(), last)})
    d = d.withColumn("_top", F.try_element_at("_w", F.col("_i")))
    pick = lambda i: F.struct(*[F.try_element_at("_w", i)[k].alias(k) for k in ("start", "end", "text")], F.try_element_at("_s", i)["entailment"].alias("support"), F.try_element_at("_s", i)["contradiction"].alias("contradiction"))
    around = F.filter(F.arrays_zip(F.col("_w").alias("w"), F.col("_s").alias("s")), lambda z: (z["w"]["start"] <= F.col("_top.start")) & (z["w"]["end"] >= F.col("_top.end")) & ((z["w"]["start"] != F.col("_top.start")) | (z["w"]["end"] != F.col("_top.end"))))
    context = F.array_min(F.transform(around, lambda z: z["s"]["entailment"])) if policy.context_check else F.lit(None).cast("double")
    d = d.withColumn("_context", F.coalesce(context, "_best"))
    enough, weak, contrary = (policy.threshold(k, F.col("_lang")) for k in ("support", "uncertain", "contradiction"))
    lacks = F.size("_missing") > 0
    contradicted = F.coalesce(F.col("_worst") >= contrary, F.lit(False))
    none = F.size("_w") == 0
    # The order of the cases, and their texts.
    cases = [
        (F.col("_blank"), "unjudged", F.lit("no source was given, so nothing can be verified")),
        (none, "not_supported", F.lit("the source only asks questions: it states nothing")),
        (lacks & ~contradicted, "not_supported", F.concat(F.lit("quantities not in the source: "), F.array_join("_missing", ", "))),
        (contradicted & (lacks | (F.col("_best") < enough)), "contradicted", F.concat(F.lit("the source contradicts the claim (p="), _two(F.col("_worst")), F.lit(")"))),
        ((F.col("_best") >= enough) & (F.col("_context") < weak), "uncertain", F.concat(F.lit("one sentence supports it (p="), _two(F.col("_best")), F.lit(") but its context does not (p="), _two(F.col("_context")), F.lit(")"))),
        (F.col("_best") >= enough, "supported", F.concat(F.lit("supported by the source (p="), _two(F.col("_best")), F.lit(")"))),
        (F.col("_best") >= weak, "uncertain", F.concat(F.lit("weak support (p="), _two(F.col("_best")), F.lit("): not enough to verify"))),
    ]
    label, reason = F.lit("not_supported"), F.concat(F.lit("the source does not state this (best support p="), _two(F.col("_best")), F.lit(")"))
    for when, name, why in reversed(cases):
        label, reason = F.when(when, name).otherwise(label), F.when(when, why).otherwise(reason)
    d = d.withColumns({"_label": label, "_reason": reason})
    none = F.col("_blank") | none
    detail = F.when(lacks, F.concat(F.lit("quantities not in the source: "), F.array_join("_missing", ", "))).otherwise("every quantity in the claim appears in the source")
    check = F.array(F.struct(F.lit("quantities").alias("name"), (~lacks).alias("passed"), detail.alias("detail")))
    nothing = F.filter(check, lambda c: F.lit(False))
    verdict = F.struct(
        F.col("_label").alias("label"),
        F.when(none, 0.0).otherwise(F.col("_best")).alias("support"),
        F.when(~none, F.col("_worst")).alias("contradiction"),
        F.when(~none, pick(F.when(F.col("_label") == "contradicted", F.col("_j")).otherwise(F.col("_i")))).alias("evidence"),
        F.when(F.col("_blank") | F.lit(not policy.numeric_check), nothing).otherwise(check).alias("checks"),
        F.lit(judge_id).alias("judge"),
        F.lit(policy.version).alias("policy"),
        F.col("_lang").alias("language"),
        F.col("_reason").alias("reason"),
        F.col("_missing").alias("missing"),
    )
    return d.withColumn("verdict", verdict).drop("_best", "_worst", "_i", "_j", "_top", "_context", "_label", "_reason")


def status_for(label: Column, trusted: Column, is_model: bool) -> Column:
    """The status a stored claim starts with: verified only by a model, on a trusted source."""
    verified = F.lit(is_model) & trusted
    return F.when(label == "supported", F.when(verified, "verified").otherwise("unverified")).when(label.isin("not_supported", "contradicted"), "quarantined").otherwise("unverified")
