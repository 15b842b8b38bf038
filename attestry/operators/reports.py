"""Reports in English and Italian, from aggregates that are a few rows each: audits, reviews, evaluations."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..policy import Policy
from ..sources.records import write_review_sheet, write_rows
from .audit import summary, worst
from .verify import LABELS

WORDS = {
    "en": {
        "title": "Memory reliability", "pairs": "pairs", "supported": "supported", "flagged": "not supported", "judged": "judged", "numbers": "with numbers that the source lacks",
        "uncertain": "uncertain", "unjudged": "unjudged", "worst": "Least supported", "closest": "closest", "judge": "Judge {judge}, policy {policy}.", "none": "n/a",
        "baseline": "The judge compares words and is no model: take these figures as a baseline, not as a finding.",
        "limits": "A verdict says what the source states, not what is true. Facts that follow from a source without being stated count as not supported.",
        "calibration": "Thresholds: {objective}; measured on held-out pairs, {lost} of true claims are lost and {admitted} of unstated ones admitted.",
        "review": "Human review", "group": "group", "memories": "memories", "reviewed": "reviewed", "not_stated": "not stated", "estimate": "Estimated share not stated", "census": "Every memory was reviewed.", "missing": "No estimate: nothing reviewed among {groups}.",
        "lacks": "Not in the source: {x}", "says": "The source says otherwise", "weak": "Weak or contested support, {x}", "states": "Stated by the source, {x}", "unstated": "Not stated by the source, best support {x}",
    },
    "it": {
        "title": "Affidabilità delle memorie", "pairs": "coppie", "supported": "confermate", "flagged": "non confermate", "judged": "giudicate", "numbers": "con numeri assenti dalla fonte",
        "uncertain": "incerte", "unjudged": "non giudicate", "worst": "Le meno confermate", "closest": "passo più vicino", "judge": "Giudice {judge}, regole {policy}.", "none": "n/d",
        "baseline": "Il giudice confronta parole e non è un modello: queste cifre sono un termine di paragone, non un risultato.",
        "limits": "Un verdetto dice ciò che la fonte afferma, non ciò che è vero. I fatti che ne seguono senza esservi scritti contano come non confermati.",
        "calibration": "Soglie: {objective}; su coppie tenute da parte si perde {lost} delle affermazioni vere e si ammette {admitted} di quelle non scritte.",
        "review": "Revisione umana", "group": "gruppo", "memories": "memorie", "reviewed": "riviste", "not_stated": "non scritte", "estimate": "Quota stimata di non scritte", "census": "Tutte le memorie sono state riviste.", "missing": "Nessuna stima: niente di rivisto tra {groups}.",
        "lacks": "Assente dalla fonte: {x}", "says": "La fonte dice altro", "weak": "Conferma debole o contestata, {x}", "states": "Scritto nella fonte, {x}", "unstated": "Non scritto nella fonte, conferma migliore {x}",
    },
}


def share(x: float | None, none: str = "n/a") -> str:
    return none if x is None or math.isnan(x) else f"{x:.0%}"


def inline(text: str) -> str:
    """Text of one line that Markdown shows as it is."""
    return "".join("\\" + c if c in "\\`*_[]<>#|" else c for c in " ".join(text.split()))


def explain(lang: str = "en") -> Column:
    """Why a memory got its verdict, in words of a language, from columns of ``audit_pairs``."""
    w, p = WORDS[lang], F.format_number("support", 2)
    say = lambda key, x=F.lit(""): F.replace(F.lit(w[key]), F.lit("{x}"), x)
    out = F.when(F.size("missing_quantities") > 0, say("lacks", F.array_join("missing_quantities", ", "))).when(F.col("verdict") == "contradicted", say("says"))
    return out.when(F.col("verdict") == "uncertain", say("weak", p)).when(F.col("verdict") == "supported", say("states", p)).otherwise(say("unstated", p))


def _facts(total: dict[str, Any], w: dict[str, str]) -> list[tuple[str, str]]:
    flagged = f"{total['flagged']}, {share(total['unsupported_share'], w['none'])} ({share(total['lo'], w['none'])}-{share(total['hi'], w['none'])}) / {total['judged']} {w['judged']}"
    return [(w["pairs"], str(total["total"])), (w["supported"], str(total["supported"])), (w["flagged"], flagged), (w["numbers"], str(total["numeric_violations"])), (w["uncertain"], str(total["uncertain"])), (w["unjudged"], str(total["unjudged"]))]


def _notes(judge: str, is_model: bool, policy: Policy, w: dict[str, str]) -> list[str]:
    out = [w["judge"].format(judge=judge, policy=policy.version)]
    if not is_model:
        out.append(w["baseline"])
    if c := policy.calibration:
        out.append(w["calibration"].format(objective=c.get("objective", w["none"]), lost=share(c.get("held_out_true_lost"), w["none"]), admitted=share(c.get("held_out_unstated_admitted"), w["none"])))
    return [*out, w["limits"]]


def audit_markdown(total: dict[str, Any], examples: list[dict[str, Any]], judge: str, is_model: bool, policy: Policy, lang: str = "en") -> str:
    w = WORDS[lang]
    lines = [f"# {w['title']}", "", *[f"- {k}: **{v}**" for k, v in _facts(total, w)], ""]
    if examples:
        lines += [f"## {w['worst']}", ""]
    for r in examples:
        lines += [f"* {inline(r['memory'])}", f"  {inline(r['why'])}", *([f"  {w['closest']}: {inline(r['evidence'])}"] if r["evidence"] else []), ""]
    return "\n".join([*lines, *[f"{n}\n" for n in _notes(judge, is_model, policy, w)]])


def audit_html(total: dict[str, Any], examples: list[dict[str, Any]], judge: str, is_model: bool, policy: Policy, lang: str = "en") -> str:
    """The same as a page; everything that came from data is escaped."""
    w, e = WORDS[lang], html.escape
    bar = "".join(f'<span class="{k}" style="width:{100 * total[k] / max(total["total"], 1):.2f}%"></span>' for k in LABELS)
    facts = "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in _facts(total, w))
    items = "".join(f"<li><b>{e(r['memory'])}</b><p>{e(r['why'])}</p><q>{e(r['evidence'] or '')}</q></li>" for r in examples)
    notes = "".join(f"<p>{e(n)}</p>" for n in _notes(judge, is_model, policy, w))
    return f'<!doctype html><html lang="{lang}"><meta charset="utf-8"><title>{e(w["title"])}</title><h1>{e(w["title"])}</h1><div class="bar">{bar}</div><dl>{facts}</dl><ul>{items}</ul>{notes}</html>\n'


def write_report(rows: DataFrame, folder: str, judge: str, is_model: bool, policy: Policy, lang: str = "en") -> dict[str, Any]:
    """``rows/`` (JSON lines) and ``review/`` (CSV) from every row, and ``report.json, .md, .html`` from aggregates."""
    d = rows.withColumn("why", explain(lang))
    write_rows(d, f"{folder}/rows")
    write_review_sheet(d, f"{folder}/review")
    total = summary(d).head().asDict()
    examples = [r.asDict() for r in worst(d).collect()]  # ten rows
    out = Path(folder)
    plain = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in total.items()}
    (out / "report.json").write_text(json.dumps({"judge": judge, "judge_is_model": is_model, "policy": policy.version, "calibration": policy.calibration, **plain}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    (out / "report.md").write_text(audit_markdown(total, examples, judge, is_model, policy, lang), encoding="utf-8")
    (out / "report.html").write_text(audit_html(total, examples, judge, is_model, policy, lang), encoding="utf-8")
    return total


def review_markdown(groups: list[dict[str, Any]], estimate: dict[str, Any], lang: str = "en") -> str:
    """From the rows of ``review_groups`` and the one of ``review_estimate``."""
    w = WORDS[lang]
    lines = [f"# {w['review']}", "", f"| {w['group']} | {w['memories']} | {w['reviewed']} | {w['not_stated']} |", "|---|---|---|---|"]
    lines += [f"| {g['grp']} | {g['memories']} | {g['reviewed']} | {g['not_stated']} |" for g in groups]
    if estimate["missing_groups"]:
        lines += ["", w["missing"].format(groups=", ".join(estimate["missing_groups"]))]
    else:
        whole = all(g["memories"] == g["reviewed"] for g in groups)
        lines += ["", f"{w['estimate']}: {share(estimate['estimate'])}" + ("" if whole else f" ({share(estimate['lo'])}-{share(estimate['hi'])})")]
        lines += [w["census"]] * whole
    return "\n".join([*lines, ""])


def evaluation_markdown(report: dict[str, Any], errors: list[dict[str, Any]], dataset: str, judge: str, policy: str, most: int = 15) -> str:
    """From the row of ``evaluate_verifier`` and its errors: false accepts, the costly ones, come first."""
    three = lambda x: "n/a" if math.isnan(x) else f"{x:.3f}"
    r = report
    lines = [f"### {dataset}", "", f"Judge {judge}, policy {policy}.", "", "| label | pairs | supported |", "|---|---|---|"]
    lines += [f"| {x} | {r[f'{x}_pairs']} | {share(r[f'{x}_supported'])} |" for x in "SNC"]
    lines += ["", f"AUROC: S against N {three(r['auroc_s_vs_n'])} ({three(r['lo'])}-{three(r['hi'])}), against N and C {three(r['auroc_s_vs_nc'])}.", f"Held out: {share(r['true_lost'])} of true claims lost, {share(r['unstated_admitted'])} of N admitted.", ""]
    for title, wrong in (("Supported, though not stated", [x for x in errors if x["verdict"] == "supported"]), ("Stated, though not supported", [x for x in errors if x["verdict"] != "supported"])):
        if wrong:
            lines += [f"{title} ({min(most, len(wrong))} of {len(wrong)}):", "", *[f"- {x['label']}, {x['verdict']}, {x['support']:.3f}: {inline(x.get('claim') or x['id'])}" for x in wrong[:most]], ""]
    return "\n".join(lines)


def ask_markdown(counts: dict[str, Any], dataset: str, judge: str, threshold: float) -> str:
    """From the row of ``search.evaluate_ask``."""
    c, rest = counts, counts["questions"] - counts["answerable"]
    return "\n".join([
        f"### {dataset}", "", f"Judge {judge}, relevance from {threshold}.", "",
        f"- answerable questions: {c['answerable']}; right {c['answered_right']}, wrong fact {c['wrong_fact']}, abstained {c['wrong_abstentions']}, fact not found by words {c['retrieval_misses']}",
        f"- others: {rest}; abstained {c['right_abstentions']}, answered {c['false_answers']}",
        f"- related facts: the right one for {c['right_in_related']} questions not answered; some for {c['unanswerable_with_related']} that have no answer", "",
    ])
