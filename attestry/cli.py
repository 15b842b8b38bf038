"""The library as commands. Exit codes: 0, 1 for a broken chain, 2 for input that cannot be used."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import guess_language
from .judges import load_judge
from .memory import Memory
from .operators import audit, chain, evaluation, metrics, reports, search
from .operators.verify import verify
from .policy import Policy
from .sources import records

ITEM = "arrival long, claim string, source string, author string, origin string, subject string, observed_at string, written_by string"


def _show(df: DataFrame) -> None:
    for line in df.toJSON().toLocalIterator():
        print(line)


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attestry")
    top.add_argument("--policy", default="default", help="a policy file, or the name of one that comes along")
    top.add_argument("--judge")
    top.add_argument("--store", default="attestry-store")
    commands = top.add_subparsers(dest="command", required=True)
    given: dict[str, tuple[str, ...]] = {
        "check": ("claim", "--source", "--source-text"), "remember": ("claim", "--source", "--source-text", "--author", "--origin", "--subject", "--observed-at"),
        "recall": ("question", "--k", "--include"), "ask": ("question", "--k"), "queue": ("--k",), "review": ("id", "decision", "reviewer"), "forget": ("id",), "stats": (),
        "chain": ("--export",), "audit": ("file", "out", "--lang"), "audit-review": ("file", "sheet", "--lang"), "eval": ("file", "--pairs-out"), "eval-ask": ("file", "--k"),
        "calibrate": ("file", "out", "--loss", "--max-admitted"), "warmup": (), "doctor": (),
    }
    kinds = {"--k": {"type": int, "default": 5}, "--lang": {"choices": sorted(reports.WORDS), "default": "en"}, "--loss": {"type": float, "default": 0.08}, "--max-admitted": {"type": float}, "--author": {"required": True}, "decision": {"choices": ("approve", "reject")}, "--include": {"nargs": "*", "default": ["verified"]}}
    for name, names in given.items():
        sub = commands.add_parser(name)
        for n in names:
            sub.add_argument(n, **kinds.get(n, {}))
    return top


def _source(a: argparse.Namespace) -> str | None:
    return Path(a.source).read_text(encoding="utf-8") if a.source else a.source_text


def _verified(spark: SparkSession, path: str, policy: Policy, judge: Any) -> DataFrame:
    return evaluation.evaluated(verify(records.load_pairs(spark, path), policy, judge))


def run(spark: SparkSession, argv: list[str]) -> int:
    a = _arguments().parse_args(argv)
    try:
        return _run(spark, a)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"attestry: {e}", file=sys.stderr)
        return 2


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    policy = Policy.load(a.policy)
    judge = load_judge(a.judge or policy.judge)
    memory = lambda: Memory(spark, a.store, policy, judge)
    match a.command:
        case "check":
            _show(verify(spark.createDataFrame([(_source(a), a.claim)], "source string, claim string"), policy, judge).select("verdict.*"))
        case "remember":
            _show(memory().remember(spark.createDataFrame([(1, a.claim, _source(a), a.author, a.origin, a.subject, a.observed_at, "cli")], ITEM)))
        case "recall":
            _show(memory().recall(spark.createDataFrame([("q", a.question)], "q_id string, q string"), a.k, tuple(a.include)).orderBy("rank").select("rank", "id", "text", "status"))
        case "ask":
            question = spark.createDataFrame([("q", a.question)], "q_id string, q string").withColumn("language", guess_language(F.col("q")))
            _show(memory().ask(question, a.k))
        case "queue":
            _show(memory().review_queue(a.k).select("id", "status", "text", "reason"))
        case "review":
            _show(memory().review(spark.createDataFrame([(a.id, a.decision == "approve", a.reviewer)], "id string, approve boolean, reviewer string")).select("id", "status"))
        case "forget":
            memory().forget(spark.createDataFrame([(a.id,)], "id string"))
        case "stats":
            print(json.dumps(memory().stats()))
        case "chain":
            log = memory().events
            if a.export:
                chain.export(log, a.export)
            found = chain.verify(log).head().asDict()
            print(json.dumps(found))
            return 0 if found["ok"] else 1
        case "audit":
            rows = records.load_audit_rows(spark, a.file)
            if rows.isEmpty():
                raise ValueError(f"{a.file} has no memories")
            total = reports.write_report(audit.audit_pairs(rows, policy, judge), a.out, judge.id, judge.is_model, policy, a.lang)
            print(json.dumps({k: v for k, v in total.items() if v == v}))
        case "audit-review":
            rows, marks = spark.read.json(f"{a.file}/rows"), records.load_review(spark, a.sheet)
            groups = audit.review_groups(rows, marks)
            print(reports.review_markdown([g.asDict() for g in groups.orderBy("grp").collect()], metrics.review_estimate(groups).head().asDict(), a.lang))
        case "eval":
            rows = _verified(spark, a.file, policy, judge)
            if a.pairs_out:
                records.write_pairs(rows.withColumn("score", F.col("support")), a.pairs_out)
            wrong = evaluation.errors(rows).orderBy("id").limit(100).collect()
            print(reports.evaluation_markdown(evaluation.evaluate_verifier(rows).head().asDict(), [r.asDict() for r in wrong], a.file, judge.id, policy.version))
        case "eval-ask":
            facts, questions = records.load_questions(spark, a.file)
            facts = facts.withColumnRenamed("id", "rowid")
            questions = questions.withColumn("language", guess_language(F.col("q")))
            hits = search.search(search.postings(facts, "rowid", "text", True), search.query_terms(questions, "q_id", "q", True), search.candidates(a.k)).join(facts, "rowid")
            counts = search.evaluate_ask(search.ask(hits, questions, judge, policy, a.k), questions.select("q_id", "want"), hits).head().asDict()
            print(reports.ask_markdown(counts, a.file, judge.id, policy.relevance_threshold))
        case "calibrate":
            thresholds, story = evaluation.calibrate(_verified(spark, a.file, policy, judge), policy, a.loss, a.max_admitted)
            policy.with_thresholds(thresholds, f"{policy.version}+calibrated", story).save(a.out)
            print(json.dumps(story))
        case "warmup" | "doctor":
            known = spark.createDataFrame([("Anna leads the payments team.", "Anna leads the payments team"), ("Rain fell.", "Anna leads the payments team")], "source string, claim string")
            states, lacks = (r.verdict.support for r in verify(known, policy, judge).collect())
            report = {"spark": spark.version, "judge": judge.id, "is_model": judge.is_model, "policies": Policy.names(), "oriented": states > lacks}
            print(json.dumps(report))
            return 0 if report["oriented"] else 1
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("attestry").getOrCreate()
    sys.exit(run(session, sys.argv[1:]))
