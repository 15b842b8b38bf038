import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestry.judges import Cover, Lexical, Model
from attestry.operators import audit, chain, facts, metrics, search
from attestry.operators.verify import verify
from attestry.policy import Policy, Thresholds
from attestry.sources import records


def judged(spark, rows, judge, policy=None):
    out = verify(spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(rows)], "i int, source string, claim string"), policy, judge)
    return [r.verdict for r in out.orderBy("i").collect()]


def fixed(scores):
    return Model("fixed" + str(sorted(scores.items())), lambda: lambda pairs: [scores.get(p, (0.01, None)) for p, _ in pairs])


def test_verdicts(spark):
    v = judged(spark, [("Anna leads the payments team.", "Anna leads payments."), ("Anna leads the team of 5.", "Anna leads the team of 6."), ("Does Anna lead?", "Anna leads."), (None, "Anna leads."), ("  ", "x y"), ("Rain fell.", "Anna leads.")], Cover())
    assert [x.label for x in v] == ["supported", "not_supported", "not_supported", "unjudged", "unjudged", "not_supported"]
    assert v[1].missing == ["6"] and not v[1].checks[0].passed
    assert v[2].evidence is None and v[2].reason.startswith("the source only asks")
    assert v[0].evidence.text == "Anna leads the payments team."


def test_context_and_contradiction(spark):
    source = "The demo is on Friday. It was cancelled."
    scores = {"The demo is on Friday.": (0.9, 0.1), source: (0.1, 0.1)}
    assert judged(spark, [(source, "The demo is on Friday")], fixed(scores))[0].label == "uncertain"
    assert judged(spark, [("It rains.", "It is dry")], fixed({"It rains.": (0.1, 0.97)}))[0].label == "contradicted"
    per = Policy(per_language={"it": Thresholds(0.95, 0.2, 0.8)})
    assert judged(spark, [("Il gatto è nero.", "Il gatto è nero")], fixed({"Il gatto è nero.": (0.9, None)}), per)[0].label == "uncertain"


def test_empty_claim_is_an_error(spark):
    with pytest.raises(Exception, match="a claim is empty"):
        judged(spark, [("x", "  ")], Lexical())


def test_policy(tmp_path):
    p = Policy(version="t", per_language={"it": Thresholds(0.6)})
    file = tmp_path / "kept.json"
    p.save(file)
    assert Policy.load(file) == p
    assert p.with_thresholds(Thresholds(0.7)).per_language == {}
    with pytest.raises(ValueError, match="unknown policy"):
        Policy.from_dict({"nope": 1})
    with pytest.raises(ValueError):
        Thresholds(0.1, 0.2)


def test_metrics(spark):
    rng = random.Random(5)
    rows = [(i, rng.random() < 0.4, round(rng.random(), 2)) for i in range(300)]
    d = spark.createDataFrame(rows, "id int, pos boolean, s double")
    pos, neg = ([s for _, p, s in rows if p is want] for want in (True, False))
    want = sum(1 if a > b else 0.5 if a == b else 0 for b in neg for a in pos) / len(pos) / len(neg)
    assert math.isclose(metrics.auroc(d, "pos", "s").head().auroc, want)
    assert math.isnan(metrics.auroc(d.filter("pos"), "pos", "s").head().auroc)
    for rate in (0.01, 0.05, 0.3):
        cut = metrics.threshold_for_admission(d, "s", rate)
        assert sum(s >= cut for *_, s in rows) <= rate * (len(rows) + 1)
    assert metrics.threshold_for_loss(d, "s", 0.08) == sorted(s for *_, s in rows)[int(0.08 * 301) - 1]
    assert metrics.threshold_for_admission(d, "s", 1.0) == 0.0
    ci = spark.range(1).select(metrics.wilson(F.lit(16), F.lit(30)).alias("c")).head().c
    assert (round(ci.lo, 4), round(ci.hi, 4)) == (0.3614, 0.6977)


def test_review(spark):
    g = spark.createDataFrame([("flagged", 10, 10, 9), ("verified", 30, 10, 3)], "grp string, memories int, reviewed int, not_stated int")
    assert math.isclose(metrics.review_estimate(g).head().estimate, 0.25 * 0.9 + 0.75 * 0.3)
    part = spark.createDataFrame([("flagged", 10, 0, 0), ("verified", 30, 10, 3)], g.schema)
    assert metrics.review_estimate(part).head().estimate is None and metrics.review_estimate(part).head().missing_groups == ["flagged"]
    census = metrics.review_estimate(spark.createDataFrame([("verified", 5, 5, 1)], g.schema)).head()
    assert census.lo == census.hi == census.estimate


def test_audit(spark):
    rows = [("1", "Anna is here.", "Anna is here", ""), ("2", "Rain.", "Snow fell", ""), ("3", "We hired 3.", "We hired 5", ""), ("4", "", "Anna", "")]
    out = audit.audit_pairs(spark.createDataFrame(rows, "id string, source string, memory string, lang string"), judge=Cover())
    s = audit.summary(out).head()
    assert (s.supported, s.not_supported, s.unjudged, s.numeric_violations) == (1, 2, 1, 1) and math.isclose(s.unsupported_share, 2 / 3)
    marks = spark.createDataFrame([("1", True), ("2", False)], "id string, stated boolean")
    assert {r.grp: (r.memories, r.reviewed, r.not_stated) for r in audit.review_groups(out, marks).collect()} == {"verified": (1, 1, 0), "flagged": (2, 1, 1)}


def test_chain(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}", "write", None if i % 2 else f"f{i}", f'{{"a":{i}}}') for i in range(1, 8)], "n int, ts string, kind string, fact_id string, payload string")
    log = chain.build(d, ["n"])
    assert chain.verify(log).head().asDict() == {"ok": True, "events": 7, "first_bad": None, "reason": ""}
    bad = log.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert chain.verify(bad).head()[:3] == (False, 3, 3)
    gap = chain.verify(log.filter("seq <> 4")).head()
    assert (gap.first_bad, gap.reason) == (5, "gap in sequence before 5")
    assert chain.head(log.limit(0)).head().hash == chain.GENESIS
    assert [r.seq for r in chain.tail(log, 2).collect()] == [6, 7]
    odd = chain.build(spark.createDataFrame([(1, None, None, None, None)], "n int, ts string, kind string, fact_id string, payload string"), ["n"])
    assert chain.verify(odd).head().ok
    chain.export(log, str(tmp_path / "log"))
    lines = [json.loads(x) for p in sorted((tmp_path / "log").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["seq"] for x in lines] == list(range(1, 8)) and lines[2]["payload"] == {"a": 3}


def one_by_one(rows):
    """Sequential rule: (arrival, subject, norm, valid_from) all verified."""
    out, held = {}, {}
    for a, subject, norm, since in sorted(rows):
        g = subject or ("", norm)
        if g in held and held[g][2] == norm:
            out[a] = ("verified", held[g][0], None)
        elif g in held and held[g][1] > since:
            out[a] = ("superseded", None, held[g][0])
        else:
            if g in held:
                out[held[g][0]] = ("superseded", out[held[g][0]][1], a)
            out[a], held[g] = ("verified", None, None), (a, since, norm)
    return out


def test_writes_and_supersession(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice("abc"), f"2024-01-{rng.randrange(1, 9):02d}") for i in range(200)]
    d = spark.createDataFrame([(*r, "verified") for r in rows], "arrival long, subject string, norm string, valid_from string, status string")
    got = {r.arrival: (r.status, r.duplicate_of, r.superseded_by) for r in facts.apply_writes(d).collect()}
    assert got == one_by_one(rows)
    distinct = [(a, s, str(a), v) for a, s, _, v in rows if s]
    got = facts.supersede(spark.createDataFrame(distinct, "arrival long, subject string, norm string, valid_from string"), "subject", "valid_from", "arrival", "arrival")
    assert {r.arrival: (r.status, None, r.superseded_by) for r in got.collect()} == one_by_one(distinct)


def test_forget_and_review(spark):
    f = spark.createDataFrame([("a", "t1", "s1", "verified", "", None), ("b", "t2", "s1", "unverified", "", None), ("c", "t3", "s2", "quarantined", "", None)], "id string, text string, source_id string, status string, reason string, reviewed_by string")
    s = spark.createDataFrame([("s1", "o", "user"), ("s2", "o", "web"), ("s3", "o", "web")], "id string, origin string, author string")
    left, sources = facts.forget(f, s, spark.createDataFrame([("a",), ("c",)], "id string"))
    assert {r.id: r.text for r in left.collect()} == {"a": "", "b": "t2", "c": ""}
    assert {r.id for r in sources.collect()} == {"s1", "s3"}
    done = facts.review(f, spark.createDataFrame([("b", True, "Kim")], "id string, approve boolean, reviewer string"))
    assert {r.id: r.status for r in done.collect()}["b"] == "verified"
    twice = spark.createDataFrame([("b", True, "Kim"), ("b", False, "Kim")], "id string, approve boolean, reviewer string")
    with pytest.raises(Exception, match="more than once"):
        facts.review(f, twice).collect()
    with pytest.raises(Exception, match="cannot review"):
        facts.review(f, spark.createDataFrame([("a", True, "Kim")], "id string, approve boolean, reviewer string")).collect()


def test_search(spark):
    rows = [(1, "The delivery was relational and fast", "verified"), (2, "Deliveries are late", "verified"), (3, "Nothing here", "unverified"), (4, "", "forgotten"), (5, "late late late", "verified")]
    f = spark.createDataFrame(rows, "rowid long, text string, status string")
    q = spark.createDataFrame([("x", "deliveries late"), ("y", "zebra")], "q_id string, q string")
    hits = search.recall(f, q, k=3).orderBy("rank").collect()
    assert [r.rowid for r in hits] == [2, 5, 1]
    questions = spark.createDataFrame([("x", "late?", "en"), ("y", "zebra?", "en")], "q_id string, q string, language string")
    cands = spark.createDataFrame([("x", 1, "A", 1), ("x", 2, "B", 2), ("x", 3, "C", 3)], "q_id string, rowid long, text string, rank int")
    out = {r.q_id: r for r in search.ask(cands, questions, fixed({"A": (0.9, None), "B": (0.11, None), "C": (0.01, None)}), Policy()).collect()}
    assert [a.rowid for a in out["x"].answers] == [1] and [a.rowid for a in out["x"].related] == [2] and out["y"].abstained
    assert search.ask(cands, questions, Lexical(), Policy()).filter("NOT abstained").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Fonte;Memoria;Lingua\n"due\nrighe";uno;it\nx; ;it\ny;z;\n', encoding="utf-8")
    rows = records.load_audit_rows(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [(r.id, r.source, r.memory, r.lang) for r in rows] == [("1", "due\nrighe", "uno", "it"), ("3", "y", "z", "")]
    (tmp_path / "b.jsonl").write_text('{"source": "a b", "claim": "c", "label": "supported"}\n\n{"source": "", "claim": "c", "label": "N"}\n', encoding="utf-8")
    assert [tuple(r) for r in records.load_pairs(spark, str(tmp_path / "b.jsonl")).collect()] == [("0", "a b", "c", "S", "")]
    (tmp_path / "q.json").write_text('{"facts": [{"id": "f", "text": "t"}], "questions": [{"q": "w", "answer": ["f"]}, {"q": "v", "answer": []}]}')
    (tmp_path / "c.JSONL").write_text('{"premise": "a", "hypothesis": "b", "label": "c", "lang": "EN", "id": ""}\n{"premise": " ", "hypothesis": "b", "label": "N"}\n', encoding="utf-8")
    assert [tuple(r) for r in records.load_pairs(spark, str(tmp_path / "c.JSONL")).orderBy("id").collect()] == [("", "a", "b", "C", "en"), ("1", " ", "b", "N", "")]
    (tmp_path / "d.json").write_text('[{"source": "a\u2028b", "memory": "m"}, {"source": "x", "memory": " "}]', encoding="utf-8")
    assert [tuple(r) for r in records.load_audit_rows(spark, str(tmp_path / "d.json")).collect()] == [("1", "a\u2028b", "m", "")]
    (tmp_path / "e.txt").write_text("one\ntwo")
    assert records.read_text(spark, str(tmp_path / "e.txt")).head()[0] == "one\ntwo"
    f, q = records.load_questions(spark, str(tmp_path / "q.json"))
    assert f.count() == 1 and [list(r.want) for r in q.orderBy("q_id").collect()] == [["f"], []]


def test_stream(spark, tmp_path):
    from attestry.streaming.supersession import stream_supersede

    schema = "subject string, id string, valid_from string, arrival int"
    pd.DataFrame([("s", "a", "2024-01-02", 1), ("s", "b", "2024-01-01", 2), ("s", "c", "2024-01-03", 3), (None, "d", "2024-01-03", 4), (None, "e", "2024-01-04", 5), ("", "f", "2024-01-01", 6)], columns=["subject", "id", "valid_from", "arrival"]).to_json(tmp_path / "1.json", orient="records", lines=True)
    stream = spark.readStream.schema(schema).json(str(tmp_path))
    q = stream_supersede(stream).writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.table("changes").collect()]
    assert sorted(got, key=str) == sorted([("s", "a", "verified", None), ("s", "b", "superseded", "a"), ("s", "a", "superseded", "c"), ("s", "c", "verified", None), (None, "d", "verified", None), (None, "e", "verified", None), ("", "f", "verified", None)], key=str)
