import json
import math

from attestry import cli
from attestry.operators import reports
from attestry.policy import Policy


def test_commands(spark, tmp_path, capsys):
    store = ["--store", str(tmp_path / "store"), "--judge", "cover"]

    def run(*args, code=0):
        capsys.readouterr()
        assert cli.run(spark, [*store, *args]) == code
        return capsys.readouterr().out

    assert json.loads(run("check", "Anna leads", "--source-text", "Anna leads the team."))["label"] == "supported"
    fact = json.loads(run("remember", "Anna leads the team", "--source-text", "Anna leads the team.", "--author", "user"))
    assert fact["status"] == "verified"
    assert json.loads(run("recall", "who leads"))["id"] == fact["fact_id"]
    assert json.loads(run("chain", "--export", str(tmp_path / "log")))["ok"]
    assert json.loads(run("doctor"))["oriented"]
    run("review", "nope", "approve", "Kim", code=2)
    (tmp_path / "empty.csv").write_text("source,memory\n")
    run("audit", str(tmp_path / "empty.csv"), str(tmp_path / "none"), code=2)


def test_audit_and_its_review(spark, tmp_path, capsys):
    (tmp_path / "pairs.jsonl").write_text('{"id": "1", "source": "Anna is here.", "memory": "Anna is <b>here</b>"}\n{"id": "2", "source": "We hired 3.", "memory": "We hired 5"}\n')
    out = tmp_path / "report"
    assert cli.run(spark, ["--judge", "lexical", "audit", str(tmp_path / "pairs.jsonl"), str(out), "--lang", "it"]) == 0
    page, text = (out / "report.html").read_text(), (out / "report.md").read_text()
    assert "Affidabilità" in text and "non è un modello" in text and "Assente dalla fonte: 5" in text and "<b>here" not in page
    assert json.loads((out / "report.json").read_text())["numeric_violations"] == 1
    (tmp_path / "sheet.csv").write_text("id,stated_by_source\n2,no\n")
    capsys.readouterr()
    assert cli.run(spark, ["audit-review", str(out), str(tmp_path / "sheet.csv")]) == 0
    assert "| flagged | 1 | 1 | 1 |" in capsys.readouterr().out


def test_other_reports():
    c = dict.fromkeys(("questions", "answerable", "answered_right", "wrong_fact", "wrong_abstentions", "retrieval_misses", "right_abstentions", "false_answers", "right_in_related", "unanswerable_with_related"), 3)
    assert "right 3" in reports.ask_markdown(c, "set", "j", 0.4)
    r = {f"{x}_{k}": 1 for x in "SNC" for k in ("pairs", "supported")} | dict.fromkeys(("auroc_s_vs_n", "auroc_s_vs_nc", "lo", "hi", "true_lost", "unstated_admitted"), math.nan)
    page = reports.evaluation_markdown(r, [{"id": "a", "label": "S", "verdict": "uncertain", "support": 0.3}, {"id": "b", "label": "N", "verdict": "supported", "support": 0.9}], "set", "j", "p")
    assert page.index("though not stated") < page.index("though not supported") and "n/a" in page
    done = reports.review_markdown([{"grp": "flagged", "memories": 2, "reviewed": 2, "not_stated": 1}], {"missing_groups": [], "estimate": 0.5, "lo": 0.5, "hi": 0.5})
    assert "Every memory was reviewed" in done
    assert Policy.load("default").window_sizes == (1, 2) and Policy.names() == ["default"]
