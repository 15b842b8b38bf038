import itertools

import pytest
from pyspark.sql import functions as F

from attestry.judges import Cover, Lexical
from attestry.memory import Memory
from attestry.operators.verify import status_for
from attestry.storage import Conflict

SCHEMA = "arrival long, claim string, source string, author string, origin string, subject string, observed_at string, written_by string"


def clock():
    n = itertools.count()
    return lambda: f"2026-01-01T00:00:{next(n):02d}.000000Z"


def item(n, claim, subject=None, at=None, author="user", source=None):
    return (n, claim, claim if source is None else source, author, f"note {n}", subject, at, "tester")


def remember(m, *items):
    return {r.arrival: r for r in m.remember(m.spark.createDataFrame(list(items), SCHEMA)).collect()}


def test_life_of_facts(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), judge=Cover(), clock=clock())
    got = remember(m, item(1, "Anna leads the payments team", "lead", "2026-01-02"), item(2, "Boris plays chess"), item(3, "Unrelated words", source="Something else."), item(4, "From the web", author="web"))
    assert [got[i].status for i in (1, 2, 3, 4)] == ["verified", "verified", "quarantined", "unverified"]
    again = remember(m, item(5, "boris PLAYS chess!", source="Boris plays chess."), item(6, "Carla leads the payments team", "lead", "2026-01-03"), item(7, "Dora leads the payments team", "lead", "2026-01-01"))
    assert again[5].duplicate_of == got[2].fact_id and again[5].fact_id == got[2].fact_id
    assert again[6].status == "verified" and again[7].status == "superseded" and again[7].superseded_by == again[6].fact_id
    facts = {r.id: r for r in m.facts.collect()}
    assert len(facts) == 6 and sorted(r.rowid for r in facts.values()) == [1, 2, 3, 4, 6, 7]
    assert facts[got[1].fact_id].status == "superseded" and facts[got[1].fact_id].superseded_by == again[6].fact_id
    assert [r.id for r in m.history("lead").collect()] == [again[7].fact_id, got[1].fact_id, again[6].fact_id]
    assert m.stats()["chain"]["ok"] and m.stats()["facts"]["verified"] == 2
    hits = m.recall(spark.createDataFrame([("q", "who plays chess")], "q_id string, q string")).collect()
    assert [r.id for r in hits] == [got[2].fact_id]
    assert m.where("status = 'verified'", ("-rowid",), 1).head().id == again[6].fact_id

    # review: the approved web fact is verified, and supersedes nothing without a subject
    queue = [r.id for r in m.review_queue().collect()]
    assert queue == [got[4].fact_id, got[3].fact_id]
    m.review(spark.createDataFrame([(got[4].fact_id, True, "Kim"), (got[3].fact_id, False, "Kim")], "id string, approve boolean, reviewer string"))
    status = {r.id: r.status for r in m.facts.collect()}
    assert status[got[4].fact_id] == "verified" and status[got[3].fact_id] == "rejected"

    # forgetting leaves nothing in any file
    m.forget(spark.createDataFrame([(got[2].fact_id,)], "id string"))
    m.forget(spark.createDataFrame([(got[2].fact_id,)], "id string"))
    gone = {r.id: r for r in m.facts.collect()}[got[2].fact_id]
    assert (gone.status, gone.text, gone.norm, gone.source_id) == ("forgotten", "", "", None)
    assert not any(b"oris" in p.read_bytes() for p in (tmp_path / "store").rglob("*.parquet"))
    assert [r.kind for r in m.events.orderBy("seq").collect()].count("forget") == 1 and m.stats()["chain"]["ok"]
    with pytest.raises(KeyError):
        m.get(spark.createDataFrame([("nope",)], "id string"))


def test_an_approved_fact_supersedes(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "store"), judge=Cover(), clock=clock())
    got = remember(m, item(1, "Anna leads", "lead", "2026-01-02"), item(2, "Boris leads", "lead", "2026-01-03", author="web"), item(3, "Carla leads", "lead", "2026-01-01", author="web"))
    changed = m.review(spark.createDataFrame([(got[2].fact_id, True, "Kim"), (got[3].fact_id, True, "Kim")], "id string, approve boolean, reviewer string"))
    assert {r.id: (r.status, r.superseded_by) for r in changed.collect()} == {got[2].fact_id: ("verified", None), got[1].fact_id: ("superseded", got[2].fact_id), got[3].fact_id: ("superseded", got[2].fact_id)}
    assert [r.kind for r in m.events.orderBy("seq").collect()] == ["write"] * 3 + ["review", "supersede"] * 2 and m.stats()["chain"]["ok"]


def test_batches_do_as_one_by_one(spark, tmp_path):
    words = ["Anna leads", "Boris leads", "Carla leads"]
    items = [item(i, words[i * 7 % 3], ["a", None][i % 4 == 3], f"2026-01-{1 + i * 5 % 9:02d}") for i in range(9)]
    whole, single = (Memory(spark, str(tmp_path / x), judge=Cover(), clock=clock()) for x in "ws")
    remember(whole, *items)
    for part in (items[:4], items[4:5], items[5:]):
        remember(single, *part)
    state = lambda m: sorted((r.text, r.subject or "", r.valid_from, r.status) for r in m.facts.collect())
    assert state(whole) == state(single)


def test_one_writer(spark, tmp_path):
    one = Memory(spark, str(tmp_path / "store"), judge=Lexical(), clock=clock())
    two = Memory(spark, str(tmp_path / "store"), judge=Lexical(), clock=clock())
    assert remember(one, item(1, "Anna leads"))[1].status == "unverified"  # not a model
    with pytest.raises(Conflict):
        remember(two, item(1, "Anna leads"))
    meta = tmp_path / "store" / "meta.json"
    meta.write_text(meta.read_text().replace('"schema_version": 2', '"schema_version": 1'))
    (tmp_path / "store" / ".meta.json.crc").unlink(missing_ok=True)
    with pytest.raises(RuntimeError):
        Memory(spark, str(tmp_path / "store"))


def test_truth_table(spark):
    for label in ("supported", "not_supported", "contradicted", "uncertain", "unjudged"):
        for trusted, model in itertools.product((True, False), repeat=2):
            got = spark.range(1).select(status_for(F.lit(label), F.lit(trusted), model)).head()[0]
            assert (got == "verified") == (label == "supported" and trusted and model)
