"""What grows with the input: the same results as by hand, in work that a large table can afford."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from attestry.functions import parts, quantities
from attestry.functions import text as T
from attestry.functions.hashes import first_words
from attestry.operators import chain, evaluation, facts, metrics, search
from attestry.plans import catalogue
from attestry.policy import Policy


def test_first_words():
    prefixes, keys = [b"boot:1:", b"boot:22:", b"", b"9:"], [b"S1", b"N23", b"", "é".encode(), b"x" * 46, b"y" * 90]
    want = [[int(hashlib.md5(p + k).hexdigest()[:8], 16) for k in keys] for p in prefixes]
    assert first_words(prefixes, keys).tolist() == want


def test_bootstrap_by_hand(spark):
    """Every round against its weights row by row, and no row written once a round."""
    rng = random.Random(4)
    rows = [(f"S{i}" if i % 9 else None, rng.random() < 0.5, rng.choice([0.0, 1.0, rng.random(), None])) for i in range(1500)]
    d = spark.createDataFrame(rows, "id string, pos boolean, support double")
    limits = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(7)])
    out = metrics.bootstrap_auroc(d, "id", "pos", "support", rounds=7)
    assert "explode" not in out._jdf.queryExecution().toString()
    got = {r["round"]: r.auroc for r in out.collect()}
    for n in range(1, 8):
        u = [int(hashlib.md5(":".join(["boot", str(n), *([] if k is None else [k])]).encode()).hexdigest()[:8], 16) / 2**32 for k, *_ in rows]
        w = [int((limits <= x).sum()) for x in u]
        s = np.array([-1.0 if x is None else x for *_, x in rows])  # nulls come first
        pos, neg = (np.array([x if p is want else 0 for x, (_, p, _) in zip(w, rows, strict=True)]) for want in (True, False))
        wins = sum(p * ((neg * (s < x)).sum() + (neg * (s == x)).sum() / 2) for p, x in zip(pos, s, strict=True) if p)
        assert math.isclose(got[n], wins / pos.sum() / neg.sum())


def test_chain_in_pieces(spark, monkeypatch):
    """The log of many pieces is that of one task, and no task puts more than a piece in order."""
    rng = random.Random(2)
    rows = [(i, f"k{i % 7}", rng.choice(["a", None]), f"t{i % 3}", f"p{rng.random()}") for i in rng.sample(range(3000), 3000)]
    d = spark.createDataFrame(rows, "n int, kind string, fact_id string, ts string, payload string").repartition(5)
    whole = sorted(map(tuple, chain.build(d, ["n", "fact_id"], "1" * 64, 9).collect()))
    monkeypatch.setattr(chain, "PIECE", 700)
    log = chain.build(d, ["n", "fact_id"], "1" * 64, 9)
    assert log.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).head()[0] < 2000
    assert sorted(map(tuple, log.collect())) == whole and whole[0][5] == "1" * 64 and len(whole) == 3000
    assert chain.verify(chain.build(d, ["n"])).head().asDict() == {"ok": True, "events": 3000, "first_bad": None, "reason": ""}


def test_writes_stream(spark):
    """Subjects over many batches fold as one by one, and no group becomes a frame of its own."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["p", "q", "", None]), rng.choice("ab"), rng.choice(["verified", "verified", "unverified"]), f"2024-01-{rng.randrange(1, 9):02d}") for i in range(400)]
    d = spark.createDataFrame(rows, "arrival long, subject string, norm string, status string, valid_from string")
    held, want = {}, {}
    for a, subject, norm, status, since in rows:
        g = (subject, subject or norm)
        now = held.get(g)
        want[a] = [status, None, None]
        if status == "verified" and now and now[0] == norm:
            want[a][1] = now[2]
        elif status == "verified" and now and now[1] > since:
            want[a] = ["superseded", None, now[2]]
        elif status == "verified":
            if now:
                want[now[2]][0], want[now[2]][2] = "superseded", a
            held[g] = (norm, since, a)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = facts.apply_writes(d)
        assert {r.arrival: [r.status, r.duplicate_of, r.superseded_by] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_texts_read_once(spark, tmp_path):
    """A search and a calibration stage what they make of texts: their plans and those of their figures hold no tokens' expressions."""
    rows = [(1, "The delivery was relational and fast", "verified"), (2, "Deliveries are late", "verified"), (3, "", "unverified")]
    f = spark.createDataFrame(rows, "rowid long, text string, status string")
    hits = search.recall(f, spark.createDataFrame([("x", "deliveries late")], "q_id string, q string"), k=3)
    assert "regexp_extract_all" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert [r.rowid for r in hits.orderBy("rank").collect()] == [2, 1]
    read = spark.sparkContext.accumulator(0)
    pairs = [(str(i), "SN"[i % 2], "en", "supported", (i % 7) / 7, True) for i in range(60)]

    @F.udf("double")
    def costly(x):
        read.add(1)
        return x

    d = spark.createDataFrame(pairs, "id string, label string, lang string, verdict string, support double, judged boolean").withColumn("support", costly("support"))
    evaluation.calibrate(d, Policy(), rounds=2)
    assert read.value == 60


def test_parts_hold_few_rows():
    """Python objects are made of a part of a batch at a time; the array is the same."""
    import pyarrow as pa

    seen = []
    t = pa.array([None, "a" * 10, ""] * 3000 + ["b" * (1 << 20)] * 4)
    out = parts.in_parts(lambda x: (seen.append(len(x)), pa.array(x, pa.string()))[1], pa.string(), t)
    assert out.equals(t) and max(seen) <= parts.PART_ROWS and len(seen) > 10
    assert parts.in_parts(lambda x: pa.array(x, pa.string()), pa.string(), t.slice(0, 0)).equals(t.slice(0, 0))


def test_trigrams_stay_out_of_lambdas(spark):
    d = spark.createDataFrame([(1, "Ab  abé\U0001f600 "), (2, ""), (3, None)], "i int, t string").select("i", T.char_trigrams(F.col("t")).alias("g"))
    assert "transform" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.g for r in d.collect()} == {1: sorted(T.py_trigrams("Ab  abé\U0001f600 ")), 2: ["    "[:3]], 3: None}


def test_missing_quantities_before_the_join(spark, tmp_path):
    docs = [(1, "We hired 5.\nx", "en"), (2, "They hired 7.\ny", "en"), (3, "He had due cani.", "it"), (4, None, "en"), (5, "12 of 5", "en"), (6, "5 of 12", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    d = catalogue.missing_quantities(spark, str(tmp_path))
    assert {r.doc_id: r.missing for r in d.collect()} == {1: ["7"], 4: ["12", "5"]}
    joins = [x for x in d._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and "text" not in d._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_words_are_judged_once():
    quantities._worth.cache_clear()
    assert [q.surface for q in quantities.extract("three cats and three dogs, a1two")] == ["three", "three", "two"]
    assert quantities._worth.cache_info().hits == 1
