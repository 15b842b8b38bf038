import math
import random

import pytest

from attestry.operators import evaluation, metrics
from attestry.policy import Policy, Thresholds

SCHEMA = "id string, label string, lang string, verdict string, support double, judged boolean"


def pairs(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = rng.choice("SSNNC")
        s = round(min(1.0, max(0.0, rng.gauss(0.7 if label == "S" else 0.3, 0.2))), 3)
        checked = rng.random() > 0.1
        s = s if checked else 0.0
        out.append((str(i), label, rng.choice(["en", "it", ""]), "supported" if s >= 0.5 else "not_supported", s, checked))
    return out


def area(pos, neg):
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)


def test_report(spark):
    rows = pairs()
    got = evaluation.evaluate_verifier(spark.createDataFrame(rows, SCHEMA), bootstrap_rounds=40, held_out_rounds=10).head().asDict()
    by = {k: [r[4] for r in rows if r[1] == k] for k in "SNC"}
    assert math.isclose(got["auroc_s_vs_n"], area(by["S"], by["N"])) and math.isclose(got["auroc_s_vs_nc"], area(by["S"], by["N"] + by["C"]))
    assert got["lo"] < got["auroc_s_vs_n"] < got["hi"] and got["S_pairs"] == len(by["S"])
    assert math.isclose(got["C_supported"], sum(s >= 0.5 for s in by["C"]) / len(by["C"]))
    assert abs(got["true_lost"] - 0.08 - sum(not r[5] for r in rows if r[1] == "S") / len(by["S"])) < 0.08
    wrong = {r.id for r in evaluation.errors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert wrong == {r[0] for r in rows if (r[1] == "S") != (r[3] == "supported")}
    langs = {r.lang: r for r in evaluation.by_language(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(langs) == {"en", "it"} and langs["it"].pairs == sum(r[2] == "it" for r in rows)
    empty = evaluation.evaluate_verifier(spark.createDataFrame([], SCHEMA), 5, 5).head()
    assert math.isnan(empty.auroc_s_vs_n) and math.isnan(empty.lo) and math.isnan(empty.S_supported)


@pytest.mark.parametrize("cap", [None, 0.05, 1.0])
def test_held_out_against_halves(spark, cap):
    """Every round by hand: its halves, its threshold and what the other half loses and admits."""
    rows = [r for r in pairs(120) if r[1] != "S" or r[5]]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.round: r for r in metrics.held_out(d, "id", "label", "support", "judged", rounds=5, max_admitted=cap).collect()}
    import hashlib

    first = lambda n, k: int(hashlib.md5(f"{n}:{k}".encode()).hexdigest()[:8], 16) / 2**32 < 0.5
    assert set(got) == set(range(1, 6))
    for n, r in got.items():
        if cap is None:
            cal = sorted(x[4] for x in rows if x[1] == "S" and first(n, x[0]))
            assert r.threshold == cal[max(1, int(0.08 * (len(cal) + 1))) - 1]
        else:
            cal = sorted((x[4] for x in rows if x[1] != "S" and first(n, x[0])), reverse=True)
            k = int(cap * (len(cal) + 1))
            assert r.threshold == 0.0 if k >= len(cal) else sum(s >= r.threshold for s in cal) <= k and any(r.threshold - 1.01e-4 <= s < r.threshold for s in cal)
        test = [x for x in rows if not first(n, x[0])]
        share = lambda label, f: sum(f(x[4]) for x in test if x[1] == label) / sum(x[1] == label for x in test)
        assert math.isclose(r.true_lost, share("S", lambda s: s < r.threshold), abs_tol=1e-12)
        assert math.isclose(r.unstated_admitted, share("N", lambda s: s >= r.threshold), abs_tol=1e-12)


def test_admission_never_admits_more(spark):
    rng = random.Random(1)
    for n in (5, 40, 41):
        values = [rng.choice([rng.random(), 0.5, 0.123456]) for _ in range(n)]
        d = spark.createDataFrame([(v,) for v in values], "s double")
        for rate in (0.0, 0.05, 0.3):
            cut = metrics.threshold_for_admission(d, "s", rate)
            assert sum(v >= cut for v in values) <= int(rate * (n + 1)) and cut == round(cut, 4)


def test_calibrate(spark):
    d = spark.createDataFrame(pairs(), SCHEMA)
    new, story = evaluation.calibrate(d, Policy(), rounds=5)
    true = sorted(r[4] for r in pairs() if r[1] == "S" and r[5])
    assert new.support == round(true[int(0.08 * (len(true) + 1)) - 1], 4) and new.uncertain <= new.support
    capped, told = evaluation.calibrate(d, Policy(), max_admitted=0.05, rounds=5)
    assert sum(r[4] >= capped.support for r in pairs() if r[1] != "S") <= 0.05 * 301 and capped.uncertain == 0.2
    assert story["pairs"]["S"] == sum(r[1] == "S" for r in pairs()) and told["held_out_true_lost"] is not None
    p = Policy(per_language={"it": Thresholds(0.6)}).with_thresholds(new, "2", story)
    assert p.version == "2" and p.calibration == story and p.per_language == {}
    with pytest.raises(ValueError):
        evaluation.calibrate(d.limit(5), Policy())


def test_review_sizes(spark):
    got = {r["size"]: r for r in evaluation.review_sizes(spark, {"flagged": (100, 0.9), "verified": (300, 0.05)}, [10, 50], trials=30).collect()}
    assert got[50].width < got[10].width and got[50].coverage > 0.7


def test_window_budget_and_precision(spark):
    d = spark.createDataFrame([("a", k, s) for k, s in enumerate([0.2, 0.9, 0.1])], "id string, ord int, entailment double")
    assert [(r.k, r.support) for r in evaluation.window_budget(d).orderBy("k").collect()] == [(1, 0.2), (2, 0.9), (3, 0.9)]
    one, two = (spark.createDataFrame([("a", x), ("b", 0.1)], "id string, support double") for x in (0.49, 0.51))
    r = evaluation.precision(one, two, 0.5).head()
    assert (r.pairs, r.crossed) == (2, 1) and math.isclose(r.max_gap, 0.02)
