import random

from attestry.llm.quotations import _latest, link_quotations

SCHEMA = "conv_id long, turn long, role string, text string, body string"


def run(spark, rows):
    out = link_quotations(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    return {(r.conv_id, r.turn, r.role): r for r in out}, len(out)


def test_nested_quotes(spark):
    got, n = run(spark, [
        (1, 0, "a", "First idea: use Spark.\nSecond line."),
        (1, 1, "b", "> First idea: use  spark\nI agree."),
        (1, 2, "c", "Something new."),
        (1, 3, "a", "> > First idea: use Spark.\n> I agree.\nGood."),
        (1, 4, "b", "> never said\nHm."),
        (2, 0, "a", "> I agree.\nOther conversation."),
    ])
    assert n == 6
    assert got[1, 1, "b"].reply_to == 0 and got[1, 1, "b"].body == "I agree." and got[1, 1, "b"].n_linked == 1
    assert (got[1, 3, "a"].reply_to, got[1, 3, "a"].n_linked, got[1, 3, "a"].depth, got[1, 3, "a"].n_quotes) == (1, 2, 2, 2)
    assert (got[1, 4, "b"].reply_to, got[1, 4, "b"].n_linked) == (3, 0)
    assert got[2, 0, "a"].reply_to is None and got[2, 0, "a"].n_linked == 0
    assert sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_odd_rows(spark):
    rows = [(1, 0, "a", None), (1, 0, "a", None), (1, 1, "a", "> ...\n"), (None, 0, "a", "x"), (None, 1, "b", "> x"), (1, None, "a", ""), (3, 5, None, "> " * 50 + "deep"), (4, 0, "a", "w " * 50_000)]
    got, n = run(spark, rows)
    assert n == len(rows)
    assert got[None, 1, "b"].reply_to == 0 and got[None, 1, "b"].n_linked == 1
    assert got[3, 5, None].depth == 50
    assert run(spark, [])[1] == 0


def test_latest_across_blocks(spark):
    rng = random.Random(4)
    said = sorted({(rng.choice("ab"), rng.randrange(3), rng.randrange(30_000)) for _ in range(60)})
    asked = sorted({(rng.choice("abc"), rng.randrange(3), rng.randrange(30_000)) for _ in range(200)} | {(c, h, t) for c, h, t in said[:20]})
    a = spark.createDataFrame([(c, str(h), t) for c, h, t in said], "c string, h string, from long")
    b = spark.createDataFrame([(c, str(h), t) for c, h, t in asked], "c string, h string, turn long")
    got = {(r["c"], r["h"], r["turn"]): r["from"] for r in _latest(a, b).collect()}
    want = {(c, str(h), t): max(u for x, y, u in said if (x, y) == (c, h) and u < t) for c, h, t in asked if any((x, y) == (c, h) and u < t for x, y, u in said)}
    assert got == want and len(want) > 50
