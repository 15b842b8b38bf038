import hashlib
import random

from attestry.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, b int, tail string"


def brute(rows):
    rows = sorted(rows, key=lambda r: hashlib.md5((r[1] or "").encode()).hexdigest())
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (k, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        s, e, x = (fp.sketch(v.encode()) for v in (t, edited, nxt))
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(s), fp.to_text(e), fp.likeness(s, e), fp.likeness(s, x)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 101, "".join(rng.choice("abcdé 漢\n") for _ in range(rng.choice([0, 1, 5, 15, 16, 17, 300]))), i, None) for i in range(100)]
    rows += [(5, None, 1, "x"), (5, None, 1, "x"), (5, "z" * 40, 1, "x"), (None, "no key", 1, ""), (None, None, 1, ""), (200, "q" * 100_000, 0, "")]
    for size in (5000, 9, 1):
        got = sorted(map(tuple, fp.fingerprint_with_next(spark.createDataFrame(rows, SCHEMA), bucket_docs=size).collect()), key=str)
        assert got == brute(rows)


def test_single_and_empty(spark):
    one = fp.fingerprint_with_next(spark.createDataFrame([(1, "only one", 0, "")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == brute([(1, "only one")])
    assert fp.fingerprint_with_next(spark.createDataFrame([], SCHEMA)).collect() == []


def test_unequal_lengths():
    words = [f"w{i}" for i in range(4000)]
    part, whole = fp.sketch(" ".join(words[500:900]).encode()), fp.sketch(" ".join(words).encode())
    assert fp.containment(part, whole) > 0.95 and fp.containment(whole, part) < 0.2
    assert fp.likeness(fp.merge(part, whole), fp.merge(whole, part)) == 1
    assert list(fp.from_text(fp.to_text(part))) == list(part)
