import random
import re
from itertools import combinations

import numpy as np
import pytest

from attestry.llm import crosspolytope, minhash, neardup, paragraphs, queries
from attestry.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, n, least=1):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < least or not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def components(sets, percent):
    """Least index reachable, by all pairs."""
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return [root(i) for i in range(len(sets))]


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [64, 4])
def test_minhash_against_all_pairs(spark, monkeypatch, few):
    """Also with nearly all buckets settled in blocks, and blocks of a few items."""
    monkeypatch.setattr(neardup, "FEW", few)
    if few < 64:
        monkeypatch.setattr(neardup, "BLOCK", 16)
        monkeypatch.setattr(neardup, "FAR", 1)
        monkeypatch.setattr(neardup, "DENSE", 8)
    rng = random.Random(few)
    texts = [t for _ in range(6) for t in family(rng, 120, rng.randrange(2, 60), 9)]
    texts += [None, "", "   ", "one", "ONE", "one two", "one two three", "a\tb\nc d", "a b c d", "é É é", "x " * 5000]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(10 * i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, n string, item int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_dedup(docs).collect()}
    sets = [shingle_set(t, 3) for t in texts]
    want = components(sets, 85)
    assert got == {10 * i: (len(s), 10 * want[i], want[i] == i) for i, s in enumerate(sets)}


def test_minhash_odd_keys(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t"), (7, "z y x w"), (7, "m n o p"), (3, "m n o p")]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (7, 7), (7, 3), (3, 3)], key=str)
    assert minhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_paragraphs_against_all_pairs(spark):
    rng = random.Random(3)
    pool = [t for _ in range(5) for t in family(rng, 60, 12, 3)] + ["short line", "w " * 19]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(40)] + [None, "", "\n\n", " ".join(f"u{i}" for i in range(80))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, paragraph int")
    lines = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]
    sets = [shingle_set(x, 5, paragraphs.LEAST) for *_, x in lines]
    root = components(sets, 80)
    size = {r: root.count(r) for r in root}
    want = {(*lines[k][:2], *lines[root[k]][:2], root[k] != k) for k in range(len(lines)) if sets[k] and size[root[k]] > 1}
    found = paragraphs.repeated_paragraphs(docs)
    assert {(r.doc_id, r.paragraph, r.component_doc_id, r.component_paragraph, r.removed) for r in found.collect()} == want
    gone = {w[:2] for w in want if w[4]}
    kept = {r.doc_id: r.text for r in paragraphs.without_repeats(docs, found).collect()}
    assert kept == {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)}


def test_passages_against_all_windows(spark):
    """Each 50 words that occur twice hold a run with a row, and each row's words occur twice."""
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared = [new(rng.randrange(50, 90)) for _ in range(6)]
    texts = []
    for _ in range(30):
        words = new(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        texts.append("".join(w.upper() + rng.choice([" "] * 12 + ["\n", "\t"]) for w in words))
    texts += [None, "", "x " * 300, "a b c " * 60, " ".join(new(17) * 9), " ".join(shared[0]), "\n".join(shared[1]), " ".join(shared[2][:49])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, word int")
    words = [(t or "").lower().split() for t in texts]
    got = [tuple(r) for r in paragraphs.repeated_passages(docs).collect()]
    at = lambda i, p, n: tuple(words[i][p : p + n])
    places = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            places.setdefault(at(i, p, 50), []).append((i, p))
    rows = {(i, p) for i, p, *_ in got}
    assert len(rows) == len(got) > 20
    again = [x for v in places.values() if len(v) > 1 for x in v]
    assert len(again) > 200 and all(any((i, q) in rows for q in range(p, p + 31)) for i, p in again)
    for i, p, n, j, q, removed in got:
        assert n == 20 and at(i, p, 20) == at(j, q, 20) and removed == ((i, p) != (j, q)) and (j, q) in rows
        assert removed or sum(at(a, b, 20) == at(i, p, 20) for a, b in rows) > 1
    null = spark.createDataFrame([(None, " ".join(shared[0])), (4, " ".join(shared[0]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_doc_id, r.removed) for r in paragraphs.repeated_passages(null).collect()} == {(4, 4, False), (None, 4, True)}
    assert paragraphs.repeated_passages(docs.limit(0)).collect() == []


def test_short_lines(spark, tmp_path):
    """The query for lines of five words or more, by all pairs."""
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in range(1, 26) for _ in range(2)]
    pool += [" ".join(x.split()[:-1] + ["end"]) for x in pool if len(x.split()) > 13]
    lines = [(i, p, rng.choice(pool)) for i in range(40) for p in range(4)]
    docs = [(i, "\n".join(x for j, _, x in lines if j == i)) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = [shingle_set(x, 5, 5) for *_, x in lines]
    root = components(sets, 80)
    want = {(*lines[k][:2], *lines[root[k]][:2], root[k] != k) for k in range(len(lines)) if sets[k] and root.count(root[k]) > 1}
    got = queries.QUERIES["op7_lines"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.paragraph, r.component_doc_id, r.component_paragraph, r.removed) for r in got} == want
    assert any(r.n_words == 5 for r in got) and queries.ORACLE_SQL["op7_paragraph_bands"] == paragraphs.op7_sql(20)


def test_bands():
    bands, rows = paragraphs.tune(0.8)
    assert (1 - 0.8**rows) ** bands < 1e-4 and bands * rows <= 48


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(crosspolytope, "BLOCK", 8)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 24))
    vectors = [(b + rng.standard_normal(24) * s).tolist() for b in base for s in rng.uniform(0, 0.2, 25)]
    vectors += [vectors[0], vectors[0], [0.0] * 24, None, [1.0, None], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1e-30] * 24, [3.0, 4.0], [6.0, 8.0], [], [2.0], [5.0], [-2.0]]
    rows = [(i, v, None if i % 50 == 7 else i % 2, 1) for i, v in enumerate(vectors)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in crosspolytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long")).collect()}

    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = {i: set() for i, *_ in rows}
    for (i, v, a, _), (j, w, b, _) in combinations(rows, 2):
        if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
            x, y = (np.array(t) / np.abs(t).max() for t in (v, w))
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    want = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        want[i] = (len(links[i]), min(seen), min(seen) == i)
    assert got == want
    assert crosspolytope.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components_of_long_and_wide_graphs(spark):
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(5000, i) for i in range(1000, 1400)] + [(i, 5000) for i in range(1000, 1010)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 1000 for i in [5000, *range(1000, 1400)]} | {8: 8, 9: 8}
