"""Nulls, repeated rows, clashing columns, empty tables and long texts."""

import random

import numpy as np
import pytest

import corpus_pipeline
from attestry.llm import paragraphs, quotations, rules, suffixes, urlgraph

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept string, n_bytes long, k string, tag string, row string, component string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 0.5, 7, "kept", 9, "k", "t", "r", "c") for r in rows], DOCS)


def test_suffixes_tell_null_keys_apart(spark):
    """Of many rows with null keys, only the one that shares 450 bytes with another document loses any."""
    rng = random.Random(1)
    new = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n))
    shared = new(60)[:450]
    d = spark.createDataFrame([(None, f"{shared} x"), (1, shared), *((None, new(60)) for _ in range(3000))], "doc_id long, text string")
    got = suffixes.remove_repeats(d, keep=("text",)).collect()
    assert len(got) == 3002 and {(r.doc_id, r.text, r.n_removed) for r in got if r.n_removed} == {(None, f"{shared} x", 450), (1, shared, 450)}


def test_suffixes_of_a_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    d = spark.createDataFrame([(1, text), (2, text[300_000:301_000])], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.remove_repeats(d).collect()} == {1: (1000, 1), 2: (1000, 1)}


def test_pipeline_stages(spark):
    """Extra columns of any name pass through, and one row of a group of copies stays whatever its id."""
    near = corpus_pipeline.near_duplicates(spark, rows_of(spark, [(7, "z y x w"), (7, "m n o p"), (3, "m n o p"), (None, "q r s t"), (None, "q r s t"), (5, None), (5, None), (6, "  "), (9, "a b c d e f"), (9, "a b c d e f")]), "")
    assert near.columns == DOCS.replace(",", "").split()[::2]
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted([(7, "z y x w"), (3, "m n o p"), (None, "q r s t"), (5, None), (6, "  "), (9, "a b c d e f")], key=str)
    good = rules.Rules(1.0, ())
    accepted = rules.accept(rows_of(spark, [(1, "x"), (1, "x"), (None, None)]), good)
    assert accepted.count() == 3 and {r.score for r in accepted.collect()} == {0.5}
    s = "0123456789" * 45
    cut = corpus_pipeline.repeated_strings(spark, rows_of(spark, [(1, "é" + s), (None, s + "ü"), (3, None)]), "")
    assert cut.columns == near.columns
    assert sorted(((r.doc_id, r.text, r.n_chars, r["kept"], r.n_bytes) for r in cut.collect()), key=str) == sorted([(1, "é", 1, "kept", 9), (None, "ü", 1, "kept", 9), (3, "", 0, "kept", 9)], key=str)
    mixed = corpus_pipeline.mix_sources(spark, rows_of(spark, [(1, "a b c"), (1, "a b c"), (None, "d e f")]), "")
    assert mixed.columns == near.columns and {r.doc_id for r in mixed.collect()} <= {1, None}
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_strings, corpus_pipeline.mix_sources):
        assert stage(spark, rows_of(spark, []), "").collect() == []


def test_quotations_of_null_ids(spark):
    d = spark.createDataFrame([(None, 0, "a", "x"), (None, 1, "a", "> x"), (1, None, "a", "> x"), (1, 2, "a", "y")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in quotations.link_quotations(d).collect()}
    assert got == {(None, 0): (0, None), (None, 1): (1, 0), (1, None): (0, None), (1, 2): (0, None)}


def linked(rows):
    """Links and order of one conversation at a time, by search through all earlier messages."""
    norm = lambda s: " ".join("".join(c.lower() if c.isalnum() else " " for c in s).split())
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == c)
        said, reply = [], {}
        for i, (turn, _, text) in enumerate(mine):
            lines, quotes = text.split("\n"), []
            for x in lines:
                level = len(x) - len(x.lstrip("> ")) and x[: len(x) - len(x.lstrip("> "))].count(">")
                if level and quotes and quotes[-1][2]:
                    if quotes[-1][0] == level:
                        quotes[-1][1].append(x.lstrip("> "))
                        continue
                if level:
                    quotes.append([level, [x.lstrip("> ")], True])
            found = []
            for level, body, _ in quotes:
                parts = {norm(p) for p in ["\n".join(body), *body]} - {""}
                at = [t for t, words in said if t < turn and words & parts]
                if at:
                    found.append((level, -max(at)))
            body = [x for x in lines if not x.startswith(">")]
            reply[i] = -min(found)[1] if found else (mine[i - 1][0] if i else None)
            out[c, turn] = (len(found), reply[i])
            said.append((turn, {norm(p) for p in ["\n".join(body), *body]} - {""}))
    return out


def test_quotations_against_a_search(spark):
    rng = random.Random(6)
    rows = []
    for c in range(6):
        texts: list[str] = []
        for turn in range(40 if c == 0 else 8):
            own = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(3))
            quoted = []
            if texts and rng.random() < 0.7:
                for level in sorted(rng.sample([1, 2, 3], rng.randrange(1, 3))):
                    quoted += [">" * level + " " + x for x in rng.choice(texts).upper().split("\n")]
            text = "\n".join([*quoted, own])
            rows.append((c, turn, "u", text))
            texts.append(own)
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in got} == linked(rows)
    for c in range(6):
        order = sorted((r for r in got if r.conv_id == c), key=lambda r: (-1 if r.reply_to is None else r.reply_to, r.turn))
        assert [r.position for r in order] == list(range(1, len(order) + 1))
    assert sum(r.n_linked for r in got) > 30


def test_propagation_against_a_dense_solution(spark):
    """Random hosts with cycles, hosts without links, and a hub that a third of all hosts link to."""
    rng = np.random.default_rng(3)
    n = 200
    a = np.zeros((n, n))
    for i in range(n - 20):  # the last 20 link to nothing
        for j in rng.choice(n, 3, replace=False):
            a[i, j] += i != j
        if i % 3 == 0 and i:
            a[i, 0] += 2
    trust, distrust = (rng.random(n) < 0.05) / 7.0, (rng.random(n) < 0.05) / 9.0
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(a[i, j])) for i, j in zip(*np.nonzero(a))], "src string, dst string, n long")
    seeds = spark.createDataFrame([(f"h{i}", float(trust[i]), float(distrust[i])) for i in range(n) if trust[i] or distrust[i]], "host string, trust double, distrust double")
    got = {r.host: r for r in urlgraph.propagate(edges, seeds, rounds=60, tolerance=1e-12).collect()}
    fwd, bwd = a / np.maximum(a.sum(1, keepdims=True), 1), a.T / np.maximum(a.T.sum(1, keepdims=True), 1)
    want = [np.linalg.solve(np.eye(n) - 0.85 * m.T, 0.15 * s) for m, s in ((fwd, trust), (bwd, distrust))]
    for i in range(n):
        r = got.get(f"h{i}")
        assert np.allclose([r.trust, r.distrust] if r else [0, 0], [want[0][i], want[1][i]], atol=1e-4)


def test_paragraphs_of_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(None, line), (None, line), (1, line), (2, "x " * 100_000), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in paragraphs.repeated_paragraphs(d).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 40, 1, 0, False), (None, 0, 40, 1, 0, True), (None, 0, 40, 1, 0, True)], key=str)
    assert paragraphs.repeated_units(d.limit(0)).collect() == []


def test_units_inside_and_across_lines(spark):
    """A passage of 60 words in the middle of a line, cut into short lines elsewhere, has rows in both texts."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = new(60)
    a = " ".join([*new(40), *passage, *new(50)])
    b = "\n".join([" ".join(new(30)), *(" ".join(passage[i : i + 6]) for i in range(0, 60, 6)), " ".join(new(30))])
    d = spark.createDataFrame([(1, a), (2, b), (3, " ".join(new(300)))], "doc_id long, text string")
    got = paragraphs.repeated_units(d).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.kind for r in got} == {"run"}


@pytest.mark.parametrize("n", [0, 3])
def test_scores_of_repeated_rows(spark, n):
    d = spark.createDataFrame([(1, "a b")] * n, "doc_id long, text string")
    assert len({tuple(r) for r in rules.score(d, rules.Rules(0.2, ())).collect()}) == min(n, 1)
