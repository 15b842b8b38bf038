import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from attestry.llm import suffixes as sx


def brute(rows, length):
    seen = Counter(d[i : i + length] for d in ((t or "").encode() for _, t in rows) for i in range(len(d) - length + 1))
    out = []
    for k, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    shared = [new(rng.randrange(380, 1500)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = new(rng.randrange(0, 900))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 3)
            piece = list(s[a : rng.randrange(2 * len(s) // 3, len(s))])
            if rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = "#"
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "".join(piece) + text[at:]
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a" * 1200), (103, "xy" * 700), (104, rows[0][1]), (3, rows[3][1]), (3, new(500)), (None, shared[0]), (None, new(450))]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, doc int, lo string")
    assert sorted(map(tuple, sx.remove_repeats(docs).collect()), key=str) == brute(rows, 400)


@pytest.mark.parametrize("length", [16, 50, 130])
def test_short_lengths(spark, length):
    """Equal windows with other bytes behind them meet at any length."""
    rng = random.Random(length)
    new = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    shared = [new(length + 2) for _ in range(60)]
    rows = [(i, new(rng.randrange(40)) + s.encode()[:length].decode(errors="ignore") + "z" * k + new(rng.randrange(40))) for i, s in enumerate(shared) for k in (0, 1)]
    docs = spark.createDataFrame([(2 * i + j % 2, t) for j, (i, t) in enumerate(rows)], "doc_id long, text string")
    want = brute([tuple(r) for r in docs.collect()], length)
    assert sorted(map(tuple, sx.remove_repeats(docs, length=length).collect()), key=str) == want


def test_lengths_that_are_refused(spark):
    with pytest.raises(ValueError):
        sx.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=15)


def test_empty(spark):
    assert sx.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts(spark):
    s = "0123456789" * 45
    got = sx.remove_repeats(spark.createDataFrame([(1, "é" + s), (2, s + "ü")], "doc_id long, text string"), texts=True)
    assert sorted((r.doc_id, r.kept) for r in got.collect()) == [(1, "é"), (2, "ü")]


def brute_words(texts, words, length=400):
    """What is left when strings of ``length`` bytes and of ``words`` whole words that occur twice are cut."""
    data = [(t or "").encode() for t in texts]
    spans = [[(i, i + length) for i in range(len(d) - length + 1)] for d in data]
    for d, s in zip(data, spans, strict=True):
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)]
        s += [(at[i][0], at[i + words - 1][1]) for i in range(len(at) - words + 1)]
    # windows of words and of bytes are counted apart
    seen = Counter((b - a == length and k < max(len(d) - length + 1, 0), d[a:b]) for d, s in zip(data, spans, strict=True) for k, (a, b) in enumerate(s))
    out = []
    for d, s in zip(data, spans, strict=True):
        gone = bytearray(len(d))
        for k, (a, b) in enumerate(s):
            if seen[(b - a == length and k < max(len(d) - length + 1, 0), d[a:b])] > 1:
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


@pytest.mark.parametrize("words", [1, 7, 50])
def test_words_against_brute_force(spark, words):
    rng = random.Random(words)
    new = lambda n: "".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 5))) + rng.choice(" \n") * rng.randrange(1, 3) for _ in range(n))
    shared = [new(rng.randrange(words, 3 * words + 2)) for _ in range(5)]
    texts = []
    for _ in range(60):
        text = new(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            piece = rng.choice(shared)
            piece = piece[rng.randrange(len(piece) // 4 + 1) :] if rng.random() < 0.5 else piece
            if rng.random() < 0.3:
                at = rng.randrange(len(piece))
                piece = piece[:at] + "#" + piece[at + 1 :]
            text += piece + new(rng.randrange(20))
        texts.append(text)
    texts += [None, "", " \n", "ha " * 70, texts[0], shared[0], "x" * 900, "y" + "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.kept) for r in sx.remove_repeats(docs, texts=True, words=words).collect())
    want = brute_words(texts, words)
    assert [k for _, k in got] == want and sum(len(a or "") > len(b) for a, b in zip(texts, want, strict=True)) > 20


def test_stage_cuts_short_passages(spark):
    """Passages of over 50 words that have fewer than 400 bytes, in the stage of the pipeline; 49 words stay."""
    rng = random.Random(9)
    new = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    long, short = new(55), new(49)
    assert len(long.encode()) < 400
    own = [(new(80), new(80)) for _ in range(12)]
    rows = [(i, f"{a}. {long if i < 8 else short} !{b}", "en", "s", 0) for i, (a, b) in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    want = {i: f"{a}.  !{b}" if i < 8 else rows[i][1] for i, (a, b) in enumerate(own)}
    assert got == {i: (t, len(t)) for i, t in want.items()}
