import base64
import hashlib
import math
import random
import re

import duckdb
import pandas as pd
import public_tokenizers
import tiktoken

import corpus_pipeline
from attestry.llm import bpe_native, minhash, mixing, rules

from .test_near_duplicates import components, shingle_set

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def statistics(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines, n = t.split("\n"), max(len(t), 1)
    share = lambda chars: sum(c in chars for c in t) / n
    values = (len(t), len(w), len(t) / max(len(w), 1), share(rules._UPPER), share("0123456789"), share(rules._SYMBOLS), share("!?"), share(".,;:"), len(set(w)) / max(len(w), 1), len(lines), len(set(lines)) / len(lines), len(t) / len(lines))
    return dict(zip(rules.FEATURES, values, strict=True))


def predicted(model, text):
    s = statistics(text)
    total = model.intercept + sum(weight for weight, bounds in model.rules if all((s[n] > v) if above else (s[n] <= v) for n, above, v in bounds))
    return 1 / (1 + math.exp(-total)) >= 0.3


def cut(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    new = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    passage = new(120)
    texts = [new(rng.randrange(3, 150)) + "." for _ in range(120)]
    texts += [texts[k] for k in range(0, 30, 3)] + [texts[k] + " more" for k in range(60, 75) if len(texts[k].split()) > 60]
    texts += [f"{new(60)} {passage} {new(60)}" for _ in range(8)] + [" ".join(w + "***" for w in new(60).split()) for _ in range(40)] + [None, "", "   "]
    rows = [(3 * i, t, "en", rng.choice(["a", "b", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 0 if "***" in (r[1] or "") else 1, 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.doc_id, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = rules.train(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels")))
    now = [r for r in rows if predicted(model, r[1])]
    assert not any("***" in (r[1] or "") for r in now) and sum("***" not in (r[1] or "x" * 3) for r in rows) - len(now) <= 3
    top = components([shingle_set(r[1], 3) for r in now], 85)
    now = [r for i, r in enumerate(now) if top[i] == i]
    now = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(now, cut([r[1] for r in now]), strict=True)]
    assert any(r[4] < len(o[1] or "") for r in now for o in rows if o[0] == r[0])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(now, columns=columns))
    taken = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.op6_sql()})").fetchall()}
    copies = {k: math.floor(n / size + 0.5) if size else 0 for k, (size, n) in taken.items()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in now:
        ids = library.encode_ordinary(r[1])
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want += [(r[0], tuple(ids), len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())] * copies[r[0]]
    assert got == sorted(want) and len(got) > 50


def test_near_copies_of_the_stage(spark):
    """Copies from 0.80 on by five words whose edits stand together, which three words at 0.85 do not link."""
    rng = random.Random(5)
    rows = []
    for i in range(0, 60, 3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        edited = [*base[:50], *(f"e{k}" for k in range(7)), *base[57:]]  # 89 of 111 shingles
        rows += [(i, " ".join(base)), (i + 1, " ".join(base[:84])), (i + 2, " ".join(edited))]
    texts = [t for _, t in rows]
    top = components([shingle_set(t, 5) for t in texts], 80)
    assert top == [k - k % 3 for k in range(60)] and components([shingle_set(t, 3) for t in texts], 85) != top
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(0, 60, 3))


def test_forest_at_the_threshold():
    assert minhash.tune(0.85) == (24, 5)
    for threshold in (0.8, 0.85):
        trees, depth = minhash.tune(threshold)
        assert (1 - threshold**depth) ** trees <= 1e-6


def test_native_fold(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["", "a", " the", " thanedble", "é", "漢字", "𝒳", "!!!!!", "Donaudampfschiff", "'ll", " 12345", "zzzzzzzzzzzzzzzzzzzz"]
    got = {r.word: list(r.ids) for r in bpe_native.encode_words(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), PATH, public_tokenizers.PATTERN).collect()}
    assert got == {w: library.encode_ordinary(w) for w in words} | {None: []}
