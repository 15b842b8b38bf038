import base64
import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

from attestry.llm import bpe, mixing, rules, urlgraph

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark, library):
    rng = random.Random(2)
    parts = ["a", "b", " ", "\n", "é", "'s", "'ll", "12", "!!", "漢字", "\u00a0", "\t", "THE", "ing", "<|endoftext|>", "x" * 60, "𝒳", "zq", "hello world"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " " * 5000, "ab" * 3000, "é" * 500, "Hello, world!"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == want
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(coded, PATH, public_tokenizers.PATTERN).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect():
        raw = b"".join(x.to_bytes(4, "little") for x in want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), hashlib.sha256(raw).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 200)) if rng.random() > 0.05 else rng.choice([None, "", " \n "]), rng.choice(["b", "c", "c", "c", "d", None]), 1) for i in range(400)]
    rows += [(400, "one two", "a", 1), (401, "tiny", "zz", 1), (402, "", "empty", 1), (7, "w w w", "b", 1), (7, "w w w", "b", 1), (None, "no key", "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(d, shard_docs=30).collect()
    again = mixing.mix(d.repartition(7), shard_docs=30).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size]
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 and target["a"] == 6
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 32
    assert mixing.mix(d.limit(0)).collect() == []


def test_seats(spark):
    d = spark.createDataFrame([("g", k, v, s) for s, votes in [(10, [53, 24, 23]), (7, [1, 1, 1, 1]), (100, [99, 1, 0])] for k, v in enumerate(votes) for _ in [0]], "g string, k int, v long, s long")
    for (seats,) in d.select("s").distinct().collect():
        part = d.filter(d.s == seats)
        got = {r.k: r.q for r in mixing.sainte_lague(part, ["g"], ["k"], "v", "s", "q").collect()}
        votes = {r.k: r.v for r in part.collect()}
        ranked = sorted(((-v / (2 * n - 1), k) for k, v in votes.items() if v for n in range(1, seats + 1)))[:seats]
        assert got == {k: sum(x == k for _, x in ranked) for k in votes}


def test_urls(spark):
    link = lambda *hosts: "".join(f'<p><a class="x" href="https://{h}/p">t</a><A HREF=\'//{h}\'>u</a>' for h in hosts)
    pages = [
        (1, "https://good.example.net/de/1", link("friend.test", "GOOD.example.net")), (2, "https://bad.org/es/2", link("victim.test")), (3, "http://friend.test/x?q=/de/#f", ""), (4, "https://fan.test/", link("bad.org")),
        (5, "https://victim.test", None), (6, None, link("bad.org")), (7, "no scheme", ""), (8, "https://A.EXAMPLE.net/de/81", ""), (9, "x://shop.example.com/en/71", ""), (10, "x://com/en/", ""), (11, "x://telecom/en/", ""), (11, "x://telecom/en/", ""), (12, "", ""), (13, "http://É.COM/en/?", ""),
    ]
    got = defaultdict(list)
    for r in urlgraph.filter_urls(spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("good.example.net", "/de/1", "net/de/", "allow")] and got[2] == [("bad.org", "/es/2", "org/es/", "block")]
    assert got[3] == [("friend.test", "/x", None, "allow")] and got[4] == [("fan.test", "/", None, "block")]
    assert got[5] == [("victim.test", "", None, "allow")] and got[6] == got[7] == got[12] == [("", "", None, "allow")]
    assert got[8][0][2:] == ("example.net/de/8", "block") and got[9][0][2:] == ("example.com/en/7", "allow")
    assert got[10][0][2:] == ("com/en/", "block") and got[11] == [("telecom", "/en/", None, "allow")] * 2 and got[13] == [("É.com", "/en/", "com/en/", "block")]
    assert urlgraph.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_rules(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(20, 200))) + "."
    bad = lambda: rng.choice([" ".join(word() + "***" for _ in range(80)), (word() + " ") * 90, good().upper() + "!!!!"])
    rows = [(i, good() if i % 4 else bad(), "x", 1.0) for i in range(600)] + [(600, None, "x", 1.0), (601, "", "x", 1.0), (602, "word " * 50_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, upper double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 5) for i in range(600)] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, n_words int")
    model = rules.train(docs, labels)
    assert model.rules and model == rules.train(docs.repartition(5), labels)
    got = {r.doc_id: r for r in rules.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [r for i, r in got.items() if r.held_out and i < 600]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    none = rules.train(docs, labels.limit(0))
    assert none.rules == () and {r.predicted for r in rules.score(docs, none).collect()} == {1}
    assert rules.score(docs.limit(0), model).collect() == []
