"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, removal by components.

Paragraphs are of two kinds. Lines of at least ``LEAST`` words are compared by bands, tuned so that a pair at
the threshold collides in one of them but once in ten thousand, and verified by exact Jaccard similarity.
Passages that start or end inside lines, or run over many short ones, have no line of their own: they are cut
at places that their own words define, so that equal passages give equal paragraphs whatever stands around
them, and only equality is asked of those (see repeated_passages).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from . import shingles as sh
from .common import scratch, stage, tidy
from .minhash import LAST
from .neardup import forest_rows, near_components

LEAST, SIZE, PERCENT = 20, 5, 80
#: Words of a passage, and of the run it is filed under: RUN finds more of an edited passage, UNIT less by chance.
PASSAGE, RUN, UNIT = 50, 20, 30


def tune(threshold: float, miss: float = 1e-4, most: int = 48) -> tuple[int, int]:
    return minhash.tune(threshold, miss, most)


def _signed(size: int, least: int, hashes: int, sets: bool):
    def run(batches):
        for batch in batches:
            for rows, data, starts in sh.text_chunks(batch, 1):
                lines = np.unique(np.concatenate([starts, np.flatnonzero(data == 10) + 1]))
                if len(lines) < 2:
                    continue
                h, at, n, words = sh.shingles(data, lines, size, least)
                full = np.flatnonzero(n > 0)
                if not len(full):
                    continue
                doc = np.searchsorted(starts, lines[full], "right") - 1
                first = np.searchsorted(lines, starts)
                found = [sh.distinct(h[at[u] : at[u] + n[u]]) for u in full]
                ids = batch.column(0)[rows.start : rows.stop].take(pa.array(doc))
                count = pa.array([len(s) for s in found], pa.int64())
                digests = pa.array([sh.digest(s) for s in found], pa.binary())
                if sets:
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    extra = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                else:
                    s = (sh.mix(sh.signatures(h, at[full], hashes).astype(np.uint64)) >> np.uint64(48)).astype(">u2")
                    extra = pa.array([r.tobytes() for r in s], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(full - first[doc], pa.int32()), pa.array(words[full], pa.int64()), count, digests, extra], ["doc_id", "paragraph", "n_words", "n", "digest", "x"])

    return run


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """One row per line that repeats or nearly repeats another one.

    ``doc_id, paragraph`` (its line, from 0), ``n_words``, ``component_doc_id, component_paragraph`` (the
    first of those it reaches), ``removed`` (it isn't that one). Lines without a partner, and so null, empty
    and short texts and empty tables, have no row. Null keys count as the greatest; rows with equal keys are
    read each, and repeated rows repeat each other's lines. A text is held in memory whole, however long it
    or a line of it is. Other columns are not read, so clashing names do not matter.
    """
    bands, depth = tune(percent / 100)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    columns = "doc_id long, paragraph int, n_words long, n long, digest binary"
    signed = stage(d.mapInArrow(tidy(_signed(size, least, bands * depth, False)), f"{columns}, x binary"), "paragraphs")
    k = F.coalesce("doc_id", F.lit(LAST))
    with scratch() as keep:
        classes = signed.groupBy("digest").agg(F.min(F.struct(k.alias("k"), F.col("paragraph").alias("p"), F.col("n"), F.col("x"))).alias("m"), F.count(F.lit(1)).alias("copies"))
        item = F.struct(F.col("m.k").alias("k"), F.col("m.p").alias("p"), F.xxhash64("digest").alias("v"))
        classes = stage(classes.select(item.alias("item"), F.col("m.n").alias("n"), F.col("m.x").alias("sig"), "digest", "copies"), "classes")
        rows = forest_rows(classes, bands, depth)

        wanted = stage(rows.select("item").distinct(), "wanted")
        texts = d.withColumn("k", k).join(wanted.select(F.col("item.k").alias("k")).distinct().hint("merge"), "k", "left_semi").select("k", "text")
        sets = texts.mapInArrow(tidy(_signed(size, least, 0, True)), f"{columns}, x array<long>")
        sets = sets.select(F.struct(F.col("doc_id").alias("k"), F.col("paragraph").alias("p"), F.xxhash64("digest").alias("v")).alias("item"), F.col("x").alias("s"))
        sets = stage(sets.join(wanted.hint("merge"), "item", "left_semi").dropDuplicates(["item"]), "sets")
        components = near_components(rows, sets, percent)

        found = classes.join(components.hint("merge"), F.col("item") == F.col("node"), "left").filter((F.col("copies") > 1) | F.col("component").isNotNull())
        found = keep(stage(found.select("digest", F.coalesce("component", "item").alias("c")), "found"))
    out = signed.select("doc_id", "paragraph", "n_words", "digest").join(found.hint("merge"), "digest")
    first = F.col("doc_id").eqNullSafe(F.col("component_doc_id")) & (F.col("paragraph") == F.col("component_paragraph"))
    out = out.select("doc_id", "paragraph", "n_words", F.when(F.col("c.k") < LAST, F.col("c.k")).alias("component_doc_id"), F.col("c.p").alias("component_paragraph"))
    return out.withColumn("removed", ~first)


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, least: int = LEAST, passage: int = PASSAGE, run: int = UNIT) -> DataFrame:
    """Repeated paragraphs of both kinds: ``doc_id, kind, place, n_words, component_doc_id, component_place, removed``.

    ``kind`` is ``line`` (``place`` is its number in the text) or ``run`` (``place`` is its first word), both
    from 0; rows as in ``repeated_paragraphs`` and ``repeated_passages``, odd rows too.
    """
    out = ["doc_id", "kind", "place", "n_words", "component_doc_id", "component_place", "removed"]
    lines = repeated_paragraphs(docs, key, text, size, percent, least).withColumns({"kind": F.lit("line"), "place": F.col("paragraph").cast("long"), "component_place": F.col("component_paragraph").cast("long")})
    runs = repeated_passages(docs, key, text, passage, run).withColumns({"kind": F.lit("run"), "place": F.col("word"), "component_place": F.col("component_word")})
    return lines.select(*out).unionByName(runs.select(*out))


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` word hashes from each position on; the last n - 1 positions have none."""
    out, have, power, done = np.zeros(len(h) - n + 1, np.uint64), h, 1, 0
    while power <= n:
        if n & power:
            out = sh.mix(out * sh._M[2] + have[done : done + len(out)])
            done += power
        have = sh.mix(have[:-power] * sh._M[0] + have[power:])
        power *= 2
    return out


def _filed(passage: int, run: int):
    span = passage - run + 1

    def filed(batches):
        for batch in batches:
            for rows, data, bounds in sh.text_chunks(batch, 1):
                start, _, h = sh.words(data, bounds)
                if len(h) < passage:
                    continue
                first = np.searchsorted(start, bounds)
                room = np.maximum(np.diff(first) - passage + 1, 0)
                if not room.sum():
                    continue
                key = _run_hashes(h, run)
                at = np.repeat(first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
                least = np.lib.stride_tricks.sliding_window_view(key, span).argmin(1)
                at = np.unique(at + least[at])
                doc = np.searchsorted(first, at, "right") - 1
                # overlapping runs of the same words (one word over and over): enough of them that no passage is without one
                fresh = np.append(True, (key[at[1:]] != key[at[:-1]]) | (doc[1:] != doc[:-1]) | (np.diff(at) >= run))
                head = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
                block = (at - head) // max(span - run, 1)
                stay = fresh | np.append(True, block[1:] != block[:-1]) | np.append(fresh[1:], True)
                at, doc = at[stay], doc[stay]
                other = np.zeros(len(at), np.uint64)
                for k in range(run):
                    other = sh.mix(other * sh._M[1] + h[at + k])
                ids = batch.column(0)[rows.start : rows.stop].take(pa.array(doc))
                columns = [ids, pa.array(at - first[doc], pa.int64()), pa.array(key[at].view(np.int64)), pa.array(other.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "word", "x", "y"])

    return filed


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int = PASSAGE, run: int = RUN) -> DataFrame:
    """One row per run of ``run`` words that stands for repeated passages, wherever lines begin and end.

    ``doc_id, word`` (its first word in the text, from 0), ``n_words, component_doc_id, component_word`` (the
    first place of the same words), ``removed`` (it isn't that one). Every ``passage`` words in a row are filed
    under the run with the least hash that they hold, so equal passages are filed alike: each passage of that
    many words that occurs elsewhere, in any document or the same one, holds a run that has a row. Where a
    run repeats over itself, only as many have rows as that takes. Words are compared as in shingles.
    Texts with fewer words, and so null ones, have no row; null keys count as the greatest.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    filed = stage(d.mapInArrow(tidy(_filed(passage, run)), "doc_id long, word long, x long, y long"), "runs")
    classes = filed.groupBy("x", "y").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("k"), F.col("word").alias("p"))).alias("c"), F.count(F.lit(1)).alias("copies"))
    found = stage(classes.filter("copies > 1").select("x", "y", "c"), "found")
    out = filed.join(found.hint("merge"), ["x", "y"])
    out = out.select("doc_id", "word", F.lit(run).cast("long").alias("n_words"), F.when(F.col("c.k") < LAST, F.col("c.k")).alias("component_doc_id"), F.col("c.p").alias("component_word"))
    return out.withColumn("removed", ~(F.col("doc_id").eqNullSafe(F.col("component_doc_id")) & (F.col("word") == F.col("component_word"))))


def without_repeats(docs: DataFrame, repeats: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs cut out of their texts, which need distinct keys."""
    cut = repeats.filter("removed").groupBy(F.col("doc_id").alias("_k")).agg(F.collect_set("paragraph").alias("_cut"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_cut", i)), "\n")
    return docs.join(cut, F.col(key) == F.col("_k"), "left").withColumn(text, F.when(F.col("_cut").isNull(), F.col(text)).otherwise(kept)).drop("_k", "_cut")


def op7_sql(least: int = LEAST) -> str:
    """All pairs by an inverted index, for DuckDB on ``documents``."""
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS paragraph FROM documents),
w AS MATERIALIZED (SELECT doc_id * 1000000 + paragraph AS id, doc_id, paragraph, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM l),
p AS MATERIALIZED (SELECT id, doc_id, paragraph, len(w)::BIGINT AS n_words FROM w WHERE len(w) >= {least}),
s AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i+{SIZE - 1}], ' ') for i in range(1, len(w) - {SIZE - 2})]) AS g FROM w WHERE len(w) >= {least}),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
i AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
k AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT DISTINCT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a WHERE r.c < e.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT p.doc_id, p.paragraph::INT AS paragraph, p.n_words, q.doc_id AS component_doc_id, q.paragraph::INT AS component_paragraph, p.id <> m.c AS removed
FROM m JOIN p ON p.id = m.node JOIN p q ON q.id = m.c"""
