"""Suffix-array dedup by refinement of q-gram buckets over sampled suffixes.

Every window of ``length`` bytes is filed under one suffix: the position with the least hash of ``GRAM``
bytes among its first ``SPAN`` ones, or as many as have these bytes inside the window. Equal windows are
filed alike, so only these suffixes, some 1 in 64, are sorted. Their initial buckets are the q-grams that
all windows of a suffix share, and buckets of one drop out. Where a window also holds the q-gram of a later
sampled suffix, the bucket of that suffix is looked up at its offset, by a pointer: a suffix leaves if the
bucket there was of one, else both identifiers make its new one. What is still mixed is refined by what
stands around these q-grams: first of the whole run of windows, then of blocks of ``STEP`` windows, then of
single windows, each round keyed by the bucket's identifier of the round before. Everything is an aggregate
before it is a join, and a suffix never meets its whole bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import discard, stage, tidy
from .minhash import LAST

SPAN, STEP, GRAM = 128, 16, 16


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on; past the end counts as zeros."""
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    a = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    b = np.ndarray((len(data),), "<u8", padded, 8, (1,))
    return sh.mix(a * sh._M[0] + (b ^ (b >> np.uint64(31))) * sh._M[2])


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """Where the least of ``span`` hashes from each position on stands."""
    n = len(hashes)
    mask = np.uint64(2**32 - 1)  # half for the hash, half for the place: the leftmost wins a tie
    size = -(-(n + span) // span) * span
    key = np.full(size, 2**64 - 1, np.uint64)
    key[:n] = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n + 1], ahead[span - 1 : span + n]) & mask


def _filed(least: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows from each start on are filed, with the first and last start of each run filed alike."""
    m = least[start].astype(np.int64)
    first = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.empty(0, int)
    last = np.append(first[1:], len(m)) - 1 if len(m) else first
    return m[first], start[first], start[last]


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix, first and last start of each run of windows filed under one suffix, and the suffix it points to.

    The pointer leads to the least q-gram hash among the ``SPAN`` positions after the suffix, which all of its
    windows hold, so that it depends on nothing else.
    """
    span = min(SPAN, length - GRAM + 1)
    n = len(data)
    least = _least(_grams(data), span)
    room = np.maximum(np.diff(bounds) - length + 1, 0)
    start = np.repeat(bounds[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
    m, low, high = _filed(least, start)
    return m, low, high, least[np.minimum(m + 1, n)].astype(np.int64)


def _suffixes(length: int):
    span = min(SPAN, length - GRAM + 1)
    core = length - span + 1
    gram = core - span if core - span >= GRAM else core  # then there are no pointers

    def run(batches):
        for batch in batches:
            for rows, data, bounds in sh.text_chunks(batch, 2):
                m, low, high, to = _runs(data, bounds, length)
                if not len(m):
                    continue
                j = (m - high) * SPAN + (m - low)
                whole = sh.mix(sh.hash_spans(data, low, high + length) + j.astype(np.uint64) * sh._M[0])
                ahead = to - m if gram < core else np.zeros(len(m), np.int64)
                # what is pointed to counts in its bucket, also if it is past the last windows of its text
                posts = np.setdiff1d(m + ahead, m)
                m, j = np.concatenate([m, posts]), np.concatenate([j, np.full(len(posts), -1)])
                whole, ahead = (np.concatenate([x, np.zeros(len(posts), x.dtype)]) for x in (whole, ahead))
                doc = np.searchsorted(bounds, m, "right") - 1
                ids, v = (batch.column(c)[rows.start : rows.stop].take(pa.array(doc)) for c in (0, 1))
                columns = [sh.hash_spans(data, m, m + gram).view(np.int64), whole.view(np.int64), ids, v, (m - bounds[doc]).astype(np.int32), j.astype(np.int32), ahead.astype(np.int16)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["core", "whole", "doc", "v", "pos", "j", "ahead"])

    return run


def _blocks(length: int):
    """Blocks of windows of the suffixes in the list column, with what is around the bytes they share."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets)
            core, pos, j, times = (np.asarray(lists.values.field(k)) for k in range(4))
            pos = pos.astype(np.int64)
            for rows, data, bounds in sh.text_chunks(batch, 2):
                part = slice(at[rows.start], at[rows.stop])
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at[rows.start : rows.stop + 1]))
                m, lo, hi = pos[part] + bounds[doc], j[part] // SPAN, j[part] % SPAN
                count = hi // STEP - lo // STEP + 1
                one = np.repeat(np.arange(len(m)), count)
                b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (lo // STEP)[one]
                left, right = m[one] - b * STEP, m[one] - b * STEP - STEP + 1 + length
                shared = sh.mix(sh.hash_spans(data, left, right) + b.astype(np.uint64) * sh._M[2])
                j1, j2 = np.maximum(lo[one], b * STEP) - b * STEP, np.minimum(hi[one], b * STEP + STEP - 1) - b * STEP
                edge = np.concatenate([np.zeros(STEP, np.uint8), data, np.zeros(STEP, np.uint8)])
                side = np.concatenate([edge[(left + 1)[:, None] + np.arange(STEP - 1)], edge[(right + STEP)[:, None] + np.arange(STEP - 1)]], axis=1)
                ids, v = (batch.column(c)[rows.start : rows.stop].take(pa.array(doc[one])) for c in (0, 1))
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * STEP - 2), len(side), [None, pa.py_buffer(np.ascontiguousarray(side).tobytes())]) if len(side) else pa.array([], pa.binary())
                first = (pos[part][one] - b * STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(core[part][one]), pa.array(shared.view(np.int64)), ids, v, pa.array(first), pa.array((j1 * STEP + j2).astype(np.int32)), flat.cast(pa.binary()), pa.array(times[part][one])], ["core", "shared", "doc", "v", "pos", "j", "side", "times"])

    return run


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of each text's first word."""
    start, end, _ = sh.words(data, bounds)
    return start, end, np.searchsorted(start, bounds)


def _word_runs(words: int):
    """Runs of windows of so many words, filed under the least hash of a third as many words inside."""
    gram = -(-words // 3)

    def run(batches):
        for batch in batches:
            for rows, data, bounds in sh.text_chunks(batch, 2):
                start, end, at = _words(data, bounds)
                room = np.maximum(np.diff(at) - words + 1, 0)
                if not room.any():
                    continue
                k = np.repeat(at[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
                core = sh.hash_spans(data, start[: len(start) - gram + 1], end[gram - 1 :])
                m, low, high = _filed(_least(core, words - gram + 1), k)
                j = (m - high) * words + (m - low)
                lo, hi = start[low], end[high + words - 1]
                whole = sh.mix(sh.hash_spans(data, lo, hi) + j.astype(np.uint64) * sh._M[0])
                doc = np.searchsorted(at, m, "right") - 1
                ids, v = (batch.column(c)[rows.start : rows.stop].take(pa.array(doc)) for c in (0, 1))
                places = [x.astype(np.int32) for x in (lo - bounds[doc], hi - bounds[doc], low - at[doc], high - low + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(core[m].view(np.int64)), pa.array(whole.view(np.int64)), ids, v, *map(pa.array, places)], ["core", "whole", "doc", "v", "lo", "end", "first", "many"])

    return run


def _word_windows(words: int):
    """The windows, each alone, of the runs in the list column."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            edge = np.asarray(lists.offsets)
            core, first, many, times = (np.asarray(lists.values.field(k)) for k in range(4))
            for rows, data, bounds in sh.text_chunks(batch, 2):
                start, end, at = _words(data, bounds)
                part = slice(edge[rows.start], edge[rows.stop])
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(edge[rows.start : rows.stop + 1]))
                count = many[part]
                one = np.repeat(np.arange(len(count)), count)
                k = (first[part] + at[doc])[one] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                lo, hi, doc = start[k], end[k + words - 1], doc[one]
                ids, v = (batch.column(c)[rows.start : rows.stop].take(pa.array(doc)) for c in (0, 1))
                places = [(x - bounds[doc]).astype(np.int32) for x in (lo, hi)]
                columns = [pa.array(core[part][one]), pa.array(sh.hash_spans(data, lo, hi).view(np.int64)), ids, v, *map(pa.array, places), pa.array(times[part][one])]
                yield pa.RecordBatch.from_arrays(columns, ["core", "window", "doc", "v", "lo", "end", "times"])

    return run


def cut_spans(starts: list[tuple[int, int]], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in the given ranges cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(starts):
        end = min(hi + length, size)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((lo, end))
    return out


def _with(columns: list[pa.Array], names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns, and those of the batch from its fifth on."""
    return pa.RecordBatch.from_arrays([*columns, *batch.columns[4:]], [*names, *batch.schema.names[4:]])


def _finish(length: int, texts: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                data = (text or "").encode()
                spans = cut_spans(list(zip(lo or (), hi or (), strict=True)), len(data), length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), kept.decode(errors="ignore") if texts else hashlib.sha256(kept).hexdigest()))
            if rows:
                yield _with([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "out"], batch)

    return run


def _live(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose bucket holds several, refined by the bucket that their pointer leads to."""
    buckets = suffixes.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("core")
    live = stage(suffixes.join(stage(buckets, "buckets"), "core"), "live")
    there = live.select("doc", "v", F.col("pos").alias("target"), F.col("core").alias("later")).dropDuplicates(["doc", "v", "target"])
    pointing = live.filter("ahead > 0").withColumn("target", F.col("pos") + F.col("ahead")).join(there, ["doc", "v", "target"])
    refined = pointing.withColumn("core", F.xxhash64("core", "ahead", "later")).select(*live.columns)
    return stage(refined.unionByName(live.filter("ahead = 0 AND j >= 0")).drop("ahead"), "refined")


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """``doc, v, lo, hi``: ranges of starts of repeated windows, from ``docs(doc, v, text)``."""
    found = stage(docs.mapInArrow(tidy(_suffixes(length)), "core long, whole long, doc long, v long, pos int, j int, ahead short"), "suffixes")
    live = _live(found)
    discard(found)
    buckets = live.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).filter("c > 1")
    buckets = stage(buckets.select("core", (F.col("w0") == F.col("w1")).alias("alike")), "refined-buckets")
    live = stage(live.join(buckets, "core"), "several")
    mixed = live.filter("NOT alike")
    # One row for each kind of run: a repeated run goes on as one suffix that counts twice, as others may share
    # some of its windows.
    kinds = stage(mixed.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "v", "pos", "j")).alias("one")), "runs")
    again = mixed.join(kinds.filter("c > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    whole = live.filter("alike").select("doc", "v", "pos", "j").unionByName(again.select("doc", "v", "pos", "j"))
    ranges = whole.select("doc", "v", (F.col("pos") - F.pmod("j", F.lit(SPAN))).alias("lo"), (F.col("pos") - F.floor(F.col("j") / SPAN)).cast("int").alias("hi"))

    edges = kinds.select("core", "one.*", F.when(F.col("c") > 1, 2).otherwise(1).cast("int").alias("times"))
    edges = edges.groupBy("doc", "v").agg(F.collect_list(F.struct("core", "pos", "j", "times")).alias("edges"))
    near = docs.dropDuplicates(["doc", "v"]).join(stage(edges, "edges"), ["doc", "v"]).select("doc", "v", "text", "edges")
    blocks = stage(near.mapInArrow(tidy(_blocks(length)), "core long, shared long, doc long, v long, pos int, j int, side binary, times int"), "blocks")
    full = F.col("j") == STEP - 1  # all windows of the block are in the run
    code = F.when(full, F.xxhash64("side"))
    kinds = blocks.groupBy("core", "shared").agg(F.sum("times").alias("c"), F.count(F.lit(1)).alias("rows"), F.min(code).alias("w0"), F.max(code).alias("w1"), F.count(code).alias("n")).filter("c > 1")
    kinds = stage(kinds.select("core", "shared", F.coalesce((F.col("n") == F.col("rows")) & (F.col("w0") == F.col("w1")), F.lit(False)).alias("alike")), "kinds")
    blocks = stage(blocks.join(kinds, ["core", "shared"]), "open")
    done = blocks.filter("alike").select("doc", "v", (F.col("pos") - (STEP - 1)).alias("lo"), F.col("pos").alias("hi"))
    t = F.explode(F.sequence(F.floor(F.col("j") / STEP).cast("int"), F.pmod("j", F.lit(STEP)).cast("int")))
    single = blocks.filter("NOT alike").select("core", "shared", "doc", "v", "pos", "side", "times", t.alias("t"))
    mine = F.col("side").substr(F.lit(STEP) - F.col("t"), F.lit(STEP - 1))
    single = single.select("core", F.xxhash64("shared", "t", mine).alias("window"), "doc", "v", (F.col("pos") - F.col("t")).alias("pos"), "times")
    single = stage(single, "windows")
    twice = stage(single.groupBy("core", "window").agg(F.sum("times").alias("c")).filter("c > 1").select("core", "window"), "twice")
    last = single.join(twice, ["core", "window"]).select("doc", "v", F.col("pos").alias("lo"), F.col("pos").alias("hi"))
    return ranges.unionByName(done).unionByName(last)


def repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """``doc, v, lo, end``: spans of repeated windows of so many words, from ``docs(doc, v, text)``.

    A window goes from the first byte of a word to the last of the last word; equal ones are equal in all bytes,
    also in the white space between words. Whole runs are settled first, and single windows where a bucket is mixed.
    """
    found = stage(docs.mapInArrow(tidy(_word_runs(words)), "core long, whole long, doc long, v long, lo int, end int, first int, many int"), "word-runs")
    buckets = found.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).filter("c > 1")
    buckets = stage(buckets.select("core", (F.col("w0") == F.col("w1")).alias("alike")), "word-buckets")
    live = stage(found.join(buckets, "core"), "live-words")
    discard(found)
    mixed = live.filter("NOT alike")
    kinds = stage(mixed.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "v", "first", "many")).alias("one")), "word-kinds")
    again = mixed.join(kinds.filter("c > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    spans = live.filter("alike").select("doc", "v", "lo", "end").unionByName(again.select("doc", "v", "lo", "end"))

    edges = kinds.select("core", "one.*", F.when(F.col("c") > 1, 2).otherwise(1).cast("int").alias("times"))
    edges = edges.groupBy("doc", "v").agg(F.collect_list(F.struct("core", "first", "many", "times")).alias("edges"))
    near = docs.dropDuplicates(["doc", "v"]).join(stage(edges, "word-edges"), ["doc", "v"]).select("doc", "v", "text", "edges")
    single = stage(near.mapInArrow(tidy(_word_windows(words)), "core long, window long, doc long, v long, lo int, end int, times int"), "word-windows")
    twice = stage(single.groupBy("core", "window").agg(F.sum("times").alias("c")).filter("c > 1").select("core", "window"), "word-twice")
    return spans.unionByName(single.join(twice, ["core", "window"]).select("doc", "v", "lo", "end"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, texts: bool = False, keep: tuple[str, ...] = (), words: int = 0) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (or ``kept`` with ``texts``).

    A byte goes when a string of ``length`` bytes that covers it also starts elsewhere, in any document or
    the same one; strings are judged on the input. Null texts are empty; texts shorter than ``length`` keep
    everything. Rows are told apart by key and a 64-bit hash of the text, and rows equal in both repeat each
    other; null keys are one more key. A long text is held in memory whole, with some 80 bytes for each of
    its bytes while its suffixes are picked. Ties between q-gram hashes go to the leftmost. An empty table
    gives an empty result. With ``texts``, a character of which a byte went is dropped whole. Other columns
    are not read but for those that ``keep`` names, which are returned as well and must not have the names
    of the result. A ``length`` of less than ``GRAM`` bytes is refused. With ``words``, a byte also goes when a
    string of so many whole words that covers it also occurs elsewhere, however few bytes it has.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM} bytes")
    if words < 0:
        raise ValueError("words must not be negative")
    d = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.lit(7), F.col(text)).alias("v"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    starts = repeated_starts(d.select("doc", "v", "text"), length)
    if words:
        spans = repeated_words(d.select("doc", "v", "text"), words)
        starts = starts.unionByName(spans.select("doc", "v", "lo", (F.col("end") - length).alias("hi")))
    starts = starts.groupBy("doc", "v").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    starts = stage(starts.select(F.col("doc").alias("_doc"), F.col("v").alias("_v"), "lo", "hi"), "starts")
    joined = d.join(starts, (F.col("doc") == F.col("_doc")) & (F.col("v") == F.col("_v")), "left").select(F.when(F.col("doc") < LAST, F.col("doc")), "text", "lo", "hi", *[F.col(f"_{i}") for i in range(len(keep))])
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, out string", *[f"_{i} {kinds[c]}" for i, c in enumerate(keep)]])
    return joined.mapInArrow(tidy(_finish(length, texts)), schema).toDF("doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256", *keep)
