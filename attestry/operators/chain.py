"""The hash-chained event log: ordered in pieces, chained from one to the next, verified in parallel."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage

GENESIS = "0" * 64
COLUMNS = "seq long, ts string, kind string, fact_id string, payload string, prev_hash string, hash string"


def _material(prev: Column) -> Column:
    return F.concat_ws("|", prev, F.col("seq").cast("string"), "ts", "kind", F.coalesce("fact_id", F.lit("")), "payload")


#: Events that one task puts in order.
PIECE = 400_000
_FIELDS = [f.split() for f in COLUMNS.split(", ")]
_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in _FIELDS])


def _chained(batch: pa.RecordBatch, prev: str, seq: int) -> list[tuple]:
    """The events of a batch of ``ts, kind, fact_id, payload``, chained after ``prev`` and ``seq``."""
    rows = []
    for ts, kind, fact, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
        seq += 1
        this = hashlib.sha256("|".join((prev, str(seq), ts, kind, fact or "", payload)).encode()).hexdigest()
        rows.append((seq, ts, kind, fact, payload, prev, this))
        prev = this
    return rows


def _log(batches: Iterator[pa.RecordBatch], prev: str, seq: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if rows := _chained(batch, prev, seq):
            seq, prev = rows[-1][0], rows[-1][-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def build(events: DataFrame, order: list[str], head: str = GENESIS, last_seq: int = 0) -> DataFrame:
    """Chain ``events(ts, kind, fact_id, payload)`` in the order of ``order`` after ``head``.

    Every hash takes in the one before. Up to ``PIECE`` events are one task. More are staged in ordered pieces; the
    head of each piece is worked out in turn, in a task of its own that hands on one hash, and from the heads the
    log is chained by pieces, side by side. A null time, kind or payload counts as empty text.
    """
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("ts", "kind", "payload")]
    fields = ["ts", "kind", "fact_id", "payload"]
    d = events.select(*given, "fact_id", *order)
    n = events.count()
    if n <= PIECE:
        return d.coalesce(1).sortWithinPartitions(*order).select(*fields).mapInArrow(lambda batches: _log(batches, head, last_seq), COLUMNS)
    ranges = d.repartitionByRange(-(-n // PIECE), *order).sortWithinPartitions(*order).select(*fields, F.monotonically_increasing_id().alias("_at"))
    staged = stage(ranges.withColumn("_piece", F.shiftright("_at", 33).cast("int")), "events", ["_piece"])
    rest = F.concat_ws("|", "ts", "kind", F.coalesce("fact_id", F.lit("")), "payload")
    heads = {}
    prev, seq = head, last_seq
    for piece in sorted(r[0] for r in staged.select("_piece").distinct().collect()):
        heads[piece] = (prev, seq)
        one = staged.filter(F.col("_piece") == piece).coalesce(1).sortWithinPartitions("_at").select(rest)
        seq, prev = one.mapInArrow(_last(prev, seq), "seq long, hash string").head()

    def pieces(batches):
        at = prev = seq = None
        for batch in batches:
            piece = batch.column(4).to_numpy()
            for start, end in itertools.pairwise([*np.flatnonzero(np.diff(piece, prepend=-1)), len(piece)]):
                if at != piece[start]:
                    at = piece[start]
                    prev, seq = heads[at]
                for out in _log([batch.slice(start, end - start)], prev, seq):
                    seq, prev = out.column(0)[-1].as_py(), out.column(6)[-1].as_py()
                    yield out

    dealt = staged.repartitionByRange(len(heads), "_piece").sortWithinPartitions("_at")
    return dealt.select(*fields, "_piece").mapInArrow(pieces, COLUMNS)


def _last(prev: str, seq: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row: ``seq, hash`` of the last of the events, which are given as what their hash takes in after ``seq``."""

    def run(batches):
        last, number, sha256 = prev, seq, hashlib.sha256
        for batch in batches:
            for rest in batch.column(0).to_pylist():
                number += 1
                last = sha256(f"{last}|{number}|{rest}".encode()).hexdigest()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([last])], names=["seq", "hash"])

    return run


def violations(log: DataFrame) -> DataFrame:
    """``seq, reason`` of every event that breaks the chain, each against its predecessor: one join on ``seq``."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected"))
    altered = F.col("hash") != F.sha2(_material(F.col("prev_hash")), 256)  # before the join, which then moves hashes only
    d = log.select("seq", "prev_hash", altered.alias("altered")).join(before, "seq", "left")
    opens = F.col("seq") == 1
    reason = F.when(~opens & F.col("expected").isNull(), F.concat(F.lit("gap in sequence before "), F.col("seq").cast("string")))
    reason = reason.when(F.col("prev_hash") != F.when(opens, GENESIS).otherwise(F.col("expected")), "previous hash does not match")
    reason = reason.when(F.col("altered"), "event content was altered")
    return d.select("seq", reason.alias("reason")).filter(F.col("reason").isNotNull())


def verify(log: DataFrame) -> DataFrame:
    """One row: ``ok, events, first_bad, reason``, where events counts up to the first bad one."""
    bad = violations(log).agg(F.min(F.struct("seq", "reason")).alias("b"))
    counted = log.join(F.broadcast(bad), F.col("b").isNull() | (F.col("seq") <= F.col("b.seq")))
    return counted.agg(F.count(F.lit(1)).alias("events"), F.first("b").alias("b")).select(F.col("b").isNull().alias("ok"), "events", F.col("b.seq").alias("first_bad"), F.coalesce("b.reason", F.lit("")).alias("reason"))


def head(log: DataFrame) -> DataFrame:
    """One row: ``seq, hash`` of the last event."""
    return log.agg(F.max(F.struct("seq", "hash")).alias("m")).select(F.coalesce("m.seq", F.lit(0)).alias("seq"), F.coalesce("m.hash", F.lit(GENESIS)).alias("hash"))


def tail(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def export(log: DataFrame, path: str) -> None:
    """JSON lines by ``seq``, in files in that order, with payloads as the objects that they hold."""
    plain = [c for c in log.columns if c != "payload"]
    payload = F.coalesce(F.try_parse_json("payload"), F.to_variant_object(F.struct(F.col("payload").alias("text"))))
    log.select(*plain, payload.alias("payload")).orderBy("seq").write.mode("overwrite").json(path)
