"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range. What is kept depends on the
shingle alone, so sketches of texts of any lengths can be compared, and the sketch of a union is the union
of the sketches. Shingles are 16 bytes of UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

WIDTH, FRACTION = 16, 16
_DIGITS = 12
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def sketch(data: bytes, fraction: int = FRACTION) -> np.ndarray:
    """The kept hashes of a text's bytes, sorted, their upper 48 bits each.

    A text shorter than a shingle is one shingle, padded. Where nothing falls below the fraction the least
    hash is kept, so that only the empty text has an empty sketch.
    """
    if not data:
        return np.empty(0, np.uint64)
    if len(data) < WIDTH:
        data = data + bytes([len(data)]) * (WIDTH - len(data))
    n = len(data) - WIDTH + 1
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * _K[0]
    h ^= h >> np.uint64(32)
    h += np.ndarray((n,), "<u8", data, 8, (1,))
    h *= _K[1]
    h ^= h >> np.uint64(29)
    h *= _K[2]
    h ^= h >> np.uint64(32)
    kept = h[h < np.uint64(2**64 // fraction)]
    return np.unique((kept if len(kept) else h.min(keepdims=True)) >> np.uint64(16))


def to_text(s: np.ndarray) -> str:
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.array([int(s[i : i + _DIGITS], 16) for i in range(0, len(s), _DIGITS)], np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has; 1 for the empty text."""
    return float(len(np.intersect1d(a, b, assume_unique=True)) / len(a)) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _judge(row: tuple, after: tuple) -> tuple:
    doc_id, text, own = row
    half = len(text) // 2
    changed = (text[: len(text) - half] + after[1][:half]).encode()
    edited = sketch(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), to_text(own), to_text(edited), likeness(own, edited), likeness(own, after[2])


def _walk(batches):
    """Rows come by bucket and order; each waits for the next, and the one from the bucket's far edge only closes it."""
    last, bucket = None, None
    for batch in batches:
        found = []
        for b, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                last, bucket = None, b
            now = (doc_id, text, sketch(text.encode()))
            if last is not None:
                found.append(_judge(last, now))
            last = None if tail else now
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), _OUT, strict=True)], schema=_OUT)


def fingerprint_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_docs: int = 5000) -> DataFrame:
    """Fingerprint every text, its edited text, and compare with both the edited and the next document.

    Order is by descending key, nulls last; equal keys stand by the text's digest, and equal rows stay
    equal. The last row's next is the first; a single row is its own next. Null texts count as empty. An empty table
    gives an empty result. Documents are dealt to ranges of the key; of each range only the head's key and
    digest come to the driver, and each head is sent to the range before its own as well.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = d.count()
    if n == 0:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    most = min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_docs)))
    cuts = sorted({int(x) for x in d.approxQuantile("doc_id", [i / most for i in range(1, most)], 0.25 / most)}, reverse=True)
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(above))
    first = F.min(F.struct(-F.coalesce("doc_id", F.lit(0)), F.md5("text")).alias("head"))
    heads = sorted((r.bucket, *r.head) for r in d.groupBy("bucket").agg(first.alias("head")).collect())  # a row for each range
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    by_bucket = {b: (minus, digest) for b, minus, digest in heads}
    rows = [by_bucket.get(b, (None, None)) + (before.get(b),) for b in range(len(cuts) + 2)]
    known = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(h).cast("string").alias("h"), F.lit(t).cast("int").alias("t")) for m, h, t in rows])
    d = d.withColumn("_h", F.element_at(known, F.col("bucket") + 1))
    is_head = (F.coalesce("doc_id", F.lit(0)) == -F.col("_h.m")) & (F.md5("text") == F.col("_h.h"))
    target = F.when(is_head, F.col("_h.t"))
    seats = F.array(F.struct(F.col("bucket").cast("int").alias("b"), F.lit(False).alias("tail")))
    seats = F.when(target.isNull(), seats).otherwise(F.concat(seats, F.array(F.struct(target.alias("b"), F.lit(True).alias("tail")))))
    dealt = d.select("doc_id", "text", F.explode(seats).alias("s")).select("s.b", "s.tail", "doc_id", "text").repartition(len(heads), "b")
    ordered = dealt.sortWithinPartitions("b", "tail", F.col("doc_id").desc_nulls_last(), F.md5("text"))
    return ordered.mapInArrow(tidy(_walk), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
