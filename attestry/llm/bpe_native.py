"""The BPE fold as Spark higher-order functions over a literal rank map, for columns of distinct words.

Ids of neighbouring parts are looked up in the map; the least rank merges, leftmost first; the fold runs
once for each byte but one. The map is a literal: buckets of packed pairs and their ranks, by remainder. It
holds about 108,000 pairs, whatever the input. See the README for what this costs against ``bpe``, which
folds the same way over Arrow batches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, _read

_BUCKETS = 16381


def _map(codec: Codec) -> tuple[Column, Column]:
    """The literal pair map and the literal ids of single bytes."""
    buckets = [{"k": [], "r": []} for _ in range(_BUCKETS)]
    for key, rank in zip(codec.keys.tolist(), codec.values.tolist(), strict=True):
        packed = (key >> 32) * 65536 + (key & 0xFFFFFFFF)
        buckets[packed % _BUCKETS]["k"].append(packed)
        buckets[packed % _BUCKETS]["r"].append(rank)
    pairs = F.from_json(F.lit(json.dumps(buckets)), "array<struct<k:array<bigint>,r:array<int>>>")
    return pairs, F.from_json(F.lit(json.dumps(codec.bytes.tolist())), "array<int>")


def encode_words(words: DataFrame, rank_path: str, pattern: str, word: str = "word") -> DataFrame:
    """``word, ids`` of every row of a table of words, each a match of the pattern; null and empty words have no ids."""
    codec = Codec(_read(rank_path), pattern)
    pairs, single = _map(codec)
    digits = F.hex(F.coalesce(F.col(word), F.lit("")))

    def rank(a: Column, b: Column) -> Column:
        key = a.cast("bigint") * 65536 + b
        found = F.get(pairs, (key % _BUCKETS).cast("int"))
        return F.get(found["r"], (F.array_position(found["k"], key) - 1).cast("int"))

    def merge(ids: Column, _: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: rank(F.get(ids, i), F.get(ids, i + 1)))

        def put(r: Column) -> Column:
            least = F.array_min(r)
            at = F.array_position(r, least).cast("int")
            return F.when(least.isNull(), ids).otherwise(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(least), F.slice(ids, at + 2, F.size(ids))))

        return F.when(F.size(ids) < 2, ids).otherwise(F.transform(F.array(ranks), put)[0])  # ranks are worked out once

    d = words.select(word, F.when(F.length(digits) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.get(single, F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))).alias("_b"))
    steps = F.when(F.size("_b") < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size("_b") - 1))
    return d.select(word, F.aggregate(steps, F.col("_b"), merge).alias("ids"))
