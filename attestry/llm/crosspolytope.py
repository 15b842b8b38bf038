"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a fast Hadamard transform, and hashed to the nearest
of the signed axes; ``rotations`` such hashes make the bucket of a table. Multiprobe also files a vector
under the bucket that the second nearest axis gives, one rotation at a time. Vectors that share a bucket are
compared by exact cosine, in pairs of bounded blocks. A pair counts only in the first bucket that it shares,
which both sides' codes tell, so that no pair leaves a block: it returns counts and spanning links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, tidy
from .components import connected_components

TABLES, BLOCK = 8, 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def _axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the nearest and the second nearest signed axis after a rotation."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = _hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    big = np.abs(x)
    first = big.argmax(1)
    rows = np.arange(len(x))
    big[rows, first] = -1
    second = big.argmax(1) if x.shape[1] > 1 else first
    return 2 * first + (x[rows, first] < 0), 2 * second + (x[rows, second] < 0)


def bucket_codes(x: np.ndarray, rotations: int, tables: int = TABLES, seed: int = 11) -> np.ndarray:
    """``(vectors, tables, 1 + rotations)`` codes of unit vectors: the own bucket, then the probed ones."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.empty((len(x), tables, rotations + 1), np.int64)
    for t in range(tables):
        axes = [_axes(x, seed + 1000 * t + r) for r in range(rotations)]
        scale = [(2 * width) ** r for r in range(rotations)]
        own = sum(a * s for (a, _), s in zip(axes, scale, strict=True))
        out[:, t, 0] = own
        for r, ((a, b), s) in enumerate(zip(axes, scale, strict=True)):
            out[:, t, r + 1] = own + (b - a) * s
    return out


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _coded(rotations: int):
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            for d in np.unique(np.diff(np.asarray(lists.offsets))):
                rows = np.flatnonzero(np.diff(np.asarray(lists.offsets)) == d)
                codes = bucket_codes(_unit(lists.take(pa.array(rows))), rotations).reshape(len(rows), -1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), flat], ["id", "codes"])

    return run


def _spread(near: np.ndarray) -> list[tuple[int, int]]:
    """Links ``(row, column)`` that span the components of a bipartite graph."""
    parent = list(range(sum(near.shape)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    while True:
        now = np.array([root(i) for i in range(len(parent))])
        open_ = near & (now[: len(near), None] != now[None, len(near) :])
        hit = np.flatnonzero(open_.any(1))
        if not len(hit):
            return out
        for r, c in zip(hit, open_[hit].argmax(1), strict=True):
            a, b = root(r), root(len(near) + c)
            if a != b:
                parent[a] = b
                out.append((r, c))


def _compare(cosine: float, probes: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        ids, copies, mine = (block.column(c).to_numpy() for c in ("id", "copies", "mine"))
        x = _unit(block.column("vector").combine_chunks())
        codes = np.asarray(block.column("codes").combine_chunks().flatten()).reshape(len(ids), -1, probes)
        table, bucket = block.column("t")[0].as_py(), block.column("code")[0].as_py()
        same = mine.min() == mine.max()
        p, q = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(mine == mine.min()), np.flatnonzero(mine == mine.max()))
        near = x[p] @ x[q].T >= cosine
        if same:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        first = np.ones(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            u, v = codes[p[i[a : a + (1 << 16)]]], codes[q[j[a : a + (1 << 16)]]]
            early = (u[:, :table, :, None] == v[:, :table, None, :]).any((1, 2, 3))
            shared = (u[:, table, :, None] == v[:, table, None, :]) & (u[:, table, :, None] < bucket)
            first[a : a + (1 << 16)] = ~early & ~shared.any((1, 2))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, p[i[first]], copies[q[j[first]]])
        if not same:
            np.add.at(links, q[j[first]], copies[p[i[first]]])
        hit = np.flatnonzero(links)
        span = _spread(near)
        a, b = (np.array([s[k] for s in span], np.int64) for k in (0, 1))
        out = [np.concatenate([ids[hit], ids[p[a]]]), np.concatenate([ids[hit], ids[q[b]]]), np.concatenate([links[hit], np.zeros(len(a), np.int64)])]
        return pa.table(dict(zip("abn", out, strict=True)))

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors are compared within equal labels and lengths. A vector that is null or zero, or has a null or
    non-finite part, and one with a null label, links with nothing. Equal vectors are collapsed first, and
    count as links of each other. Keys should differ; rows with equal keys get one answer between them, and
    null keys are not supported by ``component_id`` and stand alone.
    """
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vector", lambda e: e != 0), F.lit(False))
    v = v.withColumn("vector", F.when(usable, F.transform("vector", lambda e: e + F.lit(0.0))))
    some = v.filter("vector IS NOT NULL")
    classes = stage(some.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")
    largest = classes.groupBy("label", F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.max("d")).head()
    width = 2 << max(1, ((largest[1] or 1) - 1).bit_length())
    rotations = max(2, math.ceil(math.log(8 * (largest[0] or 1)) / math.log(width)))
    coded = stage(classes.select("id", "vector").mapInArrow(tidy(_coded(rotations)), "id long, codes array<long>"), "codes")
    probes = rotations + 1
    place = classes.select("id", "label", F.size("vector").alias("d"))
    rows = coded.join(place.hint("merge"), "id").select("id", "label", "d", F.posexplode("codes").alias("pos", "code"))
    rows = rows.select("id", "label", "d", F.floor(F.col("pos") / probes).cast("int").alias("t"), "code").distinct()
    at = ["label", "d", "t", "code"]
    shared = stage(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    rows = rows.join(shared.hint("merge"), at).withColumns({"k": blocks, "mine": F.pmod(F.xxhash64("id"), blocks)})
    rows = rows.select("id", *at, "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    rows = rows.select("id", *at, "mine", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"))
    full = stage(classes.select("id", "copies", "vector").join(coded.hint("merge"), "id"), "vectors")
    rows = rows.join(full.hint("merge"), "id")
    found = stage(rows.groupBy(*at, "i", "j").applyInArrow(_compare(cosine, probes), "a long, b long, n long"), "compared")
    discard(shared)

    counts = stage(found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("links")), "counts")
    components = stage(connected_components(found.filter("a <> b"), "a", "b"), "components")
    known = classes.join(counts.hint("merge"), F.col("id") == F.col("a"), "left").join(components.hint("merge"), F.col("id") == F.col("node"), "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = v.join(stage(known, "known").hint("merge"), ["label", "vector"], "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def op4_sql() -> str:
    """All pairs within a label, for DuckDB on ``embeddings``."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT *, sqrt(list_inner_product(e, e)) AS len FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.node = l.a WHERE r.c < l.b),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, vec_id = m.c AS kept
FROM embeddings JOIN m ON m.node = vec_id LEFT JOIN n ON n.a = vec_id"""
