"""MinHash near-dedup of documents with an LSH forest.

Signatures of up to 120 minima stand in sorted orders, each starting at another run of values: 24 orders and
runs of five at 85 hundredths, 27 and runs of four at 80. Documents that agree on an order's first run form a
region; in a region, neighbours in the order share the longest prefixes and are compared first, and dense
regions are cut at deeper prefixes. What neighbours leave open is settled exactly (see neardup). A pair at the
threshold is missed by all regions once in a million.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import scratch, stage, tidy
from .neardup import forest_rows, near_components

LAST = 2**63 - 1


def tune(threshold: float, miss: float = 1e-6, most: int = 120) -> tuple[int, int]:
    """Bands and rows: the longest rows whose number of bands, for that miss rate, stays within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _signed(size: int, hashes: int, sets: bool):
    def run(batches):
        for batch in batches:
            for rows, data, bounds in sh.text_chunks(batch, 1):
                h, at, n, _ = sh.shingles(data, bounds, size)
                sorted_sets = [sh.distinct(h[a : a + k]) for a, k in zip(at, n, strict=True)]
                count = pa.array([len(s) for s in sorted_sets], pa.int64())
                digests = pa.array([sh.digest(s) for s in sorted_sets], pa.binary())
                ids = batch.column(0)[rows.start : rows.stop]
                if sets:
                    ends = np.cumsum([0, *map(len, sorted_sets)], dtype=np.int32)
                    values = np.concatenate(sorted_sets).view(np.int64) if sorted_sets else np.empty(0, np.int64)
                    extra = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                else:
                    full = np.flatnonzero(n > 0)
                    kept = np.empty(len(n), object)
                    if len(full):
                        s = (sh.mix(sh.signatures(h, at[full], hashes).astype(np.uint64)) >> np.uint64(48)).astype(">u2")
                        kept[full] = [r.tobytes() for r in s]
                    extra = pa.array(kept.tolist(), pa.binary())
                rest = [c[rows.start : rows.stop] for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([ids, count, digests, extra, *rest], ["doc_id", "n", "digest", "x", *batch.schema.names[2:]])

    return run


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85, tag: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Links join documents whose sets of word shingles have a Jaccard similarity of ``percent`` hundredths or
    more; equal sets are collapsed before anything else. Texts that are null, empty or without words have an
    empty set and link with nothing. Rows with a null key link like others; their key counts as the greatest,
    so that ``component_id`` is null only among themselves. Rows with equal keys and texts share a component.
    A text's set is held in memory whole, whatever its length. An empty table gives an empty result. Other
    columns are not read, so clashing names do not matter; ``tag`` names one to return as ``tag``, with
    ``component``, which tells components apart also where their least keys are equal or null.
    """
    trees, depth = tune(percent / 100)
    extra = [F.col(tag).alias("tag")] if tag else []
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *extra)
    more = f", tag {dict(d.dtypes)['tag']}" if tag else ""
    signed = stage(d.mapInArrow(tidy(_signed(size, trees * depth, False)), f"doc_id long, n long, digest binary, x binary{more}"), "signed")
    k = F.coalesce("doc_id", F.lit(LAST))
    with scratch() as keep:
        found = keep(_components(d.select("doc_id", "text"), signed, k, trees, depth, size, percent))
    out = signed.select("doc_id", "n", "digest", *["tag"] * bool(tag)).join(found.hint("merge"), "digest", "left")
    own = F.when(F.col("n") > 0, F.when(F.col("component.k") < LAST, F.col("component.k"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *["tag", "component"] * bool(tag))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *["tag", "component"] * bool(tag))


def _components(d: DataFrame, signed: DataFrame, k: Column, trees: int, depth: int, size: int, percent: int) -> DataFrame:
    """``digest, component`` of every set that is not empty."""
    item = F.struct(F.col("k"), F.xxhash64("digest").alias("v"))
    classes = signed.filter("n > 0").groupBy("digest").agg(F.min(F.struct(k.alias("k"), F.col("n"), F.col("x"))).alias("m"))
    classes = stage(classes.select("digest", F.col("m.k").alias("k"), F.col("m.n").alias("n"), F.col("m.x").alias("sig")).select(item.alias("item"), "n", "sig", "digest"), "classes")
    rows = forest_rows(classes, trees, depth)

    wanted = stage(rows.select("item").distinct().select(F.col("item.k").alias("k"), "item"), "wanted")
    texts = d.withColumn("k", k).join(wanted.select("k").distinct().hint("merge"), "k", "left_semi").select("k", "text")
    sets = texts.mapInArrow(tidy(_signed(size, 0, True)), "doc_id long, n long, digest binary, x array<long>")
    sets = sets.select(F.struct(F.col("doc_id").alias("k"), F.xxhash64("digest").alias("v")).alias("item"), F.col("x").alias("s")).dropDuplicates(["item"])
    sets = stage(sets.join(wanted.select("item").hint("merge"), "item", "left_semi"), "sets")
    components = near_components(rows, sets, percent)
    found = classes.join(components.hint("merge"), F.col("item") == F.col("node"), "left").select("digest", F.coalesce("component", "item").alias("component"))
    return stage(found, "found")


def op1_sql() -> str:
    """All pairs by an inverted index, for DuckDB on ``documents``."""
    return """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) c ON c.node = d.doc_id"""
