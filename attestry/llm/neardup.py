"""Near-duplicate classes from candidate buckets, exact within them, without pairing up whole buckets.

Items that share a bucket are candidates. First only neighbours in the bucket's signature order are
verified, which joins most of a group of copies. Buckets that still hold several components are then
settled exactly. In small ones, the pairs between components that set sizes and shingles of one item alone
do not rule out are verified. Large ones are dealt out in pairs of bounded blocks, each of which counts the
common shingles of all its pairs as a matrix product and returns no more links than it has items. Pairs
inside one component need no test, as they cannot change it. Joins ask for a shuffle, so that a plan does
not change with the input's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, scratch, stage
from .components import connected_components, contracted, parts

#: Buckets up to FEW items are ordered in every tree, larger ones in the first FAR trees; above DENSE items a
#: bucket is cut at a deeper prefix before it is sorted.
FEW, FAR, DENSE = 64, 8, 4096
#: Items and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000


def forest_rows(items: DataFrame, trees: int, depth: int, width: int = 2) -> DataFrame:
    """``bucket, tree, item, n, c, deep`` of ``items(item, n, sig)``, for buckets of two items or more.

    Tree t orders signatures from their value t * depth on, round the end. Its buckets share the first
    ``depth`` values; ``deep`` has the others in the tree's order, ``c`` is the bucket's size.
    """
    cut = depth * width
    prefix = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", t * cut + 1, cut)) for t in range(trees)])
    rows = items.select("item", "n", F.posexplode(prefix).alias("tree", "bucket"))
    shared = stage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "buckets")
    start = F.col("tree") * cut
    deep = F.concat(F.col("sig").substr(start + cut + 1, F.lit(2**30)), F.col("sig").substr(F.lit(1), start))
    rows = rows.join(shared.hint("merge"), "bucket").join(items.select("item", "sig").hint("merge"), "item")
    rows = stage(rows.select("bucket", "tree", "item", "n", "c", deep.alias("deep")), "forest")
    discard(shared)
    return rows


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets' Jaccard similarity is ``percent`` hundredths or more."""
    one = pairs.join(sets.select(F.col("item").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = one.join(sets.select(F.col("item").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def _may(na, nb, least_common, least_union, percent: int):
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * least_common >= percent * least_union)


def near_components(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the items that have a partner, from ``forest_rows`` and ``sets(item, s)``."""
    with scratch() as keep:
        return keep(_settled(rows, sets, percent))


def _settled(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    steps = F.ceil(F.log(F.col("c") / DENSE) / -math.log(0.85)).cast("int")
    region = F.when(F.col("c") > DENSE, F.col("deep").substr(F.lit(1), 2 * steps))
    order = Window.partitionBy("bucket", region).orderBy("deep", "item")
    ahead = F.array(*[F.lead(F.struct("item", "n"), k).over(order) for k in (1, 2)])
    near = rows.filter((F.col("c") <= FEW) | (F.col("tree") < FAR)).select("item", "n", ahead.alias("ahead"))
    near = near.select("item", "n", F.explode("ahead").alias("o")).filter(F.col("o").isNotNull())
    fits = 100 * F.least("n", "o.n") >= percent * F.greatest("n", "o.n")
    tested = stage(near.filter(fits).select(F.least("item", "o.item").alias("a"), F.greatest("item", "o.item").alias("b")).distinct(), "pairs")
    links = stage(_verified(tested, sets, percent), "links")
    edges = contracted(links, rounds=2)  # parts of a component will do here

    placed = rows.select("bucket", "item", "n", "c").join(parts(edges).hint("merge"), F.col("item") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "item"))
    placed = stage(placed.select("bucket", "item", "n", "c", "comp"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("total")).filter(F.col("lo") != F.col("hi")).select("bucket", "total")
    placed = stage(placed.join(stage(mixed, "mixed").hint("merge"), "bucket"), "unsettled")
    more = _verified(_across(placed.filter(F.col("c") <= FEW), sets, tested, percent), sets, percent).unionByName(_by_blocks(placed.filter(F.col("c") > FEW), sets, percent))
    return stage(connected_components(edges.unionByName(more), "a", "b"), "components")


def _across(placed: DataFrame, sets: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Untested pairs between components of a bucket that may be near: no bound on their similarity rules them out."""
    own = sets.join(placed.select("item").distinct().hint("merge"), "item", "left_semi").select("item", F.explode("s").alias("h"))
    alone = own.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("item").alias("item")).filter("c = 1").groupBy("item").agg(F.count(F.lit(1)).alias("u"))
    placed = placed.join(alone.hint("merge"), "item", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    placed = stage(placed.select("bucket", "item", "n", "comp", "u"), "bounded")
    x, y = (placed.select("bucket", *[F.col(k).alias(k + p) for k in ("item", "n", "comp", "u")]) for p in "ab")
    common = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
    union = F.greatest(F.col("na") + F.col("ub"), F.col("nb") + F.col("ua"))
    across = x.join(y.hint("merge"), (x["bucket"] == y["bucket"]) & (F.col("itema") < F.col("itemb")) & (F.col("compa") != F.col("compb")) & _may(F.col("na"), F.col("nb"), common, union, percent))
    return across.select(F.col("itema").alias("a"), F.col("itemb").alias("b")).distinct().join(tested.hint("merge"), ["a", "b"], "left_anti")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x shares with each of y, exactly: a product of 0/1 matrices in strips."""
    parts = [np.concatenate(p) if p else np.empty(0, np.int64) for p in (x, y)]
    both = np.intersect1d(*map(np.unique, parts), assume_unique=True)
    out = np.zeros((len(x), len(y)), np.float32)
    cells = []
    for side, values in zip((x, y), parts, strict=True):
        column = np.searchsorted(both, values)
        hit = both[np.minimum(column, len(both) - 1)] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(column[hit], kind="stable")
        cells.append((np.repeat(np.arange(len(side)), [len(v) for v in side])[hit][order], column[hit][order]))
    for a in range(0, len(both), 4096):
        strips = []
        for side, (row, column) in zip((x, y), cells, strict=True):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            strip = np.zeros((len(side), min(4096, len(both) - a)), np.float32)
            strip[row[lo:hi], column[lo:hi] - a] = 1
            strips.append(strip)
        out += strips[0] @ strips[1].T
    return out


def _links(percent: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        items = block.column("item").combine_chunks()
        comp, mine = block.column("comp").to_numpy(), block.column("mine").to_numpy()
        lists = block.column("s").combine_chunks()
        at, values = np.asarray(lists.offsets), np.asarray(lists.values)
        sets = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        size = np.diff(at).astype(np.int64)
        names, label = np.unique(comp, return_inverse=True)
        same = mine.min() == mine.max()
        x, y = (np.arange(len(mine)),) * 2 if same else (np.flatnonzero(mine == mine.min()), np.flatnonzero(mine == mine.max()))
        most = np.bincount(label).argmax()
        pairs, parent = [], np.arange(len(names))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # all pairs but those inside the block's largest component
        for p, q in ((x[label[x] != most], y), (x[label[x] == most], y[label[y] != most])):
            if (same and q is not y) or not len(p) or not len(q):
                continue
            i = np.rint(_common([sets[k] for k in p], [sets[k] for k in q])).astype(np.int64)
            near = 100 * i >= percent * (size[p][:, None] + size[q][None, :] - i)
            while True:
                now = np.array([root(k) for k in range(len(names))])[label]
                open_ = near & (now[p][:, None] != now[q][None, :])
                hit = np.flatnonzero(open_.any(1))
                if not len(hit):
                    break
                for r, c in zip(hit, open_[hit].argmax(1), strict=True):
                    ra, rb = root(label[p[r]]), root(label[q[c]])
                    if ra != rb:
                        parent[ra] = rb
                        pairs.append((p[r], q[c]))
        a, b = (np.array([t[k] for t in pairs], np.int64) for k in (0, 1))
        return pa.table({"a": items.take(pa.array(a)), "b": items.take(pa.array(b))})

    return run


def _by_blocks(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of each bucket, from pairs of blocks of ``placed(bucket, item, c, comp, total)``."""
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    p = placed.select("bucket", "item", F.xxhash64("comp").alias("comp"), F.pmod(F.xxhash64("item"), blocks).alias("mine"), blocks.alias("k"))
    p = p.select("bucket", "item", "comp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    p = p.select("bucket", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "item", "comp", "mine")
    p = p.join(sets.hint("merge"), "item").select("bucket", "i", "j", "item", "comp", "mine", "s")
    kind = dict(p.dtypes)["item"]
    return p.groupBy("bucket", "i", "j").applyInArrow(_links(percent), f"a {kind}, b {kind}")
