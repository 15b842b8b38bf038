"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hang each node's larger neighbours on the least one around it. Small: also its smaller ones and itself."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stage(around.groupBy("u").agg(F.min("v").alias("m")), "least")  # alone, so that Spark can split a hot node in the join
    hung = around.join(least, "u")
    if large:
        out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    else:
        out = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    done = stage(out.distinct(), "star")
    discard(least)
    return done


def _settled(edges: DataFrame) -> bool:
    """Every node with an edge upwards has one, and nothing hangs on it."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 0 AND up + down > 1").isEmpty()


def _round(edges: DataFrame) -> DataFrame:
    half = _star(edges, large=True)
    after = _star(half, large=False)
    discard(half)
    return after


def contracted(links: DataFrame, rounds: int) -> DataFrame:
    """Edges ``a, b`` with the components of the staged ``links(a, b)``, after some rounds; b is less than a."""
    now = links.filter(F.col("a") != F.col("b")).select("a", "b")
    for done in range(rounds):
        after = _round(now)
        if done:
            discard(now)
        now = after
    return now


def parts(edges: DataFrame) -> DataFrame:
    """``node, component`` from ``contracted`` edges, where a component may still be in several parts."""
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    heads = heads.join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(heads)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the least node reachable.

    Repeated and reversed links are welcome, self-links say nothing and nulls are not allowed. Rounds double
    the reach, and their state is written to shared storage. A node with many links is never gathered in
    one place.
    """
    now = stage(links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "links")
    while True:
        after = _round(now)
        discard(now)
        now = after
        if _settled(now):
            break
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
