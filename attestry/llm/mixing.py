"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Everything is DataFrame work. Targets come from water-filling: weights share the whole budget, a source
stops at ``cap`` times its own size, and what it leaves is shared again by weight. The budget is cut into
blocks of ``block`` words; highest quotients ``votes / (2 s + 1)`` give every source, and then every shard
of a source, a whole number of blocks. Inside a shard the documents stand in a seeded order, and its
blocks are taken from the front, in as many rounds as the quota fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, word_count


def sainte_lague(df: DataFrame, group: list[str], order: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Give each row a whole number of the ``seats`` of its group, in proportion to ``votes``.

    The rounded shares ``floor(votes * seats / total + 1/2)`` miss ``seats`` by at most half the group's
    rows, so only the last few quotients of each row are ranked: no more than its share of the rows plus 2.
    Equal quotients go by ``order``. A group without votes gets no seats.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(g), F.count(F.lit(1)).over(g)
    d = df.withColumns({"_v": F.col(votes).cast("double"), "_t": total.cast("double"), "_n": n})
    d = d.withColumn("_q", F.when(F.col("_t") > 0, F.floor(F.col("_v") * F.col(seats) / F.col("_t") + 0.5)).otherwise(0).cast("long"))
    d = d.withColumn("_d", F.when(F.col("_t") > 0, F.col(seats) - F.sum("_q").over(g)).otherwise(0))
    most = (F.ceil(F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).otherwise(0) * F.col("_n")) + 2).cast("long")
    steps = F.when((F.col("_d") > 0) & (F.col("_v") > 0), F.least(most, F.col("_d"))).when(F.col("_d") < 0, F.least(most, -F.col("_d"), F.col("_q"))).otherwise(0)
    keys = [*group, *order]
    add = F.col("_d") > 0
    turn = d.filter(steps > 0).select(*keys, "_v", "_q", "_d", F.explode(F.sequence(F.lit(1).cast("long"), steps)).alias("_k"))
    seat = F.when(add, F.col("_q") + F.col("_k")).otherwise(F.col("_q") - F.col("_k") + 1)
    quotient = F.col("_v") / (2 * seat - 1)
    ranked = turn.withColumn("_s", F.when(add, -quotient).otherwise(quotient))
    rank = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("_s", *[F.when(add, F.col(c)) for c in order], *[F.when(~add, F.col(c)).desc() for c in order]))
    won = ranked.withColumn("_r", rank).filter(F.col("_r") <= F.abs("_d")).groupBy(*keys).agg(F.sum(F.signum("_d")).cast("long").alias("_e"))
    return d.join(won, keys, "left").withColumn(out, F.col("_q") + F.coalesce("_e", F.lit(0))).drop("_v", "_t", "_n", "_q", "_d", "_e")


def _code(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))


def source_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Targets of ``sources(source, skey, source_size, n_docs)``: one window over the sources, not the documents."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("long")).withColumn("cap", cap * F.col("source_size"))
    s = s.withColumn("_ratio", F.col("cap") / F.col("weight"))
    everyone = Window.partitionBy(F.lit(0))
    before = everyone.orderBy("_ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everyone)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumns({"_total": total, "_level": left / rest})
    s = s.withColumn("_full", F.col("_level") > F.col("_ratio"))
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "skey", "_level"))).over(everyone)["_level"]
    return s.withColumn("target", F.when(F.col("_full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))).drop("_ratio", "_level", "_full")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 16, shard_docs: int = 2000, seed: str = "mix-1") -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Null sources form one source of their own, the last. Null, empty and blank texts have size 0 and
    nothing is taken from them. Equal rows may swap places, which gives the same result. An empty table
    gives an empty result. Other columns are not read, so clashing names do not matter.
    """
    skey = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    sizes = stage(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), skey.alias("skey"), word_count(F.col(text)).alias("size")), "sizes")
    sources = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = source_targets(sources, weights, cap).withColumn("blocks", F.floor(F.col("_total") / block).cast("long"))
    sources = sainte_lague(sources, [], ["skey"], "target", "blocks", "quota")
    sources = stage(sources.select("skey", "source_size", "target", "quota", F.ceil(F.col("n_docs") / shard_docs).cast("long").alias("n_shards")), "targets")

    shard = F.pmod(F.conv(F.substring(_code(seed, F.col("doc_id")), 1, 8), 16, 10).cast("long"), F.col("n_shards"))
    placed = sizes.join(sources, "skey").withColumn("shard", shard)
    shards = placed.groupBy("skey", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = stage(sainte_lague(shards, ["skey"], ["shard"], "shard_size", "quota", "shard_quota").select("skey", "shard", "shard_size", "shard_quota"), "quotas")

    rows = placed.join(shards, ["skey", "shard"])
    seeded = Window.partitionBy("skey", "shard").orderBy(_code(seed, F.col("doc_id")), "doc_id", "size")
    start = F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, -1))
    words = F.col("shard_quota") * block
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    extra = words - rounds * F.col("shard_size") - F.coalesce(start, F.lit(0))
    taken = F.least(cap * F.col("size"), rounds * F.col("size") + F.greatest(F.lit(0), F.least(extra, F.col("size"))))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_sql(block: int = 16, shard_docs: int = 2000, seed: str = "mix-1") -> str:
    """The same mix for DuckDB, on ``documents``."""

    def apportion(src: str, name: str, group: str, order: str, votes: str, seats: str) -> str:
        part = f"PARTITION BY {group}" if group else ""
        g = f"{group}, " if group else ""
        return f"""
{name}_a AS (SELECT *, {votes}::DOUBLE AS v_, sum({votes}) OVER ({part})::DOUBLE AS t_, count(*) OVER ({part}) AS n_ FROM {src}),
{name}_b AS (SELECT *, CASE WHEN t_ > 0 THEN floor(v_ * {seats} / t_ + 0.5)::BIGINT ELSE 0 END AS q_ FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN t_ > 0 THEN {seats} - sum(q_) OVER ({part}) ELSE 0 END AS d_,
  CASE WHEN t_ > 0 THEN ceil(v_ / t_ * n_) ELSE 0 END + 2 AS m_ FROM {name}_b),
{name}_d AS (SELECT {g}{order}, v_, q_, d_, unnest(range(1, (CASE WHEN d_ > 0 AND v_ > 0 THEN least(m_, d_) WHEN d_ < 0 THEN least(m_, -d_, q_) ELSE 0 END)::BIGINT + 1)) AS k_ FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN d_ > 0 THEN -(v_ / (2 * (q_ + k_) - 1)) ELSE v_ / (2 * (q_ - k_ + 1) - 1) END AS s_ FROM {name}_d),
{name}_f AS (SELECT *, row_number() OVER ({part} ORDER BY s_, CASE WHEN d_ > 0 THEN {order} END, CASE WHEN d_ <= 0 THEN {order} END DESC) AS r_ FROM {name}_e),
{name}_g AS (SELECT {g}{order}, sum(sign(d_))::BIGINT AS e_ FROM {name}_f WHERE r_ <= abs(d_) GROUP BY ALL),
{name} AS (SELECT c.*, q_ + coalesce(e_, 0) AS got FROM {name}_c c LEFT JOIN {name}_g g USING ({g}{order}))"""

    return f"""
WITH sizes AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT skey, source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sizes GROUP BY ALL),
ws AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM src),
wr AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM ws),
wl AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev FROM wr
  WINDOW b AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wt AS (SELECT *, CASE WHEN lev > ratio THEN cap::DOUBLE ELSE (SELECT lev FROM wl WHERE lev <= ratio ORDER BY ratio, skey LIMIT 1) * weight END AS target,
  total // {block} AS blocks, ceil(n_docs / {shard_docs})::BIGINT AS n_shards FROM wl),
{apportion("wt", "so", "", "skey", "target", "blocks")},
placed AS (SELECT z.doc_id, z.size, so.skey, so.source_size, so.target, so.got AS quota, md5('{seed}:' || z.doc_id::VARCHAR) AS code,
  ('0x' || substr(md5('{seed}:' || z.doc_id::VARCHAR), 1, 8))::BIGINT % so.n_shards AS shard FROM sizes z JOIN so USING (skey)),
sh AS (SELECT skey, shard, quota, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL),
{apportion("sh", "sq", "skey", "shard", "shard_size", "quota")},
rows_ AS (SELECT p.*, sq.shard_size, sq.got * {block} AS words, coalesce(sum(p.size) OVER (PARTITION BY p.skey, p.shard ORDER BY code, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM placed p JOIN sq USING (skey, shard)),
fin AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds FROM rows_)
SELECT doc_id, size, source_size, target,
  least(3 * size, rounds * size + greatest(0, least(words - rounds * shard_size - start_, size)))::BIGINT AS taken FROM fin"""
