"""Evaluation and calibration: AUROC by ranks, order-statistic thresholds, resampling by hashes, intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.hashes import first_words
from ..storage import stage

NAN = float("nan")


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """``struct<lo,hi>``: the Wilson interval of a share; NaN where nothing was counted."""
    share, pull = k / n, F.lit(z**2) / n
    middle = (share + pull / 2) / (pull + 1)
    half = F.sqrt(pull * (share - share * share + pull / 4)) / (pull + 1)
    empty = F.coalesce(n == 0, F.lit(True))
    at = lambda x: F.when(empty, F.lit(NAN)).otherwise(x)
    return F.struct(at(F.greatest(F.lit(0.0), middle - half)).alias("lo"), at(F.least(F.lit(1.0), middle + half)).alias("hi"))


#: Strips of the range 0 to 1 that scores are ordered in, each on its own.
STRIPS = 4096


def _strip(score: Column) -> Column:
    return F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * STRIPS)


def running(values: DataFrame, by: list[str], score: str, counts: list[str]) -> DataFrame:
    """``values`` with ``below_<count>``: sums over the rows of the group with a lower score, for distinct scores.

    A strip of scores is one task, and the sums of the strips before it come from a table of strips: no task
    orders a whole group. Scores outside 0 to 1 fall into the strips at the ends.
    """
    v = values.withColumn("_strip", _strip(F.col(score)))
    inside = Window.partitionBy(*by, "_strip").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = v.groupBy(*by, "_strip").agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
    strips = strips.select(*by, "_strip", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in counts])
    v = v.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts})
    same = [v[k].eqNullSafe(strips[k]) for k in [*by, "_strip"]]
    out = v.join(strips, same)
    return out.select(*[v[c] for c in values.columns], *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"below_{c}") for c in counts])


def auroc(scores: DataFrame, positive: str, score: str, by: list[str] | None = None) -> DataFrame:
    """``by, n_pos, n_neg, auroc``: chance that a positive outranks a negative, ties half.

    Scores are counted per value before anything is ranked, and running sums replace the pairs.
    """
    by = by or []
    values = scores.groupBy(*by, score).agg(F.sum(F.when(F.col(positive), 1).otherwise(0)).alias("p"), F.sum(F.when(~F.col(positive), 1).otherwise(0)).alias("n"))
    wins = running(values, by, score, ["n"]).withColumn("w", F.col("p") * (F.col("below_n") + F.col("n") / 2))
    out = wins.groupBy(*by).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), F.sum("w").alias("w"))
    return out.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).otherwise(F.lit(NAN))).drop("w")


def _kth(scores: DataFrame, score: str, k: int) -> float | None:
    """The k-th lowest value, by counts per value: the strip that holds it, and then the value inside."""
    counts = scores.groupBy(score).agg(F.count(F.lit(1)).alias("c"))
    row = running(counts, [], score, ["c"]).filter((F.col("below_c") < k) & (F.col("below_c") + F.col("c") >= k)).select(score).head()
    return None if row is None else row[0]


def threshold_for_loss(scores: DataFrame, score: str, loss: float) -> float:
    """The score below which a new supported claim falls with about this chance."""
    n = scores.count()
    return _kth(scores, score, min(max(1, int(loss * (n + 1))), n))


def just_above(value: Column) -> Column:
    """The least multiple of 1e-4 above a value."""
    steps = F.floor(value * 10_000)
    return F.when(steps / 10_000 > value, steps).when((steps + 1) / 10_000 > value, steps + 1).otherwise(steps + 2) / 10_000


def threshold_for_admission(scores: DataFrame, score: str, rate: float) -> float:
    """Just above the score that more than this share of unsupported claims reach; 0 if all may pass."""
    n = scores.count()
    k = int(rate * (n + 1))
    if k >= n:
        return 0.0
    top = _kth(scores, score, n - k)
    return scores.sparkSession.range(1).select(just_above(F.lit(top))).head()[0]


def score_for_thresholds(verdict: str = "verdict") -> Column:
    """What a threshold acts on: support, or 0 where a check failed."""
    return F.when(F.exists(f"{verdict}.checks", lambda c: ~c["passed"]), 0.0).otherwise(F.col(f"{verdict}.support"))


def _hash01(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 2**32


#: Vectors over the rounds that a task of ``resampled`` holds.
_HELD = 2048


def resampled(rows: DataFrame, prefix: str, rounds: int, marks: list[float]) -> DataFrame:
    """``round, s, c, w, m`` from ``rows(k, s, c)``: rows ``m`` of a score and class, and how many marks their hashes reach.

    The hash of a row in a round is that of ``_hash01`` of prefix, round and key. All are worked out, many at a
    time, and summed per score where they arise: rows come in ranges of scores, so that most of a score are in
    one task, and no row is written once for each round.
    """
    rows = stage(rows.select(F.col("k").cast("string").alias("k"), "s", F.col("c").cast("int").alias("c")), "scores")
    kind = to_arrow_type(rows.schema["s"].dataType)
    schema = pa.schema([("round", pa.int32()), ("s", kind), ("c", pa.int32()), ("w", pa.int64()), ("m", pa.int64())])
    limits = [np.uint32(math.ceil(x * 2**32)) for x in marks]

    def run(batches):
        prefixes = [f"{prefix}{r}:".encode() for r in range(1, rounds + 1)]
        held: dict[tuple, list] = {}

        def written():
            found = list(held.items())
            held.clear()
            for at in range(0, len(found), 64):
                part = found[at : at + 64]
                columns = [
                    pa.array(np.tile(np.arange(1, rounds + 1, dtype=np.int32), len(part))),
                    pa.array([s for (s, _), _ in part], kind).take(pa.array(np.repeat(np.arange(len(part)), rounds))),
                    pa.array(np.repeat(np.array([c for (_, c), _ in part], np.int32), rounds)),
                    pa.array(np.concatenate([w for _, (w, _) in part])),
                    pa.array(np.repeat(np.array([m for _, (_, m) in part], np.int64), rounds)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                k, s, c = (batch.column(i).slice(at, 1024) for i in range(3))
                scores = s.dictionary_encode("encode")
                group = scores.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 32) + c.to_numpy(zero_copy_only=False)
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                keys = [x and x.encode() for x in k.to_pylist()]
                ordered = [keys[i] for i in order]
                v = first_words(prefixes, [x or b"" for x in ordered])
                for j in (j for j, x in enumerate(ordered) if x is None):  # a null has no separator before it
                    v[:, j] = first_words([p[:-1] for p in prefixes], [b""])[:, 0]
                w = np.zeros(v.shape, np.uint8)
                for x in limits:
                    w += v >= x
                sums = np.add.reduceat(w, starts, axis=1, dtype=np.int64)
                counts = np.diff(starts, append=len(order))
                for i, start in enumerate(starts):
                    of = order[start]
                    mine = held.setdefault((s[of].as_py(), c[of].as_py()), [np.zeros(rounds, np.int64), 0])
                    mine[0] += sums[:, i]
                    mine[1] += int(counts[i])
                if len(held) >= _HELD:
                    yield from written()
        yield from written()

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    d = rows.repartitionByRange(tasks, "s", "k").mapInArrow(run, f"round int, s {rows.schema['s'].dataType.simpleString()}, c int, w long, m long")
    return stage(d.groupBy("round", "s", "c").agg(F.sum("w").alias("w"), F.sum("m").alias("m")), "resampled")


def held_out(rows: DataFrame, key: str, label: str, score: str, judged: str, loss: float = 0.08, rounds: int = 200, max_admitted: float | None = None) -> DataFrame:
    """``round, threshold, true_lost, unstated_admitted, contradicted_admitted`` for halves split by hashes.

    A row is in a round's first half where the hash of round and key is below one half. That half sets the
    threshold: it loses ``loss`` of the decided true claims or, with ``max_admitted``, admits that share of the
    others. The other half is measured. Rows are counted per round and score, and never ordered one by one.
    """
    sets = (F.col(label) == "S") & F.col(judged) if max_admitted is None else F.col(label) != "S"
    kind = F.lit(0)
    for i, x in enumerate("SNC", 1):
        kind = F.when(F.col(label) == x, i).otherwise(kind)
    d = resampled(rows.select(F.col(key).alias("k"), F.col(score).alias("s"), (kind + F.when(sets, 4).otherwise(0)).alias("c")), "", rounds, [0.5])
    second = lambda i: F.sum(F.when(F.col("c") % 4 == i, F.col("w")).otherwise(0))
    values = d.groupBy("round", "s").agg(F.sum(F.when(F.col("c") >= 4, F.col("m") - F.col("w")).otherwise(0)).alias("sets"), *[second(i).alias(f"n_{x}") for i, x in enumerate("SNC", 1)])
    total = values.groupBy("round").agg(F.sum("sets").alias("m"))
    v = running(values, ["round"], "s", ["sets"]).join(total.filter("m > 0"), "round")
    if max_admitted is None:
        want = F.least(F.col("m"), F.greatest(F.lit(1), F.floor(loss * (F.col("m") + 1))))
    else:
        want = F.col("m") - F.floor(max_admitted * (F.col("m") + 1))
    at = F.when((F.col("below_sets") < want) & (F.col("below_sets") + F.col("sets") >= want), F.col("s"))
    cut = v.groupBy("round").agg(F.max(at).alias("at"))
    cut = cut.select("round", (F.col("at") if max_admitted is None else F.coalesce(just_above(F.col("at")), F.lit(0.0))).alias("threshold"))
    test = values.join(cut, "round")
    share = lambda x, low: F.sum(F.when((F.col("s") < F.col("threshold")) if low else (F.col("s") >= F.col("threshold")), F.col(x)).otherwise(0)) / F.nullif(F.sum(x), F.lit(0))
    return test.groupBy("round", "threshold").agg(share("n_S", True).alias("true_lost"), share("n_N", False).alias("unstated_admitted"), share("n_C", False).alias("contradicted_admitted"))


def bootstrap_auroc(scores: DataFrame, key: str, positive: str, score: str, rounds: int = 1000) -> DataFrame:
    """``round, auroc`` of Poisson(1) resamples, whose weights come from hashes of round and key."""
    marks, total, p = [], 0.0, math.exp(-1)
    for k in range(1, 8):
        total += p
        p /= k
        marks.append(total)
    d = resampled(scores.select(F.col(key).alias("k"), F.col(score).alias("s"), F.when(F.col(positive), 1).otherwise(0).alias("c")), "boot:", rounds, marks).filter("w > 0")
    values = d.groupBy("round", "s").agg(F.sum(F.when(F.col("c") == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("c") == 0, F.col("w")).otherwise(0)).alias("n"))
    wins = running(values, ["round"], "s", ["n"]).withColumn("x", F.col("p") * (F.col("below_n") + F.col("n") / 2)).groupBy("round").agg(F.sum("x").alias("x"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return wins.select("round", (F.col("x") / (F.col("p") * F.col("n"))).alias("auroc"))


def bootstrap_interval(resampled: DataFrame) -> DataFrame:
    """One row ``rounds, lo, hi``: the middle 95 % of ``bootstrap_auroc``; NaN without a round. One value a round is gathered."""
    d = resampled.agg(F.sort_array(F.collect_list("auroc")).alias("a")).withColumn("r", F.size("a"))
    at = lambda share: F.coalesce(F.get("a", F.least(F.col("r") - 1, F.floor(F.lit(share) * F.col("r")).cast("int"))), F.lit(NAN))
    return d.select(F.col("r").cast("long").alias("rounds"), at(0.025).alias("lo"), at(0.975).alias("hi"))


def review_estimate(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each of ``by``) from ``groups(grp, memories, reviewed, not_stated)``: the stratified share not stated.

    Null while a group with memories has no review. The interval is normal, on Jeffreys-smoothed rates, and
    shrinks to nothing as a group is reviewed in full.
    """
    g = groups.filter("memories > 0")
    total = F.sum("memories")
    rate = F.col("not_stated") / F.col("reviewed")
    smooth = (F.col("not_stated") + 0.5) / (F.col("reviewed") + 1)
    rest = F.when(F.col("memories") > 1, (F.col("memories") - F.col("reviewed")) / (F.col("memories") - 1)).otherwise(0.0)
    spread = F.col("memories") ** 2 * smooth * (1 - smooth) / (F.col("reviewed") + 2) * rest
    gap = F.max(F.when(F.col("reviewed") == 0, 1).otherwise(0)) == 1
    out = g.groupBy(*(by or [])).agg(F.when(~gap, F.sum(F.col("memories") * F.when(F.col("reviewed") > 0, rate)) / total).alias("estimate"), F.when(~gap, F.sqrt(F.sum(spread)) / total).alias("se"), F.sort_array(F.collect_list(F.when(F.col("reviewed") == 0, F.col("grp")))).alias("missing_groups"))
    return out.withColumns({"lo": F.greatest(F.lit(0.0), F.col("estimate") - 1.96 * F.col("se")), "hi": F.least(F.lit(1.0), F.col("estimate") + 1.96 * F.col("se"))})
