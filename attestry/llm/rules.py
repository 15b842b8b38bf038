"""Quality classifier: a sparse ensemble of conjunctive rules, run as Spark column expressions.

Statistics of a text are native columns. On the driver, from a bounded sample of labelled rows, small
regression trees are boosted on the log loss; every path from a root is a rule (a conjunction of bounds on
statistics); a lasso logistic regression keeps few of the rules; and the kept ones are compiled to one
column, so that scoring never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_SYMBOLS = "*#$%&|@^~<>{}[]\\/_=+`"
#: Statistics stand in columns of this prefix, beside any columns of the input.
_OWN = "_attestry_"
FEATURES = ("n_chars", "n_words", "word_chars", "upper", "digits", "symbols", "bangs", "stops", "distinct", "n_lines", "distinct_lines", "line_chars")


def statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of ``text``; null counts as the empty text, whose statistics are 0."""
    t, w, n_lines = (f"{_OWN}{k}" for k in ("text", "words", "lines"))
    q = {k: f"{_OWN}{k}" for k in FEATURES}
    d = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    d = d.select(*keep, t, F.array_remove(F.split(t, WS + "+"), "").alias(w), F.split(t, "\n").alias(n_lines))
    d = d.withColumns({q["n_chars"]: F.length(t), q["n_words"]: F.size(w), q["n_lines"]: F.size(n_lines)})
    per = lambda a, n: a / F.greatest(F.col(q[n]), F.lit(1))
    share = lambda chars: per(F.col(q["n_chars"]) - F.length(F.translate(t, chars, "")), "n_chars")
    out = {
        "n_chars": F.col(q["n_chars"]), "n_words": F.col(q["n_words"]), "word_chars": per(F.col(q["n_chars"]), "n_words"), "upper": share(_UPPER), "digits": share("0123456789"),
        "symbols": share(_SYMBOLS), "bangs": share("!?"), "stops": share(".,;:"), "distinct": per(F.size(F.array_distinct(w)), "n_words"), "n_lines": F.col(q["n_lines"]),
        "distinct_lines": per(F.size(F.array_distinct(n_lines)), "n_lines"), "line_chars": per(F.col(q["n_chars"]), "n_lines"),
    }
    return d.select(*keep, *[out[k].cast("double").alias(q[k]) for k in FEATURES])


@dataclass(frozen=True)
class Rules:
    """``rules``: weight and bounds ``(feature, above, value)``, where above means ``> value``, else ``<= value``."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for weight, bounds in self.rules:
            fits = F.lit(True)
            for name, above, value in bounds:
                fits = fits & (F.col(_OWN + name) > value if above else F.col(_OWN + name) <= value)
            total = total + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """One tree: the paths to all its nodes but the root, and its output for each row."""
    paths, out, todo = [], np.zeros(len(g)), [(np.arange(len(g)), ())]
    while todo:
        rows, path = todo.pop()
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 2 * least:
            for f in range(bins.shape[1]):
                k = len(cuts[f]) + 1
                b = bins[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                ok = (nl >= least) & (len(rows) - nl >= least)
                gain = np.where(ok, gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            out[rows] = -G / (H + 1)
            continue
        f, cut = best[1]
        low = bins[rows, f] <= cut
        for part, above in ((low, False), (~low, True)):
            longer = (*path, (f, above, cut))
            paths.append(longer)
            todo.append((rows[part], longer))
    return paths, out


def _merge(path: tuple) -> tuple:
    """Bounds of a path with one bound for each statistic and side."""
    bounds: dict[tuple[int, bool], int] = {}
    for f, above, cut in path:
        old = bounds.get((f, above), cut)
        bounds[f, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((f, above, cut) for (f, above), cut in bounds.items()))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10, penalty: float = 2e-3, steps: int = 400) -> Rules:
    """Without rows the score is 1/2; with one label only, its smoothed share."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(p / (1 - p))), ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 49)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    p0 = y.mean()
    margin, found = np.full(len(y), np.log(p0 / (1 - p0))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, out = _grow(bins, cuts, p - y, p * (1 - p), depth, least)
        margin += rate * out
        found |= dict.fromkeys(map(_merge, paths))
    rules = list(found)
    z = np.ones((len(y), len(rules)), dtype=np.float32)
    for r, path in enumerate(rules):
        for f, above, cut in path:
            z[:, r] *= (bins[:, f] > cut) == above
    mean = z.mean(0)
    w, b, v, vb, t = np.zeros(len(rules)), np.log(p0 / (1 - p0)), np.zeros(len(rules)), np.log(p0 / (1 - p0)), 1.0
    z -= mean
    u = np.full(len(rules) + 1, 1.0)
    for _ in range(30):  # the largest curvature, by power iteration
        s = z @ u[:-1].astype(np.float32) + u[-1]
        u = np.append(z.T @ s, s.sum()).astype(float)
        u /= np.linalg.norm(u) or 1
    s = z @ u[:-1].astype(np.float32) + u[-1]
    step = 1 / (0.3 * float(s @ s) / len(y) + 1e-9)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + vb))) - y
        new = v - step * (z.T @ e.astype(np.float32)) / len(y)
        new, nb = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0), vb - step * e.mean()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, vb, w, b = new + (old - 1) / t * (new - w), nb + (old - 1) / t * (nb - b), new, nb
    name = lambda f, above, cut: (FEATURES[f], bool(above), float(cuts[f][cut]))
    kept = [(float(w[r]), tuple(name(*c) for c in path)) for r, path in enumerate(rules) if abs(w[r]) > 1e-6]
    return Rules(float(b - (w * mean).sum()), tuple(kept))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = 15_000) -> Rules:
    """Fit on about ``limit`` labelled rows at most, drawn by a hash of the key from those not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.min(label).cast("double").alias("_y"))
    n = known.count()
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("fit:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    some = known.filter(draw < min(1.0, limit / max(n, 1)))  # a bounded number of pairs, whatever the input
    rows = statistics(docs.select(key, text).join(F.broadcast(some), key), text, [key, "_y"]).orderBy(key, *[_OWN + k for k in FEATURES]).toPandas()
    return fit(rows[[_OWN + k for k in FEATURES]].to_numpy(float), rows["_y"].to_numpy(float))


def score(docs: DataFrame, model: Rules, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, null and empty texts included.

    Rows are independent: repeated rows get equal scores, null keys are not held out, and an empty table gives
    an empty result. A text is scanned as a whole, whatever its length. Columns that ``keep`` does not name are
    not read; those it names must not have the names of the result.
    """
    scored = statistics(docs, text, [key, *keep]).withColumn(_OWN + "score", model.column())
    return scored.select(F.col(key).alias("doc_id"), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), F.col(_OWN + "score").alias("score"), F.when(F.col(_OWN + "score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"), *keep)


def accept(docs: DataFrame, model: Rules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` predicts as 1.

    Scores are staged beside the rows, and only then filtered: a filter that reaches below the statistics
    would have every bound of every rule work its statistic out again.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(columns, F.col(key).alias("key"), F.col(text).alias("text"))
    scored = stage(score(packed, model, "key", "text", ("row",)).select("predicted", "row"), "scored")
    return scored.filter("predicted = 1").select("row.*")
