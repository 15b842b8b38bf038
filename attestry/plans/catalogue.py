"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.quantities import missing, quantities
from ..functions.sentences import sentences, windows
from ..judges import Cover, Lexical
from ..operators import audit, chain, evaluation, facts, metrics, search
from ..operators.verify import status_for, verify
from ..policy import Policy
from ..storage import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL building blocks


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + "]"


_WS_CLASS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_ws = lambda x: f"trim(regexp_replace({x}, '{_WS_CLASS}', ' ', 'g'))"
_words = lambda x: f"list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w))"
_content = lambda x: f"list_distinct(list_filter({_words(x)}, lambda v: NOT list_contains({_list(T.STOPWORDS)}, v) AND (len(v) > 1 OR regexp_full_match(v, '\\p{{Nd}}'))))"
_count = lambda x, known: f"len(list_filter({_words(x)}, lambda v: list_contains({_list(known - T.SHARED)}, v)))"
_overlap = lambda a, b: f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0.0 END"
_hash = lambda *p: f"('0x' || substr(md5({' || chr(58) || '.join(f'({x})::VARCHAR' for x in p)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_wilson = lambda k, n: (
    f"CASE WHEN {n} = 0 THEN 'nan'::DOUBLE ELSE greatest(0.0, ({k}/{n} + 3.8416/(2*{n}))/(1+3.8416/{n}) - 1.96*sqrt({k}/{n}*(1-{k}/{n})/{n} + 3.8416/(4*{n}*{n}))/(1+3.8416/{n})) END",
    f"CASE WHEN {n} = 0 THEN 'nan'::DOUBLE ELSE least(1.0, ({k}/{n} + 3.8416/(2*{n}))/(1+3.8416/{n}) + 1.96*sqrt({k}/{n}*(1-{k}/{n})/{n} + 3.8416/(4*{n}*{n}))/(1+3.8416/{n})) END",
)


def _r(c: Column | str) -> Column:
    return F.round(c, 9)


# text functions


@query(f"SELECT doc_id, md5({_ws('text')}) AS normal, len({_ws('text')})::INT AS n FROM documents")
def normalize_ws(spark, d):
    x = T.normalize_ws(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.md5(x).alias("normal"), F.length(x).alias("n"))


@query(f"SELECT doc_id, len({_words('text')})::INT AS n, md5(array_to_string({_words('text')}, ' ')) AS words FROM documents")
def words(spark, d):
    x = T.words(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(x).alias("n"), F.md5(F.array_join(x, " ")).alias("words"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({_content('text')}), ' ') AS tokens FROM conversations")
def content_tokens(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"WITH t AS (SELECT doc_id, '  ' || lower({_ws('text')}) || '  ' AS t FROM documents) SELECT doc_id, len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: substring(t, i, 3))))::INT AS n, md5(array_to_string(list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: substring(t, i, 3)))), '|')) AS grams FROM t")
def char_trigrams(spark, d):
    g = T.char_trigrams(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(g).alias("n"), F.md5(F.array_join(F.array_sort(g), "|")).alias("grams"))


@query(f"WITH c AS (SELECT doc_id, {_count('text', T.ITALIAN)} AS it, {_count('text', T.ENGLISH)} AS en FROM documents) SELECT doc_id, CASE WHEN it = en THEN 'und' WHEN it > en THEN 'it' ELSE 'en' END AS language FROM c")
def guess_language(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.guess_language(F.col("text")).alias("language"))


@query("SELECT conv_id, turn, regexp_matches(text, '\\?[?!…]*[)\\]''\"’”»]*\\s*$') AS asks FROM conversations")
def is_question(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.is_question(F.col("text")).alias("asks"))


@query(f"SELECT item_id, array_to_string({_words('text')}, ' ') AS norm FROM benchmark")
def normalize_fact(spark, d):
    return _t(spark, d, "benchmark").select("item_id", T.normalize_fact(F.col("text")).alias("norm"))


_TERMS = f"""q AS (SELECT item_id AS q_id, {_content('text')} AS c, list_distinct({_words('text')}) AS w FROM benchmark),
k AS (SELECT q_id, unnest(CASE WHEN len(c) > 0 THEN c ELSE w END) AS term FROM q),
terms AS MATERIALIZED (SELECT q_id, term, false AS prefix FROM k UNION ALL SELECT q_id, left(term, len(term) - 2), true FROM k WHERE len(term) >= 6 AND regexp_full_match(term, '\\p{{L}}+'))"""


@query(f"WITH {_TERMS} SELECT * FROM terms")
def search_terms(spark, d):
    return search.query_terms(_t(spark, d, "benchmark"), "item_id", "text")


# verification


def labelled(spark, d) -> DataFrame:
    """Documents with their own first line as a supported claim, and with the next document's as one that isn't."""
    docs = _t(spark, d, "documents").withColumn("claim", T.normalize_ws(F.split(F.coalesce("text", F.lit("")), "\n")[0]))
    own = docs.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.col("text").alias("source"), "claim", F.lit("S").alias("label"), "lang")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), "claim")
    other = docs.select("doc_id", F.col("text").alias("source"), "lang").join(after, "doc_id").select(F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "source", "claim", F.lit("N").alias("label"), "lang")
    return own.unionByName(other).filter("claim <> ''")


_FIRST = _ws("string_split(coalesce(text, ''), chr(10))[1]")
_PAIRS = f"""f AS (SELECT doc_id, text, lang, {_FIRST} AS claim FROM documents),
p AS (SELECT 'S' || doc_id AS id, doc_id, text AS source, claim, 'S' AS label, lang FROM f WHERE claim <> ''
  UNION ALL SELECT 'N' || f.doc_id, f.doc_id, f.text, g.claim, 'N', f.lang FROM f JOIN f g ON g.doc_id = f.doc_id + 1 WHERE g.claim <> ''),
t AS (SELECT *, {_content('claim')} AS a, {_content('source')} AS b FROM p),
s AS MATERIALIZED (SELECT id, doc_id, label, lang, {_overlap('a', 'b')} AS support FROM t),
v AS MATERIALIZED (SELECT *, CASE WHEN support >= 0.5 THEN 'supported' WHEN support >= 0.2 THEN 'uncertain' ELSE 'not_supported' END AS verdict FROM s)"""


def scored(spark, d) -> DataFrame:
    """Support of the pairs of ``labelled``: every text is tokenised once, and only the tokens of claims are joined."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", T.content_tokens(F.coalesce("text", F.lit(""))).alias("words"), T.normalize_ws(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("claim"))
    claims = _t(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), T.normalize_ws(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("next"))
    both = docs.join(claims, "doc_id", "left")
    pair = lambda label, claim: F.struct(F.lit(label).alias("label"), T.content_tokens(F.col(claim)).alias("wanted"), (F.col(claim) != "").alias("some"))
    rows = both.select("doc_id", "lang", "words", F.explode(F.array(pair("S", "claim"), pair("N", "next"))).alias("p")).filter("p.some")
    return rows.select(F.concat(F.col("p.label"), F.col("doc_id").cast("string")).alias("id"), "doc_id", F.col("p.label").alias("label"), "lang", T.overlap(F.col("p.wanted"), F.col("words")).alias("support"))


def _verdict() -> Column:
    th = Policy().thresholds
    return F.when(F.col("support") >= th.support, "supported").when(F.col("support") >= th.uncertain, "uncertain").otherwise("not_supported")


@query(f"WITH {_PAIRS} SELECT id, label, round(support, 9) AS support, verdict FROM v")
def lexical_verdict(spark, d):
    return scored(spark, d).select("id", "label", _r("support").alias("support"), _verdict().alias("verdict"))


_LO, _HI = _wilson("flagged", "judged")


@query(f"WITH {_PAIRS}, c AS (SELECT lang, count(*) AS judged, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain, count(*) FILTER (WHERE verdict = 'not_supported') AS flagged FROM v GROUP BY lang) SELECT *, round(flagged / judged, 9) AS unsupported_share, round({_LO}, 9) AS lo, round({_HI}, 9) AS hi FROM c")
def lexical_audit(spark, d):
    """The flagship: verdict counts, unsupported share and its interval by language."""
    n = lambda k: F.count(F.when(F.col("verdict") == k, 1))
    c = scored(spark, d).withColumn("verdict", _verdict()).groupBy("lang").agg(F.count(F.lit(1)).alias("judged"), n("supported").alias("supported"), n("uncertain").alias("uncertain"), n("not_supported").alias("flagged"))
    ci = metrics.wilson(F.col("flagged"), F.col("judged"))
    return c.select("*", _r(F.col("flagged") / F.col("judged")).alias("unsupported_share"), _r(ci["lo"]).alias("lo"), _r(ci["hi"]).alias("hi"))


@query()
def split_sentences(spark, d):
    s = _t(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.posexplode("s").alias("pos", "x")).select("doc_id", "n_sentences", "pos", "x.start", "x.end", "x.text")


def _turns(spark, d) -> DataFrame:
    """Each turn as a claim, against the turn before it."""
    c = _t(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"), F.col("role").alias("by"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", "role", "by", "source", F.col("text").alias("claim")).filter(T.normalize_ws(F.col("claim")) != "")


@query()
def evidence_windows(spark, d):
    w = _turns(spark, d).select("conv_id", "turn", windows(F.col("source"), F.col("claim")).alias("w"))
    return w.select("conv_id", "turn", F.posexplode("w").alias("ord", "x")).select("conv_id", "turn", "ord", "x.start", "x.end", "x.text")


@query()
def verify_turns(spark, d):
    v = verify(_turns(spark, d), judge=Cover()).select("conv_id", "turn", "verdict.*")
    return v.select("conv_id", "turn", "label", "support", "evidence.start", "evidence.end", "language", "reason", F.size("missing").alias("n_missing"))


@query()
def audit_turns(spark, d):
    rows = _turns(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "source", F.col("claim").alias("memory"), F.lit("").alias("lang"))
    return audit.summary(audit.audit_pairs(rows, judge=Lexical()))


@query()
def quantities_in_documents(spark, d):
    q = _t(spark, d, "documents").select("doc_id", F.explode(quantities(F.col("text"))).alias("q"))
    return q.select("doc_id", "q.surface", "q.start", "q.end", "q.values", "q.kind")


@query()
def missing_quantities(spark, d):
    """Of each document, what the next one's first line states and it does not: quantities are read before documents meet."""
    docs = _t(spark, d, "documents").select("doc_id", "text", T.normalize_ws(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("claim"))
    claims = docs.filter("claim <> ''").select((F.col("doc_id") - 1).alias("doc_id"), quantities(F.col("claim"), T.guess_language(F.col("claim")) == "it").alias("c"))
    both = docs.select("doc_id", quantities(F.col("text")).alias("s")).join(claims.filter(F.size("c") > 0), "doc_id")
    return both.select("doc_id", missing(F.col("c"), F.col("s")).alias("missing")).filter(F.size("missing") > 0)


@query("""WITH a AS (SELECT DISTINCT role FROM conversations), l AS (SELECT unnest(['contradicted', 'not_supported', 'supported', 'uncertain', 'unjudged']) AS label), m AS (SELECT unnest([true, false]) AS is_model)
SELECT role, label, is_model, CASE WHEN label = 'supported' AND is_model AND role IN ('user', 'document', 'system') THEN 'verified' WHEN label IN ('not_supported', 'contradicted') THEN 'quarantined' ELSE 'unverified' END AS status FROM a, l, m""")
def status_table(spark, d):
    roles = _t(spark, d, "conversations").select("role").distinct()
    rows = roles.select("role", F.explode(F.array(*map(F.lit, ("contradicted", "not_supported", "supported", "uncertain", "unjudged")))).alias("label"))
    trusted = F.col("role").isin(*Policy().trusted_authors)
    both = [rows.select("role", "label", F.lit(m).alias("is_model"), status_for(F.col("label"), trusted, m).alias("status")) for m in (True, False)]
    return both[0].unionByName(both[1])


# metrics

_AUROC = lambda by: f"""WITH {_PAIRS}, r AS (SELECT *, label = 'S' AS pos, rank() OVER (PARTITION BY {by} ORDER BY support) + (count(*) OVER (PARTITION BY {by}, support) - 1) / 2.0 AS rk FROM s),
g AS (SELECT {by} AS grp, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(rk) FILTER (WHERE pos) AS w FROM r GROUP BY 1)"""  # noqa: E731


@query(_AUROC("1") + " SELECT n_pos, n_neg, round((w - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg), 9) AS auroc FROM g")
def auroc(spark, d):
    return metrics.auroc(scored(spark, d).withColumn("pos", F.col("label") == "S"), "pos", "support").withColumn("auroc", _r("auroc"))


@query(_AUROC("lang") + " SELECT grp AS lang, n_pos, n_neg, round((w - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg), 9) AS auroc FROM g")
def auroc_by_language(spark, d):
    return metrics.auroc(scored(spark, d).withColumn("pos", F.col("label") == "S"), "pos", "support", ["lang"]).withColumn("auroc", _r("auroc"))


@query(f"WITH {_PAIRS}, o AS (SELECT support, row_number() OVER (ORDER BY support) AS r, count(*) OVER () AS n FROM s WHERE label = 'N') SELECT round(support, 9) AS threshold FROM o WHERE r = least(n, greatest(1, floor(0.08 * (n + 1))))")
def loss_threshold(spark, d):
    cut = metrics.threshold_for_loss(scored(spark, d).filter("label = 'N'"), "support", 0.08)
    return spark.range(1).select(_r(F.lit(cut)).alias("threshold"))


@query(f"WITH {_PAIRS}, o AS (SELECT support, row_number() OVER (ORDER BY support DESC) AS r, count(*) OVER () AS n FROM s WHERE label = 'N'), k AS (SELECT support AS top, round(support, 4) AS t FROM o WHERE r = floor(0.05 * (n + 1)) + 1) SELECT round(CASE WHEN t > top THEN t ELSE t + 0.0001 END, 4) AS threshold FROM k")
def admission_threshold(spark, d):
    cut = metrics.threshold_for_admission(scored(spark, d).filter("label = 'N'"), "support", 0.05)
    return spark.range(1).select(F.lit(cut).alias("threshold"))


_HALVES = f"""x AS (SELECT id AS k, label AS l, support AS s, unnest(range(1, 201)) AS round FROM s),
o AS MATERIALIZED (SELECT *, {_hash('round', 'k')} < 0.5 AS first FROM x)"""
_HELD = """SELECT o.round::INT AS round, round(threshold, 9) AS threshold, round(avg(CASE WHEN l = 'S' THEN (s < threshold)::INT END), 9) AS true_lost, round(avg(CASE WHEN l = 'N' THEN (s >= threshold)::INT END), 9) AS unstated_admitted
FROM o JOIN th ON th.round = o.round WHERE NOT first GROUP BY o.round, threshold"""


@query(f"""WITH {_PAIRS}, {_HALVES},
c AS (SELECT round, s, row_number() OVER (PARTITION BY round ORDER BY s) AS nth, count(*) OVER (PARTITION BY round) AS m FROM o WHERE first AND l = 'S'),
th AS (SELECT round, s AS threshold FROM c WHERE nth = least(m, greatest(1, floor(0.08 * (m + 1))))) {_HELD}""")
def held_out_rates(spark, d):
    rows = scored(spark, d).withColumn("judged", F.lit(True))
    out = metrics.held_out(rows, "id", "label", "support", "judged")
    return out.select("round", _r("threshold").alias("threshold"), _r("true_lost").alias("true_lost"), _r("unstated_admitted").alias("unstated_admitted"))


_ABOVE = lambda v: f"(CASE WHEN floor({v} * 10000) / 10000 > {v} THEN floor({v} * 10000) WHEN (floor({v} * 10000) + 1) / 10000 > {v} THEN floor({v} * 10000) + 1 ELSE floor({v} * 10000) + 2 END / 10000)"


@query(f"""WITH {_PAIRS}, {_HALVES},
c AS (SELECT round, s, row_number() OVER (PARTITION BY round ORDER BY s) AS nth, count(*) OVER (PARTITION BY round) AS m FROM o WHERE first AND l <> 'S'),
th AS (SELECT round, {_ABOVE('s')} AS threshold FROM c WHERE nth = m - floor(0.05 * (m + 1))) {_HELD}""")
def held_out_admission(spark, d):
    rows = scored(spark, d).withColumn("judged", F.lit(True))
    out = metrics.held_out(rows, "id", "label", "support", "judged", max_admitted=0.05)
    return out.select("round", _r("threshold").alias("threshold"), _r("true_lost").alias("true_lost"), _r("unstated_admitted").alias("unstated_admitted"))


def _poisson_sql() -> str:
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(1, 8):
        total += p
        p /= k
        out.append(f"(u >= {total!r}::DOUBLE)::INT")
    return " + ".join(out)


_RESAMPLED = f"""WITH {_PAIRS}, x AS (SELECT id, label = 'S' AS pos, support, unnest(range(1, 1001)) AS round FROM s), u AS (SELECT *, {_hash("'boot'", 'round', 'id')} AS u FROM x),
w AS (SELECT *, {_poisson_sql()} AS w FROM u), g AS (SELECT round, support, sum(CASE WHEN pos THEN w ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS n FROM w WHERE w > 0 GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY round ORDER BY support ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"""


@query(_RESAMPLED + """
SELECT round::INT AS round, round(sum(p * (below + n / 2.0)) / (sum(p)::DOUBLE * sum(n)), 9) AS auroc FROM b GROUP BY round""")
def bootstrap_auroc(spark, d):
    rows = scored(spark, d).withColumn("pos", F.col("label") == "S")
    return metrics.bootstrap_auroc(rows, "id", "pos", "support").withColumn("auroc", _r("auroc"))


@query(_RESAMPLED + """, a AS (SELECT sum(p * (below + n / 2.0)) / (sum(p)::DOUBLE * sum(n)) AS auroc FROM b GROUP BY round), l AS (SELECT list_sort(list(auroc)) AS a, count(*) AS r FROM a)
SELECT r AS rounds, round(a[floor(0.025 * r)::INT + 1], 9) AS lo, round(a[least(r - 1, floor(0.975 * r))::INT + 1], 9) AS hi FROM l""")
def bootstrap_interval(spark, d):
    rows = scored(spark, d).withColumn("pos", F.col("label") == "S")
    return metrics.bootstrap_interval(metrics.bootstrap_auroc(rows, "id", "pos", "support")).select("rounds", _r("lo").alias("lo"), _r("hi").alias("hi"))


def _evaluated(spark, d) -> DataFrame:
    return scored(spark, d).select("id", "label", "lang", _verdict().alias("verdict"), "support", F.lit(True).alias("judged"))


@query(f"""WITH {_PAIRS}, l AS (SELECT unnest(['S', 'N', 'C']) AS label)
SELECT l.label, count(v.id) AS pairs, round(coalesce(avg((verdict = 'supported')::INT) FILTER (WHERE v.id IS NOT NULL), 'nan'::DOUBLE), 9) AS supported_rate FROM l LEFT JOIN v ON v.label = l.label GROUP BY l.label""")
def supported_rates(spark, d):
    return evaluation.rates(_evaluated(spark, d)).select("label", "pairs", _r("supported_rate").alias("supported_rate"))


@query(f"WITH {_PAIRS} SELECT id, label, verdict, round(support, 9) AS support FROM v WHERE (label = 'S') <> (verdict = 'supported')")
def evaluation_errors(spark, d):
    return evaluation.errors(_evaluated(spark, d)).select("id", "label", "verdict", _r("support").alias("support"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, label = 'S' AS pos, rank() OVER (PARTITION BY lang ORDER BY support) + (count(*) OVER (PARTITION BY lang, support) - 1) / 2.0 AS rk FROM s WHERE lang <> ''),
g AS (SELECT lang, count(*) AS pairs, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(rk) FILTER (WHERE pos) AS w FROM r GROUP BY 1)
SELECT lang, pairs, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (w - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg) ELSE 'nan'::DOUBLE END, 9) AS auroc FROM g""")
def evaluation_by_language(spark, d):
    return evaluation.by_language(_evaluated(spark, d)).select("lang", "pairs", _r("auroc").alias("auroc"))


@query(f"WITH {_PAIRS}, l AS (SELECT unnest(['supported', 'not_supported', 'contradicted', 'uncertain', 'unjudged']) AS verdict) SELECT l.verdict, count(v.id) AS n FROM l LEFT JOIN v ON v.verdict = l.verdict GROUP BY l.verdict")
def verdict_counts(spark, d):
    return evaluation.verdict_counts(_evaluated(spark, d))


@query(f"""WITH {_PAIRS}, o AS (SELECT support, row_number() OVER (ORDER BY support) AS r, count(*) OVER () AS n FROM s WHERE label = 'S'),
a AS (SELECT support AS v FROM o WHERE r = least(n, greatest(1, floor(0.08 * (n + 1))))), b AS (SELECT support AS v FROM o WHERE r = least(n, greatest(1, floor(0.02 * (n + 1))))),
u AS (SELECT support, row_number() OVER (ORDER BY support) AS r, count(*) OVER () AS n FROM s WHERE label = 'N'), c AS (SELECT {_ABOVE('support')} AS v FROM u WHERE r = n - floor(0.05 * (n + 1)))
SELECT 'loss' AS objective, round(a.v, 4) AS support, round(least(a.v, b.v), 4) AS uncertain FROM a, b UNION ALL SELECT 'admission', round(c.v, 4), round(least(c.v, 0.2), 4) FROM c""")
def calibrated_thresholds(spark, d):
    rows, policy = stage(_evaluated(spark, d), "evaluated"), Policy()
    found = [(name, *evaluation.calibrate(rows, policy, max_admitted=cap, rounds=5)[:1]) for name, cap in (("loss", None), ("admission", 0.05))]
    return spark.createDataFrame([(name, t.support, t.uncertain) for name, t in found], "objective string, support double, uncertain double")


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY label DESC) - 1 AS ord FROM s) SELECT doc_id AS id, (ord + 1)::INT AS k, round(max(support) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS support FROM r WHERE ord < 12")
def window_budget(spark, d):
    from pyspark.sql import Window

    ranked = scored(spark, d).withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("label"))) - 1)
    return evaluation.window_budget(ranked.select(F.col("doc_id").alias("id"), "ord", F.col("support").alias("entailment"))).select("id", "k", _r("support").alias("support"))


@query(f"WITH {_PAIRS}, z AS (SELECT support, round(support, 1) AS again FROM s) SELECT count(*) AS pairs, round(max(abs(support - again)), 9) AS max_gap, round(avg(abs(support - again)), 9) AS mean_gap, count(*) FILTER (WHERE (support >= 0.5) <> (again >= 0.5)) AS crossed FROM z")
def precision(spark, d):
    one = scored(spark, d).select("id", "support")
    return evaluation.precision(one, one.withColumn("support", F.round("support", 1)), 0.5).withColumns({"max_gap": _r("max_gap"), "mean_gap": _r("mean_gap")})


@query("""WITH r AS (SELECT CASE WHEN quality = 1 THEN 'verified' ELSE 'flagged' END AS grp, toxic, doc_id % 3 <> 2 AS seen FROM labels),
g AS (SELECT grp, count(*) AS memories, count(*) FILTER (WHERE seen) AS reviewed, count(*) FILTER (WHERE seen AND toxic = 1) AS not_stated FROM r GROUP BY grp)
SELECT round(sum(memories * (not_stated / reviewed)) / sum(memories), 9) AS estimate FROM g""")
def review_share(spark, d):
    seen = F.col("doc_id") % 3 != 2
    g = _t(spark, d, "labels").groupBy(F.when(F.col("quality") == 1, "verified").otherwise("flagged").alias("grp"))
    g = g.agg(F.count(F.lit(1)).alias("memories"), F.count(F.when(seen, 1)).alias("reviewed"), F.count(F.when(seen & (F.col("toxic") == 1), 1)).alias("not_stated"))
    return metrics.review_estimate(g).select(_r("estimate").alias("estimate"))


_STEPS = "[0.1, 0.2, 0.3, 0.4, 0.5]"


@query(f"WITH {_PAIRS}, x AS (SELECT *, unnest({_STEPS})::DOUBLE AS threshold FROM s) SELECT threshold, count(*) FILTER (WHERE label = 'S' AND support >= threshold) AS right_, count(*) FILTER (WHERE label = 'N' AND support >= threshold) AS false_ FROM x GROUP BY threshold")
def threshold_sweep(spark, d):
    x = scored(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, [k / 10 for k in range(1, 6)]))))
    n = lambda k: F.count(F.when((F.col("label") == k) & (F.col("support") >= F.col("threshold")), 1))
    return x.groupBy("threshold").agg(n("S").alias("right_"), n("N").alias("false_"))


# event log


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("fact_id"), F.coalesce("props", F.lit("{}")).alias("payload"))


_MATERIAL = "seq || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '|' || event_type || '|' || coalesce(user_id::VARCHAR, '') || '|' || coalesce(props, '{}')"


@query(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS seq FROM events), m AS (SELECT seq, {_MATERIAL} AS m FROM e)
SELECT count(*) AS seq, list_reduce(list_prepend(repeat('0', 64), list(m ORDER BY seq)), lambda h, x: sha256(h || '|' || x)) AS hash FROM m""")
def chain_head(spark, d):
    return chain.head(chain.build(_events(spark, d), ["event_id"]))


@query("SELECT true AS ok, count(*) AS events, NULL::BIGINT AS first_bad, '' AS reason FROM events")
def chain_verify(spark, d):
    return chain.verify(chain.build(_events(spark, d), ["event_id"]))


@query("SELECT false AS ok, 500::BIGINT AS events, 500::BIGINT AS first_bad, 'event content was altered' AS reason")
def chain_verify_tampered(spark, d):
    log = chain.build(_events(spark, d), ["event_id"])
    return chain.verify(log.withColumn("payload", F.when(F.col("seq") == 500, "{}{}").otherwise(F.col("payload"))))


# facts


def _orders(spark, d) -> DataFrame:
    return facts.supersede(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderkey")


_SUPERSEDED = """h AS (SELECT o_orderkey, o_custkey, o_orderdate, max({'v': o_orderdate, 'a': o_orderkey}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM orders),
r AS (SELECT *, h IS NULL OR o_orderdate >= h.v AS holds FROM h),
sp AS (SELECT *, CASE WHEN holds THEN min(CASE WHEN holds THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ELSE h.a END AS superseded_by FROM r)"""


@query(f"WITH {_SUPERSEDED} SELECT o_orderkey, o_custkey, superseded_by, CASE WHEN superseded_by IS NULL THEN 'verified' ELSE 'superseded' END AS status FROM sp")
def supersede(spark, d):
    return _orders(spark, d).select("o_orderkey", "o_custkey", "superseded_by", "status")


@query(f"WITH {_SUPERSEDED} SELECT CASE WHEN superseded_by IS NULL THEN 'verified' ELSE 'superseded' END AS status, count(*) AS n FROM sp GROUP BY 1")
def count_by_status(spark, d):
    return _orders(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS pos FROM orders")
def history(spark, d):
    from pyspark.sql import Window

    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos"))


@query(f"SELECT array_to_string({_words('text')}, ' ') AS norm, lang AS subject, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_facts(spark, d):
    return facts.duplicates(_t(spark, d, "documents"), "text", "lang", "doc_id")


@query("SELECT o_orderkey AS rowid, CASE o_orderstatus WHEN 'F' THEN 'quarantined' WHEN 'O' THEN 'verified' ELSE 'unverified' END AS status FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderkey DESC LIMIT 20")
def review_queue(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "quarantined").when(F.col("o_orderstatus") == "O", "verified").otherwise("unverified")
    return facts.review_queue(_t(spark, d, "orders").select(F.col("o_orderkey").alias("rowid"), status.alias("status")))


def _facts_and_sources(spark, d) -> tuple[DataFrame, DataFrame]:
    f = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("text"), F.lit("verified").alias("status"))
    s = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("origin"), F.lit("user").alias("author"))
    return f, s


@query("SELECT o_orderkey AS id, c_mktsegment AS source_origin, CASE WHEN c_custkey IS NOT NULL THEN 'user' END AS source_author FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def facts_with_sources(spark, d):
    return facts.with_sources(*_facts_and_sources(spark, d)).select("id", "source_origin", "source_author")


@query("""WITH g AS (SELECT o_orderkey AS id, o_custkey AS source_id, o_orderpriority AS text, o_orderstatus = 'F' AS gone FROM orders),
o AS (SELECT source_id FROM g GROUP BY source_id HAVING bool_and(gone))
SELECT 'fact' AS kind, id, CASE WHEN gone THEN '' ELSE text END AS text, CASE WHEN gone THEN 'forgotten' ELSE 'verified' END AS status FROM g
UNION ALL SELECT 'source', c_custkey, c_mktsegment, NULL FROM customer WHERE c_custkey NOT IN (SELECT source_id FROM o)""")
def forget(spark, d):
    f, s = _facts_and_sources(spark, d)
    gone = _t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    left, sources = facts.forget(f, s, gone)
    facts_left = left.select(F.lit("fact").alias("kind"), "id", "text", "status")
    return facts_left.unionByName(sources.select(F.lit("source").alias("kind"), "id", F.col("origin").alias("text"), F.lit(None).cast("string").alias("status")))


@query()
def apply_writes(spark, d):
    o = _t(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("arrival"), F.col("o_custkey").cast("string").alias("subject"), F.lower("o_orderpriority").alias("norm"), F.lit("verified").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"))
    return facts.apply_writes(rows).select("arrival", "subject", "status", "duplicate_of", "superseded_by")


# search


@query(f"""WITH {_TERMS}, dw AS MATERIALIZED (SELECT doc_id AS rowid, {_words('text')} AS w FROM documents), n AS MATERIALIZED (SELECT rowid, len(w) AS dl FROM dw),
i AS (SELECT rowid, len(w) AS dl, unnest(w) AS term FROM dw), z AS MATERIALIZED (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM n), tf AS MATERIALIZED (SELECT rowid, dl, term, count(*) AS tf FROM i GROUP BY ALL),
ph AS (SELECT DISTINCT term AS phrase, prefix FROM terms), voc AS MATERIALIZED (SELECT DISTINCT term FROM tf),
m AS (SELECT phrase, prefix, term FROM ph JOIN voc ON term = phrase WHERE NOT prefix UNION ALL SELECT phrase, prefix, term FROM (SELECT *, len(phrase) AS l FROM ph WHERE prefix) x JOIN (SELECT term, l, left(term, l) AS start FROM voc, (SELECT DISTINCT len(phrase) AS l FROM ph WHERE prefix) WHERE len(term) >= l) y ON x.phrase = y.start AND x.l = y.l),
h AS MATERIALIZED (SELECT phrase, prefix, rowid, dl, sum(tf) AS tf FROM tf JOIN m USING (term) GROUP BY ALL),
d AS (SELECT phrase, prefix, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf, n_docs, avg_dl FROM h, z GROUP BY phrase, prefix, n_docs, avg_dl),
s AS (SELECT q_id, rowid, sum((CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / avg_dl))) AS score FROM terms t JOIN h ON h.phrase = t.term AND h.prefix = t.prefix JOIN d ON d.phrase = t.term AND d.prefix = t.prefix GROUP BY q_id, rowid),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, rowid) AS rank FROM s)
SELECT q_id, rowid, round(score, 6) AS score, rank::INT AS rank FROM o WHERE rank <= 5""")
def bm25_topk(spark, d):
    index = search.postings(_t(spark, d, "documents"), "doc_id", "text")
    return search.search(index, search.query_terms(_t(spark, d, "benchmark"), "item_id", "text"), 5).withColumn("score", F.round("score", 6))


@query()
def recall_stemmed(spark, d):
    f = _t(spark, d, "documents").select(F.col("doc_id").alias("rowid"), "text", F.when(F.col("lang") == "en", "verified").otherwise("unverified").alias("status"))
    return search.recall(f, _t(spark, d, "benchmark"), query_key="item_id", query="text").select("q_id", "rowid", "rank", F.round("score", 6).alias("score"))


@query()
def ask_documents(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("rowid"), "text")
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q"), F.lit("en").alias("language"))
    hits = search.search(search.postings(docs, "rowid", "text"), search.query_terms(q, "q_id", "q"), search.candidates(5)).join(docs, "rowid")
    judge = Lexical()
    judge.is_model = True  # stands in for a relevance model
    out = search.ask(hits, q, judge, Policy(), 5)
    return out.select("q_id", "abstained", "reason", "considered", F.size("answers").alias("n_answers"), F.size("related").alias("n_related"))
