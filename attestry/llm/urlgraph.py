"""URL filters: host and path rules, and link-graph propagation for the urls that no rule fits.

Rules decide first. Hosts that rules allow are trusted seeds and hosts that rules block are distrusted
seeds. Personalised PageRank carries trust along the links between hosts and distrust against them; a host
is blocked where distrust has more than ``threshold`` of the sum of both. Only DataFrame operations: links
are parsed with SQL regular expressions, summed to host edges before any join, and every round is one join
and one grouped sum over hosts, never over pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stage

#: (verdict, host, path); a rule fits its host and all subdomains, if the url's path starts with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_HREF = "(?is)<a\\s[^>]*?href\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, n``: links from pages of one host to another host. Relative links stay on their host."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_HREF), 1), ascii_lower))
    links = pages.filter(F.col(html).contains("//")).select(host_of(F.col(url)).alias("src"), F.explode(hosts).alias("dst"))
    return links.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-9, cut: int = 5) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, trust, distrust)``.

    Trust of a host goes to the hosts it links to, distrust to the hosts that link to it, in proportion to
    the number of linking pages. Mass at a host without such a link is lost, which scales a solution as a
    whole as sending it back to the seeds would. The rounds end when no value moved by ``tolerance``; every
    ``cut`` rounds the state is written to shared storage.
    """
    out_n, in_n = edges.groupBy("src").agg(F.sum("n").alias("o")), edges.groupBy("dst").agg(F.sum("n").alias("i"))
    e = edges.join(out_n, "src").join(in_n, "dst").select("src", "dst", (F.col("n") / F.col("o")).alias("fwd"), (F.col("n") / F.col("i")).alias("bwd"))
    e = stage(e, "host-edges")
    moves = e.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("fwd").alias("t"), F.lit(0.0).alias("d"))
    moves = moves.unionByName(e.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), F.col("bwd").alias("d")))
    base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    now = base = stage(base, "host-seeds")
    done = 0
    while done < rounds:
        before = now
        for _ in range(min(cut, rounds - done)):
            moved = now.join(moves, F.col("host") == F.col("from")).select(F.col("to").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust"))
            now = base.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
            done += 1
        now = stage(now, "host-ranks")
        was = before.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        gap = now.join(was, "host", "left").select(F.greatest(F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0)))).alias("g"))
        moved_by = gap.agg(F.max("g")).head()[0]
        if before is not base:
            discard(before)
        if moved_by is None or moved_by < tolerance:
            break
    return now


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, damping: float = 0.85) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A url that is null or lacks ``://`` has an empty host and path. A host that no seed reaches, and the
    empty host, are allowed. Null pages have no links. Repeated rows are judged each; an empty table gives
    an empty result.
    """
    u = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = u.withColumns({"rule": rule, "ruled": verdict})
    hosts = judged.filter(F.col("host") != "").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("a"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"))
    hosts = stage(hosts, "hosts")
    total = hosts.agg(F.sum(F.col("a") + F.col("b"))).head()[0] or 1
    seeds = hosts.filter("a + b > 0").select("host", (F.col("a") / total).alias("trust"), (F.col("b") / total).alias("distrust"))
    ranks = propagate(host_edges(pages, url, html), seeds, damping)
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return judged.join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"))


def op2_sql(rules: tuple[tuple[str, str, str], ...] = RULES, rounds: int = 10) -> str:
    """The same for DuckDB on ``pages``, with ``rounds`` rounds written out; verdicts settle long before."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{(r[1] + r[2], r[0])[i]}'" for r in by_length) + " END"
    steps, last = [], "base"
    for k in range(rounds):
        steps.append(f"r{k} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM base UNION ALL SELECT m.t, l.trust * m.f * 0.85, l.distrust * m.b * 0.85 FROM {last} l JOIN moves m ON l.host = m.s) GROUP BY host)")
        last = f"r{k}"
    return f"""
WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS MATERIALIZED (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM u),
h AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS a, count(*) FILTER (WHERE ruled = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
base AS MATERIALIZED (SELECT host, 0.15 * a / (SELECT sum(a + b) FROM h) AS trust, 0.15 * b / (SELECT sum(a + b) FROM h) AS distrust FROM h WHERE a + b > 0),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1), lambda x: lower(x)))) AS dst FROM j WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY ALL),
w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS f, n / sum(n) OVER (PARTITION BY dst) AS b FROM e),
moves AS MATERIALIZED (SELECT src AS s, dst AS t, f::DOUBLE AS f, 0.0::DOUBLE AS b FROM w UNION ALL SELECT dst, src, 0.0, b FROM w),
{", ".join(steps)}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN {last} USING (host)"""
