"""Facts: statuses, duplicates, supersession, review, forgetting, as transformations of tables."""

from __future__ import annotations

import hashlib
import hmac
import secrets

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_fact, normalize_ws
from ..policy import Policy
from .verify import status_for

AUTHORS = ("agent", "document", "system", "tool", "user", "web")
STATUSES = ("forgotten", "quarantined", "rejected", "superseded", "unverified", "verified")
REVIEWABLE = ("quarantined", "rejected", "unverified")


def supersede(facts: DataFrame, subject: str, valid_from: str, arrival: str, key: str) -> DataFrame:
    """``facts`` with ``status`` and ``superseded_by``, as if they had arrived one by one, all verified.

    A fact at least as recent as its subject's holder replaces it; an older arrival is history from the
    start. The holder is a running maximum, so one sort per subject decides all. Without a subject nothing
    is superseded.
    """
    named = F.coalesce(F.col(subject).cast("string"), F.lit("")) != ""
    order = Window.partitionBy(subject).orderBy(arrival)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    d = facts.filter(named).withColumn("_h", F.max(F.struct(F.col(valid_from).alias("v"), F.col(arrival).alias("a"), F.col(key).alias("k"))).over(before))
    d = d.withColumn("_holds", F.col("_h").isNull() | (F.col(valid_from) >= F.col("_h.v")))
    following = F.first(F.when(F.col("_holds"), F.col(key)), ignorenulls=True).over(after)
    d = d.withColumn("superseded_by", F.when(F.col("_holds"), following).otherwise(F.col("_h.k"))).drop("_h", "_holds")
    alone = facts.filter(~named).withColumn("superseded_by", F.lit(None).cast(dict(d.dtypes)["superseded_by"]))  # no window for these
    return d.unionByName(alone).withColumn("status", F.when(F.col("superseded_by").isNull(), "verified").otherwise("superseded"))


def prepare_writes(verdicts: DataFrame, policy: Policy, is_model: bool, now: Column) -> DataFrame:
    """Rows to apply from verified items ``(arrival, claim, source, author, origin, subject, observed_at, written_by, verdict)``."""
    author = F.when(F.col("author").isin(*AUTHORS), F.col("author")).otherwise(F.raise_error(F.concat(F.lit("unknown author: "), F.coalesce("author", F.lit("null")))).cast("string"))
    d = verdicts.withColumns({"author": author, "text": normalize_ws(F.col("claim"))})
    d = d.withColumns({"norm": normalize_fact(F.col("text")), "status": status_for(F.col("verdict.label"), F.col("author").isin(*policy.trusted_authors), is_model), "valid_from": F.coalesce("observed_at", now), "created_at": now})
    return d


def apply_writes(rows: DataFrame) -> DataFrame:
    """Apply prepared writes in order of arrival: duplicates of a verified fact are dropped, newer facts supersede.

    Adds ``duplicate_of`` and ``superseded_by`` (arrivals) and the final ``status``. What is a duplicate
    depends on what was current at the time, so each subject is one ordered fold. Facts without a subject
    fold by their words instead, which cannot be superseded and only meet equal ones. Subjects stream through a
    task one after the other; it holds one fact that a later one may still supersede.
    """
    names = [c for c in rows.columns if c not in ("duplicate_of", "superseded_by")]
    names = ["arrival", *(c for c in names if c not in ("arrival", "status")), "status"]
    group = F.when(F.coalesce("subject", F.lit("")) != "", F.concat(F.lit("s:"), F.col("subject"))).otherwise(F.concat(F.lit("n:"), F.coalesce("subject", F.lit("-")), F.lit(":"), F.col("norm")))
    d = rows.select(*names, group.alias("_g"))
    at = {c: i for i, c in enumerate(d.columns)}

    def written(batch, keep, status, same, by):
        kept = [batch.column(at[c]).take(keep) for c in names[:-1]]
        return pa.RecordBatch.from_arrays([*kept, pa.array(status, pa.string()), pa.array(same, pa.int64()), pa.array(by, pa.int64())], names=[*names, "duplicate_of", "superseded_by"])

    def settled(row, by):
        return written(row, pa.array([0]), ["verified" if by is None else "superseded"], [None], [by])

    def fold(batches):
        group, current, carried = object(), None, None  # current: norm, valid_from and arrival; carried: its row, from an earlier batch
        for batch in batches:
            g, arrival, norm, status, since = (batch.column(at[c]).to_pylist() for c in ("_g", "arrival", "norm", "status", "valid_from"))
            same, by, mine = [None] * len(g), [None] * len(g), -1
            for i in range(len(g)):
                if g[i] != group:
                    group, current = g[i], None
                    if carried is not None:
                        yield settled(carried, None)
                        carried = None
                if status[i] != "verified":
                    continue
                if current is not None and current[0] == norm[i]:
                    same[i] = current[2]
                    continue
                if current is not None and current[1] > since[i]:
                    by[i], status[i] = current[2], "superseded"
                    continue
                if carried is not None:
                    yield settled(carried, arrival[i])
                    carried = None
                elif current is not None:
                    by[mine], status[mine] = arrival[i], "superseded"
                current, mine = (norm[i], since[i], arrival[i]), i
            keep = list(range(len(g)))
            if current is not None and carried is None:  # a later batch may supersede it
                keep.remove(mine)
                carried = batch.take(pa.array([mine]))
            if keep:
                yield written(batch, pa.array(keep), [status[i] for i in keep], [same[i] for i in keep], [by[i] for i in keep])
        if carried is not None:
            yield settled(carried, None)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in d.select(*names).dtypes) + ", duplicate_of long, superseded_by long"
    return d.repartition("_g").sortWithinPartitions("_g", "arrival").mapInArrow(fold, schema)


def duplicates(facts: DataFrame, text: str, subject: str, key: str) -> DataFrame:
    """``norm, subject, n, first``: facts of the same words and subject (null counts as a subject)."""
    return facts.groupBy(normalize_fact(F.col(text)).alias("norm"), F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def review_queue(facts: DataFrame, limit: int = 20) -> DataFrame:
    return facts.filter(F.col("status").isin("quarantined", "unverified")).orderBy(F.desc("rowid")).limit(limit)


def review(facts: DataFrame, decisions: DataFrame, now: str | None = None) -> DataFrame:
    """Apply ``decisions(id, approve, reviewer)``; deciding twice, blank reviewers and other statuses are errors.

    An approved fact is verified, and then supersedes the verified one of its subject, or is superseded by it,
    as when it is written; several of one subject are approved in order of rowid. Facts without ``subject`` and
    ``valid_from`` columns only change their status.
    """
    once = decisions.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("approve").alias("approve"), F.first("reviewer").alias("reviewer"))
    d = facts.join(once.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    decided = F.col("_id").isNotNull()
    bad = F.when(F.col("n") > 1, F.concat(F.lit("decided more than once: "), F.col("_id"))).when(decided & (F.trim(F.coalesce("reviewer", F.lit(""))) == ""), "a review needs the reviewer's name")
    bad = bad.when(decided & ~F.col("status").isin(*REVIEWABLE), F.concat(F.lit("cannot review a fact that is "), F.col("status")))
    verb = F.when(F.col("approve"), "approved by ").otherwise("rejected by ")
    status = F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).when(decided, F.when(F.col("approve"), "verified").otherwise("rejected")).otherwise(F.col("status"))
    changed = {"status": status, "reason": F.when(decided, F.concat(verb, "reviewer")).otherwise(F.col("reason")), "reviewed_by": F.when(decided, F.col("reviewer")).otherwise(F.col("reviewed_by")), "_new": decided & F.col("approve")}
    d = d.withColumns(changed).drop("_id", "approve", "reviewer", "n")
    if not {"subject", "valid_from", "superseded_by"} <= set(facts.columns):
        return d.drop("_new")
    current = d.filter((F.col("status") == "verified") & (F.col("subject") != "")).select("id", "subject", "valid_from", F.struct("_new", "rowid").alias("_at"))
    touched = d.filter("_new AND subject <> ''").select("subject").distinct()
    after = supersede(current.join(touched, "subject", "left_semi"), "subject", "valid_from", "_at", "id").filter("superseded_by IS NOT NULL").select(F.col("id").alias("_id"), F.col("superseded_by").alias("_by"))
    d = d.join(after, F.col("id") == F.col("_id"), "left")
    gone = F.col("_by").isNotNull()
    d = d.withColumns({"status": F.when(gone, "superseded").otherwise(F.col("status")), "superseded_by": F.coalesce("_by", "superseded_by")})
    if "superseded_at" in facts.columns:
        d = d.withColumn("superseded_at", F.when(gone, F.lit(now)).otherwise(F.col("superseded_at")))
    return d.drop("_id", "_by", "_new")


def forget(facts: DataFrame, sources: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with the content of ``ids(id)`` wiped, and sources without those that no fact uses any more.

    The results must replace the stored files, old snapshots too: rewriting is what erases.
    """
    d = facts.join(ids.select(F.col("id").alias("_id")).distinct(), F.col("id") == F.col("_id"), "left")
    gone = F.col("_id").isNotNull()
    wiped = {"text": "", "norm": "", "subject": None, "source_id": None, "verdict": None, "meta": "{}", "hash_key": "", "label": "", "support": 0.0, "status": "forgotten", "reason": "forgotten on request"}
    kinds = dict(facts.dtypes)
    d = d.withColumns({c: F.when(gone, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in wiped.items() if c in kinds}).drop("_id")
    used = d.select(F.col("source_id").alias("id")).filter("id IS NOT NULL").distinct()
    touched = facts.join(ids, "id", "left_semi").select(F.col("source_id").alias("id")).distinct()
    orphans = touched.join(used, "id", "left_anti")
    return d, sources.join(orphans, "id", "left_anti")


def with_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their source's ``source_origin`` and ``source_author``."""
    s = sources.select(F.col("id").alias("source_id"), F.col("origin").alias("source_origin"), F.col("author").alias("source_author"))
    return facts.join(s, "source_id", "left")


def seal(value: Column, key: Column) -> Column:
    """HMAC-SHA256 in hex under a key in hex; null stays null."""

    @F.pandas_udf("string")
    def sealed(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else hmac.new(bytes.fromhex(y), x.encode(), hashlib.sha256).hexdigest() for x, y in zip(v, k, strict=True)])

    return sealed(value, key)


def source_id(author: Column, origin: Column, text: Column, key: str) -> Column:
    """Identity of a source: who wrote it, where it came from, and its words."""
    return seal(F.concat_ws("\x00", author, origin, normalize_ws(text)), F.lit(key))


def new_key() -> str:
    return secrets.token_hex(32)
