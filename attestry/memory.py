"""A store of verified facts: claims go in with a verdict, and come out by recall or as answers.

Facts, sources and events are tables (see ``storage.Tables``). Everything works on sets: a batch of claims is
verified in parallel and applied as if its claims had come one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .judges import Judge, load_judge
from .operators import chain, facts, search
from .operators.verify import verify
from .policy import Policy
from .storage import Tables, stage

SCHEMAS = {
    "facts": "rowid bigint, id string, text string, norm string, subject string, status string, reason string, label string, support double, verdict string, source_id string, written_by string, created_at string, valid_from string, superseded_by string, superseded_at string, reviewed_by string, meta string, hash_key string",
    "sources": "id string, text string, origin string, author string, observed_at string, created_at string, meta string",
    "events": "seq bigint, ts string, kind string, fact_id string, payload string, prev_hash string, hash string",
}


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Memory:
    """Remember, recall, ask, review, forget. ``clock`` gives the time as ISO-8601 text in UTC."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy | None = None, judge: Judge | None = None, clock: Callable[[], str] = _now):
        self.spark, self.policy, self.clock = spark, policy or Policy(), clock
        self.judge = judge or load_judge(self.policy.judge)
        self.tables = Tables(spark, root, SCHEMAS)

    @property
    def facts(self) -> DataFrame:
        return self.tables.read("facts")

    @property
    def sources(self) -> DataFrame:
        return self.tables.read("sources")

    @property
    def events(self) -> DataFrame:
        return self.tables.read("events")

    def _log(self, events: DataFrame) -> DataFrame:
        """``events(o1, o2, kind, fact_id, payload)`` chained to the log, in order of o1 and o2."""
        last = chain.head(self.events).head()
        now = self.clock()
        return chain.build(events.withColumn("ts", F.lit(now)), ["o1", "o2", "fact_id"], last.hash, last.seq)

    def remember(self, items: DataFrame) -> DataFrame:
        """Store ``items(arrival, claim, source, author, origin, subject, observed_at, written_by)``.

        Returns ``arrival, fact_id, status, duplicate_of, superseded_by, verdict``, ids of facts. A claim that says
        what a verified fact of its subject says is its duplicate and is not stored. A null or empty subject
        supersedes nothing. Arrivals are distinct; they order the batch.
        """
        now, key = self.clock(), self.tables.meta["hash_key"]
        done = verify(items, self.policy, self.judge)
        p = facts.prepare_writes(done, self.policy, self.judge.is_model, F.lit(now))
        ms = F.lit(format(int(datetime.fromisoformat(now).timestamp() * 1000), "012x"))
        p = p.withColumn("id", F.concat(ms, F.substring(F.sha2(F.concat_ws("|", F.lit(self.tables.meta["store_id"]), F.lit(str(self.tables.meta["version"])), F.col("arrival").cast("string")), 256), 1, 10)))
        p = stage(p.withColumn("source_id", F.when(F.col("source").isNotNull(), facts.source_id(F.col("author"), F.coalesce("origin", F.lit("")), F.col("source"), key))), "writes")

        held = self.facts.filter("status = 'verified'")
        same = held.join(p.select("norm").distinct(), "norm", "left_semi").unionByName(held.join(p.filter("subject <> ''").select("subject").distinct(), "subject", "left_semi")).dropDuplicates(["id"])
        before = same.select((F.col("rowid") - F.lit(1 << 60)).alias("arrival"), "id", "subject", "norm", "status", "valid_from")
        rows = before.unionByName(p.select("arrival", "id", "subject", "norm", "status", "valid_from"))
        applied = stage(facts.apply_writes(rows), "applied")
        names = applied.select(F.col("arrival").alias("_a"), F.col("id").alias("_id"))
        for column in ("duplicate_of", "superseded_by"):
            applied = applied.join(names, F.col(column) == F.col("_a"), "left").withColumn(column, F.col("_id")).drop("_a", "_id")
        applied = stage(applied.select("arrival", "id", "status", "duplicate_of", "superseded_by"), "named")

        old = applied.filter("arrival < 0 AND superseded_by IS NOT NULL").select("id", "superseded_by")
        fresh = p.drop("status").join(applied.filter("arrival >= 0").drop("id"), "arrival")
        stored = fresh.filter("duplicate_of IS NULL")
        last = self.facts.agg(F.coalesce(F.max("rowid"), F.lit(0))).head()[0]
        lowest = p.agg(F.min("arrival")).head()[0] or 0
        row = {
            "rowid": F.col("arrival") - lowest + last + 1, "reason": F.col("verdict.reason"), "label": F.col("verdict.label"), "support": F.col("verdict.support"), "verdict": F.to_json("verdict"),
            "superseded_at": F.when(F.col("superseded_by").isNotNull(), F.lit(now)), "reviewed_by": F.lit(None).cast("string"), "meta": F.lit("{}"), "hash_key": F.sha2(F.concat(F.lit(key), F.col("id")), 256),
        }
        written = stored.withColumns(row)
        used = stored.filter("source_id IS NOT NULL").select(F.col("source_id").alias("id"), F.col("source").alias("text"), F.coalesce("origin", F.lit("")).alias("origin"), "author", "observed_at", F.lit(now).alias("created_at"), F.lit("{}").alias("meta")).dropDuplicates(["id"])
        used = used.join(self.sources.select("id"), "id", "left_anti")

        note = lambda kind, o2, fact_id, **fields: [F.col("arrival").alias("o1"), F.lit(o2).alias("o2"), F.lit(kind).alias("kind"), fact_id.alias("fact_id"), F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"}).alias("payload")]
        sealed = F.sha2(F.concat(F.lit(key), F.col("id"), F.col("norm")), 256)  # no word of the fact, so that forgetting it is enough
        log = stored.select(*note("write", 0, F.col("id"), seal=sealed, status=F.col("status"), written_by=F.col("written_by")))
        log = log.unionByName(fresh.filter("duplicate_of IS NOT NULL").select(*note("duplicate", 0, F.col("duplicate_of"), written_by=F.col("written_by"))))
        by = applied.filter("superseded_by IS NOT NULL AND duplicate_of IS NULL").join(names.select(F.col("_a").alias("at"), F.col("_id").alias("superseded_by")), "superseded_by")
        by = by.select("id", "superseded_by", F.greatest("arrival", "at").alias("arrival"))
        log = log.unionByName(by.select(*note("supersede", 1, F.col("id"), by=F.col("superseded_by"))))
        appended = {"sources": used, "events": self._log(log)}
        if old.isEmpty():
            self.tables.commit(appended | {"facts": written})
        else:
            changed = self.facts.join(old.withColumnRenamed("superseded_by", "_by"), "id", "left")
            changed = changed.withColumns({"status": F.when(F.col("_by").isNull(), F.col("status")).otherwise("superseded"), "superseded_at": F.when(F.col("_by").isNull(), F.col("superseded_at")).otherwise(now), "superseded_by": F.coalesce("_by", "superseded_by")}).drop("_by")
            self.tables.commit(appended, {"facts": changed.unionByName(written.select(*changed.columns))})
        return fresh.select("arrival", F.coalesce("duplicate_of", "id").alias("fact_id"), "status", "duplicate_of", "superseded_by", "verdict")

    def recall(self, queries: DataFrame, k: int = 5, include: tuple[str, ...] = ("verified",)) -> DataFrame:
        """``q_id, rowid, score, rank`` and the fact, the ``k`` best for each of ``queries(q_id, q)``."""
        return search.recall(self.facts, queries, k, include)

    def ask(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Answers to ``questions(q_id, q, language)`` out of verified facts, or none."""
        hits = self.recall(questions, search.candidates(k)).select("q_id", "rowid", "text", "rank")
        return search.ask(hits, questions, self.judge, self.policy, k)

    def review_queue(self, limit: int = 20) -> DataFrame:
        return facts.review_queue(self.facts, limit)

    def review(self, decisions: DataFrame) -> DataFrame:
        """Apply ``decisions(id, approve, reviewer)``; an approved fact is verified and supersedes. Returns the facts that changed."""
        known = stage(decisions, "decisions")
        if missing := known.join(self.facts.select("id"), "id", "left_anti").head():
            raise KeyError(missing.id)
        now = self.clock()
        before = self.facts
        after = stage(facts.review(before, known, now), "reviewed")
        was = before.select("id", F.col("status").alias("was"), F.col("superseded_by").alias("by"))
        changed = after.join(was, "id").filter((F.col("status") != F.col("was")) | ~F.col("superseded_by").eqNullSafe(F.col("by")))
        log = known.join(after.select("id", "rowid", "status"), "id").select(F.col("rowid").alias("o1"), F.lit(0).alias("o2"), F.lit("review").alias("kind"), F.col("id").alias("fact_id"), F.to_json(F.struct("approve", "reviewer")).alias("payload"))
        by = after.select(F.col("id").alias("superseded_by"), F.col("rowid").alias("by_row"))
        lost = changed.filter("status = 'superseded'").join(by, "superseded_by").select(F.greatest("rowid", "by_row").alias("o1"), F.lit(1).alias("o2"), F.lit("supersede").alias("kind"), F.col("id").alias("fact_id"), F.to_json(F.struct(F.col("superseded_by").alias("by"))).alias("payload"))
        self.tables.commit({"events": self._log(log.unionByName(lost))}, {"facts": after})
        return changed.drop("was", "by")

    def forget(self, ids: DataFrame) -> None:
        """Wipe the facts of ``ids(id)`` from every file, and sources that no other fact uses; the log keeps that it happened.

        The event is committed first. Forgetting twice is one forgetting; an unknown id is an error.
        """
        ids = stage(ids.select("id").distinct(), "ids")
        if missing := ids.join(self.facts.select("id"), "id", "left_anti").head():
            raise KeyError(missing.id)
        due = self.facts.filter("status <> 'forgotten'").join(ids, "id", "left_semi")
        log = due.select(F.col("rowid").alias("o1"), F.lit(0).alias("o2"), F.lit("forget").alias("kind"), F.col("id").alias("fact_id"), F.lit("{}").alias("payload"))
        self.tables.commit({"events": self._log(log)})
        left, sources = facts.forget(self.facts, self.sources, ids)
        self.tables.commit(replaced={"facts": left, "sources": sources})
        self.tables.purge()

    def get(self, ids: DataFrame) -> DataFrame:
        """The facts of ``ids(id)`` with their sources; an unknown id is an error."""
        if missing := ids.join(self.facts.select("id"), "id", "left_anti").head():
            raise KeyError(missing.id)
        return facts.with_sources(self.facts.join(ids.select("id").distinct(), "id", "left_semi"), self.sources)

    def where(self, condition: str, order: tuple[str, ...] = ("rowid",), limit: int | None = None) -> DataFrame:
        """Facts by an SQL condition, ordered by columns; one with a ``-`` before it descends."""
        found = self.facts.filter(condition).orderBy(*[F.col(c.removeprefix("-")).desc() if c.startswith("-") else F.col(c) for c in order])
        return found if limit is None else found.limit(limit)

    def history(self, subject: str) -> DataFrame:
        return self.facts.filter(F.col("subject") == subject).orderBy("valid_from", "rowid")

    def stats(self) -> dict[str, object]:
        """Facts by status, rows of the tables, and whether the log is whole."""
        by = {r.status: r["count"] for r in self.facts.groupBy("status").count().collect()}
        return {"facts": by, "sources": self.sources.count(), "chain": chain.verify(self.events).head().asDict()}
