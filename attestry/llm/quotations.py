"""Chat formatting: quotation linking.

Lines that start with ``>`` are quotes; the number of marks is their level. A run of quoted lines of one
level is a passage. Passages are normalised (marks and punctuation off, lower case, one space) and hashed,
and so are the paragraphs and whole bodies of earlier messages of the conversation; equal hashes link a
message to the one it quotes. Conversations are returned in reply order, without the quotes. All of it is
DataFrame work; a passage joins on its conversation and hash, never on a conversation alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Turns of a conversation that are searched together.
BLOCK = 4096
_MARKS = "\\A\\s*((?:>\\s?)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Each line's level and its content without the marks."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "\\s", "")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line")))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, in order, joined by line ends."""
    start = F.array().cast("array<struct<level:int,body:string>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["level"].alias("level"), F.concat(last["body"], F.lit("\n"), x["line"]).alias("body"))))
        return F.when((F.size(acc) > 0) & (last["level"] == x["level"]), longer).otherwise(F.concat(acc, F.array(F.struct(x["level"].alias("level"), x["line"].alias("body")))))

    return F.aggregate(lines, start, add)


def _latest(said: DataFrame, asked: DataFrame) -> DataFrame:
    """``c, h, turn, from``: the latest turn before ``turn`` that said ``h``, without pairing turns up.

    Both sides are put in order of turns, in blocks of ``BLOCK`` turns; a block starts with what the blocks
    before it end with, so that words repeated at very many turns are not one task's work.
    """
    rows = said.select("c", "h", F.col("from").alias("turn"), "from").unionByName(asked.withColumn("from", F.lit(None).cast(dict(said.dtypes)["from"])))
    rows = rows.filter("turn IS NOT NULL").withColumn("block", F.floor(F.col("turn") / BLOCK))
    ends = rows.groupBy("c", "h", "block").agg(F.max("from").alias("end"))
    before = F.max("end").over(Window.partitionBy("c", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("c", "h", "block", before.alias("earlier")).filter("earlier IS NOT NULL")
    order = Window.partitionBy("c", "h", "block").orderBy("turn", F.col("from").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({"_asks": F.col("from").isNull(), "near": F.max("from").over(order)}).filter("_asks")
    near = near.join(ends, ["c", "h", "block"], "left").select("c", "h", "turn", F.coalesce("near", "earlier").alias("from"))
    return near.filter(F.col("from").isNotNull())


def _dealt(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of group and order, with the number of each row's range in ``part``; a large group has many."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*group, *order]]).withColumn("part", F.spark_partition_id())


def link_quotations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: ``conv_id, turn, role, body, n_quotes, depth, n_linked, reply_to, position``.

    ``body`` is the text without quoted lines, ``depth`` the deepest level, ``n_linked`` how many quoted
    passages were found in earlier messages. ``reply_to`` is the turn whose words the message quotes at the
    lowest level, the latest such turn; without one, the turn before; null for a first message. ``position``
    counts the messages of a conversation in reply order: by the turn replied to, then by turn. Null texts
    are empty; messages without letters or digits are never quoted; null conversations are one of their own;
    null turns come first and are never replied to; equal turns stand by role and text, and rows that are
    equal in all of it have one reply and a position each. A message is held in memory whole, whatever its
    length. An empty table gives an empty result. Other columns are not read, so clashing names do not matter.
    """
    m = messages.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), _lines(F.col(text)).alias("lines"))
    body = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    quotes = F.filter(_passages(F.filter("lines", lambda x: (x["level"] > 0))), lambda p: normalised(p["body"]) != "")
    m = m.withColumns({"body": body, "quotes": quotes})
    m = m.withColumn("id", F.md5(F.to_json(F.struct("conv_id", "turn", "role", "body", "quotes"), {"ignoreNullFields": "false"})))
    ckey = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("c")
    m = stage(m, "messages")

    said = m.select(ckey, "turn", F.explode(F.array_distinct(F.concat(F.array("body"), F.split("body", "\n+")))).alias("p"))
    said = said.select("c", F.col("turn").alias("from"), F.md5(normalised(F.col("p"))).alias("h"), normalised(F.col("p")).alias("n")).filter("n <> ''").select("c", "from", "h").distinct()
    asked = m.select(ckey, "turn", "id", F.posexplode("quotes").alias("k", "q"))
    whole = asked.select("c", "turn", "id", "k", F.col("q.level").alias("level"), F.explode(F.array_distinct(F.concat(F.array("q.body"), F.split("q.body", "\n+")))).alias("p"))
    asked = whole.select("c", "turn", "id", "k", "level", F.md5(normalised(F.col("p"))).alias("h"))
    found = asked.join(_latest(said, asked.select("c", "h", "turn").distinct()), ["c", "h", "turn"])
    best = found.groupBy("id", "k", "level").agg(F.max("from").alias("from"))
    links = best.groupBy("id").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct(F.col("level"), (-F.col("from")).alias("from"))).alias("b"))
    links = links.select("id", "n_linked", (-F.col("b.from")).alias("quoted"))

    out = m.select("conv_id", ckey, "turn", "role", "body", "id", F.size("quotes").alias("n_quotes"), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("depth"))
    out = stage(_dealt(out.join(links, "id", "left"), ["c"], ["turn", "role", "body"]), "by-turn")
    before = out.groupBy("c", "part").agg(F.max("turn").alias("last"))
    before = before.select("c", "part", F.lag("last").over(Window.partitionBy("c").orderBy("part")).alias("last"))  # a row for each part
    order = Window.partitionBy("c", "part").orderBy("turn", "role", "body")
    out = out.withColumns({"previous": F.lag("turn").over(order), "first": F.row_number().over(order) == 1}).join(before, ["c", "part"])
    out = out.withColumn("reply_to", F.coalesce("quoted", F.when(F.col("first"), F.col("last")).otherwise(F.col("previous")))).drop("part", "last", "first", "previous")

    keys = ["reply_to", "turn", "role", "body"]
    out = stage(_dealt(out, ["c"], keys), "by-reply")
    before = out.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("c", "part", F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n"))
    position = (F.row_number().over(Window.partitionBy("c", "part").orderBy(*keys)) + F.col("n")).cast("int")
    return out.join(before, ["c", "part"]).select("conv_id", "turn", "role", "body", "n_quotes", "depth", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", position.alias("position"))
