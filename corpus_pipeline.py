"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Stages keep a document's columns together in one struct while they work, so that no column of the input can
clash with their own. Null ids are one more id; null and empty texts stay, as documents without words, unless
the quality stage rejects them. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import bpe, minhash, mixing, rules, suffixes
from attestry.llm.common import discard, scratch, stage, table
from attestry.llm.minhash import LAST


def _packed(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, k, tag``: all columns as one, and what the stages read; equal rows share k and tag."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", "row.doc_id", "row.text")
    return d.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tag": F.coalesce(F.md5("text"), F.lit(""))})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rule ensemble rejects; every row is judged by its own text, repeated rows alike."""
    return rules.accept(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, by five-word shingles at 0.8.

    It is the one with the least id, and of equal or null ids (which are the greatest) the one whose text's
    digest is least. Rows with equal ids and texts count once. Documents without words are no copies of each
    other.
    """
    p = _packed(docs)
    judged = minhash.near_dedup(p.select("doc_id", "text", "tag"), size=5, percent=80, tag="tag")
    judged = judged.select(F.coalesce("doc_id", F.lit(LAST)).alias("k"), "tag", "n_shingles", "component")
    first = judged.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("k", "tag")).alias("m")).select("m.*")
    kept = stage(first.unionByName(judged.filter("n_shingles = 0").select("k", "tag")).distinct(), "kept")
    stay = p.select("row", "k", "tag").join(kept.hint("merge"), ["k", "tag"], "left_semi")
    return stay.dropDuplicates(["k", "tag"]).select("row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 400 bytes or 50 words that occur elsewhere; the documents stay, with ``n_chars`` of what is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []
    cut = suffixes.remove_repeats(docs.select("doc_id", "text", *carried), texts=True, keep=("row",) * bool(others), words=50)
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[(back[c] if c in back else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document as many copies as the mix takes of its words, rounded; none is a copy too few or many.

    Documents with one id share what the mix takes of them all. Documents without words get no copy.
    """
    p = _packed(docs)
    taken = mixing.mix(docs.select("doc_id", "source", "text")).groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    taken = stage(taken.select("k", copies.alias("copies")).filter("copies > 0"), "copies")
    rows = p.select("row", "k").join(taken.hint("merge"), "k")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to; a null text has none."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: Signatures, suffix refinement and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage staged goes once its documents are written, and so do the documents it read."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stage(function(spark, docs, sf_dir), name.split()[0]))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
