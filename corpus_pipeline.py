"""From documents to token ids: quality, near-duplicates, secrets, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Null and empty texts, very
long texts, repeated rows and empty tables pass through as the operators' docstrings say; columns beyond those of
documents are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionforge.llm import mixing, near_copies, piece_codec, quality, secrets
from mentionforge.llm.common import keep, table, work_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by all labels, doesn't reject."""
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of smallest doc_id.

    Documents without words all stay; of rows repeated whole, one stays.
    """
    docs = docs.select(*COLUMNS)
    found = near_copies.near_copies(docs, width=5, percent=80)
    stay = keep(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count(), work_folder(spark), "stay")
    ids = stay.select(F.col("doc_id").alias("id"))
    out = docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select(*COLUMNS)
    return out if stay.where("count > 1").isEmpty() else out.dropDuplicates()


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark and n_chars brought up to date."""
    docs = docs.select(*COLUMNS)
    found, _ = secrets.scan(docs, "doc_id", "text")
    hit = found.where(F.size("spans") > 0).select(F.col("path").alias("id"), F.col("blob").alias("b"), "spans").distinct()
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    joined = docs.join(hit.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (blob == F.col("b")), "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redact(joined, "text"))
    joined = joined.withColumn("text", text)
    return joined.select("doc_id", "text", "lang", "source", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it, none to three."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs)
    copies = mixed.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("s")).agg(F.max("copies").alias("copies")).where("copies > 0")
    joined = docs.join(copies.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of every copy; exact: they decode to its
    text (a lower one eighth block, the model's mark for a space, counts as a space)."""
    coded = piece_codec.encode(docs, piece_codec.default_model(), "text", ("doc_id", "lang", "source", "text"))
    exact = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", exact.alias("exact"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: No stage but the third can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
