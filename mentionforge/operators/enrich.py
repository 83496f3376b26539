"""Terms and types onto pairs, from the best entry of each concept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import require


def codebook(linked: DataFrame, row_id: str = "row_id") -> DataFrame:
    """cui, term, semantic_type: of each concept the entry of highest confidence, the first row among equals.

    A confidence that is no number counts as -1; without the column the first row counts.
    """
    require(linked, "umls_top_cui", "umls_top_term", "umls_top_semantic_type", row_id)
    score = F.coalesce(F.col("umls_top_confidence").try_cast("double"), F.lit(-1.0)) if "umls_top_confidence" in linked.columns else F.lit(0.0)
    best = F.max_by(F.struct(F.col("umls_top_term").alias("term"), F.col("umls_top_semantic_type").alias("semantic_type")), F.struct(score.alias("s"), (-F.col(row_id)).alias("r")))
    own = linked.withColumn("cui", F.trim("umls_top_cui")).where("cui is not null")
    return own.groupBy("cui").agg(best.alias("x")).select("cui", "x.term", "x.semantic_type")


def enriched(pairs: DataFrame, book: DataFrame, keep_similarity: bool = False) -> DataFrame:
    """pair_id and both sides with term and type; pairs are numbered in their sorted order."""
    require(pairs, "a_cui", "a_assertion_status", "b_cui", "b_assertion_status")
    order = [F.col("a_assertion_status"), F.col("b_assertion_status"), F.desc("cosine_similarity"), F.col("a_cui"), F.col("b_cui")]
    df = pairs.withColumn("pair_id", F.row_number().over(Window.orderBy(*order)).cast("long"))
    for side in "ab":
        own = book.select(F.col("cui").alias(f"{side}_cui"), F.col("term").alias(f"{side}_term"), F.col("semantic_type").alias(f"{side}_semantic_type"))
        df = df.join(own, f"{side}_cui", "left")
    columns = ["pair_id", *(f"{s}_{c}" for s in "ab" for c in ("cui", "term", "semantic_type", "assertion_status"))]
    return df.select(*columns, *(["cosine_similarity", "config"] if keep_similarity else []))


def unmapped(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("a_term").isNull()).alias("a_unmapped"), F.count_if(F.col("b_term").isNull()).alias("b_unmapped"), F.count("*").alias("pairs"))
