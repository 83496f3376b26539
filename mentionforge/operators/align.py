"""Linking input, and concept codes back onto mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entity_text, note_text
from ..functions.rows import require, require_unique, with_row_id

ALIGNED = ["patient_id", "umls_top_cui", "semantic_type", "assertion_status", "value", "unit"]


def linking_input(mentions: DataFrame) -> DataFrame:
    """id, entity, note: the text to link and its context."""
    require(mentions, "phrase", "body_location", "semantic_type", "modifier", "purpose")
    df = mentions if "id" in mentions.columns else with_row_id(mentions)
    return df.select("id", entity_text(F.col("phrase"), F.col("body_location")).alias("entity"), note_text(F.col("semantic_type"), F.col("modifier"), F.col("purpose")).alias("note"))


def by_id(mentions: DataFrame, linked: DataFrame, column: str = "id") -> DataFrame:
    """One-to-one on the id; a repeated id on either side fails."""
    require(linked, column, "umls_top_cui")
    left = mentions if column in mentions.columns else with_row_id(mentions, column)
    return require_unique(left, column).join(require_unique(linked.select(column, "umls_top_cui"), column), column).select(*(c for c in ALIGNED if c in left.columns or c == "umls_top_cui"))


def by_position(left: DataFrame, right: DataFrame, column: str = "row_id") -> DataFrame:
    """Row by row; the shorter side is padded with nulls."""
    require(left, column)
    require(right, column)
    return left.join(right, column, "full")
