"""Analysis statuses and the support filter on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STATUS, status

STATUSES = sorted(set(STATUS.values()))


def mapped(df: DataFrame, normalise: bool = False) -> DataFrame:
    """assertion_status_norm; rows of other statuses go."""
    return df.withColumn("assertion_status_norm", status(F.col("assertion_status"), normalise)).where("assertion_status_norm is not null")


def counts(df: DataFrame) -> DataFrame:
    """(umls_top_cui, assertion_status_norm, n): rows, without null concepts."""
    return df.where("umls_top_cui is not null").groupBy("umls_top_cui", "assertion_status_norm").agg(F.count("*").alias("n"))


def pivoted(df: DataFrame) -> DataFrame:
    """Counts with statuses as columns, 0 where none."""
    one = [F.count_if(F.col("assertion_status_norm") == s).alias(s) for s in STATUSES]
    return df.where("umls_top_cui is not null").groupBy("umls_top_cui").agg(*one)


def supported(df: DataFrame, least: int = 10) -> DataFrame:
    """Rows of concepts whose most frequent status has `least` rows or more."""
    keep = counts(df).groupBy("umls_top_cui").agg(F.max("n").alias("n")).where(F.col("n") >= least)
    return df.join(keep, "umls_top_cui", "left_semi").select("patient_id", "umls_top_cui", "assertion_status_norm")
