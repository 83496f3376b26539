"""Tokens of patients, their support, co-occurrence and positive PMI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Cooccurrence
from ..functions.columns import token


def tokens(df: DataFrame, cfg: Cooccurrence = Cooccurrence(), patient: str = "patient_id", cui: str = "umls_top_cui", state: str = "assertion_status_norm") -> DataFrame:
    """Distinct (patient, token, cui, status); with a cap, the smallest tokens of each patient."""
    df = df.select(F.col(patient).alias("patient"), F.trim(cui).alias("cui"), F.upper(F.trim(state)).alias("status")).dropna()
    if cfg.wanted():
        df = df.where(F.col("status").isin(*cfg.wanted()))
    df = df.withColumn("token", token(F.col("cui"), F.col("status"), cfg.delimiter)).distinct()
    if cfg.cap > 0:
        order = Window.partitionBy("patient").orderBy("token")
        df = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cfg.cap).drop("_n")
    return df


def vocabulary(own: DataFrame, cfg: Cooccurrence = Cooccurrence()) -> DataFrame:
    """idx (from 0, by token), token, cui, status, patient_count. One row a token: bounded by the concepts, not the data."""
    counted = own.groupBy("token", "cui", "status").agg(F.count("*").alias("patient_count")).where(F.col("patient_count") >= cfg.min_patients)
    return counted.select((F.row_number().over(Window.orderBy("token")) - 1).cast("long").alias("idx"), "token", "cui", "status", "patient_count")


def pair_counts(own: DataFrame, vocab: DataFrame, cfg: Cooccurrence = Cooccurrence()) -> DataFrame:
    """(i, j, c): patients with both tokens, i < j. Patients carry small integer ids through the join, which AQE splits
    where a patient is hot; counts are combined before the second shuffle."""
    ids = own.join(vocab.select("token", "idx"), "token").select("patient", "idx")
    a, b = ids.select("patient", F.col("idx").alias("i")), ids.select("patient", F.col("idx").alias("j"))
    return a.join(b, "patient").where("i < j").groupBy("i", "j").agg(F.count("*").alias("c")).where(F.col("c") >= cfg.min_cooccur)


def symmetric(pairs: DataFrame, value: str = "c") -> DataFrame:
    """Both directions of an upper triangle, from one pass over it."""
    both = F.explode(F.array(F.struct(F.col("i"), F.col("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return pairs.select(both.alias("x"), value).select("x.i", "x.j", value)


def marginals(pairs: DataFrame) -> DataFrame:
    """(i, r): row sums of the symmetric matrix, after the minimum count."""
    return symmetric(pairs).groupBy("i").agg(F.sum("c").alias("r"))


def ppmi(pairs: DataFrame, shift_k: float = 1.0) -> DataFrame:
    """(i, j, c, v): positive PMI of the upper triangle, zeros left out."""
    row = marginals(pairs)
    total = row.agg(F.sum("r")).scalar()
    df = pairs.join(row, "i").join(row.select(F.col("i").alias("j"), F.col("r").alias("rj")), "j").withColumn("t", total)
    value = F.log(F.col("c").cast("double") * F.col("t") / (F.col("r").cast("double") * F.col("rj"))) - F.log(F.lit(float(shift_k)))
    return df.select("i", "j", "c", F.greatest(value, F.lit(0.0)).alias("v")).where("v > 0")


def checked(df: DataFrame, what: str) -> DataFrame:
    """df, or an error where it has no rows (strict runs)."""
    if df.isEmpty():
        raise ValueError(f"nothing left: {what}")
    return df
