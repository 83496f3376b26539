"""Cutoff labels and summaries of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Labels
from ..functions.columns import number


def labelled(df: DataFrame, cfg: Labels = Labels(), score: str = "relationship_score") -> DataFrame:
    """relationship_label_cutoff and has_medical_relationship_cutoff (text).

    Binary: a score of the threshold or more is positive; no score gives nulls. Tri-state: low and below negative, high
    and above positive, uncertain between; what no score gives is a policy: uncertain and empty, or positive and TRUE.
    """
    s = number(F.col(score).cast("string"))
    if cfg.mode == "binary":
        if cfg.threshold is None:
            raise ValueError("binary labels need a threshold")
        yes = F.when(s >= cfg.threshold, F.lit(True)).when(s.isNotNull(), F.lit(False))
        return df.withColumn("has_medical_relationship_cutoff", F.when(yes, "TRUE").when(~yes, "FALSE")).withColumn("relationship_label_cutoff", F.when(yes, "positive").when(~yes, "negative"))
    if cfg.mode != "tristate":
        raise ValueError(f"unknown mode {cfg.mode}")
    if not cfg.low < cfg.high:
        raise ValueError("low must be below high")
    label, flag = ("positive", "TRUE") if cfg.null_scores == "reference" else ("uncertain", "")
    out = df.withColumn("relationship_label_cutoff", F.when(s.isNull(), label).when(s <= cfg.low, "negative").when(s >= cfg.high, "positive").otherwise("uncertain"))
    return out.withColumn("has_medical_relationship_cutoff", F.when(s.isNull(), flag).when(s <= cfg.low, "FALSE").when(s >= cfg.high, "TRUE").otherwise(""))


def summary(df: DataFrame, column: str = "relationship_score") -> DataFrame:
    """count, mean, std, min, p25, median, p75, max of the numbers in a text column."""
    own = df.select(number(F.col(column).cast("string")).alias("s")).where("s is not null")
    q = F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return own.agg(F.count("*").alias("count"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), F.min("s").alias("min"), q.alias("q"), F.max("s").alias("max")).select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max")


def distribution(df: DataFrame, column: str = "relationship_label_cutoff") -> DataFrame:
    """label, count and percent of all rows; null and empty are <empty>."""
    counted = df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("<empty>")).alias("label")).agg(F.count("*").alias("count"))
    return counted.withColumn("percent", 100.0 * F.col("count") / counted.agg(F.sum("count")).scalar())


def telemetry(df: DataFrame) -> DataFrame:
    """Samples, mean and maximum of utilisation, maximum of memory, mean and maximum of power and temperature."""
    return df.agg(F.count("*").alias("samples"), F.avg("util").alias("avg_util"), F.max("util").alias("max_util"), F.max("mem_used").alias("max_mem"), F.avg("power").alias("avg_power"), F.max("power").alias("max_power"), F.avg("temp").alias("avg_temp"), F.max("temp").alias("max_temp"))
