"""Writers. Tables at rest are Parquet; delimited and JSON-lines forms are for the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, sep: str = ",", blank: tuple[str, ...] = ()) -> None:
    """Nulls of the `blank` columns, and of all strings, become empty fields; a header is always written."""
    flat = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in blank else F.col(c) for c in df.columns))
    flat.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls left out."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def matrix(df: DataFrame, path: str) -> None:
    """A sparse matrix as (i, j, v) rows."""
    df.select("i", "j", "v").write.mode("overwrite").parquet(path)


def vocabulary(df: DataFrame, path: str) -> str:
    """The vocabulary of a matrix, tokens without pairs too, beside it; returns where."""
    delimited(df.select("idx", "token", "cui", "status", "patient_count"), f"{path}.vocab.csv")
    return f"{path}.vocab.csv"


def meta(spark, facts: dict, path: str) -> None:
    import json

    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def wide(df: DataFrame, vector: str, width: int, prefix: str = "emb_") -> DataFrame:
    """A vector column as numbered columns, for export."""
    return df.select(*(c for c in df.columns if c != vector), *(F.col(vector)[i].alias(f"{prefix}{i}") for i in range(width)))


def gathered(df: DataFrame, prefix: str = "emb_") -> DataFrame:
    """Numbered columns as one vector; raises where there are none."""
    own = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix) :]))
    if not own:
        raise ValueError(f"no column starts with {prefix}")
    return df.select(*(c for c in df.columns if c not in own), F.array(*(F.col(c).cast("double") for c in own)).alias("embedding"))
