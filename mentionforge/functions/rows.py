"""Row numbers and checks on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row_id(df: DataFrame, name: str = "id", folder: str | None = None) -> DataFrame:
    """Numbers 1..N in the order of the input's partitions, without gathering rows in one task.

    Counts and numbers come from two readings of the input. Where it may change between them (an order that isn't
    stable, a source that grows), give a folder: the input is written there first, and its copy is numbered. One row a
    partition is broadcast.
    """
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    if folder is not None:
        marked.write.mode("overwrite").parquet(folder)
        marked = df.sparkSession.read.schema(marked.schema).parquet(folder)
    marked = marked.withColumn("_p", F.shiftright("_m", 33))
    total, first = 0, []
    for p, n in sorted(marked.groupBy("_p").count().collect()):
        first.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(first, "_p long, _first long")
    numbered = marked.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).cast("long"))
    return numbered.select(*df.columns, name)


def ranked_id(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """Numbers 1..N in the given order; for frames of bounded size (vocabularies, ranked results)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def require(df: DataFrame, *columns: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_unique(df: DataFrame, column: str) -> DataFrame:
    """df, whose evaluation fails where the column has a value twice."""
    n = F.count("*").over(Window.partitionBy(column))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{column} is not unique"))).otherwise(F.lit(True))).drop("_n")
