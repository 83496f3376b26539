"""Incremental forms of the batch stages over streams of mentions (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Labels
from ..operators.labels import labelled


def token_counts(stream: DataFrame, late: str = "10 minutes", width: str = "7 days", ts: str = "ts") -> DataFrame:
    """(window, cui, status, n): mentions of each concept and status by window, late ones up to a watermark.

    Times without a zone are taken in the session's.
    """
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "cui", "status").agg(F.count("*").alias("n"))


def label_batches(stream: DataFrame, path: str, checkpoint: str, cfg: Labels = Labels()) -> StreamingQuery:
    """Scores as they arrive, labelled and appended batch by batch."""
    return stream.writeStream.foreachBatch(lambda df, _: labelled(df, cfg).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
