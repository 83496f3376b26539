"""Readers: logs of JSON lines, delimited tables, dictionaries, folders."""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """value of every line, its file, and its number there from 1.

    Parts of a file are numbered by where they start in it, so the numbers are those of the file however it is split; one
    row a part is joined.
    """
    meta = F.col("_metadata")
    df = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("_at"), F.monotonically_increasing_id().alias("_m"))
    parts = df.groupBy("file", "_at").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "_at", "_first", before.alias("_before"))
    return df.join(parts, ["file", "_at"]).select("value", "file", (F.col("_before") + F.col("_m") - F.col("_first") + 1).alias("line_no"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value of every line that isn't blank, with its file and number there."""
    return numbered(spark, path).where(F.trim("value") != "")


def separator(path: str, override: str | None = None) -> str:
    """The override, else tab for .tsv and .tab, else comma."""
    return override or ("\t" if path.lower().endswith((".tsv", ".tab")) else ",")


def sniffed(first_line: str) -> str:
    """The likeliest separator of a header line."""
    return max(",\t;|", key=first_line.count)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str | None = None, encoding: str | None = None, auto_sep: bool = False) -> DataFrame:
    """A table with a header, every column a string; only empty fields are null. A byte order mark is dropped.

    Without an encoding, UTF-8 where all lines are valid in it, else Latin-1.
    """
    encoding = encoding or encoding_at(spark, path)
    head = spark.read.option("encoding", encoding).text(path).first()
    first = head[0] if head else ""
    sep = sniffed(first) if auto_sep and not sep else separator(path, sep)
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("inferSchema", False)
    df = (reader.schema(text_schema(columns)) if columns else reader).csv(path)
    if df.columns and df.columns[0].startswith("\ufeff"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff"))
    return df


def encoding_at(spark: SparkSession, path: str) -> str:
    """UTF-8 where every line under the path is valid in it, else Latin-1, in which every byte is a character."""
    raw = spark.read.text(path).select(F.col("value").cast("binary").cast("string").alias("v"))
    return "UTF-8" if raw.where(~F.is_valid_utf8("v")).isEmpty() else "ISO-8859-1"


def encoding_of(sample: bytes) -> str:
    """UTF-8 where the bytes are valid, else Latin-1."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample, False)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def tables(spark: SparkSession, folder: str, glob: str = "*.csv", done: DataFrame | None = None) -> DataFrame:
    """All tables of a folder with their file; those whose file is in `done` are left out."""
    df = spark.read.option("header", True).option("pathGlobFilter", glob).option("escape", '"').csv(folder).withColumn("file", F.col("_metadata.file_name"))
    return df if done is None else df.join(done.select("file").distinct(), "file", "left_anti")


def dictionary_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no: file and number, cui, term, semantic_type) of lines of exactly three parts divided by a double bar."""
    df = numbered(spark, path).select(F.trim("value").alias("v"), F.struct("file", "line_no").alias("line_no"))
    part = F.split("v", r"\|\|", -1)
    return df.where(F.size(part) == 3).select("line_no", part[0].alias("cui"), part[1].alias("term"), part[2].alias("semantic_type"))


def result_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Batch results as they arrive in a folder."""
    return spark.readStream.schema("value string").text(folder)
