"""What the operators of this package share: tables, the shared work folder, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

#: Texts handed to Python at a time; bounds a worker's memory whatever the length of the documents.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def work_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a cluster is refused; on one machine, as in tests, a temporary folder takes its place.
    """
    # every operator hands results on as written tables, so shuffle files need not outlive the job that made them
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return shared.work_folder(spark, "corpus")


def keep(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> DataFrame:
    """Write df into the shared work folder and read it back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: At most so many keys of a join count as hot: a hot key holds more than one HOT-th of all rows, and FLOOR at least.
HOT, FLOOR = 10_000, 256


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: str, sizes: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has few rows a key, where some keys may hold a large share of rows.

    sizes (default: facts) gives each key's number of rows in the column `size`. The rows of a hot key are dealt over
    several tasks by the column `spread`, and its facts go to each of these. What is broadcast is the list of hot keys,
    HOT entries at most whatever the data.
    """
    sizes = (facts if sizes is None else sizes).select(*keys, "size")
    total, most = sizes.agg(F.sum("size"), F.max("size")).first()
    facts = facts.drop("size")
    if not total or most <= max(total // HOT, FLOOR):
        return rows.join(facts, keys, how)
    limit = max(total // HOT, FLOOR)
    hot = sizes.where(F.col("size") > limit).select(*keys, F.ceil(F.col("size") / limit).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    held = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(held, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b; long, a <> b).

    Alternating large-star and small-star rounds. Each is a grouped minimum (combined before the shuffle) and a join
    that deals the edges of hubs over tasks, and is written to the shared folder before the next; no node list reaches
    the driver, which sees one checksum a round.
    """
    cur = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), folder, f"{name}-0")
    seen, k = None, 0
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size"), folder, f"{name}-{k}-low")
        large = spread_join(both, low, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, folder, f"{name}-{k}-large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), folder, f"{name}-{k}-least")
        small = spread_join(large, least, ["u"], "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{k + 1}")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur, k = nxt, k + 1
        if tuple(now) == seen:
            break
        seen = tuple(now)
    # at the fixed point every node but the root points at its component's smallest node
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
