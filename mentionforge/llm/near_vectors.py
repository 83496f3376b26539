"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label form one class. In each pass the classes are ordered by label and by the concatenated signs of
random projections, the order is cut into windows of WINDOW, and every vector is compared (cosine, double precision)
with its own window and the one before. The number of passes follows from the size of the largest label, as if bits
halved it. How far that held is then measured: in each pass a vector meets all that share its first bits, as many bits
as tell it from the nearest codes outside its windows, and from these its chance of missing a link at the threshold in
all passes. Verified pairs are united across passes.

A vector linked to half a window or more, or whose chance of missing a link is above `miss`, sits where windows can't
hold all that is near. Those vectors are looked at exactly: as stated queries against all vectors of their label, block
by block; links between two of them are counted where they are found, and each block pair gives on a spanning forest
instead of its pairs. So no link is lost and no group is written out pair by pair.

Rows: vectors that are null, empty or zero or hold null or non-finite components, and rows without a label, link with
nothing. Vectors of different widths link with nothing of the other width. Copies and repeated rows link with each
other (each row counts); a null vec_id takes part but is never kept. Extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, keep, partitions, small_batches, spread_join, table, work_folder
from .vectors import by_width, dense, matrix, usable

WINDOW = 256
#: Windows that are dealt out together; one more goes with them.
CHUNK = 8
BITS = 62
QUERY_BLOCK = BASE_BLOCK = 2048


def passes_for(largest: int, threshold: float, miss: float, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has met in a window but for a chance of `miss`."""
    same = 1 - math.acos(threshold) / math.pi
    shared = max(1, math.ceil(math.log2(max(2, 2 * largest / window))))
    return max(8, math.ceil(math.log(miss) / math.log1p(-(same**shared))))


def _unsure(place: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Nodes whose passes leave a link at the threshold unseen with a chance above `miss`.

    place: pass, group, code, node, window, place. A pass shows a node all that share more first bits with it than the
    last code before and the first after its windows do.
    """
    same = 1 - math.acos(threshold) / math.pi
    end = F.struct("group", "code")
    ends = place.groupBy("window").agg(F.min_by(end, "place").alias("first"), F.max_by(end, "place").alias("last"))
    none = F.lit(None).cast(ends.schema["first"].dataType)
    before = ends.select((F.col("window") + 2).alias("window"), F.col("last").alias("before"), none.alias("after"))
    after = ends.select((F.col("window") - 2).alias("window"), none.alias("before"), F.col("first").alias("after"))
    outside = before.union(after).groupBy("window").agg(F.max("before").alias("before"), F.max("after").alias("after"))

    def needed(side: str) -> Column:
        apart = F.col("code").bitwiseXOR(F.col(f"{side}.code"))
        bits = F.when(apart == 0, BITS + 1).otherwise(BITS + 1 - F.length(F.bin(apart)))
        return F.when(F.col(f"{side}.group") == F.col("group"), bits).otherwise(0)

    bits = F.greatest(needed("before"), needed("after"))
    missed = F.when(bits == 0, -1e9).otherwise(F.coalesce(F.log1p(-F.pow(F.lit(same), bits)), F.lit(-1e9)))
    chance = place.join(outside, "window", "left").groupBy("node").agg(F.sum(missed).alias("log"))
    return chance.where(F.col("log") > math.log(miss)).select("node")


def _codes(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """(pass, label, code, node): the signs of BITS random projections, the first the most significant."""

    def run(batches):
        for batch in batches:
            for idx in by_width(batch.column("embedding")):
                x = matrix(batch.column("embedding"), idx)
                rows = pa.array(idx)
                for p in range(passes):
                    way = np.random.Generator(np.random.PCG64((seed, p))).normal(size=(x.shape[1], BITS))
                    code = ((x @ way) > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), p, np.int32)), batch.column("label").take(rows), pa.array(code), batch.column("node").take(rows)], names=["pass", "label", "code", "node"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "label", "embedding").mapInArrow(run, f"pass int, label {kind}, code long, node long")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _window_pairs(threshold: float):
    """For every window of a chunk and the one before: pairs (a, b) that link, or (a, a) for one that has half a window
    of links."""

    def run(key, t):
        t = t.combine_chunks()
        node, group, window = (t.column(c).to_numpy() for c in ("node", "group", "window"))
        first = key[0].as_py() * CHUNK
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        order = np.lexsort((node, group))
        for idx in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            u, at, nodes = _unit(matrix(t.column("embedding"), idx)), window[idx], node[idx]
            for w in np.unique(at[at >= first]):
                near = np.flatnonzero((at == w) | (at == w - 1))
                mine = at[near] == w
                close = (u[near] @ u[near].T >= threshold) & (mine[:, None] | mine[None, :])
                np.fill_diagonal(close, False)
                full = close.sum(1) >= WINDOW // 2
                close[full] = close[:, full] = False
                a, b = np.nonzero(np.triu(close, 1))
                out_a += [nodes[near][a], nodes[near][full]]
                out_b += [nodes[near][b], nodes[near][full]]
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a bipartite graph given as a boolean matrix."""
    rows, cols = np.ones(close.shape[0], bool), np.ones(close.shape[1], bool)
    edges = []
    for start in range(close.shape[0]):
        if not rows[start]:
            continue
        rows[start] = False
        stack = [(0, start)]
        while stack:
            side, k = stack.pop()
            fresh = np.flatnonzero(close[k] & cols) if side == 0 else np.flatnonzero(close[:, k] & rows)
            (cols if side == 0 else rows)[fresh] = False
            for x in fresh:
                edges.append((k, int(x)) if side == 0 else (int(x), k))
                stack.append((1 - side, int(x)))
    return edges


def _block_links(threshold: float):
    """A block of crowded vectors against a block of all: rows (a, n) with the weight of a's links there, b null; and
    links (a, b) to vectors that aren't crowded, or of a spanning forest among those that are, n null."""

    def run(key, t):
        t = t.combine_chunks()
        query = t.column("query").to_numpy(zero_copy_only=False)
        q, b = np.flatnonzero(query), np.flatnonzero(~query)
        a_out, b_out, n_out = [], [], []
        if len(q) and len(b):
            node, weight, crowded = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("crowded").to_numpy(zero_copy_only=False)
            close = _unit(matrix(t.column("embedding"), q)) @ _unit(matrix(t.column("embedding"), b)).T >= threshold
            close &= node[q][:, None] != node[b][None, :]
            total = close @ weight[b]
            hit = np.flatnonzero(total)
            a_out += node[q][hit].tolist()
            b_out += [None] * len(hit)
            n_out += total[hit].tolist()
            loose = ~crowded[b]
            x, y = np.nonzero(close & loose)
            pairs = list(zip(x, y)) + _forest(close & ~loose)
            for x, y in pairs:
                a_out.append(int(node[q][x]))
                b_out.append(int(node[b][y]))
                n_out.append(None)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64()), "n": pa.array(n_out, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, miss: float = 1e-5, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    folder = work_folder(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    live = dense(rows.where(F.col("label").isNotNull()), "embedding")
    classes = live.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), folder, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, threshold, miss)

    order = ["pass", "label", "code", "node"]
    ranked = _codes(classes, passes, seed).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranked = keep(ranked.withColumn("at", F.monotonically_increasing_id()), folder, "ranked")
    # one number a partition turns places within partitions into places in the whole order
    part = F.shiftright("at", 33)
    sizes = sorted(ranked.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    places = spark.createDataFrame(offsets, "p long, offset long")
    place = ranked.withColumn("p", part).join(places, "p").withColumn("place", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))
    place = place.select("pass", F.xxhash64("pass", "label").alias("group"), "code", "node", "place", F.floor(F.col("place") / WINDOW).alias("window"))
    window = F.col("window")
    chunk = F.floor(window / CHUNK)
    # the last window of a chunk is also needed by the chunk after it
    chunks = F.when(window % CHUNK == CHUNK - 1, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    both = place.select("node", "group", "window", F.explode(chunks).alias("chunk"))
    joined = both.join(classes.select("node", "embedding"), "node").withColumn("group", F.xxhash64("group", F.size("embedding")))
    found = keep(joined.groupBy("chunk").applyInArrow(_window_pairs(threshold), "a long, b long").distinct(), folder, "found")

    crowded = found.where("a = b").select(F.col("a").alias("node")).union(_unsure(place, threshold, miss)).distinct()
    crowded = keep(crowded, folder, "crowded")
    pairs = found.where("a <> b")
    for side in "ab":
        pairs = pairs.join(crowded.withColumnRenamed("node", side), side, "left_anti").select("a", "b")

    facts = classes.join(crowded.withColumn("c", F.lit(True)), "node", "left").select("node", "label", "n", "embedding", F.coalesce("c", F.lit(False)).alias("crowded"))
    count = facts.groupBy("label", F.size("embedding").alias("width")).agg(F.ceil(F.count("*") / BASE_BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("crowded") / QUERY_BLOCK).cast("int").alias("query_blocks")).where("query_blocks > 0")
    sized = facts.withColumn("width", F.size("embedding")).join(count, ["label", "width"])
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    base = sized.withColumn("b", mine(F.col("blocks"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).withColumn("query", F.lit(False))
    query = sized.where("crowded").withColumn("q", mine(F.col("query_blocks"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("query", F.lit(True))
    seen = base.unionByName(query).groupBy("label", "width", "q", "b").applyInArrow(_block_links(threshold), "a long, b long, n long")
    seen = keep(seen, folder, "seen")

    links = keep(pairs.union(seen.where("b is not null").select("a", "b")), folder, "links")
    groups = components(links, folder, "groups")
    weight = classes.select("node", "n")
    loose = pairs.union(pairs.select("b", "a")).union(seen.where("b is not null").select(F.col("b").alias("a"), F.col("a").alias("b")).join(crowded.withColumnRenamed("node", "a"), "a", "left_anti").select("a", "b"))
    counted = loose.join(weight.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("n").alias("more"))
    counted = counted.union(seen.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))).groupBy("a").agg(F.sum("more").alias("more"))
    named = classes.join(counted.withColumnRenamed("a", "node"), "node", "left").join(groups, "node", "left").select("node", "label", "embedding", "vec_id", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("own"))
    named = keep(named, folder, "named")
    least = keep(named.groupBy("own").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("size")), folder, "least")
    named = keep(spread_join(named.drop("vec_id"), least, ["own"], "node").select("label", "embedding", "n_links", "component_id", F.col("n").alias("size")), folder, "components")

    # copies of one vector may be many: they meet their class in several tasks
    alike = dense(rows.where(F.col("label").isNotNull()), "embedding")
    linked = spread_join(alike, named, ["label", "embedding"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable(F.col("embedding")) & F.col("label").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE u AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  AND CASE WHEN len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) >= 0.93 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) END),
reach(v, m) AS (SELECT vec_id, vec_id FROM u UNION SELECT l.a, reach.m FROM reach JOIN l ON l.b = reach.v),
least AS (SELECT v, min(m) AS m FROM reach GROUP BY v), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON v = vec_id LEFT JOIN n ON a = vec_id"""
