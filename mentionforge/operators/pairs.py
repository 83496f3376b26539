"""The most similar pairs of every ordered pair of statuses, by blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TopPairs
from ..functions.arrays import matrix
from ..functions.columns import unit

BLOCK = 2048
FOUND = "ia long, ib long, status_a string, status_b string, sim double"


def _block(k_search: int, limit_pp: int, limit_other: int, pp: str, digits: int):
    def run(key, t):
        t = t.combine_chunks()
        side = t.column("side").to_numpy()
        ids = t.column("row_id").to_numpy()
        state = np.array(t.column("status").to_pylist())
        out: list[list] = [[], [], [], [], []]
        for sa in np.unique(state[side == 0]):
            qa = np.flatnonzero((side == 0) & (state == sa))
            x = matrix(t.column("u"), qa)
            for sb in np.unique(state[side == 1]):
                qb = np.flatnonzero((side == 1) & (state == sb))
                qb = qb[np.argsort(ids[qb], kind="stable")]
                # rounded first, so that ranks don't depend on the order of summation
                sim = np.round(x @ matrix(t.column("u"), qb).T, digits)
                sim[ids[qa][:, None] == ids[qb][None, :]] = -np.inf
                n = min(k_search, sim.shape[1])
                floor = np.partition(sim, sim.shape[1] - n, 1)[:, sim.shape[1] - n]
                i, j = np.nonzero((sim >= floor[:, None]) & (sim > -np.inf))
                s = sim[i, j]
                order = np.lexsort((ids[qb][j], -s, i))
                i, j, s = i[order], j[order], s[order]
                ok = np.arange(len(i)) - np.searchsorted(i, i) < n
                i, j, s = i[ok], j[ok], s[ok]
                limit = limit_pp if sa == sb == pp else limit_other
                if k_search >= limit:
                    best = np.lexsort((ids[qb][j], ids[qa][i], -s))[:limit]
                    i, j, s = i[best], j[best], s[best]
                out[0] += ids[qa][i].tolist()
                out[1] += ids[qb][j].tolist()
                out[2] += [str(sa)] * len(i)
                out[3] += [str(sb)] * len(i)
                out[4] += s.tolist()
        return pa.table(dict(zip(("ia", "ib", "status_a", "status_b", "sim"), (pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.float64())))))

    return run


def top_pairs(vectors: DataFrame, cfg: TopPairs = TopPairs(), digits: int = 6) -> DataFrame:
    """a_cui, a_assertion_status, b_cui, b_assertion_status, cosine_similarity, config.

    vectors: row_id, cui, status, embedding. Rows without an id or vector take no part; components that are null or not
    finite count as 0, and vectors of different widths don't pair. A row never pairs with itself; both directions appear. Each query keeps its
    k_search nearest of a status first, then each pair of statuses its limit; where k_search reaches the limit the first
    step changes nothing and blocks cut down to the limit at once. Blocks meet pairwise; no row is compared twice and no
    similarity leaves its block unless it may rank.
    """
    usable = vectors.where(F.col("row_id").isNotNull() & (F.size("embedding") > 0))
    rows = usable.select("row_id", "cui", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit(cfg.default_status)).alias("status"), unit(F.col("embedding")).alias("u"), F.size("embedding").alias("width"))
    n = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("row_id", "status", "u", "width", F.lit(0).alias("side"), block.alias("ba"), every.alias("bb"))
    b = rows.select("row_id", "status", "u", "width", F.lit(1).alias("side"), every.alias("ba"), block.alias("bb"))
    found = a.unionByName(b).groupBy("width", "ba", "bb").applyInArrow(_block(cfg.k_search, cfg.top_pp, cfg.top_other, cfg.pp_label, digits), FOUND)
    most = max(cfg.top_pp, cfg.top_other)
    if cfg.undirected:
        found = found.where((F.col("status_a") < F.col("status_b")) | ((F.col("status_a") == F.col("status_b")) & (F.col("ia") < F.col("ib"))))
    if cfg.k_search < most:
        near = Window.partitionBy("ia", "status_b").orderBy(F.desc("sim"), "ib")
        found = found.withColumn("_k", F.row_number().over(near)).where(F.col("_k") <= cfg.k_search).drop("_k")
    limit = F.when((F.col("status_a") == cfg.pp_label) & (F.col("status_b") == cfg.pp_label), cfg.top_pp).otherwise(cfg.top_other)
    rank = F.row_number().over(Window.partitionBy("status_a", "status_b").orderBy(F.desc("sim"), "ia", "ib"))
    best = found.withColumn("_r", rank).where((F.col("_r") <= most) & (F.col("_r") <= limit))
    name = rows.select("row_id", "cui")
    best = best.join(name.select(F.col("row_id").alias("ia"), F.col("cui").alias("a_cui")), "ia").join(name.select(F.col("row_id").alias("ib"), F.col("cui").alias("b_cui")), "ib")
    return best.select("a_cui", F.col("status_a").alias("a_assertion_status"), "b_cui", F.col("status_b").alias("b_assertion_status"), F.col("sim").alias("cosine_similarity"), F.concat_ws("~", "status_a", "status_b").alias("config"))


def sorted_pairs(df: DataFrame) -> DataFrame:
    return df.orderBy("a_assertion_status", "b_assertion_status", F.desc("cosine_similarity"), "a_cui", "b_cui")
