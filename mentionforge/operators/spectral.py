"""Spectral embeddings of a sparse symmetric matrix given as (i, j, v) rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Spectral
from ..shared import work_folder
from ..sources import writers
from .eigen import block_krylov, chosen


def prepared(m: DataFrame, cfg: Spectral = Spectral()) -> DataFrame:
    """Threshold, then no diagonal, then the mean with the transpose."""
    if cfg.threshold is not None:
        m = m.where(F.col("v") >= cfg.threshold)
    if cfg.drop_diagonal:
        m = m.where("i <> j")
    if cfg.symmetrize:
        m = m.union(m.select("j", "i", "v")).groupBy("i", "j").agg((F.sum("v") / 2).alias("v"))
    return m


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive, so that results don't depend on the solver's sign."""
    if not vectors.size:
        return vectors
    top = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def checked(m: DataFrame, n: int) -> DataFrame:
    """m, or an error where a cell lies outside the n x n square."""
    low, high = m.agg(F.min(F.least("i", "j")), F.max(F.greatest("i", "j"))).first()
    if low is not None and (low < 0 or high >= n):
        raise ValueError(f"cells from {low} to {high} don't fit a square of {n}")
    return m


def dense(m: DataFrame, n: int) -> np.ndarray:
    """The matrix in the driver, for n small enough (n squared doubles); cells arrive as Arrow columns."""
    t = m.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).toArrow()
    a = np.zeros((n, n))
    np.add.at(a, (t.column(0).to_numpy(), t.column(1).to_numpy()), t.column(2).to_numpy())
    return (a + a.T) / 2


def top_eigenpairs(m: DataFrame, n: int, k: int, cfg: Spectral = Spectral(), folder: str | None = None) -> tuple[np.ndarray, DataFrame]:
    """The k wanted eigenvalues (cfg.which), descending, and their vectors as a table (idx, x array<double>).

    Up to cfg.driver_limit rows the matrix is solved exactly in the driver; beyond, by block Krylov iteration over
    written tables, whose cost a row doesn't grow. An empty matrix has no pairs.
    """
    spark = m.sparkSession
    k = max(0, min(k, n - 1))
    m = checked(m, n)
    if k and n > cfg.driver_limit:
        return block_krylov(m, n, k, folder or work_folder(spark, "eigen"), cfg.which, cfg.tol, cfg.steps, cfg.ncv, cfg.seed)
    values, vectors = np.linalg.eigh(dense(m, n)) if k else (np.empty(0), np.empty((n, 0)))
    order = chosen(values, k, cfg.which)
    table = pa.table({"idx": np.arange(n), "x": pa.array(list(signed(vectors[:, order])), pa.list_(pa.float64()))})
    return values[order], spark.createDataFrame(table)


def scaled(values: np.ndarray, vectors: DataFrame, method: str = "sqrt_evals") -> DataFrame:
    """(idx, embedding): the vectors, or each times the root of its value (none below zero)."""
    if method == "evecs":
        return vectors.select("idx", F.col("x").alias("embedding"))
    if method != "sqrt_evals":
        raise ValueError(f"unknown embedding method {method}")
    roots = F.array(*(F.lit(float(v)) for v in np.sqrt(np.maximum(values, 0)))) if len(values) else F.expr("cast(array() as array<double>)")
    return vectors.select("idx", F.zip_with("x", roots, lambda a, b: a * b).alias("embedding"))


def embeddings(m: DataFrame, vocab: DataFrame, cfg: Spectral = Spectral(), folder: str | None = None) -> DataFrame:
    """vocab with an embedding of each token, joined by index; an error where not every token gets one.

    With a folder, the processed matrix (if cfg.save_matrix), the eigenvalues and the facts of the run are written there.
    """
    n = vocab.count()
    own = prepared(m, cfg)
    values, vectors = top_eigenpairs(own, n, cfg.k, cfg, f"{folder}/eigen" if folder else None)
    if folder:
        if cfg.save_matrix:
            writers.matrix(own, f"{folder}/processed")
        spark = m.sparkSession
        spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "rank int, eigenvalue double").write.mode("overwrite").parquet(f"{folder}/eigenvalues")
        facts = {"n": n, "k": len(values), "which": cfg.which, "method": cfg.method, "threshold": cfg.threshold, "drop_diagonal": cfg.drop_diagonal, "symmetrize": cfg.symmetrize, "tol": cfg.tol, "seed": cfg.seed}
        writers.meta(spark, facts, f"{folder}/meta")
    out = vocab.join(scaled(values, vectors, cfg.method), "idx")
    got = vocab.select("idx").join(vectors.select("idx"), "idx").count()
    if got != n:
        raise ValueError(f"{got} of {n} tokens have a vector")
    return out
