"""Eigenpairs of a large sparse symmetric matrix by seeded block Krylov iteration, all of it in written tables.

The matrix is cut into blocks of WIDTH rows and columns; a tall matrix of vectors is a table of row blocks. A product is
a join of both by block and a sum by row block; inner products and rotations are done block by block, and only matrices
as small as the basis (a few hundred columns) reach the driver. Lost executors cost the tables of one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 4096
#: Partial sums of small matrices that the driver adds up.
FAN = 16
BLOCK = "b long, data binary"


def _array(raw: pa.Scalar, columns: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, columns)


class _Tall:
    """Tables of row blocks (b, data) in a folder of their own."""

    def __init__(self, spark: SparkSession, folder: str, n: int):
        self.spark, self.folder, self.n, self.count = spark, folder, n, 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/tall-{self.count}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def blocks(self) -> DataFrame:
        return self.spark.range(-(-self.n // WIDTH)).withColumnRenamed("id", "b")

    def mapped(self, df: DataFrame, columns: int, make) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    out = [make(_array(x, columns)).astype("<f8").tobytes() for x in batch.column("data")]
                    yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(out, pa.binary())], names=["b", "data"])

        return self.keep(df.mapInArrow(run, BLOCK))

    def start(self, columns: int, seed: int, kind: str) -> DataFrame:
        n = self.n

        def run(batches):
            for batch in batches:
                out = []
                for b in batch.column("b").to_pylist():
                    gen = np.random.Generator(np.random.PCG64((seed, b)))
                    shape = (min(WIDTH, n - b * WIDTH), columns)
                    out.append((gen.normal(size=shape) if kind == "normal" else gen.random(shape)).astype("<f8").tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(out, pa.binary())], names=["b", "data"])

        return self.keep(self.blocks().mapInArrow(run, BLOCK))

    def product(self, cells: DataFrame, x: DataFrame, columns: int) -> DataFrame:
        """The matrix (cells: r, c, ij, v) times x."""
        n = self.n

        def times(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    own = _array(batch.column("data")[k], columns)
                    rows, cols, v = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("rows", "<i4"), ("cols", "<i4"), ("v", "<f8")))
                    out = np.zeros((min(WIDTH, n - batch.column("r")[k].as_py() * WIDTH), columns))
                    # cells come by row, so that rows of the product are sums of runs
                    for lo in range(0, len(v), 1 << 16):
                        hi = min(lo + (1 << 16), len(v))
                        first = np.flatnonzero(np.concatenate([[True], rows[lo + 1 : hi] != rows[lo : hi - 1]]))
                        out[rows[lo:hi][first]] += np.add.reduceat(own[cols[lo:hi]] * v[lo:hi, None], first, axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column("r").slice(k, 1), batch.column("c").slice(k, 1), pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["b", "c", "data"]).select(["c", "b", "data"])

        def total(key, t):
            return pa.table({"b": pa.array([key[0].as_py()]), "c": pa.array([key[1].as_py()]), "data": pa.array([sum(np.frombuffer(x.as_buffer(), "<f8") for x in t.column("data")).tobytes()], pa.binary())})

        full = cells.join(x.withColumnRenamed("b", "c"), "c").select("r", "c", "rows", "cols", "v", "data").mapInArrow(times, f"c long, {BLOCK}")
        many = -(-n // WIDTH)
        while many > 1 or full.columns[0] == "c":
            full = full.select("b", F.floor(F.col("c") / FAN).alias("c"), "data").groupBy("b", "c").applyInArrow(total, f"b long, c long, {BLOCK[8:]}")
            many = -(-many // FAN)
        empty = self.blocks().join(self.keep(full.select("b", "data")), "b", "left")
        zero = F.when(F.col("b") == self.n // WIDTH, F.lit(self.n % WIDTH)).otherwise(WIDTH) * columns * 8
        return self.keep(empty.select("b", F.coalesce("data", F.unhex(F.repeat(F.lit("00"), zero.cast("int")))).alias("data")))

    def inner(self, x: DataFrame, p: int, y: DataFrame, q: int) -> np.ndarray:
        """x' y, summed by partition and then in the driver."""

        def run(batches):
            total = None
            for batch in batches:
                for k in range(batch.num_rows):
                    part = _array(batch.column("x")[k], p).T @ _array(batch.column("y")[k], q)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

        both = x.select("b", F.col("data").alias("x")).join(y.select("b", F.col("data").alias("y")), "b").coalesce(FAN)
        return sum((np.frombuffer(r[0]).reshape(p, q) for r in both.mapInArrow(run, "data binary").collect()), np.zeros((p, q)))

    def beside(self, x: DataFrame, p: int, y: DataFrame, q: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    out = [np.concatenate([_array(a, p), _array(b, q)], 1).tobytes() for a, b in zip(batch.column("x"), batch.column("y"))]
                    yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(out, pa.binary())], names=["b", "data"])

        both = x.select("b", F.col("data").alias("x")).join(y.select("b", F.col("data").alias("y")), "b")
        return self.keep(both.mapInArrow(run, BLOCK))

    def orthonormal(self, x: DataFrame, columns: int) -> tuple[DataFrame, int]:
        """An orthonormal basis of x's columns and its size; twice, as once loses digits. Columns near zero go."""
        for _ in range(2):
            gram = self.inner(x, columns, x, columns)
            size = np.sqrt(np.maximum(np.diag(gram), 0))
            own = np.flatnonzero(size > 1e-13 * max(size.max(), 1e-300))
            values, vectors = np.linalg.eigh(gram[np.ix_(own, own)] / size[own][:, None] / size[own][None, :])
            good = values > 1e-7
            turn = np.zeros((columns, int(good.sum())))
            turn[own] = vectors[:, good] / np.sqrt(values[good]) / size[own][:, None]
            x, columns = self.mapped(x, columns, lambda a, turn=turn: a @ turn), turn.shape[1]
        return x, columns


def _cells(m: DataFrame) -> DataFrame:
    """Blocks (r, c) of the matrix, cells by row."""

    def pack(key, t):
        t = t.combine_chunks()
        i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "v"))
        order = np.lexsort((j, i))
        i, j = (i[order] % WIDTH).astype("<i4"), (j[order] % WIDTH).astype("<i4")
        cols = [pa.array([x.tobytes()], pa.binary()) for x in (i, j, v[order].astype("<f8"))]
        return pa.table({"r": pa.array([key[0].as_py()]), "c": pa.array([key[1].as_py()]), "rows": cols[0], "cols": cols[1], "v": cols[2]})

    placed = m.groupBy("i", "j").agg(F.sum("v").alias("v")).select(F.floor(F.col("i") / WIDTH).alias("r"), F.floor(F.col("j") / WIDTH).alias("c"), "i", "j", "v")
    return placed.groupBy("r", "c").applyInArrow(pack, "r long, c long, rows binary, cols binary, v binary")


def chosen(values: np.ndarray, k: int, which: str) -> np.ndarray:
    """Places of the k wanted values: LA largest, SA smallest, LM largest in size; then in descending order."""
    order = {"LA": -values, "SA": values, "LM": -np.abs(values)}
    if which not in order:
        raise ValueError(f"unknown selector {which}")
    best = np.argsort(order[which], kind="stable")[:k]
    return best[np.argsort(-values[best], kind="stable")]


def block_krylov(m: DataFrame, n: int, k: int, folder: str, which: str = "LA", tol: float = 1e-6, steps: int = 30, ncv: int | None = None, seed: int = 0, start: str = "normal") -> tuple[np.ndarray, DataFrame]:
    """The k wanted eigenvalues of the symmetric matrix m (i, j, v) and their vectors as a table (idx, x array<double>).

    ncv: columns of the basis at a restart (default: 2 k + 16, at most n). Stops when every wanted pair's residual is
    below tol times the largest value in size, or after so many steps.
    """
    spark = m.sparkSession
    tall = _Tall(spark, folder, n)
    cells = tall.keep(_cells(m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))))
    width = min(n, ncv or 2 * k + 16)
    x, size = tall.orthonormal(tall.start(width, seed, start), width)
    values = np.empty(0)
    for _ in range(steps):
        ax = tall.product(cells, x, size)
        # the new directions are residuals, which stand at right angles to x
        inside, p = tall.inner(x, size, ax, size), size
        residual = lambda a, p=p, inside=inside: np.concatenate([a[:, :p], a[:, p:] - a[:, :p] @ inside], 1)
        both, total = tall.orthonormal(tall.mapped(tall.beside(x, size, ax, size), 2 * size, residual), 2 * size)
        ab = tall.product(cells, both, total)
        small = tall.inner(both, total, ab, total)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = chosen(values, min(k, total), which)
        rest = chosen(values, min(width, total), which)
        rest = np.concatenate([best, np.setdiff1d(rest, best, assume_unique=True)])
        values = values[rest]
        turn = turn[:, rest]
        x = tall.mapped(both, total, lambda a, turn=turn: a @ turn)
        ax = tall.mapped(ab, total, lambda a, turn=turn: a @ turn)
        size = len(rest)
        # |A x - l x|^2 = x'A'A x - l^2 for orthonormal x
        left = np.sqrt(np.maximum(np.diag(tall.inner(ax, size, ax, size)) - values**2, 0))
        if (left[: len(best)] <= max(tol, 1e-8) * max(np.abs(values).max(), 1e-300)).all():
            break

    k = min(k, size)
    columns = size

    def rows(batches):
        for batch in batches:
            for b, data in zip(batch.column("b").to_pylist(), batch.column("data")):
                own = _array(data, columns)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(b * WIDTH + np.arange(len(own))), pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(own).ravel()))], names=["idx", "x"])

    return values[:k], x.mapInArrow(rows, "idx long, x array<double>")
