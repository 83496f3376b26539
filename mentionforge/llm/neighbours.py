"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform, parts the coordinates among
polytopes and assigns a vector to the nearest signed axis of each; a cell is one axis of every polytope. Polytopes are
added as the base grows, so cells grow with the rows. A query looks into the cells whose axes are nearest to it
(multiprobe), a share of all cells that falls as the base grows, and ranks all vectors there by the exact inner product
on the original vectors. Runs of cells are cut into blocks of bounded size on both sides, so a hot cell spreads over
tasks. Every score is one fixed summation, so a pair has the same score in all tables and ties are true ties.

The index holds every row, by direction. A long vector can rank among the k best at a cosine where cells seldom meet. So
base vectors are parted into bands of norm, four to a doubling; a band above the median's is scanned exactly, in blocks,
by each query whose k-th score it could beat at a cosine below the least that the index finds with a chance of SURE.

Recall is an expectation (README has figures, tests hold it against brute force, also for unequal norms). A query for
which the probed cells hold fewer than k candidates is answered by an exact scan in blocks, so each gets k (all
candidates, if fewer).

Rows: vectors that are null, empty or zero or hold null or non-finite components, and rows without vec_id, take no part.
Vectors of another width than the query's are no candidates. Ties go to the smaller vec_id. Of repeated rows of one
vec_id the one with the larger score counts, once. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, small_batches, table, work_folder
from .vectors import by_width, dense, matrix

TABLES, BLOCK = 14, 16384
#: Runs that the cells of a table are cut into; a block is of one run.
RUNS = 16
#: Share of the cells that a query probes where the base has SIZE rows; it falls with the power FALL of the rows.
SHARE, SIZE, FALL = 0.05, 2000, 0.3
#: Cells looked at, at most, to choose a query's probes, and rows a cell, about, beyond which a polytope is added.
CHOICES, CROWD = 1 << 16, 16
#: Bands of norm to a doubling, and the chance from which on a cosine is left to the index.
BANDS, SURE = 4, 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.Generator(np.random.PCG64((seed, number, width))).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Shape(NamedTuple):
    """Polytopes of a table, signed axes of each, probed cells, and runs that the cells are cut into."""

    polytopes: int
    axes: int
    probes: int
    runs: int

    @property
    def cells(self) -> int:
        return self.axes**self.polytopes


def shape_for(width: int, rows: int) -> Shape:
    turned_width, n = 1 << max(1, (width - 1).bit_length()), 2 if width > 2 else 1
    axes = lambda k: 2 * (turned_width // k)
    while axes(n) ** n * CROWD < rows and axes(n + 1) > 2 and axes(n + 1) ** (n + 1) > axes(n) ** n:
        n += 1
    cells = axes(n) ** n
    share = min(1.0, SHARE * (SIZE / max(rows, 1)) ** FALL)
    return Shape(n, axes(n), min(max(1, round(share * cells)), _choices(n, axes(n)) ** n), min(cells, RUNS))


def _choices(polytopes: int, axes: int) -> int:
    """Nearest axes of each polytope among which probes are chosen."""
    return min(axes, int(CHOICES ** (1 / polytopes) + 1e-9))


def _sides(y: np.ndarray, shape: Shape):
    """For each polytope, the vectors' products with its signed axes."""
    half = shape.axes // 2
    for k in range(shape.polytopes):
        z = y[:, k * half : (k + 1) * half]
        yield np.concatenate([z, -z], 1)


def cell_of(y: np.ndarray, shape: Shape) -> np.ndarray:
    """The cell of each turned vector."""
    code = np.zeros(len(y), np.int64)
    for side in _sides(y, shape):
        code = code * shape.axes + side.argmax(1)
    return code


def probed(y: np.ndarray, shape: Shape) -> np.ndarray:
    """The cells that each turned vector is nearest to, by the squares of what its coordinates fall short by."""
    few = _choices(shape.polytopes, shape.axes)
    code, short = np.zeros((len(y), 1), np.int64), np.zeros((len(y), 1))
    for side in _sides(y, shape):
        near = np.argpartition(-side, few - 1, 1)[:, :few]
        away = (side.max(1, keepdims=True) - np.take_along_axis(side, near, 1)) ** 2
        code = (code[:, :, None] * shape.axes + near[:, None, :]).reshape(len(y), -1)
        short = (short[:, :, None] + away[:, None, :]).reshape(len(y), -1)
    best = np.argpartition(short, shape.probes - 1, 1)[:, : shape.probes]
    return np.take_along_axis(code, best, 1)


@lru_cache
def least_cosine(width: int, shape: Shape, tables: int, seed: int) -> float:
    """The least cosine, to 1/64, at which a vector lies in a probed cell with a chance of SURE, from 500 random pairs."""
    rng = np.random.default_rng(seed)
    a, b = _unit(rng.normal(size=(500, width))), rng.normal(size=(500, width))
    b = b - (a * b).sum(1, keepdims=True) * a
    b = b / np.maximum(np.sqrt((b * b).sum(1, keepdims=True)), 1e-12)
    asked = [probed(turned(a, t, seed), shape) for t in range(tables)]
    lo, hi = 0.0, 1.0
    while hi - lo > 1 / 64:
        c = (lo + hi) / 2
        met = np.zeros(len(a), bool)
        for t in range(tables):
            met |= (asked[t] == cell_of(turned(c * a + np.sqrt(1 - c * c) * b, t, seed), shape)[:, None]).any(1)
        lo, hi = (lo, c) if met.mean() >= SURE else (c, hi)
    return hi


CELLS = "vec_id long, embedding array<double>, width int, tab int, cell int, codes array<long>"


def _cells(df: DataFrame, shapes: dict[int, Shape], asks: bool, tables: int, seed: int) -> DataFrame:
    """A row for each vector, table and run of cells (cell) that holds its cell, or any that it asks for, with these."""

    def run(batches):
        for batch in batches:
            for idx in by_width(batch.column("embedding")):
                x = matrix(batch.column("embedding"), idx)
                shape = shapes.get(x.shape[1])
                if shape is None:
                    continue
                unit = _unit(x)
                for t in range(tables):
                    y = turned(unit, t, seed)
                    code = probed(y, shape) if asks else cell_of(y, shape)[:, None]
                    code.sort(1)
                    run_of = code * shape.runs // shape.cells
                    new = np.ones(code.shape, bool)
                    new[:, 1:] = run_of[:, 1:] != run_of[:, :-1]
                    first = np.flatnonzero(new.ravel())
                    rows = pa.array(idx[first // code.shape[1]])
                    n = len(first)
                    for lo in range(0, n, 4096):
                        part = slice(lo, min(lo + 4096, n))
                        ends = np.append(first, code.size)[lo : part.stop + 1]
                        codes = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(code.ravel()[ends[0] : ends[-1]]))
                        own = rows.slice(lo, part.stop - lo)
                        same = lambda v, m=part.stop - lo: pa.array(np.full(m, v, np.int32))
                        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(own), batch.column("embedding").take(own), same(x.shape[1]), same(t), pa.array(run_of.ravel()[first[part]].astype(np.int32)), codes], names=[c.split()[0] for c in CELLS.split(", ")])

    return df.select("vec_id", "embedding").mapInArrow(run, CELLS)


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows x[i] and y[j], each by the same summation wherever the pair stands."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 4096):
        part = slice(lo, lo + 4096)
        out[part] = (x[i[part]] * y[j[part]]).sum(1)
    return out


def _candidates(codes: pa.ListArray, base_codes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and base rows whose cells meet. Base rows have one code each."""
    code = base_codes.flatten().to_numpy()
    order = np.argsort(code, kind="stable")
    kinds, first = np.unique(code[order], return_index=True)
    size = np.diff(np.append(first, len(code)))
    asked = codes.flatten().to_numpy()
    query = np.repeat(np.arange(len(codes)), np.diff(np.asarray(codes.offsets)))
    at = np.minimum(np.searchsorted(kinds, asked), len(kinds) - 1)
    hit = kinds[at] == asked
    at, query = at[hit], query[hit]
    per = size[at]
    ends = np.cumsum(per)
    j = order[np.repeat(first[at] - (ends - per), per) + np.arange(ends[-1] if len(ends) else 0)]
    return np.repeat(query, per), j


def _leading(i: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k largest s of their i, ties with the k-th included. i is in order."""
    order = np.argsort(-s)
    order = order[np.argsort(i[order].astype(np.uint16 if len(i) and i[-1] < 1 << 16 else i.dtype), kind="stable")]
    first = np.searchsorted(i, i)
    nth = np.minimum(first + k, np.searchsorted(i, i, "right")) - 1
    return order[s[order] >= s[order[nth]]]


def _ranked(k: int):
    """The k best of a block's base vectors for each of its queries: those in its cells, or all where it has no codes."""

    def run(key, t):
        t = t.combine_chunks()
        query, ids = t.column("query").to_numpy(zero_copy_only=False), t.column("vec_id").to_numpy()
        q, b = np.flatnonzero(query), np.flatnonzero(~query)
        q_out, b_out, s_out = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
        if len(q) and len(b):
            x, y = matrix(t.column("embedding"), q), matrix(t.column("embedding"), b)
            codes = t.column("codes").combine_chunks()
            if codes.null_count:
                # blocked products choose with a margin for rounding; what counts is computed below
                score = x @ y.T
                score[ids[q][:, None] == ids[b][None, :]] = -np.inf
                n = min(k, len(b))
                floor = np.partition(score, len(b) - n, 1)[:, len(b) - n]
                slack = 1e-12 * np.sqrt((x * x).sum(1) * (y * y).sum(1).max())
                i, j = np.nonzero((score >= (floor - slack)[:, None]) & (score > -np.inf))
            else:
                i, j = _candidates(codes.take(pa.array(q)), codes.take(pa.array(b)))
                own = ids[q][i] == ids[b][j]
                i, j = i[~own], j[~own]
            s = _products(x, y, i, j)
            rows = _leading(i, s, k)
            i, j, s = i[rows], j[rows], s[rows]
            order = np.lexsort((ids[b][j], -s, i))
            i, j, s = i[order], j[order], s[order]
            ok = np.arange(len(i)) - np.searchsorted(i, i) < k
            q_out.append(ids[q][i[ok]])
            b_out.append(ids[b][j[ok]])
            s_out.append(s[ok])
        return pa.table({"query_id": np.concatenate(q_out), "vec_id": np.concatenate(b_out), "score": np.concatenate(s_out)})

    return run


def _search(base: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Best candidates of each query in its cells (width, tab, cell), block by block."""
    cell = ["width", "tab", "cell"]
    counts = base.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).join(query.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq")), cell)
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    b = base.join(counts, cell).withColumn("b", mine(F.col("nb"))).withColumn("q", each(F.col("nq"))).withColumn("query", F.lit(False))
    q = query.join(counts, cell).withColumn("q", mine(F.col("nq"))).withColumn("b", each(F.col("nb"))).withColumn("query", F.lit(True))
    return b.unionByName(q).groupBy(*cell, "q", "b").applyInArrow(_ranked(k), "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from candidates that may come from several tables."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _long(base: DataFrame, queries: DataFrame, first: DataFrame, k: int, tables: int, shapes: dict[int, Shape], seed: int) -> tuple[DataFrame, DataFrame] | None:
    """Base vectors of bands above the median's, and the queries that must scan them, with the band as cell; or None."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    form = lambda df, cell: df.select("vec_id", "embedding", "width", F.lit(-2).alias("tab"), cell.cast("int").alias("cell"), F.lit(None).cast("array<long>").alias("codes"))
    band = F.floor(BANDS * F.log2(norm) + 1e-6)
    banded = form(base.withColumn("width", F.size("embedding")), band)
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in banded.groupBy("width", "cell").count().collect():
        sizes.setdefault(r["width"], []).append((r["cell"], r["count"]))
    rows = []
    for width, counts in sizes.items():
        total, seen = sum(n for _, n in counts), 0
        for b, n in sorted(counts):
            if 2 * seen >= total:
                # at this score over the query's norm and below, a vector of the band may lie where the index doesn't find it
                rows.append((width, b, least_cosine(width, shapes[width], tables, seed) * 2.0 ** ((b + 1) / BANDS)))
            seen += n
    if not rows:
        return None
    high = queries.sparkSession.createDataFrame(rows, "w int, cell int, reach double")
    last = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("last"))
    asked = queries.join(last, F.col("vec_id") == F.col("query_id")).withColumn("width", F.size("embedding"))
    asked = asked.join(high, (F.col("width") == F.col("w")) & (F.col("last") < F.col("reach") * norm))
    return banded, form(asked, F.col("cell"))


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, seed: int = 17) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of base for each query (both: vec_id, embedding)."""
    spark = base.sparkSession
    small_batches(spark)
    folder = work_folder(spark)
    take = lambda df: dense(df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding")
    base, queries = take(base), take(queries)
    # one row a width of vector
    shapes = {r["w"]: shape_for(r["w"], r["count"]) for r in base.groupBy(F.size("embedding").alias("w")).count().collect()}
    held = keep(_cells(base, shapes, False, tables, seed), folder, "base")
    asked = keep(_cells(queries, shapes, True, tables, seed), folder, "queries")
    first = keep(_best(_search(held, asked, k), k), folder, "found")
    long = _long(base, queries, first, k, tables, shapes, seed)
    if long is not None:
        first = keep(_best(first.select("query_id", "vec_id", "score").union(_search(*long, k)), k), folder, "both")
    # queries with too few candidates are compared with everything
    few = queries.select("vec_id").distinct().join(first.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").where(F.coalesce("count", F.lit(0)) < k).select("vec_id")
    few = keep(few, folder, "few")
    if few.isEmpty():
        return first
    flat = lambda df: df.withColumns({"width": F.size("embedding"), "tab": F.lit(-1), "cell": F.lit(0), "codes": F.lit(None).cast("array<long>")}).select("vec_id", "embedding", "width", "tab", "cell", "codes")
    rest = _best(_search(flat(base), flat(queries.join(few, "vec_id")), k), k)
    return first.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(rest)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
