"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text (shape of its bytes, words and lines, and how much repeats) are standardised and mapped
by random Fourier features, which approximate a Gaussian kernel. Ridge weights come from normal equations summed within
partitions and then in a tree of bounded fan-in, so neither a task nor the driver sees more than FAN matrices. Isotonic
regression over score bins turns ridge scores into probabilities; it is fitted on labelled rows that the ridge weights
have not seen (one in CALIBRATION by a hash), and between the middles of its steps the score is linear.

Only the text is an input of a score. Rows: null and empty texts have all statistics 0 and get a score. Labels that are
null, or of documents not there, are ignored; several labels of a document are averaged. Without any usable label every
score is 0.5. Repeated rows get equal scores; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import keep, small_batches, table, work_folder

FEATURES = 384
RIDGE = 1e-2
GAMMA = 0.25
BINS = 2048
#: One labelled row in so many calibrates; the others teach.
CALIBRATION = 4
#: Partial sums that one task or the driver adds up.
FAN = 32
SYMBOLS = b"*$#%&@^~=+<>_{}[]\\/"


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = [_mask(x) for x in (bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t", b"\n", b"|", b"!?", SYMBOLS, b".", b",;:", b"\"'()-")]
_SYMBOL_END = _mask(SYMBOLS + b"!|")
_LETTER = _mask(bytes(range(97, 123))) | (np.arange(256) >= 128)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, statistics) of texts given as bytes end to end and their offsets."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    some = np.maximum(size, 1)

    def per_doc(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offs]).astype(float)

    cols = [np.log1p(size)]
    cols += [per_doc(c[data]) / some for c in _CLASSES]
    # upper case beyond ASCII: the second bytes 0x80 to 0x9E after 0xC3
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    cols += [per_doc(wide) / some, per_doc(data >= 0xC0) / some]
    starts, ends, doc = K.words(data, offs)
    count = np.bincount(doc, minlength=n).astype(float)
    m = np.maximum(count, 1)
    mean = lambda x: np.bincount(doc, weights=x, minlength=n) / m
    length = (ends - starts).astype(float)
    wh = K.spans(data, starts, ends)
    lower = np.concatenate([[0], np.cumsum(_LETTER[data] & ~wide)])
    upper = np.concatenate([[0], np.cumsum(_CLASSES[0][data] | wide)])
    ups, lows = upper[ends] - upper[starts], lower[ends] - lower[starts]
    cols += [np.log1p(count), mean(length) / 10, np.sqrt(mean(length**2)) / 20, mean((ups > 1) & (ups >= lows)), mean(_SYMBOL_END[data[ends - 1]] if len(ends) else length), mean(length == 1), mean(ups == 1)]
    for gap in (1, 2, 3):
        same = np.zeros(len(wh))
        if len(wh) > gap:
            same[gap:] = (wh[gap:] == wh[:-gap]) & (doc[gap:] == doc[:-gap])
        cols.append(mean(same))
    for width in (1, 2, 4):
        h = wh.copy() if width == 1 else np.zeros(max(len(wh) - width + 1, 0), np.uint64)
        if width > 1:
            for k in range(width if len(h) else 0):
                h = K.mix(h * np.uint64(0xD6E8FEB86659FD93) + wh[k : k + len(h)])
        own = doc[: len(h)]
        h = K.mix(h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if width > 1:
            ok = own == doc[width - 1 :] if len(h) else np.empty(0, bool)
            h, own = h[ok], own[ok]
        distinct = np.bincount(own[np.unique(h, return_index=True)[1]], minlength=n) if len(h) else np.zeros(n)
        total = np.bincount(own, minlength=n) if len(h) else np.zeros(n)
        cols.append(np.where(total > 0, 1 - distinct / np.maximum(total, 1), 0))
    # lines
    feed = data == 10
    cut = np.unique(np.concatenate([offs[:-1], np.flatnonzero(feed) + 1]))
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    ld = np.searchsorted(offs, cut, "right") - 1
    lines = np.bincount(ld, minlength=n).astype(float)
    lm = np.maximum(lines, 1)
    lh = K.mix(K.spans(data, cut, stop) + ld.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    kinds = np.bincount(ld[np.unique(lh, return_index=True)[1]], minlength=n) if len(cut) else np.zeros(n)
    symbols = np.concatenate([[0], np.cumsum((_CLASSES[5] | _CLASSES[7])[data] | (data == 33))])
    dirty = (symbols[stop] - symbols[cut]) > 0.04 * (stop - cut)
    loud = (upper[stop] - upper[cut]) > 0.4 * (stop - cut)
    bad = (dirty | loud).astype(float)
    share = np.bincount(ld, weights=bad * (stop - cut), minlength=n) / some
    cols += [np.log1p(lines), np.log1p(size / lm), np.where(lines > 0, 1 - kinds / lm, 0), np.bincount(ld, weights=bad, minlength=n) / lm, share]
    return np.stack(cols, 1).astype(np.float32)


N_STATS = 32


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(float)


def measure(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and stats (float32 vector as bytes) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch, data, offs in K.slices(batches, text):
            stats = statistics(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), K.binary_column([x.tobytes() for x in stats])], names=[doc_id, "stats"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, stats binary")


def _summed(df: DataFrame, row, width: int, folder: str, name: str) -> np.ndarray:
    """The sum over all rows of a vector that row(batch) gives for a batch: by partition, then in a tree."""

    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = row(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), K.binary_column([total.tobytes()])], names=["part", "sum"])

    def group(key, t):
        return pa.table({"part": pa.array([key[0].as_py()]), "sum": K.binary_column([sum(np.frombuffer(x.as_buffer()) for x in t.column("sum")).tobytes()])})

    parts, level = keep(df.mapInArrow(part, "part long, sum binary"), folder, f"{name}-0"), 0
    while parts.count() > FAN:
        level += 1
        above = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        parts = keep(above.groupBy("part").applyInArrow(group, "part long, sum binary"), folder, f"{name}-{level}")
    # in order, so that reruns add up alike
    return sum((np.frombuffer(r[0]) for r in parts.orderBy("part").select("sum").collect()), np.zeros(width))


class Model:
    def __init__(self, mean, scale, omega, phase, weights, edges, levels):
        self.mean, self.scale, self.omega, self.phase, self.weights, self.edges, self.levels = mean, scale, omega, phase, weights, edges, levels

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.mapped(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order; returns the middle of each pool and its level."""
    pools: list[list[float]] = []
    for a, t, c in zip(x, total, count):
        pools.append([a * c, t, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame, folder: str, seed: int = 11) -> Model:
    """rows: stats, y (0 to 1) and calibrates (kept from the ridge weights)."""
    d = N_STATS
    teach = rows.where(~F.col("calibrates"))

    def moments(batch):
        x = _matrix(batch.column("stats"))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = _summed(teach, moments, 1 + 2 * d, folder, "moments")
    n = total[0]
    rng = np.random.Generator(np.random.PCG64(seed))
    omega = rng.normal(0, np.sqrt(2 * GAMMA / d), (d, FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    if n == 0:
        return Model(np.zeros(d), np.ones(d), omega, phase, None, None, None)
    mean = total[1 : 1 + d] / n
    model = Model(mean, np.sqrt(np.maximum(total[1 + d :] / n - mean**2, 0)) + 1e-3, omega, phase, None, None, None)
    width = FEATURES + 1
    upper = np.triu_indices(width)

    def normal(batch):
        z, y = model.mapped(_matrix(batch.column("stats"))), batch.column("y").to_numpy()
        return np.concatenate([(z.T @ z)[upper], z.T @ y])

    total = _summed(teach, normal, len(upper[0]) + width, folder, "normal")
    gram = np.zeros((width, width))
    gram[upper] = total[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T + RIDGE * np.eye(width)
    model.weights = np.linalg.solve(gram, total[len(upper[0]) :])

    def bins(batch):
        raw, y = model.raw(_matrix(batch.column("stats"))), batch.column("y").to_numpy()
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    count, hits, raws = _summed(rows.where("calibrates"), bins, 3 * BINS, folder, "bins").reshape(3, BINS)
    full = count > 0
    if full.any():
        model.edges, model.levels = isotonic(raws[full] / count[full], hits[full], count[full])
    else:
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _taught(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(doc_id, y, calibrates) of usable labels, one row a document."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    return usable.groupBy(doc_id).agg(F.avg(label).alias("y")).withColumn("calibrates", F.pmod(F.xxhash64(doc_id), F.lit(CALIBRATION)) == 0)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train=None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs. train(column of doc_id): which rows may teach."""
    folder = work_folder(docs.sparkSession)
    held = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 3 == 1
    train = train or (lambda c: ~held(c))
    stats = keep(measure(docs, doc_id, text), folder, "stats")
    rows = keep(stats.join(_taught(labels.where(train(F.col(doc_id))), doc_id, label), doc_id).select("stats", "y", "calibrates"), folder, "taught")
    model = fit(rows, folder)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(model.score(_matrix(batch.column("stats"))))], names=[doc_id, "score"])

    scored = stats.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double")
    return scored.select(doc_id, held(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns; learns from all labels."""
    folder = work_folder(docs.sparkSession)
    taught = _taught(labels, doc_id, label)
    stats = measure(docs.select(doc_id, text).join(taught.select(doc_id), doc_id, "left_semi"), doc_id, text)
    model = fit(keep(keep(stats, folder, "stats").join(taught, doc_id).select("stats", "y", "calibrates"), folder, "taught"), folder)

    def run(batches):
        for batch, data, offs in K.slices(batches, text):
            yield batch.filter(pa.array(model.score(statistics(data, offs).astype(float)) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
