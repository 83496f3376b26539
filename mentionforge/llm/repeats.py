"""Repeated strings of documents, by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes over it also starts earlier: in a document of smaller doc_id, or earlier in
the same document. Strings are judged on the input; matches never cross documents.

1. Documents, ordered by doc_id, are packed into chunks of a few MB in the shared folder. A chunk's number follows the
   order of documents, so "earlier" is a matter of chunk and place.
2. Cover sample: suffixes that start at places whose residue modulo 73 is in a perfect difference set. Any two places
   have a common shift below 73 to sampled places, so two equal strings of 100 bytes hold equal sampled strings of 28.
   Sampled suffixes are named (64-bit fingerprints of their 28 bytes) in blocks of name ranges, and a name that occurs
   once rules out every place that reaches the sample through it. Accidents here only let more places through.
3. The suffixes left are sorted bucket by bucket (`passes` buckets of name ranges, one after another, each bucket in
   blocks of bounded size); a long tie is one name, never a comparison of texts. Chunks send every name once, so a
   passage that all documents share weighs no more than the number of chunks, and what comes back is a bit for each
   name: whether an earlier chunk has it.

Order within a bucket is that of names and not of bytes: only equality matters here. The names that decide are 128-bit
fingerprints of the whole strings, so with m suffixes left an accidental match has a chance of m*m/2^129.

Rows: a null text is empty; texts shorter than `length` keep all. Rows of equal doc_id are separate documents, taken in
the order of their texts, so repeated rows lose all but the first. A null doc_id comes before all others. Extra columns
are ignored; an empty table gives an empty table. Texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import free_shuffles, keep, partitions, small_batches, table, work_folder

#: A perfect difference set: every residue modulo 73 is the difference of two members. Fixed values.
PERIOD, COVER = 73, (1, 2, 4, 8, 16, 32, 37, 55, 64)
CHUNK = 2 << 20
#: Names in a block of the sort, which bounds the memory of its task.
BLOCK = 1_000_000
#: Bytes of names handed on at a time.
SENT = 8 << 20


def _chunks(docs: DataFrame, folder: str) -> DataFrame:
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch, data, offs in K.slices(batches, "text", CHUNK):
            ids = pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), ids, pa.array([offs[1:].tolist()], pa.list_(pa.int64())), K.binary_column([data.tobytes()])], names=["chunk", "ids", "ends", "data"])
            seq += 1

    ordered = docs.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return keep(ordered.mapInArrow(run, "chunk long, ids array<long>, ends array<long>, data binary"), folder, "chunks")


def _array(column: pa.Array, i: int) -> np.ndarray:
    value = column[i].values
    return value.to_numpy(zero_copy_only=False) if value is not None else np.empty(0, np.int64)


Names = tuple[np.ndarray, np.ndarray | None]
#: The least name and that after the last (None: no end).
Range = tuple[np.uint64, np.uint64 | None]


def _cover(data: np.ndarray, ends: np.ndarray, gram: int, within: Range | None = None) -> tuple[np.ndarray, Names]:
    """Sampled places of a chunk and the names of their suffixes (one half), or those within a range of names."""
    starts = np.concatenate([[0], ends[:-1]])
    room = ends - starts - gram
    parts = []
    for r in COVER:
        per = np.maximum((room - r) // PERIOD + 1, 0)
        offs = np.concatenate([[0], np.cumsum(per)])
        parts.append(np.repeat(starts + r - PERIOD * offs[:-1], per) + PERIOD * np.arange(offs[-1]))
    at = np.sort(np.concatenate(parts))
    names = K.windows(K.lanes(data), gram, at) if len(at) else np.empty(0, np.uint64)
    if within:
        own = _inside(names, within)
        at, names = at[own], names[own]
    return at, (names, None)


def _suffixes(data: np.ndarray, lens: np.ndarray, length: int, within: Range | None = None) -> tuple[np.ndarray, Names]:
    """Starts, in the packed segments, of all strings of `length` bytes, and their names (both halves), or those within
    a range of names."""
    if not len(data):
        return np.empty(0, np.int64), (np.empty(0, np.uint64), np.empty(0, np.uint64))
    # all places but those from which a string would go on into the next segment
    own = np.ones(len(data) - length + 1, bool)
    own[(np.cumsum(lens)[:-1, None] - np.arange(1, length)).ravel()] = False
    lane = K.lanes(data)
    hi = K.every_window(lane, length, 0)[: len(own)]
    if within:
        own &= _inside(hi, within)
    at = np.flatnonzero(own)
    return at, (hi[at], K.every_window(lane, length, 1)[at])


def _inside(names: np.ndarray, within: Range) -> np.ndarray:
    least, most = within
    own = names >= least
    if most is not None:
        own &= names < most
    return own


def _edges(lo: int, hi: int, blocks: int) -> np.ndarray:
    """First names of the blocks from lo to hi, of `blocks` equal ranges of all names."""
    return np.array([(b << 64) // blocks for b in range(lo, hi)], np.uint64)


def _ranked(source: DataFrame, names_of, wide: bool, blocks: int, passes: int, earlier: bool, folder: str, name: str) -> DataFrame:
    """(chunk, bits array<struct<block, bits>>): for each distinct name of a chunk, in order, whether another chunk has
    it (earlier=False) or an earlier chunk has it (earlier=True). wide: names have both halves."""
    spark = source.sparkSession

    def judge(key, group):
        chunk = group.column("chunk").to_numpy()
        turn = np.argsort(chunk)
        raw, offs = K.text_buffers(group.column("names").combine_chunks().take(pa.array(turn)))
        own = raw.view("<u8")
        hi, lo = (np.ascontiguousarray(own[0::2]), np.ascontiguousarray(own[1::2])) if wide else (own, None)
        size = np.diff(offs) // (16 if wide else 8)
        order, first = K.ordered(hi, lo)
        # a chunk sends a name once, and chunks are in turn
        bits = np.ones(len(order), bool)
        bits[order[first if earlier else first[np.diff(np.append(first, len(order))) == 1]]] = False
        # each chunk's bits begin with a byte of their own
        room = -(-size // 8)
        at = np.concatenate([[0], np.cumsum(room)])
        spread = np.zeros(8 * at[-1], bool)
        spread[K.ranges(8 * at[:-1], size)] = bits
        return pa.table({"chunk": pa.array(chunk[turn]), "block": pa.array(np.full(len(size), key[0].as_py(), np.int32)), "bits": K.binary_slices(np.packbits(spread), at)})

    for k in range(passes):
        lo_block, hi_block = blocks * k // passes, blocks * (k + 1) // passes
        if lo_block == hi_block:
            continue

        def send(batches, lo_block=lo_block, hi_block=hi_block):
            edges = _edges(lo_block, hi_block, blocks)
            within = edges[0], _edges(hi_block, hi_block + 1, blocks)[0] if hi_block < blocks else None
            for batch in batches:
                for i in range(batch.num_rows):
                    hi, lo = names_of(batch, i, within)[1]
                    if wide:
                        order, first = K.ordered(hi, lo)
                        hi, lo = hi[order[first]], lo[order[first]]
                    else:
                        hi = np.sort(hi)
                        hi = hi[np.append(True, hi[1:] != hi[:-1])[: len(hi)]]
                    cut = np.append(np.searchsorted(hi, edges), len(hi))
                    full = np.flatnonzero(np.diff(cut))
                    own = np.stack([hi, lo], 1) if wide else hi[:, None]
                    # blocks are runs of the names in order; some MB of them at a time, one block at least
                    group = cut[full] * own.shape[1] * 8 // SENT
                    for part in np.split(full, np.flatnonzero(np.diff(group)) + 1) if len(full) else ():
                        ends = cut[np.append(part, part[-1] + 1)]
                        raw = own[ends[0] : ends[-1]].astype("<u8", copy=False).ravel()
                        names = K.binary_slices(raw, (ends - ends[0]) * own.shape[1] * 8)
                        yield pa.RecordBatch.from_arrays([pa.array((lo_block + part).astype(np.int32)), pa.array(np.full(len(part), batch.column("chunk")[i].as_py(), np.int64)), names], names=["block", "chunk", "names"])

        sent = source.mapInArrow(send, "block int, chunk long, names binary")
        keep(sent.groupBy("block").applyInArrow(judge, "chunk long, block int, bits binary"), folder, name, "append")
        del sent
        free_shuffles(spark)
    read = spark.read.schema("chunk long, block int, bits binary").parquet(f"{folder}/{name}")
    return read.groupBy("chunk").agg(F.collect_list(F.struct("block", "bits")).alias("bits"))


def _kinds(names: Names, edges: np.ndarray, bits: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of a chunk's names, equal ones by place; where in it the distinct ones start; and the bit of each, from
    those of its blocks, which start at `edges`."""
    order, first = K.ordered(*names)
    kinds = names[0][order[first]]
    cut = np.append(np.searchsorted(kinds, edges), len(kinds))
    bit = np.zeros(len(kinds), bool)
    if bits is not None:
        block = bits.field("block").to_numpy(zero_copy_only=False)
        raw, offs = K.text_buffers(bits.field("bits"))
        size = cut[block + 1] - cut[block]
        bit[K.ranges(cut[block], size)] = np.unpackbits(raw)[K.ranges(8 * offs[:-1], size)]
    return order, first, bit


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def repeats(docs: DataFrame, length: int = 100, passes: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array of start and end of maximal removed runs, in bytes) and kept (the bytes left)."""
    gram = length - PERIOD + 1
    if gram < 8:
        raise ValueError("length must be 80 at least")
    spark = docs.sparkSession
    small_batches(spark)
    folder = work_folder(spark)
    chunks = _chunks(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), folder)
    free_shuffles(spark)
    total = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    cover_blocks = max(1, passes, -(-total * len(COVER) // PERIOD // BLOCK))

    def cover(batch, i, within=None):
        return _cover(np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), _array(batch.column("ends"), i), gram, within)

    shared = _ranked(chunks.select("chunk", "ends", "data"), cover, False, cover_blocks, passes, False, folder, "shared")

    def survivors(batches):
        edges = _edges(0, cover_blocks, cover_blocks)
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), _array(batch.column("ends"), i)
                at, names = _cover(data, ends, gram)
                order, first, other = _kinds(names, edges, batch.column("bits")[i].values)
                alone = np.diff(np.append(first, len(order))) == 1
                again = np.ones(len(order), bool)
                again[order[first[alone & ~other]]] = False
                reach = np.zeros(len(data) + PERIOD + 1, np.int32)
                reach[at[again] + 1] = 1
                reach = np.cumsum(reach, dtype=np.int32)
                left = reach[PERIOD : PERIOD + len(data)] > reach[: len(data)]
                # no string of the full length starts in a document's last bytes
                begins = np.concatenate([[0], ends[:-1]])
                tail = ends[:, None] - np.arange(1, length)
                left[tail[tail >= begins[:, None]]] = False
                lo, hi = _runs(left)
                if len(lo):
                    size = hi - lo + length - 1
                    body = np.concatenate([data[a:b] for a, b in zip(lo.tolist(), (lo + size).tolist())])
                    yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([lo.tolist()], pa.list_(pa.int64())), pa.array([size.tolist()], pa.list_(pa.int64())), K.binary_column([body.tobytes()])], names=["chunk", "starts", "lens", "data"])

    parts = chunks.select("chunk", "ends", "data").join(shared.hint("shuffle_hash"), "chunk", "left").mapInArrow(survivors, "chunk long, starts array<long>, lens array<long>, data binary")
    parts = keep(parts, folder, "segments")
    free_shuffles(spark)
    left = parts.agg(F.sum(F.length("data"))).first()[0] or 0
    blocks = max(1, passes, -(-left // BLOCK))

    def suffixes(batch, i, within=None):
        return _suffixes(np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), _array(batch.column("lens"), i), length, within)

    before = _ranked(parts.select("chunk", "lens", "data"), suffixes, True, blocks, passes, True, folder, "before")

    def covered(batches):
        edges = _edges(0, blocks, blocks)
        for batch in batches:
            for i in range(batch.num_rows):
                at, names = suffixes(batch, i)
                order, first, before_it = _kinds(names, edges, batch.column("bits")[i].values)
                dup = np.ones(len(order), bool)
                dup[order[first[~before_it]]] = False
                starts, lens = _array(batch.column("starts"), i), _array(batch.column("lens"), i)
                offs = np.concatenate([[0], np.cumsum(lens)])
                at = at[dup]
                seg = np.searchsorted(offs, at, "right") - 1
                place = starts[seg] + at - offs[seg]
                if len(place):
                    # runs of starts one after another, of one segment
                    cut = np.flatnonzero((place[1:] != place[:-1] + 1) | (seg[1:] != seg[:-1])) + 1
                    lo, hi = place[np.concatenate([[0], cut])], place[np.append(cut - 1, len(place) - 1)] + length
                    yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([lo.tolist()], pa.list_(pa.int64())), pa.array([hi.tolist()], pa.list_(pa.int64()))], names=["chunk", "lo", "hi"])

    runs = parts.join(before.hint("shuffle_hash"), "chunk", "left").mapInArrow(covered, "chunk long, lo array<long>, hi array<long>")
    runs = keep(runs, folder, "runs")
    free_shuffles(spark)

    def result(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends = np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8), _array(batch.column("ends"), i)
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, _array(batch.column("lo"), i), 1)
                np.add.at(depth, _array(batch.column("hi"), i), -1)
                gone = np.cumsum(depth)[: len(data)] > 0
                docs_at = np.concatenate([[0], ends])
                # runs end at document ends too
                new, stop = gone.copy(), gone.copy()
                new[1:] &= ~gone[:-1]
                stop[:-1] &= ~gone[1:]
                full = np.flatnonzero(np.diff(docs_at))
                new[docs_at[:-1][full]] |= gone[docs_at[:-1][full]]
                stop[docs_at[1:][full] - 1] |= gone[docs_at[1:][full] - 1]
                lo, hi = np.flatnonzero(new), np.flatnonzero(stop) + 1
                doc = np.searchsorted(ends, lo, "right")
                offs = np.searchsorted(doc, np.arange(len(ends) + 1))
                base = docs_at[:-1][doc]
                spans = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], names=["start", "end"]))
                left_at = np.concatenate([[0], np.cumsum(~gone)])[docs_at]
                left_raw = data[~gone].tobytes()
                ids = batch.column("ids")[i].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(docs_at)), spans.cast(kind), K.binary_column([left_raw[a:b] for a, b in zip(left_at[:-1], left_at[1:])])], names=["doc_id", "n_bytes", "removed", "kept"])

    return chunks.join(runs.hint("shuffle_hash"), "chunk", "left").mapInArrow(result, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM f),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM j),
r AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo) AS n_removed FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, h, n, coalesce(n_removed, 0)::BIGINT AS n_removed, list_concat([0::BIGINT], coalesce(hi, [])) AS a, list_concat(coalesce(lo, []), [n]) AS b FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, n AS n_bytes, n_removed, len(a)::BIGINT - 1 AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda x: substring(h, 2 * a[x] + 1, 2 * (b[x] - a[x]))), ''))) AS kept_sha256 FROM k"""
