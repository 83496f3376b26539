"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's sorted set of word shingles gives a 128-bit set key and a MinHash signature. Documents with equal
   sets form one class at once, by a grouped minimum: copies never meet in a task.
2. Signatures are cut into bands; classes that share a band are candidates. A bucket's pairs are not all written out:
   each member is first held against one leader of its bucket, verified links are joined to components, and only
   buckets with members in different components go on. Those are compared in blocks of bounded size, chunk against
   chunk, and a block gives on a spanning forest of its links. No bucket is capped and no member is left out, so no
   link that banding finds between different components is lost.
3. A candidate's signatures are compared batch by batch. After each batch the posterior of its similarity (Beta prior,
   binomial matches) is held against the threshold; a pair whose chance of reaching it is below `miss` leaves.
4. Survivors are verified on their full sets. A shingle is held as a 64-bit fingerprint whose steps are not linear: two
   sets of m shingles have one in common by accident with a chance of m*m/2^64, and such a one moves their similarity by
   1/m. What makes sets equal at once is a digest over 128-bit fingerprints.

Rows: null and blank texts have no shingles, n_shingles 0, link with nothing and are their own component (kept). Rows
of equal doc_id count as one document only where their sets are equal; a null doc_id forms components as any other row
but is never kept. Ties and repeated rows fall into one class. Extra columns are ignored; an empty table gives an empty
table. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import components, keep, small_batches, spread_join, table, work_folder

BANDS, ROWS = 32, 5
BATCH = 20
LEADER_ROUNDS = 1
#: Members of a bucket and bytes of their sets in one chunk, and rows of small buckets that share a task, about.
CHUNK, CHUNK_BYTES, BIN = 4096, 16 << 20, 4096


@lru_cache(64)
def least_matches(threshold: float, miss: float, total: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on): P(similarity >= threshold | matches) >= miss, uniform Beta prior."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            w = np.exp(logs - logs.max())
            if w[grid >= threshold].sum() / w.sum() >= miss:
                out.append((n, m))
                break
    return out


def sets(docs: DataFrame, doc_id: str, text: str, width: int, with_sets: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, n (set size), key (16 bytes of the set), and signature or the set itself (8 bytes a shingle)."""
    small_batches(docs.sparkSession)
    what = "shingles" if with_sets else "signature"
    fields = docs.schema
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in (doc_id, *extra)) + f", n long, key binary, {what} binary"

    def run(batches):
        for batch, data, offs in K.slices(batches, text):
            values, more, at = K.shingles(data, offs, width)
            hi, lo = values.astype("<u8").tobytes(), more.astype("<u8").tobytes()
            own = [hi[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:])]
            keys = [hashlib.blake2b(x + lo[8 * a : 8 * b], digest_size=16).digest() for x, a, b in zip(own, at[:-1], at[1:])]
            if not with_sets:
                own = [x.tobytes() for x in K.min_hashes(values, at, BANDS * ROWS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (doc_id, *extra)), pa.array(np.diff(at)), K.binary_column(keys), K.binary_column(own)], names=[doc_id, *extra, "n", "key", what])

    return docs.select(doc_id, *extra, text).mapInArrow(run, schema)


def _bands(classes: DataFrame) -> DataFrame:
    """(bucket, band, node) for every band of every class that has shingles."""

    def run(batches):
        for batch in batches:
            raw = batch.column("signature").to_pylist()
            if not raw:
                continue
            sig = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), BANDS, ROWS).astype(np.uint64)
            h = np.zeros((len(raw), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                h = K.mix(h * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, r] + np.uint64(1))
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(band), pa.array(node)], names=["bucket", "band", "node"])

    return classes.where("n > 0").select("node", "signature").mapInArrow(run, "bucket long, band int, node long")


def _bayes(pairs: DataFrame, sizes: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't rule out. sizes: pairs of each a."""
    rule = least_matches(threshold, miss)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in ("sa", "sb"))
            live, got, done = np.arange(n), np.zeros(n, np.int64), 0
            for upto, least in rule:
                got[live] += (x[live, done:upto] == y[live, done:upto]).sum(1)
                live, done = live[got[live] >= least], upto
                if not len(live):
                    break
            idx = pa.array(live)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(idx) for c in "ab"], names=["a", "b"])

    sig = classes.select("node", "signature")
    one = spread_join(pairs, sig.select(F.col("node").alias("a"), F.col("signature").alias("sa")), ["a"], "b", sizes)
    two = one.join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    return two.mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sizes: DataFrame, store: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. sizes: pairs of each a."""

    def run(batches):
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("xa"), batch.column("xb")):
                ok.append(_similar(*(np.frombuffer(v.as_buffer(), "<u8") for v in (p, q)), percent))
            idx = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(idx) for c in "ab"], names=["a", "b"])

    one = pairs.join(store.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
    two = spread_join(one, store.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), ["a"], "b", sizes)
    return two.mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = int((x[at] == y).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _blocks(members: DataFrame, with_sets: bool, folder: str, name: str) -> DataFrame:
    """members (bucket, n, ...) dealt into blocks (big, bin, p, q): a large bucket chunk by chunk against chunk, small
    buckets together. A block holds two chunks at most."""
    total = members.count()
    chunks = F.ceil(F.count("*") / CHUNK)
    chunks = F.greatest(chunks, F.ceil(F.sum("n") * 8 / CHUNK_BYTES)) if with_sets else chunks
    sizes = keep(members.groupBy("bucket").agg(chunks.cast("int").alias("chunks"), F.count("*").alias("size")), folder, name)
    placed = spread_join(members, sizes, ["bucket"], "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    big = F.col("chunks") > 1
    bins = max(1, -(-total // BIN))
    return placed.withColumns({"big": big, "bin": F.when(big, F.col("bucket")).otherwise(F.pmod("bucket", F.lit(bins))), "p": F.least("chunk", "other"), "q": F.greatest("chunk", "other")}).drop("other", "chunks")


def _open_pairs(t: pa.Table, rule: list[tuple[int, int]], now=None):
    """Slices (i, j) of a block's row pairs that share a bucket, lie in different components, meet here and in no
    earlier band, and that sequential comparison of signatures doesn't rule out. now: gives the rows' components as
    they are when a slice starts."""
    bucket, own, chunk, band = (t.column(c).to_numpy() for c in ("bucket", "own", "chunk", "band"))
    crossed = t.column("p")[0].as_py() != t.column("q")[0].as_py()
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(len(bucket), -1)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], bucket[order], "right")
    count = ends - np.arange(len(order)) - 1
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(count[lo:]), 100_000, "right")) + lo)
        per = count[lo:hi]
        first = np.cumsum(per) - per
        i = np.repeat(np.arange(lo, hi), per)
        j = i + 1 + np.arange(len(i)) - np.repeat(first, per)
        i, j = order[i], order[j]
        own = now() if now else own
        ok = own[i] != own[j]
        if crossed:
            ok &= chunk[i] != chunk[j]
        i, j, lo = i[ok], j[ok], hi
        done, got = 0, np.zeros(len(i), np.int64)
        for upto, least in rule:
            got += (sig[i, done:upto] == sig[j, done:upto]).sum(1)
            ok = got >= least
            i, j, got, done = i[ok], j[ok], got[ok], upto
        if len(i):
            shared = (sig[i] == sig[j]).reshape(len(i), BANDS, ROWS).all(2).argmax(1)
            ok = shared == band[i]
            yield i[ok], j[ok]


def _open_nodes(rule):
    """Of a block, the nodes with a pair to verify."""

    def run(key, t):
        t = t.combine_chunks()
        node = t.column("node").to_numpy()
        live = [np.empty(0, np.int64)]
        for i, j in _open_pairs(t, rule):
            live += [node[i], node[j]]
        return pa.table({"node": np.unique(np.concatenate(live))})

    return run


def _block_links(rule, percent: int):
    """Of a block, verified links: a spanning forest over the components its members came in."""

    def run(key, t):
        t = t.combine_chunks()
        node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        sets_ = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("shingles").combine_chunks()]
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        a, b = [], []
        kinds, back = np.unique(own, return_inverse=True)

        def now():
            return np.array([find(x) for x in kinds.tolist()])[back]

        for i, j in _open_pairs(t, rule, now):
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = find(int(own[x])), find(int(own[y]))
                if p != q and _similar(sets_[x], sets_[y], percent):
                    root[p] = q
                    a.append(int(node[x]))
                    b.append(int(node[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the near-duplicate group) and kept, for every row of docs."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = keep(sets(docs, "doc_id", "text", width, False), folder, "rows")
    first = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "signature")).alias("x"), F.count("*").alias("size"))
    classes = keep(first.select(F.monotonically_increasing_id().alias("node"), "key", "size", "x.doc_id", "x.n", "x.signature"), folder, "classes")

    # buckets of two classes or more, each with a leader
    bands = _bands(classes)
    heads = keep(bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1"), folder, "heads")
    buckets = keep(spread_join(bands, heads, ["bucket"], "node"), folder, "buckets")

    stored: list[DataFrame] = []

    def store(need: DataFrame, name: str) -> DataFrame:
        """The sets of nodes, those kept before and new ones cut from their texts; the key tells rows of equal doc_id apart."""
        for have in stored:
            need = need.join(have.select("node"), "node", "left_anti")
        need = keep(classes.join(need, "node").select("node", "doc_id", "key"), folder, f"{name}-need")
        some = docs.join(need.select(F.col("doc_id").alias("id")).distinct().hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text")
        cut = sets(some, "doc_id", "text", width, True).select("key", "shingles")
        stored.append(keep(_one_each(cut.join(need.select("node", "key").hint("shuffle_hash"), "key").select("node", "shingles")), folder, f"{name}-sets"))
        both = stored[0]
        for more in stored[1:]:
            both = both.union(more)
        return both

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sizes = keep(pairs.groupBy("a").agg(F.count("*").alias("size")), folder, f"{name}-sizes")
        left = keep(_bayes(pairs, sizes, classes, percent / 100, miss), folder, f"{name}-survivors")
        nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
        return keep(_exact(left, sizes, store(nodes, name), percent), folder, f"{name}-links")

    def mixed(members: DataFrame, groups: DataFrame, name: str) -> DataFrame:
        """Members of buckets that hold more than one component, with their component and a new leader."""
        named = members.join(groups.withColumnRenamed("component", "own"), "node", "left").select("bucket", "band", "node", F.coalesce("own", "node").alias("own"))
        named = keep(named, folder, f"{name}-named")
        lead = F.min(F.struct(F.xxhash64("node", F.lit(name)).alias("h"), "node", "own")).alias("lead")
        split = named.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), lead, F.count("*").alias("size")).where("lo <> hi")
        split = keep(split.select("bucket", F.col("lead.node").alias("leader"), F.col("lead.own").alias("lead_own"), "size"), folder, f"{name}-split")
        return keep(spread_join(named, split, ["bucket"], "node"), folder, name)

    tested = keep(buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), folder, "pairs-0")
    links = verified(tested, "round-0")
    groups = components(links, folder, "groups-0")
    members = mixed(buckets.select("bucket", "band", "node"), groups, "mixed-0")
    for k in range(1, LEADER_ROUNDS + 1):
        new = members.where("own <> lead_own").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))
        pairs = keep(new.distinct().join(tested, ["a", "b"], "left_anti").select("a", "b"), folder, f"pairs-{k}")
        tested, links = tested.union(pairs), links.union(verified(pairs, f"round-{k}"))
        groups = components(links, folder, f"groups-{k}")
        members = mixed(members.select("bucket", "band", "node"), groups, f"mixed-{k}")

    # what is left, chunk against chunk: first by signatures alone, then with the sets of those still in question
    rule, block = least_matches(percent / 100, miss), ["big", "bin", "p", "q"]
    members = members.select("bucket", "band", "node", "own").join(classes.select("node", "n"), "node")
    signed = _blocks(members, False, folder, "blocks").join(classes.select("node", "signature"), "node")
    live = keep(signed.groupBy(*block).applyInArrow(_open_nodes(rule), "node long").distinct(), folder, "open-nodes")
    members = keep(members.join(live, "node", "left_semi"), folder, "open-members")
    full = _blocks(members, True, folder, "open-blocks").join(classes.select("node", "signature").join(live, "node", "left_semi"), "node").join(store(live, "open"), "node")
    links = links.union(keep(full.groupBy(*block).applyInArrow(_block_links(rule, percent), "a long, b long"), folder, "open-links"))
    groups = components(links, folder, "groups")

    named = classes.join(groups.withColumnRenamed("component", "own"), "node", "left").select("node", "key", "size", "doc_id", F.coalesce("own", "node").alias("own"))
    named = keep(named.withColumnRenamed("size", "rows"), folder, "named")
    least = keep(named.groupBy("own").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), folder, "least")
    named = keep(spread_join(named, least, ["own"], "node").select("key", "component_id", F.col("rows").alias("size")), folder, "components")
    out = spread_join(rows.select("doc_id", "n", "key"), named, ["key"], "doc_id")
    # documents without shingles are alone, though their sets are equal
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _one_each(df: DataFrame) -> DataFrame:
    """One row a node; rows of a node are equal. A grouped minimum, combined before the shuffle."""
    return df.groupBy("node").agg(F.min("shingles").alias("shingles"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), width=2)


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(v, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.a, reach.m FROM reach JOIN e ON e.b = reach.v),
least AS (SELECT v, min(m) AS m FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON v = d.doc_id"""
