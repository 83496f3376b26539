"""Entity linking: dictionary, encoder, nearest terms, threshold and back to every mention."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Linking
from ..functions.arrays import matrix
from ..functions.columns import clean
from ..shared import exists, files
from ..sources import readers, writers

Encoder = Callable[[list[str]], np.ndarray]
BLOCK = 4096
CANDIDATE = "array<struct<cui:string,term:string,semantic_type:string,confidence:double>>"


def last_wins(lines: DataFrame) -> DataFrame:
    """One (cui, semantic_type) for each exact term: that of its last line."""
    best = F.max_by(F.struct("cui", "semantic_type"), F.col("line_no")).alias("x")
    return lines.groupBy("term").agg(best).select("term", "x.cui", "x.semantic_type")


def ngram_encoder(dims: int = 256, longest: int | None = None) -> Encoder:
    """Hashed character trigrams of lower-cased text, L2-normalised: deterministic and offline.

    Texts are taken whole unless `longest` is given. It finds spelling variants, not synonyms; a model-backed encoder has
    the same form.
    """

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            s = f" {text.lower()[:longest]} "
            for k in range(max(1, len(s) - 2)):
                h = int.from_bytes(hashlib.blake2b(s[k : k + 3].encode(), digest_size=8).digest(), "little")
                out[row, h % dims] += 1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.maximum(norm, 1e-12)

    return encode


def encoded(df: DataFrame, text: str, make: Callable[[], Encoder]) -> DataFrame:
    """df with the column `vector`; the encoder is made once a task."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches):
        encode = make()
        for batch in batches:
            vectors = encode([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(vectors), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return df.mapInArrow(run, schema)


def cached(terms: DataFrame, text: str, make: Callable[[], Encoder], name: str, folder: str) -> DataFrame:
    """encoded(), kept in the folder under a key of the encoder's name and the texts: the same texts are encoded once.

    The key is the number of texts and two sums of hashes over them, whatever their order.
    """
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)"))
    n, one, two = terms.agg(F.count("*"), wide(1), wide(2)).first()
    path = f"{folder}/{hashlib.sha256(f'{name}:{n}:{one}:{two}'.encode()).hexdigest()[:24]}"
    # Spark's own mark of a finished write
    if not exists(terms.sparkSession, f"{path}/_SUCCESS"):
        encoded(terms, text, make).write.mode("overwrite").parquet(path)
    return terms.sparkSession.read.parquet(path)


def _nearest(k: int, digits: int):
    def run(key, t):
        t = t.combine_chunks()
        side, name = t.column("side").to_numpy(), np.array(t.column("name").to_pylist(), dtype=object)
        q, d = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, s_out = [], [], []
        if len(q) and len(d):
            d = d[np.argsort(name[d], kind="stable")]
            score = np.round(matrix(t.column("vector"), q) @ matrix(t.column("vector"), d).T, digits)
            n = min(k, len(d))
            floor = np.partition(score, len(d) - n, 1)[:, len(d) - n]
            i, j = np.nonzero(score >= floor[:, None])
            s = score[i, j]
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            ok = np.arange(len(i)) - np.searchsorted(i, i) < n
            a, b, s_out = name[q][i[ok]].tolist(), name[d][j[ok]].tolist(), s[ok].tolist()
        return pa.table({"query": pa.array(a, pa.string()), "term": pa.array(b, pa.string()), "score": pa.array(s_out, pa.float64())})

    return run


def _usable(df: DataFrame, name: str) -> DataFrame:
    """(name, vector, width) of rows that have both; components that are null or not finite count as 0."""
    return df.where(F.col(name).isNotNull() & (F.size("vector") > 0)).select(F.col(name).alias("name"), clean(F.col("vector")).alias("vector"), F.size("vector").alias("width"))


def _best(q: DataFrame, d: DataFrame, key: list[str], k: int, digits: int) -> DataFrame:
    """The k best terms of each query, from blocks of BLOCK rows, about, of each side of each key."""
    many = lambda df, n: df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    sizes = many(q, "nq").join(many(d, "nd"), key)
    mine = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, key).select("name", "vector", F.lit(0).alias("side"), *key, mine("nq").alias("q"), every("nd").alias("d"))
    d = d.join(sizes, key).select("name", "vector", F.lit(1).alias("side"), *key, every("nq").alias("q"), mine("nd").alias("d"))
    found = q.unionByName(d).groupBy(*key, "q", "d").applyInArrow(_nearest(k, digits), "query string, term string, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "term")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_terms(queries: DataFrame, dictionary: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query, term, score, rank): exact inner-product search, query blocks against dictionary blocks.

    queries: query, vector; dictionary: term, vector. Ties go to the smaller term. Rows without a name or vector take no
    part, and vectors of another width than the query's are no candidates.
    """
    return _best(_usable(queries, "query"), _usable(dictionary, "term"), ["width"], k, digits)


def cell_terms(queries: DataFrame, dictionary: DataFrame, k: int, cells: int | None = None, probes: int | None = None, seed: int = 5) -> DataFrame:
    """Approximate search: a k-means coarse quantiser, probed cells, exact ranking there.

    Cells and probes follow the dictionary's size: min(4096, max(n / 50, 256)) but no more than n, and min(32, cells), or
    as given. Both sides of a cell are cut into blocks, so a hot cell spreads over tasks. Queries for which the probed
    cells hold fewer than k terms are answered by exact search. All vectors have one width; rows without a name or
    vector take no part, and an empty dictionary gives no rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    asked, terms = _usable(queries, "query"), _usable(dictionary, "term")
    n = terms.count()
    if not n:
        return nearest_terms(queries, dictionary, k)
    cells = cells or min(4096, max(n // 50, 256), n)
    probes = min(probes or 32, cells)
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="f").fit(terms.select(array_to_vector("vector").alias("f")))
    centers = np.array(model.clusterCenters())

    def probe(width: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                far = (centers**2).sum(1)[None, :] - 2 * x @ centers.T
                own = np.argsort(far, 1, kind="stable")[:, :width].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("vector"), pa.array(own.tolist(), pa.list_(pa.int32()))], names=["name", "vector", "cells"])

        return run

    placed = lambda df, width: df.select("name", "vector").mapInArrow(probe(width), "name string, vector array<double>, cells array<int>").select("name", "vector", F.explode("cells").alias("cell"))
    best = _best(placed(asked, probes), placed(terms, 1), ["cell"], k, 9)
    few = asked.join(best.groupBy(F.col("query").alias("name")).count(), "name", "left").where(F.coalesce("count", F.lit(0)) < min(k, n)).select(F.col("name").alias("query"), "vector")
    if few.isEmpty():
        return best
    return best.join(few.select("query"), "query", "left_anti").select("query", "term", "score", "rank").union(nearest_terms(few, dictionary, k))


def normal(text: Column) -> Column:
    """What mentions are told apart by: trimmed and lower-cased, null where blank."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def clipped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def kept(candidates: Column, threshold: float) -> Column:
    """Those of the threshold or more, or the best alone; by the unclipped score."""
    good = F.filter(candidates, lambda c: c["score"] >= threshold)
    return F.when(F.size(good) > 0, good).otherwise(F.slice(candidates, 1, 1))


def back_to_mentions(mentions: DataFrame, text: str, found: DataFrame, dictionary: DataFrame, threshold: float = 0.35) -> DataFrame:
    """mentions with the six result columns; blank mentions get nulls, no candidates and no warning.

    found: query, term, score, rank for each distinct normal text.
    """
    facts = found.join(dictionary.select("term", "cui", "semantic_type"), "term")
    one = F.struct("rank", "term", "cui", "semantic_type", "score")
    lists = facts.groupBy("query").agg(F.array_sort(F.collect_list(one)).alias("all")).withColumn("c", kept(F.col("all"), threshold))
    top = F.get("c", F.lit(0))
    shown = F.transform("c", lambda x: F.struct(x["cui"].alias("cui"), x["term"].alias("term"), x["semantic_type"].alias("semantic_type"), clipped(x["score"]).alias("confidence")))
    lists = lists.select(
        F.col("query").alias("_q"),
        top["term"].alias("umls_top_term"),
        top["cui"].alias("umls_top_cui"),
        clipped(top["score"]).alias("umls_top_confidence"),
        top["semantic_type"].alias("umls_top_semantic_type"),
        F.to_json(shown).alias("umls_candidates"),
        (top["score"] < threshold).alias("umls_below_threshold_warning"),
    )
    out = mentions.withColumn("_n", normal(F.col(text))).join(lists, F.col("_n") == F.col("_q"), "left").drop("_n", "_q")
    return out.fillna({"umls_candidates": "[]", "umls_below_threshold_warning": False})


def link(mentions: DataFrame, dictionary: DataFrame, text: str = "entity", cfg: Linking = Linking(), make: Callable[[], Encoder] | None = None, cache: str | None = None) -> DataFrame:
    """Every distinct text is encoded and searched once, and its result goes back to all its mentions.

    cache: a folder in which the dictionary's vectors are kept for later runs, under cfg.encoder and its texts.
    """
    if text not in mentions.columns:
        raise KeyError(text)
    make = make or (lambda: ngram_encoder(cfg.dims, cfg.max_chars))
    distinct = mentions.select(normal(F.col(text)).alias("query")).where("query is not null").distinct()
    queries, own = encoded(distinct, "query", make), dictionary.select("term")
    terms = cached(own, "term", make, f"{cfg.encoder}:{cfg.dims}:{cfg.max_chars}", cache) if cache else encoded(own, "term", make)
    search = cell_terms if cfg.use_cells and dictionary.count() > cfg.cells_above else nearest_terms
    return back_to_mentions(mentions, text, search(queries, terms, cfg.top_k), dictionary, cfg.threshold)


def link_folder(spark: SparkSession, folder: str, out: str, dictionary: DataFrame, text: str = "entity", glob: str = "*.csv", cfg: Linking = Linking(), skip_existing: bool = False, cache: str | None = None) -> list[str]:
    """Each table of a folder linked into a table of its own, NAME.normalized.csv; returns where.

    With skip_existing, tables whose result is there are left alone. One job a file: files are few and large.
    """
    done = []
    for name in files(spark, folder, glob):
        target = f"{out.rstrip('/')}/{name.rsplit('.', 1)[0]}.normalized.csv"
        if not (skip_existing and exists(spark, f"{target}/_SUCCESS")):
            writers.delimited(link(readers.delimited(spark, f"{folder.rstrip('/')}/{name}"), dictionary, text, cfg, cache=cache), target)
        done.append(target)
    return done
