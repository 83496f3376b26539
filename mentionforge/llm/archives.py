"""WARC archives by way of a chunked record table.

A page is a response record, or a revisit of the record with an equal payload. Payloads become rows of record identifier
and chunk number, of CHUNK bytes at most, before they reach the writer, which puts each row into the archive as a record
of its own (a response and its continuation records); so neither writer nor reader ever has a whole oversized record.
Archives are written, gzip-compressed, and read with Spark's own file sources alone, into any store, and each file has a
bounded size. The
reader gives the chunk table back; digests of segmented records are carried from chunk to chunk, and a revisit is held
against the responses that were read.

Rows: a null html is an empty payload; a null url leaves out the target; a null page_id is written without one and read
back as null. Of equal payloads of `least` bytes or more the largest page_id is the response and all others revisit it;
repeated rows of that page are all responses. Extra columns are ignored; empty tables give archives without records.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, partitions, small_batches, spread_join, table, work_folder

CHUNK = 256 << 10
#: Archive files hold at most PACKS rows of about PACK bytes.
PACK, PACKS = 4 << 20, 8
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record string, chunk long, total long, page_id long, url string, record_type string, refers_to long, digest string, length long, data binary"


def plan(pages: DataFrame, least: int, folder: str) -> DataFrame:
    """page_id, url, payload, digest, length, refers_to and refers_url (null: a response)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("length", F.length("payload").cast("long"))
    facts = keep(pages.where(F.col("length") >= least).select("page_id", "url", "digest", "length"), folder, "facts")
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("last")
    shared = facts.groupBy("digest", "length").agg(last, F.count("*").alias("size")).where("size > 1 and last is not null")
    shared = keep(shared.select("digest", "length", "size", F.col("last.page_id").alias("response"), F.col("last.url").alias("refers_url")), folder, "shared")
    # revisits by page and digest, so that equal payloads spread over all tasks when they meet their texts
    again = spread_join(facts.select("page_id", "digest", "length"), shared, ["digest", "length"], "page_id").where(~F.col("page_id").eqNullSafe(F.col("response")))
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("response").alias("refers_to"), "refers_url").distinct()
    return pages.join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def _record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in fields if v is not None]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record(name: str, page_id, url, chunk: int, total: int, data, digest: str, length: int, refers_to=None, refers_url=None) -> bytes:
    """The WARC record of one row of the chunk table."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if chunk:
        last = [("WARC-Segment-Total-Length", len(head) + length)] if chunk == total - 1 else []
        return _record("continuation", f"{name}:{chunk}", [("WARC-Segment-Origin-ID", f"<urn:record:{name}>"), ("WARC-Segment-Number", chunk + 1), ("X-Chunks", total), *last], data)
    own = [("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", length)]
    if refers_to is not None:
        own += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", _line(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", refers_to), ("Content-Type", "application/http;msgtype=response")]
        return _record("revisit", name, own, b"HTTP/1.1 200 OK\r\n\r\n")
    own += [("X-Chunks", total), ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if total > 1 else None)]
    return _record("response", name, own, head + data)


def _line(url: str | None) -> str | None:
    return " ".join(url.split()) or None if url else None


def chunked(planned: DataFrame) -> DataFrame:
    """A row for each chunk of each page's payload: CHUNK bytes at most, one row where it is empty or a revisit's."""
    total = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("length") / CHUNK))).otherwise(1).cast("int")
    empty = F.lit(b"")
    part = lambda k: F.struct(k.alias("chunk"), F.when(F.col("refers_to").isNull(), F.substring("payload", k * CHUNK + 1, F.lit(CHUNK))).otherwise(empty).alias("data"))
    named = planned.withColumn("name", F.monotonically_increasing_id().cast("string")).withColumn("total", total)
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.col("total") - 1), part)).alias("part")
    return named.select("name", "page_id", "url", "total", "digest", "length", "refers_to", "refers_url", parts).select("name", "page_id", "url", "part.chunk", "total", "part.data", "digest", "length", "refers_to", "refers_url")


def write(pages: DataFrame, path: str, folder: str, least: int = 1000) -> None:
    small_batches(pages.sparkSession)

    def pack(batches):
        rows, size = [], 0
        for batch in batches:
            cols = [batch.column(c) for c in ("name", "page_id", "url", "chunk", "total", "data", "digest", "length", "refers_to", "refers_url")]
            for i in range(batch.num_rows):
                rows.append(record(*(c[i].as_py() for c in cols)))
                size += len(rows[-1])
                if size >= PACK:
                    yield _packed(rows)
                    rows, size = [], 0
        if rows:
            yield _packed(rows)

    # the text writer ends a row with the line feed that is the record's last byte
    packed = chunked(plan(pages, least, folder)).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    packed.write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", PACKS).option("compression", "gzip").text(path)


def _packed(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(rows)[:-1]], pa.binary())], names=["value"])


_BLANK_LINE = re.compile(rb"\r\n\r\n")


def parse(view: memoryview):
    """(type, fields, block) of each record of an archive, nothing copied; raises where the framing is broken."""
    at = 0
    while at < len(view):
        end = _BLANK_LINE.search(view, at)
        if end is None:
            raise ValueError("a record without a header's end")
        version, *lines = bytes(view[at : end.start()]).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        stop = end.end() + int(fields["Content-Length"])
        if view[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        yield fields["WARC-Type"], fields, view[end.end() : stop]
        at = stop + 4


def _int(x: str | None) -> int | None:
    return None if x is None else int(x)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all archives in path: a row for each revisit and each chunk of a response's payload."""
    small_batches(spark)
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                # a file holds PACKS packs, unpacked
                for kind, f, block in parse(memoryview(gzip.decompress(content.as_buffer()))):
                    if kind == "continuation":
                        name = f["WARC-Segment-Origin-ID"]
                        row = (name, int(f["WARC-Segment-Number"]) - 1, int(f["X-Chunks"]), None, None, "continuation", None, None, None, bytes(block))
                    else:
                        data = b"" if kind == "revisit" else bytes(block).split(b"\r\n\r\n", 1)[1]
                        row = (f["WARC-Record-ID"], 0, int(f.get("X-Chunks", 1)), _int(f.get("X-Page-ID")), f.get("WARC-Target-URI"), kind, _int(f.get("X-Refers-To-Page")), f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]), data)
                    rows.append(row)
                    size += len(row[-1])
                    if size >= PACK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, CHUNKS)


PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _digests(batches):
    """One row a record from chunk rows in order, with the digest carried from chunk to chunk."""
    held = None
    out: list[tuple] = []

    def close():
        page, url, kind, refers, digest, length, sha, n, chunks, total = held
        if kind == "revisit":
            return page, url, length, digest, kind, refers, True
        return page, url, n, sha.hexdigest(), kind, refers, (n, sha.hexdigest(), chunks) == (length, digest, total)

    def table_():
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in PAGES.split(", ")])

    for batch in batches:
        cols = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            if cols["chunk"][i].as_py() == 0:
                if held:
                    out.append(close())
                held = [*(cols[c][i].as_py() for c in ("page_id", "url", "record_type", "refers_to", "digest", "length")), hashlib.sha1(), 0, 0, cols["total"][i].as_py()]
            if held:
                data = cols["data"][i].as_buffer()
                held[6].update(data)
                held[7] += len(data)
                held[8] += 1
        if out:
            yield table_()
            out = []
    if held:
        out.append(close())
        yield table_()


def read_pages(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """A row for each response and revisit of the archives; intact: payload, digest and chunks are as declared, and a
    revisit's response was read with the same digest and length."""
    chunks = read_chunks(spark, path)
    short = chunks.where("total = 1").mapInArrow(_digests, PAGES)
    long_ = chunks.where("total > 1").repartition(partitions(spark), "record").sortWithinPartitions("record", "chunk")
    pages = keep(short.union(long_.mapInArrow(_digests, PAGES)), folder, "read")
    same = ["refers_to", "payload_digest", "payload_bytes"]
    revisits = pages.where("record_type = 'revisit'")
    wanted = keep(revisits.groupBy(*same).agg(F.count("*").alias("size")), folder, "wanted")
    responses = pages.where("record_type = 'response' and intact").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    there = wanted.join(responses, same, "left_semi").withColumn("there", F.lit(True))
    checked = spread_join(revisits.drop("intact"), there, same, "page_id", wanted, "left").withColumn("intact", F.coalesce("there", F.lit(False)))
    return pages.where("record_type <> 'revisit'").unionByName(checked.drop("there"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    write(table(spark, sf_dir, "pages"), f"{folder}/warc", folder)
    return read_pages(spark, f"{folder}/warc", folder)


OP7_SQL = """
WITH p AS (SELECT page_id, nullif(trim(regexp_replace(url, '\\s+', ' ', 'g')), '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT html, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, url, payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to, true AS intact
FROM p LEFT JOIN r ON p.html = r.html AND payload_bytes >= 1000"""
