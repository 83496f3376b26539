"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger says for each blob which rules
it was scanned by (a kind and the digest of its pattern, so a changed rule is a new one) and what they found; only
(blob, rule) pairs that it does not hold are scanned, each once however many paths share the blob, and findings are
joined back to all paths. One path stands for each new blob (a grouped minimum over addresses, no texts), so texts move
once, dealt by blob and path, and the paths of a blob with many copies meet its findings in several tasks.

Rows: a null text is the empty blob and has no findings. Rows of equal path and text count once in the ledger and each
get its findings; a null path is a path. Overlapping kinds are all kept, ordered by start, then kind as listed. Extra
columns are ignored; an empty table gives an empty table. Texts are taken whole; offsets are code points.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, spread_join, table, work_folder


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, needed substring or None, least length of group 2 or None); base kinds first, in the order of ties.
KINDS = (
    ("assign", ASSIGN, None, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", "AKIA", None),
    ("hex", r"[0-9a-f]{16,}", None, None),
    # with its body: up to the END line or, without one, the lines of base64
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[ \t\r\n]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\r\n]*)?)", "PRIVATE KEY-----", None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "gh", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox", None),
    ("google", r"AIza[0-9A-Za-z_-]{35}", "AIza", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ", None),
)
BASE = ("assign", "access", "hex")


def rule_of(kind: str, pattern: str, needed: str | None, least: int | None) -> str:
    """What the ledger knows a rule by."""
    return f"{kind}:{hashlib.sha256(repr((pattern, needed, least)).encode()).hexdigest()[:16]}"


def _spans(kind_no: int, kind: str, matches: Column, pieces: Column, pattern: str, least: int | None) -> Column:
    """Offsets of the matches: what lies between them (pieces) and they themselves, added up."""
    steps = F.transform(matches, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("len"), m.alias("m")))
    empty = F.expr("cast(array() as array<struct<start:int,no:int,end:int,kind:string>>)")
    ok = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= least) if least else (lambda m: F.lit(True))
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["pos"] + x["gap"] + x["len"]).alias("pos"),
            F.when(
                ok(x["m"]),
                F.concat(acc["out"], F.array(F.struct((acc["pos"] + x["gap"]).alias("start"), F.lit(kind_no).alias("no"), (acc["pos"] + x["gap"] + x["len"]).alias("end"), F.lit(kind).alias("kind")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


SPANS = "array<struct<start:int,no:int,end:int,kind:string>>"


def find(df: DataFrame, text: str, out: str = "spans", rules: str | None = None, kinds: tuple = KINDS) -> DataFrame:
    """df with the column `out`: array of (start, no, end, kind), ordered by start and kind; by the rules that the
    column `rules` lists, or by all."""
    own = F.coalesce(F.col(text), F.lit(""))
    empty = F.expr("cast(array() as array<string>)")
    found = {}
    for kind, pattern, needed, least in kinds:
        hit = F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
        asked = [F.contains(own, F.lit(needed))] if needed else []
        asked += [F.array_contains(rules, rule_of(kind, pattern, needed, least))] if rules else []
        for condition in asked:
            hit = F.when(condition, hit).otherwise(empty)
        found[f"_m_{kind}"] = hit
    df = df.withColumns(found)
    none = F.expr(f"cast(array() as {SPANS})")
    parts = [F.when(F.size(f"_m_{kind}") > 0, _spans(no, kind, F.col(f"_m_{kind}"), F.split(own, pattern, -1), pattern, least)).otherwise(none) for no, (kind, pattern, _, least) in enumerate(kinds)]
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(*found)


def scan(versions: DataFrame, path: str, text: str, ledger: DataFrame | None = None, kinds: tuple = KINDS) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) for every row of versions, and the ledger (blob, rules, spans) with what was scanned now.

    Give the returned ledger, kept, to the next call: a blob is read again only for rules it was not scanned by, and
    what rules no longer in `kinds` had found is left out.
    """
    spark = versions.sparkSession
    folder = work_folder(spark)
    addressed = versions.select(F.col(path).alias("path"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    places = keep(addressed.select("path", "blob"), folder, "places")
    blobs = keep(places.groupBy("blob").agg(F.min("path").alias("first"), F.count("*").alias("size")), folder, "blobs")
    rules = {kind: rule_of(kind, *rest) for kind, *rest in kinds}
    every = F.array(*map(F.lit, rules.values()))
    new = blobs.select(F.col("blob").alias("new_blob"), "first", every.alias("rules"))
    if ledger is not None:
        done = ledger.groupBy(F.col("blob").alias("new_blob")).agg(F.flatten(F.collect_set("rules")).alias("done"))
        left = F.array_except("rules", F.coalesce("done", F.expr("cast(array() as array<string>)")))
        new = new.join(done, "new_blob", "left").select("new_blob", "first", left.alias("rules")).where(F.size("rules") > 0)
    unseen = addressed.join(new.hint("shuffle_hash"), (F.col("blob") == F.col("new_blob")) & F.col("path").eqNullSafe(F.col("first"))).select("blob", "text", "rules")
    scanned = find(unseen, "text", rules="rules" if ledger is not None else None, kinds=kinds).select("blob", "rules", "spans")
    scanned = keep(scanned.groupBy("blob").agg(F.min("rules").alias("rules"), F.min("spans").alias("spans")), folder, "scanned")
    known, held = scanned, scanned
    if ledger is not None:
        known = ledger.select("blob", "rules", "spans").unionByName(scanned)
        now = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
        number = F.create_map(*(F.lit(x) for n, kind in enumerate(rules) for x in (kind, n)))
        live = F.filter("spans", lambda s: F.array_contains("rules", now[s["kind"]]))
        live = F.transform(live, lambda s: F.struct(s["start"].alias("start"), number[s["kind"]].alias("no"), s["end"].alias("end"), s["kind"].alias("kind")))
        held = known.select("blob", live.alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = spread_join(places, held.where(F.size("spans") > 0).select("blob", "spans"), ["blob"], "path", blobs, "left")
    return findings.select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans")), known


def redact(df: DataFrame | None, text: str, spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of bytes that some span covers replaced by the mark."""
    cut = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["pos"], x["end"]).alias("pos"),
            F.when(x["start"] >= acc["pos"], F.concat(acc["out"], F.col(text).substr(acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.col(text).substr(acc["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(F.col(text))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("path").alias("doc_id"),
        *map(count, BASE),
        F.sha2(_joined(F.filter("spans", lambda x: x["no"] < len(BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = " UNION ALL ".join(
        f"SELECT doc_id, {no} AS no, {quote(kind)} AS kind, regexp_extract_all(t, {quote(pattern)}, 0) AS m, regexp_extract_all(t, {quote(pattern)}, {2 if least else 0}) AS g, string_split_regex(t, {quote(pattern)}) AS p, {least or 0} AS least FROM d"
        for no, (kind, pattern, _, least) in enumerate(KINDS)
    )
    total = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    start = f"({total.format('p[1:i]')} + {total.format('m[1:i - 1]')})::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({rows}),
f AS (SELECT doc_id, no, kind, m, g, p, least, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
s AS (SELECT doc_id, no, kind, {start} AS lo, {start} + length(m[i]) AS hi FROM f WHERE length(g[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, no) FILTER (no < {len(BASE)}) AS base, string_agg(kind || ':' || lo || ':' || hi, ',' ORDER BY lo, no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


OP2_SQL = _oracle()
