"""License scans by ordered signature rules, in DataFrame functions alone.

Texts become lower-case words. Hundreds of signature regexes (license_rules) are gated twice: a text without any of a
few short triggers has no hit, and a rule runs only where its keyword stands. Each hit is an interval of words with the
rule's priority. A hit inside another one is suppressed if the other has a higher priority, or the same and is longer;
hits of one interval and priority all stay. Everything happens within a row: no shuffle at all.

The score is the highest priority of a text's hits, as a share of 100 (a base phrase alone counts as a bare name); 0
without any.

Rows: null and empty texts have no words, no labels and score 0. Repeated rows give equal results; extra columns are
ignored; an empty table gives an empty table. Texts are taken whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import RULES, TRIGGERS, Rule

#: Base phrases and their labels. Fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BASE_PRIORITY = 40
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = tuple(sorted({r.priority for r in RULES}))


def wide(pattern: str) -> str:
    """A pattern over words with a space on either side of each, so that neighbours share none."""
    return f" {pattern.replace(' ?', '(?: )?').replace(' ', '  ')} "


def _n_words(x: Column) -> Column:
    """Words of a part of a normalised text that begins and ends at word edges: half its spaces."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("int")


def _normalised(text: Column) -> Column:
    own = F.coalesce(text, F.lit(""))
    # of letters beyond ASCII only two become ASCII letters when lowered; they stay letters of their own
    odd = F.contains(own, F.lit("İ")) | F.contains(own, F.lit("K"))
    lowered = F.lower(F.when(odd, F.regexp_replace(own, "[İK]", "é")).otherwise(own))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NO_WORD, "  ")), F.lit(" "))


def _place(norm: Column, phrase: str, label: str) -> Column:
    """Where the phrase stands: label, n, first and last word; null if nowhere."""
    parts = F.split(norm, wide(phrase), -1)
    last = F.col("n_words") - _n_words(F.element_at(parts, -1)) - len(phrase.split())
    found = F.struct(F.lit(label).alias("label"), (F.size(parts) - 1).cast("long").alias("n"), _n_words(F.element_at(parts, 1)).cast("long").alias("first"), last.cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(wide(phrase))), found)


def _matches(rules: tuple[Rule, ...]) -> str:
    """SQL for each rule's matches in _norm and the pieces between them; one string, as a tree of calls builds slowly."""
    quote = lambda x: "r'" + x + "'"

    def one(rule: Rule) -> str:
        key, pattern = quote(rule.key.replace(" ", "  ")), quote(wide(rule.pattern))
        found = f"named_struct('label', {quote(rule.label)}, 'level', {LEVELS.index(rule.priority)}, 'found', regexp_extract_all(_norm, {pattern}, 0), 'parts', split(_norm, {pattern}, -1))"
        return f"CASE WHEN contains(_norm, {key}) THEN {found} END"

    return f"array_compact(array({', '.join(map(one, rules))}))"


HIT = "struct<start:int,minus:int,over:int,label:string>"


def _intervals(m: Column) -> Column:
    """Hits (start, -end, -level, label) of a rule: words of what lies between its matches and of the matches, added up."""
    steps = F.zip_with(m["found"], F.slice(m["parts"], 1, F.size(m["found"])), lambda hit, gap: F.struct(_n_words(gap).alias("gap"), _n_words(hit).alias("len")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        hit = F.struct(start.alias("start"), (-(start + x["len"])).alias("minus"), (-m["level"]).alias("over"), m["label"].alias("label"))
        return F.struct((start + x["len"]).alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as array<{HIT}>)").alias("out")), step, lambda acc: acc["out"])


def _kept(hits: Column) -> Column:
    """Hits, sorted by start, end (last first) and level (highest first), less those inside another that outranks them.

    All intervals around one come before it, so the furthest end of each level so far says whether one outranks it; a
    hit of the interval and level just before it shares its fate.
    """
    start = F.struct(
        F.array(*(F.lit(-1) for _ in LEVELS)).alias("ends"),
        F.lit(None).cast("struct<start:int,minus:int,over:int>").alias("last"),
        F.lit(True).alias("stays"),
        F.expr(f"cast(array() as array<{HIT}>)").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), x["minus"].alias("minus"), x["over"].alias("over"))
        free = F.forall(F.slice(acc["ends"], 1 - x["over"], len(LEVELS)), lambda end: end < -x["minus"])
        stays = F.when(acc["last"].eqNullSafe(own), acc["stays"]).otherwise(free)
        ends = F.transform(acc["ends"], lambda end, i: F.when(i == -x["over"], F.greatest(end, -x["minus"])).otherwise(end))
        return F.struct(ends.alias("ends"), own.alias("last"), stays.alias("stays"), F.when(stays, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["out"])


def scan(df: DataFrame, text: str = "text", phrases: tuple = PHRASES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with n_words, places (phrases: label, n, first, last) and hits (label, start, end, priority; by words)."""
    df = df.withColumn("_norm", _normalised(F.col(text)))
    norm = F.col("_norm")
    df = df.withColumn("n_words", F.when(norm == "  ", F.lit(0)).otherwise(_n_words(norm)).cast("long"))
    gate = " OR ".join(f"contains(_norm, '{w.replace(' ', '  ')}')" for w in TRIGGERS)
    places = F.array_compact(F.array(*(_place(norm, *p) for p in phrases)))
    df = df.withColumns({"places": places, "_found": F.expr(f"CASE WHEN {gate} THEN {_matches(rules)} END")})
    kept = _kept(F.flatten(F.transform("_found", _intervals)))
    df = df.withColumn("_hits", F.when(F.size("_found") > 0, kept).otherwise(F.expr(f"cast(array() as array<{HIT}>)")))
    priority = lambda h: F.element_at(F.array(*(F.lit(p) for p in LEVELS)), 1 - h["over"])
    hits = F.transform("_hits", lambda h: F.struct(h["label"].alias("label"), h["start"].alias("start"), (-h["minus"]).alias("end"), priority(h).alias("priority")))
    return df.withColumn("hits", hits).drop("_norm", "_found", "_hits")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("hits", lambda h: h["label"])
    n_base = F.aggregate("places", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    best = F.greatest(F.coalesce(F.array_max(F.transform("hits", lambda h: h["priority"])), F.lit(0)), F.when(n_base > 0, F.lit(BASE_PRIORITY)).otherwise(F.lit(0)))
    return found.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, own)))).alias("labels"),
        (best / 100).cast("double").alias("score"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = lambda items: ", ".join("(" + ", ".join(quote(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in items)
    rules = rows((r.label, r.priority, r.key.replace(" ", "  "), wide(r.pattern)) for r in RULES)
    base = rows((label, len(phrase.split()), wide(phrase)) for phrase, label in PHRASES)
    spaces = "((length({0}) - length(replace({0}, ' ', ''))) // 2)"
    passed = "coalesce(list_sum(list_transform({0}, lambda x: " + spaces.format("x") + ")), 0)"
    start = f"({passed.format('p[1:i]')} + {passed.format('m[1:i - 1]')})::BIGINT"
    cut = lambda t: f"SELECT *, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS p FROM d JOIN {t} ON contains(t, key)"
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
d AS (SELECT doc_id, len(words) AS n, ' ' || array_to_string(words, '  ') || ' ' AS t FROM w),
rules AS (SELECT * FROM (VALUES {rules}) AS r(label, priority, key, pattern)),
base AS (SELECT label, size, pattern, pattern AS key FROM (VALUES {base}) AS b(label, size, pattern)),
bm AS ({cut('base')}),
bs AS (SELECT doc_id, label, {start} AS lo FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM bm WHERE len(m) > 0)),
b AS (SELECT doc_id, count(*) AS n_base, min(lo) AS first_word, max(lo) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bs GROUP BY doc_id),
rm AS ({cut('rules')}),
rs AS (SELECT doc_id, label, priority, {start} AS lo, {start} + {spaces.format('m[i]')} AS hi FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM rm WHERE len(m) > 0)),
hits AS (SELECT * FROM rs x WHERE NOT EXISTS (SELECT 1 FROM rs y WHERE y.doc_id = x.doc_id AND y.lo <= x.lo AND y.hi >= x.hi AND (y.priority > x.priority OR (y.priority = x.priority AND y.hi - y.lo > x.hi - x.lo)))),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION SELECT doc_id, label FROM bs) GROUP BY doc_id),
s AS (SELECT doc_id, max(priority) AS best FROM hits GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN {BASE_PRIORITY} ELSE 0 END)::DOUBLE / 100 AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


OP9_SQL = _oracle()
