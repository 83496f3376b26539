"""A query for each operator over the supplied tables, through lens views, with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Cooccurrence, Labels, Spectral, TopPairs
from ..functions import columns as C
from ..functions.rows import with_row_id
from ..operators import align, cooccurrence, discretize, enrich, flatten, labels, linking, pairs, scoring, spectral
from ..shared import work_folder
from ..sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lens views: the supplied tables in the shapes of the stages.

CODE = "'C' || lpad(json_extract_string(props, '$.k'), 7, '0')"
MENTIONS = f"""mentions AS (SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS patient_id, {CODE} AS umls_top_cui,
 CASE event_type WHEN 'view' THEN 'present' WHEN 'click' THEN 'historical'
 WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'possible' WHEN 1 THEN 'hypothetical' ELSE 'conditional' END
 WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'associated_with_someone_else' ELSE 'absent' END
 WHEN 'error' THEN 'unclear' END AS assertion_status FROM events)"""
STATUS_SQL = "CASE assertion_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.STATUS.items()) + " END"
MAPPED = f"{MENTIONS}, mapped AS (SELECT *, {STATUS_SQL} AS s FROM mentions WHERE {STATUS_SQL} IS NOT NULL)"


def mentions(spark, sf_dir) -> DataFrame:
    third = F.col("event_id") % 3
    state = (
        F.when(F.col("event_type") == "view", "present")
        .when(F.col("event_type") == "click", "historical")
        .when(F.col("event_type") == "purchase", F.when(third == 0, "possible").when(third == 1, "hypothetical").otherwise("conditional"))
        .when(F.col("event_type") == "signup", F.when(third == 0, "associated_with_someone_else").otherwise("absent"))
        .when(F.col("event_type") == "error", "unclear")
    )
    code = F.concat(F.lit("C"), F.lpad(F.get_json_object("props", "$.k"), 7, "0"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("patient_id"), code.alias("umls_top_cui"), state.alias("assertion_status"))


def statuses(spark, sf_dir) -> DataFrame:
    return discretize.mapped(mentions(spark, sf_dir))


JSONL = """lines AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{broken'
 WHEN event_id % 19 = 0 THEN '{"key":"' || user_id || '-' || (event_id % 7) || '-' || event_id || '"}'
 ELSE '{"key":"' || user_id || '-' || (event_id % 7) || '-' || event_id || '","response":"[{\\"phrase\\":\\"' || event_type || '\\",\\"n\\":' || (event_id % 5) || '},{\\"phrase\\":\\"extra\\"}]"}' END AS value FROM events)"""


def jsonl(spark, sf_dir) -> DataFrame:
    key = F.concat(F.lit('{"key":"'), F.col("user_id"), F.lit("-"), F.col("event_id") % 7, F.lit("-"), F.col("event_id"), F.lit('"'))
    items = F.concat(F.lit(',"response":"[{\\"phrase\\":\\"'), F.col("event_type"), F.lit('\\",\\"n\\":'), F.col("event_id") % 5, F.lit('},{\\"phrase\\":\\"extra\\"}]"}'))
    value = F.when(F.col("event_id") % 17 == 0, "{broken").when(F.col("event_id") % 19 == 0, F.concat(key, F.lit("}"))).otherwise(F.concat(key, items))
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


DICTIONARY = "dictionary AS (SELECT p_partkey AS line_no, 'C' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS cui, p_name AS term, p_type AS semantic_type FROM part)"
LAST = f"{DICTIONARY}, last AS (SELECT term, arg_max(cui, line_no) AS cui, arg_max(semantic_type, line_no) AS semantic_type FROM dictionary GROUP BY term)"


def dictionary(spark, sf_dir) -> DataFrame:
    code = F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), code.alias("cui"), F.col("p_name").alias("term"), F.col("p_type").alias("semantic_type"))


ENTITIES = "entities AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 3 = 0 THEN '  ' || upper(p_name) || ' ' ELSE p_name END AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)"


def entities(spark, sf_dir) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    text = F.when(F.col("l_orderkey") % 11 == 0, "").when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    return line.join(part, line.l_partkey == part.p_partkey).select("l_orderkey", text.alias("entity"))


VECTOR_STATUS = "['PRESENT','ABSENT','HISTORY','FAMILY_HISTORY','UNCERTAIN']"
VECTORS = f"""vectors AS (SELECT vec_id AS row_id, 'C' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS cui, {VECTOR_STATUS}[label % 5 + 1] AS status, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
units AS (SELECT row_id, cui, status, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12)) AS u FROM vectors)"""
SIMS = f"{VECTORS}, sims AS (SELECT a.row_id AS ia, b.row_id AS ib, a.cui AS ca, b.cui AS cb, a.status AS sa, b.status AS sb, round(list_dot_product(a.u, b.u), 6) AS sim FROM units a JOIN units b ON a.row_id <> b.row_id)"


def vectors(spark, sf_dir) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("PRESENT", "ABSENT", "HISTORY", "FAMILY_HISTORY", "UNCERTAIN"))), (F.col("label") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.concat(F.lit("C"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("cui"), state.alias("status"), "embedding")


SCORED = "scored AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 13 = 0 THEN 'n/a' ELSE CAST(n_chars % 101 AS VARCHAR) END AS relationship_score FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)"


def scored(spark, sf_dir) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l")).distinct()
    score = F.when(F.col("l").isNull(), None).when(F.col("doc_id") % 13 == 0, "n/a").otherwise((F.col("n_chars") % 101).cast("string"))
    return docs.join(own, docs.doc_id == own.l, "left").select("doc_id", score.alias("relationship_score"))


# Stage A


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract_props(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"))


FLAT = f"""WITH {JSONL}, good AS (SELECT event_id, json_extract_string(value, '$.key') AS key, json_extract_string(value, '$.response') AS r FROM lines WHERE json_valid(value) AND json_extract_string(value, '$.response') IS NOT NULL),
items AS (SELECT event_id, key, r, unnest(range(json_array_length(r)::BIGINT)) AS item_no FROM good)
SELECT event_id, item_no, key, split_part(key, '-', 1) AS patient_id, split_part(key, '-', 2) AS admission_id, split_part(key, '-', 3) AS message_id,
 json_extract_string(r, '$[' || item_no || '].phrase') AS phrase, json_extract_string(r, '$[' || item_no || '].n') AS n FROM items"""


@query(FLAT)
def flatten_response_items(spark, sf_dir):
    df = flatten.mentions(jsonl(spark, sf_dir))
    return flatten.widened(df, ["n"]).select("event_id", F.col("item_no").cast("long").alias("item_no"), "key", "patient_id", "admission_id", "message_id", "phrase", "n")


@query(f"WITH {JSONL} SELECT event_id, value FROM lines WHERE NOT json_valid(value) OR json_extract_string(value, '$.response') IS NULL")
def reject_malformed_json(spark, sf_dir):
    return flatten.bad_records(jsonl(spark, sf_dir))


@query("SELECT DISTINCT unnest(json_keys(props)) AS name FROM events")
def schema_key_union(spark, sf_dir):
    names = flatten.discovered(table(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("extras")))
    return spark.createDataFrame([(x,) for x in names], "name string")


PARENT = """lines AS (SELECT event_id, '{"key":"1-2-3","response":"[{' || CASE event_id % 3 WHEN 0 THEN '\\"key\\":\\"' || user_id || '-8-7\\",' WHEN 1 THEN '\\"key\\":null,' ELSE '' END || '\\"phrase\\":\\"x\\"}]"}' AS value FROM events)"""


@query(f"WITH {PARENT}, r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(json_extract_string(value, '$.response'), '$[0].key') WHEN 2 THEN json_extract_string(value, '$.key') END AS key FROM lines) SELECT event_id, key, split_part(key, '-', 1) AS patient_id, split_part(key, '-', 3) AS message_id FROM r")
def item_over_parent(spark, sf_dir):
    own = F.concat(F.lit('\\"key\\":\\"'), "user_id", F.lit('-8-7\\",'))
    inner = F.when(F.col("event_id") % 3 == 0, own).when(F.col("event_id") % 3 == 1, '\\"key\\":null,').otherwise("")
    value = F.concat(F.lit('{"key":"1-2-3","response":"[{'), inner, F.lit('\\"phrase\\":\\"x\\"}]"}'))
    lines = table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return flatten.mentions(lines).select("event_id", "key", "patient_id", "message_id")


TYPED = "typed AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS line_no, CASE WHEN p_partkey % 10 = 0 THEN '  ' WHEN p_partkey % 9 = 0 THEN p_name || '||' || p_type ELSE p_brand || '||' || p_type || '||' || p_name END AS value FROM part)"


def _typed(spark, sf_dir) -> str:
    """A file of dictionary lines, some blank or malformed, in the order of the part table."""
    parts = table(spark, sf_dir, "part").orderBy("p_partkey")
    good = F.concat_ws("||", "p_brand", "p_type", "p_name")
    path = work_folder(spark, "lines")
    parts.coalesce(1).select(F.when(F.col("p_partkey") % 10 == 0, "  ").when(F.col("p_partkey") % 9 == 0, F.concat_ws("||", "p_name", "p_type")).otherwise(good).alias("value")).write.text(path)
    return path


@query(f"WITH {TYPED} SELECT value, line_no FROM typed WHERE trim(value) <> ''")
def line_scan(spark, sf_dir):
    return readers.lines(spark, _typed(spark, sf_dir)).select("value", "line_no")


@query(f"WITH {TYPED} SELECT string_split(value, '||')[2] AS term, arg_max(string_split(value, '||')[1], line_no) AS cui, arg_max(string_split(value, '||')[3], line_no) AS semantic_type FROM typed WHERE len(string_split(value, '||')) = 3 GROUP BY 1")
def dictionary_load(spark, sf_dir):
    return linking.last_wins(readers.dictionary_lines(spark, _typed(spark, sf_dir)))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name || ', \"x\" ' || chr(10) || 'y' AS name, CASE WHEN s_suppkey % 7 > 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier")
def csv_round_trip(spark, sf_dir):
    path, s = f"{work_folder(spark, 'csv')}/t.tsv", table(spark, sf_dir, "supplier")
    df = s.select("s_suppkey", F.concat("s_name", F.lit(', "x" \ny')).alias("name"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_nationkey")).alias("nation"))
    writers.delimited(df, path, readers.separator(path), blank=("nation",))
    return readers.delimited(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' é' AS name FROM customer")
def encoding_fallback(spark, sf_dir):
    path = f"{work_folder(spark, 'latin')}/t.csv"
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("name"))
    df.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.delimited(spark, path)


KEYS = "keys AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '-' || o_orderkey WHEN 1 THEN o_custkey || '--' || o_orderkey WHEN 2 THEN o_custkey || '-' || o_orderkey || '-1-2' ELSE o_custkey || '-' || o_orderkey || '-7' END AS key FROM orders)"


@query(f"WITH {KEYS} SELECT o_orderkey, key, CASE WHEN len(string_split(key, '-')) = 3 THEN split_part(key, '-', 1) END AS patient_id, CASE WHEN len(string_split(key, '-')) = 3 THEN split_part(key, '-', 2) END AS admission_id, CASE WHEN len(string_split(key, '-')) = 3 THEN split_part(key, '-', 3) END AS message_id FROM keys")
def key_split_ids(spark, sf_dir):
    cust, order, kind = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey") % 4
    key = F.when(kind == 0, F.concat(cust, F.lit("-"), order)).when(kind == 1, F.concat(cust, F.lit("--"), order)).when(kind == 2, F.concat(cust, F.lit("-"), order, F.lit("-1-2"))).otherwise(F.concat(cust, F.lit("-"), order, F.lit("-7")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    return df.select("o_orderkey", "key", *(c.alias(n) for c, n in zip(C.key_parts(F.col("key")), ("patient_id", "admission_id", "message_id"))))


# Stage B


@query("SELECT p_partkey, concat_ws(' ', nullif(trim(CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE ' ' || p_name END), ''), nullif(trim(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END), '')) AS entity FROM part")
def entity_text(spark, sf_dir):
    phrase = F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name"))
    body = F.when(F.col("p_partkey") % 7 != 0, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", C.entity_text(phrase, body).alias("entity"))


@query("SELECT p_partkey, concat_ws(', ', nullif(trim(p_type), ''), CASE WHEN p_partkey % 3 <> 0 THEN nullif(trim(p_brand), '') END, nullif(trim(CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END), '')) AS note FROM part")
def note_text(spark, sf_dir):
    purpose = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.note_text(F.col("p_type"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), purpose).alias("note"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_partkey, p_name FROM part")
def row_ids(spark, sf_dir):
    return with_row_id(table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey"), folder=work_folder(spark, "rows"))


# Stage N


@query(f"WITH {LAST} SELECT term, cui, semantic_type FROM last")
def dictionary_last_wins(spark, sf_dir):
    return linking.last_wins(dictionary(spark, sf_dir))


@query(f"WITH {ENTITIES}, {LAST} SELECT entity, cui, count(*) AS n FROM entities LEFT JOIN last ON nullif(lower(trim(entity)), '') = lower(term) GROUP BY ALL")
def mention_dedup_backfill(spark, sf_dir):
    found = linking.link(entities(spark, sf_dir), linking.last_wins(dictionary(spark, sf_dir)))
    return found.groupBy("entity", F.col("umls_top_cui").alias("cui")).agg(F.count("*").alias("n"))


PLACES = "places AS (SELECT 'N' || n_nationkey AS cui, n_name AS term FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region)"


@query(f"WITH {PLACES}, t AS (SELECT 'nation' AS file, n_name AS entity FROM nation UNION ALL SELECT 'region', lower(r_name) FROM region) SELECT file, entity, cui AS umls_top_cui, '1.0' AS umls_top_confidence FROM t JOIN places ON lower(term) = lower(entity)")
def link_folder_files(spark, sf_dir):
    folder, n, r = work_folder(spark, "tables"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    writers.delimited(n.select(F.col("n_name").alias("entity")), f"{folder}/in/nation.csv")
    writers.delimited(r.select(F.lower("r_name").alias("entity")), f"{folder}/in/region.csv")
    terms = n.select("n_nationkey", "n_name", F.lit("N")).union(r.select("r_regionkey", "r_name", F.lit("R"))).toDF("no", "term", "kind")
    terms = terms.select("term", F.concat("kind", "no").alias("cui"), F.col("kind").alias("semantic_type"))
    done = linking.link_folder(spark, f"{folder}/in", f"{folder}/out", terms, cache=f"{folder}/cache")
    # once more, with all results there already
    assert done == linking.link_folder(spark, f"{folder}/in", f"{folder}/out", terms, skip_existing=True)
    each = [readers.delimited(spark, p).select(F.lit(p.split("/")[-1].split(".")[0]).alias("file"), "entity", "umls_top_cui", F.round(F.col("umls_top_confidence").cast("double"), 6).cast("string").alias("umls_top_confidence")) for p in done]
    return each[0].union(each[1])


LINKED = f"""WITH {VECTORS}, s AS (SELECT q.cui AS query, d.cui AS term, round(list_dot_product(q.u, d.u), 6) AS score FROM units q JOIN units d ON q.row_id % 2 = 1 AND d.row_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, term) AS rank FROM s)
SELECT query, term, score, rank, score < 0.35 AS below FROM r WHERE rank <= 3 AND (score >= 0.35 OR rank = 1)"""


@query(LINKED)
def link_exact_topk(spark, sf_dir):
    v = vectors(spark, sf_dir).select("row_id", "cui", C.unit(F.col("embedding")).alias("vector"))
    found = linking.nearest_terms(v.where("row_id % 2 = 1").withColumnRenamed("cui", "query"), v.where("row_id % 2 = 0").withColumnRenamed("cui", "term"), 3, 6)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("c"))
    kept = lists.select("query", F.explode(linking.kept(F.col("c"), 0.35)).alias("x"))
    return kept.select("query", "x.term", "x.score", F.col("x.rank").cast("long").alias("rank"), (F.col("x.score") < 0.35).alias("below"))


@query()
def link_text_ngram(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit("s")).alias("entity"))
    return linking.link(names, linking.last_wins(dictionary(spark, sf_dir)))


@query()
def ann_cells_topk(spark, sf_dir):
    v = vectors(spark, sf_dir).select("row_id", "cui", C.unit(F.col("embedding")).alias("vector"))
    # one more than wanted, as a row finds itself
    found = linking.cell_terms(v.where("row_id % 20 = 0").withColumnRenamed("cui", "query"), v.withColumnRenamed("cui", "term"), 11, probes=64)
    order = Window.partitionBy("query").orderBy("rank")
    return found.where("query <> term").withColumn("rank", F.row_number().over(order)).where("rank <= 10")


# Stage C


@query("SELECT o_custkey AS patient_id, c_mktsegment AS umls_top_cui FROM orders JOIN customer ON o_orderkey = c_custkey")
def align_inner_one_to_one(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("umls_top_cui"))
    return align.by_id(left, right).select("patient_id", "umls_top_cui")


@query("SELECT coalesce(o_orderkey, c_custkey) AS row_id, o_orderstatus, c_name FROM orders FULL JOIN customer ON o_orderkey = c_custkey")
def align_positional(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return align.by_position(left, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_name"))


# Stage D


@query(f"WITH {MAPPED} SELECT row_id, s AS assertion_status_norm FROM mapped")
def status_map(spark, sf_dir):
    return statuses(spark, sf_dir).select("row_id", "assertion_status_norm")


PIVOT = ", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in discretize.STATUSES)


@query(f"WITH {MAPPED} SELECT umls_top_cui, {PIVOT} FROM mapped WHERE umls_top_cui IS NOT NULL GROUP BY umls_top_cui")
def status_counts_pivot(spark, sf_dir):
    return discretize.pivoted(statuses(spark, sf_dir))


SUPPORTED = f"{MAPPED}, kept AS (SELECT umls_top_cui FROM (SELECT umls_top_cui, s, count(*) AS n FROM mapped GROUP BY ALL) GROUP BY umls_top_cui HAVING max(n) >= 10), supported AS (SELECT patient_id, umls_top_cui, s FROM mapped WHERE umls_top_cui IN (SELECT umls_top_cui FROM kept))"


@query(f"WITH {SUPPORTED} SELECT patient_id, umls_top_cui, s AS assertion_status_norm, count(*) AS n FROM supported GROUP BY ALL")
def min_support_filter(spark, sf_dir):
    return discretize.supported(statuses(spark, sf_dir), 10).groupBy("patient_id", "umls_top_cui", "assertion_status_norm").agg(F.count("*").alias("n"))


# Stage E


def _tokens_sql(where: str = "true", cap: int = 0) -> str:
    base = f"raw AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS patient, {CODE} AS cui, upper(trim(event_type)) AS status FROM events), named AS (SELECT *, cui || '||' || status AS token FROM raw WHERE {where})"
    if cap:
        return f"{base}, toks AS (SELECT patient, cui, status, token FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY token) AS n FROM named) WHERE n <= {cap})"
    return f"{base}, toks AS (SELECT * FROM named)"


def _vocab_sql(least: int = 1) -> str:
    return f"vocab AS (SELECT row_number() OVER (ORDER BY token) - 1 AS idx, token, cui, status, n AS patient_count FROM (SELECT token, cui, status, count(*) AS n FROM toks GROUP BY ALL) WHERE n >= {least})"


def _pairs_sql(least: int = 1) -> str:
    return f"ids AS (SELECT patient, idx FROM toks JOIN vocab USING (token)), prs AS (SELECT a.idx AS i, b.idx AS j, count(*) AS c FROM ids a JOIN ids b ON a.patient = b.patient AND a.idx < b.idx GROUP BY ALL HAVING count(*) >= {least})"


SYM = "sym AS (SELECT i, j, c FROM prs UNION ALL SELECT j, i, c FROM prs), marg AS (SELECT i, CAST(sum(c) AS BIGINT) AS r FROM sym GROUP BY i)"
PPMI = f"{SYM}, full_ppmi AS (SELECT prs.i, prs.j, c, ln(c::DOUBLE * (SELECT sum(r) FROM marg)::DOUBLE / (a.r::DOUBLE * b.r::DOUBLE)) AS v FROM prs JOIN marg a ON prs.i = a.i JOIN marg b ON prs.j = b.i)"
PPMI_ROWS = "SELECT a.token AS token_a, b.token AS token_b, c, round(v, 6) AS ppmi FROM full_ppmi JOIN vocab a ON a.idx = i JOIN vocab b ON b.idx = j WHERE round(v, 6) > 0"


def _raw(spark, sf_dir) -> DataFrame:
    code = F.concat(F.lit("C"), F.lpad(F.get_json_object("props", "$.k"), 7, "0"))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("patient_id"), code.alias("umls_top_cui"), F.col("event_type").alias("assertion_status_norm"))


def _tokens(spark, sf_dir, **cfg) -> tuple[DataFrame, Cooccurrence]:
    own = Cooccurrence(**cfg)
    return cooccurrence.tokens(_raw(spark, sf_dir), own), own


def _counted(spark, sf_dir, **cfg) -> tuple[DataFrame, DataFrame]:
    toks, own = _tokens(spark, sf_dir, **cfg)
    vocab = cooccurrence.vocabulary(toks, own)
    return cooccurrence.pair_counts(toks, vocab, own), vocab


def _ppmi(spark, sf_dir, **cfg) -> DataFrame:
    counted, vocab = _counted(spark, sf_dir, **cfg)
    name = lambda i, out: vocab.select(F.col("idx").alias(i), F.col("token").alias(out))
    df = cooccurrence.ppmi(counted).join(name("i", "token_a"), "i").join(name("j", "token_b"), "j")
    return df.select("token_a", "token_b", "c", F.round("v", 6).alias("ppmi")).where("ppmi > 0")


@query(f"WITH {_tokens_sql()} SELECT patient, cui, status, token FROM toks")
def patient_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir)[0].select("patient", "cui", "status", "token")


@query(f"WITH {_tokens_sql(cap=5)} SELECT patient, token FROM toks")
def patient_token_cap(spark, sf_dir):
    return _tokens(spark, sf_dir, cap=5)[0].select("patient", "token")


@query(f"WITH {_tokens_sql()}, {_vocab_sql(3)} SELECT token, patient_count FROM vocab")
def token_support(spark, sf_dir):
    toks, cfg = _tokens(spark, sf_dir, min_patients=3)
    return cooccurrence.vocabulary(toks, cfg).select("token", "patient_count")


@query(f"WITH {_tokens_sql()}, {_vocab_sql()} SELECT idx, token, cui, status, patient_count FROM vocab")
def token_vocab(spark, sf_dir):
    return cooccurrence.vocabulary(*_tokens(spark, sf_dir))


@query(f"WITH {_tokens_sql()}, {_vocab_sql()} SELECT token, string_split(token, '||')[1] AS cui, string_split(token, '||')[2] AS status FROM vocab")
def token_split(spark, sf_dir):
    df = cooccurrence.vocabulary(*_tokens(spark, sf_dir)).select("token")
    return df.select("token", *(c.alias(n) for c, n in zip(C.token_parts(F.col("token")), ("cui", "status"))))


@query(f"WITH {_tokens_sql()}, {_vocab_sql()}, {_pairs_sql()} SELECT i, j, c FROM prs")
def cooccurrence_counts(spark, sf_dir):
    return _counted(spark, sf_dir)[0]


@query(f"WITH {_tokens_sql()}, {_vocab_sql()}, {_pairs_sql()}, {SYM} SELECT i, j, c FROM sym")
def cooccurrence_symmetric(spark, sf_dir):
    return cooccurrence.symmetric(_counted(spark, sf_dir)[0])


@query(f"WITH {_tokens_sql()}, {_vocab_sql()}, {_pairs_sql()}, {SYM} SELECT i, r FROM marg")
def cooccurrence_marginals(spark, sf_dir):
    return cooccurrence.marginals(_counted(spark, sf_dir)[0])


@query(f"WITH {_tokens_sql()}, {_vocab_sql()}, {_pairs_sql()}, {PPMI} {PPMI_ROWS}")
def ppmi_pairs(spark, sf_dir):
    return _ppmi(spark, sf_dir)


@query(f"WITH {_tokens_sql(chr(115) + 'tatus = ' + repr('VIEW'))}, {_vocab_sql()}, {_pairs_sql()}, {PPMI} {PPMI_ROWS}")
def ppmi_one_status(spark, sf_dir):
    return _ppmi(spark, sf_dir, statuses=("VIEW",))


@query(f"WITH {_tokens_sql()}, {_vocab_sql()}, {_pairs_sql(3)}, {PPMI} {PPMI_ROWS}")
def ppmi_min_cooccur(spark, sf_dir):
    return _ppmi(spark, sf_dir, min_cooccur=3)


# Stage F

MATRIX = f"WITH {_tokens_sql()}, {_vocab_sql()}, {_pairs_sql()}, {PPMI}, upper_m AS (SELECT i, j, v FROM full_ppmi WHERE v > 0)"


def _upper(spark, sf_dir) -> DataFrame:
    return cooccurrence.ppmi(_counted(spark, sf_dir)[0]).select("i", "j", "v")


@query(f"{MATRIX} SELECT i, j, round(v, 6) AS v FROM upper_m WHERE v >= 1.5")
def matrix_threshold(spark, sf_dir):
    return spectral.prepared(_upper(spark, sf_dir), Spectral(threshold=1.5, drop_diagonal=False, symmetrize=False)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"{MATRIX} SELECT i, j, round(v, 6) AS v FROM upper_m WHERE i <> j")
def matrix_drop_diagonal(spark, sf_dir):
    return spectral.prepared(_upper(spark, sf_dir), Spectral(symmetrize=False)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"{MATRIX} SELECT i, j, round(sum(v) / 2, 6) AS v FROM (SELECT i, j, v FROM upper_m UNION ALL SELECT j, i, v FROM upper_m) GROUP BY i, j")
def matrix_symmetrize(spark, sf_dir):
    return spectral.prepared(_upper(spark, sf_dir)).select("i", "j", F.round("v", 6).alias("v"))


def _matrix(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    counted, vocab = _counted(spark, sf_dir)
    return cooccurrence.symmetric(cooccurrence.ppmi(counted), "v"), vocab


@query()
def eig_topk(spark, sf_dir):
    m, vocab = _matrix(spark, sf_dir)
    values, _ = spectral.top_eigenpairs(spectral.prepared(m), vocab.count(), Spectral().k, folder=work_folder(spark, "eigen"))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "rank int, eigenvalue double")


@query()
def spectral_embeddings(spark, sf_dir):
    m, vocab = _matrix(spark, sf_dir)
    return spectral.embeddings(m, vocab).select("token", "embedding")


# Stage G


@query(f"WITH {VECTORS} SELECT row_id, i, round(u[i], 6) AS x FROM (SELECT row_id, u, unnest(range(1, len(u) + 1)) AS i FROM units)")
def l2_normalize(spark, sf_dir):
    df = vectors(spark, sf_dir).select("row_id", F.posexplode(C.unit(F.col("embedding"))).alias("i", "x"))
    return df.select("row_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT p_partkey, trim(CASE p_partkey % 4 WHEN 3 THEN p_name ELSE p_name END) AS cui, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_brand || '||' || p_type ELSE 'PRESENT' END AS status FROM part")
def token_parse_default(spark, sf_dir):
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    text = F.when(kind == 0, F.concat(name, F.lit("||"), "p_brand")).when(kind == 1, F.concat(name, F.lit("|"), "p_type")).when(kind == 2, F.concat(name, F.lit("||"), "p_brand", F.lit("||"), "p_type")).otherwise(name)
    cui, state = C.token_parts(text)
    return table(spark, sf_dir, "part").select("p_partkey", cui.alias("cui"), F.coalesce(F.nullif(state, F.lit("")), F.lit("PRESENT")).alias("status"))


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY sa, sb ORDER BY sim DESC, ia, ib) AS rk FROM {0})"
TOP = "SELECT ca AS a_cui, sa AS a_assertion_status, cb AS b_cui, sb AS b_assertion_status, sim AS cosine_similarity, sa || '~' || sb AS config FROM r WHERE rk <= CASE WHEN sa = 'PRESENT' AND sb = 'PRESENT' THEN {0} ELSE {1} END"


@query(f"WITH {SIMS}, {RANKED.format('sims')} {TOP.format(100, 10)}")
def topk_pairs_by_config(spark, sf_dir):
    return pairs.top_pairs(vectors(spark, sf_dir), TopPairs())


@query(f"WITH {SIMS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ia, sb ORDER BY sim DESC, ib) AS k FROM sims) WHERE k <= 2), {RANKED.format('near')} {TOP.format(100, 10)}")
def topk_pairs_ksearch(spark, sf_dir):
    return pairs.top_pairs(vectors(spark, sf_dir), TopPairs(k_search=2))


# Stage H

BOOK = """linked AS (SELECT p_partkey AS row_id, p_brand AS umls_top_cui, p_name AS umls_top_term, p_type AS umls_top_semantic_type, CASE WHEN p_partkey % 9 = 0 THEN 'bad' ELSE CAST(p_size % 10 AS VARCHAR) END AS conf FROM part),
book AS (SELECT umls_top_cui AS cui, umls_top_term AS term, umls_top_semantic_type AS semantic_type FROM (SELECT *, row_number() OVER (PARTITION BY umls_top_cui ORDER BY coalesce(TRY_CAST(conf AS DOUBLE), -1) DESC, row_id) AS n FROM linked) WHERE n = 1)"""


def _book(spark, sf_dir) -> DataFrame:
    conf = F.when(F.col("p_partkey") % 9 == 0, "bad").otherwise((F.col("p_size") % 10).cast("string"))
    return enrich.codebook(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("umls_top_cui"), F.col("p_name").alias("umls_top_term"), F.col("p_type").alias("umls_top_semantic_type"), conf.alias("umls_top_confidence")))


BRANDS = "prs AS (SELECT 'Brand#' || (s_suppkey % 40) AS a_cui, CASE WHEN s_suppkey % 2 = 0 THEN 'PRESENT' ELSE 'ABSENT' END AS a_assertion_status, 'Brand#' || (s_nationkey * 2) AS b_cui, 'PRESENT' AS b_assertion_status, s_acctbal AS cosine_similarity FROM supplier)"


def _brands(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 40).alias("a_cui"), F.when(F.col("s_suppkey") % 2 == 0, "PRESENT").otherwise("ABSENT").alias("a_assertion_status"), F.concat(F.lit("Brand#"), F.col("s_nationkey") * 2).alias("b_cui"), F.lit("PRESENT").alias("b_assertion_status"), F.col("s_acctbal").alias("cosine_similarity"), F.lit("x").alias("config"))


@query(f"WITH {BOOK} SELECT cui, term, semantic_type FROM book")
def codebook_best(spark, sf_dir):
    return _book(spark, sf_dir)


ENRICHED = f"""WITH {BOOK}, {BRANDS}, e AS (SELECT row_number() OVER (ORDER BY a_assertion_status, b_assertion_status, cosine_similarity DESC, a_cui, b_cui) AS pair_id, * FROM prs),
full_e AS (SELECT pair_id, a_cui, a.term AS a_term, a.semantic_type AS a_semantic_type, a_assertion_status, b_cui, b.term AS b_term, b.semantic_type AS b_semantic_type, b_assertion_status FROM e LEFT JOIN book a ON a_cui = a.cui LEFT JOIN book b ON b_cui = b.cui)"""


@query(f"{ENRICHED} SELECT * FROM full_e")
def enrich_pairs(spark, sf_dir):
    return enrich.enriched(_brands(spark, sf_dir), _book(spark, sf_dir))


@query(f"{ENRICHED} SELECT count(*) FILTER (a_term IS NULL) AS a_unmapped, count(*) FILTER (b_term IS NULL) AS b_unmapped, count(*) AS pairs FROM full_e")
def unmapped_counts(spark, sf_dir):
    return enrich.unmapped(enrich.enriched(_brands(spark, sf_dir), _book(spark, sf_dir)))


# Stage I

WORDS = "['Family History', 'FAMILY-HISTORY', 'UNCERTAIN', 'negative', '', NULL, ' denied ', 'pos', 'FH', 'History', 'If']"
ASSERTION_SQL = "coalesce(CASE replace(replace(lower(trim(raw)), '-', '_'), ' ', '_') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ASSERTION.items()) + " END, 'unknown')"


@query(f"SELECT event_id, {ASSERTION_SQL} AS status FROM (SELECT event_id, {WORDS}[event_id % 11 + 1] AS raw FROM events)")
def assertion_normalize(spark, sf_dir):
    words = ("Family History", "FAMILY-HISTORY", "UNCERTAIN", "negative", "", None, " denied ", "pos", "FH", "History", "If")
    raw = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.assertion(raw).alias("status"))


def _records(spark, sf_dir) -> DataFrame:
    return scoring.records(enrich.enriched(_brands(spark, sf_dir), _book(spark, sf_dir)))


LOW = "CASE {0} WHEN 'PRESENT' THEN 'present' WHEN 'ABSENT' THEN 'absent' END"
PROMPT = "'Concept A: ' || coalesce(a_term, '') || ' (' || a_cui || '), type ' || coalesce(a_semantic_type, '') || ', status ' || " + LOW.format("a_assertion_status") + " || chr(10) || 'Concept B: ' || coalesce(b_term, '') || ' (' || b_cui || '), type ' || coalesce(b_semantic_type, '') || ', status ' || " + LOW.format("b_assertion_status") + " || chr(10) || 'How strongly are A and B related?'"


@query(f"{ENRICHED} SELECT CAST(pair_id AS VARCHAR) AS pair_id, {PROMPT} AS prompt FROM full_e")
def pair_prompts(spark, sf_dir):
    return _records(spark, sf_dir).select("pair_id", scoring.prompt().alias("prompt"))


@query(f"{ENRICHED} SELECT CAST(pair_id AS VARCHAR) AS custom_id, 'POST' AS method, 'offline-rules' AS model, {PROMPT} AS content FROM full_e")
def batch_requests(spark, sf_dir):
    v = F.parse_json("value")
    get = lambda path: F.variant_get(v, path, "string")
    return scoring.batch_requests(_records(spark, sf_dir)).select(get("$.custom_id").alias("custom_id"), get("$.method").alias("method"), get("$.body.model").alias("model"), get("$.body.messages[1].content").alias("content"))


CANNED = """canned AS (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, CASE WHEN turn % 3 = 0 THEN '{"relationship_score": ' || (conv_id % 101) || ', "has_medical_relationship": true, "confidence": 0.5, "rationale": "' || role || '", "linking_conditions": ["x", "y"], "assertion_adjustment": "not_applicable"}'
 WHEN turn % 3 = 1 THEN '{' ELSE '[1, 2]' END AS content, conv_id, turn FROM conversations)"""


def _canned(spark, sf_dir) -> DataFrame:
    good = F.concat(F.lit('{"relationship_score": '), F.col("conv_id") % 101, F.lit(', "has_medical_relationship": true, "confidence": 0.5, "rationale": "'), "role", F.lit('", "linking_conditions": ["x", "y"], "assertion_adjustment": "not_applicable"}'))
    content = F.when(F.col("turn") % 3 == 0, good).when(F.col("turn") % 3 == 1, "{").otherwise("[1, 2]")
    return table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), "turn").alias("id"), content.alias("content"), "conv_id", "turn")


@query(f"""WITH {CANNED} SELECT id, CASE WHEN turn % 3 = 0 THEN CAST(conv_id % 101 AS VARCHAR) ELSE '' END AS relationship_score, CASE WHEN turn % 3 = 0 THEN 'true' ELSE '' END AS has_medical_relationship,
 CASE WHEN turn % 3 = 0 THEN '0.5' ELSE '' END AS confidence, CASE WHEN turn % 3 = 0 THEN json_extract_string(content, '$.assertion_adjustment') ELSE '' END AS assertion_adjustment, CASE WHEN turn % 3 = 0 THEN json_extract_string(content, '$.rationale') ELSE '' END AS rationale,
 CASE WHEN turn % 3 = 0 THEN 'x;y' ELSE '' END AS linking_conditions FROM canned""")
def parse_responses(spark, sf_dir):
    return _canned(spark, sf_dir).withColumn("x", scoring.parsed(F.col("content"))).select("id", *scoring.fields(F.col("x")))


@query(f"WITH {CANNED} SELECT id AS pair_id, CASE WHEN conv_id % 5 = 0 THEN 'error' WHEN conv_id % 5 = 1 THEN 'missing' WHEN conv_id % 5 = 2 THEN 'error' WHEN turn % 3 = 0 THEN 'ok' ELSE 'bad_json' END AS status FROM canned GROUP BY ALL")
def result_precedence(spark, sf_dir):
    own = _canned(spark, sf_dir).dropDuplicates(["id"])
    outputs = own.where("conv_id % 5 <> 1").select(F.col("id").alias("custom_id"), "content", F.when(F.col("conv_id") % 5 == 2, "limit").alias("error"))
    errors = own.where("conv_id % 5 = 0").select(F.col("id").alias("custom_id"), F.lit("failed").alias("error"))
    return scoring.batch_results(own.select(F.col("id").alias("pair_id")), outputs, errors).select("pair_id", "status")


SIDE_SQL = ", ".join(f"{x}_cui, coalesce({x}_term, '') AS {x}_term, coalesce({x}_semantic_type, '') AS {x}_semantic_type, {LOW.format(x + '_assertion_status')} AS {x}_assertion_status" for x in "ab")
RULED = f"""{ENRICHED}, sides AS (SELECT CAST(pair_id AS VARCHAR) AS pair_id, {SIDE_SQL} FROM full_e),
words AS (SELECT *, list_distinct(regexp_extract_all(lower(a_term), '\\S+')) AS wa, list_distinct(regexp_extract_all(lower(b_term), '\\S+')) AS wb, a_assertion_status = 'absent' OR b_assertion_status = 'absent' AS denied FROM sides),
based AS (SELECT *, list_sort(list_intersect(wa, wb)) AS shared, 20 + 60 * len(list_intersect(wa, wb)) // greatest(1, len(list_distinct(list_concat(wa, wb)))) + CASE WHEN a_semantic_type = b_semantic_type THEN 20 ELSE 0 END AS base FROM words),
ruled AS (SELECT *, CASE WHEN denied THEN base // 2 ELSE base END AS score, CASE WHEN denied THEN 'downgraded_due_to_absence_or_negation' ELSE 'not_applicable' END AS adjust FROM based),
answers AS (SELECT *, '{{"relationship_score": ' || score || ', "has_medical_relationship": ' || CASE WHEN score >= 50 THEN 'true' ELSE 'false' END || ', "confidence": 0.5, "rationale": "shared words and types", "linking_conditions": [' || array_to_string(list_transform(shared[1:5], lambda w: '"' || w || '"'), ', ') || '], "assertion_adjustment": "' || adjust || '"}}' AS response_json FROM ruled)"""


@query(f"""{RULED} SELECT pair_id, a_cui, a_term, a_semantic_type, a_assertion_status, b_cui, b_term, b_semantic_type, b_assertion_status, CAST(score AS VARCHAR) AS relationship_score, CASE WHEN score >= 50 THEN 'true' ELSE 'false' END AS has_medical_relationship,
 '0.5' AS confidence, adjust AS assertion_adjustment, 'shared words and types' AS rationale, array_to_string(shared[1:5], ';') AS linking_conditions, 'ok' AS status, '' AS error_type, '' AS error_message, response_json FROM answers""")
def score_pairs_offline(spark, sf_dir):
    return scoring.scored(_records(spark, sf_dir)).drop("request_json")


@query(f"{RULED} SELECT pair_id, response_json AS response_raw FROM answers")
def audit_lines(spark, sf_dir):
    v = F.parse_json("value")
    return scoring.audit(scoring.scored(_records(spark, sf_dir))).select(F.variant_get(v, "$.pair_id", "string").alias("pair_id"), F.variant_get(v, "$.response_raw", "string").alias("response_raw"))


@query(f"{ENRICHED} SELECT CASE WHEN pair_id % 3 = 0 THEN 'p' || lpad(CAST(pair_id AS VARCHAR), 6, '0') ELSE CAST(pair_id AS VARCHAR) END AS pair_id, a_cui, b_cui FROM full_e")
def record_ids(spark, sf_dir):
    rows = enrich.enriched(_brands(spark, sf_dir), _book(spark, sf_dir)).orderBy("pair_id")
    return scoring.records(rows.withColumn("pair_id", F.when(F.col("pair_id") % 3 > 0, F.col("pair_id")))).select("pair_id", "a_cui", "b_cui")


class _Service:
    """A batch service that needs three looks, answers even ids, fails those of ten and misses the other odd ones."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.looks = spark, folder, 0

    def upload(self, path: str) -> str:
        ids = self.spark.read.text(path).select(F.variant_get(F.parse_json("value"), "$.custom_id", "string").alias("custom_id")).withColumn("n", F.col("custom_id").cast("int"))
        writers.json_lines(ids.where("n % 2 = 0").select("custom_id", F.lit('{"relationship_score": 7}').alias("content")), f"{self.folder}/outputs")
        writers.json_lines(ids.where("n % 10 = 0").select("custom_id", F.lit("refused").alias("error")), f"{self.folder}/errors")
        return path

    def create(self, file_id: str, window: str) -> str:
        return "batch"

    def status(self, batch_id: str) -> str:
        self.looks += 1
        return "completed" if self.looks > 2 else "in_progress"

    def outputs(self, batch_id: str) -> str:
        return f"{self.folder}/outputs"

    def errors(self, batch_id: str) -> str:
        return f"{self.folder}/errors"


@query(f"""{ENRICHED}, s AS (SELECT CAST(pair_id AS VARCHAR) AS pair_id, CASE WHEN pair_id % 10 = 0 THEN 'error' WHEN pair_id % 2 = 1 THEN 'missing' ELSE 'ok' END AS status FROM full_e)
SELECT row_number() OVER (ORDER BY pair_id) AS place, pair_id, status, CASE WHEN status = 'ok' THEN '7' ELSE '' END AS relationship_score, CASE WHEN status = 'error' THEN 'refused' ELSE '' END AS error_message FROM s""")
def batch_run(spark, sf_dir):
    folder = work_folder(spark, "batch")
    out = scoring.run_batch(_records(spark, sf_dir), _Service(spark, folder), folder, wait=lambda s: None)
    return with_row_id(out.select("pair_id", "status", "relationship_score", "error_message"), "place")


# Stage J

NUM = "TRY_CAST(relationship_score AS DOUBLE)"


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN {NUM} >= 60 THEN 'TRUE' WHEN {NUM} < 60 THEN 'FALSE' END AS has_medical_relationship_cutoff, CASE WHEN {NUM} >= 60 THEN 'positive' WHEN {NUM} < 60 THEN 'negative' END AS relationship_label_cutoff FROM scored")
def label_binary(spark, sf_dir):
    return labels.labelled(scored(spark, sf_dir), Labels(mode="binary", threshold=60)).drop("relationship_score")


def _tri(label: str, flag: str) -> str:
    return f"CASE WHEN {NUM} IS NULL THEN '{label}' WHEN {NUM} <= 50 THEN 'negative' WHEN {NUM} >= 85 THEN 'positive' ELSE 'uncertain' END AS relationship_label_cutoff, CASE WHEN {NUM} IS NULL THEN '{flag}' WHEN {NUM} <= 50 THEN 'FALSE' WHEN {NUM} >= 85 THEN 'TRUE' ELSE '' END AS has_medical_relationship_cutoff"


@query(f"WITH {SCORED} SELECT doc_id, {_tri('uncertain', '')} FROM scored")
def label_tristate(spark, sf_dir):
    return labels.labelled(scored(spark, sf_dir)).drop("relationship_score")


@query(f"WITH {SCORED} SELECT doc_id, {_tri('positive', 'TRUE')} FROM scored")
def label_tristate_refnull(spark, sf_dir):
    return labels.labelled(scored(spark, sf_dir), Labels(null_scores="reference")).drop("relationship_score")


def _profile(x: str) -> str:
    return f"count(*) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS p75, max({x}) AS max"


@query(f"WITH {SCORED} SELECT {_profile(NUM)} FROM scored WHERE {NUM} IS NOT NULL")
def score_summary(spark, sf_dir):
    df = labels.summary(scored(spark, sf_dir))
    return df.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH {SCORED}, l AS (SELECT {_tri('uncertain', '')} FROM scored) SELECT relationship_label_cutoff AS label, count(*) AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM l), 6) AS percent FROM l GROUP BY relationship_label_cutoff")
def label_distribution(spark, sf_dir):
    df = labels.distribution(labels.labelled(scored(spark, sf_dir)))
    return df.withColumn("percent", F.round("percent", 6))


@query("SELECT count(*) AS samples, round(avg(value), 6) AS avg_util, max(value) AS max_util, max(event_id) AS max_mem, round(avg(value / 2), 6) AS avg_power, max(value / 2) AS max_power, round(avg(user_id), 6) AS avg_temp, max(user_id) AS max_temp FROM events")
def telemetry_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("util"), F.col("event_id").alias("mem_used"), (F.col("value") / 2).alias("power"), F.col("user_id").alias("temp"))
    return labels.telemetry(e).withColumns({c: F.round(c, 6) for c in ("avg_util", "avg_power", "avg_temp")})


@query()
def pipeline_end_to_end(spark, sf_dir):
    from ..config import Pipeline
    from .pipeline import Run, from_mentions

    run = Run(spark, work_folder(spark), Pipeline(strict=True))
    own = mentions(spark, sf_dir).withColumns({"semantic_type": F.lit("t"), "value": F.lit(None).cast("string"), "unit": F.lit(None).cast("string")})
    book = dictionary(spark, sf_dir).select("cui", "term", "semantic_type")
    return from_mentions(run, own, book)


# Files of the stages, written and read back


@query(f"WITH {MAPPED} SELECT s AS status, count(DISTINCT (patient_id, umls_top_cui)) AS n FROM mapped WHERE s IN ('ABSENT', 'HISTORY') AND umls_top_cui IS NOT NULL AND patient_id IS NOT NULL GROUP BY s")
def status_filter_parse(spark, sf_dir):
    cfg = Cooccurrence(statuses=Cooccurrence.parse_statuses(" absent ,History,"))
    return cooccurrence.tokens(statuses(spark, sf_dir), cfg).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {MAPPED} SELECT umls_top_cui AS cui, count(DISTINCT patient_id) AS patients FROM mapped WHERE s = 'PRESENT' AND umls_top_cui IS NOT NULL AND patient_id IS NOT NULL GROUP BY 1")
def present_only(spark, sf_dir):
    return cooccurrence.tokens(statuses(spark, sf_dir), Cooccurrence(present_only=True, statuses=("ABSENT",))).groupBy("cui").agg(F.count("*").alias("patients"))


@query(f"WITH {_tokens_sql()}, {_vocab_sql()} SELECT CAST(idx AS VARCHAR) AS idx, token, cui, status, CAST(patient_count AS VARCHAR) AS patient_count FROM vocab")
def vocab_sink(spark, sf_dir):
    return readers.delimited(spark, writers.vocabulary(_counted(spark, sf_dir)[1], f"{work_folder(spark, 'vocab')}/m"))


@query(f"{MATRIX} SELECT i, j, round(v, 6) AS v FROM upper_m")
def matrix_sink(spark, sf_dir):
    path = f"{work_folder(spark, 'matrix')}/m"
    writers.matrix(_upper(spark, sf_dir), path)
    return spark.read.parquet(path).select("i", "j", F.round("v", 6).alias("v"))


@query("SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def embedding_columns(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = f"{work_folder(spark, 'wide')}/e"
    writers.wide(e, "embedding", e.agg(F.max(F.size("embedding"))).first()[0]).write.parquet(path)
    back = writers.gathered(spark.read.parquet(path))
    return back.select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "x")


@query(f"WITH {SIMS}, {RANKED.format('sims')}, top AS ({TOP.format(100, 10)}) SELECT row_number() OVER (ORDER BY a_assertion_status, b_assertion_status, cosine_similarity DESC, a_cui, b_cui) + 1 AS line_no, a_cui, b_cui, config FROM top")
def pairs_file_order(spark, sf_dir):
    path = f"{work_folder(spark, 'pairs')}/p.csv"
    # one file: the result of a top-k, whose size is set by its limits
    writers.delimited(pairs.sorted_pairs(pairs.top_pairs(vectors(spark, sf_dir), TopPairs())).coalesce(1), path)
    part = F.split("value", ",")
    return readers.lines(spark, path).where("line_no > 1").select("line_no", part[0].alias("a_cui"), part[2].alias("b_cui"), part[5].alias("config"))
