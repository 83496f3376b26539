"""Scoring of pairs by a pluggable scorer: requests, calls with retries, batch files, results."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions.columns import assertion, filled, stripped
from ..functions.rows import ranked_id, require, require_unique, with_row_id

SIDES = [f"{s}_{c}" for s in "ab" for c in ("cui", "term", "semantic_type", "assertion_status")]
ASSESSMENT = "relationship_score int, has_medical_relationship boolean, confidence double, rationale string, linking_conditions array<string>, assertion_adjustment string"
# The adjustments an answer may name.
ADJUSTMENTS = ["not_applicable", "downgraded_due_to_absence_or_negation", "downgraded_due_to_uncertainty", "conditional_on_presence", "conditional_on_current_use", "conditional_on_diagnosis_status"]
# The form of an answer, its fields and their limits.
ANSWER_FORM = {
    "type": "json_schema",
    "json_schema": {
        "name": "relationship_assessment",
        "schema": {
            "type": "object",
            "additionalProperties": False,
            "required": ["relationship_score", "has_medical_relationship", "confidence", "rationale", "linking_conditions", "assertion_adjustment"],
            "properties": {
                "relationship_score": {"type": "integer", "minimum": 0, "maximum": 100},
                "has_medical_relationship": {"type": "boolean"},
                "confidence": {"type": "number", "minimum": 0, "maximum": 1},
                "rationale": {"type": "string"},
                "linking_conditions": {"type": "array", "items": {"type": "string"}, "maxItems": 5},
                "assertion_adjustment": {"type": "string", "enum": ADJUSTMENTS},
            },
        },
    },
}
GUIDE = "Rate how strongly two clinical concepts are related, from 0 (none) to 100 (certain). Take each concept's status into account. Answer in the given JSON form."


def records(df: DataFrame, names: dict[str, str] | None = None, need_status: bool = True) -> DataFrame:
    """pair_id and the eight fields as stripped text, statuses in the prompt vocabulary.

    names: our column to the input's. A blank id becomes p000001 and so on by the row's number (column row_id where
    given, else its place in the input); a blank concept code fails.
    """
    names = {c: (names or {}).get(c, c) for c in ("pair_id", *SIDES)}
    wanted = [c for c in SIDES if need_status or not c.endswith("assertion_status")]
    require(df, *(names[c] for c in wanted))
    df = ranked_id(df, "row_id", name="_number") if "row_id" in df.columns else with_row_id(df, "_number")
    number = F.col("_number")
    given = filled(F.col(names["pair_id"]).cast("string")) if names["pair_id"] in df.columns else F.lit(None).cast("string")
    get = lambda c: stripped(F.col(names[c]).cast("string")) if names[c] in df.columns else F.lit("")
    columns = [F.coalesce(given, F.format_string("p%06d", number)).alias("pair_id")]
    for c in SIDES:
        if c.endswith("assertion_status"):
            columns.append(assertion(get(c)).alias(c))
        elif c.endswith("_cui"):
            columns.append(F.when(get(c) == "", F.raise_error(F.lit(f"{c} is blank")).cast("string")).otherwise(get(c)).alias(c))
        else:
            columns.append(get(c).alias(c))
    return df.select(*columns)


def prompt() -> Column:
    """The question for one pair."""
    part = lambda s, name: F.format_string(f"Concept {name}: %s (%s), type %s, status %s", f"{s}_term", f"{s}_cui", f"{s}_semantic_type", f"{s}_assertion_status")
    return F.concat_ws("\n", part("a", "A"), part("b", "B"), F.lit("How strongly are A and B related?"))


def request_body(cfg: Scoring = Scoring()) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.lit(cfg.model).alias("model"), F.lit(float(cfg.temperature)).alias("temperature"), F.array(message("system", F.lit(GUIDE)), message("user", prompt())).alias("messages"))
    return F.concat(F.substring(F.to_json(body), F.lit(1), F.length(F.to_json(body)) - 1), F.lit(', "response_format": ' + json.dumps(ANSWER_FORM, sort_keys=True) + "}"))


def batch_requests(pairs: DataFrame, cfg: Scoring = Scoring()) -> DataFrame:
    """value: one JSON line a pair; a repeated id fails."""
    df = require_unique(pairs, "pair_id").withColumn("_b", request_body(cfg))
    head = F.to_json(F.struct(F.col("pair_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url")))
    return df.select("pair_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"body":'), F.col("_b"), F.lit("}")).alias("value"))


def parsed(content: Column) -> Column:
    """The assessment of an answer, or null where it is no JSON object."""
    ok = F.startswith(F.schema_of_variant(F.try_parse_json(content)), F.lit("OBJECT<"))
    return F.when(F.coalesce(ok, F.lit(False)), F.from_json(content, ASSESSMENT, {"mode": "PERMISSIVE"}))


def fields(x: Column) -> list[Column]:
    """The six answer fields as text, empty where absent."""
    text = lambda c: F.coalesce(x[c].cast("string"), F.lit("")).alias(c)
    return [text("relationship_score"), text("has_medical_relationship"), text("confidence"), text("assertion_adjustment"), text("rationale"), F.coalesce(F.array_join(x["linking_conditions"], ";"), F.lit("")).alias("linking_conditions")]


def batch_results(pairs: DataFrame, outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """A row for each pair, sorted by the id as text when written.

    outputs and errors: custom_id, content, error. An entry of the error file goes first, then no output at all, then an
    error within the output, then the answer.
    """
    once = lambda df, more: df.groupBy("custom_id").agg(*more)
    o = once(outputs, [F.first("content").alias("content"), F.first("error").alias("inline"), F.lit(True).alias("has")])
    e = once(errors, [F.coalesce(F.first("error"), F.lit("error")).alias("failed")])
    df = pairs.join(o, F.col("pair_id") == F.col("custom_id"), "left").drop("custom_id").join(e, F.col("pair_id") == F.col("custom_id"), "left").drop("custom_id")
    df = df.withColumn("x", parsed(F.col("content")))
    state = F.when(F.col("failed").isNotNull(), "error").when(F.col("has").isNull(), "missing").when(F.col("inline").isNotNull(), "error").when(F.col("x").isNull(), "bad_json").otherwise("ok")
    df = df.withColumn("status", state)
    x = F.when(F.col("status") == "ok", F.col("x"))
    return df.select(*pairs.columns, *fields(x), "status", F.when(F.col("status") == "error", F.coalesce("failed", "inline")).otherwise("").alias("error_message"))


class BatchClient(Protocol):
    """What a batch service must offer; adapters of real services live with their credentials, outside this package."""

    def upload(self, path: str) -> str: ...

    def create(self, file_id: str, window: str) -> str: ...

    def status(self, batch_id: str) -> str: ...

    def outputs(self, batch_id: str) -> str | None:
        """Where the answers are (custom_id, content, error as JSON lines), or None."""

    def errors(self, batch_id: str) -> str | None: ...


#: States in which a batch ends.
ENDED = ("completed", "failed", "expired", "cancelled")


def run_batch(pairs: DataFrame, client: BatchClient, folder: str, cfg: Scoring = Scoring(), window: str = "24h", pause: float = 10.0, wait=time.sleep) -> DataFrame:
    """Requests written and handed over, the batch polled until it ends, and its files joined back to all pairs."""
    spark, path = pairs.sparkSession, f"{folder}/requests"
    batch_requests(pairs, cfg).select("value").write.mode("overwrite").text(path)
    batch = client.create(client.upload(path), window)
    while client.status(batch) not in ENDED:
        wait(pause)
    form = "custom_id string, content string, error string"

    def read(place: str | None) -> DataFrame:
        return spark.createDataFrame([], form) if place is None else spark.read.schema(form).json(place)

    return by_id_text(batch_results(pairs, read(client.outputs(batch)), read(client.errors(batch))))


def by_id_text(df: DataFrame) -> DataFrame:
    """Rows by their id as text: 1, 10, 2."""
    return df.orderBy(F.col("pair_id").cast("string"))


class Retryable(Exception):
    """A call that may succeed when repeated."""


def rule_scorer(request: dict) -> str:
    """An offline stand-in for a model: shared words and types of the two concepts, less for absent or uncertain ones."""
    words = lambda s: set(request[f"{s}_term"].lower().split())
    a, b = words("a"), words("b")
    score = 20 + 60 * len(a & b) // max(1, len(a | b)) + 20 * (request["a_semantic_type"] == request["b_semantic_type"])
    states, adjust = {request["a_assertion_status"], request["b_assertion_status"]}, ADJUSTMENTS[0]
    if "absent" in states:
        score, adjust = score // 2, ADJUSTMENTS[1]
    elif states & {"possible", "conditional", "unknown"}:
        score, adjust = score * 3 // 4, ADJUSTMENTS[2]
    return json.dumps({"relationship_score": score, "has_medical_relationship": score >= 50, "confidence": 0.5, "rationale": "shared words and types", "linking_conditions": sorted(a & b)[:5], "assertion_adjustment": adjust})


def called(ask: Callable[[dict], str], request: dict, cfg: Scoring, wait=time.sleep) -> tuple[str | None, str, str]:
    """(answer, error type, error message). Waits 1, 2, 4 ... seconds between tries; other errors end at once."""
    pause = cfg.first_wait
    for attempt in range(cfg.max_retries + 1):
        try:
            return ask(request), "", ""
        except Retryable as e:
            if attempt == cfg.max_retries:
                return None, type(e).__name__, str(e)
            wait(min(pause, cfg.longest_wait) * (1 + 0.1 * random.random()))
            pause *= 2
        except Exception as e:  # a row of its own; raising would repeat paid calls
            return None, type(e).__name__, str(e)
    return None, "Retryable", "no tries left"


def scored(pairs: DataFrame, ask: Callable[[dict], str] = rule_scorer, cfg: Scoring = Scoring()) -> DataFrame:
    """pairs with answer fields, status and errors. Calls are side effects: write the result before using it twice."""
    columns = ["pair_id", *SIDES]

    def run(frames):
        with ThreadPoolExecutor(cfg.concurrency) as pool:
            for frame in frames:
                got = list(pool.map(lambda r: called(ask, r, cfg), frame[columns].to_dict("records")))
                yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(got, columns=["content", "error_type", "error_message"])], axis=1)

    schema = ", ".join(f"{c} string" for c in [*columns, "request_json", "content", "error_type", "error_message"])
    df = pairs.select(*columns, request_body(cfg).alias("request_json")).mapInPandas(run, schema)
    df = df.withColumn("x", parsed(F.col("content")))
    state = F.when(F.col("content").isNull(), "error").when(F.col("x").isNull(), "bad_json").otherwise("ok")
    return df.select(*columns, *fields(F.col("x")), state.alias("status"), "error_type", "error_message", "request_json", F.coalesce("content", F.lit("")).alias("response_json"))


def audit(df: DataFrame) -> DataFrame:
    """value: a JSON line a scored pair, with the request and the raw answer or the error."""
    good = F.struct("pair_id", F.col("request_json").alias("request"), F.col("response_json").alias("response_raw"))
    bad = F.struct("pair_id", F.col("request_json").alias("request"), F.col("error_message").alias("error"))
    return df.select(F.when(F.col("status") == "error", F.to_json(bad)).otherwise(F.to_json(good)).alias("value"))
