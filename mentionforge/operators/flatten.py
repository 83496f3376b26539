"""Extraction logs to mentions: one row an item, ids from the key, unknown fields in a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_parts

# The columns of the mention table.
FIELDS = ["key", "patient_id", "admission_id", "message_id", "phrase", "body_location", "semantic_type", "modifier", "purpose", "assertion_status", "value", "unit", "start_date", "end_date"]
ITEMS = "array<map<string,string>>"


def parsed(lines: DataFrame) -> DataFrame:
    """lines (value) with outer_key, items and ok: both JSON levels parse and have the expected shapes."""
    outer = F.try_parse_json(F.trim("value"))
    df = lines.where(F.trim("value") != "").withColumn("_v", outer)
    response = F.try_variant_get("_v", "$.response", "string")
    is_text = F.schema_of_variant(F.try_variant_get("_v", "$.response", "variant")) == "STRING"
    df = df.withColumn("outer_key", F.try_variant_get("_v", "$.key", "string")).withColumn("_r", F.when(is_text, response))
    inner = F.schema_of_variant(F.try_parse_json("_r"))
    df = df.withColumn("items", F.when(F.startswith(inner, F.lit("ARRAY<")), F.from_json("_r", ITEMS)))
    return df.withColumn("ok", F.col("items").isNotNull() & ~F.coalesce(F.exists("items", lambda m: m.isNull()), F.lit(False))).drop("_v", "_r")


def bad_records(lines: DataFrame) -> DataFrame:
    return parsed(lines).where(~F.coalesce("ok", F.lit(False))).select(*lines.columns)


def mentions(lines: DataFrame, delimiter: str = "-") -> DataFrame:
    """The mention table: FIELDS, extras (all other fields), and the item's position in its line."""
    df = parsed(lines).where("ok").select(*(c for c in lines.columns if c != "value"), "outer_key", F.posexplode("items").alias("item_no", "m"))
    key = F.when(F.map_contains_key("m", F.lit("key")), F.try_element_at("m", F.lit("key"))).otherwise(F.col("outer_key"))
    df = df.withColumn("key", key)
    patient, admission, message = key_parts(F.col("key"), delimiter)
    own = [F.try_element_at("m", F.lit(c)).alias(c) for c in FIELDS[4:]]
    extras = F.map_filter("m", lambda k, _: ~k.isin(*FIELDS))
    kept = [c for c in lines.columns if c != "value"]
    return df.select(*kept, "item_no", "key", patient.alias("patient_id"), admission.alias("admission_id"), message.alias("message_id"), *own, extras.alias("extras"))


def discovered(df: DataFrame, extras: str = "extras") -> list[str]:
    """Names of all extra fields, sorted; their number is that of a schema, not of rows."""
    return [r[0] for r in df.select(F.explode(F.map_keys(extras)).alias("k")).distinct().orderBy("k").collect()]


def widened(df: DataFrame, names: list[str], extras: str = "extras") -> DataFrame:
    """Extra fields as columns, null where absent."""
    return df.select(*(c for c in df.columns if c != extras), *(F.try_element_at(extras, F.lit(k)).alias(k) for k in names))
