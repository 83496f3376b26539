"""Column functions: vocabularies, keys, texts, tokens and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw assertion status to the five analysis statuses; anything else is dropped.
STATUS = {
    "present": "PRESENT",
    "absent": "ABSENT",
    "historical": "HISTORY",
    "associated_with_someone_else": "FAMILY_HISTORY",
    "possible": "UNCERTAIN",
    "hypothetical": "UNCERTAIN",
    "conditional": "UNCERTAIN",
}
# Assertion words to the vocabulary of prompts; anything else is unknown.
ASSERTION = {
    "present": "present",
    "pos": "present",
    "absent": "absent",
    "negated": "absent",
    "denied": "absent",
    "no": "absent",
    "possible": "possible",
    "suspected": "possible",
    "maybe": "possible",
    "probable": "possible",
    "uncertain": "possible",
    "conditional": "conditional",
    "if": "conditional",
    "historical": "historical",
    "history": "historical",
    "past": "historical",
    "family_history": "family_history",
    "fh": "family_history",
    "familyhx": "family_history",
}


def lookup(value: Column, names: dict[str, str]) -> Column:
    """The name a map literal gives, or null."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), value)


def status(raw: Column, normalise: bool = False) -> Column:
    return lookup(F.lower(F.trim(raw)) if normalise else raw, STATUS)


def assertion(raw: Column) -> Column:
    key = F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "- ", "__")
    return F.coalesce(lookup(key, ASSERTION), F.lit("unknown"))


def filled(text: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(text), F.lit(""))


def stripped(text: Column) -> Column:
    """Trimmed text, empty where null."""
    return F.coalesce(F.trim(text), F.lit(""))


def key_parts(key: Column, delimiter: str = "-") -> tuple[Column, Column, Column]:
    """Patient, admission and message of a key of exactly three parts; nulls otherwise."""
    parts = F.split(key, re.escape(delimiter), -1)
    return tuple(F.when(F.size(parts) == 3, F.get(parts, F.lit(i))) for i in range(3))


def entity_text(phrase: Column, body: Column) -> Column:
    return F.concat_ws(" ", filled(phrase), filled(body))


def note_text(*parts: Column) -> Column:
    return F.concat_ws(", ", *map(filled, parts))


def token(cui: Column, state: Column, delimiter: str = "||") -> Column:
    return F.concat(cui, F.lit(delimiter), state)


def token_parts(value: Column, delimiter: str = "||") -> tuple[Column, Column]:
    """Concept and status, cut once at the delimiter, else at a single bar; status is empty where there is neither."""
    mark = F.when(F.contains(value, F.lit(delimiter)), F.lit(delimiter)).when(F.contains(value, F.lit("|")), F.lit("|"))
    at = F.position(mark, value)
    cui = F.when(mark.isNull(), value).otherwise(F.substring(value, F.lit(1), at - 1))
    rest = F.when(mark.isNull(), F.lit("")).otherwise(F.substring(value, at + F.length(mark), F.length(value)))
    return F.trim(cui), F.trim(rest)


def number(text: Column) -> Column:
    """Unparseable is null."""
    return F.trim(text).try_cast("double")


def clean(vector: Column) -> Column:
    """Components as doubles, with null, NaN and infinities as 0."""
    def one(x):
        d = x.cast("double")
        return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)

    return F.transform(vector, one)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def unit(vector: Column, floor: float = 1e-12) -> Column:
    """L2-normalised, with a floor under the norm."""
    own = clean(vector)
    norm = F.greatest(F.sqrt(F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x * x)), F.lit(floor))
    return F.transform(own, lambda x: x / norm)
