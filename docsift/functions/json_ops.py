"""JSON out of model answers: fences, the first whole value, shapes and required keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "area string, observation string, category string, severity string, evidence string"


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")


def is_json(c: Column) -> Column:
    """Whether the text is one JSON value and nothing else; parse_json alone lets pass what follows a value."""
    listed = F.concat(F.lit("["), c, F.lit("]"))
    return F.coalesce(F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1), F.lit(False))


def greedy_object(c: Column) -> Column:
    """The whole text if it is JSON, else what stands between the first opening and the last closing brace or bracket."""
    t = strip_fences(c)
    tries = [t, F.regexp_extract(t, r"(?s)\{.*\}", 0), F.regexp_extract(t, r"(?s)\[.*\]", 0)]
    return F.coalesce(*[F.when(is_json(x), x) for x in tries])


def _balanced(text: str, opening: str, closing: str) -> str | None:
    """The first balanced stretch; braces within strings count, as the consumers of this format count them."""
    depth, start = 0, -1
    for m in re.finditer("[" + re.escape(opening + closing) + "]", text):
        if m[0] == opening:
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


def _whole(text: str | None) -> bool:
    try:
        json.loads(text or "")
    except ValueError:
        return False
    return True


def extract(text: str | None, close: bool = True) -> str | None:
    """The ladder: whole, first balanced object, first balanced array, greedy object or array, with missing braces added."""
    if text is None:
        return None
    t = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    for found in (t, _balanced(t, "{", "}"), _balanced(t, "[", "]")):
        if _whole(found):
            return found
    for pattern in (r"\{.*\}", r"\[.*\]"):
        m = re.search(pattern, t, re.S)
        if m and _whole(m[0]):
            return m[0]
    at = t.find("{")
    if close and at >= 0:
        rest = t[at:].rstrip()
        for n in range(1, 9):
            for tail in ("}" * n, "]" + "}" * n):
                if _whole(rest + tail):
                    return rest + tail
    return None


@F.pandas_udf(T.StringType())
def extract_json(s: pd.Series) -> pd.Series:
    """Braces have to be counted, which no built-in does; everything else here is built in."""
    return s.map(lambda t: extract(t) if isinstance(t, str) else None)


def items(c: Column) -> Column:
    """A list of findings from a list, an object with observations, data or items, or a single object."""
    def arr(x: Column) -> Column:
        return F.from_json(x, f"array<struct<{ITEM.replace(' string', ':string')}>>")

    listed = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("observations", "data", "items")])
    found = F.when(F.trim(c).startswith("["), arr(c)).when(listed.isNotNull(), arr(listed)).otherwise(F.array(F.from_json(c, ITEM)))
    return F.filter(found, lambda x: x["area"].isNotNull() | x["observation"].isNotNull())


def missing_keys(c: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")))


def schema_error(c: Column, required: list[str], properties: dict[str, str]) -> Column:
    """The first fault by a schema of required fields and of types (string, number, array, object), else ''. As in the format's consumers, true and false count as numbers."""
    v = F.try_parse_json(c)
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    tests = {"string": "STRING", "number": "(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)", "array": "ARRAY", "object": "OBJECT"}
    out = F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), "Data must be a dictionary")
    for k in required:
        out = out.when(~F.array_contains(keys, k), f"Missing required field: {k}")
    for k, kind in properties.items():
        own = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit(""))
        out = out.when(F.array_contains(keys, k) & ~own.rlike("^" + tests[kind]), f"Field {k} must be {kind}")
    return out.otherwise("")


def summary(c: Column, default: str = "No summary available.") -> Column:
    """The first of a report's texts that isn't empty: property summary, summary, findings, risks, recommendations; lists are joined."""
    def text(k: str) -> Column:
        return F.nullif(F.get_json_object(c, f"$.{k}"), F.lit(""))

    def joined(k: str) -> Column:
        return F.nullif(F.array_join(F.from_json(F.get_json_object(c, f"$.{k}"), "array<string>"), ". "), F.lit(""))

    return F.coalesce(text("property_summary"), text("summary"), joined("key_findings"), text("risk_overview"), joined("recommendations"), F.lit(default))


def envelope(data: Column, error: Column) -> Column:
    """A response: success with data, or an error with its message; empty fields are left out."""
    return F.to_json(F.struct(error.isNull().alias("success"), data.alias("data"), error.alias("error")))
