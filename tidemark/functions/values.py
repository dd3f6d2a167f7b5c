"""JSON, dates and small value conversions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import plain_normalize


def json_list(value: Column) -> Column:
    """The items of a JSON array as strings; anything else is an empty array."""
    v = F.try_parse_json(value)
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("ARRAY"), F.from_json(value, "array<string>")), F.array().cast("array<string>"))


def json_get(value: Column, path: str, kind: str = "string") -> Column:
    """A value by its dotted path, ``a.b.0.c``, from JSON text; null where it is missing or unfit."""
    return F.try_variant_get(F.try_parse_json(value), variant_path(path), kind)


def variant_path(path: str) -> str:
    out = "$"
    for step in path.split("."):
        if not step:
            raise ValueError(f"empty step in {path!r}")
        out += f"[{step}]" if step.isdigit() else f"['{step}']" if re.search(r"\W", step) else f".{step}"
    return out


def iso_time(value: Column) -> Column:
    """ISO date or time, with Z or an offset or neither (then UTC); null for others."""
    return F.try_to_timestamp(F.trim(value))


def epoch_ms(value: Column) -> Column:
    return F.timestamp_millis(value.cast("long"))


def unix_date(value: Column) -> Column:
    return F.to_date(F.timestamp_seconds(value.cast("long")))


def string_value(value: Column, default: str = "") -> Column:
    return F.coalesce(F.trim(value), F.lit(default))


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds with three decimals, null while unfinished."""
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / 1e6, 3)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number or an HTTP date, not below 0; null for others."""
    v = F.trim(value)
    at = F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    seconds = F.when(v.rlike(r"^-?\d+(\.\d+)?$"), v.cast("double")).otherwise(F.timestamp_diff("SECOND", now, at).cast("double"))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def template(pattern: str, values: dict[str, Column]) -> Column:
    """``{name}`` slots filled; an unknown name is an error when the plan is built."""
    parts = re.split(r"\{(\w+)\}", pattern)
    missing = [p for p in parts[1::2] if p not in values]
    if missing:
        raise ValueError(f"undefined variables {missing}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


def compact_metadata(value: Column, keys: list[str], most: int = 10) -> Column:
    """``k=v; `` pairs of the keys that JSON text has; a list gives its first items or their name or title."""
    pairs = []
    for key in keys:
        many = json_get(value, key, "array<variant>")
        items = F.array_join(F.filter(F.transform(F.slice(many, 1, most), lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.title", "string"), F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull()), ", ")
        text = F.when(many.isNotNull(), items).otherwise(json_get(value, key))
        pairs.append(F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{key}="), text)))
    return F.array_join(F.filter(F.array(*pairs), lambda x: x.isNotNull()), "; ")


def code_names(items: Column) -> Column:
    """``code:name`` of structs with these fields, sorted, joined by a bar."""
    return F.array_join(F.array_sort(F.transform(items, lambda x: F.concat(F.coalesce(x["code"], F.lit("")), F.lit(":"), F.coalesce(x["name"], F.lit(""))))), "|")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the normal forms."""
    return pd.Series([SequenceMatcher(None, plain_normalize(x), plain_normalize(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
