"""A subset of JSON Schema: specs are checked on the driver, rows by expectations in the plan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def is_type(value, kind) -> bool:
    if isinstance(kind, list):
        return any(is_type(value, k) for k in kind)
    if kind in ("number", "integer"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind])


def problems(value, schema: dict, root: dict | None = None, at: str = "$") -> list[str]:
    """What is wrong with a value, as path and reason; empty if nothing is."""
    root = schema if root is None else root
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            target = target.get(step) if isinstance(target, dict) else None
        return problems(value, target, root, at) if isinstance(target, dict) else [f"{at}: unknown reference {schema['$ref']}"]
    if "type" in schema and not is_type(value, schema["type"]):
        return [f"{at}: is not {schema['type']}"]
    out = []
    say = lambda bad, why: out.append(f"{at}: {why}") if bad else None
    say("const" in schema and value != schema.get("const"), "is not the constant")
    say("enum" in schema and value not in schema.get("enum", ()), "is not listed")
    if isinstance(value, str):
        say(len(value) < schema.get("minLength", 0), "is too short")
        say("pattern" in schema and not re.search(schema["pattern"], value), "does not match")
        say(schema.get("format") == "uri" and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+", value), "is not a URI")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        say(value < schema.get("minimum", value), "is too small")
        say(value > schema.get("maximum", value), "is too large")
    if isinstance(value, list):
        say(len(value) < schema.get("minItems", 0), "has too few items")
        for i, item in enumerate(value):
            out += problems(item, schema.get("items", {}), root, f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: lacks {name}" for name in schema.get("required", ()) if name not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}: must not have {name}" for name in sorted(value.keys() - known.keys())]
        for name, sub in known.items():
            if name in value:
                out += problems(value[name], sub, root, f"{at}.{name}")
    fits = lambda subs: sum(not problems(value, s, root, at) for s in subs)
    say("oneOf" in schema and fits(schema.get("oneOf", ())) != 1, "fits not just one choice")
    say("anyOf" in schema and fits(schema.get("anyOf", ())) < 1, "fits no choice")
    say("not" in schema and not problems(value, schema.get("not", {}), root, at), "fits what it must not")
    return out


def expectations(schema: dict) -> dict[str, Column]:
    """Conditions that good rows of flat columns meet: required ones filled, listed values, patterns and bounds."""
    out = {f"lacks {name}": F.coalesce(F.col(name).cast("string"), F.lit("")) != "" for name in schema.get("required", ())}
    for name, sub in schema.get("properties", {}).items():
        c = F.col(name)
        if "enum" in sub:
            out[f"{name} is not listed"] = c.isNull() | c.isin(*[x for x in sub["enum"] if x is not None])
        if "pattern" in sub:
            out[f"{name} does not match"] = c.isNull() | c.rlike(sub["pattern"])
        if "minimum" in sub:
            out[f"{name} is too small"] = c.isNull() | (c >= sub["minimum"])
        if "maximum" in sub:
            out[f"{name} is too large"] = c.isNull() | (c <= sub["maximum"])
    return out
