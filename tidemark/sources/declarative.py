"""Declarative JSON sources: a spec compiled to expressions over landed pages, its paging and its completeness."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from ..functions.urls import encoded
from ..functions.values import unix_date, variant_path

RULES = ("next_offset_ge_total", "last_page_shorter_than_page_size", "items_path_empty_after_total")
DATES = ("unix_seconds", "iso_date", "iso_datetime")


class SpecError(ValueError):
    """A spec that can't be compiled."""


def at(v: Column, path: str, kind: str = "variant") -> Column:
    """A value by its dotted path; a negative step counts from the end of a list."""
    steps = path.split(".")
    if not any(re.fullmatch(r"-\d+", s) for s in steps):
        return F.try_variant_get(v, variant_path(path), kind)
    for i, step in enumerate(steps):
        if re.fullmatch(r"-\d+", step):
            items = F.try_variant_get(v, "$", "array<variant>") if i == 0 or v is None else F.try_variant_get(v, "$", "array<variant>")
            v = F.try_element_at(items, F.lit(int(step)))
        else:
            v = F.try_variant_get(v, variant_path(step), "variant")
    return F.try_variant_get(v, "$", kind)


def first_at(v: Column, paths: list[str], kind: str = "string") -> Column:
    return F.coalesce(*[at(v, p, kind) for p in paths]) if paths else F.lit(None).cast(kind)


@dataclass(frozen=True)
class Spec:
    """A checked spec."""

    raw: dict

    def __post_init__(self) -> None:
        problems = list(check_spec(self.raw))
        if problems:
            raise SpecError("; ".join(problems))

    @property
    def extraction(self) -> dict:
        return self.raw["extraction"]

    @property
    def name(self) -> str:
        return f"declarative:{self.raw['company']['id']}"


def check_spec(raw: dict):
    """Problems of a spec, none for a sound one."""
    for section in ("company", "request", "extraction", "paging", "completeness"):
        if not isinstance(raw.get(section), dict):
            yield f"lacks {section}"
            return
    ex, paging = raw["extraction"], raw["paging"]
    for key in ("stable_id_path", "title_path"):
        if not ex.get(key):
            yield f"lacks extraction.{key}"
    if not ("page_wrapper" in ex or {"item_path", "total_path"} <= ex.keys()):
        yield "lacks the paths of items and total"
    if not (ex.get("official_url_path") or ex.get("official_url_template")):
        yield "lacks the official URL"
    if paging.get("strategy") != "offset":
        yield "paging.strategy is not offset"
    if not isinstance(paging.get("page_size"), int) or paging["page_size"] < 1:
        yield "paging.page_size is not positive"
    if ex.get("date_format") not in (None, *DATES):
        yield "unknown date_format"
    yield from (f"unknown rule {r.get('kind')}" for r in raw["completeness"].get("rules", []) if r.get("kind") not in RULES)
    d = ex.get("description") or {}
    if d.get("shape", "string") not in ("string", "list_of_blocks"):
        yield "unknown description.shape"
    if d.get("shape") == "list_of_blocks" and not {"tasks_relative_key", "qualifications_relative_key"} <= d.keys():
        yield "list_of_blocks needs its relative keys"


def date_of(value: Column, how: str | None) -> Column:
    if how == "unix_seconds":
        return unix_date(value.try_cast("long")).cast("string")
    return F.substring(value, 1, 10) if how == "iso_date" else value


def pages(spec: Spec, payloads: DataFrame) -> DataFrame:
    """Add ``items`` (unwrapped where each is an object of one key) and ``total`` to payloads."""
    ex, v = spec.extraction, F.col("v")
    wrapper = ex.get("page_wrapper") or {"items": ex.get("item_path"), "total": ex.get("total_path")}
    none = F.array().cast("array<variant>")

    def unwrapped(x: Column) -> Column:
        keys = F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))
        return F.when(F.size(keys) == 1, F.get(keys, F.lit(0))).otherwise(x)

    out = payloads.withColumn("v", F.try_parse_json("body"))
    return out.withColumns({"items": F.transform(F.coalesce(at(v, wrapper["items"], "array<variant>"), none), unwrapped), "total": F.coalesce(at(v, wrapper["total"], "long"), F.lit(0))}).drop("v")


def description(spec: Spec, v: Column, override: str | None = None) -> tuple[Column, Column, Column]:
    """(description, qualifications, complete)."""
    d = spec.extraction.get("description")
    if not d:
        return F.lit(""), F.lit(""), F.lit(False)
    paths = [override or d["path"], *(d.get("fallback_paths") or [])]
    clean = strip_tags if d.get("strip_html", True) else (lambda x: F.coalesce(x, F.lit("")))
    if d.get("shape", "string") == "string":
        text = clean(first_at(v, paths))
        return text, F.lit(""), F.trim(text) != ""
    blocks = F.coalesce(first_at(v, paths, "array<variant>"), F.array().cast("array<variant>"))
    side = lambda key: F.array_join(F.filter(F.transform(blocks, lambda b: clean(at(b, key, "string"))), lambda x: F.trim(x) != ""), d.get("join_separator", "\n\n"))
    tasks, quals = side(d["tasks_relative_key"]), side(d["qualifications_relative_key"])
    return tasks, quals, (F.trim(tasks) != "") & (F.trim(quals) != "")


def places(spec: Spec, v: Column) -> Column:
    """Locations as an array of strings, from a list of strings or of objects, or one string."""
    d = spec.extraction.get("locations")
    none = F.array().cast("array<string>")
    if not d:
        return none
    shape = d.get("shape", "list_of_strings")
    if shape == "list_of_objects":
        fields = d.get("fields") or [k for k in (d.get("city_key"), d.get("country_key")) if k]
        items = F.transform(at(v, d["path"], "array<variant>"), lambda x: F.concat_ws(", ", *[F.nullif(at(x, f, "string"), F.lit("")) for f in fields]))
    elif shape == "string":
        items = F.array(at(v, d["path"], "string"))
    else:
        items = at(v, d["path"], "array<string>")
    return F.array_distinct(F.filter(F.coalesce(items, none), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def jobs(spec: Spec, payloads: DataFrame) -> DataFrame:
    """Normalized rows of a source's landed catalog pages."""
    ex, v = spec.extraction, F.col("item")
    rows = pages(spec, payloads).select("payload_id", F.posexplode("items").alias("ordinal", "item"))
    second = ex.get("secondary_id_paths") or []
    key = first_at(v, [ex["stable_id_path"], *second])
    named = at(v, ex["official_url_path"], "string") if ex.get("official_url_path") else F.lit(None).cast("string")
    built = F.replace(F.lit(ex["official_url_template"]), F.lit("{{stable_id}}"), F.coalesce(key, F.lit(""))) if ex.get("official_url_template") else F.lit(None).cast("string")
    apply_path = ex.get("apply_url_path")
    apply_url = F.coalesce(F.get(at(v, apply_path, "array<string>"), F.lit(0)), at(v, apply_path, "string")) if apply_path else F.lit(None).cast("string")
    text, quals, complete = description(spec, v)
    maybe = lambda name: at(v, ex[name], "string") if ex.get(name) else F.lit(None).cast("string")
    language = F.coalesce(at(v, f"{ex['language_path']}.Code", "string"), at(v, ex["language_path"], "string")) if ex.get("language_path") else F.lit(None).cast("string")
    return rows.select(
        "payload_id", "ordinal", F.lit(spec.name).alias("source"), key.alias("source_job_id"), F.filter(F.array(*[at(v, p, "string") for p in second]) if second else F.array().cast("array<string>"), lambda x: x.isNotNull()).alias("source_secondary_ids"),
        maybe("title_path").alias("title"), maybe("department_path").alias("department"), maybe("organization_path").alias("organization"), places(spec, v).alias("locations"),
        date_of(maybe("publication_date_path"), ex.get("date_format")).alias("publication_date"), date_of(maybe("expiration_date_path"), ex.get("date_format")).alias("expiration_date"),
        F.coalesce(F.nullif(named, F.lit("")), built).alias("official_url"), apply_url.alias("apply_url"), language.alias("language"), text.alias("description"), quals.alias("qualifications"), complete.alias("detail_complete"),
    )


def with_details(spec: Spec, rows: DataFrame, details: DataFrame) -> DataFrame:
    """Descriptions of detail payloads (source_job_id, body) on rows; a detail without one changes nothing."""
    path = (spec.raw.get("detail") or {}).get("description_path")
    text, quals, complete = description(spec, F.col("v"), path)
    found = details.withColumn("v", F.try_parse_json("body")).select("source_job_id", text.alias("_d"), quals.alias("_q"), complete.alias("_c"))
    has = F.coalesce(F.col("_d"), F.lit("")) != ""
    return rows.join(found, "source_job_id", "left").withColumns({"description": F.when(has, F.col("_d")).otherwise(F.col("description")), "qualifications": F.when(has, F.col("_q")).otherwise(F.col("qualifications")), "detail_complete": F.when(has, F.col("_c")).otherwise(F.col("detail_complete"))}).drop("_d", "_q", "_c")


def to_raw(rows: DataFrame) -> DataFrame:
    """Normalized rows as raw records: locations joined by a bar, qualifications as a section of their own."""
    section = F.when(F.coalesce("qualifications", F.lit("")) != "", F.concat(F.lit("\n\nQualifications:\n"), F.col("qualifications"))).otherwise("")
    return rows.select(
        "payload_id", "ordinal", "source", "source_job_id", F.col("official_url").alias("source_url"), F.coalesce("apply_url", "official_url").alias("apply_url"), "title", F.array_join("locations", " | ").alias("location"),
        F.concat(F.coalesce("description", F.lit("")), section).alias("description"), F.try_to_timestamp("publication_date").alias("posted_at"), F.col("source_job_id").alias("ats_job_id"),
    )


def last_offset(spec: Spec, total: Column) -> Column:
    p = spec.raw["paging"]
    return F.lit(p["first_page_value"]) + F.floor(F.greatest(F.lit(0), total - p["first_page_value"] - 1) / p["page_size"]) * p["page_size"]


def kinds(spec: Spec) -> set[str]:
    return {r["kind"] for r in spec.raw["completeness"].get("rules", [])}


def offsets(spec: Spec, total: Column) -> Column:
    """The offsets to ask for, with the probe after the last if a rule wants an empty page."""
    p = spec.raw["paging"]
    extra = p["page_size"] if "items_path_empty_after_total" in kinds(spec) else 0
    return F.sequence(F.lit(p["first_page_value"]).cast("long"), (last_offset(spec, total) + extra).cast("long"), F.lit(p["page_size"]).cast("long"))


def completeness(spec: Spec, history: DataFrame) -> DataFrame:
    """Per run (run_id, page_value, items_count, total): complete, and the first reason against it."""
    size, first = spec.raw["paging"]["page_size"], spec.raw["paging"]["first_page_value"]
    full = F.max_by("items_count", F.struct((F.col("items_count") > 0).alias("some"), F.col("page_value").alias("p")))
    seen = history.groupBy("run_id").agg(F.max("total").alias("total"), F.collect_set(F.col("page_value").cast("long")).alias("seen"), F.collect_set(F.when(F.col("items_count") == 0, F.col("page_value").cast("long"))).alias("empty"), F.max("items_count").alias("most"), full.alias("last"))
    any_page = F.col("total") >= first
    needed = F.when(any_page, F.sequence(F.lit(first).cast("long"), last_offset(spec, F.col("total")).cast("long"), F.lit(size).cast("long"))).otherwise(F.array().cast("array<long>"))
    after = F.when(any_page, last_offset(spec, F.col("total")) + size).otherwise(F.lit(first)).cast("long")
    tests = {
        "next_offset_ge_total": (F.size(F.array_except(needed, "seen")) > 0, "missing pages"),
        "last_page_shorter_than_page_size": ((F.col("most") == 0) | ((F.col("last") >= size) & ~F.exists("empty", lambda x: x >= F.col("total"))), "last page with items was full"),
        "items_path_empty_after_total": (~F.array_contains("empty", after), "no empty page after the total"),
    }
    reasons = [F.when(*tests[k]) for k in RULES if k in kinds(spec)]
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return seen.select("run_id", reason.isNull().alias("complete"), F.coalesce(reason, F.lit("all rules hold")).alias("reason"))


def may_close(spec: Spec, complete: Column) -> Column:
    """Only a complete and authoritative full catalog closes rows."""
    sure = bool(spec.raw.get("open_closed_authoritative")) and spec.raw.get("source_of_truth") == "full_catalog"
    return complete & F.lit(sure)


def query_string(pairs: list[tuple[str, Column]]) -> Column:
    """An encoded query in the given order, repeats and all; a null value gives null, since a request can't hold it."""
    parts = [F.concat(encoded(F.lit(name)), F.lit("="), encoded(value.cast("string"))) for name, value in pairs]
    return reduce(lambda a, b: F.concat(a, F.lit("&"), b), parts)
