"""CSV scans that hold the header to a contract and report bad rows instead of losing them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..functions.urls import is_http, jobs_url


class HeaderError(ValueError):
    """The header is not the contract's."""


@dataclass(frozen=True)
class Contract:
    """Columns in order, and checks: a name and a condition that a good row meets."""

    columns: tuple[str, ...]
    checks: dict[str, Column] = field(default_factory=dict)
    unique: tuple[str, ...] = ()


def read(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """All columns as strings, null as '', with ``problems``: the failed checks' names; an exact header or HeaderError."""
    head = spark.read.option("header", False).option("mode", "PERMISSIVE").csv(path).limit(1).collect()
    found = tuple((x or "").lstrip("﻿").strip() for x in head[0]) if head else ()
    if found != contract.columns:
        raise HeaderError(f"expected {contract.columns}, found {found}")
    schema = ", ".join(f"`{c}` string" for c in contract.columns) + ", _bad string"
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in contract.columns], F.col("_bad").isNotNull().alias("_wide"))
    return checked(df, contract)


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    flags = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in contract.checks.items()]
    if "_wide" in df.columns:
        flags.append(F.when(F.col("_wide"), F.lit("number of columns")))
    if contract.unique:
        from pyspark.sql import Window as W

        df = df.withColumn("_n", F.count("*").over(W.partitionBy(*[F.trim(F.col(f"`{u}`")) for u in contract.unique])))
        flags.append(F.when(F.col("_n") > 1, F.lit("repeated key")))
    problems = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return df.withColumn("problems", problems).drop("_wide", "_n")


def good(df: DataFrame) -> DataFrame:
    return df.where(F.size("problems") == 0).drop("problems")


def filled(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.trim(F.col(f"`{n}`")) != "")
    return out


def date_or_blank(name: str) -> Column:
    c = F.trim(F.col(f"`{name}`"))
    return (c == "") | F.try_to_date(c).isNotNull()


def int_or_blank(name: str) -> Column:
    c = F.trim(F.col(f"`{name}`"))
    return (c == "") | c.try_cast("int").isNotNull()


def truth(name: str) -> Column:
    return F.upper(F.trim(F.col(f"`{name}`"))).isin("Y", "YES", "TRUE", "1")


def aliases() -> Contract:
    """Alias file: a verified alias needs its evidence."""
    columns = ("alias", "corporate_cluster_id", "status", "evidence_url", "evidence_note", "verified_date")
    checks = {"alias": normalize(F.col("alias")) != "", "status": F.col("status").isin("PROPOSED", "VERIFIED"), "evidence": (F.col("status") != "VERIFIED") | is_http(F.col("evidence_url")), "date": date_or_blank("verified_date")}
    return Contract(columns, checks, ("alias", "corporate_cluster_id"))


def registry_changes() -> Contract:
    """Change file: which fields each action needs and forbids."""
    columns = ("corporate_cluster_id", "action", "old_jobs_url", "new_jobs_url", "portal_scope", "ats_family", "ats_confidence", "status", "verification_url", "verified_date", "parent_override", "wave", "reason", "actor", "note")
    adds = F.col("action").isin("ADD", "UPDATE")
    checks = {
        "action": F.col("action").isin("ADD", "UPDATE", "RETIRE", "SUSPEND", "RESUME"), "cluster": filled("corporate_cluster_id"), "reason": filled("reason"),
        "new URL": F.when(adds, jobs_url(F.col("new_jobs_url")).isNotNull()).otherwise(F.trim("new_jobs_url") == ""), "old URL": F.when(F.col("action") == "ADD", F.trim("old_jobs_url") == "").otherwise(filled("old_jobs_url")), "date": date_or_blank("verified_date"),
    }
    return Contract(columns, checks, ("corporate_cluster_id",))


def manual_jobs() -> Contract:
    """Manual vacancy file; the id may come from the URL."""
    columns = ("job_id", "job_url", "title", "company", "location", "country", "city", "description", "posted_at", "employment_type", "workplace_type", "apply_url")
    checks = {"id": native_job_id() != "", "title": filled("title"), "company": filled("company"), "URL": is_http(F.col("job_url"))}
    return Contract(columns, checks)


def native_job_id() -> Column:
    own = F.trim("job_id")
    return F.when(own != "", own).otherwise(F.regexp_extract("job_url", r"/jobs/view/(?:[^/?#]*-)?(\d+)", 1))


def external_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate file with a tolerant header; only rows of high confidence."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.where("match_class = 'HIGH_CONFIDENCE'")


def tenant_files(spark: SparkSession, folder: str) -> DataFrame:
    """(family, slug, url, name, domain) of per-vendor files, whose names are the families and whose headers differ."""
    from pathlib import PurePosixPath

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()
    out = None
    for row in sorted(names):
        df = spark.read.option("header", True).option("escape", '"').csv(row["path"])
        pick = lambda *options, df=df: next((F.col(f"`{o}`") for o in options if o in df.columns), F.lit(None)).cast("string")
        one = df.select(F.lit(PurePosixPath(row["path"]).stem).alias("family"), pick("slug", "tenant", "token", "board").alias("slug"), pick("url", "board_url", "careers_url").alias("url"), pick("name", "company", "company_name").alias("name"), pick("domain").alias("domain"))
        out = one if out is None else out.unionByName(one)
    return out


def load_config(path: str) -> dict:
    """A YAML configuration, which must be a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not a mapping")
    return found


def write_new(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a result to a place where nothing is yet; an existing one is an error."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)
