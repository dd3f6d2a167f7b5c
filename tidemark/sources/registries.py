"""Registry files: the company master, the operational sources and the outside candidates, and their imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import candidate_url, is_http, jobs_url
from ..operators.dedup import new_candidates
from ..operators.lifecycle import check_equal, may_import
from ..operators.predicates import VERIFIED_EVIDENCE, routing, support_class_known
from ..operators.resolve import build_clusters, build_portals
from .strict_csv import Contract, checked, date_or_blank, filled, good, int_or_blank

#: Columns of the master, in order (fixed values).
MASTER = (
    "Record ID", "Employer", "Canonical Employer", "Parent Group", "Corporate Cluster ID", "Canonical Name Occurrences", "Duplicate Review Flag", "Entity Class", "Career Scan Eligible", "Sector",
    "Discovery Geography", "Org Type", "Corporate Website", "Website Status", "Careers URL", "Career Scan Status", "Discovery Source", "Source URL", "Notes", "Freeze Version", "Freeze Status",
    "Resolved Corporate Website", "Resolved Careers Landing URL", "Resolved Jobs Search URL", "Portal Scope", "ATS Family", "ATS Confidence", "Portal Resolution Status", "Portal Verification URL",
    "Portal Verified Date", "Resolution Parent Override", "Resolution Wave",
)
#: What a row of a resolution wave must hold (fixed values).
RESOLVED = ("Resolved Corporate Website", "Resolved Careers Landing URL", "Resolved Jobs Search URL", "ATS Family", "ATS Confidence", "Portal Verification URL", "Portal Verified Date", "Resolution Wave")
#: Columns and vocabularies of the operational registry (fixed values).
OPERATIONAL = (
    "employer_name", "corporate_cluster_id", "priority", "cohort", "source_key", "source_scope", "canonical_careers_url", "operational_url", "ats_family", "evidence_state", "resolution_path", "adapter_supported",
    "catalog_state", "last_verified_at", "evidence_url", "notes", "scan_enabled", "routing_override", "routing_override_rationale",
)
COHORTS = ("CORE_200", "CORE_EXTENSION")
PATHS = ("READY_TO_PROBE", "FINGERPRINT_REQUIRED", "ADAPTER_NEEDED", "RESOLVER_LIGHT", "HOLD")
CATALOG_STATES = ("UNTESTED", "PARITY_PENDING", "VERIFIED", "PARTIAL", "FIX_REQUIRED")
EVIDENCE_STATES = (
    "FIRST_PARTY_VERIFIED", "TECHNICALLY_VERIFIED", "FIRST_PARTY_AND_PLATFORM_VERIFIED", "OPERATIONAL_PLATFORM_VERIFIED", "GREENHOUSE_OPERATIONAL_PLATFORM_VERIFIED", "FIRST_PARTY_VERIFIED_PLATFORM",
    "TECHNICALLY_VERIFIED_PLATFORM", "PROBABLE", "UNVERIFIED",
)
SUPPORTED_FAMILIES = ("Greenhouse", "Lever", "Ashby", "SmartRecruiters", "Radancy", "SuccessFactors RMK", "Workday", "Phenom", "Oracle Recruiting Cloud", "Avature", "Custom Google RPC", "Eightfold")
OTHER_FAMILIES = ("Taleo", "BrassRing", "Teamtailor", "Pereless")


def bare(name: str) -> Column:
    return F.trim(F.col(f"`{name}`"))


def master() -> Contract:
    """The master file: unique record ids, a cluster for each, and resolved fields just where a wave is named."""
    in_wave = bare("Resolution Wave") != ""
    checks = {
        "record id": filled("Record ID"),
        "cluster": filled("Corporate Cluster ID"),
        "resolved fields": ~in_wave | filled(*RESOLVED),
        "verified status": ~in_wave | bare("Portal Resolution Status").startswith("VERIFIED"),
        "unresolved URL": in_wave | (bare("Resolved Jobs Search URL") == ""),
        "verified date": date_or_blank("Portal Verified Date"),
        "occurrences": int_or_blank("Canonical Name Occurrences"),
    }
    return Contract(MASTER, checks, ("Record ID",))


def operational_sources() -> Contract:
    """One row of the operational registry by itself; ``employer_problems`` tells what rows say against each other."""
    override, reason = F.upper(bare("routing_override")), bare("routing_override_rationale")
    careers, url, family = bare("canonical_careers_url"), bare("operational_url"), bare("ats_family")
    checks = {
        "employer": filled("employer_name"),
        "cohort": bare("cohort").isin(*COHORTS),
        "override": (override == "") | override.isin(*PATHS),
        "override rationale": (override == "") == (reason == ""),
        "resolution path": bare("resolution_path").isin(*PATHS),
        "override and path": (override == "") | (override == bare("resolution_path")),
        "catalog state": bare("catalog_state").isin(*CATALOG_STATES),
        "evidence state": bare("evidence_state").isin(*EVIDENCE_STATES),
        "careers URL": ((careers != "") | (url == "")) & ((careers == "") | is_http(careers)),
        "operational URL": (url == "") | is_http(url),
        "date": date_or_blank("last_verified_at"),
        "adapter supported": F.upper(bare("adapter_supported")).isin("", "YES", "NO", "UNKNOWN"),
        "family": (family == "") | family.isin(*SUPPORTED_FAMILIES, *OTHER_FAMILIES),
    }
    return Contract(OPERATIONAL, checks)


def derived_routing() -> Column:
    """The queue that a registry row's evidence, family and URL lead to."""
    return routing(bare("operational_url"), bare("evidence_state"), bare("ats_family"), bare("adapter_supported"), SUPPORTED_FAMILIES)


def employer_problems(rows: DataFrame) -> DataFrame:
    """(employer_name, problem): repeated source keys, and queues that one employer's sources may not share."""
    key = F.coalesce(F.nullif(bare("source_key"), F.lit("")), F.concat(F.lower(bare("employer_name")), F.lit("_auto")))
    one = rows.select(bare("employer_name").alias("employer_name"), key.alias("source_key"), (bare("operational_url") != "").alias("located"), derived_routing().alias("queue"))
    repeated = one.groupBy("employer_name", "source_key").count().where("count > 1").select("employer_name", F.concat(F.lit("repeated source key "), "source_key").alias("problem"))
    has = lambda q: F.bool_or(F.col("queue") == q)
    queues = one.where("located").groupBy("employer_name").agg(has("READY_TO_PROBE").alias("ready"), has("FINGERPRINT_REQUIRED").alias("prints"), has("ADAPTER_NEEDED").alias("adapter"))
    mixed = queues.select("employer_name", F.explode(F.array(*[F.when(F.col("ready") & F.col(c), F.lit(f"READY_TO_PROBE and {q}")) for c, q in (("prints", "FINGERPRINT_REQUIRED"), ("adapter", "ADAPTER_NEEDED"))])).alias("problem"))
    return repeated.unionByName(mixed.where("problem is not null"))


def refuse(problems: DataFrame, what: str) -> None:
    found = problems.limit(10).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def master_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """company_records, corporate_clusters, portals and cluster_portal_mappings of a checked master."""
    of = {"record_id": "Record ID", "corporate_cluster_id": "Corporate Cluster ID", "canonical_employer": "Canonical Employer", "sector": "Sector", "discovery_geography": "Discovery Geography", "primary_scan_eligibility": "Career Scan Eligible", "parent_group": "Parent Group", "resolution_wave": "Resolution Wave"}
    records = rows.select(*[bare(v).alias(k) for k, v in of.items()])
    names = {"sector": "sectors", "discovery_geography": "discovery_geographies", "canonical_employer": "canonical_employers", "parent_group": "parent_groups"}
    clusters = build_clusters(records, list(names)).withColumnsRenamed(names)
    resolved = rows.where(bare("Resolution Wave") != "").select(
        bare("Corporate Cluster ID").alias("corporate_cluster_id"), bare("Resolved Jobs Search URL").alias("jobs_url"), bare("ATS Family").alias("ats_family"), bare("ATS Confidence").alias("ats_confidence"), bare("Resolution Parent Override").alias("parent_override")
    )
    mappings = resolved.withColumn("normalized_url", jobs_url(F.col("jobs_url"))).where("normalized_url is not null")
    mappings = mappings.groupBy("corporate_cluster_id", "normalized_url").agg(*[F.min(c).alias(c) for c in ("ats_family", "ats_confidence", "parent_override")])
    return {"company_records": records, "corporate_clusters": clusters, "portals": build_portals(resolved), "cluster_portal_mappings": mappings}


def expected_metrics(rows: DataFrame) -> DataFrame:
    """Seven counts, read off the file's rows."""
    wave, cluster, url = bare("Resolution Wave") != "", bare("Corporate Cluster ID"), jobs_url(bare("Resolved Jobs Search URL"))
    url = F.when(wave, url)
    return rows.agg(
        F.count("*").alias("master_rows"), F.count_distinct(bare("Record ID")).alias("unique_record_ids"), F.count_distinct(cluster).alias("corporate_clusters"), F.count_if(wave).alias("resolved_rows"),
        F.count_distinct(F.when(wave, cluster)).alias("resolved_clusters"), F.count_distinct(url).alias("unique_resolved_jobs_urls"), F.count_distinct(F.when(url.isNotNull(), F.struct(cluster, url))).alias("cluster_portal_mappings"),
    )


def table_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """The same counts, read off the tables."""
    r, m = tables["company_records"], tables["cluster_portal_mappings"]
    one = r.agg(F.count("*").alias("master_rows"), F.count_distinct("record_id").alias("unique_record_ids"), F.count_if(F.col("resolution_wave") != "").alias("resolved_rows"))
    one = one.crossJoin(tables["corporate_clusters"].agg(F.count("*").alias("corporate_clusters"))).crossJoin(tables["portals"].agg(F.count("*").alias("unique_resolved_jobs_urls")))
    return one.crossJoin(m.agg(F.count_distinct("corporate_cluster_id").alias("resolved_clusters"), F.count("*").alias("cluster_portal_mappings")))  # single rows


def import_master(rows: DataFrame, batches: DataFrame, sha256: str) -> dict[str, DataFrame] | None:
    """Tables of a master file (columns MASTER); None for a file that was imported before.

    A second master, a bad row, and counts of the tables that differ from those of the file are errors.
    """
    if not may_import(batches, sha256, "master"):
        return None
    held = checked(rows, master())
    refuse(held.where(F.size("problems") > 0).select("Record ID", "problems"), "bad rows")
    tables = master_tables(good(held))
    expected, actual = expected_metrics(rows), table_metrics(tables)
    check_equal(expected, actual.select(*expected.columns))
    return tables


#: What tells one outside candidate from another.
IDENTITY = ["internal_company_id", "provider", "ats_family", "url", "slug"]


def import_candidates(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, counts) of a candidate file; storing them or not is the caller's, so a dry run is to drop them.

    Only rows of high confidence with a company, provider, family and URL count; the first of each identity (by
    ordinal) is stored unless it is already, always unverified.  Header names are tolerant of blanks and case.
    """
    tidy = {c.strip().lower(): c for c in rows.columns}
    pick = lambda *names: F.trim(F.coalesce(*[F.col(f"`{tidy[n]}`").cast("string") for n in names if n in tidy], F.lit("")))
    family, url = F.lower(pick("external_ats_family")), candidate_url(pick("external_url"))
    named = rows.select(
        pick("internal_company_id").alias("internal_company_id"), pick("external_provider").alias("provider"), family.alias("ats_family"), url.alias("url"), pick("external_slug", "external_slug / tenant id").alias("slug"),
        pick("match_class").alias("match_class"), pick("match_basis").alias("match_basis"), support_class_known(family).alias("support_class"), F.lit(False).alias("verified"), "ordinal",
    )
    high = F.col("match_class") == "HIGH_CONFIDENCE"
    whole = high & (F.col("internal_company_id") != "") & (F.col("provider") != "") & (F.col("ats_family") != "") & (F.col("url") != "")
    fresh = new_candidates(named.where(whole), stored, IDENTITY).drop("ordinal")
    told = named.agg(F.count("*").alias("input_rows"), F.count_if(high).alias("valid_high_rows"), F.count_if(~whole).alias("skipped_rows"), F.count_if(whole).alias("identity_rows"))
    families = fresh.groupBy("internal_company_id").agg(F.count_distinct("ats_family").alias("families"))
    added = fresh.agg(F.count("*").alias("inserted_rows"))
    several = families.agg(F.count("*").alias("companies_affected"), F.count_if(F.col("families") > 1).alias("multi_source_companies"))
    counts = told.crossJoin(added).crossJoin(several).withColumn("duplicate_rows", F.col("identity_rows") - F.col("inserted_rows")).drop("identity_rows")  # single rows
    return fresh, counts
