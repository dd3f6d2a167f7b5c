"""Schemas of the state tables, and a reader that adds columns which older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "company_records": "record_id string, corporate_cluster_id string, canonical_employer string, sector string, discovery_geography string, primary_scan_eligibility string",
    "corporate_clusters": "corporate_cluster_id string, representative string, canonical_employers array<string>, parent_groups array<string>, sectors array<string>, discovery_geographies array<string>, record_count int, has_primary_scan_eligibility boolean",
    "company_aliases": "normalized_alias string, alias string, corporate_cluster_id string, status string",
    "portals": "id long, jobs_search_url string, host string, ats_families array<string>, cluster_count int, metadata_conflict boolean, active_in_registry boolean, scan_enabled boolean, health_state string, access_state string, cooldown_until timestamp, last_block_reason string, last_http_status int, last_successful_scan_at timestamp, consecutive_failures int, consecutive_empty_scans int",
    "cluster_portal_mappings": "corporate_cluster_id string, portal_id long, parent_override string, ats_family string, ats_confidence string",
    "scan_runs": "id long, source string, status string, pipeline_status string, started_at timestamp, finished_at timestamp, portal_count int, success_count int, failure_count int, request_count int, retry_count int, http_2xx_count int, http_3xx_count int, http_4xx_count int, http_5xx_count int, http_429_count int, jobs_discovered int, new_jobs int, updated_jobs int, duplicates int, jobs_closed int",
    "portal_scan_attempts": "id long, scan_run_id long, portal_id long, adapter string, status string, http_status int, jobs_observed int, snapshot_complete boolean, warnings array<string>, error_type string, error_message string",
    "canonical_jobs": "canonical_job_id string, corporate_cluster_id string, title string, location string, country string, workplace_type string, seniority string, cyber_category string, filter_status string, active boolean, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, primary_apply_url string",
    "source_jobs": "id long, portal_id long, canonical_job_id string, source string, source_job_id string, adapter string, source_url string, apply_url string, raw_title string, raw_company string, raw_location string, raw_description string, resolved_company_name string, detail_title string, detail_location string, detail_description string, detail_url string, payload_sha256 string, ai_status string, is_active boolean, missing_successful_scans int, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp",
    "job_observations": "id long, source_job_row_id long, scan_run_id long, filter_status string, filter_decision_json string, cluster_resolution_json string",
    "job_ai_analyses": "id long, source_job_row_id long, model string, prompt_version string, input_hash string, valid boolean, candidate boolean, analysis_json string, ai_status string",
    "external_source_candidates": "internal_company_id string, provider string, ats_family string, slug string, url string, match_class string, match_basis string, support_class string, verified boolean",
    "registry_change_audit": "batch_id string, cluster_id string, action string, before string, after string",
    "import_batches": "kind string, source_sha256 string, row_count long, validation_json string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def evolved(df: DataFrame, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of the table in order; those that ``df`` lacks get their default or null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit((defaults or {}).get(f.name))).cast(f.dataType).alias(f.name) for f in schema(name).fields])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return evolved(spark.read.parquet(f"{folder}/{name}"), name)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
