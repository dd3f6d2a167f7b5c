"""The dashboard's queries over the state tables, each with SQL that an independent engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import predicates, resolve, windows
from ..session import importable
from . import dashboard as d
from .state_tables import CTES, State

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Structs opened, arrays joined by commas, times as text: values that engines print alike."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"{f.name}.{x}").alias(f"{f.name}_{x}") for x in f.dataType.names]
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(f.name, ",").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(sql: str):
    """Register a query over the state tables; its SQL goes on from their common table expressions."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(State(importable(spark), sf_dir)))
        ORACLE[f.__name__] = CTES + sql
        return f

    return add


TIME = lambda c, name=None: f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {name or c.split('.')[-1]}"
LAST = "last as (select * from (select *, row_number() over (partition by portal_id order by scan_run_id desc, id desc) as place from portal_scan_attempts) where place = 1)"
WITH_ATTEMPT = f"""{LAST}, seen as (
    select p.*, l.status, l.adapter, l.http_status, l.snapshot_complete, l.jobs_observed, l.warnings, l.error_type, l.error_message,
        case when l.status is null then 'NEVER_SCANNED' when l.error_type = 'RobotsDisallowed' or p.access_state = 'ROBOTS_DENIED' then 'ROBOTS_DENIAL'
             when l.error_type in ('AccessChallengeError', 'HostCircuitOpenError') or p.access_state in ('ACCESS_DENIED', 'CHALLENGE') then 'ACCESS_DENIAL'
             when l.status = 'SUCCESS' and len(l.warnings) = 0 then 'HEALTHY' when l.status = 'SUCCESS' then 'WARNING' when l.error_type = 'AdapterSchemaError' then 'SCHEMA_DRIFT'
             when l.http_status = 404 or contains(lower(coalesce(l.error_message, '')), 'not found') then 'STALE_ROUTE' else 'TRANSIENT_FAILURE' end as issue_category
    from portals p left join last l on l.portal_id = p.id where p.active_in_registry
)"""
FLAGS = """flags as (
    select canonical_job_id, list_sort(list(distinct source)) as sources, bool_or(contains(lower(source), 'linkedin')) as li, bool_or(not contains(lower(source), 'linkedin')) as official
    from source_jobs where canonical_job_id is not null group by 1
)"""
CONTEXT = f"""{FLAGS}, {LAST}, whole as (
    select canonical_job_id, bool_or(coalesce(l.status = 'SUCCESS' and l.snapshot_complete, false)) as complete from source_jobs s left join last l on l.portal_id = s.portal_id where canonical_job_id is not null group by 1
), context as (
    select j.*, coalesce(nullif(c.representative, ''), 'Unresolved') as company, coalesce(array_to_string(f.sources, ', '), '') as sources, case when w.complete then 'complete' else 'incomplete' end as lifecycle_confidence
    from canonical_jobs j left join corporate_clusters c using (corporate_cluster_id) left join flags f using (canonical_job_id) left join whole w using (canonical_job_id)
)"""
OR = lambda c, default, name=None: f"coalesce(nullif({c}, ''), '{default}') as {name or c}"
COVERAGE = f"""{WITH_ATTEMPT}, coverage as (
    select (select count(*) from company_records) as master_rows, (select count(*) from corporate_clusters) as corporate_clusters, (select count(distinct corporate_cluster_id) from cluster_portal_mappings) as resolved_clusters,
        count(*) as unique_portals, count(status) as scanned_portals, count(*) filter (where scan_enabled and access_state = 'AVAILABLE') as scannable_portals, count(*) filter (where not (scan_enabled and access_state = 'AVAILABLE')) as suspended_portals,
        count(*) filter (where health_state = 'HEALTHY') as healthy_portals, count(*) filter (where health_state = 'DEGRADED') as degraded_portals, count(*) filter (where health_state = 'BROKEN') as broken_portals,
        count(*) filter (where issue_category = 'STALE_ROUTE') as stale_portals, count(*) filter (where health_state = 'UNKNOWN') as unknown_portals
    from seen
), jobs as (
    select count(*) as total_canonical_jobs, count(*) filter (where active) as active_jobs, count(*) filter (where filter_status = 'INCLUDE' and active) as included_active_jobs, count(*) filter (where filter_status = 'REVIEW' and active) as review_jobs,
        count(*) filter (where not active) as closed_jobs, count(*) filter (where official and not coalesce(li, false)) as official_only, count(*) filter (where li and not official) as linkedin_only, count(*) filter (where li and official) as found_on_both
    from canonical_jobs left join flags using (canonical_job_id)
)"""


@query(f", {FLAGS}, {COVERAGE} select *, corporate_clusters - resolved_clusters as unresolved_clusters from coverage")
def coverage_summary(t: State) -> DataFrame:
    return d.coverage_summary(t)


@query(f", {FLAGS}, {COVERAGE} select * from jobs")
def dashboard_job_summary(t: State) -> DataFrame:
    return d.job_summary(t)


@query(f""", {FLAGS}, {COVERAGE} select {', '.join(f'c.{x} as coverage_{x}' for x in ('master_rows', 'corporate_clusters', 'resolved_clusters', 'unique_portals', 'scanned_portals', 'scannable_portals', 'suspended_portals', 'healthy_portals', 'degraded_portals', 'broken_portals', 'stale_portals', 'unknown_portals'))},
    c.corporate_clusters - c.resolved_clusters as coverage_unresolved_clusters, {', '.join(f'j.{x} as jobs_{x}' for x in ('total_canonical_jobs', 'active_jobs', 'included_active_jobs', 'review_jobs', 'closed_jobs', 'official_only', 'linkedin_only', 'found_on_both'))} from coverage c, jobs j""")
def dashboard_summaries(t: State) -> DataFrame:
    return d.summaries(t)


@query("""select (select max(id) from scan_runs) as latest_run_id, (select arg_max(new_jobs, id) from scan_runs) as new_jobs_latest_run, count(*) filter (where first_seen_at >= timestamp '2001-06-15') as new_jobs_today,
    count(*) filter (where first_seen_at >= timestamp '2001-06-15 10:00:00' - interval 30 day) as new_jobs_period, 30 as period_days from canonical_jobs""")
def dashboard_job_activity(t: State) -> DataFrame:
    return d.job_activity_summary(t, F.lit("2001-06-15 10:00:00").cast("timestamp"), 30)


@query(f""", {FLAGS}, a as (select j.*, c.representative, f.sources from canonical_jobs j left join corporate_clusters c using (corporate_cluster_id) left join flags f using (canonical_job_id) where active), v as (
    select 'Country' as dimension, {OR('country', 'Unknown', 'value')} from a union all select 'Company', {OR('representative', 'Unresolved')} from a union all select 'Cyber category', {OR('cyber_category', 'Review')} from a
    union all select 'Seniority', {OR('seniority', 'Review')} from a union all select 'Workplace', {OR('workplace_type', 'Unknown')} from a union all select 'Source', unnest(coalesce(sources, ['Unknown'])) from a)
select dimension, value, count(*) as active_jobs from v group by 1, 2""")
def dashboard_job_breakdown(t: State) -> DataFrame:
    return d.job_breakdown_rows(t)


@query(f""", {CONTEXT} select canonical_job_id, title, company, {OR('country', 'Unknown')}, location, {OR('workplace_type', 'Unknown')}, {OR('seniority', 'Review')}, {OR('cyber_category', 'Review')}, filter_status, active, lifecycle_confidence,
    {TIME('posted_at')}, {TIME('first_seen_at')}, {TIME('last_seen_at')}, sources, primary_apply_url as apply_url from context""")
def dashboard_job_rows(t: State) -> DataFrame:
    return d.job_rows(t)


@query(f""", {CONTEXT}, o as (
    select canonical_job_id, filter_decision_json as d, cluster_resolution_json as r from (select s.canonical_job_id, o.*, row_number() over (partition by s.canonical_job_id order by o.id desc) as place
    from job_observations o join source_jobs s on s.id = o.source_job_row_id where s.canonical_job_id is not null) where place = 1
), g as (
    select *, list_filter([case when json_extract_string(d, '$.cyber.status') = 'REVIEW' then 'cyber: ' || coalesce(json_extract_string(d, '$.cyber.reason'), 'review required') end,
        case when json_extract_string(d, '$.seniority.status') = 'REVIEW' then 'seniority: ' || coalesce(json_extract_string(d, '$.seniority.reason'), 'review required') end,
        case when json_extract_string(d, '$.geography.status') = 'REVIEW' then 'geography: ' || coalesce(json_extract_string(d, '$.geography.reason'), 'review required') end,
        case when coalesce(json_extract_string(r, '$.corporate_cluster_id'), '') = '' then 'company: ' || coalesce(json_extract_string(r, '$.method'), 'unresolved') end], lambda x: x is not null) as signals,
        json_extract_string(r, '$.method') as method from context left join o using (canonical_job_id) where active and filter_status = 'REVIEW'
) select canonical_job_id, title, company, {OR('location', 'Unknown')}, {OR('seniority', 'Unresolved')}, {OR('cyber_category', 'Unresolved')}, {OR("array_to_string(signals, ' | ')", 'No latest decision evidence', 'ambiguity_signals')},
    {OR('method', 'unknown', 'company_resolution')}, lifecycle_confidence, sources, {TIME('last_seen_at')}, primary_apply_url as apply_url from g""")
def dashboard_review_queue(t: State) -> DataFrame:
    return d.review_queue_rows(t)


SOURCE_ROWS = f""", {LAST}, w as (select s.*, coalesce(l.status = 'SUCCESS' and l.snapshot_complete, false) as whole from source_jobs s left join last l on l.portal_id = s.portal_id)
select id as source_job_row_id, {OR('canonical_job_id', 'Unresolved')}, source, adapter, raw_title as title, {OR('raw_company', 'Unresolved', 'company')}, {OR('raw_location', 'Unknown', 'location')}, is_active as active,
    case when whole then 'complete' else 'incomplete' end as lifecycle_confidence, whole as latest_snapshot_complete, missing_successful_scans, {TIME('last_seen_at')}, apply_url from w"""


@query(f"{SOURCE_ROWS} where is_active")
def dashboard_source_jobs(t: State) -> DataFrame:
    return d.source_job_rows(t)


@query(SOURCE_ROWS)
def dashboard_source_jobs_all(t: State) -> DataFrame:
    return d.source_job_rows(t, active_only=False)


@query(f""", runs as (select * from scan_runs order by id desc limit 20), per as (
    select a.scan_run_id as id, count(distinct case when a.status <> 'SUCCESS' then p.host end) as failed_domains, count(*) filter (where a.error_type = 'AdapterSchemaError') as parser_failures,
        count(*) filter (where a.status = 'SUCCESS' and a.snapshot_complete and a.jobs_observed = 0 and not list_contains(a.warnings, 'upstream reports zero active jobs')) as unexpected_empty_complete
    from portal_scan_attempts a join portals p on p.id = a.portal_id group by 1)
select r.id as run_id, source, status, pipeline_status, {TIME('started_at')}, {TIME('finished_at')}, floor(epoch(finished_at) - epoch(started_at)) as duration_seconds, portal_count as portals, success_count as successes, failure_count as failures, request_count as requests,
    retry_count as retries, http_2xx_count as http_2xx, http_3xx_count as http_3xx, http_4xx_count as http_4xx, http_5xx_count as http_5xx, http_429_count as http_429, coalesce(failed_domains, 0) as failed_domains, coalesce(parser_failures, 0) as parser_failures,
    coalesce(unexpected_empty_complete, 0) as unexpected_empty_complete, jobs_discovered, new_jobs, updated_jobs, duplicates, jobs_closed as closed_jobs from runs r left join per on per.id = r.id""")
def dashboard_scan_runs(t: State) -> DataFrame:
    return d.scan_run_rows(t, 20).withColumn("duration_seconds", F.floor("duration_seconds").cast("double"))


@query(f""", {WITH_ATTEMPT} select id as portal_id, host, jobs_search_url as jobs_url, cluster_count as clusters, array_to_string(ats_families, ',') as ats_families, metadata_conflict, health_state as health, access_state, scan_enabled, cast(null as varchar) as cooldown_until,
    cast(null as varchar) as last_block_reason, cast(null as int) as last_http_status, {TIME('last_successful_scan_at', 'last_successful_scan')}, consecutive_failures, consecutive_empty_scans, coalesce(status, 'NEVER_SCANNED') as latest_attempt_status,
    coalesce(adapter, 'Unknown') as latest_adapter, coalesce(snapshot_complete, false) as latest_snapshot_complete, coalesce(array_to_string(warnings, ' | '), '') as latest_warnings, error_type as latest_error_type, error_message as latest_error, issue_category from seen""")
def dashboard_portals(t: State) -> DataFrame:
    return d.portal_rows(t)


ADAPTERS = """, r as (select *, case when contains(host, 'greenhouse.io') then 'greenhouse' when contains(host, 'lever.co') then 'lever' when contains(host, 'myworkdayjobs.com') then 'workday' else 'official_html' end as adapter from portals where active_in_registry and scan_enabled)"""


@query(f"""{ADAPTERS} select adapter, count(*) as portals, count(*) filter (where health_state = 'HEALTHY') as healthy, count(*) filter (where health_state = 'DEGRADED') as degraded, count(*) filter (where health_state = 'UNKNOWN') as unknown,
    case when adapter = 'official_html' then 'incomplete fallback' else 'structured' end as coverage_type from r group by adapter""")
def dashboard_adapter_coverage(t: State) -> DataFrame:
    return d.adapter_coverage_rows(t)


@query(f"{ADAPTERS} select adapter, count(*) as portals from r group by adapter")
def cli_adapter_coverage(t: State) -> DataFrame:
    return d.adapter_coverage(t)


@query(""", c as (select * from corporate_clusters where corporate_cluster_id not in (select corporate_cluster_id from cluster_portal_mappings)),
f as (select * from c order by has_primary_scan_eligibility desc, record_count desc, representative limit 120),
s as (select *, lower(representative || ' ' || array_to_string(sectors, ' ')) as words from f)
select corporate_cluster_id, representative as company, least(record_count, 10) * 2 + case when has_primary_scan_eligibility then 5 else 0 end + case when regexp_matches(words, 'cyber|security|technology|digital|consult') then 4 else 0 end
        + case when len(discovery_geographies) > 0 then 2 else 0 end as priority_score, record_count as records, has_primary_scan_eligibility as primary_scan_eligible, array_to_string(sectors, ' | ') as sectors, array_to_string(discovery_geographies, ' | ') as discovery_geographies
from s order by priority_score desc, record_count desc, representative limit 30""")
def dashboard_high_value_unresolved(t: State) -> DataFrame:
    return d.high_value_unresolved_rows(t, 30)


COVERED = lambda c: f""" select {c}, count(distinct record_id) as master_rows, count(distinct r.corporate_cluster_id) as corporate_clusters, count(distinct m.corporate_cluster_id) as resolved_clusters_present
    from company_records r left join cluster_portal_mappings m on m.corporate_cluster_id = r.corporate_cluster_id group by 1"""  # noqa: E731


@query(COVERED("discovery_geography"))
def dashboard_discovery_coverage(t: State) -> DataFrame:
    return d.discovery_coverage_rows(t)


@query(COVERED("sector"))
def dashboard_sector_coverage(t: State) -> DataFrame:
    return d.sector_coverage_rows(t)


@query(" select filter_status, scan_run_id, count(*) as observations from job_observations where scan_run_id = (select max(scan_run_id) from job_observations) group by 1, 2")
def dashboard_latest_filter_counts(t: State) -> DataFrame:
    return d.latest_filter_counts(t)


@query(""" select count(*) filter (where ai_status = 'PENDING_AI') as pending, count(*) filter (where ai_status = 'CYBER') as cyber, count(*) filter (where ai_status = 'NON_CYBER') as non_cyber,
    count(*) filter (where ai_status = 'NEEDS_MORE_DETAIL') as needs_detail from source_jobs where is_active""")
def dashboard_ai_summary(t: State) -> DataFrame:
    return d.ai_v2_summary(t)


AI_ROWS = lambda where: f""", a as (select * from (select *, row_number() over (partition by source_job_row_id order by id desc) as place from job_ai_analyses where valid {where}) where place = 1),
j as (select s.*, a.model, analysis_json as p from source_jobs s join a on a.source_job_row_id = s.id where s.ai_status = 'CYBER' and is_active)
select coalesce(nullif(resolved_company_name, ''), nullif(raw_company, ''), 'Unresolved') as company, coalesce(nullif(detail_title, ''), raw_title) as title, json_extract_string(p, '$.role_family') as role_family,
    array_to_string(cast(json_extract(p, '$.specializations') as varchar[]), ', ') as specializations, json_extract_string(p, '$.seniority') as seniority, cast(json_extract(p, '$.years_experience_min') as double) as years_min,
    cast(json_extract(p, '$.years_experience_max') as double) as years_max, coalesce(nullif(detail_location, ''), raw_location) as location, coalesce(array_to_string(cast(json_extract(p, '$.skills_required') as varchar[]), ', '), '') as skills_required,
    '' as skills_preferred, cast(null as varchar) as degree_requirement, '' as certifications, {TIME('first_seen_at')}, {TIME('last_seen_at')}, {TIME('posted_at')}, apply_url, coalesce(nullif(detail_url, ''), source_url) as source_url,
    length(coalesce(nullif(detail_description, ''), raw_description, '')) as description_chars, coalesce(detail_description, '') <> '' as detail_enriched, adapter, model from j"""  # noqa: E731


@query(AI_ROWS(""))
def dashboard_ai_jobs(t: State) -> DataFrame:
    return d.ai_cyber_job_rows(t)


@query(AI_ROWS("and not starts_with(prompt_version, 'triage:')"))
def dashboard_ai_jobs_analyzed(t: State) -> DataFrame:
    return d.ai_cyber_job_rows(t, skip_triage=True)


@query(""", a as (select * from (select *, row_number() over (partition by source_job_row_id order by id desc) as place from job_ai_analyses) where place = 1)
select id, source_job_row_id, model, ai_status, valid from a where ai_status = 'CYBER' order by id desc limit 25""")
def cli_show_ai_results(t: State) -> DataFrame:
    return d.show_ai_results(t, "CYBER", 25).select("id", "source_job_row_id", "model", "ai_status", "valid")


@query(" select id, portal_id, raw_title, ai_status from source_jobs where portal_id = 7 order by id limit 50")
def cli_show_portal_jobs(t: State) -> DataFrame:
    return d.show_portal_jobs(t, 7, 50).select("id", "portal_id", "raw_title", "ai_status")


@query(" select ai_status, count(*) as jobs from source_jobs where portal_id = 7 group by 1")
def cli_portal_job_statuses(t: State) -> DataFrame:
    return d.portal_job_statuses(t, 7)


@query(""" select (select count(*) from company_records) as company_records, (select count(*) from corporate_clusters) as corporate_clusters, (select count(*) from cluster_portal_mappings) as cluster_portal_mappings,
    (select count(*) from portals) as portals, (select count(*) from external_source_candidates) as external_source_candidates""")
def cli_metrics(t: State) -> DataFrame:
    return d.database_metrics(t)


@query(f""", {CONTEXT} select canonical_job_id, lifecycle_confidence from context where sources <> ''""")
def a23_lifecycle_confidence(t: State) -> DataFrame:
    return d.lifecycle_confidence(t)


@query(" select id as portal_id, host from portals where active_in_registry and scan_enabled order by host, jobs_search_url limit 60")
def f1_portal_targets(t: State) -> DataFrame:
    return predicates.portal_targets(t["portals"], limit=60).select(F.col("id").alias("portal_id"), "host")


@query(" select id as portal_id from portals where active_in_registry and id in (0, 3, 5, 10, 11)")
def f1_named_targets(t: State) -> DataFrame:
    return predicates.portal_targets(t["portals"], ids=[0, 3, 5, 10, 11], include_disabled=True).select(F.col("id").alias("portal_id"))


@query(""" select corporate_cluster_id, representative, record_count, has_primary_scan_eligibility, array_to_string(sectors, ',') as sectors, array_to_string(discovery_geographies, ',') as discovery_geographies,
    array_to_string(canonical_employers, ',') as canonical_employers from corporate_clusters""")
def a10_build_clusters(t: State) -> DataFrame:
    out = resolve.build_clusters(t["company_records"], ["sector", "discovery_geography", "canonical_employer"])
    names = {"sector": "sectors", "discovery_geography": "discovery_geographies", "canonical_employer": "canonical_employers"}
    return out.withColumnsRenamed(names)


@query(""", o as (select s.canonical_job_id, o.*, row_number() over (partition by s.canonical_job_id order by o.id desc) as place from job_observations o join source_jobs s on s.id = o.source_job_row_id where s.canonical_job_id is not null)
select canonical_job_id, id, source_job_row_id, scan_run_id from o where place = 1""")
def j6_latest_observation_of_job(t: State) -> DataFrame:
    return windows.latest_observations(t["source_jobs"], t["job_observations"]).select("canonical_job_id", "id", "source_job_row_id", "scan_run_id")


@query(""" select * exclude (place) from (select source_job_row_id, id, model, row_number() over (partition by source_job_row_id order by id desc) as place from job_ai_analyses where valid and not starts_with(prompt_version, 'triage:')) where place = 1""")
def j7_latest_analysis_of_job(t: State) -> DataFrame:
    return windows.latest_analyses(t["job_ai_analyses"], True, True).select("source_job_row_id", "id", "model")
