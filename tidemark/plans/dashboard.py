"""The dashboard's queries over the state tables: one plan each, from a mapping of table names to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or
from ..functions.values import duration_seconds, json_get
from ..operators.predicates import effective, portal_issue, portal_targets, unexpected_empty
from ..operators.windows import latest_analyses, latest_attempts, latest_observations, two_stage_top
from ..sources.parsers import route

Tables = dict[str, DataFrame]
#: Words that mark a company as likely to matter (fixed values).
SIGNALS = ("cyber", "security", "technology", "digital", "consult")


def portals_with_attempt(t: Tables) -> DataFrame:
    """Active portals with their latest attempt as struct ``a`` and their issue class."""
    last = latest_attempts(t["portal_scan_attempts"])
    last = last.select(F.col("portal_id").alias("id"), F.struct("status", "adapter", "http_status", "snapshot_complete", "jobs_observed", "warnings", "error_type", "error_message").alias("a"))
    rows = t["portals"].where("active_in_registry").join(last, "id", "left")
    issue = portal_issue(F.col("a.status"), F.col("a.error_type"), F.col("a.error_message"), F.col("a.http_status"), F.col("access_state"), F.coalesce("a.warnings", F.array().cast("array<string>")))
    return rows.withColumn("issue_category", issue)


def coverage_summary(t: Tables) -> DataFrame:
    ready = F.col("scan_enabled") & (F.col("access_state") == "AVAILABLE")
    health = lambda s: F.count_if(F.col("health_state") == s)
    portals = portals_with_attempt(t).agg(
        F.count("*").alias("unique_portals"), F.count_if(F.col("a").isNotNull()).alias("scanned_portals"), F.count_if(ready).alias("scannable_portals"), (F.count("*") - F.count_if(ready)).alias("suspended_portals"),
        health("HEALTHY").alias("healthy_portals"), health("DEGRADED").alias("degraded_portals"), health("BROKEN").alias("broken_portals"), F.count_if(F.col("issue_category") == "STALE_ROUTE").alias("stale_portals"), health("UNKNOWN").alias("unknown_portals"),
    )
    records = t["company_records"].agg(F.count("*").alias("master_rows"))
    clusters = t["corporate_clusters"].agg(F.count("*").alias("corporate_clusters"))
    resolved = t["cluster_portal_mappings"].agg(F.count_distinct("corporate_cluster_id").alias("resolved_clusters"))
    out = records.crossJoin(clusters).crossJoin(resolved).crossJoin(portals)  # four rows of one
    return out.withColumn("unresolved_clusters", F.col("corporate_clusters") - F.col("resolved_clusters"))


def source_flags(t: Tables) -> DataFrame:
    """(canonical_job_id, sources sorted, has_linkedin, has_official)."""
    s, inside = F.col("source"), F.lower("source").contains("linkedin")
    return t["source_jobs"].where("canonical_job_id is not null").groupBy("canonical_job_id").agg(F.array_sort(F.collect_set(s)).alias("sources"), F.bool_or(inside).alias("has_linkedin"), F.bool_or(~inside).alias("has_official"))


def job_summary(t: Tables) -> DataFrame:
    rows = t["canonical_jobs"].join(source_flags(t), "canonical_job_id", "left")
    li, of = F.coalesce("has_linkedin", F.lit(False)), F.coalesce("has_official", F.lit(False))
    status = lambda s: F.count_if((F.col("filter_status") == s) & F.col("active"))
    return rows.agg(
        F.count("*").alias("total_canonical_jobs"), F.count_if("active").alias("active_jobs"), status("INCLUDE").alias("included_active_jobs"), status("REVIEW").alias("review_jobs"), F.count_if(~F.col("active")).alias("closed_jobs"),
        F.count_if(of & ~li).alias("official_only"), F.count_if(li & ~of).alias("linkedin_only"), F.count_if(li & of).alias("found_on_both"),
    )


def job_activity_summary(t: Tables, now: Column, period_days: int = 7) -> DataFrame:
    if period_days < 1:
        raise ValueError("period_days must be at least 1")
    jobs = t["canonical_jobs"].agg(F.count_if(F.col("first_seen_at") >= F.date_trunc("DAY", now)).alias("new_jobs_today"), F.count_if(F.col("first_seen_at") >= now - F.make_dt_interval(F.lit(period_days))).alias("new_jobs_period"))
    run = t["scan_runs"].agg(F.max("id").alias("latest_run_id"), F.coalesce(F.max_by("new_jobs", "id"), F.lit(0)).alias("new_jobs_latest_run"))
    return run.crossJoin(jobs).withColumn("period_days", F.lit(period_days))  # two rows of one


def companies(t: Tables) -> DataFrame:
    return t["corporate_clusters"].select("corporate_cluster_id", F.col("representative").alias("company"))


DIMENSIONS = ("Country", "Company", "Cyber category", "Seniority", "Workplace", "Source")


def job_breakdown_rows(t: Tables) -> DataFrame:
    rows = t["canonical_jobs"].where("active").join(companies(t), "corporate_cluster_id", "left").join(source_flags(t).select("canonical_job_id", "sources"), "canonical_job_id", "left")
    pair = lambda i, v: F.struct(F.lit(i).alias("place"), v.alias("value"))
    fixed = [text_or("country", "Unknown"), text_or("company", "Unresolved"), text_or("cyber_category", "Review"), text_or("seniority", "Review"), text_or("workplace_type", "Unknown")]
    sources = F.transform(F.coalesce("sources", F.array(F.lit("Unknown"))), lambda s: pair(5, s))
    long = rows.select(F.inline(F.concat(F.array(*[pair(i, v) for i, v in enumerate(fixed)]), sources)))
    counted = long.groupBy("place", "value").agg(F.count("*").alias("active_jobs"))
    name = F.get(F.array(*map(F.lit, DIMENSIONS)), F.col("place"))
    return counted.orderBy("place", F.desc("active_jobs"), "value").select(name.alias("dimension"), "value", "active_jobs")


def lifecycle_confidence(t: Tables) -> DataFrame:
    """(canonical_job_id, lifecycle_confidence): complete if any source's portal ended with a complete success."""
    last = latest_attempts(t["portal_scan_attempts"]).select("portal_id", ((F.col("status") == "SUCCESS") & F.col("snapshot_complete")).alias("whole"))
    rows = t["source_jobs"].where("canonical_job_id is not null").join(last, "portal_id", "left")
    return rows.groupBy("canonical_job_id").agg(F.when(F.bool_or(F.coalesce("whole", F.lit(False))), "complete").otherwise("incomplete").alias("lifecycle_confidence"))


def jobs_with_context(t: Tables, jobs: DataFrame) -> DataFrame:
    out = jobs.join(companies(t), "corporate_cluster_id", "left").join(source_flags(t).select("canonical_job_id", F.array_join("sources", ", ").alias("sources")), "canonical_job_id", "left").join(lifecycle_confidence(t), "canonical_job_id", "left")
    return out.withColumns({"company": text_or("company", "Unresolved"), "sources": F.coalesce("sources", F.lit("")), "lifecycle_confidence": F.coalesce("lifecycle_confidence", F.lit("incomplete"))})


def job_rows(t: Tables) -> DataFrame:
    rows = jobs_with_context(t, t["canonical_jobs"])
    return rows.orderBy(F.desc("first_seen_at")).select(
        "canonical_job_id", "title", "company", text_or("country", "Unknown").alias("country"), "location", text_or("workplace_type", "Unknown").alias("workplace_type"), text_or("seniority", "Review").alias("seniority"),
        text_or("cyber_category", "Review").alias("cyber_category"), "filter_status", "active", "lifecycle_confidence", "posted_at", "first_seen_at", "last_seen_at", "sources", F.col("primary_apply_url").alias("apply_url"),
    )


def ambiguity_signals(decision: Column, resolution: Column) -> Column:
    """What a decision left to review, and an unresolved company."""
    parts = []
    for gate in ("cyber", "seniority", "geography"):
        reason = F.coalesce(json_get(decision, f"{gate}.reason"), F.lit("review required"))
        parts.append(F.when(json_get(decision, f"{gate}.status") == "REVIEW", F.concat(F.lit(f"{gate}: "), reason)))
    unresolved = text_or(json_get(resolution, "corporate_cluster_id"), "") == ""
    parts.append(F.when(unresolved, F.concat(F.lit("company: "), F.coalesce(json_get(resolution, "method"), F.lit("unresolved")))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def review_queue_rows(t: Tables) -> DataFrame:
    last = latest_observations(t["source_jobs"], t["job_observations"]).select("canonical_job_id", F.col("filter_decision_json").alias("d"), F.col("cluster_resolution_json").alias("r"))
    rows = jobs_with_context(t, t["canonical_jobs"].where("active and filter_status = 'REVIEW'")).join(last, "canonical_job_id", "left")
    return rows.orderBy(F.desc("first_seen_at")).select(
        "canonical_job_id", "title", "company", text_or("location", "Unknown").alias("location"), text_or("seniority", "Unresolved").alias("seniority"), text_or("cyber_category", "Unresolved").alias("cyber_category"),
        text_or(F.array_join(ambiguity_signals(F.col("d"), F.col("r")), " | "), "No latest decision evidence").alias("ambiguity_signals"), text_or(json_get(F.col("r"), "method"), "unknown").alias("company_resolution"),
        "lifecycle_confidence", "sources", "last_seen_at", F.col("primary_apply_url").alias("apply_url"),
    )


def source_job_rows(t: Tables, active_only: bool = True) -> DataFrame:
    last = latest_attempts(t["portal_scan_attempts"]).select("portal_id", ((F.col("status") == "SUCCESS") & F.col("snapshot_complete")).alias("whole"))
    rows = t["source_jobs"].where("is_active") if active_only else t["source_jobs"]
    rows = rows.join(last, "portal_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return rows.orderBy(F.desc("last_seen_at")).select(
        F.col("id").alias("source_job_row_id"), text_or("canonical_job_id", "Unresolved").alias("canonical_job_id"), "source", "adapter", F.col("raw_title").alias("title"), text_or("raw_company", "Unresolved").alias("company"),
        text_or("raw_location", "Unknown").alias("location"), F.col("is_active").alias("active"), F.when(F.col("whole"), "complete").otherwise("incomplete").alias("lifecycle_confidence"), F.col("whole").alias("latest_snapshot_complete"),
        "missing_successful_scans", "last_seen_at", "apply_url",
    )


def scan_run_rows(t: Tables, limit: int = 100) -> DataFrame:
    runs = t["scan_runs"].orderBy(F.desc("id")).limit(limit)
    attempts = t["portal_scan_attempts"].join(t["portals"].select(F.col("id").alias("portal_id"), "host"), "portal_id").join(runs.select(F.col("id").alias("scan_run_id")), "scan_run_id", "left_semi")
    empty = unexpected_empty(F.col("status"), F.col("snapshot_complete"), F.col("jobs_observed"), F.col("warnings"))
    per = attempts.groupBy(F.col("scan_run_id").alias("id")).agg(F.count_distinct(F.when(F.col("status") != "SUCCESS", F.col("host"))).alias("failed_domains"), F.count_if(F.col("error_type") == "AdapterSchemaError").alias("parser_failures"), F.count_if(empty).alias("unexpected_empty_complete"))
    rows = runs.join(per, "id", "left").fillna(0, ["failed_domains", "parser_failures", "unexpected_empty_complete"])
    http = [F.col(f"http_{k}_count").alias(f"http_{k}") for k in ("2xx", "3xx", "4xx", "5xx", "429")]
    return rows.orderBy(F.desc("id")).select(
        F.col("id").alias("run_id"), "source", "status", "pipeline_status", "started_at", "finished_at", duration_seconds(F.col("started_at"), F.col("finished_at")).alias("duration_seconds"), F.col("portal_count").alias("portals"),
        F.col("success_count").alias("successes"), F.col("failure_count").alias("failures"), F.col("request_count").alias("requests"), F.col("retry_count").alias("retries"), *http, "failed_domains", "parser_failures", "unexpected_empty_complete",
        "jobs_discovered", "new_jobs", "updated_jobs", "duplicates", F.col("jobs_closed").alias("closed_jobs"),
    )


def portal_rows(t: Tables) -> DataFrame:
    return portals_with_attempt(t).orderBy("host").select(
        F.col("id").alias("portal_id"), "host", F.col("jobs_search_url").alias("jobs_url"), F.col("cluster_count").alias("clusters"), "ats_families", "metadata_conflict", F.col("health_state").alias("health"), "access_state", "scan_enabled", "cooldown_until",
        "last_block_reason", "last_http_status", F.col("last_successful_scan_at").alias("last_successful_scan"), "consecutive_failures", "consecutive_empty_scans", F.coalesce("a.status", F.lit("NEVER_SCANNED")).alias("latest_attempt_status"),
        F.coalesce("a.adapter", F.lit("Unknown")).alias("latest_adapter"), F.coalesce("a.snapshot_complete", F.lit(False)).alias("latest_snapshot_complete"), F.coalesce(F.array_join("a.warnings", " | "), F.lit("")).alias("latest_warnings"),
        F.col("a.error_type").alias("latest_error_type"), F.col("a.error_message").alias("latest_error"), "issue_category",
    )


def adapter_coverage_rows(t: Tables, bound: dict[str, str] | None = None) -> DataFrame:
    rows = portal_targets(t["portals"]).withColumn("adapter", route(F.col("jobs_search_url"), F.get("ats_families", F.lit(0)), bound))
    health = lambda s: F.count_if(F.upper("health_state") == s).alias(s.lower())
    out = rows.groupBy("adapter").agg(F.count("*").alias("portals"), health("HEALTHY"), health("DEGRADED"), health("UNKNOWN"))
    return out.withColumn("coverage_type", F.when(F.col("adapter") == "official_html", "incomplete fallback").otherwise("structured")).orderBy(F.desc("portals"), "adapter")


def high_value_unresolved_rows(t: Tables, limit: int = 100) -> DataFrame:
    rows = t["corporate_clusters"].join(t["cluster_portal_mappings"].select("corporate_cluster_id"), "corporate_cluster_id", "left_anti")
    text = F.lower(F.concat_ws(" ", "representative", "sectors"))
    signal = F.lit(False)
    for word in SIGNALS:
        signal = signal | text.contains(word)
    score = F.least("record_count", F.lit(10)) * 2 + F.when(F.col("has_primary_scan_eligibility"), 5).otherwise(0) + F.when(signal, 4).otherwise(0) + F.when(F.size("discovery_geographies") > 0, 2).otherwise(0)
    first = [F.desc("has_primary_scan_eligibility"), F.desc("record_count"), F.col("representative")]
    return two_stage_top(rows, limit, first, score, [F.desc("priority_score"), F.desc("record_count"), F.col("representative")]).select(
        "corporate_cluster_id", F.col("representative").alias("company"), "priority_score", F.col("record_count").alias("records"), F.col("has_primary_scan_eligibility").alias("primary_scan_eligible"),
        F.array_join("sectors", " | ").alias("sectors"), F.array_join("discovery_geographies", " | ").alias("discovery_geographies"),
    )


def attribute_coverage(t: Tables, attribute: str) -> DataFrame:
    resolved = t["cluster_portal_mappings"].select("corporate_cluster_id", F.col("corporate_cluster_id").alias("resolved")).distinct()
    rows = t["company_records"].join(resolved, "corporate_cluster_id", "left")
    out = rows.groupBy(attribute).agg(F.count_distinct("record_id").alias("master_rows"), F.count_distinct("corporate_cluster_id").alias("corporate_clusters"), F.count_distinct("resolved").alias("resolved_clusters_present"))
    return out.orderBy(F.desc("master_rows"))


def discovery_coverage_rows(t: Tables) -> DataFrame:
    return attribute_coverage(t, "discovery_geography")


def sector_coverage_rows(t: Tables) -> DataFrame:
    return attribute_coverage(t, "sector")


def latest_filter_counts(t: Tables) -> DataFrame:
    o = t["job_observations"]
    last = o.agg(F.max("scan_run_id").alias("scan_run_id"))
    return o.join(F.broadcast(last), "scan_run_id").groupBy("filter_status", "scan_run_id").agg(F.count("*").alias("observations")).orderBy("filter_status")


def summaries(t: Tables) -> DataFrame:
    """One row: coverage and jobs as structs."""
    pack = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    return pack(coverage_summary(t), "coverage").crossJoin(pack(job_summary(t), "jobs"))


def ai_v2_summary(t: Tables) -> DataFrame:
    count = lambda s, n: F.count_if(F.col("ai_status") == s).alias(n)
    return t["source_jobs"].where("is_active").agg(count("PENDING_AI", "pending"), count("CYBER", "cyber"), count("NON_CYBER", "non_cyber"), count("NEEDS_MORE_DETAIL", "needs_detail"))


def ai_cyber_job_rows(t: Tables, skip_triage: bool = False) -> DataFrame:
    """Latest valid analysis of active rows of the topic.  Triage rows count as analyses unless skipped."""
    last = latest_analyses(t["job_ai_analyses"], True, skip_triage).select(F.col("source_job_row_id").alias("id"), "model", F.col("analysis_json").alias("p"))
    rows = t["source_jobs"].where("ai_status = 'CYBER' and is_active").join(last, "id")
    p = F.col("p")
    listed = lambda k: F.coalesce(F.array_join(json_get(p, k, "array<string>"), ", "), F.lit("")).alias(k)
    text = F.coalesce(effective("detail_description", "raw_description"), F.lit(""))
    return rows.orderBy(F.desc("first_seen_at"), F.desc("id")).select(
        F.coalesce(F.nullif(F.col("resolved_company_name"), F.lit("")), F.nullif(F.col("raw_company"), F.lit("")), F.lit("Unresolved")).alias("company"), effective("detail_title", "raw_title").alias("title"), json_get(p, "role_family").alias("role_family"),
        listed("specializations"), json_get(p, "seniority").alias("seniority"), json_get(p, "years_experience_min", "double").alias("years_min"), json_get(p, "years_experience_max", "double").alias("years_max"),
        effective("detail_location", "raw_location").alias("location"), listed("skills_required"), listed("skills_preferred"), json_get(p, "degree_requirement").alias("degree_requirement"), listed("certifications"), "first_seen_at", "last_seen_at",
        "posted_at", "apply_url", effective("detail_url", "source_url").alias("source_url"), F.length(text).alias("description_chars"), (F.coalesce("detail_description", F.lit("")) != "").alias("detail_enriched"), "adapter", "model",
    )


def show_ai_results(t: Tables, status: str | None = None, limit: int = 20) -> DataFrame:
    last = latest_analyses(t["job_ai_analyses"], valid_only=False)
    last = last.where(F.col("ai_status") == status) if status else last
    return last.orderBy(F.desc("id")).limit(limit).orderBy("id")


def show_portal_jobs(t: Tables, portal_id: int, limit: int = 50) -> DataFrame:
    return t["source_jobs"].where(F.col("portal_id") == portal_id).orderBy("id").limit(limit)


def portal_job_statuses(t: Tables, portal_id: int) -> DataFrame:
    return t["source_jobs"].where(F.col("portal_id") == portal_id).groupBy("ai_status").agg(F.count("*").alias("jobs")).orderBy("ai_status")


def adapter_coverage(t: Tables) -> DataFrame:
    return adapter_coverage_rows(t).select("adapter", "portals")


def database_metrics(t: Tables) -> DataFrame:
    out = None
    for name in ("company_records", "corporate_clusters", "cluster_portal_mappings", "portals", "external_source_candidates"):
        one = t[name].agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


QUERIES = {
    f.__name__: f
    for f in (
        coverage_summary, job_summary, job_breakdown_rows, job_rows, review_queue_rows, source_job_rows, scan_run_rows, portal_rows, adapter_coverage_rows, high_value_unresolved_rows,
        discovery_coverage_rows, sector_coverage_rows, latest_filter_counts, summaries, ai_v2_summary, ai_cyber_job_rows, show_ai_results, adapter_coverage, database_metrics,
    )
}
