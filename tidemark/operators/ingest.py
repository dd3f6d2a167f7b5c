"""The deterministic ingest of one run: resolve, filter, hash, deduplicate, store, observe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_id, payload_hash, source_key, unresolved_namespace
from ..functions.text import text_or
from ..storage import cut
from .classify import vacancy_filter
from .dedup import assign, drop_repeated_keys, keyed
from .lifecycle import observe, upsert
from .resolve import resolve_global, resolve_in_portal

#: What a run brings for each record; a null portal is an outside source.
JOBS = (
    "ordinal long, portal_id long, source string, source_job_id string, apply_url string, title string, raw_company string, location string, country string, description string, employment_type string, workplace_type string, "
    "ats_job_id string, requisition_id string, at timestamp"
)
SOURCES = (
    "source string, source_job_id string, portal_id long, canonical_job_id string, corporate_cluster_id string, title string, location string, apply_url string, ats_job_id string, requisition_id string, payload_sha256 string, "
    "filter_status string, is_active boolean, missing int, first_seen_at timestamp, last_seen_at timestamp, stored_order long"
)
CANONICAL = "canonical_job_id string, corporate_cluster_id string, title string, location string, filter_status string, active boolean, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp"
#: Columns that make a payload another one.
PAYLOAD = ("apply_url", "country", "description", "employment_type", "location", "raw_company", "requisition_id", "title", "workplace_type")


@dataclass(frozen=True)
class Ingested:
    """The next source and canonical tables, and one observation of each record of the run."""

    sources: DataFrame
    canonical: DataFrame
    observations: DataFrame


def resolved(jobs: DataFrame, clusters: DataFrame, mappings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records of a portal by what is mapped to it, others among all clusters."""
    inside = resolve_in_portal(jobs.where("portal_id is not null"), mappings, clusters, aliases)
    outside = resolve_global(jobs.where("portal_id is null"), clusters, aliases)
    return inside.unionByName(outside.select(inside.columns))


def ingest_run(jobs: DataFrame, sources: DataFrame, canonical: DataFrame, clusters: DataFrame, mappings: DataFrame, aliases: DataFrame, rules: tuple[dict, dict, dict], run_id: int, done: int = -1) -> Ingested:
    """Fold one run (rows of JOBS) into ``sources`` (SOURCES) and ``canonical`` (CANONICAL).

    ``rules`` configures the topic, seniority and geography gates.  The first row of a source key counts.  Excluded rows
    are stored without a canonical record; the others take that of a matching stored or earlier row, or a new one whose id
    is a hash of the first identity.  Runs come in order, each once: a run up to ``done`` is an error.
    """
    if run_id <= done:
        raise ValueError(f"run {run_id} was processed before")
    rows = resolved(drop_repeated_keys(jobs), clusters, mappings, aliases)
    rows = vacancy_filter(rows, *rules).withColumn("payload_sha256", payload_hash(*PAYLOAD))
    rows = cut(rows.withColumn("namespace", F.coalesce("corporate_cluster_id", unresolved_namespace(F.col("portal_id"), F.col("source"), F.col("raw_company")))))

    identity = ["source", "source_job_id", "apply_url", "title", "location", "ats_job_id", "requisition_id"]
    wanted = rows.where("filter_status <> 'EXCLUDE'")
    new = keyed(wanted.select("ordinal", *identity, F.col("namespace").alias("corporate_cluster_id"), canonical_id(source_key(F.col("source"), F.col("source_job_id"))).alias("new_id")))
    stored = keyed(sources.where("canonical_job_id is not null").select(F.col("stored_order").alias("ordinal"), *identity, "corporate_cluster_id", "canonical_job_id"))
    found = cut(assign(new, stored)).select("ordinal", "canonical_job_id", F.col("method").alias("dedup_method"))
    rows = rows.join(found, "ordinal", "left")

    keys = ["source", "source_job_id"]
    before = sources.select(*keys, F.col("first_seen_at").alias("before"), F.col("stored_order").alias("order_before"))
    last = sources.agg(F.coalesce(F.max("stored_order") + 1, F.lit(0))).first()[0]
    kept = rows.join(before, keys, "left").select(
        *keys, "portal_id", "canonical_job_id", F.col("namespace").alias("corporate_cluster_id"), "title", "location", "apply_url", "ats_job_id", "requisition_id", "payload_sha256", "filter_status", F.lit(True).alias("is_active"), F.lit(0).alias("missing"),
        F.coalesce("before", "at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.coalesce("order_before", F.col("ordinal") + last).alias("stored_order"),
    )
    records = rows.where("canonical_job_id is not null").groupBy("canonical_job_id").agg(
        *[F.min_by(c, "ordinal").alias(n) for n, c in (("corporate_cluster_id", "namespace"), ("title", "title"), ("location", "location"), ("filter_status", "filter_status"), ("first_seen_at", "at"))], F.max("at").alias("last_seen_at")
    )
    records = records.withColumns({"active": F.lit(True), "closed_at": F.lit(None).cast("timestamp")}).select(canonical.columns)

    told = observe(sources, rows, keys)
    gates = F.to_json(F.struct("cyber", "seniority", "geography"))
    resolution = F.to_json(F.struct("corporate_cluster_id", "method", "candidate_ids"))
    observations = told.select(*keys, F.lit(run_id).alias("scan_run_id"), "filter_status", "payload_changed", text_or("dedup_method", "").alias("dedup_method"), gates.alias("filter_decision_json"), resolution.alias("cluster_resolution_json"))
    return Ingested(upsert(sources, kept.select(sources.columns), keys, ("first_seen_at", "stored_order")), upsert(canonical, records, ["canonical_job_id"], ("first_seen_at",)), observations)
