"""Row predicates, decision tables, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import text_or
from ..functions.values import json_list

#: The warning that makes an empty complete snapshot expected (fixed value).
EXPECTED_EMPTY = "upstream reports zero active jobs"
#: Families by support (fixed values).
LEGACY_FAMILIES = ("ashby", "avature", "google", "greenhouse", "lever", "oracle", "phenom", "radancy", "smartrecruiters", "successfactors", "workday")
DECLARATIVE_FAMILIES = ("eightfold", "beesite")


def portal_targets(portals: DataFrame, ids: list[int] | None = None, include_disabled: bool = False, limit: int | None = None) -> DataFrame:
    """Active portals (enabled ones, unless ids name them and ``include_disabled``), by host and URL."""
    if include_disabled and not ids:
        raise ValueError("include_disabled needs ids")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    out = portals.where("active_in_registry")
    out = out if include_disabled else out.where("scan_enabled")
    out = out.where(F.col("id").isin(ids)) if ids else out
    out = out.orderBy("host", "jobs_search_url")
    return out.limit(limit) if limit else out


def effective(detail: str, raw: str) -> Column:
    """The detail value, or the raw one where it is null or empty."""
    return F.coalesce(F.nullif(F.col(detail), F.lit("")), F.col(raw))


def portal_issue(status: Column, error: Column, message: Column, http: Column, access: Column, warnings: Column) -> Column:
    """Issue class of a portal by its latest attempt (a null status: none)."""
    error, message, access = F.coalesce(error, F.lit("")), F.lower(F.coalesce(message, F.lit(""))), F.coalesce(access, F.lit(""))
    stale = F.coalesce(http == 404, F.lit(False)) | message.contains("not found") | message.contains("name or service")
    return (
        F.when(status.isNull(), "NEVER_SCANNED")
        .when((error == "RobotsDisallowed") | (access == "ROBOTS_DENIED"), "ROBOTS_DENIAL")
        .when(error.isin("AccessChallengeError", "HostCircuitOpenError") | access.isin("ACCESS_DENIED", "CHALLENGE"), "ACCESS_DENIAL")
        .when((status == "SUCCESS") & (F.size(warnings) == 0), "HEALTHY")
        .when(status == "SUCCESS", "WARNING")
        .when(error == "AdapterSchemaError", "SCHEMA_DRIFT")
        .when(stale, "STALE_ROUTE")
        .otherwise("TRANSIENT_FAILURE")
    )


def unexpected_empty(status: Column, complete: Column, jobs: Column, warnings: Column) -> Column:
    return F.coalesce((status == "SUCCESS") & complete & (jobs == 0) & ~F.array_contains(warnings, EXPECTED_EMPTY), F.lit(False))


#: Pieces of a host and the family that they tell, in the order in which they are tried (fixed values).
HOST_FAMILIES = (
    ("greenhouse.io", "Greenhouse"), ("lever.co", "Lever"), ("ashbyhq.com", "Ashby"), ("smartrecruiters.com", "SmartRecruiters"), ("talentbrew.com", "Radancy"),
    ("radancy", "Radancy"), ("successfactors", "SuccessFactors RMK"), ("myworkdayjobs.com", "Workday"), ("phenom", "Phenom"), ("taleo", "Taleo"),
    ("oraclecloud.com", "Oracle Recruiting Cloud"), ("avature", "Avature"),
)
#: Evidence that may be acted on without a person (fixed values).
VERIFIED_EVIDENCE = (
    "FIRST_PARTY_VERIFIED", "TECHNICALLY_VERIFIED", "FIRST_PARTY_AND_PLATFORM_VERIFIED", "OPERATIONAL_PLATFORM_VERIFIED",
    "GREENHOUSE_OPERATIONAL_PLATFORM_VERIFIED", "FIRST_PARTY_VERIFIED_PLATFORM", "TECHNICALLY_VERIFIED_PLATFORM",
)


def decided(tests: list[tuple[Column, str]], default: str) -> Column:
    """A decision table: the name of the first test that holds."""
    out = None
    for test, name in tests:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def family_of_host(host: Column) -> Column:
    return decided([(F.lower(host).contains(piece), family) for piece, family in HOST_FAMILIES], "")


def support_class(family: Column) -> Column:
    f = F.lower(F.coalesce(family, F.lit("")))
    old, new = f.isin(*LEGACY_FAMILIES), f.isin(*DECLARATIVE_FAMILIES)
    return F.when(old & new, "BOTH").when(old, "LEGACY_SUPPORTED").when(new, "DECLARATIVE_SUPPORTED").otherwise("UNSUPPORTED")


def support_class_known(family: Column) -> Column:
    """Like support_class, with UNKNOWN for a blank family."""
    return F.when(F.trim(F.coalesce(family, F.lit(""))) == "", "UNKNOWN").otherwise(support_class(family))


def evidence_confidence(evidence: Column) -> Column:
    return decided([(evidence.isin(*VERIFIED_EVIDENCE), "VERIFIED"), (evidence == "PROBABLE", "PROBABLE")], "UNVERIFIED")


def access_state(reason: Column) -> Column:
    r = F.lower(F.coalesce(reason, F.lit("")))
    return F.when(r.contains("robots"), "ROBOTS_DENIED").when(r.contains("captcha") | r.contains("challenge"), "CHALLENGE").otherwise("ACCESS_DENIED")


def routing(url: Column, evidence: Column, family: Column, adapter_supported: Column, families: tuple[str, ...]) -> Column:
    """Queue of an operational source; ``families`` are those that have an adapter."""
    known = evidence.isin(*VERIFIED_EVIDENCE)
    ready = family.isin(*families) & (F.upper(F.coalesce(adapter_supported, F.lit(""))) == "YES")
    tests = [
        (F.trim(F.coalesce(url, F.lit(""))) == "", "HOLD"),
        (known & ready, "READY_TO_PROBE"),
        (known, "ADAPTER_NEEDED"),
        (evidence == "PROBABLE", "FINGERPRINT_REQUIRED"),
        (evidence == "UNVERIFIED", "RESOLVER_LIGHT"),
    ]
    return decided(tests, "HOLD")


def safety_verdict(unsupported: Column, permissive: Column) -> Column:
    return F.when(unsupported, "UNSUPPORTED").when(permissive, "PERMISSIVE").otherwise("SAFE")


def capped_by_host(df: DataFrame, host: str, order: list, per_host: int, total: int) -> DataFrame:
    """At most ``per_host`` rows of each host by ``order``, then at most ``total`` of all."""
    ranked = df.withColumn("_place", F.row_number().over(W.partitionBy(host).orderBy(*order))).where(F.col("_place") <= per_host)
    return ranked.orderBy(*order).limit(total).drop("_place")


def detail_candidates(jobs: DataFrame, adapters: list[str], statuses: list[str], hosts: list[str], short: int = 500, per_host: int = 2, total: int = 5) -> DataFrame:
    """Active jobs with a short description whose detail page may be asked for, by status priority and id, capped."""
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("ai_status"))
    fit = jobs.where(F.col("is_active") & F.col("adapter").isin(adapters) & F.col("ai_status").isin(statuses) & (F.length(F.trim(text_or("raw_description", ""))) < short))
    host = F.lower(F.try_parse_url(F.col("source_url"), F.lit("HOST")))
    fit = fit.withColumns({"detail_host": host, "priority": rank}).where(F.col("detail_host").isin(hosts))
    return capped_by_host(fit, "detail_host", [F.col("priority"), F.col("id")], per_host, total)


def positive_triage(jobs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Jobs with a valid positive triage of their present contents (``input_hash``)."""
    good = analyses.where("valid and prompt_version like 'triage:%' and candidate").select(F.col("source_job_row_id").alias("id"), "input_hash")
    return jobs.join(good, ["id", "input_hash"], "left_semi")


def semantic_cleanup(jobs: DataFrame, least: int = 1000, limit: int | None = None) -> DataFrame:
    """Active jobs that want more detail although their description is long."""
    text = F.length(F.trim(F.coalesce(effective("detail_description", "raw_description"), F.lit(""))))
    out = jobs.where((F.col("ai_status") == "NEEDS_MORE_DETAIL") & F.col("is_active") & (text >= least)).orderBy("id")
    return out.limit(limit) if limit else out


def interactive(df: DataFrame, isin: dict[str, list] | None = None, any_item: dict[str, list[str]] | None = None, search: tuple[list[str], str] | None = None, since: tuple[str, int, Column] | None = None) -> DataFrame:
    """The dashboard's filters: values of a column, items of a comma-joined column, a literal case-insensitive
    substring over columns, and the last N days before a reference time."""
    for name, values in (isin or {}).items():
        df = df.where(F.col(name).isin(values)) if values else df
    for name, values in (any_item or {}).items():
        df = df.where(F.arrays_overlap(F.split(F.col(name), r",\s*"), F.array(*map(F.lit, values)))) if values else df
    if search and search[1].strip():
        df = df.where(F.lower(F.concat_ws(" ", *search[0])).contains(search[1].strip().lower()))
    if since:
        name, days, now = since
        df = df.where(F.col(name) >= now - F.make_dt_interval(F.lit(days)))
    return df


def scan_gate(attempts: DataFrame, requests: DataFrame, max_failure: float = 0.1, max_retry: float = 0.2, max_429: int = 0, max_empty: int = 0) -> DataFrame:
    """One row: rates, counts, the reasons against the run, and passed.

    ``attempts`` has status, snapshot_complete, jobs_observed and warnings; ``requests`` has retry_index and
    status_code.  Without portals the failure rate is 1, without requests the retry rate 0; bounds are strict.
    """
    empty = unexpected_empty(F.col("status"), F.col("snapshot_complete"), F.col("jobs_observed"), F.col("warnings"))
    a = attempts.agg(
        F.when(F.count("*") > 0, F.count_if(F.col("status") != "SUCCESS") / F.count("*")).otherwise(1.0).alias("failure_rate"),
        F.count_if(empty).alias("unexpected_empty"),
    )
    r = requests.agg(F.when(F.count("*") > 0, F.count_if(F.col("retry_index") > 0) / F.count("*")).otherwise(0.0).alias("retry_rate"), F.count_if(F.col("status_code") == 429).alias("http_429"))
    both = a.crossJoin(r)  # two rows of one
    tests = (("failure rate", F.col("failure_rate") > max_failure), ("retry rate", F.col("retry_rate") > max_retry), ("HTTP 429", F.col("http_429") > max_429), ("unexpected empty snapshots", F.col("unexpected_empty") > max_empty))
    reasons = F.filter(F.array(*[F.when(test, F.lit(why)) for why, test in tests]), lambda x: x.isNotNull())
    return both.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def batch_mismatch(asked: DataFrame, answered: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, problem) of ids that an answer lacks, adds or repeats; empty for a valid answer."""
    named = lambda df, why: df.select(key).withColumn("problem", F.lit(why))
    twice = answered.groupBy(key).count().where("count > 1")
    return named(asked.join(answered, key, "left_anti").distinct(), "missing").unionByName(named(answered.join(asked, key, "left_anti").distinct(), "extra")).unionByName(named(twice, "repeated"))


def analysis_problems(is_topic: Column, needs_detail: Column, years_min: Column, years_max: Column) -> Column:
    """Reasons against one analysis: contradictory verdicts and impossible years."""
    bad = lambda y: F.coalesce((y < 0) | (y > 60), F.lit(False))
    tests = (
        ("verdict and need of detail contradict", is_topic.isNull() != F.coalesce(needs_detail, F.lit(False))),
        ("years out of bounds", bad(years_min) | bad(years_max)),
        ("least years above most", F.coalesce(years_min > years_max, F.lit(False))),
    )
    return F.filter(F.array(*[F.when(test, F.lit(why)) for why, test in tests]), lambda x: x.isNotNull())


def run_metrics(requests: DataFrame, group: str = "run_id") -> DataFrame:
    """Per run: requests, HTTP classes, 429s, and retries as the sum of each URL's highest retry index."""
    per = requests.groupBy(group, "url").agg(F.max("retry_index").alias("retries"), F.count("*").alias("n"), *[F.count_if(F.floor(F.col("status_code") / 100) == k).alias(f"c{k}") for k in (2, 3, 4, 5)], F.count_if(F.col("status_code") == 429).alias("c429"))
    return per.groupBy(group).agg(F.sum("n").alias("requests"), F.sum("retries").alias("retries"), *[F.sum(f"c{k}").alias(f"http_{k}xx") for k in (2, 3, 4, 5)], F.sum("c429").alias("http_429"))


def warnings_of(column: str = "warnings_json") -> Column:
    return json_list(F.col(column))
