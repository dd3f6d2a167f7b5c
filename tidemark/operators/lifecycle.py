"""State operators: the lifecycle fold, change detection, upserts, queues and registry changes.

State tables are immutable snapshots; every operator returns the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import text_or


@dataclass(frozen=True)
class Step:
    """What one run makes of the state: next sources and portals, and counts as one-row DataFrames."""

    sources: DataFrame
    portals: DataFrame
    counts: DataFrame


def close_missing(sources: DataFrame, portals: DataFrame, results: DataFrame, observed: DataFrame, misses: int = 2) -> Step:
    """Missing counters and closures after one run.

    ``sources`` has id, portal_id, is_active, missing and closed_at; ``portals`` id, empty_scans and health;
    ``results`` one row per portal of the run (portal_id, status, complete, jobs, finished_at); ``observed``
    the source ids seen.  Only successful complete results count.  An empty one of a portal that has active
    sources raises the portal's empty counter and, below ``misses``, does nothing else; any other resets it.
    """
    if misses < 2:
        raise ValueError("misses must be at least 2")
    good = results.where("status = 'SUCCESS' and complete and portal_id is not null").select("portal_id", "jobs", "finished_at")
    active = sources.where("is_active").groupBy("portal_id").agg(F.count("*").alias("active"))
    state = portals.join(good.withColumnRenamed("portal_id", "id"), "id", "left").join(active.withColumnRenamed("portal_id", "id"), "id", "left")
    empty = F.coalesce((F.col("jobs") == 0) & (F.col("active") > 0), F.lit(False))
    scans = F.when(F.col("jobs").isNull(), F.col("empty_scans")).when(empty, F.col("empty_scans") + 1).otherwise(0)
    state = state.withColumns({"anomaly": empty, "empty_scans": scans, "health": F.when(empty, "DEGRADED").otherwise(F.col("health"))})
    counted = state.where(F.col("jobs").isNotNull() & (~F.col("anomaly") | (F.col("empty_scans") >= misses))).select(F.col("id").alias("portal_id"), "finished_at")
    seen = observed.select("id").distinct().withColumn("seen", F.lit(True))
    rows = sources.join(counted, "portal_id", "left").join(seen, "id", "left")
    missed = F.col("is_active") & F.col("finished_at").isNotNull() & F.col("seen").isNull()
    more = F.col("missing") + F.when(missed, 1).otherwise(0)
    closes = missed & (more >= misses)
    rows = rows.withColumns({"closes": closes, "missing": more, "closed_at": F.when(closes, F.col("finished_at")).otherwise(F.col("closed_at"))}).withColumn("is_active", F.col("is_active") & ~F.col("closes"))
    counts = rows.agg(F.count_if("closes").alias("closed_sources")).crossJoin(state.agg(F.count_if("anomaly").alias("empty_anomalies")))  # single rows
    return Step(rows.select(sources.columns), state.select(portals.columns), counts)


def close_canonical(canonical: DataFrame, sources: DataFrame, affected: DataFrame, now: Column) -> DataFrame:
    """Canonical rows among ``affected`` ids without an active source close."""
    alive = sources.where("is_active and canonical_job_id is not null").select("canonical_job_id").distinct().withColumn("alive", F.lit(True))
    touched = affected.select("canonical_job_id").distinct().withColumn("touched", F.lit(True))
    rows = canonical.join(alive, "canonical_job_id", "left").join(touched, "canonical_job_id", "left")
    closes = F.col("active") & F.col("touched").isNotNull() & F.col("alive").isNull()
    return rows.withColumn("closes", closes).withColumns({"active": F.col("active") & ~F.col("closes"), "closed_at": F.when(F.col("closes"), now).otherwise(F.col("closed_at"))}).select(canonical.columns)


def upsert(state: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows replace state rows of the same keys, but for the columns of ``keep``, which stay as first stored."""
    rest = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.struct(*rest).alias("old"))
    new = rows.select(*keys, F.struct(*rest).alias("new"))
    merged = old.join(new, keys, "full")
    take = lambda c: (F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")))
    return merged.select(*keys, *[take(c).alias(c) for c in rest]).select(state.columns)


def observe(sources: DataFrame, rows: DataFrame, keys: list[str], value: str = "payload_sha256") -> DataFrame:
    """Observation rows with payload_changed: true for a new key or another hash."""
    old = sources.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_known"))
    return rows.join(old, keys, "left").withColumn("payload_changed", F.col("_known").isNull() | ~F.col("_old").eqNullSafe(F.col(value))).drop("_old", "_known")


def reopen(rows: DataFrame, seen: Column) -> DataFrame:
    """Observed rows are active again with no misses."""
    return rows.withColumns({"missing": F.when(seen, 0).otherwise(F.col("missing")), "is_active": seen | F.col("is_active"), "closed_at": F.when(~seen, F.col("closed_at"))})


def ingest(state: DataFrame, jobs: DataFrame, ai: bool = True) -> DataFrame:
    """Next source table of one run: ``jobs`` (source, source_job_id, portal_id, payload_sha256, at) over ``state``.

    Repeated keys of the run count once, the first by ordinal.  With ``ai``, new or changed rows become
    PENDING_AI and others keep what they have.
    """
    keys = ["source", "source_job_id"]
    first = jobs.groupBy(*keys).agg(F.min_by(F.struct("portal_id", "payload_sha256", "at"), "ordinal").alias("j"))
    merged = state.join(first, keys, "full")
    seen, known = F.col("j").isNotNull(), F.col("first_seen_at").isNotNull()
    changed = seen & (~known | ~F.col("payload_sha256").eqNullSafe(F.col("j.payload_sha256")))
    pick = lambda c: F.when(seen, F.col(f"j.{c}")).otherwise(F.col(c))
    return merged.select(
        *keys,
        pick("portal_id").alias("portal_id"),
        pick("payload_sha256").alias("payload_sha256"),
        F.coalesce("first_seen_at", "j.at").alias("first_seen_at"),
        F.when(seen, F.col("j.at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        (seen | F.coalesce("is_active", F.lit(False))).alias("is_active"),
        F.when(seen, 0).otherwise(F.col("missing")).alias("missing"),
        F.when(~seen, F.col("closed_at")).alias("closed_at"),
        F.when(changed & F.lit(ai), "PENDING_AI").otherwise(F.col("ai_status")).alias("ai_status"),
    )


STATE = "source string, source_job_id string, portal_id long, payload_sha256 string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean, missing int, closed_at timestamp, ai_status string"
PORTALS = "id long, empty_scans int, health string"


def process_run(state: DataFrame, portals: DataFrame, results: DataFrame, jobs: DataFrame, misses: int = 2) -> Step:
    """One run over the state: observed rows of successful portals are stored or reopened, then missing rows age.

    A row belongs to the portal that saw it last.  Runs are processed in order, each at most once.
    """
    good = results.where("status = 'SUCCESS'").select("portal_id")
    taken = jobs.join(good, "portal_id", "left_semi")
    new = ingest(state, taken).withColumn("id", F.concat_ws("\u0000", "source", "source_job_id"))
    observed = taken.select(F.concat_ws("\u0000", "source", "source_job_id").alias("id"))
    step = close_missing(new, portals, results, observed, misses)
    return Step(step.sources.drop("id"), step.portals, step.counts)


def fold_full_runs(jobs: DataFrame, misses: int = 2) -> DataFrame:
    """The state after a series of runs, from nothing: what ``process_run`` makes of them one by one, in a single plan.

    ``jobs`` has run, which orders the runs, and the columns of ``ingest``.  In each run every portal that has jobs
    answers completely and all others not at all, so a row ages with each later run of the portal that saw it last, until
    it closes with the run that makes its misses ``misses``.  Runs and portals are not null.
    """
    if misses < 2:
        raise ValueError("misses must be at least 2")
    keys = ["source", "source_job_id"]
    jobs = jobs.where("run is not null and portal_id is not null")
    runs = jobs.groupBy("portal_id", "run").agg(F.max("at").alias("finished_at"))
    order = W.partitionBy("portal_id").orderBy("run")
    later = F.count("*").over(W.partitionBy("portal_id")) - F.row_number().over(order)
    runs = runs.select("portal_id", "run", F.least(later, F.lit(misses)).cast("int").alias("missing"), F.lead("finished_at", misses).over(order).alias("closed_at"))
    first = jobs.groupBy("run", *keys).agg(F.min_by(F.struct("portal_id", "payload_sha256", "at"), "ordinal").alias("j"))
    rows = first.groupBy(*keys).agg(F.min_by("j.at", "run").alias("first_seen_at"), F.max_by("j", "run").alias("j"), F.max("run").alias("run"))
    rows = rows.select(*keys, "j.portal_id", "j.payload_sha256", "first_seen_at", F.col("j.at").alias("last_seen_at"), "run").join(runs, ["portal_id", "run"])
    return rows.select(*keys, "portal_id", "payload_sha256", "first_seen_at", "last_seen_at", (F.col("missing") < misses).alias("is_active"), "missing", "closed_at", F.lit("PENDING_AI").alias("ai_status"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, hashes: list[str], semantic: str, complete: bool, bootstrap: bool = False) -> DataFrame:
    """(key, change, needs_analysis): NEW, CHANGED, UNCHANGED, CLOSED or UNSEEN.

    A row changes with any of ``hashes``; only the ``semantic`` one asks for analysis, as new rows do, but for
    the first load.  Unseen open rows close only if the snapshot is complete.
    """
    a = old.select(key, F.struct(*hashes).alias("o"), "is_open")
    merged = a.join(new.select(key, F.struct(*hashes).alias("n")), key, "full")
    gone = F.col("n").isNull()
    change = F.when(gone & F.col("is_open"), "CLOSED" if complete else "UNSEEN").when(gone, "UNSEEN").when(F.col("o").isNull(), "NEW").when(F.col("o") == F.col("n"), "UNCHANGED").otherwise("CHANGED")
    needs = ~gone & (F.col("o").isNull() | (F.col(f"o.{semantic}") != F.col(f"n.{semantic}"))) & F.lit(not bootstrap)
    return merged.select(key, change.alias("change"), F.coalesce(needs, F.lit(False)).alias("needs_analysis"))


def fold_health(portals: DataFrame, attempts: DataFrame) -> DataFrame:
    """Health after one attempt of each portal: success heals, failure counts and breaks at three, UNSUPPORTED does neither."""
    rows = portals.join(attempts.select(F.col("portal_id").alias("id"), "status", "finished_at"), "id", "left")
    ok, bad = F.coalesce(F.col("status") == "SUCCESS", F.lit(False)), F.coalesce(F.col("status") == "FAILED", F.lit(False))
    n = F.when(ok, 0).when(bad, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    return rows.withColumns(
        {
            "health_state": F.when(ok, "HEALTHY").when(bad & (F.col("consecutive_failures") + 1 >= 3), "BROKEN").when(bad, "DEGRADED").otherwise(F.col("health_state")),
            "cooldown_until": F.when(~ok, F.col("cooldown_until")),
            "consecutive_failures": n,
            "last_successful_scan_at": F.when(ok, F.col("finished_at")).otherwise(F.col("last_successful_scan_at")),
        }
    ).select(portals.columns)


def spread_cooldown(portals: DataFrame, blocks: DataFrame, now: Column, hours: int) -> DataFrame:
    """All portals of a blocked host (host, reason) rest until ``now`` plus ``hours``."""
    one = blocks.groupBy("host").agg(F.min("reason").alias("reason"))
    rows = portals.join(one, "host", "left")
    hit = F.col("reason").isNotNull()
    return rows.withColumns({"cooldown_until": F.when(hit, now + F.make_dt_interval(F.lit(0), F.lit(hours))).otherwise(F.col("cooldown_until")), "last_block_reason": F.coalesce("reason", "last_block_reason")}).select(portals.columns)


def rested(portals: DataFrame, now: Column) -> DataFrame:
    """Portals whose cooldown is over."""
    return portals.where(F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now))


def with_failures(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Results of every target; one without a result failed by the run's timeout."""
    rest = targets.join(results, "portal_id", "left_anti").select("portal_id", F.lit("FAILED").alias("status"), F.lit("RunTimeout").alias("error_type"))
    return results.select("portal_id", "status", "error_type").unionByName(rest)


def queue_fold(jobs: DataFrame, answers: DataFrame, count_attempts: bool = True) -> DataFrame:
    """Queue rows after a batch: a valid answer (job_id, valid, status) moves the row on, an invalid one leaves it
    pending and, for analyses, counts an attempt."""
    rows = jobs.join(answers.select(F.col("job_id").alias("id"), "valid", F.col("status").alias("_status")), "id", "left")
    done = F.coalesce("valid", F.lit(False))
    failed = F.col("valid").isNotNull() & ~F.col("valid") & F.lit(count_attempts)
    return rows.withColumns({"ai_status": F.when(done, F.col("_status")).otherwise(F.col("ai_status")), "ai_attempts": F.col("ai_attempts") + F.when(failed, 1).otherwise(0)}).select(jobs.columns)


def verdict(is_topic: Column, needs_detail: Column) -> Column:
    return F.when(needs_detail, "NEEDS_MORE_DETAIL").when(is_topic, "CYBER").otherwise("NON_CYBER")


def store_details(jobs: DataFrame, details: DataFrame, fields: list[str]) -> DataFrame:
    """Details (id, detail_hash, fields) of another hash overwrite and requeue; equal ones change nothing."""
    rows = jobs.join(details.select("id", F.struct("detail_hash", *fields).alias("d")), "id", "left")
    moved = F.col("d").isNotNull() & ~F.col("d.detail_hash").eqNullSafe(F.col("detail_hash"))
    new = {c: F.when(moved, F.col(f"d.{c}")).otherwise(F.col(c)) for c in ("detail_hash", *fields)}
    return rows.withColumns(new | {"ai_status": F.when(moved, "PENDING_AI").otherwise(F.col("ai_status"))}).select(jobs.columns)


def requeue(jobs: DataFrame, selected: DataFrame) -> DataFrame:
    hit = selected.select("id").distinct().withColumn("_hit", F.lit(True))
    return jobs.join(hit, "id", "left").withColumn("ai_status", F.when(F.col("_hit"), "PENDING_AI").otherwise(F.col("ai_status"))).select(jobs.columns)


def backfill(jobs: DataFrame, defaults: dict[str, Column], hash_of: Column) -> DataFrame:
    """Fill blank columns, rebuild the hash, and requeue rows whose hash moved (column ``rebuilt`` says so)."""
    filled = jobs.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), v) for c, v in defaults.items()})
    moved = ~hash_of.eqNullSafe(F.col("payload_sha256"))
    return filled.withColumn("rebuilt", moved).withColumns({"payload_sha256": hash_of, "ai_status": F.when(F.col("rebuilt"), "PENDING_AI").otherwise(F.col("ai_status"))})


def check_equal(expected: DataFrame, actual: DataFrame) -> None:
    """Two independent one-row computations must agree; raises ValueError with the differences."""
    a, b = expected.first().asDict(), actual.first().asDict()
    if a != b:
        raise ValueError({k: (a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)})


def may_import(batches: DataFrame, sha256: str, kind: str) -> bool:
    """Whether a file is new; false for one imported before, an error for a second file of a kind that has one."""
    same = batches.where((F.col("kind") == kind)).select("source_sha256").limit(2).collect()
    if any(r[0] == sha256 for r in same):
        return False
    if same:
        raise ValueError(f"a different {kind} file was imported before")
    return True


ACTIONS = ("ADD", "UPDATE", "RETIRE", "SUSPEND", "RESUME")


def apply_changes(mappings: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry changes (cluster_id, action, old_url, new_url, reason) over mappings (cluster_id, url, enabled).

    Returns the next mappings, an audit (cluster_id, action, before, after) and the rejected changes with their
    problem.  A batch applies as a whole or, if any change is rejected, not at all: the next mappings are then
    the old ones and the audit is empty.
    """
    rows = changes.join(mappings, "cluster_id", "left")
    there = F.col("url").isNotNull()
    twice = changes.groupBy("cluster_id").count().where("count > 1").select("cluster_id", F.lit(True).alias("twice"))
    rows = rows.join(twice, "cluster_id", "left")
    problem = (
        F.when(F.col("twice"), "several changes of one cluster")
        .when(~F.col("action").isin(*ACTIONS), "unknown action")
        .when((F.col("action") == "ADD") & there, "exists already")
        .when((F.col("action") != "ADD") & ~there, "does not exist")
        .when((F.col("action") != "ADD") & (text_or("old_url", "") != F.col("url")), "old URL is not the stored one")
        .when(F.col("action").isin("ADD", "UPDATE") & (text_or("new_url", "") == ""), "needs a new URL")
        .when(~F.col("action").isin("ADD", "UPDATE") & (text_or("new_url", "") != ""), "forbids a new URL")
    )
    rows = rows.withColumn("problem", problem)
    rejected = rows.where("problem is not null").select("cluster_id", "action", "problem")
    stop = rejected.agg((F.count("*") > 0).alias("stop"))
    url = F.when(F.col("action").isin("ADD", "UPDATE"), F.col("new_url")).when(F.col("action") != "RETIRE", F.col("url"))
    enabled = F.when(F.col("action").isin("ADD", "RESUME"), True).when(F.col("action") == "SUSPEND", False).when(F.col("action") == "UPDATE", F.col("enabled"))
    good = rows.join(F.broadcast(stop), F.lit(True)).where("not stop").select(  # a single row
        "cluster_id", "action", F.to_json(F.struct("url", "enabled")).alias("before"), url.alias("u"), enabled.alias("e")
    )
    audit = good.select("cluster_id", "action", F.when(F.col("action") != "ADD", F.col("before")).alias("before"), F.to_json(F.struct(F.col("u").alias("url"), F.col("e").alias("enabled"))).alias("after"))
    kept = mappings.join(good.select("cluster_id"), "cluster_id", "left_anti")
    return kept.unionByName(good.where("u is not null").select("cluster_id", F.col("u").alias("url"), F.col("e").alias("enabled"))), audit, rejected


def merge_aliases(stored: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases (normalized_alias, corporate_cluster_id, status): new ones are created, PROPOSED is promoted to
    VERIFIED, demotion and a second VERIFIED owner of an alias are refused.  Returns the next table and refusals."""
    key = ["normalized_alias", "corporate_cluster_id"]
    owners = stored.where("status = 'VERIFIED'").unionByName(rows.where("status = 'VERIFIED'")).select(*key).distinct().groupBy("normalized_alias").agg(F.count("*").alias("owners"))
    both = rows.join(stored.select(*key, F.col("status").alias("was")), key, "left").join(owners, "normalized_alias", "left")
    problem = F.when((F.col("was") == "VERIFIED") & (F.col("status") != "VERIFIED"), "demotion").when((F.col("status") == "VERIFIED") & (F.col("owners") > 1), "verified for another cluster")
    both = both.withColumn("problem", problem)
    good = both.where("problem is null").select(*key, "status")
    return stored.join(good, key, "left_anti").select(*key, "status").unionByName(good), both.where("problem is not null").select(*key, "problem")


def sync_sources(stored: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """Additive sync: blanks never overwrite, nothing is disabled, rows that are not mentioned stay."""
    rest = [c for c in stored.columns if c != key]
    merged = stored.select(key, F.struct(*rest).alias("o")).join(rows.select(key, F.struct(*rest).alias("n")), key, "full")

    def value(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        kind = stored.schema[c].dataType.simpleString()
        if kind == "boolean":
            return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
        return F.coalesce(F.nullif(F.trim(new), F.lit("")), old) if kind == "string" else F.coalesce(new, old)

    return merged.select(key, *[value(c).alias(c) for c in rest]).select(stored.columns)


def change_counts(stored: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """Dry run: how many rows would create and how many reuse; repeated keys count each time."""
    known = stored.select(key).distinct().withColumn("known", F.lit(True))
    return rows.join(known, key, "left").agg(F.count_if(F.col("known").isNull()).alias("create"), F.count_if(F.col("known").isNotNull()).alias("reuse"))


def cleared(portals: DataFrame) -> DataFrame:
    """Portals as before any run."""
    reset = {"health_state": F.lit("UNKNOWN"), "consecutive_failures": F.lit(0), "consecutive_empty_scans": F.lit(0), "cooldown_until": F.lit(None).cast("timestamp"), "last_block_reason": F.lit(None).cast("string"), "last_successful_scan_at": F.lit(None).cast("timestamp"), "last_http_status": F.lit(None).cast("int")}
    return portals.withColumns({c: v.cast(portals.schema[c].dataType) for c, v in reset.items() if c in portals.columns})


def table_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, old, new, equal) for a restore's reconciliation."""
    count = lambda tables, name: _union([df.agg(F.lit(t).alias("table"), F.count("*").alias(name)) for t, df in sorted(tables.items())])
    return count(before, "old").join(count(after, "new"), "table", "full").withColumn("equal", F.col("old").eqNullSafe(F.col("new")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
