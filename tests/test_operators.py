import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import classify, dedup, lifecycle, predicates, resolve, windows
from tidemark.plans import dashboard

SENIORITY = {"include_terms": ["junior", "intern", "internship", "graduate"], "exclude_terms": ["senior", "lead"], "max_early_career_years": 3}
TOPIC = {
    "categories": {"general": ["security engineer", "infosec"], "soc": ["soc analyst", "security operations"]}, "always_excluded_title_functions": ["sales"], "negative_title_phrases": ["social security"], "negative_override_terms": ["infosec"],
    "generic_title_exclusions": ["software engineer"], "description_only_title_exclusions": ["recruiter"], "description_only_title_markers": ["intern", "graduate"], "contextual_terms": [{"term": "risk", "category": "grc", "context_markers": ["iso 27001"]}],
}
GEOGRAPHY = {
    "target_countries": ["Italy", "Spain"], "aliases": {"Italia": "Italy"}, "country_codes": {"ES": "Spain"}, "explicitly_excluded_regions": ["APAC"], "explicitly_excluded_countries": ["India"], "known_out_of_scope_countries": ["Brazil"],
    "out_of_scope_country_codes": {"US": "United States"}, "included_region_aliases": ["European Union"],
}


def judged(spark, expr, rows, names):
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return [r["c"] for r in df.withColumn("c", expr).select("c").collect()]


def test_topic_chain(spark):
    c = F.col
    rows = [
        ("Security Engineer, Sales", "", ""), ("Social Security clerk", "", ""), ("Social security infosec", "", ""), ("SOC Analyst / security engineer", "", ""), ("Software Engineer", "infosec", ""), ("Recruiter", "infosec", ""),
        ("Graduate program", "join security operations", ""), ("Program", "join infosec", "Intern"), ("Program", "join infosec", ""), ("Graduate", "risk and ISO-27001", ""), ("Graduate", "risk", ""), ("Cook", "", ""),
    ]
    got = judged(spark, classify.topic(TOPIC, c("t"), c("d"), c("e")), rows, ["t", "d", "e"])
    assert [r["status"] for r in got] == ["EXCLUDE", "EXCLUDE", "INCLUDE", "INCLUDE", "EXCLUDE", "EXCLUDE", "INCLUDE", "INCLUDE", "EXCLUDE", "INCLUDE", "EXCLUDE", "EXCLUDE"]
    assert got[3]["category"] == "general" and got[3]["matched_terms"] == ["security engineer"] and got[9]["category"] == "grc" and got[0]["matched_terms"] == ["sales"]


def test_seniority_chain(spark):
    c = F.col
    rows = [
        ("Senior dev", "", ""), ("Junior dev", "", ""), ("Junior dev", "at least 5 years of experience", ""), ("Dev", "", "Internship"), ("Analyst I", "", ""), ("Analyst II", "", ""), ("Engineer IV", "", ""), ("Dev level 3", "", ""),
        ("Dev", "1-3 years experience", ""), ("Dev", "4–6 yrs experience", ""), ("Dev", "2 to 5 years of relevant experience", ""), ("Dev", "up to 3 years experience", ""), ("Dev", "up to 9 years experience", ""),
        ("Dev", "minimum of 2 years experience", ""), ("Dev", "5+ years experience", ""), ("Dev", "3 years experience", ""), ("Dev", "4 years experience", ""), ("Dev", "no word", ""),
    ]
    got = judged(spark, classify.seniority(SENIORITY, c("t"), c("d"), c("e")), rows, ["t", "d", "e"])
    want = "EXCLUDE INCLUDE REVIEW INCLUDE INCLUDE REVIEW EXCLUDE EXCLUDE INCLUDE EXCLUDE REVIEW INCLUDE REVIEW REVIEW EXCLUDE INCLUDE EXCLUDE REVIEW".split()
    assert [r["status"] for r in got] == want
    assert got[3]["category"] == "internship" and got[1]["category"] == "junior" and got[2]["category"] is None and got[8]["matched_terms"] == ["1-3 years experience"]


def test_geography_chain(spark):
    c = F.col
    rows = [
        ("x", "Italia", ""), ("x", "es", ""), ("Rome, Italy", "India", ""), ("x", "US", ""), ("x", "Atlantis", ""), ("Delhi, India or Milan, Italia", "", ""), ("APAC", "", ""), ("European Union", "", ""), ("Remote", "", ""), ("x", "", "remote"), ("es", " ", ""), ("x", None, None),
    ]
    got = judged(spark, classify.geography(GEOGRAPHY, c("l"), c("k"), c("w")), rows, ["l", "k", "w"])
    assert [r["status"] for r in got] == ["INCLUDE", "INCLUDE", "EXCLUDE", "EXCLUDE", "REVIEW", "INCLUDE", "EXCLUDE", "INCLUDE", "REVIEW", "REVIEW", "REVIEW", "REVIEW"]
    assert got[0]["category"] == "Italy" and got[5]["matched_terms"] == ["Italy"] and got[7]["category"] == "European Union"


def test_vacancy_filter_takes_the_worst(spark):
    rows = [("Junior security engineer", "", "", "Rome, Italy", None, None), ("Junior security engineer", "", "", "Remote", None, None), ("Senior security engineer", "", "", "Rome, Italy", None, None)]
    df = spark.createDataFrame(rows, "title string, description string, employment_type string, location string, country string, workplace_type string")
    assert [r["filter_status"] for r in classify.vacancy_filter(df, TOPIC, SENIORITY, GEOGRAPHY).collect()] == ["INCLUDE", "REVIEW", "EXCLUDE"]


CANDIDATE = "ordinal long, canonical_job_id string, new_id string, source string, source_job_id string, apply_url string, corporate_cluster_id string, title string, location string, ats_job_id string, requisition_id string"


def plain_fold(stored, new):
    """The index in plain Python over keyed rows."""
    owners, out = {}, {}
    keys = [k for k, _ in dedup.PROBES]
    add = lambda r: owners.update({(k, r[k]): r for k in keys if r[k]})
    for r in sorted(stored, key=lambda r: r["ordinal"]):
        add(r)
    for r in sorted(new, key=lambda r: r["ordinal"]):
        hit = method = None
        for k, name in dedup.PROBES:
            old = owners.get((k, r[k])) if r[k] else None
            if old and (k == "k_print" or all(not old[f] or not r[f] or old[f] == r[f] for f in dedup.FIELDS)):
                hit, method = old["canonical_job_id"], name
                break
        r["canonical_job_id"] = hit or r["new_id"]
        out[r["ordinal"]] = (r["canonical_job_id"], method)
        add(r)
    return out


def test_greedy_assignment_equals_the_index(spark):
    import random

    rng = random.Random(11)
    pick = lambda *xs: rng.choice(xs)
    row = lambda i, stored: (i, f"C{i}" if stored else None, None if stored else f"N{i}", "src", f"j{rng.randrange(25)}", pick("", f"https://a.b/{rng.randrange(12)}"), f"c{rng.randrange(4)}", pick("dev", "ops", "dev ", "qa"), pick("rome", "", "oslo"), pick("", f"a{rng.randrange(8)}"), pick("", "r1"))
    stored = dedup.keyed(spark.createDataFrame([row(i, True) for i in range(40)], CANDIDATE))
    new = dedup.keyed(spark.createDataFrame([row(i, False) for i in range(90)], CANDIDATE))
    got = {r["ordinal"]: (r["canonical_job_id"], r["method"]) for r in dedup.assign(new, stored).collect()}
    assert got == plain_fold([r.asDict() for r in stored.collect()], [r.asDict() for r in new.collect()])


def test_collisions_keep_rows_apart(spark):
    schema = "ordinal long, source string, source_job_id string, title string, location string, apply_url string, requisition_id string"
    stored = spark.createDataFrame([(0, "s", "1", "Dev", "Rome", "https://a/1", "")], schema)
    jobs = spark.createDataFrame([(1, "s", "1", "dev", "Rome", "https://a/1", ""), (2, "s", "1", "Dev", "Oslo", "https://a/1", ""), (3, "s", " ", "x", "", "", ""), (4, "s", "2", "y", "", "", "")], schema)
    got = {r["ordinal"]: r for r in dedup.preserve_collisions(jobs, stored).collect()}
    assert [got[i]["is_variant"] for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert got[2]["source_job_id"].startswith("1::variant:") and got[3]["source_job_id"].startswith("anonymous::variant:") and got[2]["native_source_job_id"] == "1"


RESULT = "portal_id long, status string, complete boolean, jobs int, finished_at timestamp"
JOB = "portal_id long, source string, source_job_id string, payload_sha256 string, ordinal long, at timestamp"


def test_closure_needs_repetition(spark):
    import datetime as dt

    state, portals = spark.createDataFrame([], lifecycle.STATE), spark.createDataFrame([(1, 0, "UNKNOWN")], lifecycle.PORTALS)
    runs = [("SUCCESS", True, 1), ("FAILED", False, 0), ("SUCCESS", True, 0), ("SUCCESS", True, 0), ("SUCCESS", True, 0), ("SUCCESS", False, 0), ("SUCCESS", True, 1)]
    seen = []
    for i, (status, complete, n) in enumerate(runs):
        at = dt.datetime(2026, 1, 1 + i)
        step = lifecycle.process_run(state, portals, spark.createDataFrame([(1, status, complete, n, at)], RESULT), spark.createDataFrame([(1, "s", "a", "h", k, at) for k in range(n)], JOB))
        rows, ports = step.sources.collect(), step.portals.collect()
        state, portals = spark.createDataFrame(rows, lifecycle.STATE), spark.createDataFrame(ports, lifecycle.PORTALS)
        seen.append((rows[0]["missing"], rows[0]["is_active"], ports[0]["empty_scans"]))
    assert seen == [(0, True, 0), (0, True, 0), (0, True, 1), (1, True, 2), (2, False, 3), (2, False, 3), (0, True, 0)]
    with pytest.raises(ValueError):
        lifecycle.close_missing(state, portals, None, None, misses=1)


def test_all_days_fold_in_order(spark):
    import datetime as dt
    import hashlib
    import random
    import types

    from tidemark.plans import driver_queries

    rng = random.Random(7)
    events = [(i, rng.randrange(1, 5), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 60), rng.choice("abcdef"), f"p{rng.randrange(3)}") for i in range(240)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, props string")
    want, reopened = {}, 0
    for day in sorted({e[2].date() for e in events}):
        run = [e for e in events if e[2].date() == day]
        for key in sorted({(e[1], e[3]) for e in run}):
            one = next(e for e in run if (e[1], e[3]) == key)
            old, payload = want.get(key), hashlib.sha256(one[4].encode()).hexdigest()
            reopened += bool(old) and not old["is_active"]
            want[key] = {"payload_sha256": payload, "first_seen_at": old["first_seen_at"] if old else one[2], "last_seen_at": one[2], "is_active": True, "missing": 0, "closed_at": None, "ai_status": "PENDING_AI"}
        for portal in {e[1] for e in run}:
            for key, row in want.items():
                if key[0] == portal and row["is_active"] and key[1] not in {e[3] for e in run if e[1] == portal}:
                    row["missing"] += 1
                    if row["missing"] >= 2:
                        row |= {"is_active": False, "closed_at": max(e[2] for e in run if e[1] == portal)}
    got = {(r["portal_id"], r["source_job_id"]): r for r in driver_queries.t1_t2_run_fold(types.SimpleNamespace(spark=spark, events=frame)).collect()}
    assert {k: {c: r[c] for c in want[k]} for k, r in got.items()} == want
    assert reopened and any(not r["is_active"] for r in want.values()) and all(r["source"] == f"s{k[0]}" for k, r in got.items())


def test_unchanged_rows_keep_their_verdict(spark):
    import datetime as dt

    at = dt.datetime(2026, 1, 2)
    state = spark.createDataFrame([("s", "a", 1, "h", at, at, True, 0, None, "CYBER"), ("s", "b", 1, "h", at, at, True, 0, None, "CYBER")], lifecycle.STATE)
    jobs = spark.createDataFrame([(1, "s", "a", "h", 0, at), (1, "s", "b", "new", 1, at), (1, "s", "c", "x", 2, at), (1, "s", "c", "later", 3, at)], JOB)
    got = {r["source_job_id"]: (r["ai_status"], r["payload_sha256"]) for r in lifecycle.ingest(state, jobs).collect()}
    assert got == {"a": ("CYBER", "h"), "b": ("PENDING_AI", "new"), "c": ("PENDING_AI", "x")}


def test_canonical_closes_with_its_last_source(spark):
    canonical = spark.createDataFrame([("x", True, None), ("y", True, None), ("z", True, None)], "canonical_job_id string, active boolean, closed_at timestamp")
    sources = spark.createDataFrame([("x", False), ("x", True), ("y", False), ("z", False)], "canonical_job_id string, is_active boolean")
    affected = spark.createDataFrame([("x",), ("y",)], "canonical_job_id string")
    got = {r["canonical_job_id"]: r["active"] for r in lifecycle.close_canonical(canonical, sources, affected, F.current_timestamp()).collect()}
    assert got == {"x": True, "y": False, "z": True}


def test_registry_changes_apply_whole_or_not_at_all(spark):
    mappings = spark.createDataFrame([("a", "u1", True), ("b", "u2", True), ("c", "u3", False)], "cluster_id string, url string, enabled boolean")
    schema = "cluster_id string, action string, old_url string, new_url string, reason string"
    good = [("a", "UPDATE", "u1", "u9", "r"), ("b", "RETIRE", "u2", "", "r"), ("c", "RESUME", "u3", None, "r"), ("d", "ADD", "", "u4", "r")]
    after, audit, rejected = lifecycle.apply_changes(mappings, spark.createDataFrame(good, schema))
    assert {(r["cluster_id"], r["url"], r["enabled"]) for r in after.collect()} == {("a", "u9", True), ("c", "u3", True), ("d", "u4", True)}
    assert audit.count() == 4 and rejected.count() == 0
    after, audit, rejected = lifecycle.apply_changes(mappings, spark.createDataFrame([*good[:1], ("b", "RETIRE", "stale", "", "r")], schema))
    assert after.count() == 3 and audit.count() == 0 and rejected.first()["problem"] == "old URL is not the stored one"


def test_aliases_and_health(spark):
    schema = "normalized_alias string, corporate_cluster_id string, status string"
    stored = spark.createDataFrame([("a", "1", "VERIFIED"), ("b", "1", "PROPOSED")], schema)
    rows = spark.createDataFrame([("a", "1", "PROPOSED"), ("b", "1", "VERIFIED"), ("a", "2", "VERIFIED"), ("n", "2", "PROPOSED")], schema)
    after, refused = lifecycle.merge_aliases(stored, rows)
    assert {tuple(r) for r in after.collect()} == {("a", "1", "VERIFIED"), ("b", "1", "VERIFIED"), ("n", "2", "PROPOSED")}
    assert {r["problem"] for r in refused.collect()} == {"demotion", "verified for another cluster"}
    portals = spark.createDataFrame([(1, "HEALTHY", None, 2, None), (2, "DEGRADED", None, 1, None), (3, "HEALTHY", None, 1, None)], "id long, health_state string, cooldown_until timestamp, consecutive_failures int, last_successful_scan_at timestamp")
    attempts = spark.sql("select * from values (1L, 'FAILED', current_timestamp()), (2L, 'SUCCESS', current_timestamp()), (3L, 'UNSUPPORTED', current_timestamp()) as t(portal_id, status, finished_at)")
    got = {r["id"]: (r["health_state"], r["consecutive_failures"]) for r in lifecycle.fold_health(portals, attempts).collect()}
    assert got == {1: ("BROKEN", 3), 2: ("HEALTHY", 0), 3: ("HEALTHY", 1)}


def clusters(spark):
    return spark.createDataFrame([("1", "Acme Italy", ["Acme"], []), ("2", "Acme Spain", ["Acme"], ["Acme Group"]), ("3", "Beta", [], [])], "corporate_cluster_id string, representative string, canonical_employers array<string>, parent_groups array<string>")


def test_resolution(spark):
    aliases = spark.createDataFrame([("beta ltd", "Beta Ltd", "3", "VERIFIED"), ("acme", "Acme", "3", "VERIFIED"), ("gamma", "Gamma", "1", "PROPOSED")], "normalized_alias string, alias string, corporate_cluster_id string, status string")
    jobs = spark.createDataFrame([(n,) for n in ("ACME Italy", "acme", "Beta, Ltd.", "Gamma", "")], "raw_company string")
    got = {r["raw_company"]: (r["method"], r["corporate_cluster_id"]) for r in resolve.resolve_global(jobs, clusters(spark), aliases).collect()}
    assert got["ACME Italy"] == ("global_exact_company_name", "1") and got["acme"] == ("global_ambiguous_company_name", None)
    assert got["Beta, Ltd."] == ("global_verified_company_alias", "3") and got["Gamma"][0] == "global_company_name_not_found" and got[""][0] == "external_source_missing_company"
    mappings = spark.createDataFrame([("1", 7, ""), ("2", 7, "Holding"), ("3", 8, "")], "corporate_cluster_id string, portal_id long, parent_override string")
    jobs = spark.createDataFrame([(7, "Acme Italy"), (7, "holding"), (7, "acme"), (7, "zzz"), (7, ""), (8, "any"), (9, "x")], "portal_id long, raw_company string")
    out = resolve.resolve_in_portal(jobs, mappings, clusters(spark), aliases)
    got = {(r["portal_id"], r["raw_company"]): (r["method"], r["corporate_cluster_id"]) for r in out.collect()}
    assert got[7, "Acme Italy"] == ("exact_company_name", "1") and got[7, "holding"] == ("exact_company_name", "2") and got[7, "acme"][0] == "ambiguous_exact_company_name"
    assert got[7, "zzz"][0] == "shared_portal_no_exact_company_match" and got[7, ""][0] == "shared_portal_missing_company" and got[8, "any"] == ("single_portal_mapping", "3") and got[9, "x"][0] == "portal_has_no_cluster_mapping"
    names = {(r["portal_id"], r["raw_company"]): r["display_name"] for r in resolve.display_names(out, mappings, clusters(spark)).collect()}
    assert names[7, ""] == "Holding" and names[8, "any"] == "Beta" and names[7, "zzz"] == "zzz"


def test_proposals_and_suggestions(spark):
    none = spark.createDataFrame([], "normalized_alias string, alias string, corporate_cluster_id string, status string")
    got = resolve.propose_aliases(clusters(spark), none, ["acme itali", " "]).collect()
    assert got[0]["corporate_cluster_id"] == "1" and got[0]["score"] > 0.89 and got[0]["rank"] == 1
    found = resolve.suggestions(spark.createDataFrame([("The Beta company",)], "employer string"), clusters(spark)).collect()
    assert [r["suggestion"] for r in found] == ["beta"]


def test_gate_and_caps(spark):
    attempts = spark.createDataFrame([("SUCCESS", True, 0, [predicates.EXPECTED_EMPTY]), ("SUCCESS", True, 0, []), ("FAILED", False, 0, [])], "status string, snapshot_complete boolean, jobs_observed int, warnings array<string>")
    requests = spark.createDataFrame([(0, 200), (1, 429)], "retry_index int, status_code int")
    r = predicates.scan_gate(attempts, requests).first()
    assert r["reasons"] == ["failure rate", "retry rate", "HTTP 429", "unexpected empty snapshots"] and r["passed"] is False
    r = predicates.scan_gate(attempts.where("false"), requests.where("false")).first()
    assert r["failure_rate"] == 1.0 and r["retry_rate"] == 0.0
    with pytest.raises(ValueError):
        predicates.portal_targets(attempts, include_disabled=True)


def test_batches_and_parity(spark):
    df = spark.range(23).repartition(3)
    assert {r["id"]: r["batch"] for r in windows.batches(df, 5, F.col("id")).collect()} == {i: i // 5 for i in range(23)}
    assert windows.batches(df.where("false"), 5, F.col("id")).count() == 0
    r = windows.set_parity(spark.range(4), spark.range(2, 6), "id").first()
    assert (r["left_size"], r["right_size"], r["shared"], r["united"], r["percent"], r["only_left"], r["only_right"]) == (4, 4, 2, 6, 33.3, "0, 1", "4, 5")


def tables(spark):
    make = lambda name, *rows: spark.createDataFrame([tuple(r.get(f.name) for f in schemas.schema(name).fields) for r in rows], schemas.schema(name))
    t = {name: schemas.empty(spark, name) for name in schemas.TABLES}
    portal = lambda i, **k: {"id": i, "host": f"h{i}", "jobs_search_url": f"https://boards.greenhouse.io/{i}", "active_in_registry": True, "scan_enabled": True, "health_state": "HEALTHY", "access_state": "AVAILABLE", "ats_families": [], **k}
    t["portals"] = make("portals", portal(1), portal(2, health_state="BROKEN"), portal(3, access_state="ROBOTS_DENIED"), portal(4, active_in_registry=False), portal(5, health_state="UNKNOWN"))
    attempt = lambda i, p, run, **k: {"id": i, "portal_id": p, "scan_run_id": run, "status": "SUCCESS", "snapshot_complete": True, "jobs_observed": 3, "warnings": [], **k}
    t["portal_scan_attempts"] = make("portal_scan_attempts", attempt(1, 1, 1, status="FAILED"), attempt(2, 1, 2), attempt(3, 2, 2, status="FAILED", http_status=404, error_type="X"), attempt(4, 3, 2))
    t["scan_runs"] = make("scan_runs", {"id": 1, "new_jobs": 5}, {"id": 2, "new_jobs": 9})
    t["corporate_clusters"] = make("corporate_clusters", {"corporate_cluster_id": "c1", "representative": "Acme"}, {"corporate_cluster_id": "c2", "representative": "Cyber Co", "sectors": ["x"], "discovery_geographies": ["it"], "record_count": 20, "has_primary_scan_eligibility": True})
    t["cluster_portal_mappings"] = make("cluster_portal_mappings", {"corporate_cluster_id": "c1", "portal_id": 1})
    t["company_records"] = make("company_records", {"record_id": "r1", "corporate_cluster_id": "c1", "sector": "a"}, {"record_id": "r2", "corporate_cluster_id": "c2", "sector": "a"})
    job = lambda i, **k: {"canonical_job_id": i, "corporate_cluster_id": "c1", "title": i, "active": True, "filter_status": "INCLUDE", "country": "", **k}
    t["canonical_jobs"] = make("canonical_jobs", job("j1"), job("j2", filter_status="REVIEW", corporate_cluster_id=None), job("j3", active=False))
    source = lambda i, j, s, p=1, **k: {"id": i, "canonical_job_id": j, "source": s, "portal_id": p, "is_active": True, "ai_status": "CYBER", "raw_title": "raw", "raw_description": "abc", **k}
    t["source_jobs"] = make("source_jobs", source(1, "j1", "LinkedIn"), source(2, "j1", "greenhouse"), source(3, "j2", "lever", 2, detail_title="better", detail_description="long"))
    t["job_observations"] = make("job_observations", {"id": 1, "source_job_row_id": 3, "scan_run_id": 1, "filter_status": "REVIEW", "filter_decision_json": "bad", "cluster_resolution_json": None}, {"id": 2, "source_job_row_id": 3, "scan_run_id": 2, "filter_status": "REVIEW", "filter_decision_json": '{"seniority": {"status": "REVIEW", "reason": "unclear"}}', "cluster_resolution_json": '{"method": "none found"}'})
    t["job_ai_analyses"] = make("job_ai_analyses", {"id": 1, "source_job_row_id": 3, "valid": True, "prompt_version": "v1", "analysis_json": '{"role_family": "soc", "skills_required": ["a", "b"], "years_experience_min": 1}'}, {"id": 2, "source_job_row_id": 3, "valid": False, "prompt_version": "v1"})
    return t


def test_dashboard(spark):
    t = tables(spark)
    r = dashboard.coverage_summary(t).first()
    assert (r["unique_portals"], r["scanned_portals"], r["scannable_portals"], r["suspended_portals"], r["stale_portals"], r["unresolved_clusters"], r["broken_portals"]) == (4, 3, 3, 1, 1, 1, 1)
    r = dashboard.job_summary(t).first()
    assert (r["total_canonical_jobs"], r["active_jobs"], r["review_jobs"], r["closed_jobs"], r["official_only"], r["linkedin_only"], r["found_on_both"]) == (3, 2, 1, 1, 1, 0, 1)
    rows = {(r["dimension"], r["value"]): r["active_jobs"] for r in dashboard.job_breakdown_rows(t).collect()}
    assert rows["Country", "Unknown"] == 2 and rows["Company", "Unresolved"] == 1 and rows["Source", "LinkedIn"] == 1 and rows["Seniority", "Review"] == 2
    jobs = {r["canonical_job_id"]: r for r in dashboard.job_rows(t).collect()}
    assert jobs["j1"]["sources"] == "LinkedIn, greenhouse" and jobs["j1"]["lifecycle_confidence"] == "complete" and jobs["j2"]["lifecycle_confidence"] == "incomplete" and jobs["j3"]["sources"] == ""
    r = dashboard.review_queue_rows(t).first()
    assert r["ambiguity_signals"] == "seniority: unclear | company: none found" and r["company_resolution"] == "none found"
    issues = {r["portal_id"]: r["issue_category"] for r in dashboard.portal_rows(t).collect()}
    assert issues == {1: "HEALTHY", 2: "STALE_ROUTE", 3: "ROBOTS_DENIAL", 5: "NEVER_SCANNED"}
    r = dashboard.high_value_unresolved_rows(t).first()
    assert r["corporate_cluster_id"] == "c2" and r["priority_score"] == 20 + 5 + 4 + 2
    r = dashboard.ai_cyber_job_rows(t).first()
    assert (r["title"], r["role_family"], r["skills_required"], r["years_min"], r["description_chars"], r["detail_enriched"]) == ("better", "soc", "a, b", 1.0, 4, True)
    assert dashboard.job_activity_summary(t, F.current_timestamp()).first()["new_jobs_latest_run"] == 9
    assert [(r["filter_status"], r["scan_run_id"], r["observations"]) for r in dashboard.latest_filter_counts(t).collect()] == [("REVIEW", 2, 1)]
    assert dashboard.sector_coverage_rows(t).first()["resolved_clusters_present"] == 1
    for f in dashboard.QUERIES.values():
        f(t).collect()
    assert dashboard.adapter_coverage_rows(t).first()["adapter"] == "greenhouse"


def test_added_columns_get_defaults(spark):
    old = spark.createDataFrame([(1, "h")], "id int, host string")
    r = schemas.evolved(old, "portals", {"health_state": "UNKNOWN"}).first()
    assert r["id"] == 1 and r["health_state"] == "UNKNOWN" and r["cooldown_until"] is None
