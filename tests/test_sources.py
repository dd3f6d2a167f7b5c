import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import declarative, parsers, payloads, strict_csv


def landed(spark, *bodies, url="https://acme.example.com/site"):
    rows = [(f"p{i}", i, url, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload_id string, portal_id long, url string, body string")


def rows(df):
    return [r.asDict() for r in df.orderBy("payload_id", "ordinal").collect()]


def test_greenhouse(spark):
    job = {"id": 7, "title": " Dev ", "absolute_url": "https://b/7", "location": {"name": "Rome"}, "content": "&lt;p&gt;x&lt;/p&gt;", "updated_at": "2026-01-02T03:04:05Z", "requisition_id": "N/A"}
    got = rows(parsers.greenhouse(landed(spark, {"jobs": [job, {"id": 8, "title": "No URL"}]}, "not json")))
    assert got[0]["source_job_id"] == "7" and got[0]["title"] == "Dev" and got[0]["description"] == "<p>x</p>" and got[0]["requisition_id"] is None
    assert str(got[0]["posted_at"]) == "2026-01-02 03:04:05" and got[0]["problem"] is None
    assert got[1]["problem"] == "lacks source_url" and got[2]["problem"] == "payload has no list of items"


def test_lever_joins_and_dedups_sections(spark):
    job = {"id": "a", "text": "T", "hostedUrl": "https://l/a", "categories": {"allLocations": ["Rome", " ", "Oslo"], "commitment": "Full"}, "createdAt": 1700000000000, "description": "<p>in</p>", "lists": [{"text": "H", "content": "c"}, {"text": "", "content": "<b>in</b>"}, {"text": "x"}]}
    plain = {"id": "b", "text": "T", "hostedUrl": "u", "categories": {"location": "Bonn"}, "descriptionPlain": "plain"}
    got = rows(parsers.lever(landed(spark, [job, plain])))
    assert got[0]["location"] == "Rome | Oslo" and got[0]["description"] == "<p>in</p>\n\nH\nc" and str(got[0]["posted_at"]) == "2023-11-14 22:13:20"
    assert got[0]["apply_url"] == "https://l/a" and got[1]["location"] == "Bonn" and got[1]["description"] == "plain"


def test_ashby_drops_only_literal_false(spark):
    jobs = [{"title": "a", "jobUrl": "u1", "isListed": False}, {"title": "b", "jobUrl": "u2", "isListed": None}, {"title": "c", "jobUrl": "u3", "isListed": "false", "descriptionHtml": "<p>h</p>", "descriptionPlain": "p"}]
    got = rows(parsers.ashby(landed(spark, {"jobs": jobs})))
    assert [r["title"] for r in got] == ["b", "c"] and got[1]["description"] == "<p>h</p>"


def test_smartrecruiters_teamtailor_workable(spark):
    job = {"uuid": "u", "name": "N", "location": {"city": "Rome", "region": "", "country": "it", "remote": True}, "typeOfEmployment": {"id": "permanent", "label": "Fest"}}
    got = rows(parsers.smartrecruiters(landed(spark, {"content": [job]})))[0]
    assert (got["source_job_id"], got["location"], got["workplace_type"], got["employment_type"]) == ("u", "Rome, it", "remote", "permanent")
    items = [{"title": "one", "url": "https://t/jobs/5-x"}, {"title": "two", "url": "https://t/jobs/5-y", "_jobposting": {"jobLocation": [{"address": {"addressLocality": "Oslo"}}]}}]
    assert [r["title"] for r in rows(parsers.teamtailor(landed(spark, {"items": items})))] == ["one"]
    many = [{"shortcode": "s", "title": "t", "url": "u", "city": c, "country": "X"} for c in ("B", "A", "B")]
    got = rows(parsers.workable(landed(spark, {"name": "Acme", "jobs": many})))
    assert len(got) == 1 and got[0]["location"] == "B, X | A, X" and got[0]["company"] == "Acme"


def test_workday_ids_and_facets(spark):
    jobs = [{"title": "a", "externalPath": "/job/a", "bulletFields": ["Spotlight Job", "JR-100"]}, {"title": "b", "externalPath": "job/b", "bulletFields": ["Regular"]}]
    got = rows(parsers.workday(landed(spark, {"jobPostings": jobs})))
    assert [r["source_job_id"] for r in got] == ["JR-100", "job/b"] and got[1]["source_url"] == "https://acme.example.com/site/job/b"
    value = lambda *ns: [{"id": f"v{i}", "count": n} for i, n in enumerate(ns)]
    facets = [{"facetParameter": "exact", "values": value(60, 40)}, {"facetParameter": "short", "values": value(10)}, {"facetParameter": "over", "values": value(90, 90)}, {"facetParameter": "nested", "values": [{"facetParameter": "sub"}]}, {"facetParameter": "odd", "values": [{"id": "z"}]}]
    found = {r["parameter"]: r["coverage"] for r in parsers.workday_facets(landed(spark, {"total": 100, "facets": facets})).collect()}
    assert found == {"exact": "PARTITION_CANDIDATE", "short": "PARTIAL_COVERAGE", "over": "OVERLAPPING", "nested": "NESTED", "odd": "UNKNOWN"}
    capped = parsers.workday_facets(landed(spark, {"total": 2000, "facets": [{"facetParameter": "f", "values": value(1500, 900)}]})).first()
    assert capped["coverage"] == "UNKNOWN"


def test_oracle_and_phenom(spark):
    job = {"Id": "1/2", "Title": "t", "ExternalResponsibilitiesStr": "r", "ExternalQualificationsStr": "q", "JobType": "jt", "ContractType": "ct", "WorkplaceType": "Remote"}
    got = rows(parsers.oracle(landed(spark, {"items": [{"requisitionList": [job]}]})))[0]
    assert got["source_url"] == "https://acme.example.com/site/job/1%2F2" and got["description"] == "r q" and got["employment_type"] == "jt" and got["workplace_type"] == "Remote"
    pages = spark.createDataFrame([(1, 5, 10), (1, 5, 10), (2, 5, 10), (2, 5, 11)], "portal_id int, received int, total int")
    assert {r["portal_id"]: r["complete"] for r in parsers.oracle_completeness(pages).collect()} == {1: True, 2: False}
    page = 'x phApp.ddo = {"eagerLoadRefineSearch":{"status":200,"totalHits":1,"data":{"jobs":[{"title":"T","jobSeqNo":"S1","cityStateCountry":"Rome, IT","applyUrl":"https://a"}]}}}; y'
    assert rows(parsers.phenom(landed(spark, page)))[0]["location"] == "Rome, IT"


def test_positional_records(spark):
    record = [None] * 20
    record[0], record[1], record[7], record[10], record[3], record[4], record[12] = "9", "T", "Acme", [None, "<p>d</p>"], [None, "<p>r</p>"], [None, "<p>r</p>"], [1700000000, 0]
    record[9] = [["Rome, Italy", None, "Rome", None, None, "IT"], ["Oslo", None, "Oslo", None, None, "NO"]]
    single = [*record]
    single[0], single[9] = "10", [["Rome, Italy", None, "Rome", None, None, "IT"]]
    body = ")]}'\n" + json.dumps([["wrb.fr", "rpc", json.dumps([[record, single], None, 2])]])
    got = rows(parsers.positional(landed(spark, body)))
    assert got[0]["location"] == "Rome, Italy; Oslo" and got[0]["country"] is None and got[1]["country"] == "IT" and got[1]["city"] == "Rome"
    assert got[0]["description"] == "<h2>Description</h2><p>d</p>\n<h2>Responsibilities</h2><p>r</p>" and str(got[0]["posted_at"]) == "2023-11-14 22:13:20"


def test_json_ld_and_anchors(spark):
    place = lambda c: {"address": {"addressLocality": c, "addressCountry": "IT"}}
    job = {"@type": ["Thing", "jobposting"], "title": "A", "url": "/jobs/1", "identifier": {"value": "i1"}, "jobLocation": [place("Rome"), place("Bari")], "employmentType": ["FULL", "TEMP"], "jobLocationType": "TELECOMMUTE"}
    page = f'<script type="application/ld+json">{json.dumps({"@graph": [job, {"@type": "Org"}]})}</script><script type="application/ld+json">{json.dumps([job])}</script>'
    got = parsers.json_ld(landed(spark, page)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["source_job_id"], r["source_url"], r["country"], r["city"], r["location"], r["employment_type"], r["workplace_type"]) == ("i1", "https://acme.example.com/jobs/1", "IT", None, "Rome, IT | Bari, IT", "FULL | TEMP", "remote")
    html = '<a href="/jobs/7?utm_source=x">Security <b>Dev</b></a><a href="https://acme.example.com/jobs/7">again here</a><a href="/jobs/8">Apply</a><a href="/about">About us</a><a href="/jobs/9">x</a>'
    found = parsers.anchor_jobs(landed(spark, html)).collect()
    assert [r["title"] for r in found] == ["Security Dev"] and len(found[0]["source_job_id"]) == 64


def test_card_layouts(spark):
    page = 'of 1,204+ results<article class="article"><h3><a href="/careers/JobDetail/Dev/77">Dev &amp; Ops</a></h3><span class="list-item-location location">Rome</span><span class="posted">17-Aug-2026</span></article><article><h3></h3></article>'
    got = rows(parsers.avature(landed(spark, page)))
    assert got[1]["title"] == "Dev & Ops" or got[0]["title"] == "Dev & Ops"
    good = next(r for r in got if r["title"])
    assert good["total"] == 1204 and good["source_job_id"] == "77" and str(good["posted_at"]) == "2026-08-17 00:00:00" and good["source_url"] == "https://acme.example.com/careers/JobDetail/Dev/77"
    assert any(r["problem"] == "lacks title" for r in got)
    table = '<tr class="data-row"><td><a class="jobTitle-link" href="/job/x/55/">T1</a></td><td><span class="jobLocation">Oslo</span></td></tr><a href="?startrow=50">n</a><a href="?startrow=25">n</a>'
    assert rows(parsers.successfactors(landed(spark, table)))[0]["location"] == "Oslo"
    assert parsers.next_start(landed(spark, table, url="https://a.b/c?startrow=25")).first()["next"] == 50
    cards = '<section data-total-results="2"><a href="/job/1" data-job-id="1"><h2>One</h2><span class="job-location">A</span></a><a href="/job/1" data-job-id="1"><h2>One</h2></a></section>'
    got = rows(parsers.radancy(landed(spark, cards)))
    assert len(got) == 1 and got[0]["total"] == 2 and got[0]["location"] == "A"
    feed = "<rss><item><title>T &amp; U</title><link>https://a.b/j/12</link><g:id>99</g:id></item></rss>"
    r = parsers.rss(landed(spark, feed)).first()
    assert (r["title"], r["item_id"], r["trailing_id"]) == ("T & U", "99", "12")


def test_routes(spark):
    cases = {"https://boards.greenhouse.io/a": "greenhouse", "https://x.wd1.myworkdayjobs.com/s": "workday", "https://acme.com/jobs": "official_html", "ftp://x": "unsupported"}
    df = spark.createDataFrame(list(cases.items()), "u string, want string").withColumn("got", parsers.route(F.col("u"), None, {"https://bound.example/x": "declarative:acme"}))
    assert all(r["got"] == r["want"] for r in df.collect())


SPEC = {
    "company": {"id": "acme"}, "request": {}, "open_closed_authoritative": True, "source_of_truth": "full_catalog",
    "extraction": {
        "page_wrapper": {"items": "data.items", "total": "data.count"}, "stable_id_path": "id", "secondary_id_paths": ["alt"], "title_path": "name", "department_path": "dep", "publication_date_path": "ts", "date_format": "unix_seconds",
        "official_url_template": "https://a/{{stable_id}}", "apply_url_path": "apply", "locations": {"path": "loc", "shape": "list_of_strings"},
        "description": {"path": "blocks", "shape": "list_of_blocks", "tasks_relative_key": "t", "qualifications_relative_key": "q"},
    },
    "paging": {"strategy": "offset", "page_size": 10, "first_page_value": 0}, "completeness": {"rules": [{"kind": "next_offset_ge_total"}, {"kind": "last_page_shorter_than_page_size"}]},
}


def test_declarative_jobs(spark):
    spec = declarative.Spec(SPEC)
    item = {"id": 5, "alt": "x9", "name": "N", "ts": 1700000000, "apply": ["https://apply"], "loc": ["B", "A", "B"], "blocks": [{"t": "<p>do</p>", "q": "know"}, {"t": "more"}]}
    wrapped = {"Descriptor": {"alt": "only-alt", "name": "M"}}
    got = declarative.jobs(spec, landed(spark, {"data": {"items": [item, wrapped], "count": 2}}, {"data": {}})).orderBy("ordinal").collect()
    assert len(got) == 2
    assert (got[0]["source_job_id"], got[0]["official_url"], got[0]["apply_url"], got[0]["publication_date"], got[0]["locations"], got[0]["description"], got[0]["qualifications"], got[0]["detail_complete"]) == ("5", "https://a/5", "https://apply", "2023-11-14", ["B", "A"], "do\n\nmore", "know", True)
    assert got[1]["source_job_id"] == "only-alt" and got[1]["detail_complete"] is False
    raw = declarative.to_raw(declarative.jobs(spec, landed(spark, {"data": {"items": [item], "count": 1}}))).first()
    assert raw["location"] == "B | A" and raw["description"] == "do\n\nmore\n\nQualifications:\nknow"


def test_declarative_paging_and_completeness(spark):
    spec = declarative.Spec(SPEC)
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(declarative.offsets(spec, F.lit(25))) == [0, 10, 20] and one(declarative.offsets(spec, F.lit(20))) == [0, 10] and one(declarative.offsets(spec, F.lit(0))) == [0]
    probe = declarative.Spec({**SPEC, "completeness": {"rules": [{"kind": "items_path_empty_after_total"}]}})
    assert one(declarative.offsets(probe, F.lit(20))) == [0, 10, 20]
    history = [("whole", 0, 10, 15), ("whole", 10, 5, 15), ("gap", 0, 10, 25), ("gap", 20, 5, 25), ("full", 0, 10, 10), ("probed", 0, 10, 10), ("probed", 10, 0, 10)]
    df = spark.createDataFrame(history, "run_id string, page_value int, items_count int, total int")
    assert {r["run_id"]: r["complete"] for r in declarative.completeness(spec, df).collect()} == {"whole": True, "gap": False, "full": False, "probed": True}
    assert {r["run_id"]: r["complete"] for r in declarative.completeness(probe, df).collect()} == {"whole": False, "gap": False, "full": False, "probed": True}
    assert one(declarative.may_close(spec, F.lit(True))) is True
    assert one(declarative.query_string([("a b", F.lit("c d~")), ("a b", F.lit("2"))])) == "a%20b=c%20d~&a%20b=2"
    with pytest.raises(declarative.SpecError):
        declarative.Spec({**SPEC, "paging": {"strategy": "cursor"}})
    nested = spark.sql("""select parse_json('{"a": [{"b": 1}, {"b": 2}]}') as v""")
    assert nested.select(declarative.at(F.col("v"), "a.-1.b", "long").alias("x")).first()["x"] == 2


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    head = "alias,corporate_cluster_id,status,evidence_url,evidence_note,verified_date"
    path.write_text(f'﻿{head}\nAcme,c1,VERIFIED,https://x,"a, b",2026-01-02\nAcme,c1,PROPOSED,,,\nBeta,c2,VERIFIED,,,\nGamma,c3,MAYBE,,,bad\n', encoding="utf-8")
    got = {(r["alias"], r["status"]): r["problems"] for r in strict_csv.read(spark, str(path), strict_csv.aliases()).collect()}
    assert got == {("Acme", "VERIFIED"): ["repeated key"], ("Acme", "PROPOSED"): ["repeated key"], ("Beta", "VERIFIED"): ["evidence"], ("Gamma", "MAYBE"): ["status", "date"]}
    path.write_text("alias,other\n", encoding="utf-8")
    with pytest.raises(strict_csv.HeaderError):
        strict_csv.read(spark, str(path), strict_csv.aliases())


def test_cached_payloads(spark, tmp_path):
    key = payloads.write_entry(str(tmp_path), "https://a.b/c", "body", 200, {"ETag": "e", "Set-Cookie": "no"})
    (tmp_path / "broken.json.gz").write_bytes(b"x")
    assert "set-cookie" not in json.loads(gzip.decompress((tmp_path / f"{key}.json.gz").read_bytes()))["headers"]
    got = {r["payload_id"]: (r["body"], r["problem"]) for r in payloads.read_cache(spark, str(tmp_path)).collect()}
    assert got[key] == ("body", None) and got["broken"][1] is not None
    schema = "url string, status int, body string"
    old, new = spark.createDataFrame([("a", 200, "old"), ("b", 200, "keep")], schema), spark.createDataFrame([("a", 304, None), ("c", 200, "new")], schema)
    assert {r["url"]: r["body"] for r in payloads.latest(old, new).collect()} == {"a": "old", "b": "keep", "c": "new"}


def test_detail_pages(spark):
    from tidemark.sources import details

    body = "word " * 40
    plain = f"<nav>menu</nav><main><p>Team · Rome · Hybrid</p><h1>Dev</h1><p>Employment type:</p><p>Full-time</p><p>{body}</p></main><footer>x</footer>"
    ld = f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "title": "LD", "url": "/jobs/1", "description": "<p>a long description here</p>"})}</script>'
    got = {r["payload_id"]: r for r in details.detail_pages(landed(spark, plain, ld, "<p>short</p>")).collect()}
    assert (got["p0"]["title"], got["p0"]["location"], got["p0"]["workplace_type"], got["p0"]["employment_type"], got["p0"]["parser"]) == ("Dev", "Rome", "Hybrid", "Full-time", "main_text")
    assert "menu" not in got["p0"]["description"] and got["p1"]["description"] == "a long description here" and got["p1"]["parser"] == "json_ld_jobposting" and got["p2"]["problem"] == "too little text"


def test_detail_answers(spark):
    from tidemark.sources import details

    one = lambda kind, body: details.detail_json(landed(spark, body), kind).first()
    r = one("workday", {"jobPostingInfo": {"location": "A", "additionalLocations": ["B", "A"], "timeType": "Full", "jobDescription": "<p>x</p>"}})
    assert (r["location"], r["employment_type"], r["description"]) == ("A | B", "Full", "x")
    r = one("smartrecruiters", {"location": {"city": "A", "country": "it"}, "jobAd": {"sections": {"qualifications": {"text": "q"}, "jobDescription": {"text": "d"}}}})
    assert (r["location"], r["description"]) == ("A, it", "d\n\nq")
    r = one("oracle", {"items": [{"PrimaryLocation": "P", "JobType": "J", "ExternalDescriptionStr": "a", "ExternalQualificationsStr": "a"}]})
    assert (r["location"], r["employment_type"], r["description"]) == ("P", "J", "a")


def test_contracts(spark):
    from tidemark.sources import contracts

    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^j"}, "n": {"type": "integer", "minimum": 1}, "u": {"$ref": "#/defs/uri"}, "k": {"enum": ["a"]}, "l": {"type": "array", "minItems": 1, "items": {"type": "string"}}}, "defs": {"uri": {"type": "string", "format": "uri"}}}
    assert contracts.problems({"id": "j1", "n": 2, "u": "https://x", "k": "a", "l": ["z"]}, schema) == []
    assert len(contracts.problems({"id": "x", "n": 0, "u": "no", "k": "b", "l": [], "z": 1}, schema)) == 6
    assert contracts.problems({}, schema) == ["$: lacks id"] and contracts.problems(True, {"type": "integer"}) == ["$: is not integer"]
    assert contracts.problems(3, {"oneOf": [{"minimum": 1}, {"maximum": 5}]}) and contracts.problems(3, {"not": {"minimum": 1}}) and not contracts.problems(3, {"anyOf": [{"minimum": 9}, {"maximum": 5}]})
    df = spark.createDataFrame([("j1", 1), ("x", 0), (None, 5)], "id string, n int")
    tests = contracts.expectations({"required": ["id"], "properties": {"id": {"pattern": "^j"}, "n": {"minimum": 1}}})
    assert [sum(not r[i] for i in range(3)) for r in df.select(*[t.alias(str(i)) for i, t in enumerate(tests.values())]).collect()] == [0, 2, 1]
