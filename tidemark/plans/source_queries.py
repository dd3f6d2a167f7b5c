"""Source parsers over payloads that are laid out from the driver's tables, with SQL that states the records.

A payload holds the customers of one run of ten keys; each parser must give back what the layout put in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls, values
from ..operators import dedup, resolve
from ..session import importable
from ..sources import declarative, details, parsers, strict_csv
from ..sources.strict_csv import checked
from .state_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: What an item is laid out from: k the key, n the name, s the segment, t the nation.
ROWS = "c_custkey as k, c_name as n, c_mktsegment as s, c_nationkey as t"
FROM = f"from (select {ROWS}, (c_custkey - c_custkey % 10) / 10 as p from customer)"


class Landed:
    def __init__(self, spark: SparkSession, folder: str):
        self.customer = spark.read.parquet(f"{folder}/customer.parquet")

    def __call__(self, item: str, left: str = "", right: str = "", glue: str = ", ", url: str = "https://acme.example.com/site/") -> DataFrame:
        """Payloads (payload_id, portal_id, url, body) of ten items each, in order of their keys."""
        rows = self.customer.selectExpr(*ROWS.split(", ")).selectExpr("k - k % 10 as first", "k", f"{item} as item")
        each = rows.groupBy((F.col("first") / 10).cast("long").alias("payload_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
        return each.select("payload_id", F.col("payload_id").alias("portal_id"), F.lit(url).alias("url"), F.concat(F.lit(left), F.array_join("items", glue), F.lit(right)).alias("body"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(Landed(importable(spark), sf_dir)))
        ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""select cast(p as bigint) as payload_id, k % 10 as ordinal, cast(k as varchar) as source_job_id, case when k % 7 > 0 then n end as title, 'https://g.example/' || k as apply_url, s as location, '<p>' || t || ' & more</p>' as description,
    case when k % 3 > 0 then 'R' || k end as requisition_id, strftime(timestamp '2024-01-01' + to_days(cast(k % 9 as int)), '%Y-%m-%d %H:%M:%S') as posted_at, case when k % 7 = 0 then 'lacks title' end as problem {FROM}""")
def s2_greenhouse(land: Landed) -> DataFrame:
    item = """'{"id": ' || k || ', "title": "' || if(k % 7 = 0, '  ', ' ' || n || ' ') || '", "absolute_url": "https://g.example/' || k || '", "location": {"name": "' || s || '"}, "content": "&lt;p&gt;' || t || ' &amp;amp; more&lt;/p&gt;", "requisition_id": "'
        || if(k % 3 = 0, 'N/A', 'R' || k) || '", "updated_at": "2020-01-01T00:00:00Z"' || ', "first_published": "2024-01-0' || (k % 9 + 1) || 'T02:00:00+02:00"}'"""
    land = land(item, '{"jobs": [', "]}")
    return parsers.greenhouse(land).select("payload_id", "ordinal", "source_job_id", "title", "apply_url", "location", F.regexp_replace("description", "&amp;", "&").alias("description"), "requisition_id", "posted_at", "problem")


@query(f"""select cast(p as bigint) as payload_id, 'L' || k as source_job_id, n as title, case when k % 2 = 0 then 'https://l.example/a' || k else 'https://l.example/' || k end as apply_url, case when k % 3 = 0 then s || ' | Oslo' else s end as location,
    'IT' as country, 'remote' as workplace_type, case when k % 4 = 0 then 'plain ' || t else '<p>in ' || t || '</p>' || chr(10) || chr(10) || 'Head' || chr(10) || 'body' end as description {FROM}""")
def s3_lever(land: Landed) -> DataFrame:
    item = """'{"id": "L' || k || '", "text": "' || n || '", "hostedUrl": "https://l.example/' || k || '"' || if(k % 2 = 0, ', "applyUrl": "https://l.example/a' || k || '"', '') || ', "country": "IT", "workplaceType": "remote", "categories": {'
        || if(k % 3 = 0, '"allLocations": ["' || s || '", " ", "Oslo"]', '"location": "' || s || '"') || '}' || if(k % 4 = 0, ', "descriptionPlain": "plain ' || t || '"', ', "description": "<p>in ' || t || '</p>", "lists": [{"text": "Head", "content": "body"}, {"text": "Head", "content": "body"}]') || '}'"""
    return parsers.lever(land(item, "[", "]")).select("payload_id", "source_job_id", "title", "apply_url", "location", "country", "workplace_type", "description")


@query(f"""select cast(p as bigint) as payload_id, 'https://a.example/' || k as source_job_id, n as title, case when k % 2 = 0 then '<p>h</p>' else 'p' end as description, 'DE' as country, s as city, strftime(timestamp '2024-02-03 04:05:06', '%Y-%m-%d %H:%M:%S') as posted_at {FROM} where k % 5 > 0""")
def s4_ashby(land: Landed) -> DataFrame:
    item = """'{"title": "' || n || '", "jobUrl": "https://a.example/' || k || '", "isListed": ' || case k % 5 when 0 then 'false' when 1 then 'null' when 2 then '"false"' else 'true' end || ', "descriptionPlain": "p"' || if(k % 2 = 0, ', "descriptionHtml": "<p>h</p>"', '')
        || ', "publishedAt": "2024-02-03T04:05:06Z", "address": {"postalAddress": {"addressCountry": "DE", "addressLocality": "' || s || '"}}}'"""
    return parsers.ashby(land(item, '{"jobs": [', "]}")).select("payload_id", "source_job_id", "title", "description", "country", "city", "posted_at")


@query(f"""select cast(p as bigint) as payload_id, case when k % 2 = 0 then 'i' || k else 'u' || k end as source_job_id, n as title, s || case when k % 3 = 0 then ', it' else ', R, it' end as location, case when k % 4 = 0 then 'remote' end as workplace_type,
    case when k % 5 = 0 then 'label' else 'permanent' end as employment_type, 'Firm ' || t as company {FROM}""")
def s5_smartrecruiters(land: Landed) -> DataFrame:
    item = """'{"uuid": "u' || k || '"' || if(k % 2 = 0, ', "id": "i' || k || '"', '') || ', "name": "' || n || '", "company": {"name": "Firm ' || t || '"}, "location": {"city": "' || s || '", "region": "' || if(k % 3 = 0, '', 'R') || '", "country": "it", "remote": ' || if(k % 4 = 0, 'true', 'false')
        || '}, "typeOfEmployment": {' || if(k % 5 = 0, '', '"id": "permanent", ') || '"label": "label"}}'"""
    return parsers.smartrecruiters(land(item, '{"content": [', "]}")).select("payload_id", "source_job_id", "title", "location", "workplace_type", "employment_type", "company")


@query(f"""select payload_id, source_job_id, title, location from (select cast(p as bigint) as payload_id, cast((k - k % 2) as varchar) as source_job_id, n as title, case when k % 4 = 0 then s || ', Bari, IT' else s end as location, row_number() over (partition by k - k % 2 order by k) as place {FROM}) where place = 1""")
def s6_teamtailor(land: Landed) -> DataFrame:
    item = """'{"title": "' || n || '", "url": "https://t.example/jobs/' || (k - k % 2) || '-x' || k || '", "_jobposting": {"jobLocation": ' || if(k % 4 = 0, '[7, {"address": {"addressLocality": "' || s || '", "addressRegion": "Bari", "addressCountry": "IT"}}]', '{"address": {"addressLocality": "' || s || '"}}') || '}}'"""
    return parsers.teamtailor(land(item, '{"items": [', "]}")).select("payload_id", "source_job_id", "title", "location")


@query(f"""with r as (select cast(p as bigint) as payload_id, 's' || (k - k % 5) as source_job_id, k, n, s || ', X' as place {FROM}), d as (select payload_id, source_job_id, place, min(k) as k from r group by 1, 2, 3)
select payload_id, source_job_id, arg_min(r.n, r.k) as title, 'Acme' as company, (select string_agg(place, ' | ' order by k) from d where d.source_job_id = r.source_job_id) as location from r group by 1, 2""")
def s7_workable(land: Landed) -> DataFrame:
    item = """'{"shortcode": "s' || (k - k % 5) || '", "title": "' || n || '", "url": "https://w.example/' || k || '", "city": "' || s || '", "country": "X"}'"""
    return parsers.workable(land(item, '{"name": "Acme", "jobs": [', "]}")).select("payload_id", "source_job_id", "title", "company", "location")


@query(f"""select cast(p as bigint) as payload_id, case when k % 3 = 0 then 'job/b' || k else 'JR-' || k end as source_job_id, n as title, 'https://acme.example.com/site/job/b' || k as source_url, case when k % 3 > 0 then 'JR-' || k end as requisition_id, 'Hybrid' as workplace_type {FROM}""")
def s8_workday(land: Landed) -> DataFrame:
    item = """'{"title": "' || n || '", "externalPath": "' || if(k % 3 = 0, 'job/b', '/job/b') || k || '", "remoteType": "Hybrid", "bulletFields": ["Spotlight Job"' || if(k % 3 = 0, '', ', "JR-' || k || '", "R5"') || ']}'"""
    return parsers.workday(land(item, '{"jobPostings": [', "]}")).select("payload_id", "source_job_id", "title", "source_url", "requisition_id", "workplace_type")


@query(f"""with v as (select cast(p as bigint) as payload_id, 'f' || (k % 4) as parameter, t as n {FROM}), a as (select payload_id, parameter, count(*) as "values", sum(n) as counted from v group by 1, 2)
select payload_id, parameter, "values", counted, case when counted < 30 then 'PARTIAL_COVERAGE' when counted > 30 then 'OVERLAPPING' else 'PARTITION_CANDIDATE' end as coverage from a""")
def s9_workday_facets(land: Landed) -> DataFrame:
    base = land("""'{"id": "v' || k || '", "count": ' || t || ', "of": ' || (k % 4) || '}'""")
    # The customers of a payload are dealt to four dimensions by their keys.
    items = F.transform(F.split("body", ", (?=\\{)"), lambda x: F.struct(F.regexp_extract(x, r'"of": (\d)', 1).alias("d"), x.alias("x")))
    values = lambda d: F.array_join(F.transform(F.filter(items, lambda i: i["d"] == str(d)), lambda i: i["x"]), ", ")
    facet = lambda d: F.when(values(d) != "", F.concat(F.lit(f'{{"facetParameter": "f{d}", "values": ['), values(d), F.lit("]}")))
    body = F.concat(F.lit('{"total": 30, "facets": ['), F.concat_ws(", ", *[facet(d) for d in range(4)]), F.lit("]}"))
    return parsers.workday_facets(base.withColumn("body", body))


@query(f"""select cast(p as bigint) as payload_id, 'S' || k as source_job_id, n as title, s || ', IT' as location, case when k % 2 = 0 then 'Q' || k end as requisition_id {FROM}""")
def s10_phenom(land: Landed) -> DataFrame:
    item = """'{"title": "' || n || '", "jobSeqNo": "S' || k || '", "cityStateCountry": "' || s || ', IT"' || if(k % 2 = 0, ', "reqId": "Q' || k || '"', '') || '}'"""
    return parsers.phenom(land(item, 'x phApp.ddo = {"eagerLoadRefineSearch":{"status":200,"totalHits":10,"data":{"jobs":[', "]}}}; y", ",")).select("payload_id", "source_job_id", "title", "location", "requisition_id")


@query(f"""select cast(p as bigint) as payload_id, k || '/x' as source_job_id, n as title, 'https://acme.example.com/site/job/' || k || '%2Fx' as source_url, case when k % 2 = 0 then 'short' else 'resp qual' end as description, case when k % 3 = 0 then 'jt' else 'ct' end as employment_type, 'Remote' as workplace_type {FROM}""")
def s11_oracle(land: Landed) -> DataFrame:
    item = """'{"Id": "' || k || '/x", "Title": "' || n || '"' || if(k % 2 = 0, ', "ShortDescriptionStr": "short"', '') || ', "ExternalResponsibilitiesStr": "resp", "ExternalQualificationsStr": "qual"' || if(k % 3 = 0, ', "JobType": "jt"', '') || ', "ContractType": "ct", "WorkplaceType": "Remote"}'"""
    return parsers.oracle(land(item, '{"items": [{"requisitionList": [', "]}]}")).select("payload_id", "source_job_id", "title", "source_url", "description", "employment_type", "workplace_type")


@query(f"""select cast(p as bigint) as payload_id, cast(k as varchar) as source_job_id, n || ' & Co' as title, 'https://acme.example.com/careers/JobDetail/Dev/' || k as source_url, s as location, 1204 as total, '2026-08-17 00:00:00' as posted_at {FROM}""")
def s12_avature(land: Landed) -> DataFrame:
    item = """'<article class="article"><h3><a href="/careers/JobDetail/Dev/' || k || '">' || n || ' &amp; Co</a></h3><span class="list-item-location location">' || s || '</span><span class="posted">17-Aug-2026</span></article>'"""
    return parsers.avature(land(item, "<p>of 1,204+ results</p>", "")).select("payload_id", "source_job_id", "title", "source_url", "location", "total", "posted_at")


@query(f"""select cast(p as bigint) as payload_id, cast(k as varchar) as source_job_id, n as title, 'https://acme.example.com/job/x/' || k || '/' as source_url, s as location {FROM}""")
def s13_successfactors(land: Landed) -> DataFrame:
    item = """if(k % 2 = 0, '<tr class="data-row">', '<li class="job-tile">') || '<a class="jobTitle-link" href="/job/x/' || k || '/">' || n || '</a><span class="jobLocation">' || s || '</span>' || if(k % 2 = 0, '</tr>', '</li>')"""
    return parsers.successfactors(land(item, "<table>", "</table>")).select("payload_id", "source_job_id", "title", "source_url", "location")


@query(f"""select cast(p as bigint) as payload_id, cast(k as varchar) as source_job_id, n as title, 'https://acme.example.com/job/' || k as source_url, s as location, 10 as total {FROM}""")
def s14_radancy(land: Landed) -> DataFrame:
    item = """'<a href="/job/' || k || '" data-job-id="' || k || '"><h2>' || n || '</h2><span class="job-location">' || s || '</span></a><a href="/job/' || k || '" data-job-id="' || k || '"><h2>again</h2></a>'"""
    return parsers.radancy(land(item, '<section data-total-results="10">', "</section>")).select("payload_id", "source_job_id", "title", "source_url", "location", "total")


@query(f"""select cast(p as bigint) as payload_id, cast(k as varchar) as source_job_id, n as title, 'Firm ' || t as company, case when k % 2 = 0 then s || '; Oslo' else s end as location, case when k % 2 = 1 then 'IT' end as country,
    '<h2>Description</h2><p>d' || t || '</p>' || chr(10) || '<h2>Responsibilities</h2><p>r</p>' as description, '2023-11-14 22:13:20' as posted_at {FROM}""")
def s15_positional(land: Landed) -> DataFrame:
    item = r"""'[\\"' || k || '\\", \\"' || n || '\\", null, [null, \\"<p>r</p>\\"], [null, \\"<p>r</p>\\"], null, null, \\"Firm ' || t || '\\", null, [[\\"' || s || '\\", null, \\"Town\\", null, null, \\"IT\\"]' || if(k % 2 = 0, ', [\\"Oslo\\", null, \\"Oslo\\", null, null, \\"NO\\"]', '')
        || '], [null, \\"<p>d' || t || '</p>\\"], null, [1700000000, 0]]'"""
    return parsers.positional(land(item, ")]}'\n[[\"wrb.fr\", \"rpc\", \"[[", "], null, 2]\"]]")).select("payload_id", "source_job_id", "title", "company", "location", "country", "description", "posted_at")


@query(f"""select cast(p as bigint) as payload_id, 'i' || k as source_job_id, n as title, 'https://acme.example.com/jobs/' || k as source_url, s || ', IT' || case when k % 2 = 0 then ' | Oslo, IT' else '' end as location, 'IT' as country, case when k % 2 = 1 then s end as city,
    'FULL | TEMP' as employment_type, 'remote' as workplace_type {FROM}""")
def s16_json_ld(land: Landed) -> DataFrame:
    item = """'{"@type": ["Thing", "jobposting"], "title": "' || n || '", "url": "/jobs/' || k || '", "identifier": {"value": "i' || k || '"}, "jobLocation": [{"address": {"addressLocality": "' || s || '", "addressCountry": "IT"}}' || if(k % 2 = 0, ', {"address": {"addressLocality": "Oslo", "addressCountry": "IT"}}', '')
        || '], "employmentType": ["FULL", "TEMP"], "jobLocationType": "TELECOMMUTE"}'"""
    pages = land(item, '<script type="application/ld+json">{"@graph": [{"@type": "Org"}, ', "]}</script>")
    return parsers.json_ld(pages).select("payload_id", "source_job_id", "title", "source_url", "location", "country", "city", "employment_type", "workplace_type")


@query(f"""select cast(p as bigint) as payload_id, case when k % 4 = 3 then 'https://acme.example.com/x?gh_jid=' || k else 'https://acme.example.com/' || case k % 4 when 0 then 'jobs/' when 1 then 'job-detail/' else 'position/' end || k end as absolute_url, n || ' & more' as title {FROM} where k % 10 not in (5, 6, 7)""")
def s17_anchor_discovery(land: Landed) -> DataFrame:
    item = """case k % 10 when 5 then '<a href="/careers/' || k || '">' || n || '</a>' when 6 then '<a href="/jobs/' || k || '">Find a Job</a>' when 7 then '<a href="/jobs/' || k || '">abc</a>'
        else '<a class="x" href="' || case k % 4 when 0 then '/jobs/' when 1 then '/job-detail/' when 2 then '/position/' else '/x?gh_jid=' end || k || '"><b>' || n || '</b> &amp; more</a>' end
        || '<a href="https://acme.example.com/jobs/' || (k - k % 4) || if(k % 4 = 0 and k % 10 not in (5, 6, 7), '">again there</a>', '">x</a>')"""
    return parsers.anchors(land(item, "<html>", "</html>", "\n")).select("payload_id", "absolute_url", "title")


@query(f"""select cast(p as bigint) as payload_id, 'https://r.example/jobs/' || k as link, n || ' & Co' as title, 'i' || k as item_id {FROM}""")
def s33_rss(land: Landed) -> DataFrame:
    item = """'<item><title>' || if(k % 2 = 0, '<![CDATA[' || n || ' & Co]]>', n || ' &amp; Co') || '</title><link>https://r.example/jobs/' || k || '</link><g:id>i' || k || '</g:id></item>'"""
    return parsers.rss(land(item, "<rss>", "</rss>")).select("payload_id", "link", "title", "item_id")


# --- declarative sources ---------------------------------------------------------------------------------

SPEC = declarative.Spec(
    {
        "company": {"id": "acme"}, "request": {}, "open_closed_authoritative": True, "source_of_truth": "full_catalog",
        "extraction": {
            "page_wrapper": {"items": "data.items", "total": "data.count"}, "stable_id_path": "id", "secondary_id_paths": ["alt"], "title_path": "name", "publication_date_path": "ts", "date_format": "unix_seconds",
            "official_url_template": "https://a/{{stable_id}}", "apply_url_path": "apply", "locations": {"path": "loc", "shape": "list_of_strings"},
            "description": {"path": "blocks", "shape": "list_of_blocks", "tasks_relative_key": "t", "qualifications_relative_key": "q"},
        },
        "detail": {"description_path": "more"},
        "paging": {"strategy": "offset", "page_size": 10, "first_page_value": 0}, "completeness": {"rules": [{"kind": "next_offset_ge_total"}, {"kind": "last_page_shorter_than_page_size"}]},
    }
)
DECLARED = """if(k % 4 = 0, '{"Descriptor": {"alt": "only' || k || '", "name": "' || n || '"}}', '{"id": ' || k || ', "alt": "x' || k || '", "name": "' || n || '", "ts": 1700000000, "apply": ["https://apply/' || k || '"], "loc": ["' || s || '", "Rome", "' || s || '"], "blocks": [{"t": "<p>do ' || t || '</p>"'
    || if(k % 3 = 0, '', ', "q": "know"') || '}, {"t": "more"}]}')"""


def declared(land: Landed) -> DataFrame:
    return declarative.jobs(SPEC, land(DECLARED, '{"data": {"items": [', '], "count": 10}}'))


@query(f"""select cast(p as bigint) as payload_id, case when k % 4 = 0 then 'only' || k else cast(k as varchar) end as source_job_id, n as title, case when k % 4 > 0 then s || ',Rome' else '' end as locations, case when k % 4 > 0 then '2023-11-14' end as publication_date,
    'https://a/' || case when k % 4 = 0 then 'only' || k else cast(k as varchar) end as official_url, case when k % 4 > 0 then 'https://apply/' || k end as apply_url, case when k % 4 > 0 then 'do ' || t || chr(10) || chr(10) || 'more' else '' end as description,
    case when k % 4 > 0 and k % 3 > 0 then 'know' else '' end as qualifications, k % 4 > 0 and k % 3 > 0 as detail_complete {FROM}""")
def s18_declarative_jobs(land: Landed) -> DataFrame:
    return declared(land).select("payload_id", "source_job_id", "title", "locations", "publication_date", "official_url", "apply_url", "description", "qualifications", "detail_complete")


@query("""with r as (select c_custkey as run, 10 * (c_custkey % 4) + c_custkey % 10 as total from customer)
select run as run_id, case when total > 10 and run % 7 = 0 then 'missing pages' when total % 10 = 0 then 'last page with items was full' else 'all rules hold' end as reason from r""")
def s19_declarative_completeness(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    runs = land.customer.select(k.alias("run_id"), (10 * (k % 4) + k % 10).alias("total"))
    pages = runs.withColumn("page_value", F.explode(declarative.offsets(SPEC, F.col("total")))).where("not (run_id % 7 = 0 and page_value = 10)")
    history = pages.withColumn("items_count", F.least(F.lit(10), F.greatest(F.lit(0), F.col("total") - F.col("page_value"))))
    return declarative.completeness(SPEC, history).select("run_id", "reason")


@query(f"""select cast(k as varchar) as source_job_id, s || ' | Rome' as location, case when k % 5 = 0 then 'longer ' || t || case when k % 3 > 0 and k % 2 = 0 then chr(10) || chr(10) || 'Qualifications:' || chr(10) || 'must' else '' end
    else 'do ' || t || chr(10) || chr(10) || 'more' || case when k % 3 > 0 then chr(10) || chr(10) || 'Qualifications:' || chr(10) || 'know' else '' end end as description, '2023-11-14 00:00:00' as posted_at {FROM} where k % 4 > 0""")
def s20_declarative_to_raw(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"more": [{"t": "longer '), F.col("c_nationkey"), F.lit('"'), F.when((k % 3 > 0) & (k % 2 == 0), ', "q": "must"').otherwise(""), F.lit("}]}"))
    found = land.customer.where("c_custkey % 5 = 0").select(k.cast("string").alias("source_job_id"), body.alias("body"))
    rows = declarative.with_details(SPEC, declared(land).where("source_job_id not like 'only%'"), found)
    return declarative.to_raw(rows).select("source_job_id", "location", "description", "posted_at")


@query("select c_custkey as k, 'q=' || replace(replace(c_name || ' & co', '#', '%23'), ' & ', '%20%26%20') || '&page=' || c_custkey || '&q=x~y' as query from customer")
def s21_request_query(land: Landed) -> DataFrame:
    pairs = [("q", F.concat("c_name", F.lit(" & co"))), ("page", F.col("c_custkey")), ("q", F.lit("x~y"))]
    return land.customer.select(F.col("c_custkey").alias("k"), declarative.query_string(pairs).alias("query"))


# --- registry files, detail answers and single functions -------------------------------------------------


@query("""with r as (select c_custkey as k, case when c_custkey % 7 = 1 then '--' else 'Alias ' || (c_custkey - c_custkey % 2) end as alias, 'c' || (c_custkey % 2 + 4 * (c_custkey - c_custkey % 2)) as cluster from customer)
select k, concat_ws(',', case when alias = '--' then 'alias' end, case when k % 5 = 2 then 'status' end, case when k % 5 = 0 and k % 3 > 0 then 'evidence' end, case when k % 11 = 3 then 'date' end) as problems from r""")
def s23_alias_problems(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    even = k - k % 2
    rows = land.customer.select(
        F.when(k % 7 == 1, "--").otherwise(F.concat(F.lit("Alias "), even)).alias("alias"), F.concat(F.lit("c"), k % 2 + 4 * even).alias("corporate_cluster_id"), F.when(k % 5 == 2, "MAYBE").when(k % 5 == 0, "VERIFIED").otherwise("PROPOSED").alias("status"),
        F.when(k % 3 == 0, "https://e.example/x").otherwise("").alias("evidence_url"), F.lit("").alias("evidence_note"), F.when(k % 11 == 3, "soon").otherwise("").alias("verified_date"), k.alias("k"),
    )
    return checked(rows, strict_csv.aliases()).select("k", F.array_join("problems", ",").alias("problems"))


@query("""with r as (select c_custkey as k, case c_custkey % 5 when 0 then 'ADD' when 1 then 'UPDATE' when 2 then 'RETIRE' when 3 then 'RENAME' else 'SUSPEND' end as action from customer)
select k, concat_ws(',', case when action = 'RENAME' then 'action' end, case when k % 13 = 0 then 'reason' end, case when action in ('ADD', 'UPDATE') and k % 3 = 0 then 'new URL' when action not in ('ADD', 'UPDATE') and k % 3 > 0 then 'new URL' end,
    case when action = 'ADD' and k % 4 > 0 then 'old URL' when action <> 'ADD' and k % 4 = 0 then 'old URL' end) as problems from r""")
def s24_change_problems(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    action = F.get(F.array(*map(F.lit, ("ADD", "UPDATE", "RETIRE", "RENAME", "SUSPEND"))), (k % 5).cast("int"))
    of = {"corporate_cluster_id": F.concat(F.lit("c"), k), "action": action, "old_jobs_url": F.when(k % 4 > 0, "https://old.example"), "new_jobs_url": F.when(k % 3 > 0, "https://new.example"), "reason": F.when(k % 13 > 0, "r")}
    contract = strict_csv.registry_changes()
    rows = land.customer.select(*[F.coalesce(of.get(c, F.lit("")), F.lit("")).alias(c) for c in contract.columns], k.alias("k"))
    return checked(rows, contract).select("k", F.array_join("problems", ",").alias("problems"))


@query("""with r as (select c_custkey as k from customer) select k, case when k % 3 = 0 then 'i' || k else case when k % 4 > 0 then cast(k as varchar) else '' end end as job_id,
    concat_ws(',', case when k % 3 > 0 and k % 4 = 0 then 'id' end, case when k % 7 = 0 then 'title' end, case when k % 11 = 0 then 'URL' end) as problems from r""")
def s26_manual_jobs(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    link = F.when(k % 11 == 0, F.concat(F.lit("ftp://x/jobs/view/dev-"), k)).otherwise(F.concat(F.lit("https://x.example/jobs/view/dev-"), k))
    of = {"job_id": F.when(k % 3 == 0, F.concat(F.lit("i"), k)), "job_url": F.when(k % 4 > 0, link).otherwise(F.when(k % 11 == 0, "ftp://x").otherwise("https://x.example/jobs")), "title": F.when(k % 7 > 0, "T"), "company": F.lit("Acme")}
    contract = strict_csv.manual_jobs()
    rows = land.customer.select(*[F.coalesce(of.get(c, F.lit("")), F.lit("")).alias(c) for c in contract.columns], k.alias("k"))
    return checked(rows, contract).select("k", strict_csv.native_job_id().alias("job_id"), F.array_join("problems", ",").alias("problems"))


@query(f"""select cast(k as bigint) as payload_id, case when k % 4 = 0 then 'LD ' || n when k % 4 < 3 then n end as title, case k % 4 when 0 then null when 1 then 'Rome' when 2 then s end as location, case k % 4 when 0 then '' when 1 then 'Hybrid' when 2 then 'On site' end as workplace_type,
    case k % 4 when 0 then '' when 1 then '' when 2 then 'Full-time' end as employment_type, case when k % 4 = 0 then 'json_ld_jobposting' else 'main_text' end as parser, case when k % 4 = 3 then 'too little text' end as problem {FROM}""")
def n9_detail_pages(land: Landed) -> DataFrame:
    """Structured data, a header above the heading, labels, and too little text."""
    k, n, s = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    body = F.lit("<p>" + "word " * 40 + "</p></main><footer>x</footer>")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "title": "LD '), n, F.lit('", "url": "/jobs/1", "description": "<p>a long description here</p>"}</script>'))
    dotted = F.concat(F.lit("<nav>menu</nav><main><p>Team · Rome · Hybrid</p><h1>"), n, F.lit("</h1>"), body)
    named = F.concat(F.lit("<main><h1>"), n, F.lit("</h1><p>Location:</p><p>"), s, F.lit("</p><p>Remote status</p><p>On site</p><div>Job type</div><div>Full-time</div>"), body)
    page = F.when(k % 4 == 0, ld).when(k % 4 == 1, dotted).when(k % 4 == 2, named).otherwise("<p>short</p>")
    pages = land.customer.select(k.alias("payload_id"), k.alias("portal_id"), F.lit("https://acme.example.com/site/").alias("url"), page.alias("body"))
    return details.detail_pages(pages).select("payload_id", "title", F.nullif("location", F.when(k_is(0), F.lit("")).otherwise("-")).alias("location"), "workplace_type", "employment_type", "parser", "problem")


def k_is(rest: int):
    return F.col("payload_id") % 4 == rest


@query(f"select cast(k as bigint) as payload_id, s || case when k % 2 = 0 then ' | Oslo' else '' end as location, 'Full' as employment_type, 'do ' || t as description {FROM}")
def n10_detail_answers(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"jobPostingInfo": {"location": "'), "c_mktsegment", F.lit('", "additionalLocations": ['), F.when(k % 2 == 0, '"Oslo", "Oslo"').otherwise(""), F.lit('], "timeType": "Full", "jobDescription": "<p>do '), "c_nationkey", F.lit('</p>"}}'))
    return details.detail_json(land.customer.select(k.alias("payload_id"), body.alias("body")), "workday").select("payload_id", "location", "employment_type", "description")


@query("""select c_custkey as k, 'r ' || c_nationkey || ' d lead' as title, case when c_custkey % 2 = 0 then 'oslo | rome' else 'rome' end as place, 'https://x.example/a?b=' || c_custkey as overlap, case when c_custkey % 3 = 0 then 'none' else cast(c_custkey as varchar) end as value,
    'jobs/' || c_custkey || '/' || c_mktsegment as filled, case c_custkey % 4 when 0 then cast(c_custkey as double) when 1 then 0.0 when 2 then 90.0 end as wait from customer""")
def n4_n14_n30_n31_n34_functions(land: Landed) -> DataFrame:
    k = F.col("c_custkey")
    title = F.concat(F.lit("<b>R&nbsp;"), "c_nationkey", F.lit("</b> &amp;D Lead"))
    place = F.when(k % 2 == 0, "Rome | OSLO |rome").otherwise(" Rome ")
    waits = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, "-5").when(k % 4 == 2, "Wed, 03 Jan 2024 00:01:30 GMT").otherwise("later")
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    return land.customer.select(
        k.alias("k"), text.normalize_title(title).alias("title"), text.normalize_location(place).alias("place"), urls.overlap_url(F.concat(F.lit("www.X.example/a?b="), k)).alias("overlap"),
        values.string_value(F.when(k % 3 > 0, F.concat(F.lit(" "), k, F.lit(" "))), "none").alias("value"), values.template("jobs/{key}/{part}", {"key": k, "part": F.col("c_mktsegment")}).alias("filled"), values.retry_after(waits, now).alias("wait"),
    )


@query("""select c_custkey as k, case when c_custkey % 5 = 0 then 'anonymous' when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'n' || c_custkey else 'plain' end as stem, c_custkey % 5 = 0 or (c_custkey % 2 = 0 and c_custkey % 3 = 0) as is_variant from customer""")
def d5_collisions(land: Landed) -> DataFrame:
    """Blank ids and rows whose title conflicts with the stored base row get an id of their own."""
    k, none = F.col("c_custkey"), F.lit("")
    own = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("n"), k))
    jobs = land.customer.select(k.alias("k"), F.lit("s").alias("source"), own.alias("source_job_id"), F.col("c_name").alias("title"), none.alias("location"), none.alias("apply_url"), none.alias("requisition_id"))
    stored = land.customer.where("c_custkey % 2 = 0").select(F.lit("s").alias("source"), F.concat(F.lit("n"), k).alias("source_job_id"), F.when(k % 3 == 0, "Another").otherwise(F.upper("c_name")).alias("title"), none.alias("location"), none.alias("apply_url"), none.alias("requisition_id"))
    out = dedup.preserve_collisions(jobs, stored)
    return out.select("k", F.when(F.col("is_variant"), F.substring_index("source_job_id", "::", 1)).otherwise("plain").alias("stem"), "is_variant")


@query("""select c_custkey as k, case when c_custkey % 3 = 0 then 'Cluster ' || (c_custkey % 7) when c_custkey % 3 = 1 then 'Raw ' || c_custkey else 'Nordic' end as display_name from customer""")
def n35_display_names(land: Landed) -> DataFrame:
    """The cluster's name, else the raw one, else what the names of the portal's clusters begin with."""
    k, p = F.col("c_custkey"), F.col("id")
    spark = land.customer.sparkSession
    clusters = spark.range(7).select(F.concat(F.lit("c"), p).alias("corporate_cluster_id"), F.concat(F.lit("Cluster "), p).alias("representative")).unionByName(spark.range(2).select(F.concat(F.lit("n"), p).alias("corporate_cluster_id"), F.concat(F.lit("Nordic "), p).alias("representative")))
    mappings = spark.range(2).select(F.lit(1).cast("long").alias("portal_id"), F.concat(F.lit("n"), p).alias("corporate_cluster_id"), F.lit("").alias("parent_override"))
    jobs = land.customer.select(k.alias("k"), F.lit(1).cast("long").alias("portal_id"), F.when(k % 3 == 1, F.concat(F.lit("Raw "), k)).otherwise(" ").alias("raw_company"), F.when(k % 3 == 0, F.concat(F.lit("c"), k % 7)).alias("corporate_cluster_id"))
    return resolve.display_names(jobs, mappings, clusters).select("k", "display_name")
