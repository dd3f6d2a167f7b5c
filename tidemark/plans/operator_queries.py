"""Operators whose every branch is reached: registries, resolution, the lifecycle, hashes and selections, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import classify, dedup, ingest, lifecycle, predicates, resolve
from ..session import importable
from ..sources import parsers, registries
from ..sources.strict_csv import checked
from .state_queries import plain
from .state_tables import CTES, State

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Source(State):
    """State tables by key, the driver's tables by attribute."""

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str, state: bool = False):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(Source(importable(spark), sf_dir)))
        ORACLE[f.__name__] = (CTES + sql) if state else sql
        return f

    return add


# --- deduplication ---------------------------------------------------------------------------------------

#: Orders as rows that share source ids, URLs, ATS ids and contents on periods of their own.
ROWS = """r as (select o_orderkey as k, o_orderdate < timestamp '1999-01-01' as old, 'n' || (o_orderkey % 701) as src, case when o_orderkey % 3 = 0 then 'https://x.example/jobs/' || (o_orderkey % 499) end as url,
    case when o_orderkey % 4 = 0 then o_custkey % 10 || '|a' || (o_orderkey % 307) end as ats, o_custkey % 10 || '|title ' || (o_orderkey % 7) || '|loc ' || (o_orderkey % 5) as prt, 'title ' || (o_orderkey % 7) as title, 'loc ' || (o_orderkey % 5) as place from orders)"""
OWNER = lambda key: f"(select * from (select *, row_number() over (partition by {key} order by k desc) as n from r where old and {key} is not null) where n = 1)"
FITS = lambda a: f"{a}.k is not null and {a}.title = c.title and {a}.place = c.place and coalesce({a}.url = c.url, true)"


@query(f"""with {ROWS} select c.k as o_orderkey, case when {FITS('s')} then s.k when {FITS('u')} then u.k when {FITS('a')} then a.k else p.k end as matched,
    case when {FITS('s')} then 'source_job_id' when {FITS('u')} then 'canonical_apply_url' when {FITS('a')} then 'ats_job_id' when p.k is not null then 'normalized_fingerprint' end as method
from (select * from r where not old) c left join {OWNER('src')} s on s.src = c.src left join {OWNER('url')} u on u.url = c.url left join {OWNER('ats')} a on a.ats = c.ats left join {OWNER('prt')} p on p.prt = c.prt""")
def d1_four_probes(s: Source) -> DataFrame:
    k = F.col("o_orderkey")
    rows = s.orders.select(
        k.alias("ordinal"), F.lit("s").alias("source"), F.concat(F.lit("n"), k % 701).alias("source_job_id"), F.when(k % 3 == 0, F.concat(F.lit("https://x.example/jobs/"), k % 499, F.lit("?utm_source=a"))).otherwise("").alias("apply_url"),
        (F.col("o_custkey") % 10).cast("string").alias("corporate_cluster_id"), F.concat(F.lit("Title  <b>"), k % 7, F.lit("</b>")).alias("title"), F.concat(F.lit("LOC "), k % 5).alias("location"),
        F.when(k % 4 == 0, F.concat(F.lit("a"), k % 307)).otherwise("").alias("ats_job_id"), F.lit("").alias("requisition_id"), k.cast("string").alias("canonical_job_id"), "o_orderdate",
    )
    keyed = dedup.keyed(rows)
    old, new = keyed.where("o_orderdate < timestamp'1999-01-01'"), keyed.where("o_orderdate >= timestamp'1999-01-01'")
    return dedup.match_state(new, old).select(F.col("ordinal").alias("o_orderkey"), F.col("canonical_job_id").cast("long").alias("matched"), "method")


# --- entity resolution -----------------------------------------------------------------------------------

NAMES = """clusters as (select 'c' || s_suppkey as id, 'Supplier ' || (s_suppkey // 2) as name from supplier), aliases as (select distinct 'aka ' || (s_suppkey % 30) as name, 'c' || (s_suppkey - s_suppkey % 3) as id from supplier where s_suppkey % 4 > 0),
of as (select lower(name) as name, list_sort(list(distinct id)) as ids from clusters group by 1), ali as (select name, list_sort(list(distinct id)) as ids from aliases group by 1)"""


def clusters(s: Source) -> DataFrame:
    none, k = F.array().cast("array<string>"), F.col("s_suppkey")
    return s.supplier.select(F.concat(F.lit("c"), k).alias("corporate_cluster_id"), F.concat(F.lit("Supplier "), F.floor(k / 2).cast("long")).alias("representative"), none.alias("canonical_employers"), none.alias("parent_groups"))


def aliases(s: Source) -> DataFrame:
    """Verified ones, and as many proposed ones that must not count."""
    k = F.col("s_suppkey")
    row = lambda status, key: s.supplier.where(k % 4 > 0).select(F.concat(F.lit("aka "), key).alias("normalized_alias"), F.concat(F.lit("c"), k - k % 3).alias("corporate_cluster_id"), F.lit(status).alias("status")).distinct()
    return row("VERIFIED", k % 30).unionByName(row("PROPOSED", k % 30 + 30))


ASKED = "case p_partkey % 5 when 0 then '' when 1 then 'supplier ' || (p_partkey % 90) when 2 then 'aka ' || (p_partkey % 60) when 3 then 'nobody' else 'supplier ' || (p_partkey % 40) end"


def asked(s: Source, *more) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(F.lit("SUPPLIER, "), k % 90)).when(k % 5 == 2, F.concat(F.lit("Aka-"), k % 60)).when(k % 5 == 3, "Nobody").otherwise(F.concat(F.lit("Supplier "), k % 40))
    return s.part.select("p_partkey", name.alias("raw_company"), *more)


@query(f"""with {NAMES}, j as (select p_partkey, {ASKED} as n from part)
select p_partkey, case when n = '' then 'external_source_missing_company' when len(o.ids) = 1 then 'global_exact_company_name' when len(o.ids) > 1 then 'global_ambiguous_company_name' when len(a.ids) = 1 then 'global_verified_company_alias'
    when len(a.ids) > 1 then 'global_ambiguous_verified_alias' else 'global_company_name_not_found' end as method, case when len(o.ids) = 1 then o.ids[1] when o.ids is null and len(a.ids) = 1 then a.ids[1] end as corporate_cluster_id
from j left join of o on o.name = j.n left join ali a on a.name = j.n""")
def j11_global_resolution_with_aliases(s: Source) -> DataFrame:
    return resolve.resolve_global(asked(s), clusters(s), aliases(s)).select("p_partkey", "method", "corporate_cluster_id")


@query(f"""with {NAMES}, g as (select *, case when p_partkey % 11 = 0 then 'c' || (p_partkey % 150) else '' end as given, {ASKED} as n from part), j as (select p_partkey, given, n, c.id as known from g left join clusters c on c.id = g.given)
select p_partkey, case when known is not null then 'explicit' when len(a.ids) = 1 then 'alias' when len(o.ids) = 1 then 'name' else 'unmatched' end as match_method,
    case when known is not null then known when len(a.ids) = 1 then a.ids[1] when len(o.ids) = 1 then o.ids[1] end as corporate_cluster_id
from j left join of o on o.name = j.n and j.n <> '' left join ali a on a.name = j.n""")
def j12_reconcile_with_aliases(s: Source) -> DataFrame:
    k = F.col("p_partkey")
    rows = asked(s, F.when(k % 11 == 0, F.concat(F.lit("c"), k % 150)).otherwise("").alias("given_cluster_id")).withColumnRenamed("raw_company", "employer")
    return resolve.reconcile(rows, clusters(s), aliases(s).where("status = 'VERIFIED'")).select("p_partkey", "match_method", "corporate_cluster_id")


@query(f"""with {NAMES}, m as (select distinct case when l_suppkey % 9 = 0 then 1000 + l_suppkey else l_partkey % 40 end as portal, 'c' || l_suppkey as id, case when l_suppkey % 7 = 0 then 'group ' || (l_suppkey % 21) else '' end as parent from lineitem),
per as (select portal, list_sort(list(distinct id)) as ids from m group by 1), k as (select portal, m.id, lower(name) as name from m join clusters c on c.id = m.id union select portal, id, parent from m where parent <> '' union select portal, m.id, a.name from m join aliases a on a.id = m.id),
hits as (select portal, name, list_sort(list(distinct id)) as ids from k group by 1, 2),
j as (select p_partkey, case when p_partkey % 8 = 0 then 1000 + p_partkey % 100 else p_partkey % 42 end as portal, case when p_partkey % 6 = 1 then 'group ' || (p_partkey % 28) else {ASKED} end as n from part)
select p_partkey, case when per.ids is null then 'portal_has_no_cluster_mapping' when len(per.ids) = 1 then 'single_portal_mapping' when n = '' then 'shared_portal_missing_company' when len(h.ids) = 1 then 'exact_company_name' when len(h.ids) > 1 then 'ambiguous_exact_company_name'
    else 'shared_portal_no_exact_company_match' end as method, case when len(per.ids) = 1 then per.ids[1] when per.ids is not null and n <> '' and len(h.ids) = 1 then h.ids[1] end as corporate_cluster_id
from j left join per on per.portal = j.portal left join hits h on h.portal = j.portal and h.name = j.n""")
def j10_portal_resolution(s: Source) -> DataFrame:
    k, p = F.col("l_suppkey"), F.col("p_partkey")
    parent = F.when(k % 7 == 0, F.concat(F.lit("Group "), k % 21)).otherwise("")
    mappings = s.lineitem.select(F.when(k % 9 == 0, 1000 + k).otherwise(F.col("l_partkey") % 40).alias("portal_id"), F.concat(F.lit("c"), k).alias("corporate_cluster_id"), parent.alias("parent_override")).distinct()
    jobs = asked(s, F.when(p % 8 == 0, 1000 + p % 100).otherwise(p % 42).alias("portal_id")).withColumn("raw_company", F.when(p % 6 == 1, F.concat(F.lit("GROUP "), p % 28)).otherwise(F.col("raw_company")))
    return resolve.resolve_in_portal(jobs, mappings, clusters(s), aliases(s)).select("p_partkey", "method", "corporate_cluster_id")


@query("""with c as (select s_suppkey as company_id, 'jobs.acme' || (s_suppkey % 25) || '.com' as own, 'acme' || (s_suppkey % 25) as token, 'acme' || s_suppkey as key, 'board.example/' || (7 * s_suppkey) as portal from supplier),
b as (select p_partkey, 'board.example/' || p_partkey as url, 'acme' || (p_partkey % 40) as name, 'acme' || (p_partkey % 30) as slug, case when p_partkey % 9 = 0 then 'jobs.acme' || (p_partkey % 50) || '.com' else '' end as domain from part),
u as (select company_id, p_partkey, 'URL_EXACT' as basis from c join b on portal = url), d as (select company_id, p_partkey, 'DOMAIN_EXACT' as basis from c join b on own = domain),
t as (select company_id, p_partkey, case when contains(key, name) or contains(name, key) then 'SLUG_PLUS_NAME' else 'SLUG' end as basis from c join b on slug = token),
f as (select * from u union select * from d union select * from t), n as (select company_id, p_partkey from c join b on key = name), h as (select p_partkey, count(distinct company_id) as hits from n group by 1),
o as (select * from f union all select company_id, p_partkey, 'NAME_EXACT' from n join h using (p_partkey) where hits = 1 and not exists (select 1 from f where f.company_id = n.company_id and f.p_partkey = n.p_partkey))
select basis, case when basis in ('SLUG', 'NAME_EXACT') then 'CANDIDATE' else 'HIGH_CONFIDENCE' end as match_class, count(*) as matches, count(distinct company_id) as companies, count(distinct p_partkey) as boards, sum(company_id * (p_partkey % 1009)) as checksum from o group by 1, 2""")
def j13_j16_overlap(s: Source) -> DataFrame:
    """Every kind of evidence over all companies and boards, summed up by kind over groups of boards."""
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    companies = s.supplier.select(k.alias("company_id"), F.concat(F.lit("www.jobs.acme"), k % 25, F.lit(".com")).alias("domain"), F.array(F.concat(F.lit("https://www.board.example/"), 7 * k, F.lit("/"))).alias("portals"), F.array(F.concat(F.lit("Acme "), k)).alias("names"))
    companies = companies.withColumn("domain", F.regexp_replace("domain", "^www.", ""))
    boards = s.part.select(F.lit("lever").alias("family"), F.concat(F.lit("acme"), p % 30).alias("slug"), F.concat(F.lit("https://board.example/"), p).alias("url"), F.concat(F.lit("Acme-"), p % 40).alias("name"), F.when(p % 9 == 0, F.concat(F.lit("Jobs.acme"), p % 50, F.lit(".com"))).otherwise("").alias("domain"))
    links, members = resolve.overlap_groups(companies, boards)
    links, kind = links.withColumnRenamed("match_basis", "basis"), ["basis", "match_class"]
    members = members.select("group", F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("p"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("p") % 1009).alias("rest"))
    sums = links.join(sizes, "group").groupBy(*kind).agg(F.sum("n").alias("matches"), F.count_distinct("company_id").alias("companies"), F.sum(F.col("company_id") * F.col("rest")).alias("checksum"))
    met = links.select("group", *kind).distinct().join(members, "group").groupBy(*kind).agg(F.count_distinct("p").alias("boards"))
    return sums.join(met, kind).select(*kind, "matches", "companies", "boards", "checksum")


@query("""with m as (select l_partkey % 151 as portal_id, l_suppkey, 'f' || (l_suppkey % 3) as family from lineitem where l_returnflag = 'R' and l_shipdate < timestamp '1998-01-01'), a as (select portal_id, count(distinct l_suppkey) as n, count(distinct family) as families from m group by 1)
select s_suppkey as id, coalesce(n, 0) as cluster_count, coalesce(families, 0) as families, n is not null as active_in_registry, case when n is null then 'RETIRED' else 'HEALTHY' end as health_state, coalesce(families > 1, false) as metadata_conflict from supplier left join a on portal_id = s_suppkey""")
def a14_portal_refresh(s: Source) -> DataFrame:
    none = F.array().cast("array<string>")
    portals = s.supplier.select(F.col("s_suppkey").alias("id"), F.lit(0).cast("long").alias("cluster_count"), none.alias("ats_families"), F.lit(False).alias("metadata_conflict"), F.lit(True).alias("active_in_registry"), F.lit("HEALTHY").alias("health_state"))
    m = s.lineitem.where("l_returnflag = 'R' and l_shipdate < timestamp'1998-01-01'").select((F.col("l_partkey") % 151).alias("portal_id"), F.col("l_suppkey").alias("corporate_cluster_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 3).alias("ats_family"), F.lit("x").alias("ats_confidence"))
    return resolve.refresh_portals(portals, m).select("id", "cluster_count", F.size("ats_families").cast("long").alias("families"), "active_in_registry", "health_state", "metadata_conflict")


# --- lifecycle -------------------------------------------------------------------------------------------

#: One run, 20 January, over what was seen before: by portal it fails, ends early, or completes, some of it empty.
RUN = """e as (select user_id as portal_id, 's' || user_id || '|' || event_type as key, event_type, event_id, ts, cast(ts as date) as day, 'h' || (event_id % 2) as hash from events),
old as (select portal_id, key, arg_max(hash, event_id) as hash, max(event_id) % 2 as missing, portal_id % 5 > 0 as is_active from e where day < date '2024-01-20' group by 1, 2),
res as (select portal_id, case when portal_id % 7 = 0 then 'FAILED' else 'SUCCESS' end as status, portal_id % 4 > 0 as complete, count(*) filter (where day = date '2024-01-20' and portal_id % 6 > 0) as jobs from e group by 1),
seen as (select key, portal_id, arg_min(hash, event_id) as hash from e join res using (portal_id) where day = date '2024-01-20' and portal_id % 6 > 0 and status = 'SUCCESS' group by 1, 2),
st as (select coalesce(o.key, s.key) as key, coalesce(o.portal_id, s.portal_id) as portal_id, s.key is not null as seen, s.key is not null or o.is_active as is_active, case when s.key is not null then 0 else o.missing end as missing,
    case when s.key is not null and (o.key is null or o.hash <> s.hash) then 'PENDING_AI' when o.key is not null then 'CYBER' end as ai_status from old o full join seen s on s.key = o.key),
act as (select portal_id, count(*) filter (where is_active) as active from st group by 1),
por as (select r.portal_id, status = 'SUCCESS' and complete as good, status = 'SUCCESS' and complete and jobs = 0 and coalesce(active, 0) > 0 as anomaly, r.portal_id % 2 as before from res r left join act a on a.portal_id = r.portal_id),
aft as (select st.*, is_active and not seen and good and (not anomaly or before + 1 >= 2) as missed from st join por using (portal_id))"""


def run(s: Source) -> lifecycle.Step:
    day = F.lit("2024-01-20").cast("date")
    portal = F.col("user_id")
    e = s.events.select(portal.alias("portal_id"), F.concat(F.lit("s"), portal).alias("source"), F.col("event_type").alias("source_job_id"), F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").alias("at"), F.to_date("ts").alias("day"), F.concat(F.lit("h"), F.col("event_id") % 2).alias("payload_sha256"))
    old = e.where(F.col("day") < day).groupBy("source", "source_job_id").agg(F.first("portal_id").alias("portal_id"), F.max_by("payload_sha256", "ordinal").alias("payload_sha256"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), (F.max("ordinal") % 2).cast("int").alias("missing"))
    active = F.col("portal_id") % 5 > 0
    state = old.withColumns({"is_active": active, "closed_at": F.when(~active, F.col("last_seen_at")), "ai_status": F.lit("CYBER")}).select("source", "source_job_id", "portal_id", "payload_sha256", "first_seen_at", "last_seen_at", "is_active", "missing", "closed_at", "ai_status")
    p = F.col("portal_id")
    jobs = e.where((F.col("day") == day) & (p % 6 > 0)).drop("day")
    told = e.groupBy("portal_id").agg(F.count_if((F.col("day") == day) & (F.col("portal_id") % 6 > 0)).alias("jobs"))
    results = told.select("portal_id", F.when(p % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), (p % 4 > 0).alias("complete"), "jobs", F.lit("2024-01-20 23:00:00").cast("timestamp").alias("finished_at"))
    portals = told.select(p.alias("id"), (p % 2).cast("int").alias("empty_scans"), F.lit("HEALTHY").alias("health"))
    return lifecycle.process_run(state, portals, results, jobs)


@query(f"with {RUN} select key, portal_id, is_active and not (missed and missing + 1 >= 2) as is_active, missing + case when missed then 1 else 0 end as missing, case when missed and missing + 1 >= 2 then '2024-01-20 23:00:00' end as closed_now, ai_status from aft")
def t1_t4_one_run(s: Source) -> DataFrame:
    """New, changed, reopened, missed and closed sources of one run."""
    closed = F.when(F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss") == "2024-01-20 23:00:00", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss"))
    return run(s).sources.select(F.concat_ws("|", "source", "source_job_id").alias("key"), "portal_id", "is_active", "missing", closed.alias("closed_now"), "ai_status")


@query(f"with {RUN} select portal_id as id, case when not good then before when anomaly then before + 1 else 0 end as empty_scans, case when anomaly then 'DEGRADED' else 'HEALTHY' end as health from por")
def t3_portals_of_one_run(s: Source) -> DataFrame:
    return run(s).portals


@query(f"with {RUN} select (select count(*) from aft where missed and missing + 1 >= 2) as closed_sources, (select count(*) from por where anomaly) as empty_anomalies")
def t3_counts_of_one_run(s: Source) -> DataFrame:
    return run(s).counts


@query("""with a as (select user_id, event_type, arg_max(event_id % 2, event_id) as h from events where ts < timestamp '2024-01-15' group by 1, 2)
select e.event_id, a.h is null or a.h <> e.event_id % 2 as payload_changed from events e left join a on a.user_id = e.user_id and a.event_type = e.event_type where e.ts >= timestamp '2024-01-15'""")
def t5_change_flags(s: Source) -> DataFrame:
    keyed = s.events.select("event_id", F.col("user_id").alias("source"), F.col("event_type").alias("source_job_id"), (F.col("event_id") % 2).cast("string").alias("payload_sha256"), "ts")
    before = keyed.where("ts < timestamp_ntz'2024-01-15'").groupBy("source", "source_job_id").agg(F.max_by("payload_sha256", "event_id").alias("payload_sha256"))
    return lifecycle.observe(before, keyed.where("ts >= timestamp_ntz'2024-01-15'"), ["source", "source_job_id"]).select("event_id", "payload_changed")


@query("""with old as (select o_custkey, o_orderkey, o_orderkey % 3 as missing, o_orderkey % 4 > 0 as is_active from orders) select o_orderkey, case when o_custkey % 2 = 0 then 0 else missing end as missing, o_custkey % 2 = 0 or is_active as is_active, o_custkey % 2 = 0 or is_active as open from old""")
def t4_reopened(s: Source) -> DataFrame:
    k = F.col("o_orderkey")
    rows = s.orders.select("o_orderkey", (k % 3).cast("int").alias("missing"), (k % 4 > 0).alias("is_active"), F.when(k % 4 == 0, F.col("o_orderdate").cast("timestamp")).alias("closed_at"), (F.col("o_custkey") % 2 == 0).alias("seen"))
    return lifecycle.reopen(rows, F.col("seen")).select("o_orderkey", "missing", "is_active", F.col("closed_at").isNull().alias("open"))


#: Orders before 1999 are the first run, the others the second; every third order comes again in it.
WAVES = """j as (select o_orderkey as k, o_custkey % 60 as c, case when o_orderkey % 5 = 0 then 'Sales lead' else 'Security analyst ' || (o_orderkey % 23) end as title, 'Loc ' || (o_orderkey % 4) as place, o_orderdate < timestamp '1999-01-01' as early, o_orderkey % 3 = 0 as again from orders),
k as (select *, title not like 'Sales%' as wanted, min(case when title not like 'Sales%' then case when early then k else k + 1000000000 end end) over (partition by c, title, place) as leader from j)"""


def two_runs(s: Source) -> ingest.Ingested:
    """Two runs without portals: companies resolve by name, jobs merge by company, title and place."""
    k = F.col("o_orderkey")
    jobs = s.orders.select(
        k.alias("ordinal"), F.lit(None).cast("long").alias("portal_id"), F.lit("src").alias("source"), k.cast("string").alias("source_job_id"), F.lit("").alias("apply_url"), F.when(k % 5 == 0, "Sales lead").otherwise(F.concat(F.lit("Security Analyst  "), k % 23)).alias("title"),
        F.concat(F.lit("FIRM "), F.col("o_custkey") % 60).alias("raw_company"), F.concat(F.lit("Loc "), k % 4).alias("location"), F.lit("DE").alias("country"), F.lit("").alias("description"), F.lit("trainee").alias("employment_type"), F.lit("").alias("workplace_type"),
        F.lit("").alias("ats_job_id"), F.lit("").alias("requisition_id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderdate") < "1999-01-01").alias("early"),
    )
    none = F.array().cast("array<string>")
    firms = s.orders.select((F.col("o_custkey") % 60).alias("c")).distinct().where("c % 2 = 0").select(F.concat(F.lit("c"), "c").alias("corporate_cluster_id"), F.concat(F.lit("Firm "), "c").alias("representative"), none.alias("canonical_employers"), none.alias("parent_groups"))
    empty = lambda schema: s.spark.createDataFrame([], schema)
    mappings, aliases = empty("corporate_cluster_id string, portal_id long, parent_override string"), empty("normalized_alias string, corporate_cluster_id string, status string")
    rules = ({"categories": {"security": ["security analyst"]}}, {"include_terms": ["trainee"]}, {"target_countries": ["DE"]})
    first = ingest.ingest_run(jobs.where("early").drop("early"), empty(ingest.SOURCES), empty(ingest.CANONICAL), firms, mappings, aliases, rules, 1)
    late = jobs.where(~F.col("early") | (F.col("ordinal") % 3 == 0)).withColumn("description", F.when(F.col("early") & (F.col("ordinal") % 2 == 0), "changed").otherwise("")).withColumn("at", F.lit("2005-01-01").cast("timestamp")).drop("early")
    return ingest.ingest_run(late, first.sources, first.canonical, firms, mappings, aliases, rules, 2, 1)


@query(f"""with {WAVES} select k as source_job_id, case when wanted then 'INCLUDE' else 'EXCLUDE' end as filter_status, case when c % 2 = 0 then 'c' || c else 'EXTERNAL:src:firm ' || c end as corporate_cluster_id, case when wanted then leader % 1000000000 end as leader, case when early and not again then 1 else 2 end as last_run from k""")
def t1_ingest_sources(s: Source) -> DataFrame:
    out = two_runs(s).sources
    key = F.col("source_job_id").cast("long")
    leader = F.substring("canonical_job_id", 1, 100)
    first = s.orders.select(hashing.canonical_id(hashing.source_key(F.lit("src"), F.col("o_orderkey").cast("string"))).alias("canonical_job_id"), F.col("o_orderkey").alias("leader"))
    run = F.when(F.col("last_seen_at") == "2005-01-01", 2).otherwise(1)
    return out.withColumn("canonical_job_id", leader).join(first, "canonical_job_id", "left").select(key.alias("source_job_id"), "filter_status", "corporate_cluster_id", "leader", run.alias("last_run"))


@query(f"with {WAVES} select k as source_job_id, case when early then k % 2 = 0 else true end as payload_changed, case when not wanted then '' when early then 'source_job_id' when leader < 1000000000 or leader <> k + 1000000000 then 'normalized_fingerprint' else '' end as dedup_method from k where not early or again")
def t1_ingest_observations(s: Source) -> DataFrame:
    return two_runs(s).observations.select(F.col("source_job_id").cast("long").alias("source_job_id"), "payload_changed", "dedup_method")


# --- hashes and selections -------------------------------------------------------------------------------


@query(""" select id, sha256(cast(json_object('city', null, 'company', coalesce(nullif(resolved_company_name, ''), raw_company), 'country', null, 'description', coalesce(nullif(detail_description, ''), raw_description), 'employment_type', null,
        'location', coalesce(nullif(detail_location, ''), raw_location), 'source_url', coalesce(nullif(detail_url, ''), source_url), 'title', coalesce(nullif(detail_title, ''), raw_title), 'workplace_type', null) as varchar)) as analysis_hash,
    sha256(cast(json_object('company', coalesce(nullif(resolved_company_name, ''), raw_company, ''), 'description_snippet', left(coalesce(nullif(detail_description, ''), raw_description, ''), 1600), 'job_id', id,
        'location', coalesce(nullif(detail_location, ''), raw_location, ''), 'metadata', 'k=' || portal_id, 'title', coalesce(nullif(detail_title, ''), raw_title)) as varchar)) as triage_hash from source_jobs""", state=True)
def n26_input_hashes(s: Source) -> DataFrame:
    jobs = s["source_jobs"]
    return jobs.select("id", hashing.analysis_hash(jobs.columns).alias("analysis_hash"), hashing.triage_hash(jobs.columns, F.concat(F.lit("k="), "portal_id")).alias("triage_hash"))


@query("""select s_suppkey, sha256(cast(json_object('s_name', s_name, 's_nationkey', s_nationkey) as varchar)) as metadata_hash, sha256(cast(json_object('s_acctbal', cast(s_suppkey % 7 as int)) as varchar)) as description_hash, sha256(cast(json_object('s_name', s_name) as varchar)) as semantic_hash from supplier""")
def n25_change_hashes(s: Source) -> DataFrame:
    rows = s.supplier.withColumn("s_acctbal", (F.col("s_suppkey") % 7).cast("int"))
    return rows.select("s_suppkey", *[h.alias(k) for k, h in hashing.change_hashes(["s_nationkey", "s_name"], ["s_acctbal"], ["s_name"]).items()])


@query(""", f as (select *, 'h' || (portal_id % 9) || '.example.com' as host, case ai_status when 'NEEDS_MORE_DETAIL' then 1 when 'PENDING_AI' then 2 end as priority from source_jobs),
c as (select *, row_number() over (partition by host order by priority, id) as place from f where is_active and adapter in ('a0', 'a2') and priority is not null and length(trim(coalesce(raw_description, ''))) < 10 and host in ('h1.example.com', 'h2.example.com', 'h4.example.com', 'h7.example.com'))
select id, host as detail_host from c where place <= 2 order by priority, id limit 5""", state=True)
def f13_detail_candidates(s: Source) -> DataFrame:
    jobs = s["source_jobs"].withColumn("source_url", F.concat(F.lit("https://H"), F.col("portal_id") % 9, F.lit(".example.com/x")))
    hosts = [f"h{i}.example.com" for i in (1, 2, 4, 7)]
    return predicates.detail_candidates(jobs, ["a0", "a2"], ["NEEDS_MORE_DETAIL", "PENDING_AI"], hosts, short=10).select("id", "detail_host")


#: Titles, descriptions and employment types that reach each rule of the topic classifier.
TOPIC = {
    "categories": {"appsec": ["application security", "secure code"], "soc": ["soc analyst", "security"]}, "always_excluded_title_functions": ["sales"], "negative_title_phrases": ["social security", "job security"],
    "negative_override_terms": ["cyber"], "generic_title_exclusions": ["assistant"], "description_only_title_exclusions": ["recruiter"], "description_only_title_markers": ["trainee"],
    "contextual_terms": [{"term": "risk", "category": "context", "context_markers": ["audit", "grc"]}],
}
TITLES = ("Security Sales", "Social Security Clerk", "Cyber Social Security Lead", "SOC-Analyst", "Application Security Engineer", "Office Assistant", "Recruiter", "IT Trainee", "Developer", "Risk Trainee")
BODIES = ("", "We do Secure  Code daily", "audit of the whole group", "nothing here")


@query(f"""with j as (select o_orderkey, ({list(TITLES)})[cast(o_orderkey % 10 as int) + 1] as t, ({list(BODIES)})[cast(o_custkey % 4 as int) + 1] as b, case when o_custkey % 3 = 0 then 'Trainee' else 'Full time' end as e from orders),
n as (select *, contains(b, 'Secure') as body, t in ('IT Trainee', 'Risk Trainee') or e = 'Trainee' as early from j)
select o_orderkey, case when t in ('Security Sales', 'Social Security Clerk') then 'EXCLUDE' when t in ('Cyber Social Security Lead', 'SOC-Analyst', 'Application Security Engineer') then 'INCLUDE' when t in ('Office Assistant', 'Recruiter') then 'EXCLUDE'
    when body and early then 'INCLUDE' when body then 'EXCLUDE' when t = 'Risk Trainee' and contains(b, 'audit') then 'INCLUDE' else 'EXCLUDE' end as status,
    case when t in ('Security Sales', 'Social Security Clerk') then null when t in ('Cyber Social Security Lead', 'SOC-Analyst') then 'soc' when t = 'Application Security Engineer' then 'appsec' when t in ('Office Assistant', 'Recruiter') then null
    when body and early then 'appsec' when body then null when t = 'Risk Trainee' and contains(b, 'audit') then 'context' end as category,
    case when t = 'Security Sales' then 'sales' when t = 'Social Security Clerk' then 'social security' when t = 'Cyber Social Security Lead' then 'security' when t = 'SOC-Analyst' then 'soc analyst' when t = 'Application Security Engineer' then 'application security'
    when t = 'Office Assistant' then 'assistant' when t = 'Recruiter' then 'recruiter' when body then 'secure code' when t = 'Risk Trainee' and contains(b, 'audit') then 'risk' else '' end as terms from n""")
def f4_topic_rules(s: Source) -> DataFrame:
    of = lambda xs, key: F.get(F.array(*map(F.lit, xs)), (F.col(key) % len(xs)).cast("int"))
    employment = F.when(F.col("o_custkey") % 3 == 0, "Trainee").otherwise("Full time")
    rows = s.orders.withColumn("c", classify.topic(TOPIC, of(TITLES, "o_orderkey"), of(BODIES, "o_custkey"), employment))
    return rows.select("o_orderkey", "c.status", "c.category", F.array_join("c.matched_terms", ",").alias("terms"))


# --- registry files --------------------------------------------------------------------------------------


def master_rows(s: Source, broken: bool) -> DataFrame:
    """Customers as master rows; each kind of fault on keys of its own, if asked for."""
    k = F.col("c_custkey")
    wave = k % 2 == 0
    url = F.concat(F.lit("https://jobs"), k % 40, F.lit(".example.com/list/"))
    of = {
        "Record ID": F.concat(F.lit("r"), F.when((k % 17 == 1) & F.lit(broken), k - 1).otherwise(k)), "Employer": F.col("c_name"), "Canonical Employer": F.col("c_name"),
        "Corporate Cluster ID": F.when((k % 19 == 2) & F.lit(broken), " ").otherwise(F.concat(F.lit("c"), k - k % 3)), "Canonical Name Occurrences": F.when((k % 23 == 3) & F.lit(broken), "many").otherwise("1"), "Career Scan Eligible": F.when(k % 5 == 0, "Yes").otherwise("No"),
        "Sector": F.col("c_mktsegment"), "Resolved Corporate Website": F.when(wave, "https://w.example.com"), "Resolved Careers Landing URL": F.when(wave, "https://w.example.com/c"), "Resolved Jobs Search URL": F.when(wave | ((k % 29 == 5) & F.lit(broken)), url),
        "ATS Family": F.when(wave & ~((k % 31 == 4) & F.lit(broken)), F.concat(F.lit("f"), k % 3)), "ATS Confidence": F.when(wave, "HIGH"), "Portal Resolution Status": F.when(wave, F.when((k % 37 == 6) & F.lit(broken), "GUESSED").otherwise("VERIFIED_LIVE")),
        "Portal Verification URL": F.when(wave, url), "Portal Verified Date": F.when(wave, F.when((k % 41 == 8) & F.lit(broken), "soon").otherwise("2024-02-29")), "Resolution Wave": F.when(wave, "W1"),
    }
    return s.customer.select(*[F.coalesce(of.get(c, F.lit("")), F.lit("")).cast("string").alias(c) for c in registries.MASTER])


@query("""with r as (select c_custkey as k, c_custkey % 2 = 0 as wave, 'r' || case when c_custkey % 17 = 1 then c_custkey - 1 else c_custkey end as id from customer), n as (select *, count(*) over (partition by id) as n from r)
select k % 2 = 0 as wave, concat_ws(', ', case when k % 19 = 2 then 'cluster' end, case when wave and k % 31 = 4 then 'resolved fields' end, case when wave and k % 37 = 6 then 'verified status' end, case when not wave and k % 29 = 5 then 'unresolved URL' end,
    case when wave and k % 41 = 8 then 'verified date' end, case when k % 23 = 3 then 'occurrences' end, case when n > 1 then 'repeated key' end) as problems, count(*) as rows from n group by 1, 2""")
def s22_master_problems(s: Source) -> DataFrame:
    held = checked(master_rows(s, True), registries.master())
    return held.groupBy((F.col("Resolution Wave") != "").alias("wave"), F.array_join("problems", ", ").alias("problems")).agg(F.count("*").alias("rows"))


@query("""with r as (select *, c_custkey % 2 = 0 as wave, c_custkey - c_custkey % 3 as c from customer) select count(*) as master_rows, count(*) as unique_record_ids, count(distinct c) as corporate_clusters, count(*) filter (where wave) as resolved_rows, count(distinct c) filter (where wave) as resolved_clusters,
    count(distinct c_custkey % 40) filter (where wave) as unique_resolved_jobs_urls, count(distinct c * 1000 + c_custkey % 40) filter (where wave) as cluster_portal_mappings from r""")
def t15_master_import(s: Source) -> DataFrame:
    tables = registries.import_master(master_rows(s, False), s.spark.createDataFrame([], "kind string, source_sha256 string"), "a" * 64)
    return registries.table_metrics(tables)


def operational_rows(s: Source) -> DataFrame:
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://ops"), k, F.lit(".example.com"))
    of = {
        "employer_name": F.when(k % 13 == 1, " ").otherwise(F.concat(F.lit("Firm "), F.floor(k / 4).cast("long"))), "cohort": F.when(k % 17 == 2, "OTHER").otherwise("CORE_200"), "source_key": F.concat(F.lit("k"), k % 3), "canonical_careers_url": F.when(k % 19 == 3, "").otherwise(url),
        "operational_url": F.when(k % 5 == 4, "").when(k % 23 == 5, "ftp://x").otherwise(url), "ats_family": F.when(k % 7 == 0, "Taleo").when(k % 29 == 6, "Oracel").otherwise("Lever"), "evidence_state": F.when(k % 3 == 0, "PROBABLE").otherwise("TECHNICALLY_VERIFIED"),
        "resolution_path": F.lit("HOLD"), "adapter_supported": F.when(k % 31 == 7, "perhaps").otherwise("yes"), "catalog_state": F.when(k % 37 == 8, "").otherwise("UNTESTED"), "last_verified_at": F.when(k % 41 == 9, "2024-13-01").otherwise(""),
        "routing_override": F.when(k % 11 == 0, "hold").when(k % 11 == 1, "PROBE").when(k % 11 == 2, "ADAPTER_NEEDED").otherwise(""), "routing_override_rationale": F.when(k % 11 < 2, "because").otherwise(""),
    }
    return s.supplier.select(*[of.get(c, F.lit("")).cast("string").alias(c) for c in registries.OPERATIONAL])


@query("""select concat_ws(', ', case when k % 13 = 1 then 'employer' end, case when k % 17 = 2 then 'cohort' end, case when k % 11 = 1 then 'override' end, case when k % 11 = 2 then 'override rationale' end, case when k % 11 in (1, 2) then 'override and path' end,
    case when k % 37 = 8 then 'catalog state' end, case when k % 19 = 3 and k % 5 <> 4 then 'careers URL' end, case when k % 23 = 5 and k % 5 <> 4 then 'operational URL' end, case when k % 41 = 9 then 'date' end, case when k % 31 = 7 then 'adapter supported' end,
    case when k % 29 = 6 and k % 7 <> 0 then 'family' end) as problems, count(*) as rows from (select s_suppkey as k from supplier) group by 1""")
def s25_operational_problems(s: Source) -> DataFrame:
    held = checked(operational_rows(s), registries.operational_sources())
    return held.groupBy(F.array_join("problems", ", ").alias("problems")).agg(F.count("*").alias("rows"))


@query("""with r as (select s_suppkey as k, case when s_suppkey % 13 = 1 then '' else 'Firm ' || (s_suppkey // 4) end as employer_name, 'k' || (s_suppkey % 3) as source_key, s_suppkey % 5 <> 4 as located,
    case when s_suppkey % 3 = 0 then 'FINGERPRINT_REQUIRED' when s_suppkey % 7 = 0 or s_suppkey % 29 = 6 or s_suppkey % 31 = 7 then 'ADAPTER_NEEDED' else 'READY_TO_PROBE' end as queue from supplier),
e as (select employer_name, bool_or(queue = 'READY_TO_PROBE') as a, bool_or(queue = 'FINGERPRINT_REQUIRED') as b, bool_or(queue = 'ADAPTER_NEEDED') as c from r where located group by 1)
select employer_name, 'repeated source key ' || source_key as problem from r group by employer_name, source_key having count(*) > 1 union all select employer_name, 'READY_TO_PROBE and FINGERPRINT_REQUIRED' from e where a and b union all select employer_name, 'READY_TO_PROBE and ADAPTER_NEEDED' from e where a and c""")
def s25_employer_problems(s: Source) -> DataFrame:
    return registries.employer_problems(operational_rows(s))


CANDIDATES = """r as (select c_custkey as k, 'c' || (c_custkey % 50) as company, case when c_custkey % 9 = 0 then '' else 'p' end as provider, case c_custkey % 4 when 0 then 'lever' when 1 then 'eightfold' when 2 then 'taleo' else 'greenhouse' end as family,
    'https://b' || (c_custkey % 30) || '.example.com/x' as url, 's' || (c_custkey % 30) as slug, c_custkey % 6 > 0 as high from customer), w as (select * from r where high and provider <> ''), d as (select * from (select *, row_number() over (partition by company, family, url, slug order by k) as n from w) where n = 1),
f as (select d.* from d left join (select distinct 'c' || (s_suppkey % 50) as company, 'https://b' || (s_suppkey % 30) || '.example.com/x' as url, 's' || (s_suppkey % 30) as slug from supplier) s on s.company = d.company and s.url = d.url and s.slug = d.slug and d.family = 'lever' where s.company is null)"""


def candidate_import(s: Source) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    family = F.get(F.array(*map(F.lit, ("Lever", "Eightfold", "Taleo", "Greenhouse"))), (k % 4).cast("int"))
    rows = s.customer.select(
        F.concat(F.lit(" c"), k % 50).alias(" Internal_Company_ID"), F.when(k % 9 == 0, "").otherwise("p").alias("external_provider"), family.alias("External_ATS_Family"), F.concat(F.lit("'www.b"), k % 30, F.lit(".example.com/x/'")).alias("external_url"),
        F.concat(F.lit("s"), k % 30).alias("external_slug / tenant id"), F.when(k % 6 > 0, "HIGH_CONFIDENCE").otherwise("CANDIDATE").alias("match_class"), F.lit("SLUG").alias("match_basis"), k.alias("ordinal"),
    )
    n = F.col("s_suppkey")
    stored = s.supplier.select(F.concat(F.lit("c"), n % 50).alias("internal_company_id"), F.lit("p").alias("provider"), F.lit("lever").alias("ats_family"), F.concat(F.lit("https://b"), n % 30, F.lit(".example.com/x")).alias("url"), F.concat(F.lit("s"), n % 30).alias("slug"))
    return registries.import_candidates(rows, stored)


@query(f"with {CANDIDATES} select company as internal_company_id, family as ats_family, url, slug, case family when 'taleo' then 'UNSUPPORTED' when 'eightfold' then 'DECLARATIVE_SUPPORTED' else 'LEGACY_SUPPORTED' end as support_class, false as verified from f")
def t19_candidate_import(s: Source) -> DataFrame:
    return candidate_import(s)[0].select("internal_company_id", "ats_family", "url", "slug", "support_class", "verified")


@query(f"""with {CANDIDATES}, g as (select company, count(distinct family) as n from f group by 1) select (select count(*) from r) as input_rows, (select count(*) from r where high) as valid_high_rows, (select count(*) from r where not high or provider = '') as skipped_rows,
    (select count(*) from f) as inserted_rows, (select count(*) from g) as companies_affected, (select count(*) from g where n > 1) as multi_source_companies, (select count(*) from w) - (select count(*) from f) as duplicate_rows""")
def t19_candidate_counts(s: Source) -> DataFrame:
    return candidate_import(s)[1]


# --- facet subdivision -----------------------------------------------------------------------------------


@query("""with p as (select s_suppkey as portal_id, s_suppkey % 4 as kind from supplier), v as (select unnest(['x', 'y']) as a), c as (select portal_id, 'timeType=' || a as path, a, kind from p, v where kind > 0), g as (select portal_id, 'locations=' || l || '&timeType=x' as path from (select * from c where kind = 2 and a = 'x'), (select unnest(['m', 'n']) as l) t)
select portal_id, '' as path, 0 as level, case when kind = 0 then 50 else 2000 end as total, case when kind > 0 then 'timeType' end as dimension, case when kind = 0 then 'LEAF' else 'EXPANDED' end as state from p
union all select portal_id, path, 1, case when kind = 3 and a = 'y' then null when kind > 1 and a = 'x' then 2000 else 7 end, case when kind = 2 and a = 'x' then 'locations' end, case when kind = 3 and a = 'y' then 'MISSING' when kind = 2 and a = 'x' then 'EXPANDED' when kind = 3 and a = 'x' then 'UNRESOLVED' else 'LEAF' end from c
union all select portal_id, path, 2, 9, null, 'LEAF' from g""")
def s9_subdivision(s: Source) -> DataFrame:
    """Catalogs that are small, divide once, divide twice, or stay capped and lack an answer."""
    p = F.col("s_suppkey")
    facet = lambda name, *ids: f'{{"facetParameter": "{name}", "values": [' + ", ".join(f'{{"id": "{i}", "count": 3}}' for i in ids) + "]}"
    body = lambda total, *facets: F.lit(f'{{"total": {total}, "facets": [' + ", ".join(facets) + '], "jobPostings": []}')
    places, times, single = facet("locations", "m", "n"), facet("timeType", "x", "y"), facet("jobFamilyGroup", "only")
    kinds = [
        ([], p % 4 == 0, body(50, times)), ([], p % 4 > 0, body(2000, places, times, single)),
        (["timeType=x"], p % 4 == 1, body(7)), (["timeType=x"], p % 4 == 2, body(2000, times, places)), (["timeType=x"], p % 4 == 3, body(2000, times, single)),
        (["timeType=y"], p % 4 > 0, body(7)), (["timeType=x", "locations=m"], p % 4 == 2, body(9)), (["timeType=x", "locations=n"], p % 4 == 2, body(9)),
    ]
    out = None
    for i, (applied, test, text) in enumerate(kinds):
        test = test & (p % 4 != 3) if applied == ["timeType=y"] else test
        one = s.supplier.where(test).select((p * 10 + i).alias("payload_id"), p.alias("portal_id"), F.lit("https://w.example.com").alias("url"), text.alias("body"), F.array(*map(F.lit, applied)).cast("array<string>").alias("applied"))
        out = one if out is None else out.unionByName(one)
    return parsers.subdivision(out).select("portal_id", F.array_join("applied", "&").alias("path"), "level", "total", "dimension", "state")
