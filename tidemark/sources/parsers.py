"""Landed vendor payloads to one record shape.

Every parser takes rows (payload_id, portal_id, url, body) and returns RAW rows with an ordinal that keeps the
order of the payload.  A row that lacks what it needs, or a payload that can't be read, is returned with
``problem`` set and never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import urls
from ..functions.text import collapse, html_to_text, strip_tags, unescape
from ..functions.values import epoch_ms, iso_time
from ..operators.windows import keep_first

FIELDS = ("source_job_id", "source_url", "apply_url", "title", "company", "location", "country", "city", "description", "posted_at", "employment_type", "workplace_type", "ats_job_id", "requisition_id")


def text_at(v: Column | str, path: str) -> Column:
    """A trimmed string by its path; null for blanks and for other types."""
    value = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    return F.nullif(F.trim(value), F.lit(""))


def any_at(v: Column | str, path: str) -> Column:
    """A scalar of any type as a trimmed string."""
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def items_at(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def first(*values: Column) -> Column:
    return F.coalesce(*values)


def raw_rows(payloads: DataFrame, source: str, items: Callable[[Column], Column], fields: dict[str, Column], required: tuple[str, ...], keep: Column | None = None) -> DataFrame:
    """Explode a payload's items and project ``fields``, expressions over the variant column ``j``."""
    rows = payloads.withColumn("_v", F.try_parse_json("body")).withColumn("_items", items(F.col("_v")))
    broken = rows.where("_items is null").select("payload_id", "portal_id", "url", F.lit(0).alias("ordinal"), F.lit(None).cast("variant").alias("j"), F.lit("payload has no list of items").alias("problem"))
    each = rows.where("_items is not null").select("payload_id", "portal_id", "url", F.posexplode("_items").alias("ordinal", "j"), F.lit(None).cast("string").alias("problem"))
    each = each.where(keep) if keep is not None else each
    out = each.unionByName(broken)
    columns = {f: fields.get(f, F.lit(None)) for f in FIELDS}
    out = out.select("payload_id", "portal_id", "url", "ordinal", "j", F.lit(source).alias("source"), *[c.cast("timestamp" if f == "posted_at" else "string").alias(f) for f, c in columns.items()], "problem")
    lacks = F.array_join(F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]), lambda x: x.isNotNull()), ", ")
    return out.withColumn("problem", F.coalesce("problem", F.when(lacks != "", F.concat(F.lit("lacks "), lacks)))).withColumn("raw_payload", F.to_json("j")).drop("j")


#: The variant column of an exploded item.
J = "j"


def greenhouse(payloads: DataFrame) -> DataFrame:
    number = any_at(J, "$.requisition_id")
    real = F.when(~F.lower(number).isin("n/a", "na", "none", "tbd", "-", "0"), number)
    url = text_at(J, "$.absolute_url")
    fields = {
        "source_job_id": any_at(J, "$.id"), "source_url": url, "apply_url": url, "title": text_at(J, "$.title"), "location": text_at(J, "$.location.name"),
        "description": unescape(text_at(J, "$.content")), "posted_at": first(iso_time(text_at(J, "$.first_published")), iso_time(text_at(J, "$.updated_at"))),
        "ats_job_id": any_at(J, "$.id"), "requisition_id": real,
    }
    return raw_rows(payloads, "greenhouse", lambda v: items_at(v, "$.jobs"), fields, ("source_job_id", "title", "source_url"))


def lever(payloads: DataFrame) -> DataFrame:
    many = items_at(J, "$.categories.allLocations")
    places = F.array_join(F.filter(F.transform(many, lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    lists = F.coalesce(items_at(J, "$.lists"), F.array().cast("array<variant>"))
    section = lambda s: F.when(text_at(s, "$.content").isNotNull(), F.concat_ws("\n", text_at(s, "$.text"), text_at(s, "$.content")))
    parts = F.filter(F.concat(F.array(text_at(J, "$.description")), F.transform(lists, section)), lambda x: x.isNotNull())
    # The first of the sections that read alike stays.
    texts = F.transform(parts, html_to_text)
    kept = F.filter(parts, lambda p, i: (html_to_text(p) != "") & (F.array_position(texts, html_to_text(p)) == i + 1))
    fields = {
        "source_job_id": text_at(J, "$.id"), "source_url": text_at(J, "$.hostedUrl"), "apply_url": first(text_at(J, "$.applyUrl"), text_at(J, "$.hostedUrl")), "title": text_at(J, "$.text"),
        "location": F.when(many.isNotNull(), places).otherwise(text_at(J, "$.categories.location")), "country": text_at(J, "$.country"),
        "description": F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")).otherwise(text_at(J, "$.descriptionPlain")), "posted_at": epoch_ms(F.try_variant_get(J, "$.createdAt", "long")),
        "employment_type": text_at(J, "$.categories.commitment"), "workplace_type": text_at(J, "$.workplaceType"), "ats_job_id": text_at(J, "$.id"),
    }
    return raw_rows(payloads, "lever", lambda v: items_at(v, "$"), fields, ("source_job_id", "title", "source_url"))


def ashby(payloads: DataFrame) -> DataFrame:
    url = text_at(J, "$.jobUrl")
    fields = {
        "source_job_id": url, "source_url": url, "apply_url": first(text_at(J, "$.applyUrl"), url), "title": text_at(J, "$.title"), "location": text_at(J, "$.location"),
        "country": text_at(J, "$.address.postalAddress.addressCountry"), "city": text_at(J, "$.address.postalAddress.addressLocality"),
        "description": first(text_at(J, "$.descriptionHtml"), text_at(J, "$.descriptionPlain")), "posted_at": iso_time(text_at(J, "$.publishedAt")),
        "employment_type": text_at(J, "$.employmentType"), "workplace_type": text_at(J, "$.workplaceType"), "ats_job_id": url,
    }
    listed = ~F.coalesce((F.schema_of_variant(F.try_variant_get(J, "$.isListed", "variant")) == "BOOLEAN") & ~F.try_variant_get(J, "$.isListed", "boolean"), F.lit(False))
    return raw_rows(payloads, "ashby", lambda v: items_at(v, "$.jobs"), fields, ("source_job_id", "title"), listed)


def smartrecruiters(payloads: DataFrame) -> DataFrame:
    key = first(text_at(J, "$.id"), text_at(J, "$.uuid"))
    place = F.nullif(F.concat_ws(", ", *[text_at(J, f"$.location.{p}") for p in ("city", "region", "country")]), F.lit(""))
    fields = {
        "source_job_id": key, "source_url": text_at(J, "$.ref"), "apply_url": text_at(J, "$.ref"), "title": text_at(J, "$.name"), "company": text_at(J, "$.company.name"), "location": place,
        "country": text_at(J, "$.location.country"), "city": text_at(J, "$.location.city"), "posted_at": iso_time(text_at(J, "$.releasedDate")),
        "employment_type": first(text_at(J, "$.typeOfEmployment.id"), text_at(J, "$.typeOfEmployment.label")),
        "workplace_type": F.when(F.try_variant_get(J, "$.location.remote", "boolean"), "remote"), "ats_job_id": key,
    }
    return raw_rows(payloads, "smartrecruiters", lambda v: items_at(v, "$.content"), fields, ("source_job_id", "title"))


def teamtailor(payloads: DataFrame) -> DataFrame:
    url = text_at(J, "$.url")
    key = first(F.nullif(F.regexp_extract(url, r"/jobs/(\d+)", 1), F.lit("")), any_at(J, "$.id"), url)
    spot = F.coalesce(F.get(F.filter(items_at(J, "$._jobposting.jobLocation"), lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(0)), F.try_variant_get(J, "$._jobposting.jobLocation", "variant"))
    place = F.concat_ws(", ", text_at(spot, "$.address.addressLocality"), text_at(spot, "$.address.addressRegion"), text_at(spot, "$.address.addressCountry"))
    fields = {
        "source_job_id": key, "source_url": url, "apply_url": url, "title": text_at(J, "$.title"), "location": F.nullif(place, F.lit("")), "description": text_at(J, "$.content_html"),
        "posted_at": first(iso_time(text_at(J, "$.date_published")), iso_time(text_at(J, "$._jobposting.datePosted"))), "employment_type": text_at(J, "$._jobposting.employmentType"), "ats_job_id": key,
    }
    rows = raw_rows(payloads, "teamtailor", lambda v: items_at(v, "$.items"), fields, ("title", "source_url"))
    return keep_first(rows, ["payload_id", "source_job_id"])


def workable(payloads: DataFrame) -> DataFrame:
    """Rows of one shortcode become one, with their places in order."""
    url = first(text_at(J, "$.url"), text_at(J, "$.application_url"))
    place = F.nullif(F.concat_ws(", ", text_at(J, "$.city"), text_at(J, "$.state"), text_at(J, "$.country")), F.lit(""))
    fields = {
        "source_job_id": first(any_at(J, "$.shortcode"), any_at(J, "$.id"), url), "source_url": url, "apply_url": first(text_at(J, "$.application_url"), url), "title": text_at(J, "$.title"),
        "location": place, "description": text_at(J, "$.description"), "posted_at": first(iso_time(text_at(J, "$.published_on")), iso_time(text_at(J, "$.created_at"))),
        "employment_type": text_at(J, "$.type"), "ats_job_id": first(any_at(J, "$.shortcode"), any_at(J, "$.id"), url),
    }
    rows = raw_rows(payloads, "workable", lambda v: items_at(v, "$.jobs"), fields, ("title", "source_url"))
    places = rows.groupBy("payload_id", "source_job_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "location"))), lambda x: x["location"])), " | ").alias("places"))
    name = payloads.select("payload_id", text_at(F.try_parse_json("body"), "$.name").alias("account"))
    out = keep_first(rows, ["payload_id", "source_job_id"]).join(places, ["payload_id", "source_job_id"], "left").join(name, "payload_id", "left")
    return out.withColumns({"location": F.nullif(F.col("places"), F.lit("")), "company": F.col("account")}).drop("places", "account")


#: Shapes of a requisition number among a job's bullets.
REQUISITION = r"^(?:JR|R|J)[-_ ]?\d+|^\d+$"


def workday(payloads: DataFrame) -> DataFrame:
    path = text_at(J, "$.externalPath")
    bullets = F.filter(F.transform(items_at(J, "$.bulletFields"), lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda x: x.rlike(REQUISITION))
    number = F.get(bullets, F.lit(0))
    url = F.concat(F.regexp_replace(F.col("url"), "/+$", ""), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    fields = {
        "source_job_id": first(number, path), "source_url": url, "apply_url": url, "title": text_at(J, "$.title"), "location": text_at(J, "$.locationsText"),
        "employment_type": text_at(J, "$.timeType"), "workplace_type": text_at(J, "$.remoteType"), "ats_job_id": first(number, path), "requisition_id": number,
    }
    return raw_rows(payloads, "workday", lambda v: items_at(v, "$.jobPostings"), fields, ("source_job_id", "title"))


#: A total that this vendor reports where it has at least so many rows.
CAPPED_TOTAL = 2000


def workday_facets(payloads: DataFrame) -> DataFrame:
    """(payload_id, parameter, values, counted, coverage): what a facet dimension can prove about the total."""
    rows = payloads.withColumn("v", F.try_parse_json("body")).select("payload_id", F.try_variant_get("v", "$.total", "long").alias("total"), F.posexplode(items_at(F.col("v"), "$.facets")).alias("ordinal", "f"))
    rows = rows.withColumn("parameter", text_at(F.col("f"), "$.facetParameter")).where("parameter is not null")
    rows = keep_first(rows, ["payload_id", "parameter"])
    values = rows.select("payload_id", "parameter", "total", F.explode_outer(items_at(F.col("f"), "$.values")).alias("x"))
    values = values.select("payload_id", "parameter", "total", text_at(F.col("x"), "$.id").alias("id"), text_at(F.col("x"), "$.facetParameter").alias("sub"), F.try_variant_get("x", "$.count", "long").alias("n"))
    once = values.where("id is not null").dropDuplicates(["payload_id", "parameter", "id"]).unionByName(values.where("id is null"))
    sums = once.groupBy("payload_id", "parameter", "total").agg(F.count("id").alias("values"), F.count(F.when(F.col("id").isNotNull(), F.col("n"))).alias("known"), F.sum(F.when(F.col("id").isNotNull(), F.col("n"))).alias("counted"), F.count("sub").alias("subs"))
    capped = F.col("total") == CAPPED_TOTAL
    coverage = (
        F.when((F.col("values") == 0) & (F.col("subs") > 0), "NESTED")
        .when((F.col("values") == 0) | (F.col("known") < F.col("values")), "UNKNOWN")
        .when(F.col("counted") < F.col("total"), "PARTIAL_COVERAGE")
        .when(capped, "UNKNOWN")
        .when(F.col("counted") > F.col("total"), "OVERLAPPING")
        .otherwise("PARTITION_CANDIDATE")
    )
    return sums.select("payload_id", "parameter", "values", "counted", coverage.alias("coverage"))


#: Dimensions in the order in which they are preferred, and levels of a subdivision (fixed values).
PREFERRED_DIMENSIONS = ("jobFamilyGroup", "timeType", "locations", "workerSubType")
DEPTH = 8


def next_dimension(payloads: DataFrame) -> DataFrame:
    """(payload_id, dimension, ids): the facet to divide a payload by: not applied yet (``applied``: parameter=value
    pairs), with at least two values, preferred ones first and then in the payload's order."""
    rows = payloads.select("payload_id", "applied", F.posexplode(items_at(F.try_parse_json("body"), "$.facets")).alias("ordinal", "f"))
    rows = keep_first(rows.withColumn("dimension", text_at("f", "$.facetParameter")).where("dimension is not null"), ["payload_id", "dimension"])
    ids = F.array_distinct(F.filter(F.transform(items_at("f", "$.values"), lambda x: text_at(x, "$.id")), lambda x: x.isNotNull()))
    preferred = F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED_DIMENSIONS)), F.col("dimension")), F.lit(0))
    fit = rows.withColumns({"ids": ids, "place": F.struct(F.coalesce(preferred, F.lit(99)), "ordinal")}).where((F.size("ids") > 1) & ~F.exists("applied", lambda a: F.substring_index(a, "=", 1) == F.col("dimension")))
    return fit.groupBy("payload_id").agg(F.min_by("dimension", "place").alias("dimension"), F.min_by("ids", "place").alias("ids"))


def subdivision(branches: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The branches that a capped catalog is divided into, over landed answers.

    ``branches`` has payload_id, portal_id, url, body and applied (sorted ``parameter=value`` pairs, empty for the
    root).  Returns payload_id, portal_id, applied, level, total, dimension and state: LEAF, EXPANDED, UNRESOLVED (capped
    with nothing left to divide by, or too deep) or MISSING (no answer landed).  It finds more records but proves nothing:
    a capped catalog is never complete.  Levels are joins of one frontier with the answers; at most ``depth``.
    """
    landed = branches.select("payload_id", "portal_id", F.array_sort("applied").alias("applied"), F.try_variant_get(F.try_parse_json("body"), "$.total", "long").alias("total"), "body")
    wanted = branches.select("portal_id").distinct().withColumn("applied", F.array().cast("array<string>"))
    out = None
    for level in range(depth + 1):
        here = keep_first(wanted.join(landed, ["portal_id", "applied"], "left").withColumn("ordinal", F.col("payload_id")), ["portal_id", "applied"]).drop("ordinal")
        plan = here.join(next_dimension(here.where(F.col("total") == CAPPED_TOTAL)), "payload_id", "left") if level < depth else here.withColumns({"dimension": F.lit(None).cast("string"), "ids": F.array().cast("array<string>")})
        state = F.when(F.col("payload_id").isNull(), "MISSING").when(F.coalesce(F.col("total") != CAPPED_TOTAL, F.lit(True)), "LEAF").when(F.col("dimension").isNotNull(), "EXPANDED").otherwise("UNRESOLVED")
        plan = plan.withColumns({"state": state, "level": F.lit(level)})
        part = plan.select("payload_id", "portal_id", "applied", "level", "total", F.when(F.col("state") == "EXPANDED", F.col("dimension")).alias("dimension"), "state")
        out = part if out is None else out.unionByName(part)
        children = plan.where("state = 'EXPANDED'").select("portal_id", "applied", "dimension", F.explode("ids").alias("value"))
        wanted = children.select("portal_id", F.array_sort(F.array_append("applied", F.concat("dimension", F.lit("="), "value"))).alias("applied")).distinct()
        if wanted.isEmpty():
            break
    return out


def subdivided_jobs(branches: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Records of all branches that a subdivision visits, the first of each id by level and filters."""
    visited = subdivision(branches, depth).where("payload_id is not null").select("payload_id", "level", F.array_join("applied", "&").alias("path"))
    rows = workday(branches.drop("applied")).join(visited, "payload_id")
    place = F.row_number().over(W.partitionBy("portal_id", "source_job_id").orderBy("level", "path", "ordinal"))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "path")


def oracle(payloads: DataFrame) -> DataFrame:
    key = any_at(J, "$.Id")
    url = F.concat(F.regexp_replace(F.col("url"), "/+$", ""), F.lit("/job/"), urls.encoded(key))
    long = F.nullif(F.concat_ws(" ", text_at(J, "$.ExternalResponsibilitiesStr"), text_at(J, "$.ExternalQualificationsStr")), F.lit(""))
    fields = {
        "source_job_id": key, "source_url": url, "apply_url": url, "title": text_at(J, "$.Title"), "location": text_at(J, "$.PrimaryLocation"), "country": text_at(J, "$.PrimaryLocationCountry"),
        "description": first(text_at(J, "$.ShortDescriptionStr"), long), "posted_at": first(iso_time(text_at(J, "$.PostedDate")), iso_time(text_at(J, "$.CreatedOn"))),
        "employment_type": first(*[text_at(J, f"$.{k}") for k in ("WorkerType", "JobType", "ContractType", "JobSchedule")]),
        "workplace_type": first(text_at(J, "$.WorkplaceTypeCode"), text_at(J, "$.WorkplaceType")), "ats_job_id": key, "requisition_id": key,
    }
    return raw_rows(payloads, "oracle", lambda v: items_at(v, "$.items[0].requisitionList"), fields, ("source_job_id", "title"))


def oracle_completeness(pages: DataFrame) -> DataFrame:
    """Per portal (portal_id, received, total): complete if one total was told and as many rows were received."""
    return pages.groupBy("portal_id").agg(F.sum("received").alias("received"), F.max("total").alias("total"), (F.count_distinct("total") == 1).alias("steady")).withColumn("complete", F.col("steady") & (F.col("received") >= F.col("total")))


def phenom(payloads: DataFrame) -> DataFrame:
    """JSON inside the page's script."""
    script = F.regexp_extract("body", r'(?s)"eagerLoadRefineSearch"\s*:\s*(\{.*?"jobs"\s*:\s*\[.*?\]\s*\}\s*\})', 1)
    fields = {
        "source_job_id": first(any_at(J, "$.jobSeqNo"), any_at(J, "$.jobId"), any_at(J, "$.reqId")), "source_url": text_at(J, "$.applyUrl"), "apply_url": text_at(J, "$.applyUrl"), "title": text_at(J, "$.title"),
        "location": first(text_at(J, "$.cityStateCountry"), text_at(J, "$.location")), "country": text_at(J, "$.country"), "city": text_at(J, "$.city"), "description": text_at(J, "$.descriptionTeaser"),
        "posted_at": iso_time(text_at(J, "$.postedDate")), "employment_type": text_at(J, "$.type"), "ats_job_id": any_at(J, "$.jobId"), "requisition_id": any_at(J, "$.reqId"),
    }
    return keep_first(raw_rows(payloads.withColumn("body", script), "phenom", lambda v: items_at(v, "$.data.jobs"), fields, ("source_job_id", "title")), ["payload_id", "source_job_id"])


def positional(payloads: DataFrame) -> DataFrame:
    """Records whose fields are places in a list, behind an anti-hijacking line and a second layer of JSON.

    Places: 0 id, 1 title, 2 apply URL, 3 responsibilities, 4 qualifications, 7 company, 9 locations,
    10 description, 12 created, 13 updated, 19 minimum qualifications.
    """
    at = lambda i: text_at(J, f"$[{i}]")
    body = lambda i: first(at(i), text_at(J, f"$[{i}][1]"))
    sections = F.array(*[F.struct(F.lit(h).alias("h"), body(i).alias("b")) for h, i in (("Description", 10), ("Responsibilities", 3), ("Qualifications", 4), ("Minimum qualifications", 19))])
    known = F.filter(sections, lambda s: s["b"].isNotNull())
    bodies = F.transform(known, lambda s: s["b"])
    once = F.filter(known, lambda s, i: F.array_position(bodies, s["b"]) == i + 1)
    places = items_at(J, "$[9]")
    names = F.array_distinct(F.filter(F.transform(places, lambda p: text_at(p, "$[0]")), lambda x: x.isNotNull()))
    single = F.size(places) == 1
    stamp = lambda i: F.timestamp_seconds(F.try_variant_get(J, f"$[{i}][0]", "double"))
    inner = F.coalesce(F.try_variant_get(F.try_parse_json(F.regexp_replace("body", r"^\)\]\}'[^\n]*\n(?:\d+\n)?", "")), "$[0][2]", "string"), F.regexp_replace("body", r"^\)\]\}'[^\n]*\n", ""))
    url = F.concat(F.regexp_replace(F.col("url"), "/+$", ""), F.lit("/"), at(0))
    fields = {
        "source_job_id": at(0), "source_url": url, "apply_url": first(at(2), url), "title": at(1), "company": at(7), "location": F.array_join(names, "; "),
        "country": F.when(single, text_at(J, "$[9][0][5]")), "city": F.when(single, text_at(J, "$[9][0][2]")),
        "description": F.array_join(F.transform(once, lambda s: F.concat(F.lit("<h2>"), s["h"], F.lit("</h2>"), s["b"])), "\n"), "posted_at": first(stamp(12), stamp(13)), "ats_job_id": at(0),
    }
    return raw_rows(payloads.withColumn("body", inner), "positional", lambda v: items_at(v, "$[0]"), fields, ("source_job_id", "title"))


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute value, '' if it has none."""
    return unescape(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1))


def resolved(base: Column, href: Column) -> Column:
    """An absolute URL of a link on a page."""
    root = F.concat(urls.scheme(base), F.lit("://"), urls.part(base, 2))
    folder = F.regexp_replace(urls.part(base, 3), "[^/]*$", "")
    h = F.trim(href)
    return (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, urls.part(base, 3), h))
        .when((h == "") | h.startswith("#"), base)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), h))
    )


#: Paths of records, and link texts that name none (fixed values).
JOB_PATH = r"(?i)(?:/jobs?/|/job-detail/|/jobdetail/|/positions?/|[?&](?:gh_jid|jobId)=)"
GENERIC_ANCHORS = ("apply", "apply now", "careers", "jobs", "find jobs", "find a job", "job openings", "learn more", "read more", "search jobs", "view job", "view jobs")


def anchors(pages: DataFrame, path: str = JOB_PATH, stoplist: tuple[str, ...] = GENERIC_ANCHORS, url: str = "url", body: str = "body", key: str = "payload_id") -> DataFrame:
    """(key, ordinal, href, absolute_url, canonical_url, title) of links whose path and text look like a record,
    the first of each canonical URL."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"(?is)(<a\b[^>]*>)(.*?)</a>"), F.lit(0))
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(found).alias("ordinal", "_tag"))
    rows = rows.withColumns({"href": F.trim(attribute(F.regexp_extract("_tag", "(?is)^<a[^>]*>", 0), "href")), "title": unescape(strip_tags(F.col("_tag")))})
    rows = rows.withColumn("absolute_url", resolved(F.col("_base"), F.col("href"))).withColumn("canonical_url", urls.canonical_url(F.col("absolute_url")))
    fit = F.col("absolute_url").rlike(path) & F.length("title").between(4, 200) & ~F.lower("title").isin(*stoplist) & (F.col("canonical_url") != "")
    return keep_first(rows.where(fit), [key, "canonical_url"]).drop("_base", "_tag")


def anchor_jobs(pages: DataFrame) -> DataFrame:
    rows = anchors(pages)
    return rows.select("payload_id", "ordinal", F.lit("official_html").alias("source"), F.sha2("canonical_url", 256).alias("source_job_id"), F.col("absolute_url").alias("source_url"), F.col("absolute_url").alias("apply_url"), "title")


def json_ld(pages: DataFrame) -> DataFrame:
    """JobPosting items of JSON-LD scripts, in lists and graphs too, the first of each canonical URL."""
    scripts = F.regexp_extract_all(F.col("body"), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    s = pages.select("payload_id", "portal_id", "url", F.posexplode(scripts).alias("script", "text")).withColumn("v", F.try_parse_json("text")).where("v is not null")
    flat = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    graph = lambda v: F.concat(F.coalesce(F.flatten(F.transform(F.try_variant_get(v, "$['@graph']", "array<variant>"), flat)), F.array().cast("array<variant>")), F.array(v))
    items = s.select("payload_id", "portal_id", "url", "script", F.posexplode(F.flatten(F.transform(flat(F.col("v")), graph))).alias("place", "j"))
    kinds = F.coalesce(F.try_variant_get(J, "$['@type']", "array<string>"), F.array(F.try_variant_get(J, "$['@type']", "string")))
    items = items.where(F.exists(kinds, lambda k: F.lower(k) == "jobposting"))
    spots = F.coalesce(items_at(J, "$.jobLocation"), F.array(F.try_variant_get(J, "$.jobLocation", "variant")))
    part = lambda x, p: text_at(x, f"$.address.{p}")
    shown = F.array_distinct(F.filter(F.transform(spots, lambda x: F.concat_ws(", ", part(x, "addressLocality"), part(x, "addressRegion"), part(x, "addressCountry"))), lambda x: x != ""))
    only = lambda p: F.transform(F.array(F.array_distinct(F.filter(F.transform(spots, lambda x: part(x, p)), lambda x: x.isNotNull()))), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))[0]
    link = resolved(F.col("url"), F.coalesce(text_at(J, "$.url"), text_at(J, "$.sameAs"), F.lit("")))
    key = F.coalesce(text_at(J, "$.identifier.value"), text_at(J, "$.identifier"), urls.canonical_url(link))
    kind = F.coalesce(F.array_join(F.try_variant_get(J, "$.employmentType", "array<string>"), " | "), text_at(J, "$.employmentType"))
    rows = items.select(
        "payload_id", "portal_id", (F.col("script") * 100_000 + F.col("place")).alias("ordinal"), F.lit("official_html").alias("source"), key.alias("source_job_id"), link.alias("source_url"), link.alias("apply_url"),
        text_at(J, "$.title").alias("title"), text_at(J, "$.hiringOrganization.name").alias("company"), F.array_join(shown, " | ").alias("location"), only("addressCountry").alias("country"), only("addressLocality").alias("city"),
        text_at(J, "$.description").alias("description"), iso_time(text_at(J, "$.datePosted")).alias("posted_at"), kind.alias("employment_type"),
        F.when(F.lower(text_at(J, "$.jobLocationType")) == "telecommute", "remote").alias("workplace_type"), key.alias("requisition_id"), urls.canonical_url(link).alias("canonical_url"),
    ).where("title is not null")
    return keep_first(rows, ["payload_id", "canonical_url"])


def cards(pages: DataFrame, source: str, card: str, fields: dict[str, str], key: str, total: str | None = None, date_format: str | None = None) -> DataFrame:
    """HTML listings: ``card`` matches one record's markup, ``fields`` map to patterns whose first group is markup
    or text inside it; ``total`` is a pattern of the page's count.  The first card of each key stays."""
    found = F.regexp_extract_all(F.col("body"), F.lit(card), F.lit(0))
    rows = pages.select("payload_id", "portal_id", "url", *([F.regexp_replace(F.regexp_extract("body", total, 1), "[^0-9]", "").try_cast("long").alias("total")] if total else []), F.posexplode(found).alias("ordinal", "_card"))
    for name, pattern in fields.items():
        value = F.nullif(collapse(unescape(strip_tags(F.regexp_extract("_card", pattern, 1)))), F.lit(""))
        rows = rows.withColumn(name, value)
    for name in ("source_url", "apply_url"):
        if name in fields:
            rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), resolved(F.col("url"), F.col(name))))
    if date_format and "posted_at" in fields:
        rows = rows.withColumn("posted_at", F.try_to_timestamp("posted_at", F.lit(date_format)))
    rows = rows.withColumn("problem", F.when(F.col("title").isNull(), "lacks title")).withColumn("source", F.lit(source))
    return keep_first(rows, ["payload_id", key]).drop("_card")


LINK, INNER = r"""(?is)<a[^>]*href\s*=\s*["']([^"']+)["']""", r"(?is)<a[^>]*>(.*?)</a>"


def of_class(name: str) -> str:
    return rf"""(?is)class\s*=\s*["'][^"']*\b{name}\b[^"']*["'][^>]*>(.*?)</"""


def avature(pages: DataFrame) -> DataFrame:
    fields = {"title": INNER, "source_url": LINK, "source_job_id": r"""(?is)href\s*=\s*["'][^"']*/(\d+)(?:[/?#][^"']*)?["']""", "location": of_class("location"), "city": of_class("city"), "country": of_class("country"), "posted_at": of_class("posted")}
    return cards(pages, "avature", r"(?is)<article\b.*?</article>", fields, "source_job_id", r"(?is)of\s+([\d,.]+)\+?\s+results", "dd-MMM-yyyy")


def successfactors(pages: DataFrame) -> DataFrame:
    """Table rows, or tiles."""
    fields = {"title": INNER, "source_url": LINK, "source_job_id": r"""(?is)href\s*=\s*["'][^"']*/(\d+)/?["']""", "location": of_class("jobLocation"), "posted_at": of_class("jobDate")}
    return cards(pages, "successfactors", r"""(?is)<tr[^>]*class\s*=\s*["'][^"']*data-row[^"']*["'].*?</tr>|<li[^>]*class\s*=\s*["'][^"']*job-tile[^"']*["'].*?</li>""", fields, "source_url", None, "MMM d, yyyy")


def next_start(pages: DataFrame, name: str = "startrow") -> DataFrame:
    """(payload_id, now, next): the smallest offset linked to that is beyond the page's own; null at the end."""
    number = lambda c: F.coalesce(F.regexp_extract(c, rf"[?&]{name}=(\d+)", 1).try_cast("long"), F.lit(0))
    links = F.transform(F.regexp_extract_all(F.col("body"), F.lit(rf"[?&](?:amp;)?{name}=(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    return pages.select("payload_id", number(F.col("url")).alias("now"), F.array_min(F.filter(links, lambda x: x > number(F.col("url")))).alias("next"))


def radancy(pages: DataFrame) -> DataFrame:
    fields = {"title": r"(?is)<h\d[^>]*>(.*?)</h\d>", "source_url": LINK, "source_job_id": r"""(?is)data-job-id\s*=\s*["']([^"']+)["']""", "location": of_class("job-location"), "posted_at": of_class("job-date-posted")}
    return cards(pages, "radancy", r"""(?is)<a[^>]*data-job-id[^>]*>.*?</a>""", fields, "source_job_id", r"""(?is)data-total-(?:job-)?results\s*=\s*["']([\d,]+)["']""", "MM/dd/yyyy")


def rss(payloads: DataFrame) -> DataFrame:
    """(payload_id, link, title, item_id, trailing_id) of a feed's items."""
    items = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    tag = lambda n: unescape(F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")))
    rows = payloads.select("payload_id", F.posexplode(items).alias("ordinal", "x"))
    return rows.select("payload_id", "ordinal", tag("link").alias("link"), tag("title").alias("title"), tag(r"(?:\w+:)?id").alias("item_id")).withColumn("trailing_id", urls.trailing_id(F.col("link")))


def prefer_language(rows: DataFrame, key: str = "source_job_id", language: str = "language_code", wanted: str = "1") -> DataFrame:
    """The row in the wanted language of each id, else the first seen."""
    from ..operators.windows import first_by

    return first_by(rows, [key], F.desc(F.coalesce(F.col(language) == wanted, F.lit(False))), F.col("ordinal"))


def replay_stats(rows: DataFrame, key: str = "source_job_id", text: str = "description") -> DataFrame:
    """One row: rows, distinct ids, repeated ids, shortest and longest description."""
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), (F.count(key) - F.count_distinct(key)).alias("repeats"), F.min(F.length(text)).alias("shortest"), F.max(F.length(text)).alias("longest"))


#: Adapters in the order in which their test decides (host pieces; fixed values).
ROUTES = (
    ("greenhouse", r"(^|\.)greenhouse\.io$"), ("google_careers", r"^(www\.)?google\.com$|^careers\.google\.com$"), ("lever", r"(^|\.)lever\.co$"), ("ashby", r"(^|\.)ashbyhq\.com$"),
    ("smartrecruiters", r"(^|\.)smartrecruiters\.com$"), ("radancy", r"talentbrew|radancy"), ("successfactors_rmk", r"successfactors|sapsf"), ("workday", r"myworkdayjobs\.com$|myworkdaysite\.com$"),
    ("phenom", r"phenom"), ("oracle", r"oraclecloud\.com$"), ("avature", r"avature\.net$"), ("teamtailor", r"(^|\.)teamtailor\.com$"), ("workable", r"(^|\.)workable\.com$"),
)


def route(url: Column, family: Column | None = None, bound: dict[str, str] | None = None, fallback: str = "official_html") -> Column:
    """The first adapter that takes a portal: a bound URL, then host patterns, then its family's name."""
    host, out = urls.host(url), F.when(F.lit(False), "")
    for exact, name in (bound or {}).items():
        out = out.when(urls.jobs_url(url) == urls.jobs_url(F.lit(exact)), name)
    f = F.lower(F.regexp_replace(F.coalesce(family, F.lit("")) if family is not None else F.lit(""), r"\W+", "_"))
    for name, pattern in ROUTES:
        out = out.when(host.rlike(pattern) | (f == name), name)
    return out.when(urls.is_http(url), fallback).otherwise("unsupported")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters, "teamtailor": teamtailor, "workable": workable, "workday": workday, "oracle": oracle, "phenom": phenom,
    "google_careers": positional, "avature": avature, "successfactors_rmk": successfactors, "radancy": radancy, "official_html": json_ld,
}
