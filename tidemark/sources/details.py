"""Detail payloads: what a record's own page or detail answer adds to its catalog row."""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import join_sections, let, plain_lines
from .parsers import items_at, json_ld, text_at

#: Limits (fixed values): longest description kept of a page without structured data, and the shortest that counts as one.
LONGEST, SHORTEST, SHORTEST_STRUCTURED = 60_000, 100, 20
#: Longest value of a label, lines above a heading that may say where, and where they are sought without one.
LONGEST_VALUE, HEADER_LINES, HEADER_WITHOUT_HEADING = 200, 5, 20
#: Elements whose text is not a record's (fixed values), and words for where work is done.
HIDDEN = ("script", "style", "noscript", "svg", "nav", "footer", "header", "form")
WORKPLACES = ("hybrid", "remote", "on-site", "onsite")
FIELDS = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "location", "employment_type", "workplace_type", "description", "problem")])


class _Page(HTMLParser):
    """Lines of the main part of a page, and its first heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: dict[str, list[str]] = {"main": [], "article": [], "role": [], "body": []}
        self.open: list[tuple[str, str | None]] = []
        self.hidden, self.heading, self.in_heading = 0, [], 0
        self.headings = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        self.hidden += tag in HIDDEN
        part = tag if tag in ("main", "article") else "role" if dict(attrs).get("role") == "main" else None
        self.open.append((tag, part))
        if tag == "h1":
            self.headings += 1
            self.in_heading += self.headings == 1

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, _ in self.open[i:]:
                    self.hidden -= name in HIDDEN
                del self.open[i:]
                break
        if tag == "h1":
            self.in_heading = 0

    def handle_data(self, data):
        if self.hidden:
            return
        self.text["body"].append(data)
        for part in {p for _, p in self.open if p}:
            self.text[part].append(data)
        if self.in_heading:
            self.heading.append(data)


LINES = T.StructType([T.StructField("heading", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))])


@F.pandas_udf(LINES)
def main_lines(bodies: pd.Series) -> pd.DataFrame:
    """The first heading and the lines of the main part of each page; what they mean is decided by expressions."""
    found = []
    for body in bodies:
        page = _Page()
        page.feed(body or "")
        page.close()
        part = next((t for t in map("\n".join, page.text.values()) if t.strip()), "")
        lines = [" ".join(x.split()) for x in part.splitlines()]
        lines = [x for x, _ in groupby(filter(None, lines))]
        found.append((" ".join(" ".join(page.heading).split()), lines))
    return pd.DataFrame(found, columns=LINES.names)


def labelled(lines: Column, *labels: str) -> Column:
    """What stands on the line under the first label of a field, '' if that is long or nothing does."""
    under = F.transform(lines, lambda x, i: F.struct(F.lower(F.rtrim(x, F.lit(":"))).alias("label"), F.get(lines, i + 1).alias("value")))
    fit = F.filter(under, lambda p: p["label"].isin(*labels) & (F.length(p["value"]) <= LONGEST_VALUE))
    return F.coalesce(F.get(fit, F.lit(0))["value"], F.lit(""))


def header(lines: Column, heading: Column) -> Column:
    """Parts between middle dots of the line nearest above the heading that has several; above the twentieth line where the heading is no line."""
    place = F.array_position(lines, heading)
    place = F.when(place > 0, place).otherwise(F.least(F.size(lines), F.lit(HEADER_WITHOUT_HEADING)) + 1).cast("int")
    above = F.slice(lines, F.greatest(place - HEADER_LINES, F.lit(1)), F.least(place - 1, F.lit(HEADER_LINES)))
    divided = F.transform(above, lambda x: F.filter(F.transform(F.split(x, " · "), F.trim), lambda p: p != ""))
    several = F.filter(divided, lambda parts: F.size(parts) > 1)
    return F.coalesce(F.try_element_at(several, F.lit(-1)), F.array().cast("array<string>"))


def main_text(body: Column) -> Column:
    """FIELDS of a page without structured data."""

    def decided(heading: Column, lines: Column, text: Column, parts: Column) -> Column:
        last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
        mode = F.when(F.lower(last).isin(*WORKPLACES), last).otherwise("")
        place = F.when(mode == "", last).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
        named = labelled(lines, "location", "locations")
        location = F.when(named != "", named).otherwise(place)
        workplace = F.coalesce(F.nullif(labelled(lines, "remote status"), F.lit("")), F.when(named == "", mode).otherwise(""))
        values = (heading, location, labelled(lines, "employment type", "job type"), workplace, F.left(text, F.lit(LONGEST)))
        short = F.length(text) < SHORTEST
        return F.struct(*[F.when(~short, v).alias(n) for v, n in zip(values, FIELDS.names, strict=False)], F.when(short, "too little text").alias("problem"))

    found = main_lines(body)
    return let(lambda h, x: let(decided, heading=h, lines=x, text=F.array_join(x, "\n"), parts=header(x, h)), heading=found["heading"], lines=found["lines"])


@F.pandas_udf(T.StringType())
def plain_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: plain_lines(v) if v else "")


def detail_pages(pages: DataFrame) -> DataFrame:
    """(payload_id, fields, parser, problem) of detail pages: JSON-LD where its description has some length, else
    the main text."""
    structured = json_ld(pages).withColumn("description", plain_text("description")).where(F.length(F.trim("description")) >= SHORTEST_STRUCTURED)
    structured = structured.withColumn("place", F.row_number().over(_by_payload())).where("place = 1")
    structured = structured.select("payload_id", F.struct("title", "location", F.coalesce("employment_type", F.lit("")).alias("employment_type"), F.coalesce("workplace_type", F.lit("")).alias("workplace_type"), "description", F.lit(None).cast("string").alias("problem")).alias("s"))
    rows = pages.join(structured, "payload_id", "left").withColumn("m", F.when(F.col("s").isNull(), main_text(F.col("body"))))
    pick = [F.coalesce(F.col(f"s.{n}"), F.col(f"m.{n}")).alias(n) for n in FIELDS.names]
    return rows.select("payload_id", *pick, F.when(F.col("s").isNotNull(), "json_ld_jobposting").otherwise("main_text").alias("parser"))


def _by_payload():
    from pyspark.sql import Window as W

    return W.partitionBy("payload_id").orderBy("ordinal")


def sections(v: Column, paths: list[str]) -> Column:
    return join_sections(F.transform(F.filter(F.array(*[text_at(v, p) for p in paths]), lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "<[^>]+>", "\n")))


def detail_json(payloads: DataFrame, kind: str) -> DataFrame:
    """(payload_id, location, employment_type, workplace_type, description) of a vendor's detail answer."""
    v = F.try_parse_json("body")
    none = F.lit("")
    if kind == "workday":
        i = F.try_variant_get(v, "$.jobPostingInfo", "variant")
        more = F.transform(items_at(i, "$.additionalLocations"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
        spots = F.filter(F.concat(F.array(text_at(i, "$.location")), F.coalesce(more, F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
        text = F.coalesce(text_at(i, "$.jobDescription"), text_at(i, "$.externalJobDescription"), text_at(i, "$.description"))
        found = (F.array_join(F.array_distinct(spots), " | "), text_at(i, "$.timeType"), text_at(i, "$.remoteType"), join_sections(F.array(F.regexp_replace(F.coalesce(text, none), "<[^>]+>", "\n"))))
    elif kind == "smartrecruiters":
        place = F.concat_ws(", ", *[text_at(v, f"$.location.{p}") for p in ("city", "region", "country")])
        found = (place, none, none, sections(v, [f"$.jobAd.sections.{s}.text" for s in ("jobDescription", "qualifications", "additionalInformation", "companyDescription")]))
    elif kind == "oracle":
        i = F.try_variant_get(v, "$.items[0]", "variant")
        found = (text_at(i, "$.PrimaryLocation"), F.coalesce(*[text_at(i, f"$.{k}") for k in ("WorkerType", "JobType", "ContractType", "JobSchedule")]), none, sections(i, ["$.ExternalDescriptionStr", "$.ExternalResponsibilitiesStr", "$.ExternalQualificationsStr"]))
    else:
        raise ValueError(f"no detail parser for {kind!r}")
    return payloads.select("payload_id", *[F.coalesce(c, none).alias(n) for c, n in zip(found, ("location", "employment_type", "workplace_type", "description"), strict=True)])
