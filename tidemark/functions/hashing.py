"""Identity keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, normalize_location, normalize_title
from .urls import canonical_url

NUL = "\u0000"


def blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def joined(*values: Column) -> Column:
    """Values joined by NUL, so that none can run into the next."""
    return F.concat_ws(NUL, *values)


def source_key(source: Column, source_job_id: Column) -> Column:
    return joined(normalize(source), blank(source_job_id))


def ats_key(cluster: Column, ats_job_id: Column) -> Column:
    """Null where the id is blank."""
    return F.when(blank(ats_job_id) != "", joined(blank(cluster), blank(ats_job_id)))


def fingerprint(cluster: Column, title: Column, location: Column, requisition: Column) -> Column:
    """SHA-256 of cluster, title, location and requisition in their normal forms."""
    return F.sha2(joined(blank(cluster), normalize_title(title), normalize_location(location), normalize(requisition)), 256)


def variant_id(native: Column, title: Column, location: Column, url: Column, requisition: Column) -> Column:
    """Id of a row that shares its native id with another row of other contents."""
    own = F.when(blank(native) == "", "anonymous").otherwise(blank(native))
    key = joined(own, normalize_title(title), normalize_location(location), canonical_url(url), blank(requisition))
    return F.concat(own, F.lit("::variant:"), F.substring(F.sha2(key, 256), 1, 16))


def conflicts(old_title: Column, old_location: Column, old_url: Column, title: Column, location: Column, url: Column) -> Column:
    """Whether title, location or URL are known on both sides and differ; all in their normal forms already."""
    pairs = ((old_title, title), (old_location, location), (old_url, url))
    out = F.lit(False)
    for a, b in pairs:
        a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
        out = out | ((a != "") & (b != "") & (a != b))
    return out


def payload_hash(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted keys and nulls."""
    return json_hash({c: F.col(c) for c in columns})


def change_hashes(metadata: list[str], description: list[str], semantic: list[str]) -> dict[str, Column]:
    """Three hashes with apart responsibilities."""
    return {"metadata_hash": payload_hash(*metadata), "description_hash": payload_hash(*description), "semantic_hash": payload_hash(*semantic)}


#: Fields that an analysis reads: the better known value, and what it falls back to.
EFFECTIVE = {
    "city": ("detail_city", "raw_city"), "company": ("resolved_company_name", "raw_company"), "country": ("detail_country", "raw_country"), "description": ("detail_description", "raw_description"),
    "employment_type": ("detail_employment_type", "raw_employment_type"), "location": ("detail_location", "raw_location"), "source_url": ("detail_url", "source_url"), "title": ("detail_title", "raw_title"),
    "workplace_type": ("detail_workplace_type", "raw_workplace_type"),
}
#: Characters of a description that a triage reads (fixed value).
SNIPPET = 1600


def effective_field(columns: list[str], name: str) -> Column:
    first, second = (F.col(c) if c in columns else F.lit(None).cast("string") for c in EFFECTIVE[name])
    return F.coalesce(F.nullif(first, F.lit("")), second)


def analysis_hash(columns: list[str]) -> Column:
    """Hash of what an analysis of a job reads, over the columns that the table has."""
    return json_hash({name: effective_field(columns, name) for name in EFFECTIVE})


def triage_hash(columns: list[str], metadata: Column, job_id: str = "id") -> Column:
    """Hash of what a triage of a job reads: its id, compact metadata and the beginning of its description."""
    text = {name: F.coalesce(effective_field(columns, name), F.lit("")) for name in ("company", "location", "description")}
    snippet = F.left(text["description"], F.lit(SNIPPET))
    return json_hash({"job_id": F.col(job_id), "company": text["company"], "title": effective_field(columns, "title"), "location": text["location"], "metadata": metadata, "description_snippet": snippet})


def json_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys and nulls."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def canonical_id(*first_identity: Column) -> Column:
    """A reproducible id for the record that was first seen with this identity."""
    return F.concat(F.lit("CJ-"), F.substring(F.sha2(joined(*first_identity), 256), 1, 32))


def unresolved_namespace(portal_id: Column, source: Column, company: Column) -> Column:
    """What stands for a cluster where none is known."""
    return F.when(portal_id.isNotNull(), F.concat(F.lit("PORTAL:"), portal_id.cast("string"))).otherwise(F.concat(F.lit("EXTERNAL:"), normalize(source), F.lit(":"), normalize(company)))
