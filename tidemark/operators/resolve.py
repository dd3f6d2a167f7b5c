"""Entity resolution: registries, portal-scoped and global resolution, overlap with outside registries, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import urls
from ..functions.text import common_prefix, normalize
from ..functions.values import similarity
from ..storage import cut
from .windows import mode_by

#: Fields that must agree within a resolved cluster.
RESOLUTION_FIELDS = ("website", "careers_url", "jobs_url", "portal_scope", "ats_family", "ats_confidence", "resolution_status", "verification_url", "verified_date", "parent_override", "wave")


def sorted_set(value: Column) -> Column:
    """Distinct non-blank values, sorted by lower case and then spelling, as an array."""
    bare = F.filter(F.collect_set(F.trim(value)), lambda x: x != "")
    return F.transform(F.array_sort(F.transform(bare, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def build_clusters(records: DataFrame, sets: list[str], name: str = "canonical_employer", eligible: str = "primary_scan_eligibility") -> DataFrame:
    """One row per cluster: record count, sorted sets of ``sets``, whether any record is eligible, and the most
    frequent name."""
    grouped = records.groupBy("corporate_cluster_id").agg(F.count("*").alias("record_count"), F.bool_or(F.trim(eligible) == "Yes").alias("has_primary_scan_eligibility"), *[sorted_set(F.col(s)).alias(s) for s in sets])
    top = mode_by(records.select("corporate_cluster_id", F.trim(name).alias("representative")), ["corporate_cluster_id"], "representative").select("corporate_cluster_id", "representative")
    return grouped.join(top, "corporate_cluster_id")


def inconsistent(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, values) wherever a group has more than one value of a field that must be one."""
    counts = records.groupBy(key).agg(*[F.count_distinct(F.trim(F.coalesce(f, F.lit("")))).alias(f) for f in fields])
    long = counts.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in fields])))
    return long.where("values > 1")


def build_portals(mappings: DataFrame) -> DataFrame:
    """One row per normalized URL: least raw URL, sorted families and confidences, cluster count, conflict flag.
    Rows whose URL has no normal form are left to ``rejected_portals``."""
    rows = mappings.withColumn("normalized_url", urls.jobs_url(F.col("jobs_url"))).where("normalized_url is not null")
    grouped = rows.groupBy("normalized_url").agg(
        F.min("jobs_url").alias("jobs_search_url"), F.array_sort(F.collect_set("ats_family")).alias("ats_families"), F.array_sort(F.collect_set("ats_confidence")).alias("ats_confidences"), F.count_distinct("corporate_cluster_id").alias("cluster_count")
    )
    return grouped.withColumns({"host": urls.host(F.col("normalized_url")), "metadata_conflict": (F.size("ats_families") > 1) | (F.size("ats_confidences") > 1)})


def rejected_portals(mappings: DataFrame) -> DataFrame:
    return mappings.where(urls.jobs_url(F.col("jobs_url")).isNull())


def refresh_portals(portals: DataFrame, mappings: DataFrame, retire: bool = True, keep_blank: bool = True) -> DataFrame:
    """Aggregates of changed mappings put back on their portals; a portal without any retires, if asked to."""
    m = mappings if keep_blank else mappings.where("trim(ats_family) <> ''")
    fresh = m.groupBy("portal_id").agg(F.count_distinct("corporate_cluster_id").alias("_n"), F.array_sort(F.collect_set("ats_family")).alias("_families"), F.count_distinct("ats_confidence").alias("_confidences"))
    joined = portals.join(fresh, portals["id"] == fresh["portal_id"], "left").drop("portal_id")
    some = F.col("_n").isNotNull()
    out = joined.withColumns(
        {
            "cluster_count": F.coalesce("_n", F.lit(0)),
            "ats_families": F.when(some, F.col("_families")).otherwise(F.array().cast("array<string>")),
            "metadata_conflict": some & ((F.size("_families") > 1) | (F.col("_confidences") > 1)),
        }
    )
    if retire:
        out = out.withColumns({"active_in_registry": F.col("active_in_registry") & some, "health_state": F.when(some, F.col("health_state")).otherwise("RETIRED")})
    return out.drop("_n", "_families", "_confidences")


def names_of(clusters: DataFrame) -> DataFrame:
    """(corporate_cluster_id, name_key) of every normalized name of a cluster."""
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.array("representative"), F.coalesce("canonical_employers", none), F.coalesce("parent_groups", none)))
    each = clusters.select("corporate_cluster_id", F.explode(names).alias("name"))
    return each.select("corporate_cluster_id", normalize(F.col("name")).alias("name_key")).where("name_key <> ''").distinct()


def candidates_of(names: DataFrame, prefix: str) -> DataFrame:
    return names.groupBy("name_key").agg(F.array_sort(F.collect_set("corporate_cluster_id")).alias(f"{prefix}_ids"))


def resolve_global(jobs: DataFrame, clusters: DataFrame, aliases: DataFrame, company: str = "raw_company") -> DataFrame:
    """Add corporate_cluster_id, method and candidate_ids by exact normalized name, then by verified alias
    where no name matches at all; several candidates resolve to none."""
    by_name = candidates_of(names_of(clusters), "name")
    by_alias = candidates_of(aliases.where("status = 'VERIFIED'").select("corporate_cluster_id", F.col("normalized_alias").alias("name_key")), "alias")
    rows = jobs.withColumn("name_key", normalize(F.col(company))).join(by_name, "name_key", "left").join(by_alias, "name_key", "left")
    ids = F.coalesce("name_ids", "alias_ids", F.array().cast("array<string>"))
    method = (
        F.when(F.col("name_key") == "", "external_source_missing_company")
        .when(F.size("name_ids") == 1, "global_exact_company_name")
        .when(F.size("name_ids") > 1, "global_ambiguous_company_name")
        .when(F.size("alias_ids") == 1, "global_verified_company_alias")
        .when(F.size("alias_ids") > 1, "global_ambiguous_verified_alias")
        .otherwise("global_company_name_not_found")
    )
    return rows.withColumns({"method": method, "candidate_ids": F.when(F.col("name_key") == "", F.array().cast("array<string>")).otherwise(ids)}).withColumn(
        "corporate_cluster_id", F.when(F.col("method").isin("global_exact_company_name", "global_verified_company_alias"), F.get("candidate_ids", F.lit(0)))
    ).drop("name_key", "name_ids", "alias_ids")


def resolve_in_portal(jobs: DataFrame, mappings: DataFrame, clusters: DataFrame, aliases: DataFrame, company: str = "raw_company") -> DataFrame:
    """Add corporate_cluster_id, method and candidate_ids among the clusters mapped to a job's portal.

    One mapping decides at once; a shared portal wants the exact name, parent override or verified alias of
    just one of its clusters.  Least and greatest ids tell whether there is one; the arrays of all candidates, which may
    be long for each job, are not built where a caller drops candidate_ids.
    """
    found = lambda rows, by, name: rows.groupBy(*by).agg(
        F.lit(True).alias(name), F.min("corporate_cluster_id").alias(f"{name}_first"), F.max("corporate_cluster_id").alias(f"{name}_last"), F.array_sort(F.collect_set("corporate_cluster_id")).alias(f"{name}_ids")
    )
    named = mappings.join(names_of(clusters), "corporate_cluster_id").select("portal_id", "corporate_cluster_id", "name_key")
    override = mappings.select("portal_id", "corporate_cluster_id", normalize(F.col("parent_override")).alias("name_key")).where("name_key <> ''")
    alias = mappings.join(aliases.where("status = 'VERIFIED'").select("corporate_cluster_id", F.col("normalized_alias").alias("name_key")), "corporate_cluster_id").select("portal_id", "corporate_cluster_id", "name_key")
    per, hits = found(mappings, ["portal_id"], "portal"), found(named.unionByName(override).unionByName(alias), ["portal_id", "name_key"], "hit")
    rows = jobs.withColumn("name_key", normalize(F.col(company))).join(hits, ["portal_id", "name_key"], "left").join(per, "portal_id", "left")
    single = lambda name: F.col(f"{name}_first") == F.col(f"{name}_last")
    method = (
        F.when(F.col("portal").isNull(), "portal_has_no_cluster_mapping")
        .when(single("portal"), "single_portal_mapping")
        .when(F.col("name_key") == "", "shared_portal_missing_company")
        .when(single("hit"), "exact_company_name")
        .when(F.col("hit_first") < F.col("hit_last"), "ambiguous_exact_company_name")
        .otherwise("shared_portal_no_exact_company_match")
    )
    none = F.array().cast("array<string>")
    chosen = F.when(F.col("method") == "single_portal_mapping", F.col("portal_first")).when(F.col("method") == "exact_company_name", F.col("hit_first"))
    candidates = F.when(F.col("method") == "ambiguous_exact_company_name", F.col("hit_ids")).otherwise(F.coalesce("portal_ids", none))
    return rows.withColumn("method", method).withColumns({"corporate_cluster_id": chosen, "candidate_ids": candidates}).select(*jobs.columns, "method", "corporate_cluster_id", "candidate_ids")


def display_names(resolved: DataFrame, mappings: DataFrame, clusters: DataFrame, company: str = "raw_company") -> DataFrame:
    """Add display_name: the cluster's name, else the raw one, else what the portal's clusters share."""
    names = clusters.select("corporate_cluster_id", "representative")
    of_portal = mappings.join(names, "corporate_cluster_id").groupBy("portal_id").agg(
        F.filter(F.collect_set(F.trim(F.coalesce("parent_override", F.lit("")))), lambda x: x != "").alias("overrides"), F.transform(F.array_sort(F.collect_list(F.struct("corporate_cluster_id", "representative"))), lambda x: x["representative"]).alias("names")
    )
    shared = common_prefix(F.col("names"))
    guess = F.when(F.size("overrides") == 1, F.get("overrides", F.lit(0))).when(shared != "", shared).otherwise(F.array_join(F.array_distinct("names"), " / "))
    raw = F.nullif(F.trim(F.coalesce(company, F.lit(""))), F.lit(""))
    rows = resolved.join(names, "corporate_cluster_id", "left").join(of_portal, "portal_id", "left")
    return rows.withColumn("display_name", F.coalesce("representative", raw, guess, F.lit(""))).drop("representative", "overrides", "names")


def reconcile(rows: DataFrame, clusters: DataFrame, aliases: DataFrame, employer: str = "employer", given: str = "given_cluster_id") -> DataFrame:
    """Registry rows to clusters: a given id that exists, then an alias, then an exact name; else unmatched."""
    known = clusters.select(F.col("corporate_cluster_id").alias(given), F.lit(True).alias("known"))
    by_alias = candidates_of(aliases.select("corporate_cluster_id", F.col("normalized_alias").alias("name_key")), "alias")
    by_name = candidates_of(names_of(clusters), "name")
    out = rows.withColumn("name_key", normalize(F.col(employer))).join(known, given, "left").join(by_alias, "name_key", "left").join(by_name, "name_key", "left")
    method = F.when(F.col("known"), "explicit").when(F.size("alias_ids") == 1, "alias").when(F.size("name_ids") == 1, "name").otherwise("unmatched")
    chosen = F.when(F.col("known"), F.col(given)).when(F.size("alias_ids") == 1, F.get("alias_ids", F.lit(0))).when(F.size("name_ids") == 1, F.get("name_ids", F.lit(0)))
    return out.withColumns({"match_method": method, "corporate_cluster_id": chosen}).drop("name_key", "known", "alias_ids", "name_ids")


def suggestions(unmatched: DataFrame, clusters: DataFrame, employer: str = "employer", most: int = 5) -> DataFrame:
    """(employer, suggestion): up to ``most`` cluster names that hold, or are held by, the employer's name.

    Names are compared only if they share a word, which containment of whole words implies.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 2)
    left = unmatched.select(employer, normalize(F.col(employer)).alias("a")).distinct().withColumn("word", F.explode(words(F.col("a"))))
    right = names_of(clusters).select(F.col("corporate_cluster_id"), F.col("name_key").alias("b")).withColumn("word", F.explode(words(F.col("b"))))
    near = left.join(right, "word").where(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).select(employer, F.col("b").alias("suggestion")).distinct()
    place = F.row_number().over(W.partitionBy(employer).orderBy(F.length("suggestion"), "suggestion"))
    return near.withColumn("place", place).where(F.col("place") <= most).drop("place")


def propose_aliases(clusters: DataFrame, aliases: DataFrame, queries: list[str], threshold: float = 0.72, limit: int = 5) -> DataFrame:
    """(query, corporate_cluster_id, matched_name, source, score): each cluster's best name by Ratcliff-Obershelp
    ratio, at least ``threshold``, the best ``limit`` for each query.  The stated queries meet all names."""
    if not 0 <= threshold <= 1 or limit < 1:
        raise ValueError("threshold must lie in 0..1 and limit be positive")
    master = clusters.select("corporate_cluster_id", "representative", F.explode(F.array_distinct(F.concat(F.array("representative"), F.coalesce("canonical_employers", F.array().cast("array<string>")), F.coalesce("parent_groups", F.array().cast("array<string>"))))).alias("name"), F.lit("master").alias("source"))
    alias = aliases.where("status = 'VERIFIED'").join(clusters.select("corporate_cluster_id", "representative"), "corporate_cluster_id").select("corporate_cluster_id", "representative", F.col("alias").alias("name"), F.lit("verified_alias").alias("source"))
    asked = [q for q in queries if q.strip()]
    rows = master.unionByName(alias).withColumn("query", F.explode(F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")))
    scored = rows.withColumn("score", similarity("query", "name")).where(F.col("score") >= threshold)
    best = F.row_number().over(W.partitionBy("query", "corporate_cluster_id").orderBy(F.desc("score"), F.desc("source"), "name"))
    top = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.lower("representative"), "corporate_cluster_id"))
    return scored.withColumn("b", best).where("b = 1").withColumn("rank", top).where(F.col("rank") <= limit).select("query", "rank", "corporate_cluster_id", "representative", F.col("name").alias("matched_name"), "source", "score")


def overlap_groups(companies: DataFrame, boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of companies (company_id, domain, portals, names) with outside boards (family, slug, url, name, domain).

    Returns links (company_id, group, match_class, match_basis) and members (group, family, slug, url); a link holds for
    every member of its group, and each match is in just one link of its basis.  In order of evidence: equal portal URL,
    equal domain, equal company token with compatible names (HIGH_CONFIDENCE) or without (CANDIDATE), and equal
    name alone (CANDIDATE) unless the pair is there already, the key has at most two characters, or the board
    fits several companies.

    Boards that a kind of evidence cannot tell apart are one group of it: those of one URL key, of the same domains, of the
    same hosts, slugs and names.  So links grow with companies and different boards, not with copies.  A name alone links a board to at
    most one company for each of its names, and has groups of single boards.
    """
    board = ["family", "slug", "url"]
    c = companies.select("company_id", urls.bare_host(F.col("domain")).alias("own_domain"), "portals", "names").withColumns({"token": urls.company_token(F.col("own_domain")), "keys": F.array_distinct(F.filter(F.transform("names", urls.name_key), lambda k: k != ""))})
    rows = boards.select(*board, F.lower(F.coalesce("domain", F.lit(""))).alias("domain"), urls.name_key(F.col("name")).alias("name"))
    b = rows.groupBy(*board).agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set("name")).alias("names")).withColumns({"url_key": urls.overlap_url(F.col("url")), "host": urls.bare_host(F.col("url")), "slug_token": urls.slug_key(F.col("slug"))})
    b = b.withColumn("tokens", F.array_sort(F.array_distinct(F.array("slug_token", F.split_part("host", F.lit("."), F.lit(1))))))
    group = lambda kind, *cols: F.unhex(F.md5(F.to_json(F.struct(F.lit(kind).alias("kind"), *cols))))
    b = b.withColumns({"by_url": group("url", "url_key"), "by_domain": group("domain", "domains"), "by_token": group("token", "host", "tokens", "names"), "by_name": group("name", *board)})
    pair = ["company_id", "group"]
    out = lambda df, kind, basis: df.select(*pair, F.lit(kind).alias("match_class"), F.lit(basis).alias("match_basis"))
    of = lambda kind, *cols: b.select(F.col(f"by_{kind}").alias("group"), *cols).distinct()
    portals = c.select("company_id", F.explode(F.transform("portals", urls.overlap_url)).alias("url_key")).where("url_key <> ''")
    by_url = out(portals.join(of("url", "url_key"), "url_key").select(*pair).distinct(), "HIGH_CONFIDENCE", "URL_EXACT")
    domains = of("domain", "domains").select("group", F.explode("domains").alias("own_domain"))
    by_domain = out(c.where("own_domain <> ''").join(domains, "own_domain").select(*pair).distinct(), "HIGH_CONFIDENCE", "DOMAIN_EXACT")
    tokens = of("token", "host", "tokens", F.col("names").alias("board_names")).withColumn("token", F.explode("tokens")).where((F.col("token") != "") & ~urls.is_generic_label(F.col("token")))
    fits = F.exists("board_names", lambda n: F.coalesce(urls.names_compatible(F.get("keys", F.lit(0)), n), F.lit(False)))
    same = c.where("token <> ''").join(tokens, "token").where("host <> own_domain").groupBy(*pair).agg(F.bool_or(fits).alias("fits"))
    by_token = same.select(*pair, F.when(F.col("fits"), "HIGH_CONFIDENCE").otherwise("CANDIDATE").alias("match_class"), F.when(F.col("fits"), "SLUG_PLUS_NAME").otherwise("SLUG").alias("match_basis"))
    first = cut(by_url.unionByName(by_domain).unionByName(by_token))
    owners = c.select("company_id", F.explode("keys").alias("name_key")).where(F.length("name_key") > 2).groupBy("name_key").agg(F.min("company_id").alias("company_id"), F.max("company_id").alias("other")).where("company_id = other")
    alone = b.withColumn("name_key", F.explode("names")).join(owners, "name_key").select("company_id", "by_url", "by_domain", "by_token", "by_name").distinct()
    for kind in ("by_url", "by_domain", "by_token"):
        alone = alone.join(first.select("company_id", F.col("group").alias(kind)), ["company_id", kind], "left_anti")
    links = cut(first.unionByName(out(alone.select("company_id", F.col("by_name").alias("group")), "CANDIDATE", "NAME_EXACT")))
    return links, b.select(F.explode(F.array("by_url", "by_domain", "by_token", "by_name")).alias("group"), *board)


def overlap(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """The matches of ``overlap_groups`` one by one: company_id, family, slug, url, match_class, match_basis."""
    links, members = overlap_groups(companies, boards)
    return links.join(members, "group").select("company_id", "family", "slug", "url", "match_class", "match_basis")


def overlap_labels(matches: DataFrame) -> DataFrame:
    """Matches with their company's number of matches, families, and whether one family has several boards."""
    per = matches.groupBy("company_id", "family").agg(F.count_distinct("slug", "url").alias("boards")).groupBy("company_id").agg(F.count("*").alias("families"), F.max("boards").alias("most"))
    size = F.count("*").over(W.partitionBy("company_id"))
    return matches.withColumn("matches", size).join(per, "company_id").withColumns({"multi_family": F.col("families") > 1, "multi_tenant": F.col("most") > 1}).drop("most")
