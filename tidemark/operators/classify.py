"""Rule classifiers. Each compiles its configuration to one expression and returns an audit struct:
status (INCLUDE, REVIEW, EXCLUDE), reason, matched_terms, category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, normalize, padded_contains, padded_matches, plain_normalize

RESULT = "struct<status:string,reason:string,matched_terms:array<string>,category:string>"
INCLUDE, REVIEW, EXCLUDE = "INCLUDE", "REVIEW", "EXCLUDE"
#: Terms that make an early-career match an internship (fixed values).
INTERNSHIP_TERMS = ("intern", "internship", "stage", "working student", "thesis")


def result(status: str, reason: str, terms: Column | None = None, category: Column | str | None = None) -> Column:
    terms = F.array().cast("array<string>") if terms is None else terms
    category = F.lit(category).cast("string") if category is None or isinstance(category, str) else category
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), terms.cast("array<string>").alias("matched_terms"), category.alias("category")).cast(RESULT)


def first_rule(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The outcome of the first rule that holds."""
    out = None
    for test, outcome in rules:
        out = F.when(test, outcome) if out is None else out.when(test, outcome)
    return out.otherwise(default)


def padded(value: Column) -> Column:
    """The normal form with a space at both ends, in which terms are looked for."""
    return F.concat(F.lit(" "), normalize(value), F.lit(" "))


def any_of(text: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | padded_contains(text, t)
    return out


def best_category(text: Column, categories: dict[str, list[str]]) -> Column:
    """struct(category, terms): of the category that owns the longest matched term, the earliest if several do; null without a match."""
    found = []
    for place, (name, terms) in enumerate(categories.items()):
        sized = F.array(*[F.when(padded_contains(text, t), F.struct(F.lit(len(plain_normalize(t))).alias("size"), F.lit(t).alias("term"))) for t in terms if plain_normalize(t)] or [F.lit(None).cast("struct<size:int,term:string>")])
        hits = F.filter(sized, lambda h: h.isNotNull())
        longest = F.array_max(F.transform(hits, lambda h: h["size"]))
        found.append(F.when(F.size(hits) > 0, F.struct(longest.alias("size"), F.lit(-place).alias("place"), F.lit(name).alias("category"), F.transform(hits, lambda h: h["term"]).alias("terms"))))
    if not found:
        return F.lit(None).cast("struct<size:int,place:int,category:string,terms:array<string>>")
    return F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))


def topic(config: dict, title: Column, description: Column, employment: Column) -> Column:
    """Topic classifier over a taxonomy with the keys categories, contextual_terms, negative_title_phrases,
    negative_override_terms, always_excluded_title_functions, generic_title_exclusions,
    description_only_title_exclusions and description_only_title_markers."""
    listed = lambda key: [str(x) for x in config.get(key) or []]
    categories = {str(k): [str(t) for t in v] for k, v in config["categories"].items() if isinstance(v, list)}
    never, negative = listed("always_excluded_title_functions"), listed("negative_title_phrases")
    generic, other, markers = listed("generic_title_exclusions"), listed("description_only_title_exclusions"), listed("description_only_title_markers")

    def decided(t: Column, d: Column, e: Column, in_title: Column, in_text: Column) -> Column:
        early = any_of(t, markers) | any_of(e, markers)
        rules = [
            (any_of(t, never), result(EXCLUDE, "title names a function that is never wanted", padded_matches(t, never))),
            (any_of(t, negative) & ~any_of(t, listed("negative_override_terms")), result(EXCLUDE, "title uses the topic's word in another sense", padded_matches(t, negative))),
            (in_title.isNotNull(), result(INCLUDE, "title names the topic", in_title["terms"], in_title["category"])),
            (any_of(t, generic), result(EXCLUDE, "title is generic", padded_matches(t, generic))),
            (any_of(t, other), result(EXCLUDE, "title names another function", padded_matches(t, other))),
            (in_text.isNotNull() & early, result(INCLUDE, "description names the topic", in_text["terms"], in_text["category"])),
            (in_text.isNotNull(), result(EXCLUDE, "only the description names the topic", in_text["terms"])),
        ]
        both = F.concat(t, F.ltrim(d))  # padded, with one space between
        for item in config.get("contextual_terms") or []:
            test = padded_contains(both, str(item["term"])) & any_of(both, [str(m) for m in item["context_markers"]]) & early
            rules.append((test, result(INCLUDE, "term with a marker of its context", F.array(F.lit(str(item["term"]))), str(item["category"]))))
        return first_rule(rules, result(EXCLUDE, "nothing names the topic"))

    # Normal forms once a row, then the categories once a row, then the rules.
    return let(lambda t, d, e: let(decided, t=t, d=d, e=e, in_title=best_category(t, categories), in_text=best_category(d, categories)), t=padded(title), d=padded(description), e=padded(employment))


YEARS = r"(?:years?|yrs?)(?:\s+of)?(?:\s+relevant)?\s+experience\b"
#: Experience phrases in the order in which they are tried (fixed values).
EXPERIENCE = {
    "range": rf"(?iU)\b(\d{{1,2}})\s*(?:-|–|—|to)\s*(\d{{1,2}})\s*{YEARS}",
    "up_to": rf"(?iU)\bup\s+to\s+(\d{{1,2}})\s*{YEARS}",
    "minimum": rf"(?iU)\b(?:minimum(?:\s+of)?|at\s+least)\s+(\d{{1,2}})\s*{YEARS}",
    "plus": rf"(?iU)\b(\d{{1,2}})\s*\+\s*{YEARS}",
    "exact": rf"(?iU)\b(\d{{1,2}})\s*{YEARS}",
}
#: Levels in titles (fixed values).
ROMAN = r"(?iU)\b(?:engineer|analyst|consultant|specialist)\s+(I{1,3}|IV)\b"
LEVEL = r"(?iU)\blevel\s+([1-4])\b"


def experience(description: Column, years: int) -> Column:
    """What the first phrase on years of experience says; null without one."""
    text = F.coalesce(description, F.lit(""))
    # Only texts with the word that all phrases end in are searched; each phrase is searched once a row.
    text = F.when(F.lower(text).contains("experience"), text).otherwise("")

    def decided(*tokens: Column) -> Column:
        found = dict(zip(EXPERIENCE, tokens, strict=True))
        number = lambda k, i=0: F.get(F.regexp_extract_all(found[k], F.lit(r"(\d{1,2})"), F.lit(1)), F.lit(i)).try_cast("int")
        inc = lambda k, why: result(INCLUDE, why, F.array(found[k]), "junior")
        rev = lambda k, why: result(REVIEW, why, F.array(found[k]))
        exc = lambda k, why: result(EXCLUDE, why, F.array(found[k]))
        rules = [
            ((found["range"] != "") & (number("range", 1) <= years), inc("range", "range of years is early-career")),
            ((found["range"] != "") & (number("range") > years), exc("range", "range of years is beyond early-career")),
            (found["range"] != "", rev("range", "range of years crosses the bound")),
            ((found["up_to"] != "") & (number("up_to") <= years), inc("up_to", "most years are early-career")),
            (found["up_to"] != "", rev("up_to", "most years cross the bound")),
            ((found["minimum"] != "") & (number("minimum") > years), exc("minimum", "least years are beyond early-career")),
            (found["minimum"] != "", rev("minimum", "least years are open-ended")),
            ((found["plus"] != "") & (number("plus") > years), exc("plus", "open-ended years are beyond early-career")),
            (found["plus"] != "", rev("plus", "open-ended years")),
            ((found["exact"] != "") & (number("exact") <= years), inc("exact", "years are early-career")),
            (found["exact"] != "", exc("exact", "years are beyond early-career")),
        ]
        return first_rule(rules, F.lit(None).cast(RESULT))

    return let(lambda x: let(decided, **{k: F.regexp_extract(x, p, 0) for k, p in EXPERIENCE.items()}), x=text)


def ordinal(title: Column) -> Column:
    """What a roman or numbered level in the title says; null without one."""
    text = F.coalesce(title, F.lit(""))
    roman, level = F.upper(F.regexp_extract(text, ROMAN, 1)), F.regexp_extract(text, LEVEL, 1)
    number = F.when(roman != "", F.when(roman == "I", 1).when(roman == "II", 2).when(roman == "III", 3).otherwise(4)).otherwise(level.try_cast("int"))
    token = F.array(F.when(roman != "", F.regexp_extract(text, ROMAN, 0)).otherwise(F.regexp_extract(text, LEVEL, 0)))
    return (
        F.when(number == 1, result(INCLUDE, "first level", token, "junior")).when(number == 2, result(REVIEW, "second level differs by employer", token)).when(number > 2, result(EXCLUDE, "higher level", token))
    )


def seniority(config: dict, title: Column, description: Column, employment: Column) -> Column:
    """Seniority classifier over include_terms, exclude_terms and max_early_career_years."""
    include, exclude = [str(x) for x in config.get("include_terms") or []], [str(x) for x in config.get("exclude_terms") or []]
    limit = int(config.get("max_early_career_years", 3))
    internship = [x for x in include if plain_normalize(x) in INTERNSHIP_TERMS]

    def decided(t: Column, e: Column, years: Column, level: Column) -> Column:
        too_long = F.coalesce(years["status"] == EXCLUDE, F.lit(False))
        rules = [(any_of(t, exclude), result(EXCLUDE, "title is beyond early-career", padded_matches(t, exclude)))]
        for text, where in ((t, "title"), (e, "employment type")):
            hits = padded_matches(text, include)
            category = F.when(any_of(text, internship), "internship").otherwise("junior")
            rules += [
                (any_of(text, include) & too_long, result(REVIEW, f"{where} is early-career, the years are not", F.concat(hits, years["matched_terms"]))),
                (any_of(text, include), result(INCLUDE, f"{where} is early-career", hits, category)),
            ]
        rules += [(level.isNotNull(), level), (years.isNotNull(), years)]
        return first_rule(rules, result(REVIEW, "nothing tells the seniority"))

    return let(decided, t=padded(title), e=padded(employment), years=experience(description, limit), level=ordinal(title))


def geography(config: dict, location: Column, country: Column, workplace: Column) -> Column:
    """Geography classifier over target_countries, aliases, country_codes, explicitly_excluded_regions,
    explicitly_excluded_countries, known_out_of_scope_countries, out_of_scope_country_codes and included_region_aliases."""
    listed = lambda key: [str(x) for x in config.get(key) or []]
    mapped = lambda key: {str(k): str(v) for k, v in (config.get(key) or {}).items()}
    targets, aliases = listed("target_countries"), mapped("aliases")
    out = listed("explicitly_excluded_countries")
    known: dict[str, str] = {}
    ordered = [{x: x for x in targets}, aliases, mapped("country_codes"), {x: x for x in [*out, *listed("known_out_of_scope_countries")]}, mapped("out_of_scope_country_codes")]
    for names in ordered:
        for name, meant in names.items():
            known.setdefault(plain_normalize(name), meant)
    where = padded(location)
    resolved = F.lit(None).cast("string")
    if known:
        resolved = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), normalize(country))
    hits = F.filter(F.array_distinct(F.array(*[F.when(padded_contains(where, n), F.lit(m)) for n, m in [*((x, x) for x in targets), *aliases.items()]] or [F.lit(None).cast("string")])), lambda x: x.isNotNull())
    outside, regions = [*listed("explicitly_excluded_regions"), *out], listed("included_region_aliases")
    is_given = F.trim(F.coalesce(country, F.lit(""))) != ""
    remote = (normalize(workplace) == "remote") | padded_contains(where, "remote")
    rules = [
        (is_given & resolved.isin(*targets) if targets else F.lit(False), result(INCLUDE, "given country is wanted", F.array(resolved), resolved)),
        (is_given & resolved.isNotNull(), result(EXCLUDE, "given country is known and not wanted", F.array(resolved))),
        (is_given, result(REVIEW, "given country is unknown", F.array(F.trim(country)))),
        (F.size(hits) > 0, result(INCLUDE, "location names a wanted country", hits, F.get(hits, F.lit(0)))),
        (any_of(where, outside), result(EXCLUDE, "location is outside", padded_matches(where, outside))),
        (any_of(where, regions), result(INCLUDE, "location is the whole region", padded_matches(where, regions), "European Union")),
        (remote, result(REVIEW, "remote without a country")),
    ]
    return first_rule(rules, result(REVIEW, "location is not known"))


def combined(*gates: Column) -> Column:
    """EXCLUDE if any gate says so, else REVIEW if any does, else INCLUDE."""
    rank = lambda g: F.when(g["status"] == EXCLUDE, 2).when(g["status"] == REVIEW, 1).otherwise(0)
    worst = F.greatest(*map(rank, gates)) if len(gates) > 1 else rank(gates[0])
    return F.when(worst == 2, EXCLUDE).when(worst == 1, REVIEW).otherwise(INCLUDE)


def vacancy_filter(df, topic_config: dict, seniority_config: dict, geography_config: dict):
    """Add cyber, seniority, geography (audit structs) and filter_status to rows with title, description,
    employment_type, location, country and workplace_type."""
    c = F.col
    gates = df.withColumns(
        {
            "cyber": topic(topic_config, c("title"), c("description"), c("employment_type")),
            "seniority": seniority(seniority_config, c("title"), c("description"), c("employment_type")),
            "geography": geography(geography_config, c("location"), c("country"), c("workplace_type")),
        }
    )
    return gates.withColumn("filter_status", combined(c("cyber"), c("seniority"), c("geography")))


def scores(df, truth: str, guess: str):
    """One row: cases, accuracy, precision and recall of boolean columns."""
    t, g = F.col(truth), F.col(guess)
    hit, said, true = F.count_if(t & g), F.count_if(g), F.count_if(t)
    return df.agg(
        F.count("*").alias("cases"),
        F.round(F.count_if(t == g) / F.count("*"), 6).alias("accuracy"),
        F.round(F.when(said > 0, hit / said).otherwise(0.0), 6).alias("precision"),
        F.round(F.when(true > 0, hit / true).otherwise(0.0), 6).alias("recall"),
    )
