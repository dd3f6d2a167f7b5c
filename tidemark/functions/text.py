"""Text functions. Built-in expressions wherever they are exact; pandas functions where Python's Unicode rules matter."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_WORD = r"[^\p{L}\p{N}_]+"
BEYOND_ASCII = r"[^\x00-\x7f]"
#: Entities that the built-in HTML path decodes (fixed values); the exact path knows all of them.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def text_or(value: Column | str, default: str) -> Column:
    """The value, or ``default`` where it is null or empty."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def let(body, **values: Column) -> Column:
    """``body`` over columns that are computed once for each row, however often it names them."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, lambda x: body(*[x[k] for k in values])), F.lit(0))


def normalize_ascii(value: Column) -> Column:
    """Lower case, runs of other than letters, digits and underscore to one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), NOT_WORD, " "))


def exact_where(pattern: str, value: Column, exact, plain) -> Column:
    """``exact`` for values that match, which alone go through Python, and ``plain`` for all others."""
    odd = F.coalesce(value, F.lit("")).rlike(pattern)
    return F.when(odd, exact(F.when(odd, value))).otherwise(plain(value))


def normalize(value: Column) -> Column:
    """NFKC, case folded, runs of other than word characters to one space, trimmed; null gives ''.

    Built-in functions do so for ASCII; other texts take one Arrow pass.  Inside higher-order functions, where Python
    can't go, ``normalize_ascii`` stands in.
    """
    return exact_where(BEYOND_ASCII, value, normalize_exact, normalize_ascii)


def plain_normalize(value: str | None) -> str:
    """The exact normal form: NFKC, casefold, runs of non-word characters to one space."""
    folded = unicodedata.normalize("NFKC", value or "").casefold()
    return " ".join(re.sub(r"\W+", " ", folded).split())


@F.pandas_udf(T.StringType())
def normalize_exact(values: pd.Series) -> pd.Series:
    return values.map(plain_normalize, na_action="ignore")


def contains_term(normalized: Column, term: str) -> Column:
    """Whether the normalized text holds the term's words side by side; a blank term is in no text."""
    return padded_contains(F.concat(F.lit(" "), normalized, F.lit(" ")), term)


def padded_contains(padded: Column, term: str) -> Column:
    """contains_term for a normalized text that already has a space at both ends."""
    words = plain_normalize(term)
    return padded.contains(f" {words} ") if words else F.lit(False)


def matched_terms(normalized: Column, terms) -> Column:
    """The terms found, in their order."""
    return padded_matches(F.concat(F.lit(" "), normalized, F.lit(" ")), terms)


def padded_matches(padded: Column, terms) -> Column:
    """matched_terms for a normalized text that already has a space at both ends."""
    terms = [t for t in terms if plain_normalize(t)]
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(padded_contains(padded, t), F.lit(t)) for t in terms]), lambda t: t.isNotNull())


def unescape(value: Column) -> Column:
    for name, sign in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value


def html_to_text(value: Column) -> Column:
    """Decoded text without tags, white space collapsed; tags go only if both < and > occur."""
    decoded = unescape(F.coalesce(value, F.lit("")))
    bare = unescape(F.regexp_replace(decoded, r"<[^>]*>", " "))
    return collapse(F.when(decoded.contains("<") & decoded.contains(">"), bare).otherwise(decoded))


def strip_tags(value: Column) -> Column:
    """Tags to spaces, collapsed and trimmed; entities stay."""
    return collapse(F.regexp_replace(F.coalesce(value, F.lit("")), r"<[^>]+>", " "))


class _Text(HTMLParser):
    """Text nodes without those of scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def text_nodes(markup: str) -> list[str]:
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return parser.parts


def plain_html_to_text(value: str | None) -> str:
    text = html.unescape(value or "")
    if "<" in text and ">" in text:
        text = html.unescape(" ".join(text_nodes(text)))
    return " ".join(text.split())


def plain_display(value: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", plain_html_to_text(value)).split())


def plain_title(value: str | None) -> str:
    return plain_normalize(plain_display(value))


def plain_location(value: str | None) -> str:
    return " | ".join(sorted({plain_normalize(x) for x in (value or "").split("|") if x.strip()}))


def plain_lines(value: str | None) -> str:
    """Text by lines: collapsed, blank ones dropped, and a line that repeats the one before it dropped."""
    out: list[str] = []
    for line in "\n".join(text_nodes(html.unescape(value or ""))).splitlines():
        line = " ".join(line.split())
        if line and (not out or out[-1] != line):
            out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def html_to_text_exact(values: pd.Series) -> pd.Series:
    return values.map(plain_html_to_text)


@F.pandas_udf(T.StringType())
def display_text(values: pd.Series) -> pd.Series:
    return values.map(plain_display)


@F.pandas_udf(T.StringType())
def normalize_title_exact(values: pd.Series) -> pd.Series:
    return values.map(plain_title, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_location_exact(values: pd.Series) -> pd.Series:
    return values.map(plain_location, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_lines(values: pd.Series) -> pd.Series:
    return values.map(plain_lines)


def normalize_title(value: Column) -> Column:
    """The normal form of the text without markup; exact for markup, entities and other than ASCII."""
    return exact_where(r"[^\x00-\x7f]|[&<>]", value, normalize_title_exact, normalize_ascii)


def normalize_location(value: Column) -> Column:
    """Parts between bars: normalized, distinct, sorted, joined by ' | '."""

    def plain(v: Column) -> Column:
        parts = F.filter(F.split(F.coalesce(v, F.lit("")), r"\|"), lambda p: F.trim(p) != "")
        return F.array_join(F.array_sort(F.array_distinct(F.transform(parts, normalize_ascii))), " | ")

    return exact_where(BEYOND_ASCII, value, normalize_location_exact, plain)


def clean_lines(value: Column) -> Column:
    """Collapsed lines without blanks, as an array."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "\n"), collapse), lambda x: x != "")


def distinct_lines(value: Column) -> Column:
    """Collapsed lines without blanks and without repeats of the line before."""
    lines = clean_lines(value)
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.element_at(lines, F.when(i == 0, F.lit(1)).otherwise(i)))), "\n")


def all_lines(value: Column) -> Column:
    """Collapsed lines without blanks; repeated ones stay."""
    return F.array_join(clean_lines(value), "\n")


def join_sections(sections: Column, clean=distinct_lines) -> Column:
    """Sections that are not blank once each has been put through ``clean``, without exact repeats, with a blank line
    between."""
    return F.array_join(F.array_distinct(F.filter(F.transform(sections, clean), lambda s: s != "")), "\n\n")


def bounded(value: Column, limit: int, mark: str = "\n[...]\n") -> Column:
    """A long text as its first two thirds and last third of ``limit`` around a mark."""
    head = limit * 2 // 3
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.left(value, F.lit(head)), F.lit(mark), F.right(value, F.lit(limit - head))))


def model_json(value: Column) -> Column:
    """JSON object text out of a model's answer: code fences and a leading 'json' go, anything but an object is null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?i)^json\s*(?=\{)", ""))
    return F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare)


def common_prefix(names: Column) -> Column:
    """Leading words that all names share, letters compared without case, in the first name's spelling."""
    words = F.filter(F.transform(names, lambda n: F.filter(F.split(F.trim(n), r"\s+"), lambda w: w != "")), lambda w: F.size(w) > 0)
    first = F.element_at(words, 1)

    def shared(_, i):
        return F.forall(words, lambda w: F.lower(F.coalesce(F.get(w, i), F.lit(""))) == F.lower(F.get(first, i)))

    flags = F.transform(first, shared)
    count = F.coalesce(F.nullif(F.array_position(flags, False), F.lit(0)) - 1, F.size(first).cast("long"))
    return F.when(F.size(words) == 0, "").otherwise(F.array_join(F.slice(first, F.lit(1), count.cast("int")), " "))
