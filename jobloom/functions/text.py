"""Text rules of the job catalogue as column functions.

NFKC and case folding have no native form; ``normal_text`` applies them in one Arrow function. Everything else is
native.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Gender notations, arrangement words, legal forms and measured thresholds of the catalogue's rules.
LETTER_NOTATION = r"(?i)\(\s*[mwfdax](?:\s*[/|]\s*[mwfdax])+\s*\)"
SPELLED_NOTATION = r"(?i)\(\s*(?:all|any)\s+genders?\s*\)"
NON_PLACES = [
    "remote", "hybrid", "onsite", "on site", "home office", "homeoffice", "vor ort", "telearbeit", "flexible",
    "anywhere", "worldwide",
]
LEADING_ARRANGEMENT = "(?i)^(remote|hybrid|onsite|on site)\\s*[-–—]\\s*"
LEGAL_FORMS = [
    "ab", "ag", "aps", "as", "bv", "co", "corp", "corporation", "e", "gbr", "gmbh", "group", "holding", "inc", "kg",
    "limited", "llc", "lp", "ltd", "mbh", "nv", "ohg", "oy", "plc", "sa", "sas", "se", "spa", "srl", "ug", "v",
]
LOCATION_SEPARATORS = (";", ",", "|", " / ", " · ")
MATCH_KEY_VERSION, PART_SEPARATOR = "v2", "\x1f"
MINIMUM_TEXT_OVERLAP = 0.85
MINIMUM_MARKER_LENGTH = 4


@F.pandas_udf(StringType())
def normal_text(values: pd.Series) -> pd.Series:
    """NFKC, case folding, whitespace runs as one space; null stays null."""
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


def normal_title(c: Column) -> Column:
    return normal_text(F.regexp_replace(F.regexp_replace(c, LETTER_NOTATION, " "), SPELLED_NOTATION, " "))


def match_key(company: Column, title: Column) -> Column:
    """Versioned hash of employer and title; the parts can't run into each other."""
    joined = F.concat(normal_text(company), F.lit(PART_SEPARATOR), normal_title(title))
    return F.concat(F.lit(f"{MATCH_KEY_VERSION}:"), F.sha2(joined, 256))


def _foldings() -> dict[str, str]:
    """Characters of which case folding makes ASCII letters and lower-casing doesn't, such as the sharp s."""
    both = {chr(k): chr(k).casefold() for k in range(0x80, 0x10000)}
    return {ch: to for ch, to in both.items() if to != ch.lower() and re.search("[a-z]", to)}


FOLDINGS = _foldings()


def case_folded(c: Column) -> Column:
    """Case folding as far as ASCII letters come of it; other characters are lower-cased."""
    out = c
    for ch, to in FOLDINGS.items():
        out = F.replace(out, F.lit(ch), F.lit(to))
    # None of them is ASCII.
    return F.lower(F.when(F.octet_length(c) == F.length(c), c).otherwise(out))


def city_names(location: Column) -> Column:
    """Sorted distinct cities of a location, in NFKC and case folded: of each entry the first part that names a place.

    Entries are split at semicolons, and at commas too where a part carries its own parentheses.
    """
    entry, part = "\ue000", "\ue001"  # private-use characters, which NFKC leaves alone
    chunks = F.split(F.coalesce(location, F.lit("")), ";", -1)
    entries = F.flatten(F.transform(chunks, lambda x: F.when(F.contains(x, F.lit("(")), F.split(x, ",", -1)).otherwise(F.array(x))))
    tidy = lambda x: F.regexp_replace(F.trim(x), LEADING_ARRANGEMENT, "")
    parts = F.transform(entries, lambda e: F.array_join(F.transform(F.split(F.regexp_replace(e, r"\([^)]*\)", " "), ",", -1), tidy), part))
    plain = normal_text(F.array_join(parts, entry))
    folded_parts = F.transform(F.split(plain, entry, -1), lambda e: F.transform(F.split(e, part, -1), lambda s: F.trim(s)))
    firsts = F.transform(folded_parts, lambda p: F.get(F.filter(p, lambda s: (s != "") & ~s.isin(NON_PLACES)), F.lit(0)))
    return F.array_sort(F.array_distinct(F.array_compact(firsts)))


def same_place(a: Column, b: Column) -> Column:
    """Whether two city arrays agree; a side that names no city agrees with everything."""
    return (F.size(a) == 0) | (F.size(b) == 0) | (a == b)


def vocabulary(text: Column) -> Column:
    """Distinct words in NFKC and case folded; none of a null text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(normal_text(text), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard of two vocabularies without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def blocks(text: Column) -> Column:
    """Non-blank lines without surrounding whitespace."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def folded(block: Column) -> Column:
    """ASCII letters and digits, case folded, between single spaces, padded so that whole words can be looked up."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(case_folded(block), "[^0-9a-z]+", " ")), F.lit(" "))


def employer_marker(employer: Column) -> Column:
    """The first word of an employer's name that is no legal form and has four letters; else empty."""
    parts = F.filter(F.split(F.trim(folded(employer)), " "), lambda w: ~w.isin(LEGAL_FORMS) & (F.length(w) >= MINIMUM_MARKER_LENGTH))
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(""))


def fit_location(c: Column, limit: int = 255) -> Column:
    """A location within ``limit`` code points: cut after the last separator that leaves room for the ellipsis."""
    head = F.left(c, F.lit(limit - 2))
    before = lambda s: F.when(F.contains(head, F.lit(s)), F.length(head) - F.length(F.substring_index(head, s, -1)) - len(s)).otherwise(0)
    last = F.greatest(*map(before, LOCATION_SEPARATORS))
    cut = F.when(last > 0, F.rtrim(F.left(head, last))).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit(" …")))


# Tags that end a line of text.
BLOCK_TAGS = [
    "p", "br", "div", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "blockquote", "nav",
    "h1", "h2", "h3", "h4", "h5", "h6",
]
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>")
_BREAK = re.compile(rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?=[\s/>])[^>]*>")
_TAG = re.compile(r"</?[a-zA-Z][^>]*>")


def _without_markup(value: str) -> str:
    """One layer of markup off: hidden parts first, line ends for block tags, other tags, then entities."""
    seen = html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub("", value))))
    return "\n".join(line for line in (" ".join(raw.split()) for raw in seen.split("\n")) if line)


@F.pandas_udf(StringType())
def plain_text(values: pd.Series) -> pd.Series:
    """Text of markup. Markup that was escaped shows after one layer; so layers come off until nothing changes, ten
    at most."""

    def one(value):
        for _ in range(10):
            before, value = value, _without_markup(value)
            if value == before:
                break
        return value

    return values.map(one, na_action="ignore")


def hosts(text: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Distinct hosts of the absolute URLs in a text, in order, without www, and outside the ignored domains."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"https?://([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1)), lambda h: F.regexp_replace(h, r"^www\.", ""))
    if ignored:
        domains = "|".join(d.replace(".", r"\.") for d in ignored)
        found = F.filter(found, lambda h: ~F.rlike(h, F.lit(rf"(^|\.)({domains})$")))
    return F.array_distinct(found)


def redacted(c: Column) -> Column:
    """URLs without user info, and query secrets without their values."""
    bare = F.regexp_replace(c, r"(https?://)[^/@\s]+@", "$1")
    return F.regexp_replace(bare, r"(?i)([?&](?:app_?key|app_?id|api_?key|token|secret)=)[^&\s]+", "$1***")
