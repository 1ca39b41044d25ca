"""Work arrangements and employment kinds that a text names outright; silence is never read as an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases in two languages, and the order in which the more specific kind wins.
WORKPLACES = {
    "remote": "remote", "fully remote": "remote", "home office": "remote", "homeoffice": "remote",
    "telearbeit": "remote", "hybrid": "hybrid", "teilweise remote": "hybrid", "on site": "onsite",
    "onsite": "onsite", "in office": "onsite", "vor ort": "onsite", "präsenz": "onsite",
}
EMPLOYMENTS = {
    "full time": "full_time", "fulltime": "full_time", "vollzeit": "full_time", "part time": "part_time",
    "parttime": "part_time", "teilzeit": "part_time", "contract": "contract", "contractor": "contract",
    "freelance": "contract", "internship": "internship", "intern": "internship", "praktikum": "internship",
    "working student": "internship", "werkstudent": "internship", "temporary": "temporary", "temp": "temporary",
    "fixed term": "temporary", "befristet": "temporary",
}
WORKPLACE_ORDER = ["hybrid", "remote", "onsite"]
EMPLOYMENT_ORDER = ["internship", "temporary", "contract", "part_time", "full_time"]


def stated(text: Column, phrases: dict[str, str], order: list[str]) -> Column:
    """The most specific kind that ``text`` names by a whole phrase, longest phrases first; else unspecified."""
    words = "|".join(p.replace(" ", r"[\s_-]+") for p in sorted(phrases, key=lambda p: (-len(p), p)))
    pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"
    hits = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    kinds = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    named = F.transform(hits, lambda h: F.try_element_at(kinds, F.trim(F.regexp_replace(h, r"[\s_-]+", " "))))
    out = F.lit("unspecified")
    for kind in reversed(order):
        out = F.when(F.array_contains(named, kind), kind).otherwise(out)
    return out


def workplace(*texts: Column) -> Column:
    return stated(F.concat_ws("\n", *texts), WORKPLACES, WORKPLACE_ORDER)


def employment(*texts: Column) -> Column:
    return stated(F.concat_ws("\n", *texts), EMPLOYMENTS, EMPLOYMENT_ORDER)
