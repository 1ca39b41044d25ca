"""The job listing: filters, keyset pages, opaque cursors, details with their sources."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 100
CURSOR_VERSION = "1"


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the last row's date, or none in the undated tail, and its id."""

    published_at: datetime | None
    id: str

    def encode(self) -> str:
        stamp = self.published_at.isoformat() if self.published_at else ""
        return base64.urlsafe_b64encode(f"{CURSOR_VERSION}|{stamp}|{self.id}".encode()).decode().rstrip("=")

    @staticmethod
    def decode(token: str) -> Cursor:
        """Strict: wrong alphabet, version, field count or date is a ValueError."""
        try:
            raw = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True).decode()
        except (binascii.Error, UnicodeDecodeError) as wrong:
            raise ValueError("not a cursor") from wrong
        fields = raw.split("|")
        if len(fields) != 3 or fields[0] != CURSOR_VERSION or not fields[2]:
            raise ValueError("not a cursor of this version")
        return Cursor(datetime.fromisoformat(fields[1]) if fields[1] else None, fields[2])


def _following(jobs: DataFrame, after: Cursor | None) -> DataFrame:
    """The rows after the cursor by date descending, undated last, then id descending."""
    if after is not None:
        date, key = F.col("published_at"), F.col("id")
        last_id = F.lit(after.id).cast(jobs.schema["id"].dataType)
        if after.published_at is None:
            jobs = jobs.where(date.isNull() & (key < last_id))
        else:
            at = F.lit(after.published_at).cast("timestamp_ntz")
            jobs = jobs.where(date.isNull() | (date < at) | ((date == at) & (key < last_id)))
    return jobs.orderBy(F.desc_nulls_last("published_at"), F.desc("id"))


def _checked(size: int) -> int:
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page size must be within 1 and {MAX_PAGE}")
    return size


def title_contains(jobs: DataFrame, needle: str) -> DataFrame:
    """Literal, case-insensitive substring; no character is a wildcard."""
    return jobs.where(F.contains(F.lower("title"), F.lower(F.lit(needle))))


def any_of(jobs: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Membership; an empty list is no filter."""
    return jobs.where(F.col(column).isin(values)) if values else jobs


def listed_by(jobs: DataFrame, provenance: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``jobs`` that the source ``key`` lists now. An unknown key is a ValueError: no answer isn't an empty one."""
    source = sources.where(F.col("key") == key).select("source_id")
    if source.isEmpty():
        raise ValueError(f"unknown source: {key}")
    ids = provenance.where(~F.col("retired")).join(source, "source_id", "left_semi").select(F.col("job_id").alias("id"))
    return jobs.join(ids, "id", "left_semi")


def page(jobs: DataFrame, size: int = 20, after: Cursor | None = None) -> DataFrame:
    """``size`` rows after the cursor by date descending, undated last, then id descending."""
    return _following(jobs, after).limit(_checked(size))


def page_and_cursor(jobs: DataFrame, size: int = 20, after: Cursor | None = None) -> tuple[list, str | None]:
    """The rows of a page and the token of the next one, if there is one."""
    rows = _following(jobs, after).limit(_checked(size) + 1).collect()  # a row more than the page, at its cap too
    more, rows = len(rows) > size, rows[:size]
    return rows, Cursor(rows[-1]["published_at"], str(rows[-1]["id"])).encode() if more else None


def with_sources(jobs: DataFrame, provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """``jobs`` with ``sources``: the keys that list each job and when they first saw it, in key order."""
    seen = provenance.join(F.broadcast(sources.select("source_id", "key")), "source_id")
    seen = seen.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    lists = seen.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("key", "first_seen_at"))).alias("sources"))
    return jobs.join(lists, jobs["id"] == lists["job_id"], "left").drop("job_id")


# What a reader sees of a job in a list, and once it is open.
ON_CARD = ("id", "company", "title", "excerpt", "location", "workplace_type", "employment_type", "application_url", "published_at", "sources")
ON_PAGE = ("id", "company", "title", "description", "location", "workplace_type", "employment_type", "application_url", "published_at", "expires_at", "status", "sources")


def shown(jobs: DataFrame, companies: DataFrame, provenance: DataFrame, sources: DataFrame, whole: bool = False) -> DataFrame:
    """``jobs`` as a reader sees them: the company nested, an excerpt (or the ``whole`` posting), and the sources' attributions.

    ``companies`` has (id, display_name, website_url), ``provenance`` (job_id, source_id, source_url), ``sources`` (source_id,
    key, display_name). Attributions are structs of key, display_name and url, in that order; neither a provider's own ids
    nor the times of ingestion are shown. Defined cases: a job of an unknown company has a null one; one without accounts
    has an empty list; repeated accounts are told once.
    """
    firm = companies.select(F.col("id").alias("_firm"), F.struct("id", "display_name", "website_url").alias("company"))
    told = provenance.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").join(sources, "source_id")
    told = told.select(F.col("job_id").alias("_job"), F.struct("key", "display_name", F.col("source_url").alias("url")).alias("told"))
    lists = told.groupBy("_job").agg(F.array_sort(F.collect_set("told")).alias("_sources"))
    met = jobs.join(firm, F.col("company_id") == F.col("_firm"), "left").join(lists, F.col("id") == F.col("_job"), "left")
    met = met.withColumn("sources", F.coalesce("_sources", F.array().cast(lists.schema["_sources"].dataType)))
    return met.select(*ON_PAGE) if whole else met.withColumn("excerpt", excerpt(F.col("description"))).select(*ON_CARD)


def latest_per(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in ``order``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def excerpt(text, limit: int = 200):
    """Non-blank lines joined by spaces, cut at the last space within ``limit`` code points and closed by an ellipsis."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    flat = F.array_join(lines, " ")
    head = F.left(flat, F.lit(limit))
    back = F.instr(F.reverse(head), " ")
    cut = F.when((F.substring(flat, limit + 1, 1) == " ") | (back == 0), head).otherwise(F.left(head, F.length(head) - back))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))
