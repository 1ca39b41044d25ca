"""Landed provider payloads: schemas, validation with a reject side, and normalisation to canonical postings.

A page is one JSON document per row. A provider names where its records are, their schema, which fields must be
there, and how each canonical field reads. Adding a provider is adding an entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.stated import employment, workplace
from jobloom.functions.text import fit_location, plain_text

NAME_LIMIT, URL_LIMIT = 255, 2048
# Fixed value: the line that this provider puts under every description.
FOOTER = r"\s*Find (?:more [^\n]{1,40} )?Jobs in [^\n]{1,60} on Arbeitnow\z"
CANONICAL = [
    "company", "title", "description", "location", "workplace_type", "employment_type", "application_url",
    "published_at", "expires_at", "source_key", "source_job_id", "source_url", "raw_payload", "partial_description",
]

c = F.col


# From where on an epoch counts milliseconds, and the last second of the year 9999.
MILLISECONDS_FROM, LAST_SECOND = 2e10, 253402300799
OFFSET = r"(?i)\d\s*(?:z|[+-]\d{2}(?::?\d{2})?)\s*$"


def _instant(x: Column, naive: bool = False) -> Column:
    """An epoch as number or digits, or an ISO date with an offset, or without one where ``naive`` dates mean UTC.

    Epochs from 2e10 on are milliseconds. Null for anything else, a negative epoch, and one after the year 9999.
    """
    text = x.cast("string")
    number = text.try_cast("double")
    seconds = F.when(number < MILLISECONDS_FROM, number).otherwise(number / 1000)
    able = (seconds >= 0) & (seconds <= LAST_SECOND)
    dated = text.try_cast("timestamp")
    told = dated if naive else F.when(F.rlike(text, F.lit(OFFSET)) & F.contains(text, F.lit(":")), dated)
    return F.when(number.isNotNull(), F.when(able, F.timestamp_seconds(seconds))).otherwise(told)


def _place(x: Column) -> Column:
    return fit_location(F.nullif(F.trim(x), F.lit("")), NAME_LIMIT)


@dataclass(frozen=True)
class Provider:
    key: str
    records: str
    schema: str
    required: tuple[str, ...]
    canonical: dict[str, Callable[[], Column]]
    precedence: int = 10
    partial: bool = False
    dates: tuple[str, ...] = ()
    naive: bool = False  # whether dates without an offset are taken, as UTC


PROVIDERS: dict[str, Provider] = {}


def _add(provider: Provider) -> None:
    PROVIDERS[provider.key] = provider


_add(Provider(
    "arbeitnow", "data",
    "slug string, company_name string, title string, description string, remote boolean, url string, tags array<string>, "
    "job_types array<string>, location string, created_at string",
    ("slug", "company_name", "title", "description", "url"),
    {
        "company": lambda: c("company_name"), "title": lambda: c("title"),
        "description": lambda: F.regexp_replace(plain_text(c("description")), FOOTER, ""),
        "location": lambda: _place(c("location")),
        "workplace_type": lambda: workplace(F.when(c("remote"), "remote"), c("location"), F.concat_ws("\n", "tags")),
        "employment_type": lambda: employment(F.concat_ws("\n", "job_types")),
        "application_url": lambda: c("url"), "published_at": lambda: _instant(c("created_at")), "source_job_id": lambda: c("slug"),
    },
    dates=("created_at",),
))
_add(Provider(
    "greenhouse", "jobs",
    "board string, id string, title string, company_name string, content string, absolute_url string, location struct<name:string>, "
    "metadata array<struct<name:string,value:string>>, first_published string, application_deadline string",
    ("board", "id", "title", "company_name", "content", "absolute_url"),
    {
        "company": lambda: c("company_name"), "title": lambda: c("title"), "description": lambda: plain_text(c("content")),
        "location": lambda: _place(c("location.name")),
        "workplace_type": lambda: workplace(_named("workplace type", "workplace", "remote type"), c("location.name")),
        "employment_type": lambda: employment(_named("employment type", "job type", "contract type")),
        "application_url": lambda: c("absolute_url"), "published_at": lambda: _instant(c("first_published")),
        "expires_at": lambda: _instant(c("application_deadline")), "source_job_id": lambda: F.concat(c("board"), F.lit(":"), c("id")),
    },
    precedence=20,
    dates=("first_published", "application_deadline"),
))
_add(Provider(
    "polymer", "items",
    "board string, id string, title string, organization_name string, description string, kind_pretty string, "
    "remoteness_pretty string, display_location string, job_post_url string, published_at string",
    ("board", "id", "title", "organization_name", "description", "job_post_url"),
    {
        "company": lambda: c("organization_name"), "title": lambda: c("title"), "description": lambda: plain_text(c("description")),
        "location": lambda: _place(c("display_location")), "workplace_type": lambda: workplace(c("remoteness_pretty")),
        "employment_type": lambda: employment(c("kind_pretty")), "application_url": lambda: c("job_post_url"),
        "published_at": lambda: _instant(c("published_at")), "source_job_id": lambda: F.concat(c("board"), F.lit(":"), c("id")),
    },
    precedence=20,
    dates=("published_at",),
))
_add(Provider(
    "pinpoint", "data",
    "board string, id string, title string, description string, key_responsibilities string, skills_knowledge_expertise string, "
    "workplace_type string, workplace_type_text string, employment_type string, employment_type_text string, deadline_at string, "
    "url string, location struct<name:string,city:string>",
    ("board", "id", "title", "url"),
    {
        "company": lambda: c("board"), "title": lambda: c("title"),
        "description": lambda: F.array_join(F.filter(F.array(*[F.coalesce(plain_text(c(x)), F.lit("")) for x in (
            "description", "key_responsibilities", "skills_knowledge_expertise")]), lambda s: s != ""), "\n\n"),
        "location": lambda: _place(F.coalesce(F.nullif(c("location.name"), F.lit("")), c("location.city"))),
        "workplace_type": lambda: workplace(c("workplace_type"), c("workplace_type_text")),
        "employment_type": lambda: employment(c("employment_type"), c("employment_type_text")),
        "application_url": lambda: c("url"), "expires_at": lambda: _instant(c("deadline_at")),
        "source_job_id": lambda: F.concat(c("board"), F.lit(":"), c("id")),
    },
    precedence=20,
    dates=("deadline_at",),
))
_add(Provider(
    "jobicy", "jobs",
    "id string, jobTitle string, companyName string, jobDescription string, url string, jobGeo string, jobType string, pubDate string",
    ("id", "jobTitle", "companyName", "jobDescription", "url"),
    {
        "company": lambda: c("companyName"), "title": lambda: c("jobTitle"), "description": lambda: plain_text(c("jobDescription")),
        "location": lambda: _place(F.when(F.lower(F.trim(c("jobGeo"))) != "anywhere", F.regexp_replace(c("jobGeo"), r"\s+", " "))),
        "workplace_type": lambda: F.lit("remote"), "employment_type": lambda: employment(c("jobType")),
        "application_url": lambda: c("url"), "published_at": lambda: _instant(c("pubDate")), "source_job_id": lambda: c("id"),
    },
    dates=("pubDate",),
))
_add(Provider(
    "remotive", "jobs",
    "id string, title string, company_name string, job_type string, publication_date string, candidate_required_location string, "
    "description string, url string",
    ("id", "title", "company_name", "description", "url"),
    {
        "company": lambda: c("company_name"), "title": lambda: c("title"), "description": lambda: plain_text(c("description")),
        "location": lambda: _place(c("candidate_required_location")), "workplace_type": lambda: F.lit("remote"),
        "employment_type": lambda: employment(c("job_type")), "application_url": lambda: c("url"),
        "published_at": lambda: _instant(c("publication_date"), naive=True), "source_job_id": lambda: c("id"),
    },
    dates=("publication_date",),
    naive=True,
))
_add(Provider(
    "himalayas", "jobs",
    "guid string, title string, companyName string, employmentType string, locationRestrictions string, description string, "
    "pubDate string, expiryDate string, applicationLink string",
    ("guid", "title", "companyName", "description", "applicationLink"),
    {
        "company": lambda: c("companyName"), "title": lambda: c("title"), "description": lambda: plain_text(c("description")),
        "location": lambda: _place(F.array_join(_listed(c("locationRestrictions")), ", ")),
        "workplace_type": lambda: F.lit("remote"), "employment_type": lambda: employment(c("employmentType")),
        "application_url": lambda: c("applicationLink"), "published_at": lambda: _instant(c("pubDate")),
        "expires_at": lambda: F.when(_instant(c("expiryDate")) >= F.coalesce(_instant(c("pubDate")), _instant(c("expiryDate"))), _instant(c("expiryDate"))),
        "source_job_id": lambda: c("guid"), "source_url": lambda: c("guid"),
    },
    dates=("pubDate", "expiryDate"),
))
_add(Provider(
    "adzuna", "results",
    "country string, id string, title string, description string, company struct<display_name:string>, location struct<display_name:string>, "
    "redirect_url string, created string, contract_type string, contract_time string",
    ("country", "id", "title", "description", "company.display_name", "redirect_url"),
    {
        "company": lambda: c("company.display_name"), "title": lambda: c("title"), "description": lambda: plain_text(c("description")),
        "location": lambda: F.nullif(c("location.display_name"), F.lit("")), "workplace_type": lambda: F.lit("unspecified"),
        "employment_type": lambda: employment(c("contract_time"), c("contract_type")), "application_url": lambda: c("redirect_url"),
        "published_at": lambda: _instant(c("created")), "source_job_id": lambda: F.concat(c("country"), F.lit(":"), c("id")),
    },
    partial=True,
    dates=("created",),
))


def _named(*names: str) -> Column:
    """Values of the metadata entries with one of ``names``, whatever their case."""
    return F.array_join(F.transform(F.filter("metadata", lambda m: F.lower(F.trim(m["name"])).isin(list(names))), lambda m: m["value"]), "\n")


def _listed(text: Column) -> Column:
    """A field that is null, a string, or a list of strings, as a list."""
    many = F.from_json(text, "array<string>")
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), many).otherwise(F.array_compact(F.array(F.nullif(text, F.lit("")))))


def records(pages: DataFrame, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of ``pages`` (body, and stamps such as board or country).

    A body that is no object, or whose record field is no list, fails as a page. Unknown fields are ignored.
    """
    # Records stay text first: each is then read by the provider's schema and kept as its own payload.
    envelope = F.from_json(c("body"), f"{provider.records} array<string>")
    opened = pages.withColumn("_list", envelope[provider.records])
    bad = opened.where(c("_list").isNull()).select(
        F.lit(provider.key).alias("source_key"), F.lit("page").alias("stage"), F.lit(f"{provider.records}: not a list of records").alias("reason"),
        F.lit(None).cast("string").alias("source_job_id"),
    )
    stamps = [x for x in pages.columns if x != "body"]
    each = opened.where(c("_list").isNotNull()).select(*stamps, F.explode("_list").alias("raw_payload"))
    read = each.withColumn("_r", F.from_json("raw_payload", provider.schema))
    names = [part.split(" ")[0] for part in _fields(provider.schema)]
    out = read.select("raw_payload", *[(F.coalesce(c(f"_r.{n}"), c(n)) if n in stamps else c(f"_r.{n}")).alias(n) for n in names])
    return out, bad


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    out, depth, at = [], 0, 0
    for k, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:k].strip())
            at = k + 1
    return [*out, schema[at:].strip()]


def normalise(pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(postings, failures) of a provider's landed pages. Failures have source_key, stage, reason, source_job_id.

    Reasons name fields and rules, never a provider's data. One record's failure stops nothing else.
    """
    provider = PROVIDERS[key]
    found, bad_pages = records(pages, provider)
    blank = lambda f: F.trim(F.coalesce(c(f), F.lit(""))) == ""
    missing = [F.when(blank(f), F.lit(f"{f}: required")) for f in provider.required]
    unread = [F.when(~blank(f) & _instant(c(f), provider.naive).isNull(), F.lit(f"{f}: no date")) for f in provider.dates]
    checked = found.withColumn("_errors", F.array_compact(F.array(*missing, *unread)))
    own_id = provider.canonical["source_job_id"]()
    id_of = F.when(F.trim(own_id) != "", own_id)
    bad = checked.where(F.size("_errors") > 0).select(
        F.lit(key).alias("source_key"), F.lit("validate").alias("stage"), F.array_join("_errors", "; ").alias("reason"), id_of.alias("source_job_id")
    )
    good = checked.where(F.size("_errors") == 0)
    given = {n: f() for n, f in provider.canonical.items()}
    nothing = F.lit(None)
    postings = good.select(
        *[F.trim(given[n]).alias(n) for n in ("company", "title")], given["description"].alias("description"), given["location"].alias("location"),
        *[given[n].alias(n) for n in ("workplace_type", "employment_type", "application_url")],
        *[given.get(n, nothing).cast("timestamp").alias(n) for n in ("published_at", "expires_at")],
        F.lit(key).alias("source_key"), given["source_job_id"].alias("source_job_id"),
        given.get("source_url", given["application_url"]).alias("source_url"), "raw_payload", F.lit(provider.partial).alias("partial_description"),
    )
    valid, refused = contract(postings)
    return valid, bad_pages.unionByName(bad).unionByName(refused)


def contract(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failures) under the canonical rules: names of 1 to 255 characters, http URLs up to 2048, a text, an
    expiry not before publication."""
    name = lambda n: F.when(~F.length(F.coalesce(c(n), F.lit(""))).between(1, NAME_LIMIT), F.lit(f"{n}: 1 to {NAME_LIMIT} characters"))
    url = lambda n: F.when(~(F.rlike(F.coalesce(c(n), F.lit("")), F.lit("(?i)^https?://[^/\\s]+")) & (F.length(n) <= URL_LIMIT)), F.lit(f"{n}: http URL"))
    errors = F.array_compact(F.array(
        name("company"), name("title"), F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.lit("description: required")),
        F.when(F.length("location") > NAME_LIMIT, F.lit(f"location: {NAME_LIMIT} characters")), url("application_url"), url("source_url"),
        F.when(c("expires_at") < c("published_at"), F.lit("expires_at: before published_at")),
    ))
    checked = postings.withColumn("_errors", errors)
    refused = checked.where(F.size("_errors") > 0).select(
        "source_key", F.lit("normalise").alias("stage"), F.array_join("_errors", "; ").alias("reason"), "source_job_id"
    )
    return checked.where(F.size("_errors") == 0).drop("_errors"), refused


def failure_summary(failures: DataFrame) -> DataFrame:
    """(source_key, total, by_stage, reasons): counts, and the first five distinct reasons in order."""
    stages = failures.groupBy("source_key", "stage").agg(F.count("*").alias("n"))
    by_stage = stages.groupBy("source_key").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("by_stage")
    )
    reasons = failures.select("source_key", "reason").distinct()
    reasons = reasons.groupBy("source_key").agg(F.slice(F.array_sort(F.collect_list("reason")), 1, 5).alias("reasons"))
    return by_stage.join(reasons, "source_key")


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed JSON file: its path and body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of an XML feed: an element per row, its children as fields, attributes under @, namespaces off."""
    return spark.read.format("xml").schema(schema).options(rowTag=row_tag, attributePrefix="@", ignoreNamespace="true", mode="PERMISSIVE").load(path)


def hydrated(listing: DataFrame, detail: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, failures): each listed record with its detail's fields over its own; listed ones without detail fail."""
    extra = [x for x in detail.columns if x not in keys]
    both = listing.alias("l").join(detail.alias("d"), keys)
    fields = [F.coalesce(f"d.{x}", f"l.{x}").alias(x) if x in extra else F.col(f"l.{x}") for x in listing.columns if x not in keys]
    fields += [F.col(f"d.{x}") for x in extra if x not in listing.columns]
    return both.select(*keys, *fields), listing.join(detail.select(*keys), keys, "left_anti")


def within_budget(records: DataFrame, max_records: int = 1000) -> tuple[DataFrame, bool]:
    """(at most ``max_records`` records, whether more were there)."""
    return records.limit(max_records), records.limit(max_records + 1).count() > max_records
