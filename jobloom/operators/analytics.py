"""Market analytics over active postings: skill demand, locations, workplaces, publication trend."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_jobs(
    jobs: DataFrame,
    since: datetime | None = None,
    until: datetime | None = None,
    location: str | None = None,
    listed_by: DataFrame | None = None,
) -> DataFrame:
    """Active postings in the half-open window [since, until), at a raw location, that ``listed_by`` names.

    Any bound drops undated postings. ``listed_by`` holds a job_id column and is applied as a semi join.
    """
    out = jobs.where(F.col("status") == "active")
    if since is not None:
        out = out.where(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("published_at") < F.lit(until).cast("timestamp_ntz"))
    if location is not None:
        out = out.where(F.col("location") == location)
    if listed_by is not None:
        out = out.join(listed_by.select(F.col("job_id").alias("id")), "id", "left_semi")
    return out


def jobs_of_source(provenance: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """job_id of every posting that the source named ``key`` lists."""
    named = sources.where(F.col("key") == key).select("source_id")
    return provenance.join(F.broadcast(named.limit(1)), "source_id", "left_semi").select("job_id")


def skill_demand(jobs: DataFrame, job_skills: DataFrame, limit: int = 20) -> DataFrame:
    """(concept, job_count): the concepts that most of ``jobs`` ask for, ties by name."""
    ids = jobs.select(F.col("id").alias("job_id"))
    return (
        job_skills.join(ids, "job_id", "left_semi")
        .groupBy("concept")
        .agg(F.count("*").alias("job_count"))
        .orderBy(F.desc("job_count"), "concept")
        .limit(limit)
    )


def location_distribution(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """(location, job_count) over trimmed locations; blank and absent ones are Unknown."""
    place = F.coalesce(F.nullif(F.trim("location"), F.lit("")), F.lit("Unknown"))
    return jobs.groupBy(place.alias("location")).agg(F.count("*").alias("job_count")).orderBy(F.desc("job_count"), "location").limit(limit)


def workplace_distribution(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("workplace_type").agg(F.count("*").alias("job_count"))


def posting_trend(jobs: DataFrame, bucket: str) -> DataFrame:
    """(bucket, job_count) by day, week from Monday, or month; undated postings count nowhere, gaps stay gaps."""
    if bucket not in ("day", "week", "month"):
        raise ValueError(f"no such bucket: {bucket}")
    start = F.date_trunc(bucket, "published_at").cast("timestamp_ntz")
    return jobs.where(F.col("published_at").isNotNull()).groupBy(start.alias("bucket")).agg(F.count("*").alias("job_count"))
