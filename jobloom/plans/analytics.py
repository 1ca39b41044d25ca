"""Analytics and listing queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from jobloom.operators import analytics as A
from jobloom.operators import listing as L
from jobloom.plans.registry import query
from jobloom.session import table
from jobloom.sources import bindings as B

SINCE, UNTIL = datetime(1995, 1, 1), datetime(1997, 1, 1)
_WINDOW = "published_at >= TIMESTAMP '1995-01-01' AND published_at < TIMESTAMP '1997-01-01'"
_DEMAND = "SELECT concept, count(*) AS job_count FROM job_skills WHERE job_id IN (SELECT id FROM jobs WHERE {0}) GROUP BY concept ORDER BY job_count DESC, concept LIMIT 20"


@query(f"{B.with_tables('jobs', 'job_skills')} {_DEMAND.format('status = ' + chr(39) + 'active' + chr(39))}")
def skill_demand_topk(spark, sf_dir):
    return A.skill_demand(A.active_jobs(B.jobs(spark, sf_dir)), B.job_skills(spark, sf_dir))


@query(f"{B.with_tables('jobs', 'job_skills')} " + _DEMAND.format(f"status = 'active' AND {_WINDOW}"))
def skill_demand_window(spark, sf_dir):
    return A.skill_demand(A.active_jobs(B.jobs(spark, sf_dir), SINCE, UNTIL), B.job_skills(spark, sf_dir))


@query(
    f"{B.with_tables('jobs', 'job_skills', 'job_sources', 'job_provenance')} "
    + _DEMAND.format(
        "status = 'active' AND id IN (SELECT job_id FROM job_provenance JOIN job_sources USING (source_id) WHERE key = 'Supplier#000000007')"
    )
)
def skill_demand_source_filtered(spark, sf_dir):
    listed = A.jobs_of_source(B.job_provenance(spark, sf_dir), B.job_sources(spark, sf_dir), "Supplier#000000007")
    return A.skill_demand(A.active_jobs(B.jobs(spark, sf_dir), listed_by=listed), B.job_skills(spark, sf_dir))


@query(
    f"{B.with_tables('jobs')} SELECT coalesce(nullif(trim(location), ''), 'Unknown') AS location, count(*) AS job_count FROM jobs "
    "WHERE status = 'active' GROUP BY 1 ORDER BY job_count DESC, location LIMIT 20"
)
def location_distribution(spark, sf_dir):
    return A.location_distribution(A.active_jobs(B.jobs(spark, sf_dir)))


@query(f"{B.with_tables('jobs')} SELECT workplace_type, count(*) AS job_count FROM jobs WHERE status = 'active' GROUP BY 1")
def workplace_distribution(spark, sf_dir):
    return A.workplace_distribution(A.active_jobs(B.jobs(spark, sf_dir)))


def _trend(bucket: str) -> str:
    return (
        f"{B.with_tables('jobs')} SELECT date_trunc('{bucket}', published_at)::TIMESTAMP AS bucket, count(*) AS job_count FROM jobs "
        "WHERE status = 'active' AND published_at IS NOT NULL GROUP BY 1"
    )


@query(_trend("day"))
def posting_trend_day(spark, sf_dir):
    return A.posting_trend(A.active_jobs(B.jobs(spark, sf_dir)), "day")


@query(_trend("week"))
def posting_trend_week(spark, sf_dir):
    return A.posting_trend(A.active_jobs(B.jobs(spark, sf_dir)), "week")


@query(_trend("month"))
def posting_trend_month(spark, sf_dir):
    return A.posting_trend(A.active_jobs(B.jobs(spark, sf_dir)), "month")


_PAGE = "SELECT id, title, published_at FROM jobs WHERE status = 'active'{0} ORDER BY published_at DESC NULLS LAST, id DESC LIMIT {1}"
_LISTED = ["id", "title", "published_at"]


@query(f"{B.with_tables('jobs')} " + _PAGE.format("", 20))
def listing_first_page(spark, sf_dir):
    return L.page(A.active_jobs(B.jobs(spark, sf_dir)), 20).select(*_LISTED)


@query(
    f"{B.with_tables('jobs')} "
    + _PAGE.format(
        " AND (published_at IS NULL OR published_at < TIMESTAMP '1996-06-01' OR (published_at = TIMESTAMP '1996-06-01' AND id < 5000))", 50
    )
)
def listing_after_cursor(spark, sf_dir):
    return L.page(A.active_jobs(B.jobs(spark, sf_dir)), 50, L.Cursor(datetime(1996, 6, 1), "5000")).select(*_LISTED)


@query(f"{B.with_tables('jobs')} " + _PAGE.format(" AND published_at IS NULL AND id < 5000", 50))
def listing_undated_tail(spark, sf_dir):
    return L.page(A.active_jobs(B.jobs(spark, sf_dir)), 50, L.Cursor(None, "5000")).select(*_LISTED)


@query(f"{B.with_tables('jobs')} SELECT id, title FROM jobs WHERE status = 'active' AND contains(lower(title), 'urg')")
def listing_title_contains(spark, sf_dir):
    return L.title_contains(A.active_jobs(B.jobs(spark, sf_dir)), "Urg").select("id", "title")


@query(f"{B.with_tables('jobs')} SELECT id, company_id FROM jobs WHERE status = 'active' AND company_id = 7")
def listing_company_filter(spark, sf_dir):
    return A.active_jobs(B.jobs(spark, sf_dir)).where("company_id = 7").select("id", "company_id")


@query(f"{B.with_tables('jobs')} SELECT id, workplace_type FROM jobs WHERE status = 'active' AND workplace_type IN ('remote', 'hybrid')")
def listing_enum_filter(spark, sf_dir):
    return L.any_of(A.active_jobs(B.jobs(spark, sf_dir)), "workplace_type", ["remote", "hybrid"]).select("id", "workplace_type")


@query(
    f"{B.with_tables('jobs', 'job_sources', 'job_provenance')} SELECT id, title, "
    "string_agg(key, ',' ORDER BY key) AS sources, min(first_seen_at) AS first_seen_at FROM jobs "
    "JOIN job_provenance ON job_id = id JOIN job_sources USING (source_id) WHERE status = 'active' GROUP BY id, title"
)
def job_detail_with_sources(spark, sf_dir):
    jobs = A.active_jobs(B.jobs(spark, sf_dir))
    out = L.with_sources(jobs, B.job_provenance(spark, sf_dir), B.job_sources(spark, sf_dir)).where("sources is not null")
    return out.select(
        "id", "title", F.array_join(F.transform("sources", lambda s: s["key"]), ",").alias("sources"),
        F.array_min(F.transform("sources", lambda s: s["first_seen_at"])).alias("first_seen_at"),
    )


@query(
    "SELECT event_type AS source_key, event_id AS run_id, ts AS started_at FROM "
    "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"
)
def latest_run_per_source(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_key"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))
    return L.latest_per(runs, "source_key", F.desc("started_at"), F.desc("run_id"))


@query(
    "SELECT segment, id, display_name FROM (SELECT c_mktsegment AS segment, c_custkey AS id, c_name AS display_name, "
    "row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n = 1"
)
def oldest_company_per_name(spark, sf_dir):
    return L.latest_per(B.companies(spark, sf_dir), "segment", F.asc("id")).select("segment", "id", "display_name")


@query(
    "SELECT source AS vocabulary, doc_id AS version FROM (SELECT source, doc_id, "
    "row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1"
)
def newest_alias_version(spark, sf_dir):
    versions = table(spark, sf_dir, "documents").select(F.col("source").alias("vocabulary"), F.col("doc_id").alias("version"), "n_chars")
    return L.latest_per(versions, "vocabulary", F.desc("n_chars"), F.desc("version")).select("vocabulary", "version")


@query(
    f"{B.with_tables('jobs')} SELECT c_custkey AS company_id, count(id)::BIGINT AS job_count FROM customer LEFT JOIN jobs ON company_id = c_custkey GROUP BY 1"
)
def employer_job_counts_left(spark, sf_dir):
    counts = B.jobs(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n"))
    firms = B.companies(spark, sf_dir).select(F.col("id").alias("company_id"))
    return firms.join(counts, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("job_count"))


@query(
    """SELECT doc_id, CASE WHEN length(flat) <= 200 THEN flat ELSE rtrim(CASE
  WHEN substr(flat, 201, 1) = ' ' OR instr(reverse(flat[1:200]), ' ') = 0 THEN flat[1:200]
  ELSE flat[1:200 - instr(reverse(flat[1:200]), ' ')] END, ' ') || '…' END AS excerpt
FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS flat FROM documents)"""
)
def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", L.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) = 3")
def json_flag_containment(spark, sf_dir):
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k = 3")
