"""Queries over websites of companies, landed pages, uploads, retention, and what a reader sees of a job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobloom.functions.sites import is_public_url
from jobloom.operators import cvs as V
from jobloom.operators import discovery as D
from jobloom.operators import lifecycle as C
from jobloom.operators import listing as L
from jobloom.plans.registry import query
from jobloom.session import table
from jobloom.sources import bindings as B
from jobloom.sources import landing

NOW, BUDGET = datetime(1997, 6, 1), 100
_AT = "TIMESTAMP '1997-06-01'"
_PLATFORMS = " AND ".join(f"host <> '{h}' AND NOT ends_with(host, '.{h}')" for h in D.PLATFORM_HOSTS)

_WEBSITES = rf"""WITH firms AS (SELECT c_custkey AS company_id, c_name AS display_name, CASE WHEN c_custkey % 5 = 0 THEN 'https://held.example/' END AS website_url,
  CASE WHEN c_custkey % 5 = 0 THEN 'source' END AS website_source, CASE c_custkey % 4 WHEN 0 THEN TIMESTAMP '1997-05-01' WHEN 1 THEN TIMESTAMP '1996-01-01' END AS website_checked_at FROM customer),
due AS (SELECT * FROM firms WHERE website_url IS NULL AND (website_checked_at IS NULL OR website_checked_at < {_AT} - INTERVAL 90 DAYS)),
looked AS (SELECT company_id, display_name FROM due LEFT JOIN (SELECT o_custkey, count(*) AS jobs FROM orders GROUP BY 1) ON o_custkey = company_id
  ORDER BY coalesce(jobs, 0) DESC, display_name LIMIT {BUDGET}),
payloads AS (SELECT page_id, page_id % 150 AS company_id, lower(url || ' https://www.github.com/x ' || CASE WHEN page_id % 3 = 0 THEN 'http://Firm' || page_id % 150 || '.example/a' ELSE '' END) AS payload FROM pages),
named AS (SELECT DISTINCT page_id, company_id, regexp_replace(unnest(regexp_extract_all(payload, 'https?://([a-z0-9.-]+\.[a-z]{{2,}})', 1)), '^www\.', '') AS host FROM payloads),
votes AS (SELECT company_id, host, count(*) AS n FROM named WHERE {_PLATFORMS} GROUP BY 1, 2),
best AS (SELECT company_id, 'https://' || max(host) || '/' AS url FROM votes v WHERE n = (SELECT max(n) FROM votes w WHERE w.company_id = v.company_id) GROUP BY company_id HAVING count(*) = 1 AND max(n) >= 2),
entities AS (SELECT s_suppkey * 3 % 150 AS company_id, CASE WHEN s_suppkey % 4 <> 1 THEN 'CUSTOMER#' || lpad((s_suppkey * 3 % 150)::VARCHAR, 9, '0') || ' GmbH' ELSE s_name END AS label, s_suppkey % 6 <> 5 AS business,
  'https://e' || s_suppkey || '.example' AS website FROM supplier),
sole AS (SELECT company_id, max(website) AS url FROM entities JOIN looked USING (company_id) WHERE business AND label = upper(display_name) || ' GmbH' GROUP BY company_id HAVING count(*) = 1),
found AS (SELECT company_id, coalesce(b.url, o.url) AS url, CASE WHEN b.url IS NOT NULL THEN 'postings' WHEN o.url IS NOT NULL THEN 'wikidata' END AS how
  FROM looked LEFT JOIN best b USING (company_id) LEFT JOIN sole o USING (company_id))"""


def _websites(spark, sf_dir):
    """Customers as companies, their orders as jobs, pages as payloads and suppliers as what a search for a company gives."""
    n, page, of = F.col("c_custkey"), F.col("page_id"), F.col("s_suppkey") * 3 % 150
    held = lambda v: F.when(n % 5 == 0, v)
    at = F.when(n % 4 == 0, F.lit(datetime(1997, 5, 1)).cast("timestamp_ntz")).when(n % 4 == 1, F.lit(datetime(1996, 1, 1)).cast("timestamp_ntz"))
    firms = table(spark, sf_dir, "customer").select(
        n.alias("company_id"), F.col("c_name").alias("display_name"), held("https://held.example/").alias("website_url"), held("source").alias("website_source"), at.alias("website_checked_at")
    )
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.count("*").alias("job_count"))
    own = F.when(page % 3 == 0, F.concat(F.lit("http://Firm"), page % 150, F.lit(".example/a"))).otherwise("")
    payloads = table(spark, sf_dir, "pages").select((page % 150).alias("company_id"), F.concat_ws(" ", "url", F.lit("https://www.github.com/x"), own).alias("payload"))
    label = F.when(F.col("s_suppkey") % 4 != 1, F.concat(F.lit("CUSTOMER#"), F.lpad(of.cast("string"), 9, "0"), F.lit(" GmbH"))).otherwise(F.col("s_name"))
    entities = table(spark, sf_dir, "supplier").select(
        of.alias("company_id"), label.alias("label"), (F.col("s_suppkey") % 6 != 5).alias("business"), F.concat(F.lit("https://e"), "s_suppkey", F.lit(".example")).alias("website")
    )
    return D.resolve_websites(firms, jobs, payloads, entities, NOW, BUDGET)


@query(
    f"""{_WEBSITES} SELECT company_id, display_name, coalesce(website_url, url) AS website_url, coalesce(how, website_source) AS website_source,
  CASE WHEN f.company_id IS NOT NULL THEN {_AT} ELSE website_checked_at END AS website_checked_at FROM firms LEFT JOIN found f USING (company_id)"""
)
def website_run(spark, sf_dir):
    """Companies after a run that looked for the websites of those that are due."""
    return _websites(spark, sf_dir)[0]


@query(
    f"""{_WEBSITES} SELECT (SELECT count(*) FROM due) AS seeded, count(*) AS processed, count(*) FILTER (how = 'postings') AS postings, count(*) FILTER (how = 'wikidata') AS wikidata,
  count(*) FILTER (how IS NULL) AS unresolved, (SELECT count(*) FROM due) > count(*) AS stopped_at_budget FROM found"""
)
def website_run_summary(spark, sf_dir):
    """How many companies were due, looked at and resolved by which evidence."""
    return _websites(spark, sf_dir)[1]


MOST = 6
_LANDED = """WITH RECURSIVE numbered AS (SELECT user_id AS scan, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, event_id, event_type, ts FROM events),
landed AS (SELECT scan, page, event_type = 'error' AND event_id % 2 = 0 AS failed, event_id % 9 <> 4 AS more, event_id % 50 AS records FROM numbered WHERE event_id % 31 <> 7),
walk AS (SELECT *, 1 AS depth FROM landed WHERE page = 1
  UNION ALL SELECT l.*, w.depth + 1 FROM walk w JOIN landed l ON l.scan = w.scan AND l.page = w.page + 1 WHERE NOT w.failed AND w.more AND w.depth < {most}),
ends AS (SELECT scan, count(*) FILTER (NOT failed) AS pages, coalesce(sum(records) FILTER (NOT failed), 0)::BIGINT AS records, arg_max(CASE WHEN failed THEN 'failed' WHEN NOT more THEN 'complete'
  WHEN depth = {most} THEN '{bound}' ELSE 'failed' END, depth) AS outcome FROM walk GROUP BY scan),
told AS (SELECT DISTINCT user_id AS scan FROM events)"""


def _landed(spark, sf_dir):
    """An event for every landed page of its user's scan; some pages never landed."""
    events = table(spark, sf_dir, "events")
    e, nth = F.col("event_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pages = events.withColumn("page", nth).where(e % 31 != 7).select(
        F.col("user_id").alias("scan"), "page", F.col("ts").alias("landed_at"), ((F.col("event_type") == "error") & (e % 2 == 0)).alias("failed"),
        (e % 9 != 4).alias("more"), (e % 50).alias("records"),
    )
    return pages, events.select(F.col("user_id").alias("scan"))


@query(
    _LANDED.format(most=MOST, bound="stopped_at_bound")
    + " SELECT scan, coalesce(pages, 0) AS pages, coalesce(records, 0) AS records, coalesce(outcome, 'failed') AS outcome, coalesce(outcome = 'complete', false) AS reached_the_end FROM told LEFT JOIN ends USING (scan)"
)
def source_scans(spark, sf_dir):
    """How far the walk over each source's landed pages came."""
    return landing.scans(*_landed(spark, sf_dir), most=MOST)


@query(
    _LANDED.format(most=MOST, bound="failed")
    + """ SELECT scan, CASE WHEN outcome = 'complete' THEN pages ELSE 0 END AS pages, CASE WHEN outcome = 'complete' THEN records ELSE 0 END AS records,
  coalesce(outcome, 'failed') AS outcome, coalesce(outcome = 'complete', false) AS reached_the_end FROM told LEFT JOIN ends USING (scan)"""
)
def board_scans(spark, sf_dir):
    """As for sources, but a board that isn't read to its end gives nothing."""
    return landing.scans(*_landed(spark, sf_dir), most=MOST, whole=True)


_NAME = "CASE page_id % 6 WHEN 0 THEN 'cv-' || page_id || '.pdf' WHEN 1 THEN url WHEN 2 THEN 'Lebenslauf.v' || page_id || '.PDF' WHEN 3 THEN ' cv.pdf' WHEN 4 THEN 'été.pdf' ELSE '.pdf' END"
_TYPE = "CASE WHEN page_id % 7 = 3 THEN 'text/html' WHEN page_id % 7 <> 5 THEN 'application/pdf' END"
_HEAD = "CASE WHEN page_id % 5 = 0 THEN substr(html, 1, 8) ELSE '%PDF-1.7' END"


@query(
    f"""SELECT page_id, CASE WHEN NOT coalesce(regexp_matches(name, '^.+\\.pdf$', 'i') AND NOT contains(name, '/') AND name = trim(name), false) THEN 'invalid_filename'
  WHEN size < 1 THEN 'empty_file' WHEN size > 5242880 THEN 'file_too_large' WHEN type IS DISTINCT FROM 'application/pdf' THEN 'unsupported_media_type'
  WHEN NOT coalesce(starts_with(head, '%PDF-'), false) THEN 'unsupported_content' END AS refusal
FROM (SELECT page_id, {_NAME} AS name, {_TYPE} AS type, {_HEAD} AS head, CASE WHEN page_id % 11 = 0 THEN 0 ELSE page_id * 7919 % 6000000 + 1 END AS size FROM pages)"""
)
def upload_refusals(spark, sf_dir):
    """Pages as uploads of every kind of fault."""
    size = F.expr("CASE WHEN page_id % 11 = 0 THEN 0 ELSE page_id * 7919 % 6000000 + 1 END")
    refusal = V.upload_refusal(F.expr(_NAME), F.expr(_TYPE), size, F.encode(F.expr(_HEAD), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", refusal.alias("refusal"))


_CVS = "WITH cvs AS (SELECT user_id AS owner_id, event_id AS cv_id, date_trunc('hour', ts) AS created_at FROM events), kept AS (SELECT * FROM cvs WHERE cv_id % 3 = 0)"


def _cvs(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("cv_id"), hour.alias("created_at"))


@query(
    f"""{_CVS} SELECT c.owner_id, c.cv_id, c.created_at FROM cvs c JOIN (SELECT owner_id, max((created_at, cv_id)) AS mark FROM kept GROUP BY 1) USING (owner_id)
WHERE (created_at, cv_id) < mark AND cv_id % 3 <> 0"""
)
def cvs_superseded(spark, sf_dir):
    """Uploads that a later kept one of the owner replaces."""
    cvs = _cvs(spark, sf_dir)
    return V.superseded(cvs, cvs.where("cv_id % 3 = 0").select("owner_id", "cv_id"))


@query(f"{_CVS} SELECT owner_id, arg_max(cv_id, (created_at, cv_id)) AS cv_id FROM cvs GROUP BY owner_id")
def newest_cv_per_owner(spark, sf_dir):
    return L.latest_per(_cvs(spark, sf_dir), "owner_id", F.desc("created_at"), F.desc("cv_id")).select("owner_id", "cv_id")


_URL = """CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://user@') WHEN 2 THEN 'http://10.0.0.' || page_id % 200 || '/x' WHEN 3 THEN 'https://db.internal/' || page_id
  WHEN 4 THEN 'https://firm.example:' || (page_id % 3 * 363 + 80) || '/a' WHEN 5 THEN 'ftp://firm.example/' WHEN 6 THEN 'https://localhost' ELSE upper(url) END"""


@query(
    f"""SELECT page_id, coalesce(lower(split_part(url, '://', 1)) IN ('http', 'https') AND NOT contains(host, '@') AND NOT regexp_matches(host, '^[0-9.]+$') AND host <> 'localhost' AND NOT ends_with(host, '.internal')
  AND regexp_extract(place, ':(.*)$', 1) IN ('', '80', '443') AND host <> '', false) AS public
FROM (SELECT page_id, url, place, lower(split_part(place, ':', 1)) AS host FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS place FROM (SELECT page_id, {_URL} AS url FROM pages)))"""
)
def public_urls(spark, sf_dir):
    """Which URLs may be looked at at all."""
    return table(spark, sf_dir, "pages").select("page_id", is_public_url(F.expr(_URL)).alias("public"))


_KEPT = f"""{B.with_tables("jobs", "job_provenance")}, posts AS (SELECT *, title || ' of ' || company_id AS description, 'https://jobs.example/' || id AS application_url FROM jobs),
probes AS (SELECT l_orderkey AS job_id FROM lineitem WHERE l_linenumber = 7 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity = 50),
gone AS (SELECT id, id IN (SELECT job_id FROM probes) AS named FROM jobs WHERE status IN ('expired', 'removed') AND updated_at < {_AT} - INTERVAL 30 DAYS
  AND id NOT IN (SELECT job_id FROM job_provenance WHERE NOT retired))"""


def _kept(spark, sf_dir):
    """Ended jobs, referenced by two probes of other tables."""
    lines = table(spark, sf_dir, "lineitem")
    probe = lambda keep: lines.where(keep).select(F.col("l_orderkey").alias("job_id"))
    jobs = B.jobs(spark, sf_dir).withColumns(
        {"description": F.concat_ws(" of ", "title", "company_id"), "application_url": F.concat(F.lit("https://jobs.example/"), "id")}
    )
    accounts = B.job_provenance(spark, sf_dir).withColumn("raw_payload", F.to_json(F.struct("stated")))
    actions = C.retention(jobs, accounts, probe("l_linenumber = 7").unionByName(probe("l_quantity = 50")), NOW)
    return C.retained(jobs, accounts, actions, NOW)


@query(
    f"""{_KEPT} SELECT id, status, updated_at, CASE WHEN named THEN 'Posting no longer available' ELSE description END AS description, CASE WHEN named IS NULL THEN location END AS location,
  CASE WHEN named THEN '' ELSE application_url END AS application_url, CASE WHEN named THEN {_AT} END AS anonymised_at FROM posts LEFT JOIN gone USING (id) WHERE named IS DISTINCT FROM false"""
)
def retained_jobs(spark, sf_dir):
    """Jobs after retention: purged ones are gone, referenced ones say nothing any more."""
    return _kept(spark, sf_dir)[0].select("id", "status", "updated_at", "description", "location", "application_url", "anonymised_at")


@query(
    f"""{_KEPT} SELECT job_id, source_id, CASE WHEN named THEN '{{"_anonymised_at":"1997-06-01T00:00:00"}}' ELSE '{{"stated":' || stated || '}}' END AS raw_payload
FROM job_provenance LEFT JOIN gone ON id = job_id WHERE named IS DISTINCT FROM false"""
)
def retained_accounts(spark, sf_dir):
    """The accounts that retention leaves, and what they still hold."""
    return _kept(spark, sf_dir)[1].select("job_id", "source_id", "raw_payload")


_SHOWN = f"""{B.with_tables("jobs", "job_provenance")}, told AS (SELECT DISTINCT job_id, s_name AS key, s_name || ' jobs' AS display_name, 'https://s.example/' || job_id || '/' || source_id AS url
  FROM job_provenance JOIN supplier ON s_suppkey = source_id),
lists AS (SELECT job_id, string_agg(key || '=' || display_name || '@' || url, ';' ORDER BY key, url) AS sources FROM told GROUP BY 1),
seen AS (SELECT j.*, c_name AS company FROM jobs j LEFT JOIN customer ON c_custkey = company_id)"""


def _shown(spark, sf_dir, whole):
    posts = B.jobs(spark, sf_dir).withColumns(
        {"description": F.concat(F.lit(" "), "title", F.lit("\n\nof "), "company_id"), "employment_type": F.lit("unspecified"), "application_url": F.concat(F.lit("https://jobs.example/"), "id")}
    )
    firms = B.companies(spark, sf_dir).select("id", "display_name", F.lit(None).cast("string").alias("website_url"))
    boards = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("key"), F.concat("s_name", F.lit(" jobs")).alias("display_name"))
    accounts = B.job_provenance(spark, sf_dir).withColumn("source_url", F.concat_ws("/", F.lit("https://s.example"), "job_id", "source_id"))
    out = L.shown(posts, firms, accounts, boards, whole)
    flat = F.array_join(F.transform("sources", lambda s: F.concat(s["key"], F.lit("="), s["display_name"], F.lit("@"), s["url"])), ";")
    return out.withColumns({"company": F.col("company.display_name"), "sources": flat})


@query(f"{_SHOWN} SELECT id, company, title, title || ' of ' || company_id AS excerpt, location, coalesce(sources, '') AS sources FROM seen LEFT JOIN lists ON job_id = id")
def job_cards(spark, sf_dir):
    """Every job as a list shows it, its nested fields written out."""
    return _shown(spark, sf_dir, False).select("id", "company", "title", "excerpt", "location", "sources")


@query(
    f"{_SHOWN} SELECT id, company, ' ' || title || chr(10) || chr(10) || 'of ' || company_id AS description, expires_at, status, coalesce(sources, '') AS sources FROM seen LEFT JOIN lists ON job_id = id"
)
def job_pages(spark, sf_dir):
    """Every job as it shows once it is open."""
    return _shown(spark, sf_dir, True).select("id", "company", "description", "expires_at", "status", "sources")
