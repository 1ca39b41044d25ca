"""Queries over the life of postings, ownership, upserts and ledgers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from jobloom.operators import lifecycle as C
from jobloom.operators import ownership, upserts
from jobloom.plans.registry import query
from jobloom.session import table
from jobloom.sources import bindings as B

NOW = datetime(1997, 6, 1)
_AT = "TIMESTAMP '1997-06-01'"
_TABLES = B.with_tables("jobs", "job_provenance")


@query(f"{_TABLES} SELECT id, status FROM jobs WHERE id NOT IN (SELECT job_id FROM job_provenance WHERE NOT retired)")
def jobs_nobody_lists(spark, sf_dir):
    return C.unlisted(B.jobs(spark, sf_dir), B.job_provenance(spark, sf_dir)).select("id", "status")


@query(
    f"""{_TABLES} SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'anonymise' ELSE 'purge' END AS action
FROM jobs WHERE status IN ('expired', 'removed') AND updated_at < {_AT} - INTERVAL 30 DAYS AND id NOT IN (SELECT job_id FROM job_provenance WHERE NOT retired)"""
)
def retention_split(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("job_id"))
    return C.retention(B.jobs(spark, sf_dir), B.job_provenance(spark, sf_dir), refs, NOW)


@query(
    f"""{_TABLES} SELECT CASE WHEN status = 'active' AND expires_at < {_AT} THEN 'expired' ELSE status END AS status, count(*) AS jobs,
  max(CASE WHEN status = 'active' AND expires_at < {_AT} THEN {_AT} ELSE updated_at END) AS updated_at FROM jobs GROUP BY 1"""
)
def expire_past_date(spark, sf_dir):
    return C.expire(B.jobs(spark, sf_dir), NOW).groupBy("status").agg(F.count("*").alias("jobs"), F.max("updated_at").alias("updated_at"))


def _reconciled(cutoff: str) -> str:
    return f"""{_TABLES}, after AS (SELECT *, NOT retired AND source_id = 3 AND last_seen_at < {cutoff} AS now FROM job_provenance),
gone AS (SELECT job_id FROM after GROUP BY 1 HAVING bool_or(now) AND bool_and(retired OR now))
SELECT id, CASE WHEN status = 'active' AND id IN (SELECT job_id FROM gone) THEN 'removed' ELSE status END AS status FROM jobs"""


@query(_reconciled(_AT))
def reconcile_exhausted(spark, sf_dir):
    return C.reconcile(B.jobs(spark, sf_dir), B.job_provenance(spark, sf_dir), 3, NOW)[1].select("id", "status")


@query(_reconciled("TIMESTAMP '1995-06-01'"))
def reconcile_aged(spark, sf_dir):
    return C.reconcile(B.jobs(spark, sf_dir), B.job_provenance(spark, sf_dir), 3, datetime(1995, 6, 1))[1].select("id", "status")


_ACCOUNTS = f"{B.with_tables('job_sources', 'job_provenance')}, accounts AS (SELECT * FROM job_provenance JOIN job_sources USING (source_id))"


def _accounts(spark, sf_dir):
    return B.job_provenance(spark, sf_dir).join(B.job_sources(spark, sf_dir), "source_id")


@query(
    f"""{_ACCOUNTS}, topped AS (SELECT *, max(CASE WHEN NOT retired THEN precedence END) OVER (PARTITION BY job_id) AS top FROM accounts)
SELECT job_id, max(top) AS owner_rank, min(first_seen_at) FILTER (NOT retired AND precedence = top) AS owner_first_seen,
  bool_and(partial) FILTER (NOT retired AND precedence = top) AS owner_partial, max(stated) FILTER (NOT retired AND precedence = top) AS owner_stated,
  bool_or(NOT partial) AS has_full_text FROM topped GROUP BY job_id"""
)
def owner_summary(spark, sf_dir):
    return ownership.owner_summary(_accounts(spark, sf_dir))


@query(
    f"""{_ACCOUNTS}, topped AS (SELECT *, max(CASE WHEN NOT retired THEN precedence END) OVER (PARTITION BY job_id) AS top FROM accounts),
owners AS (SELECT job_id, max(top) AS r, min(first_seen_at) FILTER (NOT retired AND precedence = top) AS fs,
  bool_and(partial) FILTER (NOT retired AND precedence = top) AS p, max(stated) FILTER (NOT retired AND precedence = top) AS st,
  bool_or(NOT partial) AS has_full FROM topped GROUP BY job_id)
SELECT job_id, source_id, CASE WHEN partial AND coalesce(has_full, false) THEN false WHEN r IS NULL THEN true
  WHEN precedence <> r THEN precedence > r WHEN partial <> p THEN p WHEN stated <> st THEN stated > st ELSE first_seen_at < fs END AS wins
FROM accounts JOIN owners USING (job_id)"""
)
def merge_outcome(spark, sf_dir):
    """Whether each account, arriving again, would win a contested field."""
    accounts = _accounts(spark, sf_dir)
    both = accounts.join(ownership.owner_summary(accounts), "job_id")
    wins = ownership.outranks(*map(F.col, ("precedence", "partial", "stated", "first_seen_at")))
    return both.select("job_id", "source_id", wins.alias("wins"))


@query(
    f"""{_ACCOUNTS}, told AS (SELECT a.*, CASE WHEN (job_id + source_id) % 3 = 0 THEN 'unspecified' WHEN (job_id + source_id) % 3 = 1 THEN 'remote' ELSE 'onsite' END AS workplace FROM accounts a)
SELECT job_id, arg_min(workplace, (partial, -precedence, -stated, first_seen_at, source_id)) FILTER (workplace <> 'unspecified') AS workplace FROM told GROUP BY job_id"""
)
def merged_workplace(spark, sf_dir):
    slot = (F.col("job_id") + F.col("source_id")) % 3
    told = _accounts(spark, sf_dir).withColumn("workplace", F.when(slot == 0, "unspecified").when(slot == 1, "remote").otherwise("onsite"))
    return ownership.merged_fields(told, ["workplace"])


_HALF = """SELECT l_orderkey AS job_id, l_suppkey AS source_id, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at,
  max(CASE WHEN l_quantity > 40 THEN l_returnflag END) AS payload, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS retired_at
FROM lineitem WHERE l_linenumber {0} GROUP BY 1, 2"""


@query(
    f"""WITH s AS ({_HALF.format('<= 4')}), n AS ({_HALF.format('> 3')})
SELECT job_id, source_id, least(s.first_seen_at, n.first_seen_at) AS first_seen_at, greatest(s.last_seen_at, n.last_seen_at) AS last_seen_at,
  coalesce(n.payload, s.payload) AS payload, CASE WHEN n.first_seen_at IS NULL THEN s.retired_at END AS retired_at
FROM s FULL JOIN n USING (job_id, source_id)"""
)
def provenance_upsert(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def half(keep):
        return lines.where(keep).groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("source_id")).agg(
            F.min("l_shipdate").alias("first_seen_at"), F.max("l_shipdate").alias("last_seen_at"),
            F.max(F.when(F.col("l_quantity") > 40, F.col("l_returnflag"))).alias("payload"),
            F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("retired_at"),
        )

    return upserts.upsert_provenance(half("l_linenumber <= 4"), half("l_linenumber > 3"))


@query(
    """SELECT p_name, p_brand, 'missing' AS side FROM (SELECT p_name, p_brand FROM part WHERE p_size > 10 EXCEPT ALL SELECT p_name, p_brand FROM part WHERE p_size < 40)
UNION ALL SELECT p_name, p_brand, 'unexpected' FROM (SELECT p_name, p_brand FROM part WHERE p_size < 40 EXCEPT ALL SELECT p_name, p_brand FROM part WHERE p_size > 10)"""
)
def publication_diff(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = lambda keep: parts.where(keep).select("p_name", "p_brand")
    return upserts.publication_diff(rows("p_size < 40"), rows("p_size > 10"))


_RUNS = """WITH polls AS (SELECT user_id AS board, ts, event_id, event_type = 'error' AS failed FROM events),
runs AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY board ORDER BY ts, event_id) AS s FROM polls),
last AS (SELECT board, max(s) AS s, count(*) AS polls FROM runs GROUP BY 1),
tail AS (SELECT board, s, count(*) FILTER (failed) AS n FROM runs GROUP BY 1, 2)
SELECT board, polls, n AS consecutive_failures, CASE WHEN n >= 3 THEN 'inactive' ELSE 'confirmed' END AS status FROM last JOIN tail USING (board, s)"""


@query(_RUNS)
def board_lifecycle(spark, sf_dir):
    polls = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("board"), F.col("ts").alias("at"), F.col("event_id").alias("poll_id"), (F.col("event_type") == "error").alias("failed")
    )
    return C.board_standing(polls)


@query(
    """SELECT event_type AS source, ts::DATE AS day, count(*) AS calls, sum(CASE WHEN n <= 5 THEN 1 ELSE 0 END)::BIGINT AS admitted
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events) GROUP BY 1, 2"""
)
def quota_gate(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"))
    out = C.quota_admitted(calls, 5)
    return out.groupBy("source", F.to_date("at").alias("day")).agg(F.count("*").alias("calls"), F.count_if("admitted").alias("admitted"))


@query(
    """SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS attempts, greatest(count(*) - 3, 0) AS refused
FROM events GROUP BY 1, 2"""
)
def throttle_windows(spark, sf_dir):
    return C.attempts_allowed(table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("at")), 3, 3600)
