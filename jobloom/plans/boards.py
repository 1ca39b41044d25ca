"""Queries over the registry of boards: what probes register and what polls make of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import boards as R
from jobloom.plans.registry import query
from jobloom.session import table

STATUSES = ("confirmed", "named", "inactive", "candidate", "not_found", "blocked", "wrong_company", "unreachable", "confirmed")
KINDS = ("provider_name", "site_title", "operator", "unverified", None)
ANSWERS = ("confirmed", "unverifiable", "not_found", "named", "wrong_company", "unreachable")
NAMED = ("confirmed", "named", "wrong_company", None)


def _pick(values, at):
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def _boards(spark, sf_dir):
    """A board for every supplier, held by one of forty companies."""
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), n).alias("slug"), _pick(STATUSES, n % 9).alias("status"), F.when(n % 13 != 0, n % 40).alias("company_id"),
        _pick(KINDS, n % 5).alias("kind"), (n % 11 == 0).alias("pinned"), (n % 4).cast("int").alias("failures"),
    )


def _registered(spark, sf_dir):
    """A probe for every part; some companies claim one slug, and some visits name another board."""
    n = F.col("p_partkey")
    probes = table(spark, sf_dir, "part").select(
        n.alias("probe"), (n * 7 % 40).alias("company_id"), F.concat(F.lit("s"), n * 13 % 150).alias("slug"), _pick(ANSWERS, n * 31 % 23 % 6).alias("answer"),
        F.concat(F.lit("s"), (n * 17 + 5) % 150).alias("other_slug"), _pick(NAMED, F.floor(n / 3) % 4).alias("other_answer"),
    )
    return R.register(probes, _boards(spark, sf_dir))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_ROW = "STRUCT(status VARCHAR, company_id BIGINT, kind VARCHAR, pinned BOOLEAN, failures BIGINT)"
_TOWARD = """CASE WHEN {0}.status IN ('blocked', 'wrong_company') OR ({0}.status IN ('confirmed', 'named') AND {0}.company_id <> company_id) THEN 'shut'
    WHEN coalesce({0}.pinned, false) THEN 'pinned' WHEN {0}.status IN ('confirmed', 'named') AND {0}.company_id = company_id THEN 'trusted'
    WHEN {0}.status = 'inactive' THEN 'asleep' ELSE 'open' END"""
_BOARDS = f"""boards AS (SELECT 's' || s_suppkey AS slug, ({_list(STATUSES)})[s_suppkey % 9 + 1] AS status, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey % 40 END AS company_id,
  ({_list(KINDS)})[s_suppkey % 5 + 1] AS kind, s_suppkey % 11 = 0 AS pinned, (s_suppkey % 4)::BIGINT AS failures FROM supplier)"""
# Every probe is one step, which reads the rows of its two slugs from the map of all rows and writes them back.
_WALK = f"""WITH RECURSIVE {_BOARDS},
probes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_partkey AS probe, p_partkey * 7 % 40 AS company_id, 's' || (p_partkey * 13 % 150) AS slug,
  ({_list(ANSWERS)})[p_partkey * 31 % 23 % 6 + 1] AS answer, 's' || ((p_partkey * 17 + 5) % 150) AS other_slug, ({_list(NAMED)})[(p_partkey // 3) % 4 + 1] AS other_answer FROM part),
start AS (SELECT map(list(slug), list({{'status': status, 'company_id': company_id, 'kind': kind, 'pinned': pinned, 'failures': failures}}::{_ROW})) AS m FROM boards),
walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS probe, ''::VARCHAR AS outcome, m FROM start
  UNION ALL
  SELECT k, probe, CASE WHEN told2 IN ('', 'unchanged') THEN told1 WHEN answer = 'unverifiable' THEN told2 WHEN told2 = 'reactivated' THEN 'located_reactivated' ELSE 'located' END,
    CASE WHEN new2 IS NULL THEN CASE WHEN new1 IS NULL THEN m ELSE map_concat(m, map([slug], [new1])) END ELSE map_concat(m, map([slug, other_slug], [new1, new2])) END
  FROM (SELECT *, CASE WHEN NOT goes THEN '' WHEN t2 IN ('shut', 'pinned') THEN 'unchanged' WHEN t2 = 'asleep' AND other_answer = 'confirmed' THEN 'reactivated' ELSE other_answer END AS told2,
    CASE WHEN goes AND t2 NOT IN ('shut', 'pinned') THEN {{'status': other_answer, 'company_id': company_id, 'kind': CASE other_answer WHEN 'named' THEN 'site_title' ELSE 'provider_name' END,
      'pinned': false, 'failures': CASE WHEN t2 = 'asleep' AND other_answer = 'confirmed' THEN 0 ELSE coalesce(r2.failures, 0) END}}::{_ROW} END AS new2
  FROM (SELECT *, {_TOWARD.format("r2")} AS t2,
    t1 NOT IN ('shut', 'pinned') AND other_answer IS NOT NULL AND other_slug <> slug AND (answer = 'unverifiable' OR answer = 'not_found' AND t1 <> 'trusted') AS goes,
    CASE WHEN t1 = 'shut' THEN 'unchanged' WHEN t1 = 'pinned' THEN 'pinned_reported'
      WHEN t1 = 'trusted' THEN CASE WHEN answer IN ('confirmed', 'named') THEN 'reverified' WHEN answer IN ('wrong_company', 'unverifiable') THEN 'demoted' ELSE 'unchanged' END
      WHEN t1 = 'asleep' AND answer = 'confirmed' THEN 'reactivated' WHEN t1 = 'asleep' AND answer = 'named' THEN 'named_reactivated' ELSE answer END AS told1,
    CASE WHEN t1 NOT IN ('shut', 'pinned') THEN {{
      'status': CASE WHEN t1 = 'trusted' AND answer IN ('not_found', 'unreachable', 'named') THEN r1.status
        WHEN answer = 'unverifiable' THEN CASE WHEN t1 = 'trusted' AND r1.kind IN ('site_title', 'provider_name') THEN 'named' ELSE 'candidate' END ELSE answer END,
      'company_id': company_id,
      'kind': CASE WHEN t1 = 'trusted' AND answer IN ('not_found', 'unreachable') THEN r1.kind WHEN answer IN ('confirmed', 'wrong_company') THEN 'provider_name'
        WHEN answer = 'named' THEN 'site_title' WHEN answer = 'unverifiable' THEN 'unverified' ELSE answer END,
      'pinned': false, 'failures': CASE WHEN t1 = 'asleep' AND answer IN ('confirmed', 'named') THEN 0 ELSE coalesce(r1.failures, 0) END}}::{_ROW} END AS new1
  FROM (SELECT *, {_TOWARD.format("r1")} AS t1 FROM (
    SELECT p.*, w.m, w.m[p.slug] AS r1, w.m[p.other_slug] AS r2 FROM walk w JOIN probes p ON p.k = w.k + 1)))))"""


@query(f"{_WALK} SELECT probe, outcome FROM walk WHERE k > 0")
def board_registration(spark, sf_dir):
    """What became of every probe."""
    return _registered(spark, sf_dir)[0]


@query(
    f"""{_WALK}
SELECT e.key AS slug, e.value.status AS status, e.value.company_id AS company_id, e.value.kind AS kind, e.value.pinned AS pinned, e.value.failures::INTEGER AS failures
FROM (SELECT unnest(map_entries(m)) AS e FROM walk WHERE k = (SELECT max(k) FROM walk))"""
)
def board_rows_after(spark, sf_dir):
    """The registry's rows after all probes."""
    return _registered(spark, sf_dir)[1]


@query(
    f"""{_WALK}, names AS (SELECT unnest(CASE outcome WHEN 'named_reactivated' THEN ['reactivated', 'named'] WHEN 'located' THEN ['located', 'not_found']
  WHEN 'located_reactivated' THEN ['located', 'not_found', 'reactivated'] ELSE [outcome] END) AS tally FROM walk WHERE k > 0)
SELECT {", ".join(f"count(*) FILTER (tally = '{t}') AS {t}" for t in R.TALLIES)} FROM names"""
)
def board_tallies(spark, sf_dir):
    """The twelve tallies of the run."""
    return R.tallied(_registered(spark, sf_dir)[0])


_POLLS = "polls AS (SELECT 's' || (user_id % 140) AS slug, ts, event_id, event_type = 'error' OR event_id % 3 = 0 AS failed FROM events)"


@query(
    f"""WITH RECURSIVE {_BOARDS}, {_POLLS},
queue AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY ts, event_id) AS k FROM polls JOIN boards USING (slug)),
steps AS (SELECT slug, 0::BIGINT AS k, status, failures FROM boards
  UNION ALL
  SELECT q.slug, q.k, CASE WHEN NOT q.failed THEN CASE WHEN s.status <> 'inactive' THEN s.status WHEN q.pinned OR (q.kind <> 'operator' AND q.company_id IS NOT NULL) THEN 'confirmed' ELSE 'candidate' END
    WHEN s.failures + 1 >= 3 AND NOT q.pinned THEN 'inactive' ELSE s.status END, CASE WHEN q.failed THEN s.failures + 1 ELSE 0 END
  FROM steps s JOIN queue q ON q.slug = s.slug AND q.k = s.k + 1)
SELECT slug, max(k) AS polls, arg_max(failures, k) AS failures, arg_max(status, k) AS status FROM steps GROUP BY slug HAVING max(k) > 0"""
)
def board_poll_standing(spark, sf_dir):
    """Polls of registered boards: failures, pins and what evidence brings back."""
    polls = table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id") % 140).alias("slug"), F.col("ts").alias("at"), F.col("event_id").alias("poll_id"),
        ((F.col("event_type") == "error") | (F.col("event_id") % 3 == 0)).alias("failed"),
    )
    return R.after_polls(polls, _boards(spark, sf_dir))


_DECIDED = "(['pin', 'block', 'unblock', 'other'])[event_id % 4 + 1]"


@query(
    f"""WITH RECURSIVE {_BOARDS}, queue AS MATERIALIZED (SELECT 's' || (user_id % 130) AS slug, {_DECIDED} AS decision, row_number() OVER (PARTITION BY user_id % 130 ORDER BY event_id) AS k FROM events WHERE event_id % 7 = 0),
steps AS (SELECT slug, 0::BIGINT AS k, status, company_id, kind, pinned, failures FROM (SELECT slug FROM boards UNION SELECT slug FROM queue) LEFT JOIN boards USING (slug)
  UNION ALL
  SELECT s.slug, q.k, CASE decision WHEN 'pin' THEN 'confirmed' WHEN 'block' THEN 'blocked' WHEN 'unblock' THEN CASE WHEN s.status IS NOT NULL THEN 'candidate' END ELSE s.status END,
    s.company_id, CASE WHEN decision IN ('pin', 'block') THEN 'operator' ELSE s.kind END, CASE decision WHEN 'pin' THEN true WHEN 'block' THEN false ELSE s.pinned END,
    CASE WHEN decision = 'pin' THEN 0 WHEN decision = 'block' THEN coalesce(s.failures, 0) ELSE s.failures END
  FROM steps s JOIN queue q ON q.slug = s.slug AND q.k = s.k + 1)
SELECT slug, status, company_id, kind, pinned, failures::INTEGER AS failures FROM steps WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY k DESC) = 1"""
)
def board_decisions(spark, sf_dir):
    """The registry after an operator pinned, blocked and unblocked boards."""
    names = F.array(*map(F.lit, ("pin", "block", "unblock", "other")))
    events = table(spark, sf_dir, "events").where("event_id % 7 = 0")
    decisions = events.select(F.concat(F.lit("s"), F.col("user_id") % 130).alias("slug"), F.col("event_id").alias("at"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("decision"))
    return R.decided(_boards(spark, sf_dir), decisions)
