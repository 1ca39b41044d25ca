"""Queries over the outcomes of a run's records, the ledger of runs, and candidate profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import persist as P
from jobloom.operators import profiles
from jobloom.plans.identity import one_by_one
from jobloom.plans.registry import query
from jobloom.session import table
from jobloom.sources import bindings as B

FIELDS = ["location", "workplace_type"]
DECISIONS = (P.NEW, P.CHANGED, P.UNCHANGED, P.AMBIGUOUS, P.CHANGED)

_FIELD = """CASE WHEN failed THEN s.{0} WHEN decision = 'new' THEN r.{0} WHEN decision <> 'changed' THEN s.{0}
    WHEN r.{0} IS NULL OR r.{0} = 'unspecified' THEN s.{0} WHEN s.{0} IS NULL OR s.{0} = 'unspecified' THEN r.{0} WHEN wins THEN r.{0} ELSE s.{0} END AS {0}"""
_OUTCOMES = f"""{B.with_tables("jobs")}, told AS (
  SELECT l_orderkey * 10 + l_linenumber AS record_id, l_suppkey % 9 <> 0 AS own, l_quantity > 25 AS wins,
    (['new', 'changed', 'unchanged', 'ambiguous', 'changed'])[(l_orderkey + l_linenumber) % 5 + 1] AS decision, l_orderkey AS about,
    CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS location,
    (['onsite', 'hybrid', 'remote', 'unspecified'])[l_partkey % 4 + 1] AS workplace_type FROM lineitem),
r AS (SELECT *, NOT own OR decision = 'ambiguous' AS failed, CASE WHEN decision IN ('changed', 'unchanged') THEN about END AS job_id FROM told),
merged AS (SELECT record_id, s.id AS job_id, decision, failed, s.status AS was, s.location AS old_location, s.workplace_type AS old_workplace,
    {_FIELD.format("location")}, {_FIELD.format("workplace_type")} FROM r LEFT JOIN jobs s ON r.job_id = s.id),
outcomes AS (SELECT record_id, job_id, failed, location, workplace_type,
    CASE WHEN failed THEN 'skipped' WHEN decision = 'new' THEN 'created'
      WHEN decision = 'changed' AND (location IS DISTINCT FROM old_location OR workplace_type IS DISTINCT FROM old_workplace) THEN 'updated' ELSE 'skipped' END AS outcome,
    CASE WHEN failed THEN was WHEN decision = 'new' OR was = 'removed' THEN 'active' ELSE was END AS status FROM merged)"""


def _outcomes(spark, sf_dir):
    """Every line of an order as a record about that order's job; one supplier in nine is another source."""
    number = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    records = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        F.when(F.col("l_suppkey") % 9 != 0, "ours").otherwise("theirs").alias("source_key"),
        F.get(F.array(*map(F.lit, DECISIONS)), number.cast("int")).alias("decision"),
        F.col("l_orderkey").alias("job_id"),
        (F.col("l_quantity") > 25).alias("wins"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("location"),
        F.get(F.array(*map(F.lit, ("onsite", "hybrid", "remote", "unspecified"))), (F.col("l_partkey") % 4).cast("int")).alias("workplace_type"),
    )
    return P.persist_outcomes(records, B.jobs(spark, sf_dir), FIELDS, "ours")


@query(f"{_OUTCOMES} SELECT record_id, job_id, outcome, failed, status, location, workplace_type FROM outcomes")
def persist_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(
    f"""{_OUTCOMES} SELECT status, count(*) AS fetched, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (failed) AS failed FROM outcomes GROUP BY status"""
)
def run_tally(spark, sf_dir):
    return P.run_tally(_outcomes(spark, sf_dir), "status")


_TOLD = f"""{B.with_tables("jobs").replace("WITH", "WITH RECURSIVE", 1)}, held AS (SELECT * FROM jobs WHERE id % 3 <> 0), told AS (
  SELECT l_orderkey * 10 + l_linenumber AS record_id, round(l_extendedprice * 100)::BIGINT AS arrival, l_quantity > 25 AS wins,
    CASE WHEN l_suppkey % 9 <> 0 AND l_linenumber <> 6 THEN l_orderkey END AS job_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS location,
    (['onsite', 'hybrid', 'remote', 'unspecified'])[l_partkey % 4 + 1] AS workplace_type FROM lineitem),
live AS (SELECT * FROM told WHERE job_id IS NOT NULL), {one_by_one(FIELDS)}"""


def _run(spark, sf_dir):
    """The lines of an order as records about its job, in the order of their prices; a third of the jobs isn't stored yet."""
    records = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("arrival"),
        F.when(F.col("l_suppkey") % 9 != 0, "ours").otherwise("theirs").alias("source_key"),
        F.when(F.col("l_linenumber") != 6, F.col("l_orderkey")).alias("job_id"),
        (F.col("l_quantity") > 25).alias("wins"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("location"),
        F.get(F.array(*map(F.lit, ("onsite", "hybrid", "remote", "unspecified"))), (F.col("l_partkey") % 4).cast("int")).alias("workplace_type"),
    )
    jobs = B.jobs(spark, sf_dir).where("id % 3 <> 0")
    return P.fold_run(records, jobs, FIELDS, "ours"), jobs


@query(
    f"""{_TOLD} SELECT record_id, job_id, decision, outcome, false AS failed, location, workplace_type FROM steps WHERE k > 0
UNION ALL SELECT record_id, NULL, NULL, 'skipped', true, NULL, NULL FROM told WHERE job_id IS NULL"""
)
def run_folded(spark, sf_dir):
    return _run(spark, sf_dir)[0].drop("arrival", "nth")


@query(
    f"""{_TOLD} SELECT s.job_id AS id, CASE WHEN coalesce(h.status, 'removed') = 'removed' THEN 'active' ELSE h.status END AS status, s.location, s.workplace_type
FROM steps s LEFT JOIN held h ON h.id = s.job_id WHERE s.k > 0 QUALIFY row_number() OVER (PARTITION BY s.job_id ORDER BY s.k DESC) = 1"""
)
def run_jobs_after(spark, sf_dir):
    folded, jobs = _run(spark, sf_dir)
    return P.jobs_after(folded, jobs, FIELDS)


@query(
    """SELECT user_id AS run_id, ts AS at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS state
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,
  event_type IN ('error', 'purchase') DESC, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END DESC) = 1"""
)
def run_ledger(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind == "error", "failed").when(kind == "purchase", "completed").otherwise("running")
    return P.run_ledger(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), state.alias("state")))


@query(
    f"""{B.with_tables("candidate_skills")} SELECT c_custkey AS candidate_id FROM customer WHERE c_acctbal >= 0
AND (SELECT count(*) FROM candidate_skills WHERE candidate_id = c_custkey) >= 1"""
)
def profiles_ready(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), (F.col("c_acctbal") >= 0).alias("complete"))
    return profiles.matching_ready(people, B.candidate_skills(spark, sf_dir)).select("candidate_id")


@query(
    """SELECT p_partkey AS id, p_name AS label FROM part WHERE contains(lower(p_name), 'ring')
ORDER BY NOT starts_with(lower(p_name), 'ring'), lower(p_name), p_partkey LIMIT 10"""
)
def concept_search(spark, sf_dir):
    return profiles.search_concepts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), "RING")


_PLACES, _KINDS = ("remote", "nowhere", "onsite", None), ("full-time", "contract", "other")


@query(
    """WITH p AS (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 9 <> 0 THEN CASE WHEN c_custkey % 8 = 0 THEN ' ' ELSE c_name END END AS name, CASE WHEN c_nationkey % 5 <> 1 THEN c_mktsegment END AS place,
  list_filter([(['remote', 'nowhere', 'onsite', NULL])[c_custkey % 4 + 1], 'elsewhere'], lambda x: x IS NOT NULL) AS workplaces, [(['full-time', 'contract', 'other'])[c_custkey % 3 + 1]] AS employments FROM customer)
SELECT candidate_id FROM p WHERE trim(name) <> '' AND trim(place) <> '' AND list_has_any(workplaces, ['remote', 'hybrid', 'onsite'])
  AND list_has_any(employments, ['full-time', 'part-time', 'contract', 'internship', 'temporary'])"""
)
def profiles_complete(spark, sf_dir):
    key = F.col("c_custkey")
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    people = table(spark, sf_dir, "customer").select(
        key.alias("candidate_id"), F.when(key % 9 != 0, F.when(key % 8 == 0, " ").otherwise(F.col("c_name"))).alias("name"), F.when(F.col("c_nationkey") % 5 != 1, F.col("c_mktsegment")).alias("place"),
        F.array_compact(F.array(pick(_PLACES, key % 4), F.lit("elsewhere"))).alias("workplaces"), F.array(pick(_KINDS, key % 3)).alias("employments"),
    )
    return people.where(profiles.complete(*map(F.col, ("name", "place", "workplaces", "employments")))).select("candidate_id")


@query(
    f"""{B.with_tables("candidate_skills")}, terms AS (SELECT p_partkey AS request_id, p_partkey * 3 % 200 AS candidate_id, CASE WHEN p_partkey % 6 = 0 THEN 'zz' ELSE p_name END AS term FROM part),
forms AS (SELECT p_name AS term, count(DISTINCT p_name) AS n, any_value(p_name) AS concept, bool_or(length(p_name) % 5 = 0) AS twice FROM part GROUP BY 1),
people AS (SELECT c_custkey AS candidate_id FROM customer WHERE c_custkey % 4 <> 0), stored AS (SELECT * FROM candidate_skills WHERE candidate_id % 2 = 0),
judged AS (SELECT request_id, t.candidate_id, CASE WHEN p.candidate_id IS NULL THEN 'no_profile' WHEN f.term IS NULL THEN 'unmapped' WHEN twice THEN 'ambiguous' WHEN length(f.concept) % 7 = 0 THEN 'unavailable' END AS refusal, f.concept
  FROM terms t LEFT JOIN forms f ON f.term = t.term LEFT JOIN people p ON p.candidate_id = t.candidate_id)
SELECT request_id, candidate_id, CASE WHEN refusal IS NULL THEN concept END AS concept, coalesce(refusal, CASE WHEN EXISTS (SELECT 1 FROM stored s WHERE s.candidate_id = j.candidate_id AND s.concept = j.concept)
  OR row_number() OVER (PARTITION BY candidate_id, concept, refusal IS NULL ORDER BY request_id) > 1 THEN 'present' ELSE 'added' END) AS outcome FROM judged j"""
)
def profile_skills_added(spark, sf_dir):
    """Terms that candidates add to their profiles, with some unknown, some ambiguous and some whose concept isn't stored."""
    part = table(spark, sf_dir, "part")
    number, name = F.col("p_partkey"), F.col("p_name")
    requests = part.select(number.alias("request_id"), (number * 3 % 200).alias("candidate_id"), F.when(number % 6 == 0, "zz").otherwise(name).alias("term"))
    twice = F.length(name) % 5 == 0
    forms = part.select(name.alias("term"), F.when(twice, "AMBIGUOUS").otherwise("RESOLVED").alias("outcome"), F.when(~twice, name).alias("concept")).distinct()
    concepts = part.where(F.length(name) % 7 != 0).select(name.alias("concept"))
    people = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("candidate_id"))
    stored = B.candidate_skills(spark, sf_dir).where("candidate_id % 2 = 0")
    return profiles.added_skills(stored, requests, forms, concepts, people)[0]
