"""Canonical job-market tables projected from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import table


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per order: nullable location and date, four workplaces, three states."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    place = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    workplaces = F.array(*map(F.lit, ("onsite", "hybrid", "remote", "unspecified")))
    states = F.create_map(*map(F.lit, ("O", "active", "P", "expired", "F", "removed")))
    return orders.join(place, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("n_name")).alias("location"),
        F.get(workplaces, (F.col("o_orderkey") % 4).cast("int")).alias("workplace_type"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("published_at"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
        F.try_element_at(states, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("updated_at"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_id")
    )


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (job_id, concept) pairs; a concept is a part's name."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("job_id"), F.col("p_name").alias("concept"))
        .distinct()
    )


def job_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("key"), (F.col("s_suppkey") % 2 * 10 + 10).cast("int").alias("precedence")
    )


def job_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per (job, source): first and last sighting; retired when every line was returned."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("source_id"))
        .agg(
            F.min("l_shipdate").alias("first_seen_at"),
            F.max("l_shipdate").alias("last_seen_at"),
            F.every(F.col("l_returnflag") == "R").alias("retired"),
            F.every(F.col("l_linenumber") > 4).alias("partial"),
            F.max("l_linenumber").alias("stated"),
        )
    )


def candidate_skills(spark: SparkSession, sf_dir: str, skills: DataFrame | None = None) -> DataFrame:
    """Distinct (candidate_id, concept): what a customer's own orders name; ``skills`` are ``job_skills``, if at hand."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"))
    skills = job_skills(spark, sf_dir) if skills is None else skills
    return orders.join(skills, F.col("o_orderkey") == F.col("job_id")).select("candidate_id", "concept").distinct()


# The same projections as SQL, for the second engine.
SQL = {
    "jobs": """jobs AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS title,
    CASE WHEN o_orderkey % 7 <> 0 THEN n_name END AS location,
    (['onsite', 'hybrid', 'remote', 'unspecified'])[o_orderkey % 4 + 1] AS workplace_type,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS published_at,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 30 DAYS END AS expires_at,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'expired' WHEN 'F' THEN 'removed' END AS status,
    o_orderdate AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "job_skills": """job_skills AS (
  SELECT DISTINCT l_orderkey AS job_id, p_name AS concept FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "job_sources": """job_sources AS (
  SELECT s_suppkey AS source_id, s_name AS key, (s_suppkey % 2 * 10 + 10)::INTEGER AS precedence FROM supplier)""",
    "job_provenance": """job_provenance AS (
  SELECT l_orderkey AS job_id, l_suppkey AS source_id, min(l_shipdate) AS first_seen_at, max(l_shipdate) AS last_seen_at,
    bool_and(l_returnflag = 'R') AS retired, bool_and(l_linenumber > 4) AS partial, max(l_linenumber) AS stated
  FROM lineitem GROUP BY 1, 2)""",
    "candidate_skills": """candidate_skills AS (
  SELECT DISTINCT o_custkey AS candidate_id, p_name AS concept
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
