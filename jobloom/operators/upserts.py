"""Table updates as full-outer joins: a new version of a table from the old one and what arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_provenance(stored: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("job_id", "source_id")) -> DataFrame:
    """First sightings only move back and last sightings only forward; a payload stays unless a new one came; being
    seen clears ``retired_at``. Applying the same sightings twice changes nothing."""
    s, n = stored.alias("s"), seen.alias("n")
    on = [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys]
    joined = s.join(n, on, "full_outer")
    seen_now = F.col(f"n.{keys[0]}").isNotNull()
    return joined.select(
        *[F.coalesce(f"n.{k}", f"s.{k}").alias(k) for k in keys],
        F.least("s.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.greatest("s.last_seen_at", "n.last_seen_at").alias("last_seen_at"),
        F.coalesce("n.payload", "s.payload").alias("payload"),
        F.when(~seen_now, F.col("s.retired_at")).alias("retired_at"),
    )


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with the rows it lacked, those rows)."""
    added = new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns)
    return stored.unionByName(added), added


def update_supplied(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Upsert that touches only the fields a change supplies; null means not supplied."""
    fields = [c for c in stored.columns if c != key]
    s, n = stored.alias("s"), changes.alias("n")
    supplied = set(changes.columns)
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(
        F.coalesce(f"n.{key}", f"s.{key}").alias(key),
        *[(F.coalesce(f"n.{f}", f"s.{f}") if f in supplied else F.col(f"s.{f}")).alias(f) for f in fields],
    )


def replace_children(stored: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of ``parents`` replaced by ``new``; other parents' children stay."""
    return stored.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_mentions(stored: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """Skill mentions after extracting ``parents`` again: counts are overwritten, first sightings kept, last ones
    never move back, and mentions no longer found go."""
    keys = ["job_id", "surface_form"]
    kept = stored.join(parents.select("job_id").distinct(), "job_id", "left_anti")
    s = stored.select(*keys, F.col("first_seen_at").alias("_first"), F.col("last_seen_at").alias("_last"))
    fresh = new.join(s, keys, "left").select(
        *keys, "occurrences",
        F.least("first_seen_at", "_first").alias("first_seen_at"),
        F.greatest("last_seen_at", "_last").alias("last_seen_at"),
    )
    return kept.select(*fresh.columns).unionByName(fresh)


def publication_diff(published: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with ``side`` missing or unexpected; empty if they are equal."""
    missing = expected.exceptAll(published).withColumn("side", F.lit("missing"))
    return missing.unionByName(published.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def cascade_delete(jobs: DataFrame, doomed: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Without the doomed ids: the jobs, and every child table by its job_id."""
    ids = doomed.select("id").distinct()
    gone = ids.select(F.col("id").alias("job_id"))
    return jobs.join(ids, "id", "left_anti"), {n: c.join(gone, "job_id", "left_anti") for n, c in children.items()}
