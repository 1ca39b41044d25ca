"""The life of postings: reconciliation after a run, expiry, retention, and the standing of boards."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAILURES_TO_INACTIVE = 3
# What an anonymised job and its accounts still say.
ANONYMISED_TEXT, ANONYMISED_KEY = "Posting no longer available", "_anonymised_at"


def may_reconcile(run: dict, aged: bool = False) -> bool:
    """Whether a run entitles its source to retire what it didn't see.

    Never after an empty run or a budget stop. The exhaustive rule also needs the end of the source, no failure and
    every record processed; the aged rule only that all records are accounted for.
    """
    if not run["fetched"] or run["stopped_at_budget"]:
        return False
    if aged:
        return run["created"] + run["updated"] + run["skipped"] + run["failed"] >= run["fetched"]
    return run["reached_the_end"] and not run["failed"] and run["created"] + run["updated"] + run["skipped"] >= run["fetched"]


def reconcile(jobs: DataFrame, provenance: DataFrame, source_id: int, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """(provenance, jobs): the source's live rows last seen before ``cutoff`` are retired; active jobs that a source
    once listed and no source lists any more are removed."""
    at = F.lit(cutoff).cast("timestamp_ntz")
    gone = ~F.col("retired") & (F.col("source_id") == source_id) & (F.col("last_seen_at") < at)
    after = provenance.withColumn("retired_now", gone).withColumn("retired", F.col("retired") | gone)
    touched = after.where("retired_now").select("job_id").distinct()
    live = after.where(~F.col("retired")).select("job_id")
    unlisted = touched.join(live, "job_id", "left_anti").withColumn("unlisted", F.lit(True))
    out = jobs.join(unlisted, jobs["id"] == unlisted["job_id"], "left").drop("job_id")
    status = F.when(F.col("unlisted") & (F.col("status") == "active"), "removed").otherwise(F.col("status"))
    return after.drop("retired_now"), out.withColumn("status", status).drop("unlisted")


def unlisted(jobs: DataFrame, provenance: DataFrame) -> DataFrame:
    """Jobs without a live account."""
    live = provenance.where(~F.col("retired")).select(F.col("job_id").alias("id"))
    return jobs.join(live, "id", "left_anti")


def expire(jobs: DataFrame, now: datetime) -> DataFrame:
    """Active jobs whose expiry lies strictly before ``now`` become expired, and count as updated then."""
    at = F.lit(now).cast("timestamp_ntz")
    due = (F.col("status") == "active") & (F.col("expires_at") < at)
    return jobs.withColumn("updated_at", F.when(due, at).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(due, "expired").otherwise(F.col("status"))
    )


def retention(jobs: DataFrame, provenance: DataFrame, references: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    """(id, action): ended jobs untouched for ``days`` without a live account: anonymise if referenced, else purge.

    Jobs with an ``anonymised_at`` are done with; a table without that column has none of them.
    """
    cutoff = F.lit(now - timedelta(days=days)).cast("timestamp_ntz")
    ended = jobs.where(F.col("status").isin("expired", "removed") & (F.col("updated_at") < cutoff))
    if "anonymised_at" in jobs.columns:
        ended = ended.where(F.col("anonymised_at").isNull())
    named = references.select(F.col("job_id").alias("ref")).distinct()
    out = unlisted(ended, provenance).join(named, F.col("id") == F.col("ref"), "left")
    return out.select("id", F.when(F.col("ref").isNotNull(), "anonymise").otherwise("purge").alias("action"))


def retained(jobs: DataFrame, provenance: DataFrame, actions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(jobs, provenance) after the ``actions`` (id, action) of ``retention``: purged jobs and their accounts are gone.

    An anonymised job keeps its id, company, title, dates and status; its description says that it is gone, location and
    ``application_url`` are emptied, ``anonymised_at`` is set, and its accounts' ``raw_payload`` holds that time only.
    Defined cases: jobs without an action stay; a table without one of these columns gets none but ``anonymised_at``.
    """
    at = F.lit(now).cast("timestamp_ntz")
    acts = actions.select(F.col("id").alias("_id"), "action").distinct()
    met = jobs.join(acts, F.col("id") == F.col("_id"), "left").where(F.coalesce(F.col("action") != "purge", F.lit(True)))
    hidden = F.coalesce(F.col("action") == "anonymise", F.lit(False))
    if "anonymised_at" not in jobs.columns:
        met = met.withColumn("anonymised_at", F.lit(None).cast("timestamp_ntz"))
    says = {"description": F.lit(ANONYMISED_TEXT), "location": F.lit(None), "application_url": F.lit(""), "anonymised_at": at}
    after = met.withColumns({c: F.when(hidden, v).otherwise(F.col(c)) for c, v in says.items() if c in met.columns})
    accounts = provenance.join(acts, F.col("job_id") == F.col("_id"), "left").where(F.coalesce(F.col("action") != "purge", F.lit(True)))
    if "raw_payload" in provenance.columns:
        mark = F.to_json(F.struct(F.lit(now.isoformat()).alias(ANONYMISED_KEY)))
        accounts = accounts.withColumn("raw_payload", F.when(hidden, mark).otherwise(F.col("raw_payload")))
    return after.drop("_id", "action"), accounts.drop("_id", "action")


def board_standing(polls: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """(board, polls, consecutive_failures, status) from (board, at, poll_id, failed), in order of time.

    A success starts the count anew and revives; three failures in a row make a board inactive, but none of the
    ``pinned`` (board).
    """
    order = Window.partitionBy("board").orderBy("at", "poll_id")
    runs = polls.withColumn("successes", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(order))
    last = runs.groupBy("board").agg(F.max("successes").alias("run"), F.count("*").alias("polls"))
    tail = runs.where("failed").groupBy(F.col("board").alias("b"), F.col("successes").alias("s")).agg(F.count("*").alias("n"))
    joined = last.join(tail, (F.col("board") == F.col("b")) & (F.col("run") == F.col("s")), "left")
    failures = F.coalesce("n", F.lit(0)).cast("long")
    held = F.lit(False)
    if pinned is not None:
        joined = joined.join(pinned.select(F.col("board").alias("pin")).distinct(), F.col("board") == F.col("pin"), "left")
        held = F.col("pin").isNotNull()
    return joined.select(
        "board", "polls", failures.alias("consecutive_failures"),
        F.when((failures >= FAILURES_TO_INACTIVE) & ~held, "inactive").otherwise("confirmed").alias("status"),
    )


def quota_admitted(calls: DataFrame, per_day: int) -> DataFrame:
    """``calls`` (source, at, call_id) with ``admitted``: the first ``per_day`` of each source and UTC day."""
    nth = F.row_number().over(Window.partitionBy("source", F.to_date("at")).orderBy("at", "call_id"))
    return calls.withColumn("admitted", nth <= per_day)


def attempts_allowed(attempts: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """(key, window_start, attempts, refused) over fixed windows: attempts beyond ``limit`` are refused."""
    start = F.window("at", f"{seconds} seconds")["start"].cast("timestamp_ntz")
    counts = attempts.groupBy("key", start.alias("window_start")).agg(F.count("*").alias("attempts"))
    return counts.withColumn("refused", F.greatest(F.col("attempts") - limit, F.lit(0)))
