"""Streams over landed sightings, polls and attempts.

Sightings only ever move minima and maxima, so a replayed micro-batch changes nothing. The failure counter of a board
is keyed state. Throttle windows are event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobloom.operators.boards import earned
from jobloom.operators.lifecycle import FAILURES_TO_INACTIVE


def sightings(stream: DataFrame) -> DataFrame:
    """(source_key, source_job_id, first_seen_at, last_seen_at, sightings), kept up to date over the stream."""
    return stream.groupBy("source_key", "source_job_id").agg(
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("sightings")
    )


def first_arrivals(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row per (source_key, source_job_id) within the lateness bound."""
    return stream.withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["source_key", "source_job_id"])


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Process what has landed as micro-batches and stop: one scheduled run of a source."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttle(attempts: DataFrame, limit: int = 10, seconds: int = 60, lateness: str = "5 minutes") -> DataFrame:
    """(key, window_start, attempts, refused) over fixed event-time windows."""
    counts = attempts.withWatermark("at", lateness).groupBy("key", F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("attempts"))
    return counts.select("key", F.col("w.start").alias("window_start"), "attempts", F.greatest(F.col("attempts") - limit, F.lit(0)).alias("refused"))


def board_failures(polls: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """(board, consecutive_failures, status) after each micro-batch of (board, at, failed).

    ``boards`` is the registry (slug, status, company_id, kind, pinned, failures), a static table that the stream is joined
    with: a board's first poll starts from its row, its pin keeps it from going inactive, and its evidence says what a
    success brings it back to. Without a registry every board starts confirmed. State is the count, the last poll's time
    and the standing; polls not later than that are replays and are skipped. Unknown boards give no row.
    """
    if boards is None:
        facts = {"was": F.lit("confirmed"), "back": F.lit("confirmed"), "pinned": F.lit(False), "before": F.lit(0)}
        told = polls.select("board", "at", "failed", *[v.alias(n) for n, v in facts.items()])
    else:
        held = boards.select(
            F.col("slug").alias("board"), F.col("status").alias("was"), earned(F.col("kind"), F.col("company_id"), F.col("pinned")).alias("back"),
            F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("failures", F.lit(0)).cast("int").alias("before"),
        )
        told = polls.select("board", "at", "failed").join(held, "board")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, last, status = state.get if state.exists else (None, -1, None)
        for rows in batches:
            for r in rows.sort_values("at").itertuples(index=False):
                if status is None:
                    failures, status = int(r.before), r.was
                at = int(pd.Timestamp(r.at).value)
                if at <= last:
                    continue
                last, failures = at, failures + 1 if r.failed else 0
                if not r.failed:
                    status = r.back if status == "inactive" else status
                elif failures >= FAILURES_TO_INACTIVE and not r.pinned:
                    status = "inactive"
        state.update((failures, last, status))
        yield pd.DataFrame({"board": [key[0]], "consecutive_failures": [failures], "status": [status]})

    return told.groupBy("board").applyInPandasWithState(
        step, "board string, consecutive_failures int, status string", "failures int, last long, status string", "update", GroupStateTimeout.NoTimeout
    )
