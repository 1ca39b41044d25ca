"""Uploaded CVs: the states that they go through, and the skills that they bring to a profile."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a CV and the steps that are allowed.
INITIAL = "pending"
ALLOWED = {("pending", "processing"), ("processing", "processed"), ("processing", "failed"), ("failed", "processing")}
# What an upload may be.
MEDIA_TYPE, MAGIC, MOST_BYTES, LONGEST_NAME = "application/pdf", b"%PDF-", 5 * 1024 * 1024, 255


def upload_refusal(filename: Column, media_type: Column, size: Column, head: Column, most: int = MOST_BYTES) -> Column:
    """Why an upload is refused, or null: its name, then its size, its declared type and its first bytes.

    A name has 1 to 255 characters, a stem and the ending pdf in either case, no slash, no control or format character, and
    no blank at either end. Defined cases: a null name, type or head is refused as that, and a null size as an empty file.
    """
    safe = F.length(filename).between(1, LONGEST_NAME) & ~F.rlike(filename, F.lit(r"(?U)[/\\\p{C}]|^\s|\s\z")) & F.rlike(filename, F.lit(r"(?is)\A.+\.pdf\z"))
    return (
        F.when(~F.coalesce(safe, F.lit(False)), "invalid_filename")
        .when(F.coalesce(size, F.lit(0)) < 1, "empty_file")
        .when(size > most, "file_too_large")
        .when(~media_type.eqNullSafe(MEDIA_TYPE), "unsupported_media_type")
        .when(~F.substring(head, 1, len(MAGIC)).eqNullSafe(F.lit(MAGIC)), "unsupported_content")
    )


def superseded(cvs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``cvs`` (owner_id, cv_id, created_at) that a ``kept`` (owner_id, cv_id) of the same owner replaces.

    Older ones by time, then id, go; a newer one always stays, as does the kept one. Defined cases: a kept CV that isn't
    stored, or is another owner's, replaces nothing; of several kept ones each replaces; null times replace nothing.
    """
    marks = kept.select("owner_id", "cv_id").distinct().join(cvs, ["owner_id", "cv_id"])
    # One mark an owner: whatever is older than some kept row is older than the newest of them.
    newest = marks.groupBy("owner_id").agg(F.max(F.struct("created_at", "cv_id")).alias("mark"))
    held = cvs.join(newest, "owner_id").join(kept.select("owner_id", "cv_id").distinct(), ["owner_id", "cv_id"], "left_anti")
    at, top = F.col("created_at"), F.col("mark.created_at")
    return held.where((at < top) | ((at == top) & (F.col("cv_id") < F.col("mark.cv_id")))).select(*cvs.columns)


def steps_taken(events: DataFrame) -> DataFrame:
    """``events`` (cv_id, at, event_id, state) with ``before``, the state they met, and ``legal``, in order of time, then id.

    A CV starts as pending; a step that isn't allowed from the state it meets is a reject and changes nothing. Events of a
    CV come to one task in their order and only its state is held there, however many there are. Defined cases: a null
    state is a reject; a null time comes first; ids are whole numbers; a null cv is one CV.
    """
    kept = events.select("cv_id", "at", "event_id", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            before, legal = [], []
            for cv, wanted in zip(batch.column("cv_id").to_pylist(), batch.column("state").to_pylist(), strict=True):
                if held is None or held[0] != cv:
                    held = (cv, INITIAL)
                before.append(held[1])
                legal.append((held[1], wanted) in ALLOWED)
                if legal[-1]:
                    held = (cv, wanted)
            columns = [*batch.columns, pa.array(before, pa.string()), pa.array(legal, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "before", "legal"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.repartition("cv_id").sortWithinPartitions("cv_id", "at", "event_id").mapInArrow(run, f"{schema}, before string, legal boolean")


def states_after(taken: DataFrame) -> DataFrame:
    """(cv_id, state, rejects) of ``steps_taken``: the last legal state, pending without any, and how many were refused."""
    last = F.max_by("state", F.when(F.col("legal"), F.struct("at", "event_id")))
    return taken.groupBy("cv_id").agg(F.coalesce(last, F.lit(INITIAL)).alias("state"), F.count_if(~F.col("legal")).alias("rejects"))


def replaced_skills(stored: DataFrame, extracted: DataFrame, read: DataFrame) -> DataFrame:
    """(candidate_id, concept, source) after the CVs of the candidates in ``read`` (candidate_id) were read again.

    Their skills from a CV go, and what was extracted now comes, but for concepts that they entered by hand. Other
    candidates' skills stay, and so does what was extracted for a candidate that isn't in ``read`` out.
    """
    again = read.select("candidate_id").distinct()
    by_hand = F.coalesce(F.col("source") != "cv", F.lit(True))
    kept = stored.where(by_hand).unionByName(stored.where(~by_hand).join(again, "candidate_id", "left_anti"))
    fresh = extracted.select("candidate_id", "concept").distinct().join(again, "candidate_id", "left_semi")
    fresh = fresh.join(stored.where(by_hand).select("candidate_id", "concept"), ["candidate_id", "concept"], "left_anti")
    return kept.select("candidate_id", "concept", "source").unionByName(fresh.withColumn("source", F.lit("cv")))
