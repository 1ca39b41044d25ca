"""Outcomes of records, ledgers, profiles and sources on hand-written rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.operators import listing, persist, profiles

DAY = datetime(2026, 1, 5, 12)


def test_outcomes_of_records(spark):
    jobs = spark.createDataFrame(
        [(1, "active", "Berlin", None), (2, "removed", "Paris", "remote"), (3, "expired", None, "onsite")], "id long, status string, location string, kind string"
    )
    records = [
        (1, "ours", "new", None, False, "Rome", "remote"),
        (2, "ours", "changed", 1, False, "Bonn", None),  # contests a field and loses: nothing changes
        (3, "ours", "changed", 1, False, "Bonn", "hybrid"),  # fills a gap
        (4, "ours", "changed", 1, True, "Bonn", "unspecified"),
        (5, "ours", "unchanged", 2, False, "x", "y"),  # listed again
        (6, "ours", "changed", 3, True, "Lyon", None),  # stays expired
        (7, "theirs", "changed", 2, True, "Lyon", None),
        (8, "ours", "ambiguous", 1, True, "Lyon", None),
        (9, None, "new", None, None, None, None),
        (10, "ours", None, 1, None, None, None),
        (11, "ours", "changed", 99, True, "Lyon", None),
    ]
    schema = "record_id long, source_key string, decision string, job_id long, wins boolean, location string, kind string"
    found = persist.persist_outcomes(spark.createDataFrame(records, schema), jobs, ["location", "kind"], "ours")
    got = {r["record_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {
        1: (None, "created", False, "active", "Rome", "remote"),
        2: (1, "skipped", False, "active", "Berlin", None),
        3: (1, "updated", False, "active", "Berlin", "hybrid"),
        4: (1, "updated", False, "active", "Bonn", None),
        5: (2, "skipped", False, "active", "Paris", "remote"),
        6: (3, "updated", False, "expired", "Lyon", "onsite"),
        7: (2, "skipped", True, "removed", "Paris", "remote"),
        8: (None, "skipped", True, None, None, None),
        9: (None, "skipped", True, None, None, None),
        10: (None, "skipped", True, None, None, None),
        11: (None, "skipped", True, None, None, None),
    }
    assert tuple(persist.run_tally(found).first()) == (11, 1, 3, 7, 5)
    assert tuple(persist.run_tally(found.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_the_last_entry_of_a_run(spark):
    entries = [(1, DAY, "running", None), (1, DAY + timedelta(1), "completed", 5), (2, DAY, "running", None), (3, DAY, "running", 1), (3, DAY, "failed", 2)]
    ledger = persist.run_ledger(spark.createDataFrame(entries, "run_id long, at timestamp, state string, fetched long"))
    assert sorted((r["run_id"], r["state"], r["fetched"]) for r in ledger.collect()) == [(1, "completed", 5), (2, "running", None), (3, "failed", 2)]


def test_profiles(spark):
    people = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "candidate_id long, complete boolean")
    skills = spark.createDataFrame([(1, "sql"), (3, "sql"), (4, "go"), (None, "x")], "candidate_id long, concept string")
    assert [r["candidate_id"] for r in profiles.matching_ready(people, skills).collect()] == [1]
    assert profiles.matching_ready(people, skills, 2).isEmpty()
    arrays = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["a", "z"]), (4, None)], "id int, v array<string>")
    assert [r[0] for r in arrays.orderBy("id").select(profiles.only_of(F.col("v"), ["a", "b"])).collect()] == [True, True, False, None]
    concepts = spark.createDataFrame([(1, "My SQL"), (2, "sql"), (3, "SQL"), (4, "100%"), (5, None)], "id long, label string")
    assert [r["id"] for r in profiles.search_concepts(concepts, "Sql").collect()] == [2, 3, 1]
    assert [r["id"] for r in profiles.search_concepts(concepts, "%").collect()] == [4]


def test_an_unknown_source_is_no_empty_answer(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "id long")
    seen = spark.createDataFrame([(1, 7, False), (2, 7, True)], "job_id long, source_id long, retired boolean")
    sources = spark.createDataFrame([(7, "here"), (8, "idle")], "source_id long, key string")
    assert [r["id"] for r in listing.listed_by(jobs, seen, sources, "here").collect()] == [1]
    assert listing.listed_by(jobs, seen, sources, "idle").isEmpty()
    with pytest.raises(ValueError):
        listing.listed_by(jobs, seen, sources, "nowhere")
