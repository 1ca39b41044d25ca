"""Published versions, backfills and their measure, a corpus's manifest, and CVs, on hand-written rows."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jobloom.operators import boilerplate, cvs, extraction, measure
from jobloom.sources import versions


def test_a_version_is_loaded_once_and_never_changed(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "form string, concept string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    first = make([("sql", "c1"), ("go", "c2"), ("go", "c2"), (None, "c3")])
    assert not versions.is_published(spark, root, "v1")
    assert versions.load(first, root, "v1", ["form"]) and not versions.load(first.repartition(3), root, "v1", ["form"])
    for rows, said in [
        ([("sql", "c9"), ("go", "c2"), ("go", "c2"), (None, "c3")], "row changed .form='sql'"), ([("sql", "c1"), ("go", "c2"), (None, "c3")], "row unexpected .form='go'"),
        ([("sql", "c1"), ("go", "c2"), ("go", "c2"), (None, "c3"), ("aa", "x"), ("zz", "x")], "row missing .form='aa'"), ([("sql", "c1"), ("go", "c2"), ("go", "c2")], "row unexpected .form=None"),
    ]:
        with pytest.raises(versions.PublishedConflict, match=said):
            versions.load(make(rows), root, "v1", ["form"])
    with pytest.raises(versions.PublishedConflict, match="columns differ"):
        versions.load(first.withColumn("more", F.lit(1)), root, "v1", ["form"])
    assert versions.read(spark, root, "v1").count() == 4
    assert versions.load(make([]), root, "empty", ["form"]) and versions.read(spark, root, "empty").count() == 0
    with pytest.raises(ValueError, match="no version name"):
        versions.load(first, root, "../v1", ["form"])


def test_a_writer_that_dies_or_comes_second_leaves_what_was_published(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    one, two = (spark.createDataFrame([(n,)], "n long") for n in (1, 2))
    dying = one.select(F.raise_error(F.lit("killed")).cast("long").alias("n"))
    with pytest.raises(Exception, match="killed"):
        versions.load(dying, root, "v", ["n"])
    assert not versions.is_published(spark, root, "v") and versions.load(one, root, "v", ["n"])
    # Both writers see no version; the second one's step fails and it compares.
    monkeypatch.setattr(versions, "is_published", lambda *a: False)
    assert not versions.load(one, root, "v", ["n"])
    with pytest.raises(versions.PublishedConflict, match="row missing .n=2|row unexpected .n=1"):
        versions.load(two, root, "v", ["n"])
    assert [r["n"] for r in versions.read(spark, root, "v").collect()] == [1]


def test_backfills_report_apply_and_measure(spark):
    text = "Acme builds Rust Tools here.\nwe need Apache Kafka and sql"
    rows = [(k, "Acme GmbH", text + f" {k}") for k in range(6)] + [(9, "Solo", "Solo only once"), (10, None, None), (11, "Acme GmbH", "")]
    postings = spark.createDataFrame(rows, "posting_id long, employer string, description string")
    changes = boilerplate.rewrites(postings, boilerplate.removable_stored(postings))
    assert sorted((r["posting_id"], r["description"], r["removed_blocks"], r["removed_characters"]) for r in changes.collect()) == [
        (k, f"we need Apache Kafka and sql {k}", 1, 29) for k in range(6)
    ]
    assert tuple(boilerplate.backfill_report(postings, changes).first()) == (9, 6, 6, 6 * 29)
    applied = postings.alias("p").join(changes.alias("c"), "posting_id", "left").select("posting_id", "employer", F.coalesce("c.description", "p.description").alias("description"))
    assert boilerplate.rewrites(applied, boilerplate.removable_stored(postings)).count() == 0
    told = {r["version"]: tuple(r)[1:] for r in boilerplate.measured(postings, changes, extraction.propose_candidates).collect()}
    seen = lambda texts: [t for x in texts if x for t, _, _ in extraction.proposals(x)]
    old, new = seen(r[2] for r in rows), seen(r["description"] for r in applied.collect())
    assert told["before"] == (len(old), len(set(old)), sum(len(r[2] or "") for r in rows))
    assert told["after"] == (len(new), len(set(new)), sum(len(r["description"] or "") for r in applied.collect()))
    assert len(set(new)) < len(set(old))


def test_a_manifest_does_not_depend_on_order(spark):
    jobs = [(k, f"E{k % 40:02}", datetime(2026, 1, 1 + k % 9) if k % 5 else None, f"text {k}") for k in range(90)]
    records = [(k % 90, f"s{k % 3}", k, f"b{k % 4}" if k % 3 == 0 else None) for k in range(150)]
    make = lambda j, r: measure.full_manifest(
        spark.createDataFrame(j, "id long, employer string, published_at timestamp_ntz, description string"), spark.createDataFrame(r, "job_id long, source_key string, source_job_id long, board string")
    )
    told = sorted(tuple(r) for r in make(jobs, records).collect())
    mixed = random.Random(1).sample
    assert told == sorted(tuple(r) for r in make(mixed(jobs, 90), mixed(records, 150)).collect())
    got = {(k, n): v for k, n, v in told}
    assert got["source", "s0"] == "50" and got["board", "b0"] == str(sum(k % 12 == 0 for k in range(150))) and sum(k == "employer" for k, *_ in told) == 30
    assert got["employer", "E00"] == "3" and ("employer", "E39") not in got
    assert (got["total", "jobs"], got["total", "without_a_date"], got["total", "jobs_with_two_sources"]) == ("90", "18", "0")
    changed = {(k, n): v for k, n, v in map(tuple, make([*jobs[:-1], (89, "E09", None, "other")], records).collect())}
    assert changed["total", "digest"] != got["total", "digest"]
    none = {(k, n): v for k, n, v in map(tuple, make([], []).collect())}
    assert none == {("total", n): v for n, v in [("jobs", "0"), ("employers", "0"), ("jobs_with_two_sources", "0"), ("without_a_date", "0"), ("earliest", None), ("latest", None), ("digest", "0")]}


def test_cvs_take_allowed_steps_only(spark):
    steps = {1: ["processed", "processing", "failed", "processed", "processing", "processed", "processing"], 2: ["failed", None], 3: ["processing"]}
    events = [(cv, datetime(2026, 1, 1, 1), k, s) for cv, xs in steps.items() for k, s in enumerate(xs)]
    events = spark.createDataFrame(events, "cv_id long, at timestamp_ntz, event_id long, state string").withColumn("before", F.lit(0)).repartition(3)
    taken = cvs.steps_taken(events)
    assert [(r["before"], r["legal"]) for r in taken.where("cv_id = 1").orderBy("event_id").collect()] == [
        ("pending", False), ("pending", True), ("processing", True), ("failed", False), ("failed", True), ("processing", True), ("processed", False),
    ]
    assert sorted(tuple(r) for r in cvs.states_after(taken).collect()) == [(1, "processed", 3), (2, "pending", 2), (3, "processing", 0)]
    assert cvs.states_after(cvs.steps_taken(events.limit(0))).count() == 0


def test_skills_entered_by_hand_win_over_a_cv(spark):
    stored = spark.createDataFrame([(1, "sql", "manual"), (1, "go", "cv"), (2, "go", "cv"), (3, "c", None)], "candidate_id long, concept string, source string")
    new = spark.createDataFrame([(1, "sql"), (1, "rust"), (1, "rust"), (2, "java"), (3, "c"), (3, "d")], "candidate_id long, concept string")
    read = spark.createDataFrame([(1,), (1,), (3,), (None,)], "candidate_id long")
    assert sorted(tuple(map(str, r)) for r in cvs.replaced_skills(stored, new, read).collect()) == [
        ("1", "rust", "cv"), ("1", "sql", "manual"), ("2", "go", "cv"), ("3", "c", "None"), ("3", "d", "cv"),
    ]
