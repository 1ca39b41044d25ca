"""Profiles' completeness and added skills, registration and decisions about boards, on hand-written rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.operators import boards, profiles

ROW = "slug string, status string, company_id long, kind string, pinned boolean, failures int"


def told(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_profiles_are_complete_with_one_known_choice_of_each(spark):
    rows = [
        (1, "A", "x", ["remote", "moon"], ["contract"]), (2, " ", "x", ["remote"], ["contract"]), (3, "A", None, ["remote"], ["contract"]), (4, "A", "x", ["moon"], ["contract"]),
        (5, "A", "x", [], ["contract"]), (6, "A", "x", None, ["contract"]), (7, "A", "x", ["hybrid"], [None]), (8, "A", "x", ["onsite"], ["other", "internship"]),
    ]
    df = spark.createDataFrame(rows, "id int, name string, place string, w array<string>, e array<string>")
    done = df.select("id", profiles.complete(*map(F.col, ("name", "place", "w", "e"))).alias("ok"))
    assert told(done, "id", "ok") == [(k, k in (1, 8)) for k in range(1, 9)]


def test_terms_are_added_once_or_refused_with_a_reason(spark):
    requests = [(1, 1, "sql"), (2, 1, "SQL"), (3, 1, "go"), (4, 1, "c"), (5, 1, "?"), (6, 2, "sql"), (7, 3, "rust"), (8, 3, None), (9, 3, "go")]
    resolved = [("sql", "RESOLVED", "c1"), ("SQL", "RESOLVED", "c1"), ("go", "RESOLVED", "c2"), ("c", "AMBIGUOUS", None), ("?", "UNMAPPED", None), ("rust", "RESOLVED", "c9"), ("go", "RESOLVED", "c2")]
    make = spark.createDataFrame
    stored = make([(1, "c2")], "candidate_id long, concept string")
    args = make(resolved, "term string, outcome string, concept string"), make([("c1",), ("c2",)], "concept string"), make([(1,), (3,)], "candidate_id long")
    asked = make(requests, "request_id long, candidate_id long, term string")
    done, after = profiles.added_skills(stored, asked, *args)
    assert told(done, "request_id", "outcome") == [
        (1, "added"), (2, "present"), (3, "present"), (4, "ambiguous"), (5, "unmapped"), (6, "no_profile"), (7, "unavailable"), (8, "unmapped"), (9, "added"),
    ]
    assert told(after, "candidate_id", "concept") == [(1, "c1"), (1, "c2"), (3, "c2")]
    again, same = profiles.added_skills(after, asked, *args)
    assert "added" not in {r["outcome"] for r in again.collect()} and told(same, "candidate_id", "concept") == told(after, "candidate_id", "concept")


def test_claims_on_one_slug_are_taken_in_order(spark):
    held = [
        ("blocked", "blocked", None, "operator", False, 0), ("theirs", "confirmed", 9, "provider_name", False, 0), ("pinned", "confirmed", None, "operator", True, 0),
        ("mine", "confirmed", 1, "provider_name", False, 2), ("named", "named", 1, "site_title", False, 0), ("asleep", "inactive", 5, "operator", False, 4),
    ]
    probes = [
        (1, 1, "blocked", "confirmed", None, None), (2, 1, "theirs", "confirmed", None, None), (3, 1, "pinned", "not_found", "new0", "confirmed"),
        (4, 1, "mine", "not_found", "new1", "confirmed"), (5, 1, "mine", "unverifiable", None, None), (6, 1, "named", "named", None, None),
        (7, 2, "asleep", "confirmed", None, None), (8, 3, "asleep", "confirmed", None, None),  # 3 comes too late
        (9, 4, "new2", "not_found", "new3", "confirmed"), (10, 5, "new3", "unverifiable", "new4", "confirmed"),  # new3 is taken, so new4 isn't written
        (11, 6, "new5", "unverifiable", "new6", "named"), (12, 7, "new7", "wrong_company", None, None), (13, 8, "new8", None, None, None), (14, 9, "new9", "unverifiable", "new9", "confirmed"),
    ]
    done, rows = boards.register(
        spark.createDataFrame(probes, "probe long, company_id long, slug string, answer string, other_slug string, other_answer string"), spark.createDataFrame(held, ROW)
    )
    assert dict(told(done, "probe", "outcome")) == {
        1: "unchanged", 2: "unchanged", 3: "pinned_reported", 4: "unchanged", 5: "demoted", 6: "reverified", 7: "reactivated", 8: "unchanged", 9: "located",
        10: "unchanged", 11: "named", 12: "wrong_company", 13: "unreachable", 14: "unverifiable",
    }
    after = {r["slug"]: tuple(r[c] for c in ("status", "company_id", "kind", "failures")) for r in rows.collect()}
    assert after == {
        "blocked": ("blocked", None, "operator", 0), "theirs": ("confirmed", 9, "provider_name", 0), "pinned": ("confirmed", None, "operator", 0), "mine": ("named", 1, "unverified", 2),
        "named": ("named", 1, "site_title", 0), "asleep": ("confirmed", 2, "provider_name", 0), "new2": ("not_found", 4, "not_found", 0), "new3": ("confirmed", 4, "provider_name", 0),
        "new5": ("candidate", 6, "unverified", 0), "new6": ("named", 6, "site_title", 0), "new7": ("wrong_company", 7, "provider_name", 0), "new8": ("unreachable", 8, "unreachable", 0),
        "new9": ("candidate", 9, "unverified", 0),
    }
    tallies = boards.tallied(done).first().asDict()
    assert tallies["located"] == tallies["not_found"] == 1 and tallies["unchanged"] == 5 and sum(tallies.values()) == 15


def test_registering_nothing_leaves_the_rows(spark):
    held = spark.createDataFrame([("a", "named", 1, "site_title", False, 0)], ROW)
    none = spark.createDataFrame([], "probe long, company_id long, slug string, answer string, other_slug string, other_answer string")
    done, rows = boards.register(none, held)
    assert done.count() == 0 and told(rows, "slug", "status") == [("a", "named")] and set(boards.tallied(done).first()) == {0}


def test_an_operator_outranks_discovery(spark):
    held = spark.createDataFrame([("a", "wrong_company", 1, "provider_name", False, 3), ("b", "confirmed", 2, None, True, 1), ("c", "named", 3, "site_title", False, 0)], ROW)
    made = [("a", 1, "pin"), ("b", 1, "block"), ("b", 2, "unblock"), ("new", 1, "unblock"), ("new", 2, "block"), ("gone", 1, "unblock"), ("c", 1, "other")]
    after = boards.decided(held, spark.createDataFrame(made, "slug string, at int, decision string"))
    assert told(after, "slug", "status", "company_id", "kind", "pinned", "failures") == [
        ("a", "confirmed", 1, "operator", True, 0), ("b", "candidate", 2, "operator", False, 1), ("c", "named", 3, "site_title", False, 0), ("new", "blocked", None, "operator", False, 0),
    ]
