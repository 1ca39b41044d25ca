"""Operators of the catalogue on hand-written rows: rules of text, providers, paging, identity, updates, streams, boards."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text as T
from jobloom.operators import boards, discovery, extraction, identity, lifecycle, listing, measure, upserts
from jobloom.sources import providers
from jobloom.streaming import runs

DAY = datetime(2026, 1, 5, 12)


def values(spark, rule, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r["out"] for r in df.select("k", rule(F.col("t")).alias("out")).orderBy("k").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_titles_and_employers_make_one_key(spark):
    titles = ["Data Engineer", "Data Engineer (m/w/d)", "Data  Engineer (all genders)", "DATA ENGINEER", "ＤＡＴＡ engineer"]
    assert len(set(values(spark, lambda c: T.match_key(F.lit("ACME"), c), *titles))) == 1
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "a string, b string").select(T.match_key(F.col("a"), F.col("b")))
    assert len(set(df.collect())) == 2


def test_cities(spark):
    got = values(
        spark, T.city_names, "London, UK", "Berlin, Berlin, Germany", "Berlin, Berlin; München, Bavaria", "Freiburg (Germany), Berlin (Germany)",
        "Remote, France", None, "", "Remote", "Hybrid", "Homeoffice", "GROSSRÖHRSDORF; Großröhrsdorf", "Ｋöln",
    )
    assert got == [["london"], ["berlin"], ["berlin", "münchen"], ["berlin", "freiburg"], ["france"], [], [], [], [], [], ["grossröhrsdorf"], ["köln"]]


def test_folding_is_case_folding(spark):
    assert values(spark, T.folded, "Großmann Straße", "STRAẞE 5", "ﬁne") == [" grossmann strasse ", " strasse 5 ", " fine "]
    assert values(spark, T.employer_marker, "Großmann GmbH", "AG", "SE Müllermann") == ["grossmann", "", "llermann"]
    assert values(spark, T.vocabulary, "Straße STRASSE straße", None) == [["strasse"], []]
    for ch in ("ß", "ﬂ", "ſ"):
        assert T.FOLDINGS[ch] == ch.casefold()


def test_long_locations_end_between_places(spark):
    many = "; ".join(["Frankfurt/Main"] * 30)
    slashes = " / ".join(["Frankfurt/Main"] * 30)
    plain = "x" * 300
    a, b, c, d = values(spark, T.fit_location, many, slashes, plain, "short")
    assert a.endswith("Frankfurt/Main …") and b.endswith("Frankfurt/Main …") and len(c) == 255 and d == "short"
    assert max(map(len, (a, b, c))) <= 255


def test_markup_and_secrets_go(spark):
    assert values(spark, T.plain_text, "<p>a &amp; b</p><script>x</script><div>c</div>", "&lt;p&gt;x&lt;/p&gt;", None) == ["a & b\nc", "x", None]
    assert values(spark, T.redacted, "https://me:pw@host/x?app_key=12&y=1") == ["https://host/x?app_key=***&y=1"]


PAGES = {
    "arbeitnow": {"data": [{"slug": "s", "company_name": "C", "title": " T ", "description": "<p>x</p>", "url": "https://a/1", "remote": True, "location": "", "job_types": ["Vollzeit"], "created_at": 1767600000, "new": 1}]},
    "greenhouse": {"jobs": [{"id": 7, "title": "T", "company_name": "C", "content": "&lt;p&gt;x&lt;/p&gt;", "absolute_url": "https://a/1", "location": {"name": "Berlin; Remote"}, "metadata": [{"name": "Employment Type", "value": "Full-time"}], "first_published": "2026-01-05T10:00:00+02:00"}]},
    "polymer": {"items": [{"id": 7, "title": "T", "organization_name": "C", "description": "x", "kind_pretty": "Full time", "remoteness_pretty": "Remote", "job_post_url": "https://a/1", "published_at": "2026-01-05T08:00:00.000Z"}]},
    "pinpoint": {"data": [{"id": "7", "title": "T", "description": "x", "key_responsibilities": "<p>y</p>", "workplace_type": "onsite", "employment_type": "full_time", "url": "https://a/1", "location": {"city": "Berlin"}}]},
    "jobicy": {"jobs": [{"id": 7, "jobTitle": "T", "companyName": "C", "jobDescription": "x", "url": "https://a/1", "jobGeo": "UK,  Ireland", "jobType": ["full-time"], "pubDate": "2026-01-05T08:00:00+00:00"}]},
    "remotive": {"jobs": [{"id": 7, "title": "T", "company_name": "C", "job_type": "full_time", "publication_date": "2026-01-05T08:00:00", "candidate_required_location": "Worldwide", "description": "x", "url": "https://a/1"}]},
    "himalayas": {"jobs": [{"guid": "https://a/1", "title": "T", "companyName": "C", "employmentType": "Full Time", "locationRestrictions": ["Germany", "France"], "description": "x", "pubDate": 1767600000, "expiryDate": 1767500000, "applicationLink": "https://a/1"}]},
    "adzuna": {"results": [{"id": "7", "title": "T", "description": "x", "company": {"display_name": "C"}, "location": {"display_name": "Berlin"}, "redirect_url": "https://a/1", "created": "2026-01-05T08:00:00Z", "contract_time": "full_time"}]},
}


def landed(spark, *bodies):
    body = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    return spark.createDataFrame([(b, "brd", "gb") for b in body], "body string, board string, country string")


@pytest.mark.parametrize("key", sorted(PAGES))
def test_providers_normalise(spark, key):
    good, bad = providers.normalise(landed(spark, PAGES[key]), key)
    (r,) = good.collect()
    assert bad.count() == 0 and r["title"] == "T" and r["employment_type"] == "full_time" and r["application_url"] == "https://a/1"
    assert r["company"] == ("brd" if key == "pinpoint" else "C") and r["source_key"] == key and r["partial_description"] == (key == "adzuna")
    ids = {"arbeitnow": "s", "jobicy": "7", "remotive": "7", "himalayas": "https://a/1", "adzuna": "gb:7"}
    assert r["source_job_id"] == ids.get(key, "brd:7") and r["expires_at"] is None
    place = {"arbeitnow": None, "greenhouse": "Berlin; Remote", "polymer": None, "jobicy": "UK, Ireland", "remotive": "Worldwide", "himalayas": "Germany, France"}
    assert r["location"] == place.get(key, "Berlin")
    assert r["published_at"] == (None if key == "pinpoint" else datetime(2026, 1, 5, 8))
    kinds = {"greenhouse": "remote", "pinpoint": "onsite", "adzuna": "unspecified"}
    assert r["workplace_type"] == kinds.get(key, "remote")
    assert r["description"] == ("x\n\ny" if key == "pinpoint" else "x")


def test_bad_records_and_pages_fail_alone(spark):
    good = PAGES["arbeitnow"]["data"][0]
    page = {"data": [good, good | {"slug": " ", "title": None}, good | {"created_at": "yesterday"}, good | {"url": "ftp://x"}, good | {"created_at": -5}]}
    ok, bad = providers.normalise(landed(spark, page, "[]", {"data": 3}), "arbeitnow")
    assert ok.count() == 1
    assert rows(bad, "stage", "reason", "source_job_id") == sorted([
        ("page", "data: not a list of records", None), ("page", "data: not a list of records", None), ("validate", "slug: required; title: required", None),
        ("validate", "created_at: no date", "s"), ("validate", "created_at: no date", "s"), ("normalise", "application_url: http URL; source_url: http URL", "s"),
    ], key=str)
    (s,) = providers.failure_summary(bad).collect()
    assert s["total"] == 6 and s["by_stage"] == {"page": 2, "validate": 3, "normalise": 1} and len(s["reasons"]) == 4


def test_ids_without_a_part_are_null(spark):
    page = {"jobs": [PAGES["greenhouse"]["jobs"][0] | {"id": None}]}
    _, bad = providers.normalise(landed(spark, page), "greenhouse")
    assert rows(bad, "reason", "source_job_id") == [("id: required", None)]


def test_details_budget_and_files(spark, tmp_path):
    listed = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, title string, description string")
    detail = spark.createDataFrame([(1, "full")], "id int, description string")
    good, bad = providers.hydrated(listed, detail, ["id"])
    assert rows(good, "id", "title", "description") == [(1, "a", "full")] and rows(bad, "id") == [(2,)]
    some, more = providers.within_budget(spark.range(5), 3)
    assert some.count() == 3 and more and not providers.within_budget(spark.range(3), 3)[1]
    (tmp_path / "p.json").write_text('{"a":\n1}')
    (tmp_path / "f.xml").write_text('<f xmlns:k="u"><job id="3"><k:title>T</k:title></job><job id="4"/></f>')
    assert rows(providers.landed_pages(spark, str(tmp_path / "p.json")), "body") == [('{"a":\n1}',)]
    assert rows(providers.xml_records(spark, str(tmp_path / "f.xml"), "job", "`@id` long, title string"), "@id", "title") == [(3, "T"), (4, None)]


@pytest.mark.parametrize("size", [7, 100])
def test_pages_hold_every_row_once(spark, size):
    made = [(f"{k:03d}", DAY + timedelta(days=k // 9) if k % 4 else None) for k in range(250)]
    jobs = spark.createDataFrame(made, "id string, published_at timestamp_ntz").cache()
    if size == 7:
        jobs = jobs.where("id < '040'")
    seen, after = [], None
    while True:
        got, token = listing.page_and_cursor(jobs, size, after)
        seen += [r["id"] for r in got]
        if token is None:
            break
        after = listing.Cursor.decode(token)
    assert len(seen) == len(set(seen)) == jobs.count()
    with pytest.raises(ValueError):
        listing.page(jobs, 101)
    for wrong in ("!", "MnxhfGI", ""):
        with pytest.raises(ValueError):
            listing.Cursor.decode(wrong)


def records(spark, made):
    fields = "id long, source_key string, source_job_id string, company string, title string, description string, location string, partial boolean, arrival long"
    df = spark.createDataFrame([(*r[:8], k) for k, r in enumerate(made)], fields)
    blank = ["workplace_type", "employment_type", "application_url", "published_at", "expires_at"]
    return identity.keyed(df.select("*", *[F.lit("").alias(b) for b in blank]))


LONG = " ".join(f"word{k}" for k in range(40))


def test_identity_against_stored_jobs(spark):
    stored = records(spark, [(1, "a", "1", "C", "T", LONG, "Berlin", False), (2, "a", "2", "D", "T", LONG, None, False), (3, "a", "3", "D", "T", LONG + " x", None, False)])
    new = records(spark, [
        (11, "a", "1", "C", "T", LONG, "Berlin", False), (12, "b", "9", "C", "T (m/w/d)", LONG + " more", "Berlin, Germany", False),
        (13, "b", "8", "C", "T", LONG, "Paris", False), (14, "b", "7", "D", "T", LONG, "Rome", False), (15, "b", "6", "C", "T", LONG, None, True),
    ])
    known = spark.createDataFrame([("a", "1", 1)], "source_key string, source_job_id string, job_id long")
    assert rows(identity.decide(new, stored, known), "id", "job_id", "decision") == [
        (11, 1, "UNCHANGED"), (12, 1, "CHANGED"), (13, None, "NEW"), (14, None, "AMBIGUOUS"), (15, None, "NEW"),
    ]


def test_identity_within_a_batch_follows_arrival(spark):
    words = [f"w{k}" for k in range(100)]
    text = lambda drop: " ".join(w for k, w in enumerate(words) if k not in drop)
    a, b, c = text(range(12)), text([]), text(range(88, 100))
    first = records(spark, [(1, "a", "1", "C", "T", a, None, False), (2, "a", "2", "C", "T", c, None, False), (3, "a", "3", "C", "T", b, None, False)])
    assert rows(identity.fold_batch(first), "id", "job_id", "decision") == [(1, 1, "NEW"), (2, 2, "NEW"), (3, None, "AMBIGUOUS")]
    other = records(spark, [(3, "a", "3", "C", "T", b, None, False), (1, "a", "1", "C", "T", a, None, False), (2, "a", "2", "C", "T", c, None, False)])
    assert rows(identity.fold_batch(other), "id", "job_id", "decision") == [(1, 3, "MATCHED"), (2, 3, "MATCHED"), (3, 3, "NEW")]


FORMS = [("Postgres", "c1"), ("data analysis", "c2"), ("analysis", "c3"), ("analysis", "c4"), ("Python", "c5"), ("ai", "c6"), ("sql", "c7"), ("Straße", "c8"), ("cross-functional", "c9"), ("one two three four five six seven", "c10")]
TEXTS = ["We use POSTGRES and data-analysis daily.", "Python supports data analysis and analysis workflows.", "Said AI enables painting.", "SQL, sql, and SQL.", "STRASSE and cross_functional", "x one two three four five six seven y", None, ""]


@pytest.mark.parametrize("held", [10**6, 0])
def test_mentions(spark, held):
    vocabulary = extraction.load_vocabulary(spark.createDataFrame(FORMS, "surface_form string, concept string"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    found = extraction.extract_mentions(docs, vocabulary, held).cache()
    assert rows(found, "id", "surface_form", "concept", "start", "end") == [
        (0, "POSTGRES", "c1", 7, 15), (0, "data-analysis", "c2", 20, 33), (1, "Python", "c5", 0, 6), (1, "analysis", None, 34, 42), (1, "data analysis", "c2", 16, 29),
        (2, "AI", "c6", 5, 7), (3, "SQL", "c7", 0, 3), (3, "SQL", "c7", 14, 17), (3, "sql", "c7", 5, 8), (4, "STRASSE", "c8", 0, 7), (4, "cross_functional", "c9", 12, 28),
        (5, "one two three four five six seven", "c10", 2, 35),
    ]
    skills, loose = extraction.plan_skills(found)
    assert rows(skills.where("id = 3"), "concept", "surface_form") == [("c7", "SQL")]
    assert rows(loose, "id", "surface_form", "occurrences") == [(1, "analysis", 1)]
    terms = spark.createDataFrame([("postgres",), ("Analysis",), ("rust",)], "term string")
    assert rows(extraction.resolve_terms(terms, vocabulary), "term", "outcome", "concept") == [("Analysis", "AMBIGUOUS", None), ("postgres", "RESOLVED", "c1"), ("rust", "UNMAPPED", None)]
    unknown = extraction.unknown_terms(spark.createDataFrame([("SQL",), ("Rust",)], "surface_form string"), vocabulary)
    assert rows(unknown, "surface_form") == [("Rust",)]


@pytest.mark.parametrize("held", [10**6, 0])
def test_mentions_reach_over_punctuation(spark, held):
    vocabulary = spark.createDataFrame([("machine learning", "m"), ("c++", "c"), ("learning", None)], "form string, concept string")
    text = "Machine, learning and machine (learning), machine / learning; machine  learning, C++."
    found = extraction.extract_mentions(spark.createDataFrame([(1, text)], "id long, text string"), vocabulary, held)
    assert sorted((r["start"], r["surface_form"], r["form"], r["concept"]) for r in found.collect()) == [
        (0, "Machine, learning", "machine learning", "m"), (22, "machine (learning", "machine learning", "m"), (42, "machine / learning", "machine learning", "m"),
        (62, "machine  learning", "machine learning", "m"), (81, "C++", "c++", "c"),
    ]


@pytest.mark.parametrize("forms", [[("data", "a"), ("Data", "b")], [("data", "a"), ("data", None)], [("data", "a"), ("...", "b")], [("x, y", "a"), ("x y", "b")]])
def test_vocabularies_that_cannot_be_matched_raise(spark, forms):
    docs = spark.createDataFrame([(1, "data")], "id long, text string")
    with pytest.raises(ValueError, match="without a term|conflict"):
        extraction.extract_mentions(docs, spark.createDataFrame(forms, "form string, concept string")).collect()
    with pytest.raises(ValueError, match="without a term"):
        extraction.load_vocabulary(spark.createDataFrame([(" - ", "a")], "surface_form string, concept string"))


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("We run Amazon Web Services here", ["Amazon", "Amazon Web", "Amazon Web Services", "Web", "Web Services", "Services"]),
        ("Kubernetes is required", []),
        ("Done. Apache Kafka is used", ["Apache Kafka", "Kafka"]),
        ("we like One Two Three Four Five", ["One", "One Two", "One Two Three", "One Two Three Four", "Two", "Two Three", "Two Three Four", "Two Three Four Five", "Three", "Three Four", "Three Four Five", "Four", "Four Five", "Five"]),
        ("we use Node.js CI/CD C++ C# F# e.g and/or", None),
        ("the Go, Rust pair", ["Go", "Rust"]),
        ("use The Go tool\n  Rust", ["Go"]),
        ("", []),
    ],
)
def test_proposals(text, terms):
    found = extraction.proposals(text)
    assert all(text[a:b] == t for t, a, b in found)
    if terms is None:
        assert {"Node.js", "CI/CD", "C++", "C#", "F#", "e.g", "and/or"} <= {t for t, _, _ in found}
    else:
        assert [t for t, _, _ in found] == terms


def test_capitals_propose_nothing_where_they_are_grammar():
    text = "wir suchen Menschen mit Erfahrung in Technik und Freude an Arbeit " * 5 + "mit node.js"
    assert [t for t, _, _ in extraction.proposals(text)] == ["node.js"]


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, note string")
    table, added = upserts.insert_absent(stored, spark.createDataFrame([(2, "z", "z"), (3, "c", None), (3, "c", None)], stored.schema), ["id"])
    assert rows(table, "id", "name") == [(1, "a"), (2, "b"), (3, "c")] and rows(added, "id") == [(3,)]
    after = upserts.update_supplied(stored, spark.createDataFrame([(1, None, "n"), (4, "d", None)], "id long, name string, note string"), "id")
    assert rows(after, "id", "name", "note") == [(1, "a", "n"), (2, "b", None), (4, "d", None)]
    one = spark.createDataFrame([(1,)], "id long")
    assert rows(upserts.replace_children(stored, spark.createDataFrame([(1, "n", "n")], stored.schema), one, "id"), "id", "name") == [(1, "n"), (2, "b")]
    jobs, children = upserts.cascade_delete(stored, one, {"m": spark.createDataFrame([(1, 5), (2, 6)], "job_id long, v long")})
    assert rows(jobs, "id") == [(2,)] and rows(children["m"], "job_id") == [(2,)]
    fields = "job_id long, surface_form string, occurrences long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    old = spark.createDataFrame([(1, "sql", 3, DAY, DAY + timedelta(5)), (1, "java", 1, DAY, DAY), (2, "c", 1, DAY, DAY)], fields)
    new = spark.createDataFrame([(1, "sql", 2, DAY + timedelta(1), DAY + timedelta(1)), (1, "go", 1, DAY, DAY)], fields)
    got = upserts.upsert_mentions(old, new, spark.createDataFrame([(1,)], "job_id long"))
    assert rows(got, "job_id", "surface_form", "occurrences", "first_seen_at", "last_seen_at") == [(1, "go", 1, DAY, DAY), (1, "sql", 2, DAY, DAY + timedelta(5)), (2, "c", 1, DAY, DAY)]


def test_boards_and_retention(spark):
    polls = [("a", k, k, k > 1) for k in range(6)] + [("p", k, k, True) for k in range(5)] + [("r", k, k, k < 4) for k in range(5)]
    df = spark.createDataFrame([(b, DAY + timedelta(k), n, f) for b, k, n, f in polls], "board string, at timestamp_ntz, poll_id long, failed boolean")
    pinned = spark.createDataFrame([("p",)], "board string")
    got = rows(lifecycle.board_standing(df, pinned), "board", "consecutive_failures", "status")
    assert got == [("a", 4, "inactive"), ("p", 5, "confirmed"), ("r", 0, "confirmed")]
    jobs = [(1, "expired", DAY, None), (2, "removed", DAY, None), (3, "expired", DAY, DAY), (4, "active", DAY, None), (5, "expired", DAY + timedelta(39), None), (6, "expired", DAY, None)]
    jobs = spark.createDataFrame(jobs, "id long, status string, updated_at timestamp_ntz, anonymised_at timestamp_ntz")
    listed = spark.createDataFrame([(6, False), (1, True)], "job_id long, retired boolean")
    refs = spark.createDataFrame([(2,), (3,)], "job_id long")
    assert rows(lifecycle.retention(jobs, listed, refs, DAY + timedelta(40)), "id", "action") == [(1, "purge"), (2, "anonymise")]


def test_entitlement_to_retire():
    run = {"fetched": 5, "created": 2, "updated": 2, "skipped": 1, "failed": 0, "reached_the_end": True, "stopped_at_budget": False}
    assert lifecycle.may_reconcile(run) and lifecycle.may_reconcile(run, aged=True)
    for change in ({"fetched": 0}, {"stopped_at_budget": True}, {"reached_the_end": False}, {"failed": 1}, {"skipped": 0}):
        assert not lifecycle.may_reconcile(run | change)
    assert lifecycle.may_reconcile(run | {"failed": 1, "skipped": 0, "reached_the_end": False}, aged=True)
    assert not lifecycle.may_reconcile(run | {"skipped": 0}, aged=True)


def test_discovery(spark):
    assert values(spark, discovery.candidate_slugs, "Blue River GmbH", "Solo AG") == [["blueriver", "blue-river", "blue"], ["solo"]]
    names = ["Müller AG", "Café Blau GmbH", "jobbusters®", "A & B GmbH & Co KG.", "Straße 1, Ltd.", "West Group Holding e.V.", "ag", " ", None, "x" * 64, "Ünïcode--Name SE"]
    assert values(spark, discovery.candidate_slugs, *names) == [
        ["muller"], ["cafeblau", "cafe-blau", "cafe"], ["jobbusters"], ["ab", "a-b", "a"], ["strasse1", "strasse-1", "strasse"],
        ["westgroupholdingev", "west-group-holding-e-v", "west"], ["ag"], [], [], [], ["unicodename", "unicode-name"],
    ]
    same = spark.createDataFrame([("WPP Media", "wppmedia"), ("Acme Health", "Acme"), ("Acme", "ACME GmbH."), ("Acme Group", "Acme")], "a string, b string")
    assert [r[0] for r in same.select(discovery.belongs_to(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    companies = spark.createDataFrame([("Blue River GmbH",), ("Solo AG",), ("Nobody Here",)], "name string")
    boards = [("blueriver", True, "Other"), ("blue-river", False, None), ("blue", True, "BLUE RIVER"), ("solo", True, None)]
    boards = spark.createDataFrame(boards, "slug string, reachable boolean, stated_company string")
    assert rows(discovery.discover(companies, boards), "company", "slug", "outcome") == [
        ("Blue River GmbH", "blue", "confirmed"), ("Nobody Here", None, "not_found"), ("Solo AG", "solo", "unverifiable"),
    ]
    known = [(1, "B", None, None), (2, "A", None, DAY), (3, "C", "https://c", None), (4, "D", None, DAY - timedelta(100)), (5, "E", None, None)]
    known = spark.createDataFrame(known, "company_id long, display_name string, website_url string, website_checked_at timestamp_ntz")
    counts = spark.createDataFrame([(1, 2), (4, 9)], "company_id long, job_count long")
    assert [r["company_id"] for r in discovery.due_for_website(known, counts, DAY, 2).collect()] == [4, 1]
    held = [(1, 1, "x", "confirmed", False, DAY), (2, 1, "y", "not_found", False, DAY), (4, 1, "z", "not_found", False, DAY - timedelta(50)), (5, 1, "w", "blocked", True, DAY)]
    held = spark.createDataFrame(held, "company_id long, source_id long, slug string, status string, pinned boolean, last_checked_at timestamp_ntz")
    assert rows(discovery.due_for_discovery(known, held, DAY, {"not_found": 30}), "company_id") == [(3,), (4,)]
    sources = spark.createDataFrame([(1, "gh")], "source_id long, key string")
    assert [r["slug"] for r in discovery.polled_boards(held, sources, "gh").collect()] == ["x"]
    chain = spark.createDataFrame([(k, k + 1) for k in range(55)] + [(55, 3)], "parent long, child long")
    reach = discovery.taxonomy_reach(chain, spark.createDataFrame([(0,)], "node long"))
    assert reach.agg(F.max("depth"), F.count("*")).first() == (55, 56)


def test_dates_without_offset_and_beyond_all_years_are_refused(spark):
    given = ["2026-01-05T08:00:00Z", "2026-01-05T10:00:00+02:00", "2026-01-05T08:00:00", "2026-01-05", "1e18", "1767600000000", "1767600000", "-5", "x", None]
    eight = datetime(2026, 1, 5, 8)
    assert values(spark, providers._instant, *given) == [eight, eight, None, None, None, eight, eight, None, None, None]
    assert values(spark, lambda x: providers._instant(x, naive=True), *given[:4]) == [eight, eight, eight, datetime(2026, 1, 5)]


def test_polls_stand_alike_in_batch_and_stream(spark, tmp_path):
    """Pins hold, evidence decides what a success brings back, and counted failures go on from the registry's row."""
    registry = [
        ("a", "confirmed", 1, "provider_name", False, 2), ("b", "inactive", 1, "operator", False, 3), ("c", "inactive", None, "operator", True, 3),
        ("d", "named", 1, "site_title", False, 0), ("e", "candidate", None, None, True, 1), ("f", "inactive", 2, "site_title", False, 9), ("g", "inactive", 2, "site_title", False, 3),
    ]
    registry = spark.createDataFrame(registry, "slug string, status string, company_id long, kind string, pinned boolean, failures int")
    fails = {"a": [1], "b": [0], "c": [1, 0, 1], "d": [1, 1, 1, 0, 1], "e": [1, 1, 1, 1], "f": [0, 1, 1, 1], "g": [1], "unknown": [0]}
    polls = [(s, DAY + timedelta(k), k, bool(x)) for s, xs in fails.items() for k, x in enumerate(xs)]
    made = spark.createDataFrame(polls, "slug string, at timestamp, poll_id int, failed boolean")
    batch = rows(boards.after_polls(made, registry), "slug", "failures", "status")
    assert batch == [
        ("a", 3, "inactive"), ("b", 0, "candidate"), ("c", 1, "confirmed"), ("d", 1, "confirmed"), ("e", 5, "candidate"), ("f", 3, "inactive"), ("g", 4, "inactive"),
    ]
    source = stream(spark, str(tmp_path / "p"), [(s, at, f) for s, at, _, f in polls if at < DAY + timedelta(2)], "board string, at timestamp, failed boolean")
    stream(spark, str(tmp_path / "p"), [(s, at, f) for s, at, _, f in polls if at >= DAY + timedelta(1)], "board string, at timestamp, failed boolean")
    last = {}
    keep = lambda df, n: last.update({r["board"]: (r["consecutive_failures"], r["status"]) for r in df.collect()})
    query = runs.board_failures(source, registry).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c"))
    finished(query.trigger(availableNow=True).start())
    assert sorted((s, *x) for s, x in last.items()) == batch


def stream(spark, path, made, schema):
    spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(query):
    query.awaitTermination(120)
    return query


def test_streams(spark, tmp_path):
    fields = "source_key string, source_job_id string, seen_at timestamp"
    seen = [("a", "1", DAY), ("a", "1", DAY + timedelta(2)), ("a", "2", DAY)]
    path = str(tmp_path / "seen")
    stream(spark, path, seen, fields)
    source = stream(spark, path, seen[:1], fields)
    out = {}

    def keep(name):
        return lambda df, n: out.setdefault(name, []).extend(df.collect())

    finished(runs.sightings(source).writeStream.outputMode("complete").format("memory").queryName("sightings").trigger(availableNow=True).start())
    assert rows(spark.table("sightings"), "source_job_id", "first_seen_at", "last_seen_at", "sightings") == [("1", DAY, DAY + timedelta(2), 3), ("2", DAY, DAY, 1)]
    finished(runs.run_available(runs.first_arrivals(source), keep("first"), str(tmp_path / "c1")))
    assert sorted(r["source_job_id"] for r in out["first"]) == ["1", "2"]
    finished(runs.run_available(runs.first_arrivals(source), keep("again"), str(tmp_path / "c1")))
    assert not out.get("again")
    polls = stream(spark, str(tmp_path / "polls"), [("b", DAY + timedelta(k), k != 1) for k in range(5)] + [("b", DAY, True)], "board string, at timestamp, failed boolean")
    query = runs.board_failures(polls).writeStream.outputMode("update").foreachBatch(keep("boards")).option("checkpointLocation", str(tmp_path / "c2"))
    finished(query.trigger(availableNow=True).start())
    assert [tuple(r) for r in out["boards"]][-1] == ("b", 3, "inactive")
    attempts = stream(spark, str(tmp_path / "tries"), [("k", DAY + timedelta(seconds=s)) for s in range(12)], "key string, at timestamp")
    finished(runs.throttle(attempts).writeStream.outputMode("complete").format("memory").queryName("tries").trigger(availableNow=True).start())
    assert rows(spark.table("tries"), "key", "attempts", "refused") == [("k", 12, 2)]


def test_samples_and_contexts(spark):
    made = spark.createDataFrame([(k, "a" if k < 8 else "b") for k in range(10)], "id long, stratum string")
    quotas = measure.largest_remainder(made.groupBy("stratum").agg(F.count("*").alias("size")), 5)
    assert rows(quotas, "stratum", "quota") == [("a", 4), ("b", 1)]
    picked = measure.stratified_sample(made, quotas)
    assert rows(picked, "id") == rows(measure.stratified_sample(made, quotas), "id") and picked.count() == 5
    mentions = [("sql", f"e{k % 3}", k, "we use sql here", 7, 10) for k in range(9)]
    mentions = spark.createDataFrame(mentions, "surface_form string, employer string, id long, text string, start int, end int")
    assert measure.contexts(mentions, 2).count() == 2 and measure.contexts(mentions, 8, 3).first()["context"] == "se sql he"
    audit = measure.form_audit(spark.createDataFrame([("sql", 1, "a"), ("sql", 1, "a"), ("sql", 2, "b"), ("go", 3, "a")], "form string, id long, employer string"))
    assert rows(audit, "form", "mentions", "postings", "employers", "employer_rate") == [("go", 1, 1, 1, 0.5), ("sql", 3, 2, 2, 1.0)]
