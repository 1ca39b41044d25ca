"""Website runs, landed pages, uploads, retention's effects and what a reader sees, on hand-written rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobloom.functions.sites import is_public_url
from jobloom.operators import cvs, discovery, lifecycle, listing
from jobloom.sources import landing

NOW = datetime(2025, 6, 1)
FIRMS = "company_id long, display_name string, website_url string, website_source string, website_checked_at timestamp_ntz"


def told(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_websites_come_from_postings_then_from_the_only_entity(spark):
    old, new = NOW - timedelta(days=91), NOW - timedelta(days=90)
    firms = [
        (1, "Acme GmbH", None, None, None), (2, "Blue", None, None, old), (3, "Cyan", None, None, new), (4, "Dune", "https://d/", "source", None), (5, "Echo", None, None, None),
        (6, "Fern", None, None, None), (7, "Gale", None, None, None),
    ]
    payloads = [
        (1, '{"a": "https://www.Acme.de/x https://acme.de/y", "b": "https://jobs.lever.co/z"}'), (1, "http://acme.de https://notlever.co"), (1, "https://lever.co"), (1, "https://lever.co"),
        (2, "https://one.de https://two.de"), (2, "https://one.de https://two.de"), (5, "https://once.de"), (5, None), (9, "https://x.de"),
    ]
    entities = [
        (1, "Acme", True, "https://other.de"), (2, "BLUE AG", True, "https://blue.de"), (2, "Blue", False, "https://no.de"), (2, "Bluest", True, "https://no.de"), (2, "Blue", True, " "),
        (5, "Echo", True, "https://e1.de"), (5, "Echo", True, "https://e2.de"), (6, None, True, "https://f.de"), (6, "Fern", None, "https://f.de"), (6, "Fern", True, None),
    ]
    make = spark.createDataFrame
    given = make(firms, FIRMS), make([(2, 9), (1, 5), (5, 3), (6, 1)], "company_id long, job_count long"), make(payloads, "company_id long, payload string")
    found = make(entities, "company_id long, label string, business boolean, website string")
    after, summary = discovery.resolve_websites(*given, found, NOW, budget=4)
    assert told(after, "company_id", "website_url", "website_source", "website_checked_at") == [
        (1, "https://acme.de/", "postings", NOW), (2, "https://blue.de", "wikidata", NOW), (3, None, None, new), (4, "https://d/", "source", None), (5, None, None, NOW),
        (6, None, None, NOW), (7, None, None, None),
    ]
    assert told(summary) == [(5, 4, 1, 1, 2, True)]
    nothing, zeros = discovery.resolve_websites(*(df.limit(0) for df in given), found.limit(0), NOW)
    assert nothing.isEmpty() and told(zeros) == [(0, 0, 0, 0, 0, False)]


def test_walks_end_at_gaps_failures_bounds_or_the_last_page(spark):
    t = [datetime(2025, 1, 1, h) for h in range(3)]
    rows = [
        ("done", 1, t[0], False, True, 10), ("done", 2, t[0], False, False, 5), ("done", 3, t[0], False, False, 99), ("gap", 1, t[0], False, True, 10), ("gap", 3, t[0], False, False, 5),
        ("bad", 1, t[0], False, True, 10), ("bad", 2, t[0], True, True, 7), ("bad", 3, t[0], False, False, 5), ("long", 1, t[0], False, True, 1), ("long", 2, t[0], False, True, 1),
        ("long", 3, t[0], False, True, 1), ("long", 4, t[0], False, False, 1), ("late", 2, t[0], False, False, 4), ("again", 1, t[0], True, True, 3), ("again", 1, t[1], None, None, 2),
        ("zero", 0, t[0], False, True, 8), ("zero", 1, t[0], False, False, None),
    ]
    pages = spark.createDataFrame(rows, "scan string, page int, landed_at timestamp_ntz, failed boolean, more boolean, records long")
    wanted = spark.createDataFrame([(s,) for s in ("done", "gap", "bad", "long", "late", "again", "zero", "none")], "scan string")
    ends = {"again": (1, 2, "complete"), "bad": (1, 10, "failed"), "done": (2, 15, "complete"), "gap": (1, 10, "failed"), "late": (0, 0, "failed"), "long": (3, 3, "stopped_at_bound"), "none": (0, 0, "failed"), "zero": (1, 0, "complete")}
    assert told(landing.scans(pages, wanted, 3)) == [(s, *e, e[2] == "complete") for s, e in ends.items()]
    whole = {s: e if e[2] == "complete" else (0, 0, "failed") for s, e in ends.items()}
    assert told(landing.scans(pages, wanted, 3, whole=True)) == [(s, *e, e[2] == "complete") for s, e in whole.items()]
    assert told(landing.usable(pages, 3), "scan", "page") == [("again", 1), ("bad", 1), ("done", 1), ("done", 2), ("gap", 1), ("long", 1), ("long", 2), ("long", 3), ("zero", 1)]
    assert told(landing.usable(pages, 3, whole=True), "scan", "page") == [("again", 1), ("done", 1), ("done", 2), ("zero", 1)]
    assert landing.scans(pages.limit(0), wanted.limit(0)).isEmpty()


def test_uploads_are_refused_for_the_first_fault(spark):
    pdf, body = "application/pdf", b"%PDF-1.7"
    cases = [
        (("cv.pdf", pdf, 1, body), None), (("a.b.PdF", pdf, 5 * 1024 * 1024, body), None), (("é" * 251 + ".pdf", pdf, 9, body), None), (("é" * 252 + ".pdf", pdf, 9, body), "invalid_filename"),
        ((None, pdf, 9, body), "invalid_filename"), (("", None, 0, None), "invalid_filename"), ((".pdf", pdf, 9, body), "invalid_filename"), (("a/b.pdf", pdf, 9, body), "invalid_filename"),
        (("a\\b.pdf", pdf, 9, body), "invalid_filename"), ((" a.pdf", pdf, 9, body), "invalid_filename"), (("a.pdf\n", pdf, 9, body), "invalid_filename"), (("a​b.pdf", pdf, 9, body), "invalid_filename"),
        (("a.pdf　", pdf, 9, body), "invalid_filename"), (("pdf", pdf, 9, body), "invalid_filename"), (("a.txt", pdf, 9, body), "invalid_filename"), (("a.pdf", pdf, 0, b""), "empty_file"),
        (("a.pdf", pdf, None, body), "empty_file"), (("a.pdf", None, 5 * 1024 * 1024 + 1, body), "file_too_large"), (("a.pdf", "text/html", 9, b"x"), "unsupported_media_type"),
        (("a.pdf", None, 9, body), "unsupported_media_type"), (("a.pdf", pdf, 9, b" %PDF-"), "unsupported_content"), (("a.pdf", pdf, 9, None), "unsupported_content"),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, name string, type string, size long, head binary")
    got = dict(told(df.select("k", cvs.upload_refusal(*map(F.col, ("name", "type", "size", "head"))).alias("why")), "k", "why"))
    assert got == {k: why for k, (_, why) in enumerate(cases)}


def test_newer_uploads_and_other_owners_stay(spark):
    a, b = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [(1, 1, a), (1, 2, a), (1, 3, b), (1, 4, None), (2, 5, a), (2, 6, b), (3, 7, a)]
    stored = spark.createDataFrame(rows, "owner_id long, cv_id long, created_at timestamp_ntz")
    kept = lambda *ids: spark.createDataFrame(ids, "owner_id long, cv_id long")
    assert told(cvs.superseded(stored, kept((1, 2))), "cv_id") == [(1,)]
    assert told(cvs.superseded(stored, kept((1, 3), (1, 3), (2, 5))), "cv_id") == [(1,), (2,)]
    assert told(cvs.superseded(stored, kept((1, 3), (1, 2))), "cv_id") == [(1,)]
    assert cvs.superseded(stored, kept((3, 6), (9, 9), (1, 4))).isEmpty() and cvs.superseded(stored.limit(0), kept((1, 2))).isEmpty()


def test_only_plain_public_urls_may_be_looked_at(spark):
    good = ["http://a.de", "HTTPS://A.de:443/x?y@z", " https://a.de:/", "http://a.de:80#x", "https://localhost.de", "https://internal.de", "https://1a.de"]
    bad = [
        None, "", "a.de", "ftp://a.de", "https://", "https:///x", "https://u@a.de", "https://u:p@a.de", "https://a.de:8080", "https://a.de:99999", "http://127.0.0.1", "http://2130706433", "http://127.1/",
        "http://[::1]/", "http://localhost:80", "http://LOCALHOST", "http://x.localhost", "http://a.local/", "https://db.internal.", "http://0x7f.1", "http://a b.de", "http://a.de\\@b.de:8",
    ]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(good + bad)], "k int, u string")
    assert told(df.select("k", is_public_url(F.col("u")).alias("ok"))) == sorted([(k, k < len(good)) for k in range(len(good + bad))], key=str)


def test_retention_purges_or_empties(spark):
    jobs = spark.createDataFrame(
        [(k, "T", "text", "here", "https://x", "expired") for k in (1, 2, 3)], "id long, title string, description string, location string, application_url string, status string"
    )
    accounts = spark.createDataFrame([(1, 1, "{}"), (1, 2, None), (2, 1, "{}"), (3, 1, "{}")], "job_id long, source_id long, raw_payload string")
    actions = spark.createDataFrame([(1, "anonymise"), (1, "anonymise"), (2, "purge")], "id long, action string")
    after, left = lifecycle.retained(jobs, accounts, actions, NOW)
    assert told(after) == [(1, "T", lifecycle.ANONYMISED_TEXT, None, "", "expired", NOW), (3, "T", "text", "here", "https://x", "expired", None)]
    assert [(j, s, json.loads(p)) for j, s, p in told(left)] == [(1, 1, {"_anonymised_at": NOW.isoformat()}), (1, 2, {"_anonymised_at": NOW.isoformat()}), (3, 1, {})]
    assert told(lifecycle.retained(after, left, actions.limit(0), NOW)[0]) == told(after)


def test_readers_see_companies_and_attributions_only(spark):
    columns = "id long, company_id long, title string, description string, location string, workplace_type string, employment_type string, application_url string, published_at timestamp_ntz, expires_at timestamp_ntz, status string, secret string"
    jobs = spark.createDataFrame([(1, 1, "T", "\t0 one \n\n two\r\n1", None, "remote", "contract", "https://x", NOW, None, "active", "s"), (2, 9, "U", None, None, None, None, None, None, None, None, None)], columns)
    firms = spark.createDataFrame([(1, "Acme", None)], "id long, display_name string, website_url string")
    accounts = spark.createDataFrame([(1, 2, "u2"), (1, 1, "u1"), (1, 1, "u1"), (5, 1, "u5")], "job_id long, source_id long, source_url string")
    sources = spark.createDataFrame([(1, "b", "B"), (2, "a", "A")], "source_id long, key string, display_name string")
    card, bare = sorted((r.asDict(True) for r in listing.shown(jobs, firms, accounts, sources).collect()), key=lambda r: r["id"])
    assert tuple(card) == listing.ON_CARD and card["company"] == {"id": 1, "display_name": "Acme", "website_url": None} and card["excerpt"] == "0 one two 1"
    assert card["sources"] == [{"key": "a", "display_name": "A", "url": "u2"}, {"key": "b", "display_name": "B", "url": "u1"}]
    assert bare["company"] is None and bare["sources"] == [] and bare["excerpt"] == ""
    page = listing.shown(jobs, firms, accounts, sources, whole=True)
    assert tuple(page.columns) == listing.ON_PAGE and told(page, "id", "description") == [(1, "\t0 one \n\n two\r\n1"), (2, None)]
