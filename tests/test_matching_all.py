"""Matching queries over every candidate and whole documents, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from jobloom.operators import matching, measure
from jobloom.plans.catalogue import QUERIES
from jobloom.sources import bindings as B


@pytest.fixture(scope="module")
def sides(spark, sf_dir):
    active = {r["id"] for r in B.jobs(spark, sf_dir).collect() if r["status"] == "active"}
    asks, has = defaultdict(set), defaultdict(set)
    for r in B.job_skills(spark, sf_dir).collect():
        if r["job_id"] in active:
            asks[r["job_id"]].add(r["concept"])
    for r in B.candidate_skills(spark, sf_dir).collect():
        has[r["candidate_id"]].add(r["concept"])
    return asks, has


def test_every_candidate_is_ranked_by_coverage(spark, sf_dir, sides):
    asks, has = sides
    want, told = set(), set()
    for c, own in has.items():
        scored = sorted((-len(own & x) / len(x), j) for j, x in asks.items() if own & x) if len(own) >= 3 else []
        want |= {(c, j, len(has[c] & asks[j]), len(asks[j]), k) for k, (_, j) in enumerate(scored[:10], 1)}
        told |= {(c, j, ";".join(sorted(own & asks[j])), ";".join(sorted(asks[j] - own))) for _, j in scored[:5]}
    got = QUERIES["coverage_match_topk_all"](spark, sf_dir).collect()
    assert {(r["candidate_id"], r["job_id"], r["matched"], r["required"], r["rank"]) for r in got} == want and len(got) == len(want)
    got = QUERIES["coverage_explained_all"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == told and len(got) == len(told)


def test_every_candidate_is_ranked_by_cosine(spark, sf_dir, sides):
    asks, has = sides
    df = Counter(x for own in asks.values() for x in own)
    w2 = {x: (math.log((1 + len(asks)) / (1 + n)) + 1) ** 2 for x, n in df.items()}
    norm = lambda xs: math.sqrt(sum(w2.get(x, 0) for x in xs))
    got = defaultdict(dict)
    for r in QUERIES["tfidf_cosine_topk_all"](spark, sf_dir).collect():
        got[r["candidate_id"]][r["rank"]] = r["score"]
    want = {}
    for c, own in has.items():
        scored = sorted((sum(w2[x] for x in own & asks[j]) / norm(own) / norm(asks[j]) for j in asks if own & asks[j]), reverse=True)[:10]
        if scored:
            want[c] = dict(enumerate(scored, 1))
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c], abs=2e-6) for c in want)


def test_spans_meet_in_buckets_as_all_with_all(spark):
    rng = random.Random(4)
    lay = lambda n, longest: [(rng.choice([1, 2, None]), a := rng.randrange(3000), a + rng.choice([0, 1, 9, longest])) for _ in range(n)]  # noqa: E731, F841
    gold, found = lay(150, 700), lay(120, 400)
    gold += gold[:5]
    make = lambda rows: spark.createDataFrame([(*r, "c") for r in rows], "posting long, start int, end int, category string")
    meets = lambda x, others: x[0] is not None and any(o[0] == x[0] and x[1] < o[2] and o[1] < x[2] for o in others)
    got = {r["posting"]: tuple(r)[1:] for r in measure.span_scores(make(gold), make(found)).collect()}
    assert got == {
        p: (sum(g[0] == p for g in gold), sum(g[0] == p and meets(g, found) for g in gold), sum(f[0] == p for f in found), sum(f[0] == p and meets(f, gold) for f in found))
        for p in (1, 2)
    }
    half = found[: len(found) // 2]
    tail = sorted(str(tuple(r)[:3]) for r in measure.gold_tail(make(gold), make(half), make(found)).collect())
    assert tail == sorted(str(g) for g in gold if not meets(g, found))


def test_intervals_hold_the_estimates(spark):
    rng = random.Random(9)
    rows = [(k, n := rng.randrange(1, 30), rng.randrange(n + 1), n // 2) for k in range(300)]
    scores = spark.createDataFrame([*rows, (None, None, None, None)], "posting long, gold long, one long, two long")
    both = {"one": ("one", "gold"), "two": ("two", "gold")}
    out = {r["name"]: r for r in measure.bootstrap(scores.repartition(5), both, [("one", "two")], rounds=2000).collect()}
    gold = sum(r[1] for r in rows)
    assert out["one"]["estimate"] == pytest.approx(sum(r[2] for r in rows) / gold)
    assert out["one minus two"]["estimate"] == pytest.approx(out["one"]["estimate"] - out["two"]["estimate"]) and out["one minus two"]["design_effect"] is None
    assert all(r["low"] < r["estimate"] < r["high"] for r in out.values())
    # The interval's width is that of the linearised ratio's standard error.
    rest = [r[2] - out["one"]["estimate"] * r[1] for r in rows]
    error = math.sqrt(sum(x * x for x in rest)) / gold
    assert out["one"]["high"] - out["one"]["low"] == pytest.approx(3.92 * error, rel=0.12)
    nothing = measure.bootstrap(scores.limit(0), both, rounds=10).collect()
    assert {(r["estimate"], r["low"]) for r in nothing} == {(None, None)}


@pytest.mark.parametrize("digits", [None, 6])
def test_only_the_best_pairs_leave_the_blocks(spark, digits):
    rng = random.Random(11)
    asks = {j: set(rng.sample("abcdefghij", rng.choice([1, 2, 2, 3, 5]))) for j in range(1, 90)}
    has = {c: set(rng.sample("abcdefghijk", rng.choice([1, 3, 6]))) for c in range(1, 30)}
    has |= {c + 100: own for c, own in has.items()}
    rows = lambda of, key: spark.createDataFrame([(k, x) for k, own in of.items() for x in own], f"{key} long, concept string")
    u = {x: 1.0 if digits is None else 1.0 + k / 7 for k, x in enumerate("abcdefghij")}
    total = lambda own: sum(u.get(x, 0.0) for x in own)
    norm = {j: total(own) if digits is None else math.sqrt(total(own)) for j, own in asks.items()}
    own_norm = {c: 1.0 if digits is None else math.sqrt(total(own)) for c, own in has.items()}
    norms = spark.createDataFrame(list(norm.items()), "job_id long, norm double"), spark.createDataFrame(list(own_norm.items()), "candidate_id long, own double")
    weights = spark.createDataFrame(list(u.items()), "concept string, u double")
    blocks = {"job_block": 7, "candidate_block": 5}
    for more in ({}, {"first_jobs": 3}):
        found = matching.best_pairs(rows(asks, "job_id"), rows(has, "candidate_id"), weights, norms, 4, digits, **blocks, **more).collect()
        got = defaultdict(list)
        for r in found:
            got[r["candidate_id"]].append((-round(r["score"], 6), r["job_id"], r["matched"]))
        for c, own in has.items():
            scored = sorted((-round(total(own & x) / norm[j] / own_norm[c], 6), j, len(own & x)) for j, x in asks.items() if own & x)
            assert sorted(got[c]) == scored[:4]
