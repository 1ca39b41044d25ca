"""Steps whose cost must follow their input: the same results however the work is dealt out."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobloom.functions.text import blocks, folded
from jobloom.operators import boards, boilerplate, extraction, identity, matching


def test_terms_are_counted_alike_however_few_a_task_holds(spark):
    rng = random.Random(5)
    texts = [None, "", "  ", *(" ".join(rng.choices(["The", "of", "Data", "SQL", "spark", "x1", "é"], k=rng.randrange(12))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = Counter()
    for text in texts:
        words = [w for w in (text or "").lower().split() if w != "é"]
        runs = {tuple(words[k : k + n]) for n in range(1, 5) for k in range(len(words) - n + 1)}
        want.update(" ".join(r) for r in runs if not {r[0], r[-1]} & extraction.STOPWORDS)
    want = {t: n for t, n in want.items() if 2 <= n <= 0.5 * len(texts)}
    for held in (1, 7, 1_000):
        rows = extraction.ngram_frequencies(docs, longest=4, least=2, share=0.5, held=held).collect()
        assert {r["term"]: r["df"] for r in rows} == want and len(rows) == len(want)


def test_a_backfill_deals_no_texts_out(spark):
    rows = [(k, f"Acme{k % 3} GmbH", f"Acme{k % 3} builds tools.\nText {k}") for k in range(40)]
    postings = spark.createDataFrame(rows, "posting_id long, employer string, description string")
    changes = boilerplate.rewrites(postings, boilerplate.removable_stored(postings))
    assert {(r["posting_id"], r["description"], r["removed_blocks"]) for r in changes.collect()} == {(k, f"Text {k}", 1) for k in range(40)}
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_blocks_are_trimmed_and_folded_as_their_patterns_say(spark):
    texts = [" \t a  b  \r\n\n\x0b c \f  d \n", "Straße\nSTRASSE ẞ\nﬁx", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(blocks(F.col("t")).alias("b"), F.transform(blocks(F.col("t")), folded).alias("f")).collect()
    assert [r["b"] for r in rows] == [["a  b ", "c", " d "], ["Straße", "STRASSE ẞ", "ﬁx"], [], []]
    assert [r["f"] for r in rows] == [[" a b ", " c ", " d "], [" strasse ", " strasse ss ", " fix "], [], []]


def plain_proposals(text):
    """Proposals token by token, as they are described."""
    words = re.findall(r"[A-Za-zÀ-ɏ][\wÀ-ɏ]*", text)
    dense = len(words) >= 30 and sum(w[0].isupper() for w in words) > 0.25 * len(words)
    kinds = re.compile(rf"(?P<marked>{extraction.PUNCTUATED})|(?P<capital>{extraction.CAPITALISED})|[\wÀ-ɏ]+")
    tokens = list(kinds.finditer(text))
    named = [bool(m.lastgroup) and not (dense and m.lastgroup == "capital") and m.group().casefold() not in extraction.STOPWORDS for m in tokens]
    found = []
    for k, m in enumerate(tokens):
        before = text[max(0, m.start() - 40) : m.start()]
        said = before.rstrip()
        opens = not said or said[-1] in ".!?:;)]" or "\n" in before[len(said) :]
        for n in range(4):
            run = tokens[k : k + n + 1]
            if len(run) <= n or not all(named[k : k + n + 1]) or any(text[a.end() : b.start()].strip() for a, b in zip(run, run[1:])):
                break
            if n or not opens:
                found.append((text[m.start() : run[-1].end()], m.start(), run[-1].end()))
    return found


def test_proposals_pass_over_plain_words_without_loss(spark):
    rng = random.Random(11)
    signs = [*"aBcD.+/# \n×÷ÀßÞ_1é!:İɐ", *" " * 5, "The ", " Foo", "Kafka ", " c++", " a.b"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 160))) for _ in range(3_000)]
    want = [plain_proposals(t) for t in texts]
    assert [extraction.proposals(t) for t in texts] == want
    docs = spark.createDataFrame([*enumerate(texts[:300]), (300, None)], "id long, text string")
    rows = extraction.propose_candidates(docs).collect()
    assert sorted((r["id"], r["start"], r["end"], r["surface_form"]) for r in rows) == sorted((k, a, b, t) for k, p in enumerate(want[:300]) for t, a, b in p)
    # A long text of plain words is gone through once.
    assert extraction.proposals("word " * 400_000 + "Kafka") == [("Kafka", 2_000_000, 2_000_005)]
    assert "MapInArrow" in extraction.propose_candidates(docs)._jdf.queryExecution().executedPlan().toString()


def test_probes_are_registered_without_a_table_sent_to_the_driver(spark):
    pick = lambda xs, k: xs[k % len(xs)]
    answers, named = ("unverifiable", "not_found", "confirmed", "named", None), ("confirmed", "named", None, "wrong_company")
    probes = [(k, k % 5, f"s{k * 7 % 11}", pick(answers, k // 3), f"s{(k * 5 + 1) % 11}", pick(named, k)) for k in range(200)]
    held = [(f"s{k}", pick(("confirmed", "inactive", "blocked", "candidate"), k), k % 3, None, None if k % 2 else False, None) for k in range(0, 20, 2)]
    boards_ = spark.createDataFrame(held, "slug string, status string, company_id long, kind string, pinned boolean, failures int")
    made = spark.createDataFrame(probes, "probe long, company_id long, slug string, answer string, other_slug string, other_answer string")
    outcomes, rows = boards.register(made.repartition(3), boards_)
    for df in (outcomes, rows, boards.tallied(outcomes)):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert outcomes.count() == outcomes.distinct().count() == 200
    after = {r["slug"]: tuple(r)[1:] for r in rows.collect()}
    # Boards that no probe named are as they were.
    assert all(after[s] == tuple(rest) for s, *rest in held if int(s[1:]) >= 11)


def test_labels_are_normalised_once_each(spark):
    vocabulary = extraction.load_vocabulary(spark.createDataFrame([("Apache-Kafka", "kafka"), ("SQL", "sql"), ("sql", "query")], "surface_form string, concept string"))
    rows = [(1, ["apache kafka!", "x"]), (2, ["Sql"]), (3, ["none", None]), (4, []), (5, None), (6, ["sql", "SQL"]), (6, ["SQL"])]
    told = extraction.gold_resolution(spark.createDataFrame(rows, "mention long, labels array<string>"), vocabulary)
    assert tuple(told.first())[:2] == (7, 3)
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"ArrowEvalPython \[form\(term.*\n(\W*Filter.*\n)?\W*Relation \[term#\d+\]", plan)


@pytest.mark.parametrize("words", [12, 64, 200])
@pytest.mark.parametrize("digits", [None, 6])
def test_masks_of_concepts_lose_no_best_pair(words, digits):
    rng = np.random.default_rng(words)
    weight = np.ones(words) if digits is None else 1 + rng.random(words)
    sets = lambda n, most: [np.sort(rng.choice(words, rng.integers(1, most), replace=False)) for _ in range(n)]
    asks, held, limit = sets(3_000, 9), sets(150, 12), 4
    norm = np.array([weight[a].sum() if digits is None else np.sqrt(weight[a].sum()) for a in asks])
    has = np.array([weight[h].sum() for h in held])
    own = np.ones(len(held)) if digits is None else np.sqrt(has)
    ids = rng.permutation(len(asks))
    lists = lambda xs, kind: pa.array([x.tolist() for x in xs], pa.list_(kind))
    jobs = pa.table({"kind": ids, "norm": norm, "asks": lists(asks, pa.int64()), "u": lists([weight[a] for a in asks], pa.float64())})
    people = pa.table({"person": np.arange(len(held)), "own": own, "has": has, "held": lists(held, pa.int64()), "floor": np.zeros(len(held))})
    want = []
    for k, h in enumerate(held):
        mine = set(h.tolist())
        common = [[c for c in a.tolist() if c in mine] for a in asks]
        scored = sorted((-round(weight[c].sum() / (norm[j] * own[k]), digits or 12), ids[j], len(c)) for j, c in enumerate(common) if c)
        want += [(k, j, n, -s) for s, j, n in scored[:limit]]
    columns = [c.to_pylist() for c in matching._best_of_blocks(jobs, people, limit, digits)]
    assert sorted((p, j, n, round(s, digits or 12)) for p, j, n, s in zip(*columns)) == sorted(want)


def test_texts_that_share_too_few_parts_do_not_meet(spark):
    rng = random.Random(3)
    words = [[f"w{k}", *rng.sample([f"common{c}" for c in range(30)], 5), *(f"own{k}x{c}" for c in range(45))] for k in range(60)]
    near = [["a"], [f"n{c}" for c in range(50)], [f"n{c}" for c in range(48)]]
    df = spark.createDataFrame([(k, "key", w, [], False) for k, w in enumerate(words + near)], "id long, match_key string, vocabulary array<string>, cities array<string>, partial boolean")
    assert {r["id"] for r in identity.meeting_words(df).select("id").distinct().collect()} == {61, 62}
    pairs = identity.block_pairs(df, df, lambda mine, other: mine > other).collect()
    assert [tuple(r) for r in pairs] == [(62, 61, 0.96)]


def test_words_of_records_with_a_lone_key_are_not_read(spark):
    def told(text):
        if text.startswith("lone"):
            raise ValueError("a text that nothing can agree with")
        return text.split()

    rows = [(1, "a", "x y z"), (2, "a", "z y x"), (3, "b", "lone b"), (4, None, "lone"), (5, "c", "lone c")]
    df = spark.createDataFrame(rows, "id long, match_key string, text string")
    df = df.withColumns({"partial": F.lit(False), "cities": F.array().cast("array<string>")})
    read = lambda sides: [x.withColumn("vocabulary", F.udf(told, "array<string>")("text")) for x in sides]
    (own,) = read(identity.rivalled(df))
    assert {tuple(r)[:2] for r in identity.block_pairs(own, own).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    left, right = read(identity.rivalled(df.where("id in (1, 3)"), df.where("id in (2, 5)")))
    assert [tuple(r) for r in identity.block_matches(left, right).collect()] == [(1, 1, 2)]
