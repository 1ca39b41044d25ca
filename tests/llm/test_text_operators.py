"""Licence, secret, quality and toxicity operators against plain Python, and the cases their docstrings define."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from corpus_cases import CASES, SCHEMA, clashing
from jobloom.llm import licenses, queries, quality_crf, secrets, toxicity
from jobloom.llm.license_texts import TEMPLATES
from jobloom.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_licences_agree_with_plain_dice(spark):
    mit = TEMPLATES["MIT"]
    texts = [None, "", "one", mit, mit.upper(), "Intro line\n" + " ".join(mit.split()) + "\nend", mit[: len(mit) // 2]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc"], r["line"]): (r["license"], r["dice"]) for r in licenses.scan(docs).where("unit <> 'passage'").collect()}
    want = {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        for line, unit in [(-1, t or ""), *(list(enumerate(lines)) if len(lines) > 1 else [])]:
            mine = set(licenses.bigram_set(unit))
            scored = []
            for name, template in TEMPLATES.items():
                other = set(licenses.bigram_set(template))
                if mine:
                    scored.append((-2 * len(mine & other) / (len(mine) + len(other)), name))
            if scored and -min(scored)[0] >= 0.9:
                want[k, line] = (min(scored)[1], pytest.approx(-min(scored)[0]))
    assert got == want
    assert {k for k, _ in got} >= {3, 4, 5}


def test_licences_are_found_inside_longer_files(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    wrapped = lambda t: "\n".join(" * " + " ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    changed = TEMPLATES["GPL-3.0"].replace("This program", "Frob").replace("hope that", "hope")
    texts = [f"{prose(40)}\n{wrapped(t)}\n{prose(300)}" for t in (TEMPLATES["MIT"], TEMPLATES["Apache-2.0"], changed)]
    texts += [f"{prose(9)} {TEMPLATES['MIT (line)']} {prose(30)}", "Intro\n" + TEMPLATES["MIT (line)"], prose(50) + TEMPLATES["MIT"][:400] + prose(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc"], r["unit"], r["license"]): r["line"] for r in licenses.scan(docs).collect()}
    assert {k: v for k, v in got.items() if k[1] == "passage"} == {
        (0, "passage", "MIT"): 40, (1, "passage", "Apache-2.0"): 40, (2, "passage", "GPL-3.0"): got.get((2, "passage", "GPL-3.0")), (3, "passage", "MIT (line)"): 9,
        (1, "passage", "Apache-2.0 (line)"): 40,  # the notice begins with that sentence
    }
    assert set(got) - {k for k in got if k[1] == "passage"} == {(4, "line", "MIT (line)")} and (2, "passage", "GPL-3.0") in got


def test_telling_words_are_in_all_that_reaches_the_threshold():
    words = set(licenses.telling_words(TEMPLATES, 0.9))
    for text in TEMPLATES.values():
        grams = licenses.bigram_set(text)
        assert sum(bool(words & set(g.split())) for g in grams) > licenses.may_lack(len(grams), 0.9)
    assert len(words) < 40 and min(map(len, words)) > 2


def test_licences_stay_native(spark):
    docs = spark.createDataFrame(CASES, SCHEMA)
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secret_base_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op2_secret_scan(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assign = re.compile(
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    for d in docs:
        text, spans = d["text"] or "", []
        spans += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        row = got[d["doc_id"]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        base = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) | {""}


def test_secret_verdicts_equal_a_plain_count_over_the_whole_table(spark, sf_dir):
    """Owners and repositories of every value counted one by one; bare tokens looked for without the operator's sweep."""
    docs = [(r["doc_id"], r["source"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect()]
    # Values copied within one owner, over several, and held by one alone, as the table may hold none.
    docs += [(3 * 10**6 + k, f"o{k % 4}", "token = abcdefg") for k in range(4)] + [(4 * 10**6, "o1", "secret: hijklmnop")]
    docs += [(10**6 + k, "one owner", f"key {'Zx81Kq20Lm73Pw55'}") for k in range(10)] + [(2 * 10**6 + k, f"o{k}", "see Qa12Ws34Ed56Rf78 and Qa12Ws34Ed56Rf78") for k in range(2)]
    found, owners, repos = {}, {}, {}
    for doc, owner, text in docs:
        base = secrets.base_spans(text)
        bare = [(m.start(), m.end(), 3, "bare", m.group()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text) if all(m.end() <= s or m.start() >= e for s, e, *_ in base)]
        bare = [b for b in bare if re.search("[0-9]", b[4]) and re.search("[A-Za-z]", b[4]) and len(set(b[4])) >= 8]
        found[doc] = sorted(base + bare, key=lambda x: (x[0], x[2], x[1]))
        for *_, value in found[doc]:
            owners.setdefault(value, set()).add(owner)
            repos.setdefault(value, set()).add(doc)
    rows = secrets.scan(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    assert len(rows) == len(docs)
    verdicts = set()
    for r in rows:
        live = [len(owners[v]) < 3 and len(repos[v]) < 10 for *_, v in found[r["doc"]]]
        kept = [x for x, is_live in zip(found[r["doc"]], live) if x[3] != "bare" or is_live]
        alive = [len(owners[x[4]]) < 3 and len(repos[x[4]]) < 10 for x in kept]
        assert r["spans"] == ",".join(f"{kind}:{s}:{e}" for s, e, _, kind, _ in kept)
        assert r["n_repos"] == ",".join(str(len(repos[x[4]])) for x in kept) and r["n_owners"] == ",".join(str(len(owners[x[4]])) for x in kept)
        assert (r["n_live"], r["n_example"]) == (sum(alive), len(kept) - sum(alive))
        verdicts |= {(x[3], a) for x, a in zip(kept, alive)}
    assert ("bare", True) in verdicts and len({a for _, a in verdicts}) == 2


def test_secret_ownership_tells_examples_from_live_values(spark):
    copied, own = "Zx81Kq20Lm73Pw55", "Qa12Ws34Ed56Rf78"
    rows = [(k, f"see {copied} here", f"owner{k}") for k in range(4)] + [(9, f"my {own} and {own}", "owner9"), (10, None, None)]
    rows += [(k, "token = abcdefg", f"owner{k}") for k in range(20, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc"]: r for r in secrets.scan(docs).collect()}
    # A copied bare token is no finding at all; a copied base finding stays one, and counts as an example.
    assert all(got[k]["spans"] == "" and got[k]["n_example"] == got[k]["n_live"] == 0 for k in range(4))
    assert all(got[k]["spans"] == "assign:0:15" and got[k]["n_example"] == 1 and got[k]["n_live"] == 0 for k in range(20, 24))
    assert got[9]["spans"] == "bare:3:19,bare:24:40" and got[9]["n_live"] == 2
    assert got[10]["spans"] == "" and got[10]["n_assign"] == 0


def test_secret_copied_through_one_owner_is_an_example(spark):
    copied, few = "Zx81Kq20Lm73Pw55", "Qa12Ws34Ed56Rf78"
    rows = [(k, f"see {copied} here", "one") for k in range(10)] + [(k, f"my {few}", "one") for k in range(20, 29)]
    rows += [(k, "token = abcdefg", "one") for k in range(30, 42)]
    got = {r["doc"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["spans"] == "" and got[k]["n_live"] == 0 for k in range(10))
    assert all(got[k]["spans"] == "bare:3:19" and got[k]["n_live"] == 1 and got[k]["n_repos"] == "9" for k in range(20, 29))
    assert all((got[k]["n_example"], got[k]["n_live"], got[k]["n_repos"], got[k]["n_owners"]) == (1, 0, "12", "1") for k in range(30, 42))


def _quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    covered = None if twice is None else len({k + j for k, w in enumerate(windows) if w in twice for j in range(3)})
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, covered


def test_quality_base_columns_and_verdict(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op3_quality_rules(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n, chars, symbols, dup, covered = _quality(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup)
        if covered is not None:
            assert r["n_repeat_words"] == covered
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_good_and_rejects_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in queries.op3_quality_rules(spark, sf).collect() if labels.get(r["doc_id"]) is not None and not r["base_failed"]]
    good, bad = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    print(len(good), np.mean(good), len(bad), np.mean(bad))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_quality_field_tells_lines_of_one_document_apart():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(8, 20))).capitalize() + "."
    junk = lambda: " | ".join(f"#{word()}" for _ in range(rng.integers(2, 6)))
    good = [quality_crf.text_features("\n".join(prose() for _ in range(9)))[0] for _ in range(60)]
    bad = [quality_crf.text_features("\n".join(junk() for _ in range(5)))[0] for _ in range(60)]
    sequences = quality_crf.joined(good, bad)
    assert sum(len(set(y.tolist())) == 2 for _, y in sequences) == 45
    weights, step = quality_crf.fit_field(sequences)
    lines = [prose(), prose(), junk(), junk(), junk(), prose()]
    found = quality_crf.viterbi(quality_crf.text_features("\n".join(lines))[0] @ weights.T, step)
    assert found.tolist() == [1, 1, 0, 0, 0, 1] and step[0, 0] > step[0, 1] and step[1, 1] > step[1, 0]
    share = quality_crf.content_share("\n".join(lines), weights, step)
    assert share == pytest.approx(sum(len(lines[k]) for k in (0, 1, 5)) / sum(map(len, lines)))


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7):
        emit, step = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(
            ([(c >> t) & 1 for t in range(n)] for c in range(2**n)),
            key=lambda y: sum(emit[t, y[t]] for t in range(n)) + sum(step[y[t - 1], y[t]] for t in range(1, n)),
        )
        assert quality_crf.viterbi(emit, step).tolist() == best


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect() if r["toxic"] is not None}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos, neg = np.array([s for s, y in held if y]), np.array([s for s, y in held if not y])
    assert np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos]) > 0.8
    assert (neg >= 0.3).mean() < 0.03


def test_text_operators_take_odd_rows(spark):
    docs = clashing(spark.createDataFrame(CASES, SCHEMA))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    n = len(CASES)
    assert secrets.scan(docs).count() == n
    assert licenses.scan(docs).count() == 0
    assert quality_crf.judge(docs, quality_crf.train(docs, labels)).count() == n
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == n
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    none = docs.limit(0)
    assert secrets.scan(none).count() == licenses.scan(none).count() == toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality_crf.judge(none, quality_crf.train(none, labels.limit(0))).count() == 0
