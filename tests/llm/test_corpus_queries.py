"""Corpus queries against their SQL, and the pipeline's stages each on its own input."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from jobloom.llm import decontaminate, toxicity
from jobloom.llm.oracles import ORACLES
from jobloom.llm.queries import QUERIES
from jobloom.session import table
from test_dedup_operators import plain_components, plain_lines


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    as_text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    mine = sorted(tuple(as_text(r[c]) for c in columns) for r in got.collect())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert mine == sorted(tuple(map(as_text, r)) for r in want)


def test_every_numbered_operator_has_one_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, len(QUERIES) + 1))


def test_pipeline_stages_do_what_they_say(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(out := str(tmp_path / str(k)))
        done = spark.read.parquet(out)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = {r["doc_id"]: r["text"] for r in done.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == columns and done.count() == len(after)
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, sf_dir, "labels"))
            want = {r["doc"] for r in toxicity.score(docs, model).collect() if r["score"] < 0.3}
            assert set(after) == want
        elif name == "line dedup":
            want = {d: v[2] for d, v in plain_lines(list(before.items())).items()}
            assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in after.items()} == want
        elif name == "minhash near-dedup":
            want = {d for d, (_, c) in plain_components(list(before.items()), 5, 80).items() if d == c}
            assert set(after) == want
        elif name == "benchmark decontamination":
            held = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
            assert set(after) == set(before) - {r["doc"] for r in held.collect()}
        else:
            words = sum(len((t or "").split()) for t in before.values())
            assert abs(sum(r["taken"] for r in done.collect()) - words) <= 40
            assert set(after) <= set(before)
        docs = done


def test_run_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(got.columns)
    assert got.count() > 0
