"""Counts of every prefix against the tokenizer's own library, and against plain merging with small vocabularies."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpus_cases import CASES, SCHEMA, clashing
from jobloom.llm import token_counts
from jobloom.llm.queries import QUERIES
from jobloom.llm.token_counts import MODEL, SPACE, Prefixes, prefixes_of, unpacked
from jobloom.session import table


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


HARD = [
    " ", "  ", "\n", "\r\n", "\t", "a", "the", "ing", "é", "é", "日本", "\U0001f44d\U0001f3fd", "<s>", "<0x0A>", "▁", "\x00",
    "2024", "ﬁ", "internationalization", "Ａ", "==", "----", "//", "und", "Straße", "퟿", "x" * 70, "ab" * 40,
]


def test_every_prefix_counts_as_the_library_says(library):
    rng, counts = random.Random(5), prefixes_of(MODEL)
    texts = ["".join(rng.choice(HARD) for _ in range(rng.randrange(14))) for _ in range(250)]
    for text, (n, store) in zip(texts, counts.packed(texts), strict=True):
        want = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert unpacked(store).tolist() == want and n == want[-1], repr(text)


def merged(text, scores):
    parts = list(text)
    while True:
        found = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_small_vocabularies_agree_with_plain_merging(seed):
    rng, alphabet = random.Random(seed), "ab" + SPACE
    scores = {c: 0.0 for c in alphabet}
    while len(scores) < 14:  # merges of what is there, each worse than all before it
        piece = rng.choice(list(scores)) + rng.choice(list(scores))
        if len(piece) <= 6 and piece not in scores and (seed % 2 or SPACE not in piece[1:]):
            scores[piece] = -float(len(scores))
    table_, plain = Prefixes(scores), lambda t: sum(1 if p in scores else len(p.encode()) for p in merged(t, scores))
    texts = ["".join(rng.choice("aabb  é") for _ in range(rng.randrange(90))) for _ in range(40)]
    for text, (_, store) in zip(texts, table_.packed(texts), strict=True):
        seen = SPACE + text.replace(" ", SPACE)
        assert unpacked(store).tolist() == [0] + [plain(seen[: k + 1]) for k in range(1, len(text) + 1)]


def test_a_step_beyond_a_byte_is_kept_exactly():
    scores = {"a": 0.0, "b": 0.0} | {"a" * k + "b": -float(k) for k in range(1, 300)}
    text = "a" * 260 + "b"
    ((n, store),) = Prefixes(scores).packed([text])
    assert n == 3 + 1 and unpacked(store).tolist() == [0, *[3 + k for k in range(1, 261)], 4]  # the first space has 3 bytes


def test_no_vocabulary_counts_bytes():
    assert [n for n, _ in Prefixes({}).packed(["", "aé", " "])] == [0, 6, 6]


def test_query_counts_whole_texts(spark, sf_dir, library):
    rows = {r["doc_id"]: r for r in QUERIES["op11_token_counts"](spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        text, got = d["text"] or "", rows[d["doc_id"]]
        n = len(library.encode(text))
        assert (got["n_bytes"], got["n_tokens"], got["over_limit"]) == (len(text.encode()), n, n > 4096)
        assert got["tokens_at"] == len(library.encode(text[:4096]))
        assert len(library.encode(text[: got["cut_chars"]])) <= 4096
        assert got["cut_chars"] == len(text) if n <= 4096 else all(len(library.encode(text[: got["cut_chars"] + k])) > 4096 for k in (1, 2, 9))


def test_odd_rows(spark, library):
    docs = clashing(spark.createDataFrame(CASES, SCHEMA)).withColumn("prefix_tokens", F.lit("x"))
    told = token_counts.answers(token_counts.prefix_counts(docs), budget=F.lit(5), at=F.lit(3))
    got = sorted((str(r["doc"]), r["n_bytes"], r["n_tokens"], r["cut_chars"] <= (r["n_chars"] or 0), r["tokens_at"]) for r in told.collect())
    size = lambda t: len(library.encode(t or ""))
    assert got == sorted((str(c[0]), len((c[1] or "").encode()), size(c[1]), True, size((c[1] or "")[:3])) for c in CASES)
    nothing = token_counts.answers(token_counts.prefix_counts(docs.limit(2)), budget=F.lit(None), at=F.lit(-1)).collect()
    assert [(r["cut_chars"], r["tokens_at"]) for r in nothing] == [(None, None)] * 2
    assert token_counts.prefix_counts(docs.limit(0)).count() == 0


def test_truncated_texts_keep_to_the_limit(spark, library):
    docs = clashing(spark.createDataFrame(CASES, SCHEMA)).withColumn("n_tokens", F.lit("old"))
    done = token_counts.truncated(docs, 7)
    assert [c for c in done.columns if c != "n_tokens"] == [c for c in docs.columns if c != "n_tokens"]
    before, after = sorted(docs.collect(), key=str), sorted(done.collect(), key=lambda r: str(r))
    assert len(before) == len(after)
    for r in after:
        assert (r["text"] is None and r["n_tokens"] == 0) or (len(library.encode(r["text"])) == r["n_tokens"] <= 7)
    assert {r["text"] for r in before if r["text"] is not None and len(library.encode(r["text"])) <= 7} <= {r["text"] for r in after}
