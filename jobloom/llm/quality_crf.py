"""Quality rules with a linear-chain conditional random field over lines.

Every line gets a few measured features. The field's two labels are content and boilerplate; Viterbi decoding
labels a text's lines together, and the share of characters in content lines decides whether the text stays.
The field is trained here, by maximum likelihood, on a bounded sample of labelled documents. A document's quality label
stands for each of its lines; most training sequences join the lines of a good document and of a bad one, so that labels
change within them and the transitions are learned too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.text import WordHash, map_rows, shingle_hashes

# The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"
FEATURES = 8
CONTENT, BOILERPLATE = 1, 0


def line_features(line: str, repeated: bool) -> list[float]:
    """Bias, symbols a word, repeated-word share, digits, log length, sentence end, earlier copy, word length."""
    words = line.split()
    n, size = max(len(words), 1), max(len(line), 1)
    symbols = sum(line.count(c) for c in SYMBOLS)
    digits = sum(map(line.count, "0123456789"))
    return [
        1.0,
        min(symbols / n, 2.0),
        1 - len(set(words)) / n,
        digits / size,
        math.log1p(n) / 4,
        float(line.rstrip()[-1:] in (".", "!", "?")),
        float(repeated),
        min(size / n, 20.0) / 10,
    ]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and character counts of a text's lines with a word."""
    seen: set[str] = set()
    rows, sizes = [], []
    for line in text.split("\n"):
        if line.strip():
            rows.append(line_features(line, line in seen))
            sizes.append(len(line))
            seen.add(line)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(sizes, np.float64)


def viterbi(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best label sequence for emission scores (lines, 2) and transition scores (2, 2)."""
    n = len(emit)
    back = np.zeros((n, 2), np.int8)
    a, b = emit[0]
    (s00, s01), (s10, s11) = step.tolist()
    for t, (e0, e1) in enumerate(emit.tolist()):
        if t:
            back[t] = (int(b + s10 > a + s00), int(b + s11 > a + s01))
            a, b = max(a + s00, b + s10) + e0, max(a + s01, b + s11) + e1
    labels = np.zeros(n, np.int8)
    labels[-1] = int(b > a)
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def content_share(text: str, weights: np.ndarray, step: np.ndarray) -> float:
    """Share of the characters of lines with a word that lie in content lines; 0 without such a line."""
    rows, sizes = text_features(text)
    if not len(rows):
        return 0.0
    labels = viterbi(rows @ weights.T, step)
    return float(sizes[labels == CONTENT].sum() / sizes.sum())


def joined(good: list[np.ndarray], bad: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of training sequences: of four pairs one stays apart, the others put bad lines into, before or
    after good ones. The shorter list is gone through again and again; without one of them the sequences stay pure."""
    pure = lambda x, y: (x, np.full(len(x), y))
    if not good or not bad:
        return [pure(x, CONTENT) for x in good] + [pure(x, BOILERPLATE) for x in bad]
    out = []
    for k in range(max(len(good), len(bad))):
        g, b = pure(good[k % len(good)], CONTENT), pure(bad[k % len(bad)], BOILERPLATE)
        half = len(g[0]) // 2
        parts = ([g], [(g[0][:half], g[1][:half]), b, (g[0][half:], g[1][half:])], [b, g], [g, b])[k % 4]
        out.append(tuple(np.concatenate(x) for x in zip(*parts)))
        if k % 4 == 0:
            out.append(b)
    return out


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.5, decay: float = 1e-3):
    """Maximum-likelihood weights (2, features) and transitions (2, 2) of (features, labels) by line, by gradient ascent.

    Sequences longer than 64 lines are trained on in pieces of 64.
    """
    pieces = [(s[k : k + 64], y[k : k + 64]) for s, y in sequences for k in range(0, len(s), 64)]
    if not pieces:
        return np.zeros((2, FEATURES)), np.zeros((2, 2))
    long = max(len(s) for s, _ in pieces)
    x = np.zeros((len(pieces), long, FEATURES))
    mask = np.zeros((len(pieces), long), bool)
    truth = np.zeros((len(pieces), long, 2))
    for k, (s, y) in enumerate(pieces):
        x[k, : len(s)], mask[k, : len(s)] = s, True
        truth[k, np.arange(len(s)), y] = 1
    steps_seen = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    w, step = np.zeros((2, FEATURES)), np.zeros((2, 2))
    gw2, gs2 = np.full_like(w, 1e-8), np.full_like(step, 1e-8)
    total = mask.sum()
    for _ in range(steps):
        emit = x @ w.T
        alpha = np.zeros((long, len(pieces), 2))
        beta = np.zeros_like(alpha)
        alpha[0] = emit[:, 0]
        for t in range(1, long):
            on = np.logaddexp(alpha[t - 1, :, :1] + step[0], alpha[t - 1, :, 1:] + step[1]) + emit[:, t]
            alpha[t] = np.where(mask[:, t, None], on, alpha[t - 1])
        for t in range(long - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[t + 1]
            on = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            beta[t] = np.where(mask[:, t + 1, None], on, beta[t + 1])
        norm = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        held = np.exp(alpha + beta - norm[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
        gw = np.einsum("ntl,ntf->lf", truth - held, x) / total - decay * w
        gs = steps_seen.copy()
        for t in range(1, long):
            joint = alpha[t - 1, :, :, None] + step[None] + (emit[:, t] + beta[t])[:, None, :] - norm[:, None, None]
            gs -= (np.exp(joint) * mask[:, t, None, None]).sum(0)
        gs = gs / total - decay * step
        gw2 += gw**2
        gs2 += gs**2
        w += rate * gw / np.sqrt(gw2)
        step += rate * gs / np.sqrt(gs2)
    return w, step


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = 3000,
    max_lines: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
):
    """Fit the field on ``max_docs`` labelled documents at most, taken in hash order of their ids.

    A document of more than ``max_lines`` lines gives so many neighbouring ones to the training, from a place that its
    id's hash sets.

    Defined cases: rows without id, label, text or a line with a word aren't learned from; without any the field is zero
    and every line counts as boilerplate.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), (F.col(label_col).cast("int") != 0).cast("int").alias("y")
    )
    per = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs // 2) for y in (0, 1)
    ]
    sample = F.broadcast(per[0].union(per[1]))  # max_docs rows at most

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            found, _ = text_features(row["text"])
            at = row["h"] % max(len(found) - max_lines + 1, 1)
            yield {"h": row["h"], "id": row["_id"], "y": row["y"], "x": found[at : at + max_lines].astype(np.float32).ravel().tolist()}

    arrow = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float32()))])
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(sample, F.col("id") == F.col("_id")).select(F.xxhash64("_id").alias("h"), "_id", "y", "text")
    got = map_rows(rows, run, "h long, id long, y int, x array<float>", arrow).toPandas().sort_values(["h", "id"])
    shaped = [(np.asarray(v, np.float64).reshape(-1, FEATURES), int(y)) for v, y in zip(got["x"], got["y"])]
    good, bad = ([s for s, y in shaped if y == label and len(s)] for label in (CONTENT, BOILERPLATE))
    return fit_field(joined(good, bad))


def judge(
    docs: DataFrame,
    field: tuple[np.ndarray, np.ndarray],
    min_content: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept).

    A text fails the base rules under 50 words, or if more than half of its words lie in three-word windows found
    twice or more. Else the decoded content share decides: ``kept`` needs ``min_content`` or more.

    Defined cases: null and empty texts have no words and fail; repeated rows are judged each for itself; an empty
    table gives an empty result.
    """
    weights, step = field

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        cache = WordHash()
        for row in rows:
            text = row["text"] or ""
            raw = text.encode()
            words = raw.split()
            ids = cache.array(words)
            n = len(words)
            again = np.zeros(n, bool)
            if n >= 3:
                _, at, count = np.unique(shingle_hashes(ids, 3), return_inverse=True, return_counts=True)
                twice = count[at] > 1
                for k in range(3):
                    again[k : n - 2 + k] |= twice
            seen: set[bytes] = set()
            dup = 0
            for line in raw.split(b"\n"):
                if line.split(None, 1):
                    dup += line in seen
                    seen.add(line)
            repeat = int(again.sum())
            failed = n < 50 or 100 * repeat > 50 * n
            share = content_share(text, weights, step)
            yield {
                "doc": row["doc"],
                "n_words": n,
                "word_chars": len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
                "n_symbols": sum(map(text.count, SYMBOLS)),
                "n_dup_lines": dup,
                "n_repeat_words": repeat,
                "base_failed": failed,
                "content_share": share,
                "kept": not failed and share >= min_content,
            }

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    arrow = pa.schema(
        [("doc", pa.int64())] + [(n, pa.int64()) for n in names]
        + [("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())]
    )
    schema = "doc long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, content_share double, kept boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_rows(rows, run, schema, arrow)
