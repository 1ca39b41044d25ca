"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram counts as present or absent in a text. Its naive Bayes log-count ratio between the labels scales the
feature; logistic regression over the scaled features gives the weights. Both are fitted on a bounded sample of
labelled documents by Spark jobs, which count the n-grams and sum the gradients; scoring is one pass over whole texts
with a weight table of constant size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.text import map_rows
from jobloom.session import discard, settle

GRAMS = (3, 4, 5)
BITS = 20
FIT_TASKS = 8
_PRIME = np.uint32(0x01000193)


def gram_ids(text: str) -> np.ndarray:
    """Hashed ids, with repeats, of the character n-grams of the lower-cased text, whitespace runs as one space."""
    chars = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in GRAMS:
        count = len(chars) - n + 1
        if count <= 0:
            continue
        acc = np.full(count, np.uint32(2166136261 + n))
        for k in range(n):
            acc = (acc ^ chars[k : k + count]) * _PRIME
            acc ^= acc >> np.uint32(15)
        out.append(acc * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counted(texts: DataFrame) -> DataFrame:
    """(gram, n0, n1): how many of the (y, text) rows of each label hold the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for y, text in zip(part["y"].to_pylist(), part["text"].to_pylist()):
                    count[y, np.unique(gram_ids(text))] += 1
        found = np.flatnonzero(count.any(0))
        for k in range(0, len(found), 1 << 16):
            at = found[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c[at].astype(np.int64)) for c in count)], ["gram", "n0", "n1"])

    each = texts.select("y", "text").mapInArrow(run, "gram int, n0 long, n1 long")
    return each.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def chosen_grams(texts: DataFrame, n0: int, n1: int, most: int, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, log-count ratios) of the ``most`` n-grams whose counts differ most between the labels.

    The log-count ratio is taken of smoothed presence counts. An n-gram ranks by its ratio and its count; it needs
    three rows.
    """
    share = lambda c, n: F.log((F.col(c) + smooth) / F.lit(n + 2 * smooth))
    both = F.col("n0") + F.col("n1")
    rated = _counted(texts).where(both >= 3).select("gram", (share("n1", n1) - share("n0", n0)).alias("ratio"), both.alias("both"))
    rated = rated.withColumn("strength", F.abs("ratio") * F.sqrt("both")).where("strength > 0")
    best = rated.orderBy(F.desc("strength"), "gram").limit(most).select("gram", "ratio").toArrow()  # `most` rows
    ids = best["gram"].to_numpy()
    order = np.argsort(ids)
    return ids[order], best["ratio"].to_numpy()[order]


def _features(texts: DataFrame, grams: np.ndarray) -> DataFrame:
    """(y, slots): of each text the places of its n-grams in ``grams``, as bytes of unsigned 32-bit numbers."""
    held = texts.sparkSession.sparkContext.broadcast(grams.astype(np.int32))

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[held.value] = np.arange(len(held.value), dtype=np.int32)
        for row in rows:
            found = slot[np.unique(gram_ids(row["text"]))]
            yield {"y": row["y"], "slots": found[found >= 0].astype(np.uint32).tobytes()}

    return map_rows(texts.select("y", "text"), run, "y int, slots binary", pa.schema([("y", pa.int32()), ("slots", pa.binary())]), 200)


def _loss(features: DataFrame, scale: np.ndarray, x: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Regularised logistic loss and its gradient at x (weights, intercept): the tasks sum, the driver adds the tasks' sums."""
    held = features.sparkSession.sparkContext.broadcast((x[:-1] * scale, float(x[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, b = held.value
        grad, loss = np.zeros(len(ws) + 1), 0.0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                y = part["y"].to_numpy().astype(np.float64)
                slots = [np.frombuffer(s, np.uint32) for s in part["slots"].to_pylist()]
                cols = np.concatenate(slots)
                at = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
                z = np.bincount(at, ws[cols], len(slots)) + b
                loss += float((np.logaddexp(0, z) - y * z).sum())
                miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                grad[:-1] += np.bincount(cols, miss[at], len(ws))
                grad[-1] += miss.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.astype(np.float32).tobytes()], pa.binary())], ["loss", "grad"])

    parts = features.coalesce(FIT_TASKS).mapInArrow(run, "loss double, grad binary").collect()  # a row a task
    held.destroy()
    grad = np.zeros(len(x))
    for r in parts:
        grad += np.frombuffer(r["grad"], np.float32)
    grad[:-1] = grad[:-1] * scale + decay * x[:-1]
    return sum(r["loss"] for r in parts) + decay / 2 * float(x[:-1] @ x[:-1]), grad


def minimum(loss, x: np.ndarray, steps: int = 30, memory: int = 8, still: float = 5e-3) -> np.ndarray:
    """Where limited-memory BFGS with halved steps takes ``loss`` (value and gradient) from x, in ``steps`` calls at most.

    It ends early once a step lowers the value by less than ``still`` of itself.
    """
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    calls, stride = 1, 1 / max(1.0, float(np.linalg.norm(grad)))
    while calls < steps:
        way, held = grad.copy(), []
        for s, g in reversed(past):
            held.append(float(s @ way) / float(s @ g))
            way -= held[-1] * g
        way *= float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]) if past else stride
        for (s, g), h in zip(past, reversed(held)):
            way += (h - float(g @ way) / float(s @ g)) * s
        slope, size = -float(way @ grad), 1.0
        while True:
            next_value, next_grad = loss(x - size * way)
            calls += 1
            if next_value <= value + 1e-4 * size * slope or calls >= steps:
                break
            size /= 2
        if next_value >= value:
            break
        step, bend = -size * way, next_grad - grad
        if float(step @ bend) > 1e-12:
            past = [*past, (step, bend)][-memory:]
        done = value - next_value < still * value
        x, value, grad = x + step, next_value, next_grad
        if done:
            break
    return x


def held_out(c):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = 8000,
    most: int = 60_000,
    decay: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
):
    """(weights by n-gram id, intercept), fitted on half of ``max_docs`` documents a label at most.

    They are the first of each label in hash order of their ids, none of them held out; the intercept is then set
    to the labels' true shares. Presence counts, the choice of ``most`` n-grams and the sums of every gradient are
    Spark jobs: the driver holds vectors of ``most`` numbers, no texts and no n-grams of texts.

    Defined cases: rows without id, label or text aren't learned from; without both labels all weights are 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("_id"), (F.col(label_col).cast("int") != 0).cast("int").alias("y")
    )
    first = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs // 2)
    sample = F.broadcast(first(0).union(first(1)))  # max_docs rows at most
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = settle(texts.join(sample, F.col("id") == F.col("_id")).select("y", "text"))
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n0 or not n1:
        discard(rows)
        share = (n1 + 1) / (n0 + n1 + 2)
        return weights, float(np.log(share / (1 - share)))
    every = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    grams, scale = chosen_grams(rows, n0, n1, most)
    features = settle(_features(rows, grams))
    x = minimum(lambda x: _loss(features, scale, x, decay), np.append(np.zeros(len(grams)), np.log(n1 / n0)))
    discard(rows, features)
    weights[grams] = x[:-1] * scale
    return weights, float(x[-1] + np.log(every[1] / every[0]) - np.log(n1 / n0))


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score) for every row: the chance that the text is labelled toxic, by its n-grams alone.

    Defined cases: null and empty texts get the score of a text without n-grams known to the model; repeated rows
    score alike; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        weights, b = held.value
        live = weights != 0
        for row in rows:
            ids = gram_ids(row["text"] or "")
            ids = np.unique(ids[live[ids]])
            z = float(weights[ids].sum(dtype=np.float64)) + b
            yield {"doc": row["doc"], "score": 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))}

    arrow = pa.schema([("doc", pa.int64()), ("score", pa.float64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "doc long, score double", arrow)


def without_toxic(docs: DataFrame, model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, filtered in one pass over the documents."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = held.value
        live = weights != 0
        cut = np.log(threshold / (1 - threshold))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keep = []
                for text in part.column(at).to_pylist():
                    ids = gram_ids(text or "")
                    ids = np.unique(ids[live[ids]])
                    keep.append(float(weights[ids].sum(dtype=np.float64)) + b < cut)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)
