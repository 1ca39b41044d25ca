"""Hard negatives and centroid clusters against plain Python on odd rows, and the bounds by which they leave work out."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import centroids, hard_negatives
from jobloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark, n=260, dims=6, seed=1, labels=3):
    """Ties, repeated rows and ids, null ids, labels, vectors and components, other lengths; and columns with clashing names."""
    rng = np.random.default_rng(seed)
    rows = [(k - 20, [float(x) for x in rng.integers(-3, 4, dims) / 8], int(rng.integers(labels))) for k in range(n)]
    rows += [rows[20], rows[20], rows[70], (50, rows[3][1], 1), (None, rows[4][1], 0), (None, rows[4][1], 1), (100, rows[9][1], None)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] * dims, 1), (203, [float("nan")] * dims, 1), (204, [math.inf] * dims, 1), (250, [0.5] * 3, 1), (251, [0.5, 0.25, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, df.select("*", *[F.lit(0).alias(c) for c in ("id", "row", "v", "dims", "rb", "ab", "anchor", "cluster", "distance")])


def usable(rows):
    fine = lambda x: x is not None and math.isfinite(x)
    return [r for r in rows if r[1] is not None and all(map(fine, r[1]))]


def plain_negatives(rows):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in usable(rows) if label is not None and v]
    order = lambda p: (-p[1], p[0] is None, p[0] or 0)
    out = []
    for k, (anchor, q, label) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(i, sum(a * b for a, b in zip(q, v, strict=True)), y) for j, (i, v, y) in enumerate(rows) if j != k and len(v) == len(q)]
        for positive, p, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            near = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[1] <= 95 * p), key=order)[:3]
            out += [(anchor, positive, r, s[0], p, s[1]) for r, s in enumerate(near, 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_hard_negatives_agree_with_plain_scores(spark, block):
    rows, df = odd_vectors(spark)
    got = hard_negatives.mine(df, F.col("label"), F.col("id") % 50 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    _, df = odd_vectors(spark, n=90)
    assert hard_negatives.mine(df.limit(0), F.col("label"), F.col("id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("label"), F.col("id") == -999).count() == 0


@pytest.mark.parametrize("dims", [1, 7, 64, 100])
def test_intervals_hold_every_score_and_leave_some_out(dims):
    rng = np.random.default_rng(dims)
    rows = rng.integers(-200, 200, (300, dims))
    rows[:40] += rows[40:80]
    rows[200] = 0
    anchors = np.concatenate([rows[:20] * 3 + rng.integers(-9, 9, (20, dims)), rows[200:201]])
    low, high = hard_negatives.intervals(anchors, *hard_negatives.codes(rows))
    exact = anchors @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    kept = [hard_negatives.reaching(lo, hi, np.ones(len(lo), bool), 3) for lo, hi in zip(low, high, strict=True)]
    for k, keep in enumerate(kept):
        assert set(np.argsort(-exact[k])[:3]) <= set(np.flatnonzero(keep)) or (exact[k] == 0).all()
    if dims > 1:
        assert np.mean(kept) < 0.5


def test_scores_beyond_doubles_stay_exact():
    big = np.array([[2**28 + 1, 3], [2**28 - 1, -5]])
    assert hard_negatives.scores(big, big[0]).tolist() == [(2**28 + 1) ** 2 + 9, (2**28 + 1) * (2**28 - 1) - 15]


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in usable(rows) if len(v) == dims]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(f"{seed}:{r[0]}"), r[1]))[:k]
    centres = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        who = [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), w in zip(kept, who, strict=True) if w == j]
                centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own else centres[j]
    inertia = [far(v, centres[w]) for (_, v), w in zip(kept, who, strict=True)]
    of = lambda j: sum(d for d, w in zip(inertia, who, strict=True) if w == j)
    return sorted(
        str((i, w, d, of(w), sum(inertia), digest(",".join(map(str, centres[w]))))) for (i, _), w, d in zip(kept, who, inertia, strict=True)
    )


@pytest.mark.parametrize("k", [1, 4, 8, 400])
def test_clusters_agree_with_plain_rounds(spark, k):
    rows, df = odd_vectors(spark, n=120, seed=k)
    got = centroids.cluster(df, k=k, rounds=4, dims=6, scale=16)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_clusters(rows, k, 4, 6, 16, 3)


def test_clusters_of_nothing(spark):
    _, df = odd_vectors(spark, n=90)
    assert centroids.cluster(df.limit(0), dims=6).count() == 0 == centroids.cluster(df, dims=5).count()


def test_search_is_exact_and_measures_few():
    rng = np.random.default_rng(8)
    centres = rng.integers(-60, 60, (200, 12)) + rng.integers(-500, 500, (200, 1))
    centres[150] = centres[20]
    vectors = centres[rng.integers(0, 200, 3000)] + rng.integers(-30, 30, (3000, 12))
    who, distance, measured = centroids.Centroids(centres).nearest(vectors)
    full = ((vectors[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (who == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.2 * full.size


def test_components_without_exact_distances_raise(spark):
    df = spark.createDataFrame([(1, [3e38] * 6, 1), (50, [1.0] * 6, 1)], SCHEMA)
    with pytest.raises(Exception, match="too large|CAST_OVERFLOW|OverflowError"):
        centroids.cluster(df, dims=6).collect()


def test_queries_take_no_python_rows_outside_their_tables(spark, sf_dir):
    assert QUERIES["op13_centroid_clusters"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
