"""Hard negatives: other-label rows whose score comes near that of an anchor's best same-label rows.

Every row is stored as one-bit codes, the signs of its vector after a fixed rotation, then those of what that leaves, and
so on, each with its alignment: the share along the code's own direction. An anchor's product with a code is told by
counting bits. What all codes leave is of known length, so Cauchy and Schwarz bound its part of the score, and each pair
gets an interval that surely holds its score. Rows whose interval can't be among the wanted ones are left out, the rest
are scored in integers. One code alone leaves six tenths of a vector's length, too much to tell random vectors apart.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.vectors import finite, matrix, scaled, with_columns_aside
from jobloom.session import discard, settle

LEVELS = 5  # codes of a row
PLANES = 7  # bits by which an anchor's rotated components are told when bits are counted
BLOCK = 4096  # rows that meet in one group,
ANCHORS = 512  # and anchors


@functools.lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (row, level, word) of each row's codes, its alignment with each, and the length of what they leave."""
    left, root = vectors @ rotation(vectors.shape[1]), np.sqrt(vectors.shape[1])
    words, aligned = [], []
    for _ in range(LEVELS):
        words.append(words_of(left > 0))
        aligned.append(np.abs(left).sum(axis=1) / root)
        left = left - np.where(left > 0, 1, -1) * (aligned[-1] / root)[:, None]
    return np.stack(words, axis=1), np.stack(aligned, axis=1), np.sqrt((left**2).sum(axis=1))


def intervals(anchors: np.ndarray, words: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each anchor (row) can have with each coded row (column)."""
    turned, root = anchors @ rotation(anchors.shape[1]), np.sqrt(anchors.shape[1])
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    steps = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    told = low[:, None] + step[:, None] * steps
    error = np.sqrt(((turned - told) ** 2).sum(axis=1))[:, None]
    planes = [words_of((steps >> b) & 1 == 1) for b in range(PLANES)]
    length = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))[:, None]
    middle, half = np.zeros((len(anchors), len(rest))), np.zeros((len(anchors), len(rest)))
    for level in range(words.shape[1]):
        code = words[:, level]
        count = lambda other, c=code: sum(np.bitwise_count(other[:, k, None] & c[None, :, k]).astype(np.int32) for k in range(c.shape[1]))
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)[None, :]
        weighted = sum(2**b * count(plane) for b, plane in enumerate(planes))
        along = (2 * (low[:, None] * ones + step[:, None] * weighted) - told.sum(axis=1)[:, None]) / root
        middle += aligned[:, level] * along
        half += aligned[:, level] * error
    # What is left is at right angles to the last code.
    half += rest * np.sqrt(np.maximum(length**2 - np.maximum(np.abs(along) - error, 0) ** 2, 0))
    # The last part is far above the floating-point error of the others.
    half += 1e-9 * length * (aligned.sum(axis=1) + rest) + 1e-6
    return middle - half, middle + half


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products, in doubles only where every sum stays a whole number below 2^53."""
    if rows.shape[1] * int(np.abs(rows).max(initial=0)) * int(np.abs(anchor).max(initial=0)) < 2**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return rows @ anchor


def best(found: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by the smaller id, nulls (masked) last."""
    return np.lexsort((np.ma.filled(ids, np.iinfo(np.int64).max), np.ma.getmaskarray(ids), -found))[:n]


def reaching(low: np.ndarray, high: np.ndarray, sure: np.ndarray, n: int) -> np.ndarray:
    """Which rows can be among the ``n`` highest: ``n`` of the ``sure`` ones surely reach what they must."""
    floors = low[sure]
    return high >= np.partition(floors, -n)[-n] if len(floors) > n else np.ones(len(high), bool)


def ids_of(column: pa.ChunkedArray) -> np.ma.MaskedArray:
    return np.ma.masked_array(column.fill_null(0).to_numpy(), mask=column.is_null().to_numpy())


def coded(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(row, id, label, dims, v, code, aligned, rest): every row that takes part, as integers and as a code."""
    sound = vectors.where(finite(F.col("embedding")) & (F.size("embedding") > 0) & F.col("label").isNotNull())
    rows = with_columns_aside(sound, id=F.col("vec_id").cast("long"), label=label.cast("long"), v=scaled(F.col("embedding"), scale))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("dims"), "v")

    def run(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                words, aligned, rest = codes(matrix(part.column("v")))
                code = pa.array([w.tobytes() for w in words], pa.binary())
                shares = pa.array(list(aligned), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, code, shares, pa.array(rest)], names=[*part.schema.names, "code", "aligned", "rest"]
                )

    return rows.mapInArrow(run, "row long, id long, label long, dims int, v array<long>, code binary, aligned array<double>, rest double")


def meeting(rows: DataFrame, anchors: DataFrame, block: int, same: bool, judge: Callable, schema: str) -> DataFrame:
    """``judge(anchor, its vector, rows, low, high)`` for each anchor with the rows of each block, of its label or of all others.

    The anchors are a stated query set. A block holds ``block`` rows on average, or ``ANCHORS`` anchors, dealt by a hash of the row's number, so
    repeated rows and hot labels spread; each pair of blocks is a group of its own.
    """
    n_rows, n_anchors = max(1, -(-rows.count() // block)), max(1, -(-anchors.count() // ANCHORS))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = rows.withColumns({"rb": dealt(n_rows, 1), "ab": all_of(n_anchors)})
    anchors = anchors.withColumns({"ab": dealt(n_anchors, 2), "rb": all_of(n_rows)})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        if left.num_rows and right.num_rows:
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint64).reshape(left.num_rows, LEVELS, -1)
            aligned, rest = np.array(left.column("aligned").to_pylist()), left.column("rest").to_numpy()
            asked, facts = matrix(right.column("v")), right.drop_columns(["v", "code"]).to_pylist()
            wanted, labels = right.column("label").to_numpy(), left.column("label").to_numpy()
            held = {"row": left.column("row").to_numpy(), "id": ids_of(left.column("id")), "v": matrix(left.column("v"))}
            for label in np.unique(wanted):
                own, mine = np.flatnonzero(wanted == label), np.flatnonzero((labels == label) == same)
                low, high = intervals(asked[own], code[mine], aligned[mine], rest[mine])
                part = {k: v[mine] for k, v in held.items()}
                for k, i in enumerate(own):
                    out += judge(facts[i], asked[i], part, low[k], high[k])
        return pa.Table.from_pylist(out, schema=arrow)

    arrow = pa.schema([(n, pa.int64()) for n in (x.split()[0] for x in schema.split(", "))])
    keys = ("dims", "ab", "rb")
    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(run, schema)


def firsts(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` highest of each key with their ``rank``; tasks drop what can't be among them before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def positives(rows: DataFrame, anchors: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(anchor, anchor_id, other, score, rank): each anchor's ``n`` best other rows of its label."""

    def judge(anchor: dict, asked: np.ndarray, rows: dict, low: np.ndarray, high: np.ndarray) -> list[dict]:
        same = np.flatnonzero(rows["row"] != anchor["row"])
        same = same[reaching(low[same], high[same], np.ones(len(same), bool), n)]
        found = scores(rows["v"][same], asked)
        top = best(found, rows["id"][same], n)
        out = zip(rows["id"][same][top].tolist(), found[top].tolist(), strict=True)
        return [{"anchor": anchor["row"], "anchor_id": anchor["id"], "other": o, "score": s} for o, s in out]

    return firsts(meeting(rows, anchors, block, True, judge, "anchor long, anchor_id long, other long, score long"), ["anchor"], n)


def negatives(rows: DataFrame, anchors: DataFrame, n: int, floor: int, cap: int, block: int = BLOCK) -> DataFrame:
    """(anchor, anchor_id, nth, positive, positive_score, other, score, rank) for each of an anchor's ``wanted`` positives.

    The ``n`` best rows of another label whose score is between ``floor`` and ``cap`` percent of the positive's.
    """

    def judge(anchor: dict, asked: np.ndarray, rows: dict, low: np.ndarray, high: np.ndarray) -> list[dict]:
        wanted = anchor["wanted"]
        able = np.zeros((len(wanted), len(low)), bool)
        for k, w in enumerate(wanted):
            least, most = floor * w["score"], cap * w["score"]
            able[k] = (100 * high >= least) & (100 * low <= most)
            able[k] &= reaching(low, high, (100 * low >= least) & (100 * high <= most), n)
        near = able.any(axis=0)
        able, ids = able[:, near], rows["id"][near]
        found, out = scores(rows["v"][near], asked), []
        for k, w in enumerate(wanted):
            good = np.flatnonzero(able[k] & (100 * found >= floor * w["score"]) & (100 * found <= cap * w["score"]))
            top = good[best(found[good], ids[good], n)]
            of = {"anchor": anchor["row"], "anchor_id": anchor["id"], "nth": w["rank"], "positive": w["other"], "positive_score": w["score"]}
            out += [of | {"other": o, "score": s} for o, s in zip(ids[top].tolist(), found[top].tolist(), strict=True)]
        return out

    schema = "anchor long, anchor_id long, nth long, positive long, positive_score long, other long, score long"
    return firsts(meeting(rows, anchors, block, False, judge, schema), ["anchor", "nth"], n)


def mine(
    vectors: DataFrame, label: Column, is_anchor: Column, scale: int = 256, n_positives: int = 5, n: int = 3, floor: int = 50, cap: int = 95, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    ``label`` is over ``vectors``, ``is_anchor`` over the column ``id``, the row's ``vec_id``. Rows with a null label, a null or empty vector, or a null or
    non-finite component, take no part. Repeated rows are rows of their own, also as anchors and among the best. A null id is no anchor
    and comes last among equal scores. Rows meet only rows with as many components. Components too large for exact products
    raise. An empty table, or one without anchors, gives no rows.
    """
    rows = settle(coded(vectors, label, scale))
    again = vectors.sparkSession.read.schema(rows.schema).parquet(rows.settled_in)  # a cogroup's sides must be two reads
    anchors = again.where(F.coalesce(is_anchor, F.lit(False)))
    first = settle(positives(rows, anchors, n_positives, block))
    wanted = first.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("wanted"))
    asked = anchors.join(wanted, F.col("row") == F.col("anchor")).drop("anchor")
    found = negatives(rows, asked, n, floor, cap, block)
    done = settle(
        found.select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
    discard(rows, first)
    return done
