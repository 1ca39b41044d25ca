"""Benchmark decontamination with SimHash windows and a multi-index over Hamming blocks.

Every benchmark item has a 64-bit SimHash of its words. In a document, all windows of the items' sizes are fingerprinted
but those that a bound shows to be similar to no item at all: the summed weights of the window's shingles that stand in
any item, against its other shingles. Fingerprints are looked up in an index of five blocks of 12 or 13 bits, kept with
up to two bits flipped; five blocks of more than two differing bits each are more than 14 bits, so every item of the
window's size within radius 14 is found. Exact weighted-shingle similarity then decides.

The items are held by the tasks in blocks of bounded size; a benchmark of more blocks takes more passes over the
documents. Shingle weights are counted over all items, so the blocks don't change the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.text import WordHash, map_rows, packed, shingle_hashes, unpacked
from jobloom.session import settle

WIDTH = 5
RADIUS, BLOCKS = 14, ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TOKEN = re.compile(r"\w+")
SIEVE_BITS = 22


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def simhash(windows: np.ndarray) -> np.ndarray:
    """SimHash of every row of word hashes: bit by bit the majority of the row's words."""
    out = np.zeros(len(windows), np.uint64)
    for bit in range(64):
        ones = ((windows >> np.uint64(bit)) & np.uint64(1)).sum(1)
        out |= (2 * ones > windows.shape[1]).astype(np.uint64) << np.uint64(bit)
    return out


def _flips(bits: int) -> np.ndarray:
    one = [1 << i for i in range(bits)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


class BlockIndex:
    """Fingerprints by group and by the value of each block; ``near`` finds all within the radius."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray | None = None):
        self.prints = prints
        groups = np.zeros(len(prints), np.uint64) if groups is None else groups.astype(np.uint64)
        self.blocks = []
        for at, bits in BLOCKS:
            values = (prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)
            flips = _flips(bits)
            keys = ((groups << np.uint64(13) | values)[:, None] ^ flips).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.uint64(at), np.uint64((1 << bits) - 1), keys[order], order // len(flips)))

    def near_all(self, values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the value, index of the fingerprint) of all pairs of one group within the radius."""
        pairs = []
        for at, mask, keys, owner in self.blocks:
            probes = groups.astype(np.uint64) << np.uint64(13) | ((values >> at) & mask)
            lo, hi = np.searchsorted(keys, probes), np.searchsorted(keys, probes, "right")
            count = hi - lo
            which = np.repeat(np.arange(len(values)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            found = owner[place]
            close = np.bitwise_count(self.prints[found] ^ values[which]) <= RADIUS
            pairs.append(which[close] * len(self.prints) + found[close])
        both = np.unique(np.concatenate(pairs))
        return both // max(len(self.prints), 1), both % max(len(self.prints), 1)

    def near(self, value: np.uint64) -> np.ndarray:
        return self.near_all(np.array([value], np.uint64), np.zeros(1, np.uint64))[1]


def weighted_similarity(window: np.ndarray, item: np.ndarray, weights: dict[int, float], other: float, one: float) -> float:
    """Weighted Jaccard of two shingle bags: sum of the lesser over sum of the greater counts, times weights.

    A shingle of the item weighs as in ``weights``, or ``one`` if no other item holds it; what it lacks weighs ``other``.
    """
    return _similarity(window, *_bag(item, weights, one), other)


def _bag(item: np.ndarray, weights: dict[int, float], one: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles in order, counts, weights) of an item."""
    keys, count = np.unique(item, return_counts=True)
    return keys, count, np.array([weights.get(k, one) for k in keys.tolist()])


def _similarity(window: np.ndarray, keys: np.ndarray, count: np.ndarray, weight: np.ndarray, other: float) -> float:
    at = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
    held = np.bincount(at[keys[at] == window], minlength=len(keys))
    low = float((weight * np.minimum(held, count)).sum())
    high = float((weight * np.maximum(held, count)).sum()) + other * (len(window) - int(held.sum()))
    return low / high


def shingle_weight(n_items: int, held_by: int) -> float:
    """Smoothed inverse item frequency."""
    return float(np.log((1 + n_items) / (1 + held_by)) + 1)


class Items:
    """One block of benchmark items, ready for lookups inside a task."""

    stretch = 8192

    def __init__(self, rows: list[tuple[int, str]], repeated: dict[int, int], n_items: int):
        words = WordHash()
        self.weights = {s: shingle_weight(n_items, c) for s, c in repeated.items()}
        self.other, self.one = shingle_weight(n_items, 0), shingle_weight(n_items, 1)
        self.ids, self.hashes, self.shingles = [], [], []
        for item, text in rows:
            w = words.array(tokens(text))
            if len(w):
                self.ids.append(item)
                self.hashes.append(w)
                self.shingles.append(shingle_hashes(w, WIDTH))
        of_item = np.array([len(w) for w in self.hashes], np.int64)
        self.bags = [_bag(s, self.weights, self.one) for s in self.shingles]
        self.sizes, group = np.unique(of_item, return_inverse=True)
        prints = np.concatenate([simhash(w[None, :]) for w in self.hashes]) if self.ids else np.zeros(0, np.uint64)
        self.index = BlockIndex(prints, group)
        self.by_width = {}
        for width in sorted({min(WIDTH, int(n)) for n in self.sizes}):
            keys = np.unique(np.concatenate([s for s, n in zip(self.shingles, of_item) if min(WIDTH, n) == width]))
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[keys & np.uint64((1 << SIEVE_BITS) - 1)] = True
            weight = np.array([self.weights.get(k, self.one) for k in keys.tolist()])
            groups = [g for g, n in enumerate(self.sizes.tolist()) if min(WIDTH, n) == width]
            self.by_width[width] = (sieve, keys, weight, groups)

    def windows(self, words: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(start, size group) of the item-sized windows that could have similarity ``threshold`` with some item."""
        starts, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, (sieve, keys, weight, of_width) in self.by_width.items():
            if len(words) < width:
                continue
            here = shingle_hashes(words, width)
            maybe = np.flatnonzero(sieve[here & np.uint64((1 << SIEVE_BITS) - 1)])
            at = np.minimum(np.searchsorted(keys, here[maybe]), len(keys) - 1)
            known = keys[at] == here[maybe]
            # What a text of so many known shingles can reach in the smallest window, were all of them in it.
            most = (1 - threshold) * weight.max() * known.sum()
            least = min(int(self.sizes[of_width[0]]), len(words)) - width + 1
            if not known.any() or most < threshold * self.other * (least - known.sum()) - 1e-9:
                continue
            # Along the text: weights of shingles that items hold, and numbers of those that none holds.
            inside = np.zeros(len(here) + 1)
            inside[maybe[known] + 1] = weight[at[known]]
            outside = np.arange(len(here) + 1) - np.cumsum(inside > 0)
            inside = np.cumsum(inside)
            for g in of_width:
                many = min(int(self.sizes[g]), len(words)) - width + 1
                gain, loss = inside[many:] - inside[:-many], outside[many:] - outside[:-many]
                able = np.flatnonzero((1 - threshold) * gain >= threshold * self.other * loss - 1e-9)
                starts.append(able)
                groups.append(np.full(len(able), g))
        return np.concatenate(starts), np.concatenate(groups)

    def prints(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """SimHash of windows of ``words``, from running sums of each bit."""
        out = np.zeros(len(starts), np.uint64)
        for at in np.unique(starts // self.stretch) * self.stretch:
            mine = np.flatnonzero((starts >= at) & (starts < at + self.stretch))
            part = words[at : int((starts[mine] + sizes[mine]).max())]
            bits = (part[:, None] >> np.arange(64, dtype=np.uint64)).astype(np.uint8) & 1
            ones = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])
            for k in range(0, len(mine), self.stretch):
                these = mine[k : k + self.stretch]
                a = starts[these] - at
                more = 2 * (ones[a + sizes[these]] - ones[a]) > sizes[these][:, None]
                out[these] = np.packbits(more, axis=1, bitorder="little").view("<u8")[:, 0]
        return out

    def matches(self, words: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """item index -> (similarity, start, size) of its most similar window, the first of equals."""
        best: dict[int, tuple[float, int, int]] = {}
        starts, groups = self.windows(words, threshold)
        if not len(starts):
            return best
        sizes = np.minimum(self.sizes[groups], len(words))
        which, items = self.index.near_all(self.prints(words, starts, sizes), groups)
        for w, k in sorted(zip(which.tolist(), items.tolist()), key=lambda x: (starts[x[0]], x)):
            start, size = int(starts[w]), int(sizes[w])
            bag = shingle_hashes(words[start : start + size], min(WIDTH, len(self.hashes[k])))
            score = _similarity(bag, *self.bags[k], self.other)
            if score >= threshold and score > best.get(k, (0.0,))[0]:
                best[k] = (score, start, size)
        return best


_READY: dict = {}


def _ready(held) -> Items:
    """The items of a broadcast block, built once in each Python worker."""
    if held.value["key"] not in _READY:
        _READY.clear()
        _READY[held.value["key"]] = Items(held.value["rows"], held.value["repeated"], held.value["n_items"])
    return _READY[held.value["key"]]


def _shingle_rows(items: DataFrame) -> DataFrame:
    """(block, s), one row for every distinct shingle of each item."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        words = WordHash()
        for row in rows:
            found = np.unique(shingle_hashes(words.array(tokens(row["text"])), WIDTH))
            yield {"block": row["block"], "s": found.view(np.int64).tolist()}

    arrow = pa.schema([("block", pa.int64()), ("s", pa.list_(pa.int64()))])
    return map_rows(items, run, "block long, s array<long>", arrow, 200).select("block", F.explode("s").alias("s"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    block_chars: int = 4_000_000,
    block_items: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc, th, item, similarity, start, size) of every item that a document holds, in words of the document.

    An item is held if some item-sized window has weighted five-word-shingle similarity ``threshold`` or more with
    it; the best window is given. Weights are inverse item frequencies over all items. Words are runs of word
    characters of the lower-cased text. ``block_chars`` and ``block_items`` are about what a task holds of the items at
    once: characters of their texts, and their number, as an item's place in the index takes some 7 kB however short it is.

    Defined cases: null or empty documents hold nothing; items without words are held by nothing; items of fewer
    than five words are one shingle; repeated rows are matched each for itself; empty tables give empty results.
    """
    items = benchmark.where(F.col(item_text_col).rlike(r"(?U)\w")).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")
    )
    total = items.agg(F.count("*").alias("n"), F.sum(F.char_length("text").cast("long")).alias("chars")).first()
    n_blocks = max(-(-(total["chars"] or 0) // block_chars), -(-total["n"] // block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(n_blocks, 1))))
    shingles = _shingle_rows(items)
    repeated = shingles.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    repeated = shingles.distinct().join(repeated, "s")
    if n_blocks > 1:
        repeated = settle(repeated)
    arrow = pa.schema(
        [("doc", pa.int64()), ("th", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("size", pa.int64())]
    )
    schema = "doc long, th long, item long, similarity double, start long, size long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in range(n_blocks):
        here = F.col("block") == block
        rows = [tuple(r) for r in items.where(here).select("item", "text").collect()]
        often = {r["s"] % (1 << 64): r["c"] for r in repeated.where(here).collect()}
        value = {"key": uuid.uuid4().hex, "rows": sorted(rows, key=str), "repeated": often, "n_items": total["n"]}
        held = docs.sparkSession.sparkContext.broadcast(value)

        def run(found: Iterator[dict], held=held) -> Iterator[dict]:
            known = _ready(held)
            words = WordHash()
            for row in found:
                for k, (score, start, size) in known.matches(words.array(tokens(row["text"] or "")), threshold).items():
                    yield {"doc": row["doc"], "th": row["th"], "item": known.ids[k], "similarity": score, "start": start, "size": size}

        out = out.unionByName(map_rows(texts, run, schema, arrow)) if block else map_rows(texts, run, schema, arrow)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Rows go by id and text: of rows with one id only those whose own text holds an item; null and empty texts stay.
    """
    gone = contaminated(docs, benchmark, id_col=id_col, **how).select(F.col("doc").alias("_doc"), F.col("th").alias("_th")).distinct()
    text = how.get("text_col", "text")
    rows = packed(docs, _id=F.col(id_col).cast("long"), _at=F.xxhash64(text))
    left = rows.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_th")), "left_anti")
    return unpacked(left, docs.columns)
