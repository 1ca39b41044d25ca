"""Substring deduplication by hashing text units and keeping each unit's earliest occurrence.

Units are lines, and paragraphs of several lines, normalised in case and spacing. Their digests are grouped over the whole
corpus, each digest's earliest ranked occurrence stays, and the rest go, with offsets in the original text.

A passage that begins inside a line is no such unit. As an addition, marked by the level ``window``, every window of
``size`` words is a unit, so that a passage pasted anywhere shares units whatever marks, lines or words surround it, and
is covered to its first and last word. There are as many windows as words. Each has an anchor, the least hash of its ``ANCHOR_WORDS``-word shingles, which
a block of neighbouring windows shares. A window can only recur where its anchor does. So blocks are grouped first, by
anchor and by a digest of all their words: where a block recurs, all its windows do. Single windows are hashed only in
the first places of blocks that share their anchor with other blocks. This drops no window that recurs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.text import WordHash, map_rows, packed, scramble, shingle_hashes, unpacked
from jobloom.session import discard, settle

LEVELS = ("line", "paragraph", "window")
ANCHOR_WORDS = 8
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


class _Words(WordHash):
    """Hash of a word that is no bytes yet."""

    def __missing__(self, word):
        self[word] = value = super().__missing__(word.encode("utf-8", "surrogatepass"))
        return value


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words that ``text.split()`` gives."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.ones(len(points) + 2, bool)
    blank[1:-1] = _BLANK[np.minimum(points, len(_BLANK) - 2)] if len(points) else False
    blank[1:-1] |= points == len(_BLANK) - 1
    edge = blank[1:] != blank[:-1]
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def _shingles(text: str, words: WordHash, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, least, place): word hashes, and of every window the least shingle hash and where the first such one begins."""
    hashes = words.array(text.lower().split())
    if len(hashes) < size:
        none = np.empty(0, np.int64)
        return hashes, none.view(np.uint64), none
    width = min(ANCHOR_WORDS, size)
    short = shingle_hashes(hashes, width)
    count = len(hashes) - size + 1
    place = np.lib.stride_tricks.sliding_window_view(short, size - width + 1).argmin(1) + np.arange(count)
    return hashes, short[place], place


def windows(text: str, words: WordHash, size: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(nth, start, end, anchor, digest) of the windows of ``size`` words, or of those whose anchor is ``wanted``."""
    hashes, least, _ = _shingles(text, words, size)
    nth = np.arange(len(least)) if wanted is None else np.flatnonzero(np.isin(least, wanted))
    if not len(nth):
        return nth, nth, nth, nth, nth
    starts, ends = word_bounds(text)
    # A hash seeded otherwise than the anchor's, so that both together are 128 bits.
    digest = shingle_hashes(scramble(hashes), size)[nth]
    return nth, starts[nth], ends[nth + size - 1], least[nth].view(np.int64), digest.view(np.int64)


def units(text: str, least: int = 1) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(level, start, end, words, digest) of the lines, and of the paragraphs of several lines, with ``least`` words or more.

    Blank lines part paragraphs. A unit begins and ends with a word; its digest is that of its words, lower-cased.
    """
    least, at, lines = max(least, 1), 0, []

    def unit(level: str, parts: list) -> Iterator[tuple[str, int, int, int, bytes]]:
        words = [w for *_, own in parts for w in own]
        if len(words) >= least:
            yield level, parts[0][0], parts[-1][1], len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))

    for raw in [*text.split("\n"), ""]:
        words = raw.lower().split()
        if words:
            lines.append((at + len(raw) - len(raw.lstrip()), at + len(raw.rstrip()), words))
            yield from unit("line", lines[-1:])
        else:
            if len(lines) > 1:
                yield from unit("paragraph", lines)
            lines = []
        at += len(raw) + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def unit_rows(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, level, s, e, words, k0, k1), one row a line or paragraph; k0 and k1 are its digest."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            for level, s, e, n, digest in units(row["text"] or "", least):
                k0, k1 = np.frombuffer(digest, np.int64).tolist()
                yield {"doc": row["doc"], "th": row["th"], "level": level, "s": s, "e": e, "words": n, "k0": k0, "k1": k1}

    ints = [("s", pa.int32()), ("e", pa.int32()), ("words", pa.int32())]
    arrow = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("level", pa.string()), *ints, ("k0", pa.int64()), ("k1", pa.int64())])
    schema = "doc long, th long, level string, s int, e int, words int, k0 long, k1 long"
    return map_rows(_texts(docs, id_col, text_col), run, schema, arrow, 20_000)


class _Powers:
    """Powers of an odd number modulo 2^64 and their inverses, for hashes of word runs taken from running sums."""

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def runs(self, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of the ``length`` words from each ``start``, the same wherever these words stand."""
        if len(self.up) <= len(hashes):
            raised = np.full((2, 2 * len(hashes)), [[self.base], [self.inverse]], np.uint64)
            raised[:, 0] = 1
            self.up, self.down = np.cumprod(raised, 1, np.uint64)
        # Seeded otherwise than the anchors, so that both together are 128 bits.
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(scramble(hashes) * self.up[: len(hashes)], out=sums[1:])
        total = (sums[start + length] - sums[start]) * self.down[start]
        return scramble(total + scramble(length.astype(np.uint64)))


def _stacked(part: pa.RecordBatch, found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    """The arrays found for each row of ``part`` as one batch, beside the row's doc and th."""
    rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
    values = [pa.array(np.concatenate(column)) for column in zip(*found)]
    return pa.RecordBatch.from_arrays([part["doc"].take(rows), part["th"].take(rows), *values], ["doc", "th", *names])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def window_blocks(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, nth, n, s, e, anchor, digest), one row for every block: ``n`` successive windows, from the ``nth`` on,
    that have their anchor at one place. ``digest`` stands for all words of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = _Words(), _Powers()
        for part in _slices(batches):
            found = []
            for text in part["text"].to_pylist():
                hashes, least, place = _shingles(text or "", words, size)
                nth = np.flatnonzero(np.diff(place, prepend=-1))
                n = np.diff(nth, append=len(place))
                starts, ends = word_bounds(text if len(nth) else "")
                digest = powers.runs(hashes, nth, n + size - 1)
                ints = [x.astype(np.int32) for x in (nth, n, starts[nth], ends[nth + n + size - 2])]
                found.append((*ints, least[nth].view(np.int64), digest.view(np.int64)))
            yield _stacked(part, found, ["nth", "n", "s", "e", "anchor", "digest"])

    schema = "doc long, th long, nth int, n int, s int, e int, anchor long, digest long"
    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def block_windows(docs: DataFrame, blocks: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, nth, s, e, anchor, digest, mark), one row for every window of ``blocks``; ``mark`` is its own digest."""
    asked = blocks.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("nth", "n", "anchor", "digest")).alias("asked")
    )
    texts = _texts(docs, id_col, text_col)
    held = texts.join(asked, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).select("doc", "th", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = _Words(), _Powers()
        for part in _slices(batches):
            flat = part["asked"].flatten()
            nth, n, anchor, digest = (flat.field(c).to_numpy() for c in ("nth", "n", "anchor", "digest"))
            ends_at = np.cumsum(part["asked"].value_lengths().to_numpy())
            found = []
            for text, to, count in zip(part["text"].to_pylist(), ends_at, np.diff(ends_at, prepend=0)):
                own = slice(to - count, to)
                many = n[own]
                # Numbers of the windows: each block's first, and those that follow it.
                at = np.repeat(nth[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
                starts, ends = word_bounds(text)
                mark = powers.runs(words.array(text.lower().split()), at, np.full(len(at), size))
                ints = [x.astype(np.int32) for x in (at, starts[at], ends[at + size - 1])]
                found.append((*ints, np.repeat(anchor[own], many), np.repeat(digest[own], many), mark.view(np.int64)))
            yield _stacked(part, found, ["nth", "s", "e", "anchor", "digest", "mark"])

    return held.mapInArrow(run, "doc long, th long, nth int, s int, e int, anchor long, digest long, mark long")


_RANK = ("doc", "th", "nth")


def _rank() -> Column:
    return F.struct(F.col("doc").isNull().alias("late"), *_RANK)


def _repeated_windows(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, th, nth, last, s, e, words, d0) of all windows that an earlier place holds, and the tables it reads.

    A row stands for the windows ``nth`` to ``last``, ``words`` in number; ``d0`` is the smallest id that keeps one.
    """
    blocks = settle(window_blocks(docs, size, id_col, text_col))
    shared = settle(
        blocks.groupBy("anchor")
        .agg(F.count("*").alias("places"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where("places > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    )
    # Both sides are dealt for the join alone, so Spark can split a hot anchor's blocks.
    held = settle(blocks.join(shared, "anchor"))
    discard(blocks, shared)
    firsts = held.groupBy("anchor", "digest").agg(
        F.min(_rank()).alias("first"), F.max(_rank()).alias("final"), F.min("n").alias("n"), F.min("mixed").alias("mixed")
    )
    # A later place of a block repeats all its windows. Only where blocks with one anchor differ can a first place's
    # windows recur elsewhere, and there the first places hold the first of every window.
    unlike = firsts.where("mixed").select("first.doc", "first.th", "first.nth", "n", "anchor", "digest")
    single = settle(block_windows(docs, unlike, size, id_col, text_col))
    marks = single.groupBy("anchor", "mark").agg(F.min(_rank()).alias("first"), F.max(_rank()).alias("final"))
    later = settle(
        single.join(marks.where(F.col("first") != F.col("final")), ["anchor", "mark"])
        .where(_rank() != F.col("first"))
        .select(*_RANK, "s", "e", "anchor", "digest", F.col("first.doc").alias("d0"))
    )
    discard(single)
    inner = later.groupBy("anchor", "digest").agg(F.min("d0").alias("inner"))
    again = (
        firsts.where(F.col("first") != F.col("final"))
        .join(inner, ["anchor", "digest"], "left")
        .select("anchor", "digest", "first", F.least("first.doc", "inner").alias("d0"))
    )
    whole = held.join(again, ["anchor", "digest"]).where(_rank() != F.col("first"))
    last = (F.col("nth") + F.col("n") - 1).alias("last")
    found = whole.select(*_RANK, last, "s", "e", F.col("n").alias("words"), "d0").unionByName(
        later.select(*_RANK, F.col("nth").alias("last"), "s", "e", F.lit(1).alias("words"), "d0")
    )
    return found, [held, later]


def repeated_units(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(level, doc, th, start, end, n_units, n_words, kept_in) of every line and paragraph of ``min_words`` words or more that
    isn't the earliest with its digest. A line and a paragraph are no copies of each other.

    Defined cases are those of ``repeated_spans``.
    """
    found = settle(unit_rows(docs, min_words, id_col, text_col))
    rank = lambda: F.struct(F.col("doc").isNull().alias("late"), "doc", "th", "s")
    keys = ["level", "k0", "k1"]
    firsts = settle(found.groupBy(*keys).agg(F.min(rank()).alias("first"), F.max(rank()).alias("final")).where("first <> final"))
    again = found.join(firsts, keys).where(rank() != F.col("first"))
    # Equal rows of one document repeat its units alike.
    once = again.groupBy("level", "doc", "th", "s", "e").agg(F.max("words").alias("words"), F.min("first.doc").alias("d0"))
    out = settle(once.select(
        "level", "doc", "th", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(1).cast("long").alias("n_units"),
        F.col("words").cast("long").alias("n_words"), F.col("d0").alias("kept_in"),
    ))
    discard(found, firsts)
    return out


def repeated_windows(docs: DataFrame, min_words: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(level, doc, th, start, end, n_units, n_words, kept_in) of every place where ``min_words`` words or more follow each other
    as at an earlier place, in whatever case and spacing, covered whole; ``n_words`` counts each word once.

    Defined cases are those of ``repeated_spans``.
    """
    again, read = _repeated_windows(docs, min_words, id_col, text_col)
    # Equal rows of one document repeat all its units alike, so they go on as one.
    each = again.groupBy("doc", "th", "nth").agg(
        F.max("last").alias("last"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("words").alias("words"), F.min("d0").alias("d0")
    )
    inside = Window.partitionBy("doc", "th").orderBy("nth")
    opens = F.col("nth") > F.coalesce(F.lag("last").over(inside), F.lit(-2)) + 1
    spans = (
        each.withColumn("opens", opens.cast("int"))
        .withColumn("run", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "th", "run")
        .agg(
            F.min("s").alias("start"),
            F.max("e").alias("end"),
            (F.max("last") - F.min("nth") + 1).cast("long").alias("n_units"),
            (F.sum("words") + min_words - 1).cast("long").alias("n_words"),  # the last window has words after its first
            F.min("d0").alias("kept_in"),
        )
        .select(F.lit("window").alias("level"), "doc", "th", "start", "end", "n_units", "n_words", "kept_in")
    )
    spans = settle(spans)
    discard(*read)
    return spans


def repeated_spans(
    docs: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    min_words: int = 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(level, doc, th, start, end, n_units, n_words, kept_in) of every span to remove, at each of ``levels``.

    A unit is repeated unless it is the earliest occurrence of its digest by id and place in the text. At the levels
    ``line`` and ``paragraph`` each repeated unit of ``min_words`` words or more is a span; at the level ``window`` runs of
    repeated windows are. Spans of different levels overlap; ``remove_spans`` takes their union. Offsets are code points of
    the original text, end exclusive. ``kept_in`` is the smallest id that keeps one of the span's units.

    Defined cases: null and empty texts have no units; a null id ranks after every id; texts of one id rank
    by their hash; rows with one id and text are one document, and each loses the same spans; windows overlap, so a text that
    repeats itself keeps the start of its first round; an empty table gives an empty result.
    """
    parts = []
    if set(levels) & {"line", "paragraph"}:
        parts.append(repeated_units(docs, min_words, id_col, text_col).where(F.col("level").isin(*levels)))
    if "window" in levels:
        parts.append(repeated_windows(docs, min_words, id_col, text_col))
    return functools.reduce(DataFrame.unionByName, parts)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of their texts; spans may overlap.

    Defined cases: a null text stays null, a row without spans as it is; a null id matches spans of null ids with that text.
    """
    cuts = spans.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cuts")
    )
    rows = packed(docs, _id=F.col(id_col).cast("long"), _text=F.col(text_col), _at=F.xxhash64(text_col))
    joined = rows.join(cuts, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_th")), "left")
    text = F.col("_text")
    # What stays before each cut: from the furthest end of the cuts before it.
    kept = F.aggregate(
        "_cuts",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["text"], F.substr(text, s["at"] + 1, F.greatest(c["start"] - s["at"], F.lit(0)))).alias("text"), F.greatest(s["at"], c["end"]).alias("at")
        ),
    )
    cut = F.concat(kept["text"], F.substr(text, kept["at"] + 1))
    return unpacked(joined, docs.columns, **{text_col: F.when(F.col("_cuts").isNull(), text).otherwise(cut)})
