"""Token counts of every prefix of a text, by dynamic programming over the vocabulary of a byte-fallback BPE model.

A sequence of pieces is what the model makes of their text exactly if each two neighbours are what it makes of theirs.
So the last piece of a prefix is the one piece that ends there and agrees with the last piece of the shorter prefix
before it, and a prefix has one token more than that one. One pass over a text thus gives the count of each of its
prefixes, and truncation and budget questions are answered from the counts alone, without encoding anything again.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.text import map_rows

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # Fixed value: how the model writes a space.
HELD = 200_000  # words that a Python worker remembers, twice: the latest and those before them
LONGEST_HELD = 64  # characters of a word that is remembered
TOGETHER = 1_000_000  # characters of texts that are counted together, or one text


class Agreements:
    """Which pairs of pieces stay apart, and whole, in their common text: a table with open addressing, read in one go.

    It forgets all when it is over half full, so memory stays the same however many pairs a corpus has.
    """

    def __init__(self, pieces: list[str], scores: dict[str, float], bits: int = 20):
        self.pieces, self.scores, self.bits = pieces, scores, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, bool)
        self.size = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of piece numbers; number 0 on the left is a word's start."""
        keys = left << 32 | right
        slots, found, open_ = self.slots(keys), np.zeros(len(keys), bool), np.arange(len(keys))
        missing = []
        while len(open_):
            there = self.keys[slots[open_]]
            same = there == keys[open_]
            found[open_[same]] = self.values[slots[open_[same]]]
            missing.append(open_[there == -1])
            open_ = open_[~same & (there != -1)]
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
        new, back = np.unique(keys[(lost := np.concatenate([*missing, open_]))], return_inverse=True)
        fresh = np.array([self.agree(self.pieces[k >> 32], self.pieces[k & 0xFFFFFFFF]) for k in new.tolist()], bool)
        found[lost] = fresh[back]
        self.remember(new, fresh)
        return found

    def remember(self, keys: np.ndarray, values: np.ndarray) -> None:
        for key, slot, value in zip(keys.tolist(), self.slots(keys).tolist(), values.tolist(), strict=True):
            if 2 * self.size > len(self.keys):
                self.clear()
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value
            self.size += 1

    def agree(self, left: str, right: str) -> bool:
        """Pairs are merged by the best score first, then from the left, until a merge crosses the border or none is left."""
        parts, none = list(left + right), -np.inf
        scores = [self.scores.get(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        border = len(left) - 1
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            if k == border:
                return False
            border -= k < border
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = self.scores.get(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = self.scores.get(parts[k] + parts[k + 1], none)
        return border <= 0 and len(parts) == 1 + bool(left)


class Prefixes:
    """Counts of the prefixes of words, remembered in part; ``scores`` maps each mergeable piece to its score.

    A text is cut where no piece can lie: before spaces, and round line breaks where the vocabulary allows that. The
    rest of the text doesn't change the pieces of such a word. A character outside the vocabulary counts one token for
    each of its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float]):
        pieces = ["", *scores]
        self.agreements = Agreements(pieces, scores)
        self.longest = max(map(len, pieces))
        self.joined = any(p.lstrip(SPACE).find(SPACE) > 0 for p in scores)
        self.breaks = not any("\n" in p for p in scores if len(p) > 1)
        # The pieces, read from their ends, as arcs (node, character) in order, each with its next node and the piece there.
        self.codes = np.zeros(0x110000, np.int64)
        alphabet = sorted({c for p in scores for c in p})
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        arcs: dict[int, list[int]] = {}
        for number, piece in enumerate(pieces[1:], 1):
            node = 0
            for code in self.codes[[ord(c) for c in reversed(piece)]].tolist():
                arc = arcs.setdefault(node << 21 | code, [len(arcs) + 1, 0])
                node = arc[0]
            arc[1] = number
        self.arcs = np.array(sorted(arcs), np.int64)
        self.nodes, self.ending = np.array([arcs[k] for k in self.arcs.tolist()], np.int64).reshape(-1, 2).T.copy()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text, with a space before it; joined they are the text as the model sees it."""
        if self.joined:
            return [SPACE + text.replace(" ", SPACE)]
        text = f"{SPACE}{text}".replace(" ", f" {SPACE}")
        while f"{SPACE} {SPACE}" in text:
            text = text.replace(f"{SPACE} {SPACE}", SPACE + SPACE)
        return (text.replace("\n", " \n ") if self.breaks else text).split(" ")

    def steps(self, words: list[str]) -> np.ndarray:
        """By how many tokens the count changes with each character of each of these words, one after another."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        codes = self.codes[flat]
        ends, starts, numbers = self.matches(codes, place)
        last, counts = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        size = 1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)
        by_place, by_end = np.argsort(place, kind="stable"), np.argsort(place[ends], kind="stable")
        chars = np.cumsum(np.bincount(place))
        pieces = np.cumsum(np.bincount(place[ends], minlength=len(chars)))
        for k in range(len(chars)):  # the k-th character of all words at once
            at = by_place[chars[k - 1] if k else 0 : chars[k]]
            counts[at] = size[at] + (counts[at - 1] if k else 0)
            here = by_end[pieces[k - 1] if k else 0 : pieces[k]]
            end, start, number = ends[here], starts[here], numbers[here]
            inner = place[start] > 0
            good = self.agreements.of(np.where(inner, last[start - 1], 0), number)
            counts[end[good]] = 1 + np.where(inner, counts[start - 1], 0)[good]
            last[end[good]] = number[good]
        return counts - np.where(place > 0, np.roll(counts, 1), 0)

    def matches(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, number) of all places where a piece lies inside a word."""
        ends = np.flatnonzero(codes)
        node, out = np.zeros(len(ends), np.int64), [(ends[:0], ends[:0], ends[:0])]
        for back in range(self.longest):
            inside = place[ends] >= back
            ends, node = ends[inside], node[inside]
            keys = node << 21 | codes[ends - back]
            arc = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            there = self.arcs[arc] == keys
            ends, arc = ends[there], arc[there]
            node, number = self.nodes[arc], self.ending[arc]
            whole = number > 0
            out.append((ends[whole], ends[whole] - back, number[whole]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def steps_of_long(self, word: str) -> np.ndarray:
        """``steps`` of one word of any length, character by character: its neighbours are few beside its length."""
        codes = self.codes[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        ends, starts, numbers = self.matches(codes, np.arange(len(codes)))
        order = np.argsort(ends, kind="stable")
        last, counts, settled, pairs = [0], [0], 0, {}

        def unknown(to: int) -> None:
            """Characters at which no piece ends; what follows them starts anew."""
            for c in word[settled:to]:
                last.append(0)
                counts.append(counts[-1] + len(c.encode()))

        for end, start, number in zip(ends[order].tolist(), starts[order].tolist(), numbers[order].tolist(), strict=True):
            if end < settled:
                continue
            if end > settled:
                unknown(end)
                settled = end
            pair = last[start], number
            if pair not in pairs:
                if len(pairs) >= HELD:
                    pairs.clear()
                pairs[pair] = self.agreements.agree(self.agreements.pieces[pair[0]], self.agreements.pieces[number])
            if pairs[pair]:
                last.append(number)
                counts.append(counts[start] + 1)
                settled += 1
        unknown(len(word))
        return np.diff(np.array(counts, np.int64))

    def learn(self, words: list[str]) -> None:
        """Remember ``steps`` of these words as one signed byte each, if they fit."""
        steps, at = self.steps(words), 0
        small = steps.astype(np.int8)
        packed, fits = small.tobytes(), bool((small == steps).all())
        for word in words:
            to = at + len(word)
            if fits or (small[at:to] == steps[at:to]).all():
                self.known[word] = packed[at:to]
            at = to

    def packed(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """Tokens of each whole text, and the steps at all its characters, compressed; the first byte is their width."""
        split = [self.words(t) if t else [] for t in texts]
        distinct = set().union(*split)
        if len(self.known) >= HELD:
            self.older, self.known = self.known, {"": b""}
        for word in distinct - self.known.keys():
            if word in self.older:
                self.known[word] = self.older[word]
        if new := [w for w in distinct - self.known.keys() if len(w) <= LONGEST_HELD]:
            self.learn(new)
        for words in split:
            if not words:
                yield 0, b""
                continue
            parts = list(map(self.known.get, words))
            if None not in parts:
                steps = np.frombuffer(b"".join(parts), np.int8)
            else:
                own = [self.steps_of_long(w) if p is None else np.frombuffer(p, np.int8) for w, p in zip(words, parts, strict=True)]
                steps = np.concatenate(own)
            # The first step is that of the space put before the text; it goes to the text's first character.
            own = steps[1:].astype(np.int32)
            own[0] += steps[0]
            small = own.astype(np.int8)
            own = small if (small == own).all() else own
            yield int(steps.sum(dtype=np.int64)), bytes([own.itemsize]) + zlib.compress(own.tobytes(), 1)


def unpacked(store: bytes) -> np.ndarray:
    """Tokens of the text's first 0, 1, 2, ... characters."""
    if not store:
        return np.zeros(1, np.int64)
    steps = np.frombuffer(zlib.decompress(store[1:]), np.int8 if store[0] == 1 else np.int32)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def grouped(rows: Iterator, size: Callable) -> Iterator[list]:
    """Lists of rows in order, each of ``TOGETHER`` characters or little more, or one long row."""
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size(row)
        if total >= TOGETHER:
            yield group
            group, total = [], 0
    if group:
        yield group


@functools.lru_cache(maxsize=2)
def prefixes_of(model: str) -> Prefixes:
    """The vocabulary of a model file: a path, or the name of an installed public one."""
    import sentencepiece

    if not os.path.isabs(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    spm = sentencepiece.SentencePieceProcessor(model_file=str(model))
    usable = [i for i in range(spm.get_piece_size()) if not (spm.is_unknown(i) or spm.is_control(i) or spm.is_byte(i))]
    return Prefixes({spm.id_to_piece(i): spm.get_score(i) for i in usable})


def prefix_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc, n_chars, n_bytes, n_tokens, prefix_tokens): the counts of all prefixes of each row's whole text.

    A null text counts as empty, and an empty one has no token; null ids and repeated rows stay as they are, and further
    columns of ``docs`` are ignored. ``prefix_tokens`` holds the step from each prefix to the next, compressed, and is
    read by ``answers``. One map over the rows: nothing is shuffled, and a task holds one text's counts at a time.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"))

    def run(found: Iterator[dict]) -> Iterator[dict]:
        table = prefixes_of(model)
        for group in grouped(found, lambda row: len(row["text"])):
            for row, (n, store) in zip(group, table.packed([r["text"] for r in group]), strict=True):
                text = row["text"]
                yield {"doc": row["doc"], "n_chars": len(text), "n_bytes": len(text.encode()), "n_tokens": n, "prefix_tokens": store}

    arrow = pa.schema([("doc", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("prefix_tokens", pa.binary())])
    return map_rows(rows, run, "doc long, n_chars long, n_bytes long, n_tokens long, prefix_tokens binary", arrow, out_rows=500)


def answers(counted: DataFrame, budget: Column, at: Column) -> DataFrame:
    """``prefix_counts``'s rows with (cut_chars, tokens_at) in place of the counts' column.

    ``cut_chars`` is the length of the longest prefix that takes ``budget`` tokens or fewer; counts may fall with one more
    character, so a longer prefix can fit where a shorter one doesn't. ``tokens_at`` is the count of the first ``at``
    characters, of the whole text where it is shorter. A null budget or place, or a negative one, gives null.
    """
    asked = counted.select("*", budget.cast("long").alias("_budget"), at.cast("long").alias("_at"))

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            counts, most, place = unpacked(row.pop("prefix_tokens")), row.pop("_budget"), row.pop("_at")
            fitting = None if most is None or most < 0 else int(np.flatnonzero(counts <= most)[-1])
            known = None if place is None or place < 0 else int(counts[min(place, len(counts) - 1)])
            yield row | {"cut_chars": fitting, "tokens_at": known}

    names = ("doc", "n_chars", "n_bytes", "n_tokens", "cut_chars", "tokens_at")
    return map_rows(asked, run, ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))


def truncated(docs: DataFrame, limit: int, model: str = MODEL) -> DataFrame:
    """``docs`` with every text cut to its longest prefix of at most ``limit`` tokens, and ``n_tokens`` of what is left.

    A null text stays null with 0 tokens. A column ``n_tokens`` of ``docs`` is replaced; other columns stay as they are.
    """
    import pyspark.sql.types as T

    names = [c for c in docs.columns if c != "n_tokens"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:1], T.StructField("_cut", T.LongType()), T.StructField("_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefixes_of(model)
        for batch in batches:
            cuts, left = [], []
            for group in grouped(iter(batch.column("_text").to_pylist()), len):
                for _, store in table.packed(group):
                    counts = unpacked(store)
                    cuts.append(int(np.flatnonzero(counts <= limit)[-1]))
                    left.append(int(counts[cuts[-1]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(cuts, pa.int64()), pa.array(left, pa.int64())], names=["_row", "_cut", "_n"]
            )

    done = rows.mapInArrow(run, schema)
    cut = F.expr("substring(_row.text, 1, int(_cut))")
    own = [(cut if c == "text" else F.col("_row").getField(c)).alias(c) for c in names]
    return done.select(*own, F.col("_n").alias("n_tokens"))
