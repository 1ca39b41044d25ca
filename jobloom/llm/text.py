"""Text helpers shared by the corpus operators: native expressions, and word hashing inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The whitespace set and the word pattern of the result contracts.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same, and faster, where every code point is one byte."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def count_words(c: Column) -> Column:
    """Number of words of a text as a long; null counts 0."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once a row: filters and later columns don't repeat its expression.

    The optimizer copies a column's expression into the filters and lambdas that use it; it doesn't through explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``df`` as one struct column ``_row`` beside ``keys``, so that joins meet none of its own column names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[k.alias(n) for n, k in keys.items()])


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns ``names`` of ``_row`` again, those in ``new`` replaced, further ones in ``new`` appended."""
    own = [new.get(c, F.col("_row").getField(c)).alias(c) for c in names]
    return df.select(*own, *[v.alias(c) for c, v in new.items() if c not in names])


def digest128(c: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes of one string."""
    return [F.xxhash64(c), F.xxhash64(F.lit(7), c)]


class WordHash(dict):
    """64-bit hash of a word, remembered per task; emptied when it holds ``limit`` words."""

    limit = 400_000

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words in order; a shorter sequence is one shingle, none gives none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    acc = np.full(count, np.uint64(n))
    for k in range(n):
        acc = acc * _ODD + words[k : k + count]
    return scramble(acc)


def map_rows(
    df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, arrow_schema: pa.Schema, out_rows: int = 2000
) -> DataFrame:
    """Run ``fn`` over the rows of every partition as dicts, in Arrow batches both ways.

    Batches go out every ``out_rows`` rows, so memory stays bounded by the batch and not by the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from batch.slice(at, 256).to_pylist()

        held: list[dict] = []
        for row in fn(rows()):
            held.append(row)
            if len(held) >= out_rows:
                yield pa.RecordBatch.from_pylist(held, schema=arrow_schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow_schema)

    return df.mapInArrow(run, schema)
