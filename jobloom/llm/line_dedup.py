"""Line deduplication by range-partitioned line hashes, answered with compressed keep bitmaps.

Every long enough line becomes (hash, document, position). Rows are range-partitioned by hash and sorted by hash,
document and position, so that a task streams over each hash's occurrences in order; the document that keeps the
line comes first. Hashes too frequent for one task are split off: they are few (each holds more than a task's
share of all rows), so their statistics are aggregated map-side first and the short list is joined back.

Only native DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.text import SPACES, ascii_lower, digest128, hold, packed, unpacked
from jobloom.session import settle

HOT_FLOOR = 1000


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, th, pos, h1, h2) of every line whose key has ``min_chars`` code points. th tells texts of one id apart."""
    one = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    lines = one.select(
        "doc", F.xxhash64("text").alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    keyed = lines.select("doc", "th", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where(
        F.char_length("line") >= min_chars
    )
    h1, h2 = digest128(ascii_lower(F.col("line")))
    return keyed.select("doc", "th", "pos", h1.alias("h1"), h2.alias("h2"))


def _runs(dropped):
    """Run lengths kept, dropped, kept, dropped ... of sorted dropped positions; the kept tail is left out."""
    at = lambda a, i: F.get(a, i)
    starts = F.filter(dropped, lambda p, i: (i == 0) | (p != at(dropped, i - 1) + 1))
    ends = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (p + 1 != at(dropped, i + 1)))
    return starts, ends


def keep_bitmaps(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Compressed keep bitmaps: (doc, th, n_dropped, keep_runs) for every text that loses lines.

    ``keep_runs`` is the run-length form of the bitmap: numbers of kept, dropped, kept, dropped ... lines; lines
    after the last run are kept. ``th`` is ``xxhash64`` of the text.

    A key is the line without whitespace at its ends, A-Z lower-cased. A key of ``min_chars`` code points or more
    in ``min_docs`` documents or more stays only in the largest document id that holds it.

    Defined cases: a null text is one empty line; a null id is one more document, smaller than every other; rows
    that share an id are one document, each with its own bitmap; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = settle(_line_rows(docs, id_col, text_col, min_chars))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequent = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    total = rows.count()
    share = max(HOT_FLOOR, total // (2 * parts))
    # Fewer than 2 * parts hashes can hold more than this share each, so the list is bounded.
    hot = F.broadcast(settle(frequent.where(F.col("n") > share).select("h1", "h2")))

    cold = rows.join(hot, ["h1", "h2"], "left_anti")
    by_hash = Window.partitionBy("h1", "h2").orderBy(F.col("doc").desc_nulls_last())
    streamed = (
        cold.repartitionByRange(parts, "h1", "h2")
        .sortWithinPartitions("h1", "h2", F.col("doc").desc_nulls_last(), "pos")
        .withColumn("keeper", F.first("doc").over(by_hash))
        .withColumn("nth", F.dense_rank().over(by_hash))
        .withColumn("docs", F.max("nth").over(Window.partitionBy("h1", "h2")))
        .where((F.col("docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("keeper")))
        .select("doc", "th", "pos")
    )
    hot_rows = rows.join(hot, ["h1", "h2"], "left_semi")
    of_hot = (
        hot_rows.groupBy("h1", "h2", "doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs)
    )
    from_hot = (
        hot_rows.join(F.broadcast(of_hot), ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .select("doc", "th", "pos")
    )
    dropped = (
        streamed.unionByName(from_hot)
        .groupBy("doc", "th")
        .agg(F.collect_set("pos").alias("found"))
    )
    dropped = hold(dropped, "dropped", F.array_sort("found"))
    starts, ends = _runs(F.col("dropped"))
    runs = hold(hold(dropped, "s", starts), "e", ends)
    lengths = F.transform(
        "s", lambda s, i: F.array(s - F.coalesce(F.get("e", i - 1), F.lit(-1)) - 1, F.get("e", i) - s + 1)
    )
    return runs.select("doc", "th", F.size("dropped").cast("long").alias("n_dropped"), F.flatten(lengths).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept``: the text without the lines its bitmap drops.

    Columns of ``docs`` with one of these three names are replaced.
    """
    maps = bitmaps.select(
        F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("n_dropped").alias("_n"), F.col("keep_runs").alias("_runs")
    )
    rows = packed(docs, _id=F.col(id_col), _text=F.col(text_col), _at=F.xxhash64(text_col))
    joined = rows.join(maps, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_th")), "left")
    lines = split_lines(F.col("_text"))
    flags = F.flatten(F.transform("_runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.transform(
        F.filter(
            F.arrays_zip(lines.alias("line"), flags.alias("keep")), lambda x: F.coalesce(x["keep"], F.lit(True))
        ),
        lambda x: x["line"],
    )
    whole = F.when(F.col("_n").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = {"_n_lines": F.size(lines).cast("long"), "_n_dropped": F.coalesce("_n", F.lit(0)).cast("long")}
    return unpacked(joined, docs.columns, **counts, _kept=whole)


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """Every document with its repeated lines removed, in the columns of ``docs``; a text may become empty."""
    ids = {k: v for k, v in how.items() if k in ("id_col", "text_col")}
    text = how.get("text_col", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, **how), **ids)
    out = out.withColumn(text, F.when(F.col("_n_dropped") > 0, F.col("_kept")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
